from oracle import SF
from pyspark.sql import functions as F

import corpus_pipeline as C
from doclens.llm import decontam, pii, quality_knn, simhash, sp_sampling
from doclens.llm.common import written


def test_stages_against_their_operators(spark):
    """Each stage keeps or changes exactly the rows that its operator says."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~quality_knn.held_out())

    space = quality_knn.fit_space(docs, labels)
    kept = written(C.quality_classifier(spark, docs, SF), "t")
    assert ids(kept) == ids(quality_knn.score(docs, space).where("predicted = 1")) and 0 < kept.count() < docs.count()

    single = written(C.near_dedup(spark, kept, SF), "t")
    assert ids(single) == ids(simhash.near_duplicates(kept).where("doc_id = component_id"))

    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = written(C.decontamination(spark, single, SF), "t")
    assert ids(clean) == ids(single) - ids(decontam.find(single, benchmark))

    masked = written(C.personal_data(spark, clean, SF), "t")
    model = pii.fit_model(clean)
    before = {r.doc_id: r.text for r in clean.collect()}
    assert all(r.text == pii.masked(before[r.doc_id], pii.all_spans(before[r.doc_id], model)[1]) for r in masked.collect())
    assert all(df.columns == columns for df in (kept, single, clean, masked))

    last = C.sentencepiece_sampling(spark, masked, SF).cache()
    assert ids(last) == ids(masked) and last.where("not round_trip").count() == 0
    assert last.groupBy("doc_id").agg(F.count_distinct("ids").alias("n"), F.count("*").alias("m")).where(f"n <> m or m > {sp_sampling.SAMPLES}").count() == 0


def test_run_is_the_stages_in_turn(spark):
    names = [n for n, _ in C.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    assert C.run(spark, SF).count() > 0
