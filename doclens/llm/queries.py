"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm import decontam, filter_audit, licenses, lm_mixing, pii, quality_knn, quality_rules, simhash, sp_sampling, token_pack, toxicity, url_filter, whitening
from doclens.llm.common import new_path, table
from doclens.plans.session import ready


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files are; their package says so."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.query(spark, table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(ready(spark), sf_dir, t) for t in ("documents", "labels"))
    return toxicity.score(docs, toxicity.fit_chain(docs, labels))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(ready(spark), sf_dir, t) for t in ("documents", "labels"))
    return quality_rules.apply_rules(docs, quality_rules.fit_model(docs, labels))


def op5_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sp_sampling.encode(table(ready(spark), sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "sample", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "perturbed", "inclusion", "round_trip")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    return pii.find(docs, pii.fit_model(docs))


def op8_token_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(ready(spark), "packed")
    token_pack.write_packed(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), vocab_size=49408)
    return token_pack.read_packed(spark, path)


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(ready(spark), sf_dir, t) for t in ("documents", "labels"))
    space = quality_knn.fit_space(docs, labels.where(~quality_knn.held_out()))
    return quality_knn.score(docs, space).select("doc_id", quality_knn.held_out().alias("held_out"), "score", "predicted")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(ready(spark), sf_dir, "documents"))


def op11_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_mixing.score(table(ready(spark), sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.apply(table(ready(spark), sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(*(table(spark, sf_dir, t) for t in ("documents", "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_toxicity, op3_decontamination, op4_quality_rules, op5_sentencepiece_sampling, op6_license_scans, op7_pii, op8_token_pack, op9_quality_knn, op10_simhash_near_dedup, op11_lm_mixing, op12_embedding_whitening, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": url_filter.ORACLE, "op3_decontamination": decontam.ORACLE, "op6_license_scans": licenses.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
