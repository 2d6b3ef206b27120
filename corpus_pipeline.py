"""From raw documents to sampled token ids: five of the corpus operators, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doclens.llm import decontam, near_copies, pii, quality_knn, simhash, sp_sampling
from doclens.llm.common import table, written
from doclens.llm.queries import tokenizer_path
from doclens.plans.session import ready


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote doesn't reject."""
    labels = table(ready(spark), sf_dir, "labels").where(~quality_knn.held_out())
    return quality_knn.keep(docs, quality_knn.fit_space(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by the contract of op10."""
    return simhash.one_of_each(docs)


def all_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What near_dedup keeps, and of texts with a similarity of 0.8 in five-word shingles, which fingerprints miss, one too."""
    return near_copies.one_of_each(near_dedup(spark, docs, sf_dir))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redact(docs, pii.fit_model(docs))


def sentencepiece_sampling(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, sample, ids, log_prob, perturbed, inclusion, round_trip): distinct segmentations of each document."""
    return sp_sampling.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", all_near_dedup),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", sentencepiece_sampling),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again."""
    docs = table(ready(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
