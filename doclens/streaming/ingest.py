"""Documents as they arrive: the per-document part of the engine holds no state, so it runs on a stream as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclens.operators.classify import classify
from doclens.operators.extract import headers

#: Bytes of a document above which it is refused unread.
MAX_BYTES = 25 * 1024 * 1024


def read_folder(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(doc_id, path, raw_text) of text files in a folder, as they arrive; doc_id is a hash of the path."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.where(F.col("length") <= MAX_BYTES).select(F.xxhash64("path").alias("doc_id"), "path", F.col("content").cast("string").alias("raw_text"))


def classified(docs: DataFrame) -> DataFrame:
    """docs with kind, header values and the time of reading: one pass over the rows, without a shuffle or state."""
    kinds = classify(docs)
    first = lambda f: F.get(F.get(F.filter("headers", lambda h: h["field"] == f), F.lit(0))["parts"], F.lit(0))["text"].alias(f)
    rows = headers(kinds)
    return rows.select(*(c for c in rows.columns if c != "headers"), *map(first, ("doctor_name", "patient_name", "date")), F.current_timestamp().alias("read_at"))


def write(docs: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Classified documents to Parquet, exactly once for each file."""
    return classified(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
