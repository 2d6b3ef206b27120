"""Whole records of documents whose pages arrive one by one, late, and again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from doclens.operators import pages

PAGES = "doc_id long, page int, source string, text string, confidence array<double>, visible int, truncated boolean, blank boolean, error string, arrived timestamp"


def read_pages(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Pages as a reader gives them (see operators.pages), with the time of their arrival, from Parquet files in a folder."""
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def assembled(stream: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(doc_id, closed, pages): a document's pages, once no page of it has come for `gap`.

    The state of an open document is its pages; they leave it when the watermark, `late` behind the newest arrival, has passed the
    gap after the last one. A page that comes later than that counts as a document of its own pages, with a later `closed`. Pages
    without a doc_id, a number or a time are left out.
    """
    rows = stream.where("doc_id is not null and page is not null and arrived is not null").withWatermark("arrived", late)
    page = F.struct(*(c for c in rows.columns if c != "doc_id"))
    found = rows.groupBy(F.session_window("arrived", gap).alias("open"), "doc_id").agg(F.collect_list(page).alias("pages"))
    return found.select("doc_id", F.col("open.end").alias("closed"), "pages")


def once_each(documents: DataFrame) -> DataFrame:
    """(closed, doc_id, page, …) of assembled documents: of a page that came several times the first to arrive."""
    each = documents.select("closed", "doc_id", F.explode("pages").alias("p")).select("closed", "doc_id", "p.*")
    last = [F.xxhash64("text"), F.xxhash64("error")]
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("closed", "arrived", *last))
    return each.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "arrived")


def write_records(stream: DataFrame, out: str, checkpoint: str, gap: str = "10 minutes", late: str = "1 hour", finish: Callable[[DataFrame], DataFrame] = lambda r: r) -> StreamingQuery:
    """Records of documents made of pages (operators.pages.records) to Parquet, each batch to a folder of its own that is
    overwritten if the batch is run again, so that every document is written once. Several documents of one doc_id that close
    in one batch are taken together; `finish` may change the records before they are written."""

    def write(batch: DataFrame, number: int) -> None:
        found = once_each(batch).drop("closed")
        finish(pages.records(found)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return assembled(stream, gap, late).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
