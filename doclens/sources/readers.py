"""Documents, truths and manifests from files; reports to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 25 * 1024 * 1024
REQUIRED = ("document_type", "patient_name", "doctor_name", "date", "medications", "test_results", "tests", "diagnoses", "symptoms", "allergies")
OPTIONAL = ("medication_mentions", "vitals", "panels", "notes")


def gate(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """files(…, content) with `kind`, `raw_text` and `error`: PDFs, empty files and those over the limit are named, not read."""
    kind = F.when(F.substring("content", 1, 5).cast("string") == "%PDF-", "pdf").otherwise("text")
    size = F.octet_length("content")
    error = F.when(size > most, "file_too_large").when(F.coalesce(size, F.lit(0)) == 0, "empty_file").when(kind == "pdf", "needs a PDF reader")
    return files.withColumns({"kind": F.coalesce(kind, F.lit("text")), "error": error}).withColumn("raw_text", F.when(F.col("error").isNull(), F.col("content").cast("string")))


def documents(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """(path, stem, kind, raw_text, error): files of a folder."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return gate(files, most).select("path", stem.alias("stem"), "kind", "raw_text", "error")


KINDS = ("prescription", "lab_report", "discharge_summary", "medical_invoice", "pharmaceutical_information", "other_medical", "unknown")
#: Records of a truth file with the values that each must have, or (vitals) may have.
TRUTH_RECORDS = {
    "medications": ("name", "dosage", "frequency", "duration"), "medication_mentions": ("name", "dosage", "frequency", "duration"), "test_results": ("name", "value", "unit", "reference_range"),
    "vitals": ("name", "value", "unit", "reference_range"),
}
TRUTH_SINGLE = ("patient_name", "doctor_name", "date")
TRUTH_LISTS = ("tests", "diagnoses", "symptoms", "allergies", "panels")


def truth_keys(truths: DataFrame, text: str = "json") -> DataFrame:
    """truths with the keys that a truth file lacks, those that it may not have, the `items` whose keys aren't those of their
    record, and whether its document_type is `bad_type`."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    known = F.array(*map(F.lit, REQUIRED + OPTIONAL))

    def wrong(field: str, subs: tuple[str, ...]) -> Column:
        have = F.transform(F.from_json(F.get_json_object(text, f"$.{field}"), "array<string>"), F.json_object_keys)
        allowed = F.array(*map(F.lit, subs))
        lacks = lambda k: F.size(F.array_except(allowed, k)) > 0
        bad = lambda k: k.isNull() | (F.size(F.array_except(k, allowed)) > 0) | (lacks(k) if field != "vitals" else F.lit(False))
        return F.when(F.coalesce(F.exists(have, bad), F.lit(False)), field)

    kind = F.get_json_object(text, "$.document_type")
    return truths.withColumns({
        "missing": F.array_except(F.array(*map(F.lit, REQUIRED)), keys), "unknown": F.array_except(keys, known), "items": F.filter(F.array(*(wrong(*r) for r in TRUTH_RECORDS.items())), lambda f: f.isNotNull()),
        "bad_type": ~F.coalesce(kind.isin(*KINDS), F.lit(False)),
    })


def _alternatives(json: Column) -> Column:
    """A JSON text or list of texts as an array; of null an empty one."""
    given = F.trim(json)
    return F.when(json.isNull() | (given == "null"), F.array().cast("array<string>")).when(given.startswith("["), F.from_json(json, "array<string>")).otherwise(F.array(json))


def truth_values(truths: DataFrame, text: str = "json") -> DataFrame:
    """(doc_id, field, item_no, sub, alternatives) of truths(doc_id, json): every value of every truth file, a text or a list of
    accepted texts alike as an array, null as an empty one; values that a record doesn't have give no row."""
    # strings lose their quotes and lists stay JSON in a map of strings
    top = truths.select("doc_id", F.from_json(text, "map<string,string>").alias("m"))
    row = lambda field, no, sub, value: F.struct(F.lit(field).alias("field"), no.cast("int").alias("item_no"), sub.alias("sub"), _alternatives(value).alias("alternatives"))

    def listed(f: str) -> Column:
        return F.transform(F.from_json(F.col("m")[f], "array<string>"), lambda v, i: row(f, i, F.lit("text"), v))

    def recorded(f: str) -> Column:
        values = lambda r, i: F.transform(F.map_entries(r), lambda e: row(f, i, e["key"], e["value"]))
        return F.flatten(F.transform(F.from_json(F.col("m")[f], "array<map<string,string>>"), values))

    rows = [*(F.array(row(f, F.lit(0), F.lit("text"), F.col("m")[f])) for f in TRUTH_SINGLE), *map(listed, TRUTH_LISTS), *map(recorded, TRUTH_RECORDS)]
    none = F.array().cast("array<struct<field:string,item_no:int,sub:string,alternatives:array<string>>>")
    return top.select("doc_id", F.inline(F.concat(*(F.coalesce(r, none) for r in rows))))


def longest_stem(names: DataFrame, stems: DataFrame) -> DataFrame:
    """(name, stem): the longest stem that is the name or its beginning before "_"; null if none. Each name is looked up by
    its own prefixes, so nothing is compared with everything."""
    parts = F.split("name", "_")
    tries = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "_"))).alias("stem"))
    found = tries.join(stems.select("stem").distinct(), "stem").groupBy("name").agg(F.max_by("stem", F.length("stem")).alias("stem"))
    return names.select("name").distinct().join(found, "name", "left")


def manifest_problems(listed: DataFrame, files: DataFrame) -> DataFrame:
    """(name, problem) from listed(name, digest) and files(name, content): missing, changed or added."""
    a = listed.select("name", "digest").alias("a")
    b = files.select("name", F.sha2(F.col("content"), 256).alias("found")).alias("b")
    problem = F.when(F.col("b.found").isNull(), "missing").when(F.col("a.digest").isNull(), "added").when(F.col("a.digest") != F.col("b.found"), "changed")
    return a.join(b, "name", "full_outer").select("name", problem.alias("problem")).where("problem is not null")


def write_report(scores: DataFrame, path: str) -> None:
    """Scores as JSON lines."""
    scores.write.mode("overwrite").json(path)


def markdown(scores: DataFrame) -> DataFrame:
    """One row: scores(field, tp, fp, fn, precision, recall) as a Markdown table, fields in order. A field is a line, so this is small."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, ("field", "tp", "fp", "fn", "precision", "recall"))), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct("field", line.alias("line"))))
    head = F.lit("| field | tp | fp | fn | precision | recall |\n|-|-|-|-|-|-|\n")
    return scores.agg(F.concat(head, F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("markdown"))


def markdown_documents(scores: DataFrame) -> DataFrame:
    """(doc_id, markdown): a line of a table for each document of scores(doc_id, document_type, status, tp, fp, fn)."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return scores.select("doc_id", F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, ("doc_id", "document_type", "status", "tp", "fp", "fn"))), F.lit(" |")).alias("markdown"))


def image_coverage(boxes: DataFrame) -> DataFrame:
    """(doc_id, page, coverage) from boxes(doc_id, page, width, height, x0, y0, x1, y1): the share of a page's area that its image
    objects take up, each clipped to the page; null for a page without area."""
    side = lambda low, high, most: F.greatest(F.lit(0.0), F.least(high, most) - F.greatest(low, F.lit(0.0)))
    c = F.col
    area = side(c("x0"), c("x1"), c("width")) * side(c("y0"), c("y1"), c("height"))
    sums = boxes.groupBy("doc_id", "page", "width", "height").agg(F.sum(area).alias("a"))
    return sums.select("doc_id", "page", F.try_divide(c("a"), c("width") * c("height")).alias("coverage"))
