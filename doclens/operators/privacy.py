"""What may not be published: paths, secrets in texts, aggregates that aren't numbers only, and settings with a token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens.functions import patterns as P

# Names that decide.
REAL_METADATA = ("README.md", "DATASET.md", "manifest.json", "truth_template.json")
AGGREGATE = "eval/reports/model_selection_real_world/summary.json"
BASELINE = "eval/aggregates/real_world_baseline.json"
REPORTS = "eval/reports/model_selection_real_world/"
SUMMARY = "eval/reports/SUMMARY.md"
FIXTURES = ("eval/dev/", "eval/heldout/", "eval/controls/")
PRIVATE_PARTS = ("prescription-data", "external-data", "datasets", "uploads", "tmp", "hf_cache", "huggingface", "models", ".cache", ".venv", "privacy-recovery")
MEDIA = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp", "gif", "heic", "heif", "pdf")
WEIGHTS = ("safetensors", "gguf", "pt", "pth", "bin", "ckpt", "zip", "tar", "gz", "7z", "bundle")
RAW_KEYS = ("raw_text", "text", "transcription", "model_wrote", "source_line", "patient_name", "doctor_name", "documents_detail")


def path_problem(path: Column) -> Column:
    """Why a path may not be published, or null; the first rule that applies. One aggregate is allowed whatever follows. Below a
    folder whose name begins with real_world only its metadata may be."""
    parts, name = F.split(path, "/"), F.regexp_extract(path, "([^/]*)$", 1)
    suffix = F.when(name.rlike(r"^[.][^.]*$"), "").otherwise(F.lower(F.regexp_extract(name, r"[.]([^.]+)$", 1)))
    real = F.array_position(F.transform(parts, lambda p: p.startswith("real_world")), F.lit(True))
    metadata = (F.size(parts) == real + 1) & name.isin(*REAL_METADATA)
    fixture = F.lit(False)
    for f in FIXTURES:
        fixture = fixture | path.startswith(f)
    return (
        F.when(F.arrays_overlap(parts, F.array(*map(F.lit, PRIVATE_PARTS))), "private folder")
        .when((name == ".env") | (name.startswith(".env.") & (name != ".env.example")), "environment file")
        .when(suffix.isin(*WEIGHTS), "weights or archive").when(path == BASELINE, None).when((real > 0) & ~metadata, "real source or annotation")
        .when(path.startswith(REPORTS) & (path != AGGREGATE), "report of single real documents").when(path == SUMMARY, "combined report")
        .when(suffix.isin(*MEDIA) & ~fixture, "media outside fixtures")
    )


def has_secret(text: Column) -> Column:
    return text.rlike(P.SECRET)


#: A JSON string and, in group 2, the colon after it if it is a key.
LITERAL = r'"((?:[^"\\]|\\.)*)"[ \t\n\r]*(:?)'


def numbers_only(json: Column) -> Column:
    """Is a text a JSON object of null, numbers and booleans only, at any depth, without a key that stands for raw text?"""
    literals = F.arrays_zip(F.regexp_extract_all(json, F.lit(LITERAL), F.lit(1)).alias("s"), F.regexp_extract_all(json, F.lit(LITERAL), F.lit(2)).alias("c"))
    plain = lambda s: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), F.lit(0)), s)
    keys_only = F.forall(literals, lambda x: (x["c"] == ":") & ~plain(x["s"]).isin(*RAW_KEYS))
    bare = F.regexp_replace(json, LITERAL, "$2")
    shape = F.trim(json).startswith("{") & ~bare.contains("[")
    return F.coalesce(F.try_parse_json(json).isNotNull() & shape & keys_only, F.lit(False))


def content_problem(path: Column, text: Column) -> Column:
    """Why a file's text may not be published, or null: a secret, an aggregate that isn't numbers only, a settings template that
    gives the token a value."""
    return (
        F.when(has_secret(text), "secret").when(path.isin(AGGREGATE, BASELINE) & ~numbers_only(text), "aggregate with text")
        .when(F.regexp_extract(path, "([^/]*)$", 1).eqNullSafe(".env.example") & text.rlike(P.TOKEN_LINE), "template with a token")
    )
