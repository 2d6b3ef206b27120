"""Checks of extracted values. They add reasons for review and never change a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions import patterns as P


def misreadings() -> list[tuple[str, str]]:
    """(seen, meant character) for every lexicon word with one character taken for another: lower case but for that one."""
    out = {}
    for word in P.LAB_LEXICON:
        for i, right in enumerate(word):
            for seen, may in P.CONFUSABLE.items():
                for meant in may:
                    if meant.lower() == right:
                        out.setdefault(word[:i] + seen + word[i + 1 :], meant)
    return sorted(out.items())


def meant_name(name: Column) -> Column:
    """What the name's first misread word may stand for, or null. A word is misread if it isn't in the lexicon, and is with
    one character swapped for one that it is confused with. The swaps are a literal map: they don't grow with the data."""
    known = misreadings()
    seen, meant_chars = (F.split(F.lit(",".join(x)), ",") for x in zip(*known))
    swaps = F.map_from_arrays(seen, meant_chars)  # folded to one literal
    # a map's entries are compared one by one, so only words that are among them, by hash, are looked up
    at = lambda key: F.when(key.isin([s for s, _ in known]), F.try_element_at(swaps, key))
    words = F.regexp_extract_all(name, F.lit(r"([A-Za-z0-9|]+(?:-[A-Za-z0-9]+)?)"), F.lit(1))
    char = lambda w, i: F.substring(w, i, 1)
    left, right = lambda w, i: F.substring(w, F.lit(1), i - 1), lambda w, i: F.substring(w, i + 1, F.length(w))

    def tried(w: Column) -> Column:
        meant = lambda i: at(F.concat(F.lower(left(w, i)), char(w, i), F.lower(right(w, i))))
        found = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(left(w, i), meant(i), right(w, i)))
        return F.when(~F.lower(w).isin(P.LAB_LEXICON) & w.rlike("[A-Za-z]"), F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))

    return F.get(F.filter(F.transform(words, tried), lambda m: m.isNotNull()), F.lit(0))


def confusable_names(names: DataFrame) -> DataFrame:
    """names(…, name) with `meant`, by meant_name."""
    return names.withColumn("meant", meant_name(F.col("name")))


#: A dose with letters has one among or before its digits, right before its unit; a code with letters has one beside a dash.
NEAR_DOSE, NEAR_CODE = r"[OoIiLlSsBbZz][0-9OoIiLlSsBbZz]{0,4}\s?[MmGgIi][CcGgLlMmUu]", r"[lIO|]\s?-|-\s?[lIO|]"


def misread(segment: Column, dosage: Column, after: Column) -> dict[str, Column]:
    """What looks misread in a segment (a line from a medicine's name on) and in the three characters after its dosage:
    dose_letters, code_letters and stray_capital, each null if there is none."""
    # a search for what stands in any match, before the pattern that cuts the match out
    group = lambda m, near: F.when(segment.rlike(near), F.nullif(F.regexp_extract(segment, m.parts, 2), F.lit("")))
    stray = F.when(dosage.isNotNull() & after.rlike(P.STRAY_CAPITAL), F.trim(F.substring(after, 1, 2)))
    return {"dose_letters": group(P.DOSE_WITH_LETTERS, NEAR_DOSE), "code_letters": group(P.CODE_WITH_LETTERS, NEAR_CODE), "stray_capital": stray}


def misread_doses(rows: DataFrame) -> DataFrame:
    """rows(…, line, dosage) with dose_letters, code_letters and stray_capital of the line (see misread)."""
    there = F.when(F.expr("locate(dosage, line)") > 0, F.col("dosage"))
    return rows.withColumns(misread(F.col("line"), there, F.expr("substring(line, locate(dosage, line) + length(dosage), 3)")))


def decimal_slip(value: Column, reference: Column) -> Column:
    """Is a value more than ten times outside its range? A limit (< n or > n) counts as the range from 0 to n."""
    number = value.try_cast("double")
    part = lambda p, i: F.regexp_extract(reference, p, i).try_cast("double")
    ranged = reference.rlike(P.RANGE)
    low, high = F.when(ranged, part(P.RANGE, 1)).otherwise(0.0), F.when(ranged, part(P.RANGE, 2)).otherwise(part(P.LIMIT, 1))
    return F.coalesce(((high > 0) & (number > 10 * high)) | ((low > 0) & (number < low / 10)), F.lit(False))


def date_reasons(date: Column, today: Column) -> Column:
    """An array of what makes a numeric date doubtful; empty for others. Day first is tried before month first."""
    whole = r"^([0-9]{1,2})([/.\-|])([0-9]{1,2})([/.\-|])([0-9]{2,4})$"
    part = lambda i: F.regexp_extract(date, whole, i)
    numeric = date.rlike(whole) & (part(2) == part(4))
    short = F.length(part(5)) == 2
    year = F.when(short, F.concat(F.lit("20"), part(5))).otherwise(F.lpad(part(5), 4, "0"))
    day = lambda d, m: F.try_to_date(F.concat(year, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    read = F.coalesce(day(part(1), part(3)), day(part(3), part(1)))
    found = F.array(
        F.when(part(2) == "|", "unusual separator"), F.when(short, "two-digit year"), F.when(read.isNull(), "no calendar date"),
        F.when(read > F.date_add(today, 31), "in the future"), F.when((read <= F.date_add(today, 31)) & (F.year(read) < 1950), "implausibly old"),
    )
    return F.when(numeric, F.filter(found, lambda r: r.isNotNull())).otherwise(F.array().cast("array<string>"))


def overlay(values: DataFrame, doubts: DataFrame) -> DataFrame:
    """values(doc_id, line_no, …) with `reasons`: the doubts about their lines, once each, in order."""
    of_line = doubts.groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return values.join(of_line, ["doc_id", "line_no"], "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


#: Probabilities of characters below which a value, a line and a document are doubtful.
SURE_VALUE, SURE_LINE, SURE_DOCUMENT = 0.80, 0.60, 0.80


def span_confidence(values: DataFrame, confidence: str = "confidence") -> DataFrame:
    """values(…, start, end, confidence array) with the least known probability of the span's characters, rounded to 3."""
    known = F.filter(F.slice(confidence, F.col("start") + 1, F.col("end") - F.col("start")), lambda p: p.isNotNull())
    return values.withColumn("ocr_confidence", F.round(F.array_min(known), 3))


def unsure(ocr_confidence: Column) -> Column:
    """The reason to review a value whose characters were read with a low probability, or null."""
    return F.when(ocr_confidence < SURE_VALUE, "characters read with low probability")


def millionths(p: Column) -> Column:
    """A probability in millionths, half a one upwards; the greatest double below a half lets none below a half through."""
    return F.floor(p * 1_000_000 + 0.49999999999999994)


def mean_confidence(text: Column, confidence: Column, pattern: str = r"[\p{L}\p{N}]") -> Column:
    """The mean of the known probabilities of a text's characters of a pattern, rounded to 3: letters and digits for a document,
    [^\\s] for a line. Null if none is known. Probabilities are added as millionths, so that the order doesn't matter."""
    chars = F.split(text, "")
    known = F.filter(F.zip_with(chars, confidence, lambda c, p: F.when(c.rlike(f"^{pattern}$"), p)), lambda p: p.isNotNull())
    total = F.aggregate(known, F.lit(0).cast("long"), lambda a, p: a + millionths(p))
    return F.when(F.size(known) > 0, F.round(total / F.size(known) / 1_000_000, 3))


def ungrounded(values: DataFrame, docs: DataFrame, withheld: DataFrame | None = None) -> DataFrame:
    """values(doc_id, start, end, text) that aren't literally in their document at their place, or that overlap a stretch of
    withheld(doc_id, start, end), which nothing may be taken from. A null text grounds nothing. Values and texts are joined by
    shuffle: either may be larger than a plan takes it for."""
    joined = values.join(docs.select("doc_id", F.coalesce("raw_text", F.lit("")).alias("raw_text")).hint("merge"), "doc_id")
    there = F.expr("substring(raw_text, start + 1, end - start)")
    bounds = (F.col("start") < 0) | (F.col("end") > F.length("raw_text")) | (F.col("end") < F.col("start"))
    bad = bounds | (there != F.col("text"))
    if withheld is not None:
        of_doc = withheld.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("_w"))
        joined = joined.join(of_doc.hint("merge"), "doc_id", "left")
        bad = bad | F.coalesce(F.exists("_w", lambda w: (w["start"] < F.col("end")) & (F.col("start") < w["end"])), F.lit(False))
    return joined.where(bad).select(values.columns)


def document_status(rows: DataFrame) -> DataFrame:
    """rows(…, legible, mean_confidence, n_withheld, n_low_lines, n_doubts, n_suspect_pages, failed) with `status`. A text with
    too few letters and digits outside withheld lines is unreadable, before anything is extracted that could fail."""
    low = (F.col("n_withheld") > 0) | (F.col("n_low_lines") > 0) | (F.col("n_doubts") > 0) | (F.col("n_suspect_pages") > 0) | F.coalesce(F.col("mean_confidence") < SURE_DOCUMENT, F.lit(False))
    return rows.withColumn("status", F.when(F.col("legible") < P.LEGIBLE_CHARS, "unreadable").when(F.col("failed"), "failed").when(low, "low_confidence").otherwise("ok"))


def page_status(suspect: Column, text: Column) -> Column:
    """ok, suspect (a page check withheld the page) or no_text."""
    return F.when(suspect, "suspect").when(F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) < P.LEGIBLE_CHARS, "no_text").otherwise("ok")
