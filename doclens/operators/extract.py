"""Values in lines of documents, by pattern and from the spans of recognisers: routes of lines, medicines, laboratory rows,
vital signs, panels, sections and headers.

Values are verbatim stretches of the text. An item is a record of a field (a medicine, a laboratory row, a diagnosis ...)
with its values as `parts`; a part's `start` counts code points of the document from 0. Recognisers of names plug in as a
table of spans; see plugins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import patterns as P
from doclens.operators import checks
from doclens.operators.lines import PLAIN, ROW_ENDS, WHITE, any_in, block_of, lead, may_end_row, staged, tidy
from doclens.sources.stored import as_files, once

#: A value in an item. `sub` names it within the item; method is "pattern" or "model"; score is a model's.
PART = "struct<sub:string,text:string,start:int,method:string,score:double,reasons:array<string>>"
ITEM = f"struct<field:string,parts:array<{PART}>>"
SPAN = "struct<start:int,end:int,kind:string,score:double>"
#: A score below this makes a value doubtful, and is no evidence of a medicine by itself.
SURE_SCORE = 0.60
#: Fields that only a document about a patient has.
OF_A_PATIENT = ("diagnoses", "symptoms", "allergies", "tests", "test_results")
#: Lists in which a text counts once.
LISTS = ("diagnoses", "symptoms", "tests", "allergies")
#: What a text in lower case must hold for a second medicine to begin in it.
SECOND_CUES = tuple({f[:3]: None for f in P.SECOND_FORMS})
#: What a text in lower case must hold for a phrase of dosing, and for several strengths.
PHRASE_CUES, LIST_CUES = ("once", "twice", "thrice", "bed", "each", "every"), (",", "or", "and")
#: What a line in lower case must hold to be of these routes.
ALLERGY_CUES, DIAGNOSIS_CUES, COMPLAINT_CUES = ("allerg", "nkda", "nkfa"), ("dx", "diag", "imp"), ("c/o", "complain")
PANEL_CUES = tuple(dict.fromkeys(max(re.split(r"[ ~]|\(\w+\)", t), key=len) for t in (*P.PANEL_ENDS, *P.PANELS)))
#: What a line in lower case must hold to name a vital sign; a dosage form; a dosing code without digits.
VITAL_CUES = tuple(dict.fromkeys(max(re.split(r"[ ~]|\(\w+\)", t), key=len) for t in P.VITALS))
FORM_CUES = tuple(dict.fromkeys(re.sub(r"\(\w+\)", "", t) for t in P.FORMS))
FORM_CUES = tuple(t for t in FORM_CUES if not any(o != t and o in t for o in FORM_CUES))
CODE_CUES = (*(c.lower() for c in P.CODES), "½")
BY_PATTERN, MENTIONED, UNKNOWN_TEST, BARE_LABEL, NO_SEPARATOR, CONFUSABLE = (
    "found by pattern only", "named, which is not evidence that it was prescribed", "test name found by pattern only", "name from a bare label", "name from a label without a separator",
    "may be a misreading of another name",
)


# ---- parts and items


def reasons(*found: Column | str) -> Column:
    return F.filter(F.array(*(F.lit(r) if isinstance(r, str) else r for r in found)).cast("array<string>"), lambda r: r.isNotNull())


def part(sub: str, text: Column, start: Column, why: Column | None = None, model: Column | None = None, score: Column | None = None) -> Column:
    """A value, or null if its text is null or empty; `model`: did a recogniser find it?"""
    model = F.lit(False) if model is None else F.coalesce(model, F.lit(False))
    score = F.when(model, score).cast("double") if score is not None else F.lit(None).cast("double")
    why = F.concat(F.array().cast("array<string>") if why is None else why, reasons(F.when(score < SURE_SCORE, "low score of the recogniser")))
    value = F.struct(F.lit(sub).alias("sub"), text.alias("text"), start.cast("int").alias("start"), F.when(model, "model").otherwise("pattern").alias("method"), F.round(score, 3).alias("score"), why.alias("reasons"))
    return F.when(F.coalesce(text != "", F.lit(False)), value.cast(PART))


def item(field: Column | str, *parts: Column) -> Column:
    """An item of the parts that aren't null, the first of which must be there; else null."""
    field = F.lit(field) if isinstance(field, str) else field
    kept = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return F.when(parts[0].isNotNull(), F.struct(field.alias("field"), kept.alias("parts")).cast(ITEM))


def _none(kind: str = ITEM) -> Column:
    return F.array().cast(f"array<{kind}>")


def span_part(sub: str, span: Column, line: Column, line_start: Column, why: Column | None = None) -> Column:
    text = F.substring(line, span["start"] + 1, span["end"] - span["start"])
    return part(sub, text, line_start + span["start"], why, F.lit(True), span["score"])


def pieces(text: Column, pattern: str) -> Column:
    """An array of (text, at): text cut at what group 1 of a pattern takes in, the even ones between, the odd ones taken."""
    cut = F.split(F.regexp_replace(text, pattern, "\x01$1\x01"), "\x01")
    size = lambda i: F.aggregate(F.slice(cut, F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(cut, lambda x, i: F.struct(x.alias("text"), size(i).alias("at"), (i % 2 == 1).alias("taken")))


def find(text: Column, mark: P.Mark) -> tuple[Column, Column]:
    """(the first of something in a text, or null; characters before it)."""
    return F.nullif(F.regexp_extract(text, mark.parts, 2), F.lit("")), F.length(F.regexp_extract(text, mark.parts, 1))


def place(text: Column, value: Column, mark: P.Mark) -> Column:
    """Characters before `value`, the first of something in a text by find; null of a null. Where a text holds those characters
    once only, that is where they stand; else the pattern tells."""
    first = F.position(value, text)
    once_only = F.position(value, text, first + 1) == 0
    return F.when(value.isNotNull(), F.when(once_only, first - 1).otherwise(F.length(F.regexp_extract(text, mark.parts, 1))))


# ---- routes


def prescribed_looking(line: Column) -> Column:
    """The cheapest test first."""
    return F.ltrim(line).rlike(P.LEADING_FORM) | line.rlike(P.FREQUENCY_CODE.anywhere) | line.rlike(P.MEDICINE_DOSE)


def lab_row(line: Column) -> Column:
    """A line that is a laboratory row without a recogniser's help: with a unit or a range, and no label or date."""
    some = (F.regexp_extract(line, P.LAB_ROW, 6) != "") | (F.regexp_extract(line, P.LAB_ROW, 8) != "")
    return may_end_row(line) & line.rlike(P.LAB_ROW) & some & ~line.rlike(P.NOT_MEDICINE_LINE) & ~line.rlike(P.DATE)


def route(lines: DataFrame, by_span: bool = False) -> DataFrame:
    """lines(…, line) with `route`, the first of the extractors that a line goes to; `by_span`: tests and medicines among
    `spans` may make a laboratory row of it."""
    line = F.col("line")
    row = lab_row(line)
    if by_span:
        tests = F.exists("spans", lambda s: s["kind"] == "test")
        drugs = F.exists("spans", lambda s: (s["kind"] == "drug") & _row_with_evidence(s, line))
        row = row | tests | drugs
    shaped = staged(lines, _rx=prescribed_looking(line), _low=F.lower(line))
    low = F.col("_low")
    way = (
        F.when(any_in(low, *ALLERGY_CUES) & (line.rlike(P.ALLERGY) | line.rlike(P.NO_ALLERGY)), "allergy").when(any_in(low, *DIAGNOSIS_CUES) & line.rlike(P.DIAGNOSIS), "diagnosis")
        .when(any_in(low, *COMPLAINT_CUES) & line.rlike(P.COMPLAINT), "complaint")
        .when(~F.col("_rx") & line.rlike(P.VITAL_MEASURE), "vitals").when(any_in(low, *PANEL_CUES) & F.trim(line).rlike(P.PANEL), "panel")
        .when(~F.col("_rx") & row, "lab").otherwise("medicine")
    )
    return staged(shaped, route=way).drop("_rx", "_low")


def _after(span: Column, line: Column) -> Column:
    return F.substring(line, span["end"] + 1, F.length(line))


def _row_with_evidence(span: Column, line: Column) -> Column:
    rest = _after(span, line)
    return rest.rlike(P.LAB_REST) & ((F.regexp_extract(rest, P.LAB_REST, 4) != "") | (F.regexp_extract(rest, P.LAB_REST, 6) != "")) & ~_dated(rest)


def _dated(rest: Column) -> Column:
    """Does a date stand where a row's value would?"""
    at = F.length(F.regexp_extract(rest, P.LAB_REST, 1))
    return F.substring(rest, at + 1, F.length(rest)).rlike(P.DATE_AHEAD)


# ---- what each route gives, as an array of items; `line`, `start` and `spans` are columns of the lines


def _section(line: Column, start: Column, by_span: bool = True) -> Column:
    """Items of allergy, diagnosis and complaint lines.

    A section ends at a duration; absences are no items. Of recognised names those on an allergy line are the allergens; else
    one name that is short beside its part makes the whole part an item, other names stand for themselves.
    """
    way = F.col("route")
    at = F.coalesce(*(F.when(way == r, F.length(F.regexp_extract(line, rf"(?s)^(.*?{p})", 1))) for r, p in (("allergy", P.ALLERGY), ("diagnosis", P.DIAGNOSIS), ("complaint", P.COMPLAINT))), F.lit(0))
    body = F.substring(line, at + 1, F.length(line))
    stop = rf"(?s)^(.*?){P.SECTION_END}"
    body = F.when(body.rlike(stop), F.regexp_extract(body, stop, 1)).otherwise(body)
    nothing = (way == "allergy") & (line.rlike(P.NO_ALLERGY) | F.substring(line, at + 1, F.length(line)).rlike(P.ABSENT))
    kinds = F.when(way == "allergy", F.array(*map(F.lit, ("drug", "allergy", "disease")))).otherwise(F.array(*map(F.lit, ("disease", "symptom"))))
    named = F.filter("spans", lambda s: F.array_contains(kinds, s["kind"]) & (s["start"] >= at))
    field = F.when(way == "allergy", "allergies").when(way == "diagnosis", "diagnoses").otherwise("symptoms")

    def one(p: Column) -> Column:
        text, a = tidy(p["text"]), at + p["at"] + lead(p["text"])
        inside = F.filter(named, lambda s: (s["start"] >= a) & (s["start"] < a + F.length(text)))
        first = F.get(inside, F.lit(0))
        short = (F.size(inside) == 1) & (first["end"] - first["start"] < 0.6 * F.length(text))
        whole = F.array(item(field, part("text", text, start + a, F.when(F.size(inside) == 0, reasons(BY_PATTERN)).otherwise(_none("string")), short, first["score"])))
        each = F.transform(inside, lambda s: item(field, span_part("text", s, line, start)))
        good = (F.length(text) >= 2) & text.rlike("[A-Za-z]") & ~text.rlike(P.ABSENT)
        return F.when(good, F.when((F.size(inside) == 0) | short, whole).otherwise(each)).otherwise(_none())

    def plain(p: Column) -> Column:
        text = tidy(p["text"])
        good = (F.length(text) >= 2) & text.rlike("[A-Za-z]") & ~text.rlike(P.ABSENT)
        return F.when(good, item(field, part("text", text, start + at + p["at"] + lead(p["text"]), reasons(BY_PATTERN))))

    parts = F.filter(pieces(body, P.ITEM_BREAK), lambda p: ~p["taken"])
    if not by_span:
        return F.when(nothing, _none()).otherwise(F.filter(F.transform(parts, plain), lambda x: x.isNotNull()))
    by_part = F.flatten(F.transform(parts, one))
    allergens = F.transform(named, lambda s: item(field, span_part("text", s, line, start)))
    return F.when(nothing, _none()).when((way == "allergy") & (F.size(named) > 0), allergens).otherwise(by_part)


def _vitals(line: Column, start: Column) -> Column:
    """Every vital sign on a line."""
    group = lambda m, i: F.regexp_extract(m["text"], P.VITAL_MEASURE, i)

    def one(m: Column) -> Column:
        at, name, gap, unit = start + m["at"], group(m, 1), group(m, 2), group(m, 4)
        return item("vitals", part("name", name, at), part("value", group(m, 3), at + F.length(name) + F.length(gap)), part("unit", unit, at + F.length(m["text"]) - F.length(unit)))

    return F.transform(F.filter(pieces(line, f"({P.VITAL_MEASURE})"), lambda p: p["taken"]), one)


def _panel(line: Column, start: Column) -> Column:
    return F.filter(F.array(item("panels", part("text", tidy(line), start + lead(line)))), lambda x: x.isNotNull())


def _lab_item(name: Column, text: Column, pattern: str, first: int, at: Column) -> Column:
    """A row from its groups: `first` is the number of the gap after the name, `at` where that gap begins."""
    g = [F.regexp_extract(text, pattern, first + k) for k in range(6)]
    ends, sizes = [], F.lit(0)
    for x in g:
        sizes = sizes + F.length(x)
        ends.append(at + sizes)
    value, reference = g[1], g[5]
    slip = F.when((reference != "") & checks.decimal_slip(value, reference), "more than ten times outside the range")
    return item("test_results", name, part("value", value, ends[0], reasons(slip)), part("unit", g[3], ends[2]), part("reference_range", reference, ends[4]))


def _confusable(text: Column) -> Column:
    return F.when(checks.meant_name(text).isNotNull(), CONFUSABLE)


def _lab(line: Column, start: Column, by_span: bool = True) -> Column:
    """Rows after recognised names; a medicine's name counts with a unit or range only. A name within an earlier name's row
    is part of that. A test without a row is a test. Without any, the whole line is a row if it is shaped like one."""
    name, at = F.regexp_extract(line, P.LAB_ROW, 2), start + F.length(F.regexp_extract(line, P.LAB_ROW, 1))
    by_shape = _lab_item(part("name", name, at, reasons(UNKNOWN_TEST, _confusable(name))), line, P.LAB_ROW, 3, at + F.length(name))
    whole = F.filter(F.array(F.when(lab_row(line), by_shape)), lambda x: x.isNotNull())
    if not by_span:
        return whole
    spans = F.array_sort(F.filter("spans", lambda s: s["kind"].isin("test", "drug")))
    has_row = lambda s: _after(s, line).rlike(P.LAB_REST) & ~_dated(_after(s, line)) & ((s["kind"] == "test") | _row_with_evidence(s, line))
    end = lambda s: sum((F.length(F.regexp_extract(_after(s, line), P.LAB_REST, i)) for i in range(1, 7)), s["end"])
    free = F.filter(spans, lambda s: ~F.exists(spans, lambda o: (o["start"] < s["start"]) & has_row(o) & (s["start"] < end(o))))
    name_of = lambda sub, s: span_part(sub, s, line, start, reasons(_confusable(F.substring(line, s["start"] + 1, s["end"] - s["start"]))))
    found = F.transform(free, lambda s: F.when(has_row(s), _lab_item(name_of("name", s), _after(s, line), P.LAB_REST, 1, start + s["end"])).when(s["kind"] == "test", item("tests", name_of("text", s))))
    found = F.filter(found, lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(whole)


# ---- medicines


def segments(lines: DataFrame, cut: Column | None = None, whole: Column | None = None) -> DataFrame:
    """lines with one row for each medicine's stretch of the line: `seg_no`, `seg` and where it begins, `seg_at`; only of lines
    that are to be `cut`. Lines that stay `whole` have a row for themselves too, with a seg_no of -1 and no stretch."""
    rest = F.expr("substring(line, 4)")
    marked = F.concat(F.substring("line", 1, 3), F.regexp_replace(rest, P.SEGMENT, "$1\x01$2"))
    stretches = F.when(any_in(F.lower(rest), *SECOND_CUES) | F.col("line").contains("\x01"), F.split(marked, "\x01")).otherwise(F.array("line"))
    rows = staged(lines, _cut=stretches if cut is None else F.when(cut, stretches).otherwise(F.array().cast("array<string>")))
    at = lambda i: F.aggregate(F.slice("_cut", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x))
    one = lambda no, seg, at: F.struct(no.alias("seg_no"), seg.alias("seg"), at.alias("seg_at"))
    each = F.when(F.size("_cut") == 1, F.array(one(F.lit(0), F.get("_cut", F.lit(0)), F.lit(0)))).otherwise(F.transform("_cut", lambda x, i: one(i, x, at(i))))
    if whole is not None:
        each = F.when(whole, F.concat(F.array(one(F.lit(-1), F.lit(""), F.lit(0))), each)).otherwise(each)
    return rows.select(*lines.columns, F.inline(each))


def medicines(lines: DataFrame, cut: Column | None = None, whole: Column | None = None) -> DataFrame:
    """Rows of lines(…, line, mention, and perhaps spans) for each medicine that a line prescribes or, where `mention`, only names:
    seg_no, seg_at, seg_end, name, name_at, by_model, score, and dosage, frequency and duration with where they begin (…_at), all
    counted from the line's start; `line` from the name on is checked for what looks misread.

    A medicine that a line prescribes needs a dosage form before it, a dosing code or a dose of one digit; one whose name a
    recogniser found needs any of these, a phrase or a duration. One that is only named must be a recogniser's or a product
    with its form, beside a strength, a form, or with a sure score. `cut` and `whole` as for segments: rows of whole lines are
    left as they are. What only prescribed medicines have isn't looked for where one is only named, nor the other way round.
    """
    of_medicine = ~F.col("line").rlike(P.NOT_MEDICINE_LINE)
    rows = segments(lines.where(of_medicine)) if cut is None else segments(lines, cut & of_medicine, whole)
    stays, mention, by_span = F.col("seg_no") < 0, F.col("mention"), "spans" in lines.columns
    seg = F.col("seg")
    head = F.when(F.substring(seg, 1, 1).isin(*WHITE, *"0123456789"), F.length(F.regexp_extract(seg, f"({P.NUMBERED})", 1))).otherwise(0)
    if by_span:
        drug = F.get(F.filter("spans", lambda s: (s["kind"] == "drug") & (s["start"] >= F.col("seg_at")) & (s["start"] < F.col("seg_at") + F.length("seg"))), F.lit(0))
        rows = staged(rows, head=head, drug=drug)
        by_model, drug_start, drug_end, score = F.col("drug").isNotNull(), F.col("drug.start"), F.col("drug.end"), F.col("drug.score")
        drug_form = F.coalesce(F.length(F.regexp_extract(F.expr("substring(line, drug.start + 1, drug.end - drug.start)"), P.LEADING_FORM, 1)), F.lit(0))
    else:
        rows = staged(rows, head=head)
        by_model, drug_start, drug_end, drug_form, score = F.lit(False), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0), F.lit(None).cast("double")
    rows = staged(rows, body=F.expr("substring(seg, head + 1)"))
    rows = staged(
        rows, form=F.when(stays, 0).otherwise(F.length(F.regexp_extract("body", P.LEADING_FORM, 1))), before=F.when(mention, F.length(F.regexp_extract("body", P.PRODUCT, 1))).otherwise(0),
        product=F.when(mention, F.regexp_extract("body", P.PRODUCT, 2)).otherwise(""),
    )
    body_at = F.col("seg_at") + F.col("head")
    begin = F.when(by_model, drug_start + drug_form).when(mention, body_at + F.col("before")).otherwise(body_at + F.col("form"))
    seg_end = F.col("seg_at") + F.length("seg")
    end = F.when(by_model, drug_end).when(mention, begin + F.length("product")).otherwise(seg_end)
    known = by_model | ~mention | ((F.col("product") != "") & ~F.lower("product").isin(*P.NOT_PRODUCT))
    rows = staged(rows, begin=begin, seg_end=seg_end, by_model=by_model, source=F.when(known, F.substring(F.col("line"), begin + 1, end - begin)))
    rows = staged(rows.where(stays | F.col("source").isNotNull()), stretch=F.when(~stays, F.coalesce(F.nullif(F.regexp_extract("source", P.NAME_STOP, 1), F.lit("")), F.col("source"))))
    rows = staged(rows, name=tidy(F.col("stretch")), name_at=F.col("begin") + lead(F.col("stretch")))
    first, last = F.substring("name", 1, 1), F.substring("name", -1, 1)
    dose_alone = first.isin(*"0123456789") & (F.col("name").rlike(P.WHOLE_DOSE) | F.col("name").rlike(f"^{P.STRENGTHS}"))
    named = (F.length("name") >= 2) & F.col("name").rlike("[A-Za-z]{3,}") & ~dose_alone
    # a letter or space stands for the name's last character, so that boundaries hold
    rest = F.expr("substring(line, name_at + length(name) + 1, seg_end - name_at - length(name))")
    rows = staged(rows.where(stays | named), tail=F.concat(F.when(last.isin(*PLAIN, "_"), "a").otherwise(" "), rest), base=F.col("name_at") + F.length("name") - 1)
    tail = F.col("tail")
    got = lambda m: F.nullif(F.regexp_extract(tail, m.parts, 2), F.lit(""))
    said = any_in(F.lower(tail), *PHRASE_CUES)
    rows = staged(
        rows, several=any_in(F.lower(tail), *LIST_CUES) & tail.rlike(P.STRENGTHS), dose=got(P.DOSE),
        code=F.when(~mention, got(P.FREQUENCY_CODE)), phrase=F.when(~mention & said, got(P.FREQUENCY_PHRASE)), span=F.when(~mention, got(P.DURATION)),
    )
    rows = staged(rows, bare=F.when(F.col("dose").isNull(), got(P.BARE_NUMBER)), **{f"{n}_at": F.col("base") + place(tail, F.col(n), m) for n, m in (("dose", P.DOSE), ("code", P.FREQUENCY_CODE), ("phrase", P.FREQUENCY_PHRASE), ("span", P.DURATION))})
    amount = F.col("dose").isNotNull()
    earlier = F.col("code").isNotNull() & (F.col("phrase").isNull() | (F.col("code_at") <= F.col("phrase_at")))
    strong = (F.col("form") > 0) | F.col("code").isNotNull() | F.coalesce(F.col("dose").rlike(P.PLAIN_DOSE), F.lit(False))
    weak = F.col("by_model") & (F.col("phrase").isNotNull() | F.col("span").isNotNull())
    dosage = F.when(~F.col("several"), F.coalesce("dose", "bare"))
    beside = dosage.isNotNull() | F.col("several") | (F.col("form") > 0) | (F.col("product") != "") | F.coalesce(score >= SURE_SCORE, F.lit(False))
    rows = staged(
        rows, dosage=dosage, dosage_at=F.when(amount, F.col("dose_at")).otherwise(F.col("base") + place(tail, F.col("bare"), P.BARE_NUMBER)),
        frequency=F.when(earlier, F.col("code")).otherwise(F.col("phrase")), frequency_at=F.when(earlier, F.col("code_at")).otherwise(F.col("phrase_at")),
        duration=F.col("span"), duration_at=F.col("span_at"), score=score, kept=F.when(mention, beside).otherwise(strong | weak),
    )
    return rows.where(stays | F.col("kept")).select(*lines.columns, "seg_no", "seg_at", "seg_end", "name", "name_at", "by_model", "score", *(c for n in ("dosage", "frequency", "duration") for c in (n, f"{n}_at")))


def medicine_items(rows: DataFrame) -> DataFrame:
    """rows of medicines() with `item`."""
    doubts = checks.misread(F.expr("substring(line, name_at + 1)"), F.col("dosage"), F.expr("substring(line, dosage_at + length(dosage) + 1, 3)"))
    rows = staged(rows, _dose=doubts["dose_letters"], _code=doubts["code_letters"], _stray=doubts["stray_capital"])
    dose, code, stray = (F.when(F.col(c).isNotNull(), F.lit(w)) for c, w in (("_dose", "letters in a dose"), ("_code", "letters in a dosing code"), ("_stray", "stray capital after a dose")))
    at = lambda c: F.col("start") + F.col(c)
    why = reasons(F.when(F.col("mention"), MENTIONED), F.when(~F.col("by_model"), BY_PATTERN), dose, code, stray)
    made = item(
        F.when(F.col("mention"), "medication_mentions").otherwise("medications"), part("name", F.col("name"), at("name_at"), why, F.col("by_model"), F.col("score")),
        part("dosage", F.col("dosage"), at("dosage_at"), reasons(dose, stray)), part("frequency", F.col("frequency"), at("frequency_at"), reasons(code)), part("duration", F.col("duration"), at("duration_at")),
    )
    return staged(rows, item=made)


def _plain(lines: DataFrame, mention: bool) -> DataFrame:
    return lines.withColumn("mention", F.lit(mention))


def prescribed_medicines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, seg_no, name, dosage, frequency, duration) of medicines that lines prescribe, without a recogniser."""
    return medicines(_plain(lines, False)).select("doc_id", "line_no", "seg_no", "name", "dosage", "frequency", "duration")


def mentioned_medicines(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, seg_no, name, dosage) of products named with their dosage form: named, not prescribed."""
    return medicines(_plain(lines, True)).select("doc_id", "line_no", "seg_no", "name", "dosage")


def mention_only(line: Column, about_a_patient: Column) -> Column:
    """Selling, listing or advertising a medicine doesn't prescribe it."""
    low, last = F.lower(line), F.substring(line, -1, 1)
    priced = any_in(low, "hsn", "sac", "rs", "₹") | (line.contains(".") & last.isin(*ROW_ENDS, *WHITE))
    return ~about_a_patient | (priced & line.rlike(P.INVOICE_ROW)) | (any_in(low, *LIST_CUES) & line.rlike(P.STRENGTHS))


def mention_key(name: Column) -> Column:
    """A medicine's name without salts at its end (one word stays)."""
    words = F.trim(F.regexp_replace(F.lower(name), r"[\s.]+", " "))
    return F.regexp_replace(words, rf"(?: \(?(?:{'|'.join(P.SALTS)})\)?)+$", "")


# ---- lines to items


def with_spans(lines: DataFrame, spans: DataFrame | None) -> DataFrame:
    """lines with `spans`, those of spans(doc_id, line_no, kind, start, end, score) that begin in each, counted from its start."""
    if spans is None:
        return lines.withColumn("spans", _none(SPAN))
    of_line = spans.groupBy("doc_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "score").cast(SPAN))).alias("_spans"))
    moved = F.transform(F.coalesce("_spans", _none(SPAN)), lambda s: F.struct((s["start"] - F.col("start")).alias("start"), (s["end"] - F.col("start")).alias("end"), s["kind"].alias("kind"), s["score"].alias("score")).cast(SPAN))
    return lines.join(of_line.hint("merge"), ["doc_id", "line_no"], "left").withColumn("spans", moved).drop("_spans")


def line_items(lines: DataFrame, by_span: bool = False) -> DataFrame:
    """(doc_id, line_no, about_a_patient, item) from lines(doc_id, line_no, start, line, spans, about_a_patient), each line by its
    route; what a recogniser found on a line that no medicine claims stands for itself."""
    line, start = F.col("line"), F.col("start")
    routed = route(lines, by_span)
    routed = once(routed) if by_span else routed  # four branches start from it
    direct = routed.where("route <> 'medicine'")
    found = (
        F.when(F.col("route").isin("allergy", "diagnosis", "complaint"), _section(line, start, by_span)).when(F.col("route") == "vitals", _vitals(line, start))
        .when(F.col("route") == "panel", _panel(line, start)).otherwise(_lab(line, start, by_span))
    )
    direct = direct.select("doc_id", "line_no", "about_a_patient", F.explode(found).alias("item"))
    rows = staged(routed.where("route = 'medicine'"), mention=mention_only(line, F.col("about_a_patient")))
    drugs = medicine_items(medicines(rows))
    drugs = once(drugs.select("doc_id", "line_no", "about_a_patient", "item", "name_at", "seg_end")) if by_span else drugs
    out = direct.unionByName(drugs.select("doc_id", "line_no", "about_a_patient", "item"))
    if not by_span:
        return out
    claimed = drugs.groupBy("doc_id", "line_no").agg(F.collect_list(F.struct(F.col("name_at").alias("a"), F.col("seg_end").alias("z"))).alias("claimed"))
    left = rows.where(F.size("spans") > 0).join(claimed, ["doc_id", "line_no"], "left").withColumn("claimed", F.coalesce("claimed", _none("struct<a:int,z:int>")))
    each = left.select("doc_id", "line_no", "about_a_patient", "line", "start", "claimed", F.explode("spans").alias("s"))
    outside = ~F.exists("claimed", lambda c: (c["a"] <= F.col("s.start")) & (F.col("s.start") < c["z"]))
    s = F.col("s")
    field = F.when((s["kind"] == "test") & outside, "tests").when((F.size("claimed") == 0) & (s["kind"] == "disease"), "diagnoses").when((F.size("claimed") == 0) & (s["kind"] == "symptom"), "symptoms")
    why = reasons(F.when(s["kind"] == "test", _confusable(F.substring(line, s["start"] + 1, s["end"] - s["start"]))))
    return out.unionByName(each.where(field.isNotNull()).select("doc_id", "line_no", "about_a_patient", item(field, span_part("text", s, line, start, why)).alias("item")))


def may_hold_items(line: Column, about_a_patient: Column) -> Column:
    """False of most lines that give no item without a recogniser, never of one that does: plain searches, and what prescribes
    nothing by its beginning."""
    low, digit = F.lower(line), line.rlike("[0-9]")
    medicine = any_in(low, *FORM_CUES) | (about_a_patient & (digit | any_in(low, *CODE_CUES)))  # a row of a laboratory has a digit too
    return (
        any_in(low, *PANEL_CUES) | (about_a_patient & any_in(low, *ALLERGY_CUES, *DIAGNOSIS_CUES, *COMPLAINT_CUES)) | (digit & any_in(low, *VITAL_CUES))
        | (medicine & ~line.rlike(P.NOT_MEDICINE_LINE))
    )


def items_by_text(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, item, at) from lines(doc_id, line_no, start, line, about_a_patient, headers), as line_items gives it without
    a recogniser, but for what isn't a patient's, with the items of `headers`, which have no line and stand with a document's
    first line only; starts of an item's parts count from `at`.

    What a line gives rests on its text and on what its document is about. So lines that may give something are kept, each
    different one is gone through once, and its items meet its lines again by a join in order, which holds no key's lines in memory.
    """
    kept = staged(lines, _may=may_hold_items(F.col("line"), F.col("about_a_patient")))
    kept = as_files(kept.where(F.col("_may") | F.col("headers").isNotNull()))
    heads = kept.where("headers is not null").select("doc_id", F.lit(None).cast("int").alias("line_no"), F.explode("headers").alias("item"), F.lit(0).alias("at"))
    of = ["line", "about_a_patient"]
    given = kept.where("_may")
    found = given.join(items_of_texts(given.select(*of).distinct()).hint("merge"), of)
    return heads.unionByName(found.select("doc_id", "line_no", "item", F.col("start").alias("at")))


def items_of_texts(texts: DataFrame) -> DataFrame:
    """(line, about_a_patient, item): what each of texts(line, about_a_patient) gives, counted from the line's start.

    A text is gone through once: a row of its own carries its direct items; a line of medicines has a row for each of its stretches.
    """
    line, start, about = F.col("line"), F.col("start"), F.col("about_a_patient")
    kind = F.col("route")
    found = (
        F.when(kind == "medicine", _none()).when(kind.isin("allergy", "diagnosis", "complaint"), _section(line, start, False)).when(kind == "vitals", _vitals(line, start))
        .when(kind == "panel", _panel(line, start)).otherwise(_lab(line, start, False))
    )
    rows = staged(route(texts.withColumn("start", F.lit(0)), False), found=found, of_medicine=kind == "medicine", mention=(kind == "medicine") & mention_only(line, about))
    of_patient = lambda x: about | ~x["field"].isin(*OF_A_PATIENT)
    rows = staged(rows, direct=F.filter("found", of_patient)).drop("found", "route")
    each = medicine_items(medicines(rows, F.col("of_medicine"), F.size("direct") > 0))
    return each.select("line", "about_a_patient", F.explode(F.when(F.col("seg_no") < 0, F.col("direct")).otherwise(F.array("item"))).alias("item")).where("item is not null")


def lab_results(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, name, value, unit, reference_range) of lines that are laboratory rows by their shape."""
    rows = lines.where(lab_row(F.col("line")))
    group = lambda i: F.nullif(F.regexp_extract("line", P.LAB_ROW, i), F.lit(""))
    return rows.select("doc_id", "line_no", group(2).alias("name"), group(4).alias("value"), group(6).alias("unit"), group(8).alias("reference_range"))


def _texts(x: Column, sub: str) -> Column:
    return F.get(F.filter(x["parts"], lambda p: p["sub"] == sub), F.lit(0))["text"]


def vitals(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, n, name, value, unit): every vital sign on the lines of that route."""
    rows = route(lines).where("route = 'vitals'").select("doc_id", "line_no", F.posexplode(_vitals(F.col("line"), F.col("start"))).alias("n", "v"))
    return rows.select("doc_id", "line_no", "n", *(_texts(F.col("v"), s).alias(s) for s in ("name", "value", "unit")))


def panels(lines: DataFrame) -> DataFrame:
    return route(lines).where("route = 'panel'").select("doc_id", "line_no", tidy(F.col("line")).alias("panel"))


def section_items(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, n, field, item) of diagnosis, complaint and allergy lines, n counting a line's items from 0."""
    rows = route(lines).where("route in ('allergy', 'diagnosis', 'complaint')")
    rows = rows.select("doc_id", "line_no", F.posexplode(_section(F.col("line"), F.col("start"), by_span=False)).alias("n", "v"))
    return rows.select("doc_id", "line_no", "n", F.col("v.field").alias("field"), _texts(F.col("v"), "text").alias("item"))


# ---- headers


def headers(docs: DataFrame) -> DataFrame:
    """docs(doc_id, raw_text, about_a_patient, …) with an array `headers` of items: doctor_name, date and patient_name.

    The doctor's name loses credentials at its end. The date is the first on a line that speaks of dates, else the first. An
    explicit label names the patient; where the document may be about a patient, a bare "Name:" does too if there are
    demographics and no payee within two lines of it, and so does "Pt" before a capitalised name at a line's start, both with
    a reason for review. Labels of the next field at a name's end are not part of it.
    """
    text = F.col("raw_text")
    rows = staged(docs, _ls=F.split("raw_text", "\n"))
    rows = staged(rows, _dr=F.when(text.contains("Dr"), F.nullif(F.regexp_extract(text, P.DOCTOR.parts, 2), F.lit(""))))
    rows = staged(rows, _dr_at=place(text, F.col("_dr"), P.DOCTOR))
    doctor = F.regexp_replace(F.when(F.col("_dr").rlike(P.DOCTOR_TAIL), F.regexp_extract("_dr", P.DOCTOR_TAIL, 1)).otherwise(F.col("_dr")), "[,. ]+$", "")
    # lines with a date, with their numbers
    numbered = F.filter(F.transform("_ls", lambda x, i: F.struct(x.alias("line"), i.alias("no"))), lambda r: r["line"].rlike(P.NEAR_DATE) & r["line"].rlike(P.DATE))
    rows = staged(rows, _dated=numbered)
    best = F.coalesce(F.get(F.filter("_dated", lambda r: r["line"].rlike(P.DATE_WORDS)), F.lit(0)), F.get("_dated", F.lit(0)))
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, P.PATIENT_TAIL, ""), "[.]+$", "")
    whole = F.regexp_extract_all(text, F.lit(f"({P.PATIENT})"), F.lit(1))
    labelled = F.filter(F.transform(whole, lambda m: F.struct(m.alias("match"), F.regexp_extract(m, P.PATIENT, 1).alias("name"))), lambda r: trimmed(r["name"]) != "")
    about = F.col("about_a_patient")
    bare = F.transform("_ls", lambda x, i: F.when(x.rlike(P.BARE_NAME) & block_of(F.col("_ls"), i).rlike(P.DEMOGRAPHICS) & ~block_of(F.col("_ls"), i).rlike(P.PAYEE) & (trimmed(F.regexp_extract(x, P.BARE_NAME, 2)) != ""), F.struct(x.alias("line"), i.alias("no"))))
    unseparated = F.filter(F.transform("_ls", lambda x, i: F.struct(x.alias("line"), i.alias("no"))), lambda r: r["line"].rlike(P.UNSEPARATED_NAME))
    rows = staged(
        rows, _day=best, _a=F.get(labelled, F.lit(0)), _b=F.when(about & text.rlike("(?i)name"), F.get(F.filter(bare, lambda r: r.isNotNull()), F.lit(0))), _c=F.when(about, F.get(unseparated, F.lit(0))),
    )
    of_line = lambda r: F.aggregate(F.slice("_ls", F.lit(1), r["no"]), F.lit(0), lambda a, x: a + F.length(x) + 1)
    number, number_at = find(F.col("_day.line"), P.NUMERIC_DATE)
    written, written_at = find(F.col("_day.line"), P.WRITTEN_DATE)
    first = number.isNotNull() & (written.isNull() | (number_at <= written_at))
    rows = staged(rows, _date=F.when(first, number).otherwise(written), _date_at=F.when(first, number_at).otherwise(written_at) + of_line(F.col("_day")))
    date = part("text", F.col("_date"), F.col("_date_at"), checks.date_reasons(F.col("_date"), F.col("_today")) if "_today" in docs.columns else None)
    a_at = F.instr(text, F.col("_a.match")) - 1 + F.length("_a.match") - F.length("_a.name")
    line_name = lambda c, p: part("text", trimmed(F.regexp_extract(F.col(f"{c}.line"), p, 2)), of_line(F.col(c)) + F.length(F.regexp_extract(F.col(f"{c}.line"), p, 1)), reasons(BARE_LABEL if c == "_b" else NO_SEPARATOR))
    patient = F.coalesce(part("text", trimmed(F.col("_a.name")), a_at), line_name("_b", P.BARE_NAME), line_name("_c", P.UNSEPARATED_NAME))
    every = F.array(item("patient_name", patient), item("doctor_name", part("text", doctor, F.col("_dr_at"))), item("date", date))
    return staged(rows, headers=F.filter(every, lambda x: x.isNotNull())).select(*docs.columns, "headers")


def header_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, doctor_name, patient_name, date, reason): the headers as texts, with the reason to review the patient's name."""

    def first(field: str) -> Column:
        return F.get(F.filter("headers", lambda x: x["field"] == field), F.lit(0))["parts"]

    rows = staged(headers(docs), **{f: F.get(first(f), F.lit(0)) for f in ("doctor_name", "patient_name", "date")})
    return rows.select("doc_id", *(F.col(f"{f}.text").alias(f) for f in ("doctor_name", "patient_name", "date")), F.get("patient_name.reasons", F.lit(0)).alias("reason"))


# ---- order


def first_wins(rows: DataFrame, key: Column, order: list[str], by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The earliest of the rows of a document with one key."""
    w = Window.partitionBy(*by, "_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_key", "_nth")


def page_of(values: DataFrame, pages: DataFrame) -> DataFrame:
    """values(doc_id, start, …) with the page of each: the last page that starts at or before it."""
    starts = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "page"))).alias("_pages"))
    last = F.element_at(F.filter("_pages", lambda p: p["start"] <= F.col("start")), -1)["page"]
    return values.join(starts, "doc_id", "left").withColumn("page", F.when(F.size("_pages") > 0, last)).drop("_pages")
