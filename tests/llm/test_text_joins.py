"""URL filters, decontamination and licence scans."""

import datetime as dt

from oracle import same
from pyspark.sql import functions as F

from doclens.llm import decontam, licenses, url_filter

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(n)


def test_intervals(spark):
    rows = [("a.com", "x", False, day(5), True), ("a.com", "x", False, day(7), True), ("a.com", "x", False, day(9), False), ("a.com", "x", False, day(20), True), ("b.com", "x", False, day(1), False), (None, "x", False, day(1), True), ("c.com", "x", False, None, True)]
    got = url_filter.intervals(spark.createDataFrame(rows, "entry string, category string, allow boolean, day date, listed boolean"))
    assert {(r.entry, r.valid_from, r.valid_to) for r in got.collect()} == {("a.com", day(5), day(9)), ("a.com", day(20), None)}


def test_captures_are_judged_at_their_fetch_time(spark):
    entries = spark.createDataFrame([
        ("bad.com", "spam", False, day(10), True), ("bad.com", "spam", False, day(20), False), ("bad.com/ok", "fine", True, day(0), True), ("com", "all", False, day(100), True), ("bad.com", "adult", False, day(12), True),
    ], "entry string, category string, allow boolean, day date, listed boolean")
    caps = [
        (1, "http://www.bad.com/x", day(9)), (2, "http://www.bad.com/x", day(10)), (3, "https://u@SUB.bad.com:80/ok/y", day(11)), (4, "http://bad.com/ok/y?q", day(15)), (5, "http://bad.com", day(20)), (6, "http://other.com/", day(100)),
        (7, None, day(11)), (8, "nonsense", day(11)), (9, "http://bad.com/", None), (2, "http://www.bad.com/x", day(10)), (10, "http://notbad.com/", day(15)), (None, "http://bad.com/", day(15)),
    ]
    got = {(r.page_id, r.fetched): (r.blocked, r.category) for r in url_filter.judge(spark.createDataFrame(caps, "page_id long, url string, fetched date"), entries).collect()}
    assert len(got) == 11
    assert got[1, day(9)] == (False, None) and got[2, day(10)] == (True, "spam") and got[3, day(11)] == (True, "spam") and got[4, day(15)] == (False, "fine")
    assert got[5, day(20)] == (True, "adult") and got[6, day(100)] == (True, "all") and got[None, day(15)] == (True, "adult")
    assert all(got[k] == (False, None) for k in [(7, day(11)), (8, day(11)), (9, None), (10, day(15))])
    small = url_filter.judge(spark.createDataFrame(caps, "page_id long, url string, fetched date"), entries, slice_days=1)
    assert {(r.page_id, r.fetched): (r.blocked, r.category) for r in small.collect()} == got
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, fetched date"), entries).count() == 0
    assert not url_filter.judge(spark.createDataFrame(caps, "page_id long, url string, fetched date"), entries.limit(0)).where("blocked").count()


def test_spellings_of_an_entry_share_a_history(spark):
    entries = spark.createDataFrame([
        ("Bad.com/", "spam", False, day(1), True), ("bad.com", "spam", False, day(5), False), ("www.evil.com", "spam", False, day(1), True), ("EVIL.com.//Deep//", "worse", False, day(2), True),
        ("", "x", False, day(1), True), ("www.", "x", False, day(1), True), ("/", "x", False, day(1), True),
    ], "entry string, category string, allow boolean, day date, listed boolean")
    assert {r.entry for r in url_filter.intervals(entries).collect()} == {"bad.com", "evil.com", "evil.com/deep"}
    caps = [(1, "http://bad.com/", day(3)), (2, "http://BAD.com/", day(6)), (3, "http://www.evil.com/", day(3)), (4, "http://evil.com./deep/x", day(3)), (5, "http://evil.com/", dt.date(9999, 1, 1))]
    got = {r.page_id: (r.blocked, r.category) for r in url_filter.judge(spark.createDataFrame(caps, "page_id long, url string, fetched date"), entries).collect()}
    assert got == {1: (True, "spam"), 2: (False, None), 3: (True, "spam"), 4: (True, "worse"), 5: (True, "spam")}


def test_long_urls_and_clashing_columns(spark):
    entries = spark.createDataFrame([("bad.com", "spam", False, day(1), True)], "entry string, category string, allow boolean, day date, listed boolean")
    long = "http://bad.com/" + "step/" * 300 + "?" + "q" * 100_000
    caps = spark.createDataFrame([(1, long, day(3), "x", "y", "z", "w"), (2, "http://" + "a." * 100 + "bad.com/", day(3), "x", "y", "z", "w")], "page_id long, url string, fetched date, entry string, part string, host string, category string")
    got = url_filter.judge(caps, entries).collect()
    assert sorted((r.page_id, r.blocked) for r in got) == [(1, True), (2, True)]


ITEM = "If Tom has 12 apples and Bob Smith eats 3 kg of them how many of the 12 does Tom keep today"


def test_templates(spark, docs_of):
    docs = docs_of(
        (1, "so. " + ITEM + " in all"), (2, ITEM.replace("12", "40").replace("Bob Smith", "Zoe").replace(" 3 kg", " 7 km") + "."), (3, ITEM.replace("12", "40", 1)),
        (4, "the apples of Tom are many and nothing else is here to be seen"), (5, None), (6, ""), (None, ITEM), (7, "a b c d"), (1, "so. " + ITEM + " in all"),
    )
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, "a b c"), (12, None), (13, ""), (None, "x y")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows == r.item_windows, r.exact) for r in decontam.find(docs, items).collect()}
    assert got == {(1, 10): (True, True), (2, 10): (True, False), (7, 11): (True, True)}
    assert got == {(r.doc_id, r.item_id): (r.n_windows == r.item_windows, r.exact) for r in decontam.find(docs, items, broadcast_most=0).collect()}
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 3, 4, 5, 6]
    assert decontam.find(docs, items.limit(0)).count() == 0 and decontam.find(docs.limit(0), items).count() == 0


def test_a_consistent_alignment_counts_beside_an_inconsistent_one(spark, docs_of):
    """A document with a template twice: first filled inconsistently, then as the item or with other parameters."""
    bad, other = ITEM.replace("12", "40", 1), ITEM.replace("12", "40").replace("Tom", "Ann")
    docs = docs_of((1, f"so. {bad}. {ITEM}."), (2, f"so. {bad}. {other}."), (3, f"so. {bad}. {bad}."))
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): (r.n_windows == r.item_windows, r.exact) for r in decontam.find(docs, items).collect()} == {(1, 10): (True, True), (2, 10): (True, False)}
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [3]


def test_rows_of_one_doc_id_are_judged_each_by_its_own_text(spark, docs_of):
    bad = ITEM.replace("12", "40", 1)
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    docs = docs_of((1, "so. " + ITEM), (1, "so. " + bad), (2, bad), (2, "so. " + bad), (3, ITEM), (3, ITEM), (4, "pad " * 300_000 + ". " + ITEM))
    assert {(r.doc_id, r.exact) for r in decontam.find(docs, items).collect()} == {(1, True), (3, True), (4, True)}
    assert {(r.doc_id, r.exact) for r in decontam.find(docs, items, found_most=0).collect()} == {(1, True), (3, True), (4, True)}


def test_names_at_the_head_of_sentences(spark, docs_of):
    items = spark.createDataFrame([(1, "Alice bought 3 apples for 2 dollars"), (2, "Every day Tom runs. Alice walks 5 miles. The dog sleeps for 9 hours"), (3, "x")], "item_id long, text string")
    docs = docs_of((1, "Maria bought 7 apples for 9 dollars"), (2, "so he said: \"Zoe bought 4 apples for 8 dollars\""), (3, "Every day Ben runs. Maria walks 8 miles. The dog sleeps for 2 hours"), (4, "These bought 7 apples for 9 dollars"))
    assert {(r.doc_id, r.item_id, r.exact) for r in decontam.find(docs, items).collect()} == {(1, 1, False), (2, 1, False), (3, 2, False)}


def test_no_slot_compared_is_not_exact(spark, docs_of):
    tail = " and then we walk home along the old river road in the evening light with our dogs"
    items = spark.createDataFrame([(1, "we have 3 of them here" + tail)], "item_id long, text string")
    assert [(r.n_slots, r.exact) for r in decontam.find(docs_of((1, "so it was" + tail)), items).collect()] == [(0, False)]


def test_slots(spark):
    df = decontam.templates(spark.createDataFrame([(ITEM,)], "t string"), "t").selectExpr("t", "inline(views)")
    for r, values in zip(df.select("view", "tokens", decontam.slots(F.col("t"), F.col("view"), F.col("tokens")).alias("s")).orderBy("view").collect(), (["Tom", "12", "Bob Smith", "3", "kg", "12", "Tom"], ["12", "3", "kg", "12"])):
        assert [r.s[i] for i in sorted(r.s)] == values
        assert sorted(r.s) == [i for i, x in enumerate(r.tokens) if x in "\x01\x02\x03"]


def test_items_in_another_case(spark, docs_of):
    item = "Yesterday in the market Alice Smith bought 3 apples and Bob Jones paid 4 dollars for them all"
    items = spark.createDataFrame([(1, item), (2, "TWO HUNDRED PEOPLE saw Carol leave")], "item_id long, text string")
    again = item.replace("3", "5").replace("4", "9")
    docs = docs_of((1, item.lower()), (2, item.upper()), (3, "so. " + item.title() + "."), (4, again.lower()), (5, item), (6, "two hundred people saw carol leave"), (7, item.lower().replace("3", "5", 1).replace("apples", "apples 3 apples")))
    got = {(r.doc_id, r.item_id): (r.n_windows == r.item_windows, r.exact) for r in decontam.find(docs, items).collect()}
    assert {k: got.pop((k, 1)) for k in (1, 2, 3, 4, 5)} == {1: (True, True), 2: (True, True), 3: (True, True), 4: (True, False), 5: (True, True)}
    assert got.pop((6, 2)) == (True, True)
    assert same(decontam.find(docs, items), decontam.ORACLE, tables={"documents": docs, "benchmark": items})


def test_other_rows_of_a_doc_id_stay(spark, docs_of):
    items = spark.createDataFrame([(10, ITEM)], "item_id long, text string")
    docs = docs_of((1, "so. " + ITEM), (1, "quite another row"), (1, None), (1, "quite another row"), (2, ITEM.lower()), (None, ITEM))
    assert sorted((r.doc_id or 0, r.text or "") for r in decontam.clean(docs, items).collect()) == [(0, ITEM), (1, ""), (1, "quite another row"), (1, "quite another row")]


def test_windows_of_all_widths(spark):
    rows = spark.createDataFrame([([1, 2, 3, 1, 2, 3, 1, 2, 3, 4],), ([5],), ([],)], "h array<long>")
    for w in range(1, 10):
        got = [r.w for r in rows.select(decontam._windows(F.col("h"), w).alias("w")).collect()]
        want = [[1, 2, 3, 1, 2, 3, 1, 2, 3, 4][i : i + w] for i in range(11 - w)]
        assert [len(g) for g in got] == [len(want), int(w == 1), 0]
        assert all((a == b) == (x == y) for a, x in zip(got[0], want) for b, y in zip(got[0], want))


def test_licences(spark, docs_of):
    t = spark.createDataFrame([*licenses.STATEMENTS], "license string, statement string")
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = spark.createDataFrame([
        (1, "a/LICENSE", "x\n" + mit), (2, "a/src/x.txt", "code"), (3, "a/src/deep/y.txt", "code\n# " + apache), (4, "a/b/copying.md", apache), (5, "a/b/c/z", None), (6, "q/z", ""), (7, None, mit), (8, None, None),
        (2, "a/src/x.txt", "code"), (9, "a/b/c/w", "this licence plate is red"), (10, "top", "x"),
    ], "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.basis) for r in licenses.scan(files, t).collect()}
    assert got == {
        1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: ("Apache-2.0", "own"), 5: ("Apache-2.0", "inherited"), 6: (None, "none"), 7: ("MIT", "own"), 8: (None, "none"),
        9: ("Apache-2.0", "inherited"), 10: (None, "none"),
    }
    assert licenses.scan(files.limit(0), t).count() == 0
    assert {r.basis for r in licenses.scan(files, t.limit(0)).collect()} == {"none"}


def test_every_template_finds_its_licence_in_a_file_a_header_and_wrapped(spark):
    """Each template as a licence file in wrapped lines, as a wrapped comment header over code, and, if short, as a line."""
    import textwrap

    t = spark.createDataFrame([*licenses.STATEMENTS], "license string, statement string")
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.STATEMENTS):
        for k, (path, body) in enumerate((
            (f"p{i}/LICENSE", "\n".join(textwrap.wrap(text, 70, break_on_hyphens=False))), (f"q{i}/a.py", "\n\n" + "\n".join("# " + x for x in textwrap.wrap(text, 40, break_on_hyphens=False)) + "\n\ncode and more code"),
            (f"r{i}/a.c", "/*\n" + "\n".join(" * " + x for x in textwrap.wrap(text, 50, break_on_hyphens=False)) + "\n */\nint main() {}"), (f"s{i}/b.txt", "first\n" + text + "\nlast"),
        )):
            rows.append((4 * i + k, path, body))
            want[4 * i + k] = name
    got = {r.doc_id: (r.license, r.basis) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), t).collect()}
    same_text = {"BSD-2-Clause", "BSD-3-Clause"}  # the one is the other's beginning
    assert not [(i, n, got[i]) for i, n in want.items() if got[i][1] != "own" or (got[i][0] != n and not {got[i][0], n} <= same_text)]


def test_licence_edges(spark):
    """Long texts, equal scores, several ancestors, clashing columns, null paths."""
    t = spark.createDataFrame([("B", "licensed under the zork license"), ("A", "licensed under the zork license")], "license string, statement string")
    rows = [(1, "a/LICENSE", "licensed under the zork license", "x", "y"), (2, "a/b/c/d/e.txt", "words " * 200_000, "x", "y"), (3, None, "Licensed under the ZORK license", "x", "y"), (4, "z/e.txt", None, "x", "y"), (5, "a/b/COPYING", "nothing here", "x", "y")]
    got = {r.doc_id: (r.license, r.basis, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string, term string, license string"), t).collect()}
    assert got == {1: ("A", "own", 1.0), 2: ("A", "inherited", 1.0), 3: ("A", "own", 1.0), 4: (None, "none", None), 5: ("A", "inherited", 1.0)}


def test_no_word_list_decides_what_is_compared(spark):
    """A template without a word that speaks of licences; by an array of terms and by a join alike."""
    words = "altered source versions must be plainly marked as such"
    t = spark.createDataFrame([("Zlib", words), *licenses.STATEMENTS], "license string, statement string")
    rows = [(1, "a/x.c", "code\n" + words + "\n"), (2, "b/y.c", "such a long road as must be taken")] + [(k, f"c/{k}", f"some text of number {k} is here\nas must be") for k in range(3, 40)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: tuple(r[2:]) for r in licenses.scan(files, t).collect()}
    assert got[1] == ("Zlib", "own", 1.0) and {got[k][1] for k in range(2, 40)} == {"none"}
    assert got == {r.doc_id: tuple(r[2:]) for r in licenses.scan(files, t, array_most=0).collect()}


def test_tags_and_hints_stop_another_licence(spark):
    t = spark.createDataFrame([*licenses.STATEMENTS], "license string, statement string")
    rows = [
        (1, "p/LICENSE", "Released under the MIT License."), (2, "p/a.c", "// SPDX-License-Identifier: GPL-3.0-only\nint x;"), (3, "p/b.py", "# SPDX-License-Identifier: MIT\nx = 1"), (4, "p/c.py", "# spdx-license-identifier: EPL-2.0.\nx = 1"),
        (5, "p/d.py", "x = 1"), (6, "q/e.py", "# SPDX-License-Identifier: GPL-2.0+"), (7, "q/README", "this is licensed under the MIT License - see the LICENSE file"), (8, "p/f.py", "SPDX-License-Identifier:"),
        (9, "p/g.py", "parts of it are perhaps under the apache license, version 2.0, or whatever somebody else had written there at that time"),
    ] + [(k, f"r/{k}", f"line {k} of what the others write\nunder the of version {k}") for k in range(10, 60)]
    got = {r.doc_id: (r.license, r.basis) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), t).collect()}
    assert {k: got[k] for k in range(1, 10)} == {
        1: ("MIT", "own"), 2: ("GPL-3.0", "own"), 3: ("MIT", "own"), 4: (None, "unclear"), 5: ("MIT", "inherited"), 6: ("GPL-2.0", "own"), 7: ("MIT", "own"), 8: (None, "unclear"), 9: (None, "unclear"),
    }
