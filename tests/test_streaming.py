import datetime as dt

from doclens.operators import pages
from doclens.streaming import records

START = dt.datetime(2024, 1, 1)
LINES = "Dr Asha Rao\nTab. Dolo 650 mg BD\nBP 120/80"


def page(doc, n, minute, text=LINES, error=None):
    return (doc, n, "ocr", text, [0.95] * len(text or ""), len([x for x in (text or "").split("\n") if x.strip()]), False, False, error, START + dt.timedelta(minutes=minute))


#: Two folders' worth: pages out of order, repeated, late, and of documents that end in the second one.
FIRST = [page(1, 1, 1, "Tab. Pan 40 mg OD\nsecond page"), page(1, 0, 2), page(2, 0, 3), page(1, 0, 4, "a repeated page with another text"), page(3, 0, 5), (None, 0, *page(9, 0, 5)[2:])]
SECOND = [page(2, 2, 9, None, "lost"), page(2, 1, 8, "Tab. Pan 40 mg OD"), page(3, 1, 12, "and the end of it"), page(4, 0, 200), page(2, 1, 10, "again")]
LAST = [page(5, 0, 2000)]


def files(spark, folder, rows):
    spark.createDataFrame(rows, records.PAGES).coalesce(1).write.mode("append").parquet(folder)


def test_records_of_pages_that_come_late_and_again(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in (FIRST, SECOND, LAST, LAST):  # the stream is stopped and started again between them
        files(spark, folder, rows)
        records.write_records(records.read_pages(spark, folder), out, state).awaitTermination()
    got = spark.read.parquet(out).drop("batch")
    kept = [r for r in FIRST + SECOND if r[0] is not None and r not in (FIRST[3], SECOND[4])]
    want = pages.records(spark.createDataFrame([r[:-1] for r in kept], records.PAGES.rsplit(",", 1)[0]))
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: {r.doc_id: r for r in df.select(*sorted(want.columns)).collect()}
    assert key(got) == key(want) and got.count() == 4
    assert {k: r.status for k, r in key(got).items()} == {1: "ok", 2: "failed", 3: "ok", 4: "ok"}
    assert key(got)[1].raw_text == LINES + "\n\nTab. Pan 40 mg OD\nsecond page" and key(got)[2].raw_text == LINES + "\n\nTab. Pan 40 mg OD"


def test_a_batch_that_is_run_again_is_written_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for rows in (FIRST, LAST):
        files(spark, folder, rows)
        records.write_records(records.read_pages(spark, folder), out, state).awaitTermination()
    before = spark.read.parquet(out).count()
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], tmp_path / "state" / "commits" / f".{commits[-1].name}.crc"):  # as if the last batch had been cut off
        if p.exists():
            p.unlink()
    records.write_records(records.read_pages(spark, folder), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == before == 3
