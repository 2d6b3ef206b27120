"""The engine's queries over the driver's tables, each with equivalent SQL for checking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions import patterns as P
from doclens.operators import checks, classify, extract, lines, pages, plugins, privacy, quality, record, score
from doclens.plans import sql
from doclens.plans.registry import query
from doclens.plans.session import ready
from doclens.plans.sql import LEGIBLE, NAME_KEY, ROUTE, SQUEEZED, VALUE_KEY, gone, group, has
from doclens.sources import corpus, readers, stored
from doclens.sources.corpus import ctes, table

_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS raw_text FROM documents)"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("raw_text"))


# ---- lines


@query(f"WITH {_DOCS}, {sql.lines('docs')} SELECT doc_id, line_no, start, length(line) AS n_chars FROM lines")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.split_lines(texts(spark, sf_dir)).select("doc_id", "line_no", "start", F.length("line").cast("long").alias("n_chars"))


@query(f"SELECT doc_id, n AS legible, CASE WHEN n < {P.LEGIBLE_CHARS} THEN 'unreadable' ELSE 'ok' END AS status FROM (SELECT doc_id, {LEGIBLE("coalesce(text, '')")} AS n FROM documents)")
def legibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).select("doc_id", lines.legible(F.col("raw_text")).cast("long").alias("legible"))
    return rows.withColumn("status", F.when(F.col("legible") < P.LEGIBLE_CHARS, "unreadable").otherwise("ok"))


@query(f"WITH {_DOCS}, {sql.lines('docs')}, {sql.reasons()} SELECT doc_id, line_no, reason FROM reasons WHERE reason IS NOT NULL")
def repeated_line_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_reasons(lines.split_lines(texts(spark, sf_dir))).where("reason is not null").select("doc_id", "line_no", "reason")


@query(ctes("notes") + f", {sql.lines('notes')}, {sql.reasons()} SELECT doc_id, line_no, line, reason FROM reasons")
def commentary_and_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_reasons(lines.split_lines(corpus.notes(spark, sf_dir))).select("doc_id", "line_no", "line", "reason")


@query(f"""WITH {_DOCS}, n AS (SELECT doc_id, len(list_filter(string_split(raw_text, chr(10)), lambda x: trim(x) <> '')) AS lines_read, (doc_id % 7) * 3 AS visible FROM docs)
SELECT doc_id, lines_read, visible, CASE WHEN lines_read = 0 THEN 'ok' WHEN visible = 0 THEN 'withhold: nothing visible' WHEN lines_read < 0.6 * visible - 1 THEN 'doubt: text may be missing' WHEN lines_read <= visible THEN 'ok'
  WHEN lines_read >= 2 * greatest(1, visible) + 6 THEN 'withhold: more than the page holds' WHEN lines_read >= greatest(1.5 * visible + 4, visible + 6) THEN 'doubt: text may be invented' ELSE 'doubt: extra text or dense layout' END AS verdict FROM n""")
def line_count_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines visible on a page come from its image; here they are taken from doc_id, so that every verdict occurs."""
    read = F.size(F.filter(F.split("raw_text", "\n"), lambda x: F.trim(x) != "")).cast("long")
    rows = texts(spark, sf_dir).select("doc_id", read.alias("lines_read"), (F.col("doc_id") % 7 * 3).alias("visible"))
    return rows.withColumn("verdict", quality.line_count_verdict(F.col("lines_read"), F.col("visible")))


@query(f"""WITH {_DOCS}, {sql.lines('docs')}, {sql.reasons()} SELECT doc_id, md5(string_agg(CASE WHEN reason IS NOT NULL THEN repeat(' ', length(line)) ELSE line END, chr(10) ORDER BY line_no)) AS trusted_md5,
  sum((reason IS NOT NULL)::int)::bigint AS n_withheld FROM reasons GROUP BY doc_id""")
def withheld_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.line_reasons(lines.split_lines(texts(spark, sf_dir))).withColumn("withheld", F.col("reason").isNotNull())
    return lines.withhold(judged, counted=True).select("doc_id", F.md5("trusted").alias("trusted_md5"), "n_withheld")


@query(f"""WITH RECURSIVE {_DOCS}, cut AS (SELECT doc_id, 0 AS chunk, 0 AS start, CASE WHEN length(raw_text) <= 900 THEN length(raw_text) ELSE coalesce(nullif(nullif(900 - instr(reverse(substring(raw_text, 1, 900)), chr(10)) + 1, 901), 1), 900) END AS size FROM docs WHERE raw_text <> ''
  UNION ALL SELECT c.doc_id, chunk + 1, c.start + c.size, CASE WHEN length(rest) <= 900 THEN length(rest) ELSE coalesce(nullif(nullif(900 - instr(reverse(substring(rest, 1, 900)), chr(10)) + 1, 901), 1), 900) END
  FROM (SELECT c.*, substring(raw_text, c.start + c.size + 1) AS rest FROM cut c JOIN docs USING (doc_id)) c WHERE rest <> '')
SELECT doc_id, chunk::int AS chunk, start::bigint AS start, size::bigint AS n_chars FROM cut""")
def recogniser_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 900 characters, cut after line breaks."""
    return lines.chunks(texts(spark, sf_dir)).select("doc_id", "chunk", F.col("start").cast("long").alias("start"), F.length("text").cast("long").alias("n_chars"))


_ANSWER = "CASE doc_id % 4 WHEN 0 THEN '```text' || chr(10) || {0} || chr(10) || '```' WHEN 1 THEN '  ' || {0} || ' ' WHEN 2 THEN '*No readable text.*' ELSE {0} END"


@query(f"""WITH {_DOCS} SELECT doc_id, md5(trim({gone("CASE doc_id % 4 WHEN 2 THEN '' ELSE raw_text END", '^' + chr(92) + 's+|' + chr(92) + 's+$')})) AS text_md5, true AS aligned FROM docs""")
def reader_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a reader in code fences, with white space or with nothing to read; each character carries its place as its
    probability, so that the cut shows."""
    rows = texts(spark, sf_dir).select("doc_id", "raw_text", F.expr(_ANSWER.format("raw_text")).alias("text")).withColumn("confidence", F.transform(F.split("text", ""), lambda c, i: i.cast("double")))
    out = lines.strip_wrapping(rows)
    first = F.when(F.col("doc_id") % 4 == 0, 8).when(F.col("doc_id") % 4 == 1, 2).otherwise(0) + F.length("raw_text") - F.length(F.regexp_replace("raw_text", r"^\s+", ""))
    fits = (F.size("confidence") == F.length("text")) & (F.coalesce(F.get("confidence", F.lit(0)), first.cast("double")) == first)
    return out.select("doc_id", F.md5("text").alias("text_md5"), fits.alias("aligned"))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::double) * 100)::int) AS bands, 12 + (vec_id % 5) * 6 AS tallest FROM embeddings),
t AS (SELECT *, list_sort(list_filter(bands, lambda h: h BETWEEN 5 AND tallest)) AS tall, greatest(1, tall[len(tall) // 2 + 1]) AS typical FROM b)
SELECT vec_id, coalesce(list_sum(list_transform(bands, lambda h: CASE WHEN len(tall) = 0 OR h < 5 OR h > 6 * typical THEN 0 WHEN h >= 1.7 * typical THEN round_even(h / typical, 0)::int ELSE 1 END)), 0)::int AS n_lines FROM t""")
def lines_in_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings stand for the heights of a page's ink bands; what is too tall for a line differs by page."""
    bands = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", quality.lines_in_bands(bands, 12 + (F.col("vec_id") % 5) * 6).alias("n_lines"))


# ---- pages

#: Documents as pages of eight lines, as a reader might give them: some from a text layer, blank, cut short or lost, with a number
#: of visible lines. Tokens have one to four bytes, so that they part characters; one document in five was read with little
#: certainty. Expressions of both engines; {div} is their whole division.
PAGE_LINES = 8
_PAGE = {
    "source": "CASE WHEN (doc_id + page) % 3 = 0 THEN 'text_layer' ELSE 'ocr' END",
    "visible": "CASE WHEN doc_id % 3 = 0 THEN n_read ELSE (doc_id * 7 + page * 3) % 12 END",
    "truncated": "(doc_id + page) % 11 = 0", "blank": "(doc_id + 2 * page) % 13 = 5", "error": "CASE WHEN (doc_id + 3 * page) % 29 = 7 THEN 'lost' END", "n_bytes": "1 + (doc_id + page) % 4",
}
_CERTAIN = "1 - ((i * 37 + doc_id * 11) % 100) / 100.0 * CASE WHEN doc_id % 5 = 0 THEN 0.9 ELSE 0.1 END"
_PAGES_SQL = f"""{_DOCS}, cut AS (SELECT doc_id, string_split(raw_text, chr(10)) AS a FROM docs),
parts AS (SELECT doc_id, p::int AS page, array_to_string(a[p * {PAGE_LINES} + 1 : p * {PAGE_LINES} + {PAGE_LINES}], chr(10)) AS raw_text, len(list_filter(a[p * {PAGE_LINES} + 1 : p * {PAGE_LINES} + {PAGE_LINES}], lambda x: trim(x) <> '')) AS n_read FROM cut, unnest(range(0, (len(a) + {PAGE_LINES - 1}) // {PAGE_LINES})) AS r(p)),
pages AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _PAGE.items())} FROM parts),
tokens AS (SELECT doc_id, page, i, ({_CERTAIN})::double AS p, n_bytes FROM pages, unnest(range(0, (octet_length(encode(raw_text)) + n_bytes - 1) // n_bytes)) AS r(i)),
chars AS MATERIALIZED (SELECT doc_id, page, j, c, n_bytes, sum(octet_length(encode(c))) OVER (PARTITION BY doc_id, page ORDER BY j) AS done FROM (SELECT doc_id, page, n_bytes, unnest(range(1, length(raw_text) + 1)) AS j, substring(raw_text, j, 1) AS c FROM pages)),
ended AS (SELECT DISTINCT doc_id, page, (done - 1)::bigint // n_bytes AS i FROM chars),
begun AS (SELECT t.doc_id, t.page, t.i, i = 0 OR done IS NOT NULL AS first, CASE WHEN i = 0 OR done IS NOT NULL OR (t.doc_id, t.page, t.i) IN (SELECT (doc_id, page, i) FROM ended) THEN p END AS p FROM tokens t LEFT JOIN chars c ON c.doc_id = t.doc_id AND c.page = t.page AND c.done = t.i * t.n_bytes),
runs AS (SELECT *, sum(first::int) OVER (PARTITION BY doc_id, page ORDER BY i) AS run FROM begun),
least_ AS (SELECT doc_id, page, i, min(p) OVER (PARTITION BY doc_id, page, run ORDER BY i) AS p FROM runs),
sure AS MATERIALIZED (SELECT c.doc_id, c.page, c.j, c.c, l.p FROM chars c JOIN least_ l ON l.doc_id = c.doc_id AND l.page = c.page AND l.i = (c.done - 1)::bigint // c.n_bytes)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, source, text, visible, truncated, blank, error, tokens)."""
    cut = F.split("raw_text", "\n")
    part = lambda p: F.slice(cut, p * PAGE_LINES + 1, PAGE_LINES)
    each = F.transform(F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / PAGE_LINES).cast("int")), lambda p: F.struct(p.alias("page"), F.array_join(part(p), "\n").alias("text"), F.size(F.filter(part(p), lambda x: F.trim(x) != "")).alias("n_read")))
    rows = texts(ready(spark), sf_dir).select("doc_id", F.inline(each)).withColumns({n: F.expr(e) for n, e in _PAGE.items()})
    # _CERTAIN in thousandths: whole numbers, whose quotient is the double nearest to the decimal
    certain = "(1000 - (i * 37 + doc_id * 11) % 100 * if(doc_id % 5 = 0, 9, 1)) / 1000D"
    return rows.withColumns({"visible": F.col("visible").cast("int"), "tokens": F.expr(f"""if(text = '', array(), transform(sequence(0, cast(floor((octet_length(text) - 1) / n_bytes) as int)),
      i -> named_struct('n_bytes', cast(n_bytes as int), 'p', {certain})))""")}).drop("n_read", "n_bytes")


@query(f"WITH {_PAGES_SQL} SELECT doc_id, page, count(*) AS n_chars, sum(round(p * 1000000)::bigint)::bigint AS millionths, sum((j % 97) * round(p * 1000000)::bigint)::bigint AS placed FROM sure GROUP BY ALL")
def character_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a page's characters from those of a reader's tokens, which part characters of several bytes."""
    rows = lines.staged(pages.character_confidence(_pages(spark, sf_dir)).where("text <> ''"), million=F.transform("confidence", checks.millionths))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", "page", F.size("confidence").cast("long").alias("n_chars"), add("million").alias("millionths"), add(F.transform("million", lambda x, i: (i + 1) % 97 * x)).alias("placed"))


@query(rf"""WITH {_PAGES_SQL}, lost AS (SELECT doc_id, min(page) AS at_page FROM pages WHERE error IS NOT NULL GROUP BY doc_id),
kept AS (SELECT p.*, NOT blank AND coalesce(bool_or(raw_text <> '' AND NOT blank) OVER (PARTITION BY p.doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS broken FROM pages p LEFT JOIN lost l USING (doc_id) WHERE at_page IS NULL OR page < at_page),
paged AS (SELECT doc_id * 100000 + page AS doc_id, raw_text FROM kept WHERE NOT blank), {sql.lines('paged')}, {sql.reasons()},
read_ AS (SELECT doc_id, count(*) FILTER (trim({gone('line', chr(92) + 's+', "' '")}) <> '') AS n FROM lines GROUP BY doc_id),
verdicts AS (SELECT k.*, n, CASE WHEN source <> 'ocr' OR n = 0 THEN 'ok' WHEN visible = 0 THEN 'withhold' WHEN n < 0.6 * visible - 1 THEN 'doubt' WHEN n <= visible THEN 'ok' WHEN n >= 2 * greatest(1, visible) + 6 THEN 'withhold' ELSE 'doubt' END AS verdict FROM kept k JOIN read_ r ON r.doc_id = k.doc_id * 100000 + page),
line_p AS (SELECT l.doc_id, l.line_no, sum(round(p * 1000000)::bigint) AS total, count(*) AS n FROM lines l JOIN sure s ON s.doc_id * 100000 + s.page = l.doc_id AND s.j > l.start AND s.j <= l.start + length(l.line) WHERE NOT regexp_matches(c, '^\s$') GROUP BY ALL),
judged AS (SELECT v.doc_id, v.page, r.line_no, r.line, CASE WHEN verdict = 'withhold' THEN 'page' WHEN source = 'ocr' AND trim({gone('line', chr(92) + 's+', "' '")}) <> '' THEN r.reason END AS reason, (verdict = 'doubt')::int + (source = 'ocr' AND truncated)::int AS doubts,
  source = 'ocr' AND trim({gone('line', chr(92) + 's+', "' '")}) <> '' AND coalesce(round(total / p.n / 1000000, 3) < {checks.SURE_LINE}, false) AS low FROM verdicts v JOIN reasons r ON r.doc_id = v.doc_id * 100000 + v.page LEFT JOIN line_p p ON p.doc_id = r.doc_id AND p.line_no = r.line_no WHERE broken OR raw_text <> ''),
of_doc AS (SELECT doc_id, count(reason) AS n_withheld, sum(low::int) AS n_low_lines, sum(doubts) AS n_doubts, sum(CASE WHEN reason IS NULL THEN {LEGIBLE('line')} ELSE 0 END) AS legible FROM judged GROUP BY doc_id),
of_page AS (SELECT k.doc_id, k.page, k.source, CASE WHEN k.blank THEN 'blank' WHEN verdict = 'withhold' THEN 'suspect' WHEN {LEGIBLE('k.raw_text')} < {P.LEGIBLE_CHARS} THEN 'no_text' ELSE 'ok' END AS status, coalesce(q.n, 0) AS n_lines FROM kept k LEFT JOIN verdicts v ON v.doc_id = k.doc_id AND v.page = k.page
  LEFT JOIN (SELECT doc_id, count(*) FILTER (trim(line) <> '') AS n FROM lines GROUP BY doc_id) q ON q.doc_id = k.doc_id * 100000 + k.page),
listed AS (SELECT doc_id, string_agg(page || ':' || source || ':' || status || ':' || n_lines, '|' ORDER BY page) AS pages, count(*) FILTER (status IN ('suspect', 'no_text')) AS n_suspect FROM of_page GROUP BY doc_id),
whole AS (SELECT doc_id, string_agg(CASE WHEN broken THEN chr(10) || chr(10) ELSE '' END || raw_text, '' ORDER BY page) AS raw_text FROM kept WHERE NOT blank GROUP BY doc_id),
mean AS (SELECT s.doc_id, round(sum(round(p * 1000000)::bigint) / count(*) / 1000000, 3) AS m FROM sure s JOIN kept k USING (doc_id, page) WHERE k.source = 'ocr' AND NOT blank AND regexp_matches(c, '^[\p{{L}}\p{{N}}]$') GROUP BY s.doc_id),
every AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS lost, coalesce(w.raw_text, '') AS raw_text, coalesce(legible, 0) AS legible, coalesce(n_withheld, 0) AS n_withheld, coalesce(n_low_lines, 0) AS n_low, coalesce(n_doubts, 0) AS n_doubts, coalesce(n_suspect, 0) AS n_suspect, m, coalesce(p.pages, '') AS pages
  FROM docs d LEFT JOIN lost l USING (doc_id) LEFT JOIN whole w USING (doc_id) LEFT JOIN of_doc o USING (doc_id) LEFT JOIN listed p USING (doc_id) LEFT JOIN mean USING (doc_id))
SELECT doc_id, CASE WHEN lost THEN 'failed' WHEN legible < {P.LEGIBLE_CHARS} THEN 'unreadable' WHEN n_withheld > 0 OR n_low > 0 OR n_doubts > 0 OR n_suspect > 0 OR coalesce(m < {checks.SURE_DOCUMENT}, false) THEN 'low_confidence' ELSE 'ok' END AS status, CASE WHEN lost THEN 'reader_failed' END AS error,
  n_withheld::bigint AS n_withheld, n_low::bigint AS n_low_lines, n_suspect::bigint AS n_suspect_pages, m AS ocr_confidence, pages, md5(raw_text) AS text_md5 FROM every""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents made of pages that a reader gave: what is kept of each, and the status that follows."""
    given = pages.character_confidence(_pages(spark, sf_dir)).withColumn("confidence", F.when(F.col("source") == "ocr", F.col("confidence"))).drop("tokens")
    rows = pages.records(given)
    listed = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["page"].cast("string"), p["source"], p["status"], p["n_lines"].cast("string"))), "|")
    return rows.select("doc_id", "status", "error", "n_withheld", "n_low_lines", "n_suspect_pages", "ocr_confidence", listed.alias("pages"), F.md5("raw_text").alias("text_md5"))


# ---- kinds


@query(ctes("every") + f""", {sql.classified('every')} SELECT doc_id, {', '.join(f'{f}::int AS {f}' for f in classify.FAMILIES)}, kind, about_a_patient FROM classified""")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(corpus.every(spark, sf_dir)).select("doc_id", *classify.FAMILIES, "kind", "about_a_patient")


# ---- medicines

_MEDICINES = "doc_id, line_no, seg_no, name, dosage, frequency, duration"


@query(ctes("invoices") + f", {sql.lines('invoices')}, {sql.medicines('lines', 'true')} SELECT doc_id, line_no, name, dosage FROM medicines")
def invoice_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which medicines does each invoice name, and with which strength?"""
    return extract.mentioned_medicines(lines.split_lines(corpus.invoices(spark, sf_dir))).select("doc_id", "line_no", "name", "dosage")


@query(ctes("prescriptions") + f", {sql.lines('prescriptions')}, {sql.medicines('lines', 'false')} SELECT {_MEDICINES} FROM medicines")
def prescribed_medicines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.prescribed_medicines(lines.split_lines(corpus.prescriptions(spark, sf_dir)))


@query(ctes("notes") + f", {sql.lines('notes')}, {sql.medicines('lines', 'false')} SELECT {_MEDICINES} FROM medicines")
def prescribed_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.prescribed_medicines(lines.split_lines(corpus.notes(spark, sf_dir)))


@query(ctes("prescriptions") + f""", {sql.lines('prescriptions')}, {sql.medicines('lines', 'false')} SELECT doc_id, string_agg(dosage, '|' ORDER BY line_no, seg_no) AS dosages, string_agg(frequency, '|' ORDER BY line_no, seg_no) AS frequencies
FROM medicines GROUP BY doc_id""")
def derived_dosages_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.prescribed_medicines(lines.split_lines(corpus.prescriptions(spark, sf_dir)))
    joined = lambda c: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "seg_no", c))), lambda r: r[c]), "|"), F.lit(""))
    return rows.groupBy("doc_id").agg(joined("dosage").alias("dosages"), joined("frequency").alias("frequencies"))


@query(ctes("invoices") + f""", {sql.lines('invoices')}, {sql.medicines('lines', 'true')} SELECT doc_id, line_no, name FROM (SELECT *, {sql.MENTION_KEY('name')} AS key FROM medicines)
QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY line_no, seg_no) = 1""")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.mentioned_medicines(lines.split_lines(corpus.invoices(spark, sf_dir)))
    return extract.first_wins(rows, extract.mention_key(F.col("name")), ["line_no", "seg_no"]).select("doc_id", "line_no", "name")


# ---- other values


@query(ctes("lab_reports") + f""", {sql.lines('lab_reports')} SELECT doc_id, line_no, {group('line', P.LAB_ROW, 2)} AS name, {group('line', P.LAB_ROW, 4)} AS value, {group('line', P.LAB_ROW, 6)} AS unit,
  {group('line', P.LAB_ROW, 8)} AS reference_range FROM lines WHERE {sql.LAB}""")
def lab_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.lab_results(lines.split_lines(corpus.lab_reports(spark, sf_dir)))


@query(ctes("notes") + f""", {sql.lines('notes')}, found AS (SELECT doc_id, line_no, {', '.join(f"regexp_extract_all(line, '{P.VITAL_MEASURE}', {k}) AS {c}" for k, c in ((1, 'a'), (3, 'b'), (4, 'c')))}
  FROM (SELECT *, {ROUTE} AS route FROM lines) WHERE route = 'vitals') SELECT doc_id, line_no, (i - 1)::int AS n, a[i] AS name, b[i] AS value, nullif(c[i], '') AS unit FROM found, unnest(range(1, len(a) + 1)) AS r(i)""")
def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.vitals(lines.split_lines(corpus.notes(spark, sf_dir)))


@query(ctes("lab_reports", "notes") + f", both_ AS (SELECT * FROM lab_reports UNION ALL SELECT -doc_id, raw_text FROM notes), {sql.lines('both_')} SELECT doc_id, line_no, {sql.TIDY('line')} AS panel FROM (SELECT *, {ROUTE} AS route FROM lines) WHERE route = 'panel'")
def panel_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = corpus.lab_reports(spark, sf_dir).unionByName(corpus.notes(spark, sf_dir).withColumn("doc_id", -F.col("doc_id")))
    return extract.panels(lines.split_lines(both))


@query(ctes("every") + f""", {sql.lines('every')} SELECT doc_id % 4 AS corpus, route, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM (SELECT *, {ROUTE} AS route FROM lines) GROUP BY ALL""")
def line_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each line's route rests on the line alone, so offsets aren't needed here
    rows = extract.route(corpus.every(spark, sf_dir).select("doc_id", F.explode(F.split("raw_text", "\n")).alias("line")))
    by_doc = rows.groupBy("doc_id", "route").agg(F.count("*").alias("n"))
    return by_doc.groupBy((F.col("doc_id") % 4).alias("corpus"), "route").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_docs"))


@query(ctes("notes") + f""", {sql.lines('notes')}, bodies AS (SELECT *, CASE route {' '.join(f"WHEN '{r}' THEN regexp_extract(line, '{p}(.*)$', 1)" for r, p in (('allergy', P.ALLERGY), ('diagnosis', P.DIAGNOSIS), ('complaint', P.COMPLAINT)))} END AS body FROM (SELECT *, {ROUTE} AS route FROM lines)),
parts AS (SELECT *, regexp_split_to_array({gone('body', r'(?s)\s(?:x|for|since)\s*[0-9].*$')}, ',|;|\\band\\b') AS ps FROM bodies WHERE route IN ('allergy', 'diagnosis', 'complaint') AND NOT (route = 'allergy' AND ({has('line', P.NO_ALLERGY)} OR {has('body', P.ABSENT)}))),
items AS (SELECT doc_id, line_no, route, i, {sql.TIDY('ps[i]')} AS item FROM parts, unnest(range(1, len(ps) + 1)) AS r(i))
SELECT doc_id, line_no, (row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) - 1)::int AS n, CASE route WHEN 'allergy' THEN 'allergies' WHEN 'diagnosis' THEN 'diagnoses' ELSE 'symptoms' END AS field, item FROM items WHERE length(item) >= 2 AND {has('item', '[A-Za-z]')} AND NOT {has('item', P.ABSENT)}""".replace("\\\\b", "\\b"))
def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.section_items(lines.split_lines(corpus.notes(spark, sf_dir)))


@query(ctes("prescriptions") + f", {sql.classified('prescriptions')}, {sql.headers()} SELECT doc_id, nullif(doctor, '') AS doctor_name, nullif(patient, '') AS patient_name, date FROM headed")
def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.header_texts(classify.classify(corpus.prescriptions(spark, sf_dir))).select("doc_id", "doctor_name", "patient_name", "date")


@query(ctes("notes") + f", {sql.classified('notes')}, {sql.headers()} SELECT doc_id, nullif(patient, '') AS patient_name, why AS reason FROM headed")
def patient_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.header_texts(classify.classify(corpus.notes(spark, sf_dir))).select("doc_id", "patient_name", "reason")


@query(ctes("prescriptions") + f""", {sql.lines('prescriptions')}, pages AS (SELECT doc_id, start, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::int AS page FROM lines WHERE line_no % 3 = 0)
SELECT l.doc_id, l.line_no, max(p.page) AS page FROM lines l JOIN pages p ON p.doc_id = l.doc_id AND p.start <= l.start GROUP BY ALL""")
def page_of_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line begins a page."""
    rows = lines.split_lines(corpus.prescriptions(spark, sf_dir))
    pages = rows.where("line_no % 3 = 0").select("doc_id", "start", F.expr("CAST(line_no div 3 AS INT)").alias("page"))
    return extract.page_of(rows.select("doc_id", "line_no", "start"), pages).select("doc_id", "line_no", "page")


# ---- whole records

_TODAY = "2022-01-01"


@query(ctes("every") + f", {sql.entities('every', f'DATE {chr(39)}{_TODAY}{chr(39)}')} SELECT doc_id, field, item_no, sub, text, start, end_ AS \"end\", array_to_string(reasons, '|') AS reasons FROM entities")
def entities_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every document of the four corpora, a row each, judged as of a fixed day."""
    found = record.values(record.items(corpus.every(spark, sf_dir), today=F.lit(_TODAY).cast("date")))
    return found.select("doc_id", "field", "item_no", "sub", "text", "start", "end", F.array_join("reasons", "|").alias("reasons"))


_FLAT = lambda f, subs: f"string_agg(s, ';' ORDER BY item_no) FILTER (field = '{f}') AS {f}"
_LISTED = (*record.RECORDS, *record.LISTED)


@query(ctes("notes") + f""", {sql.lines('notes', name='raw_lines')}, {sql.reasons('raw_lines')}, trusted AS (SELECT doc_id, string_agg(CASE WHEN reason IS NOT NULL THEN repeat(' ', length(line)) ELSE line END, chr(10) ORDER BY line_no) AS raw_text, count(reason) AS n_withheld FROM reasons GROUP BY doc_id),
judged AS (SELECT n.doc_id, n.raw_text IS NULL AS absent, coalesce(t.n_withheld, 0) AS n_withheld, {LEGIBLE("coalesce(t.raw_text, '')")} AS legible, CASE WHEN n.raw_text IS NULL THEN 'failed' WHEN legible < {P.LEGIBLE_CHARS} THEN 'unreadable' WHEN coalesce(t.n_withheld, 0) > 0 THEN 'low_confidence' ELSE 'ok' END AS status
  FROM notes n LEFT JOIN trusted t USING (doc_id)), source_ AS (SELECT t.doc_id, t.raw_text FROM trusted t JOIN judged USING (doc_id) WHERE legible >= {P.LEGIBLE_CHARS}), {sql.entities('source_')},
flat AS (SELECT doc_id, field, item_no, string_agg(sub || '=' || text, ',' ORDER BY list_position(['text', 'name', 'dosage', 'frequency', 'duration', 'value', 'unit', 'reference_range'], sub)) AS s, count(*) FILTER (len(reasons) > 0) AS r FROM entities GROUP BY ALL),
folded AS (SELECT doc_id, {', '.join(f"max(substring(s, 6)) FILTER (field = '{f}') AS {f}" for f in record.SINGLE)}, {', '.join(f"string_agg(s, ';' ORDER BY item_no) FILTER (field = '{f}') AS {f}" for f in _LISTED)}, sum(r)::bigint AS n_review FROM flat GROUP BY doc_id)
SELECT j.doc_id, j.status, CASE WHEN j.status IN ('ok', 'low_confidence') THEN coalesce(c.kind, 'unknown') ELSE 'unknown' END AS document_type, CASE WHEN absent THEN 'no_text' END AS error, j.n_withheld, {', '.join(record.SINGLE)}, {', '.join(f"coalesce({f}, '') AS {f}" for f in _LISTED)}, coalesce(n_review, 0) AS n_review
FROM judged j LEFT JOIN (SELECT doc_id, kind FROM classified) c USING (doc_id) LEFT JOIN folded USING (doc_id)""")
def documents_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of each note, withheld lines left out, its nested entities written out again as text."""
    docs = corpus.notes(spark, sf_dir)
    rows = record.records(docs, reasons=quality.line_reasons(lines.split_lines(docs)))
    text = lambda v, name: F.when(v.isNotNull(), F.concat(F.lit(f"{name}="), v["text"]))
    whole = lambda f: (lambda r: F.array_join(F.array(*(text(r[s], s) for s in record.RECORDS[f])), ",")) if f in record.RECORDS else (lambda r: text(r, "text"))
    joined = lambda f: F.array_join(F.transform(F.col(f"entities.{f}"), whole(f)), ";")
    flagged = sum((F.coalesce(F.col(f"entities.{f}.needs_review").cast("long"), F.lit(0)) for f in record.SINGLE), F.lit(0).cast("long"))
    one = lambda v: F.coalesce(v["needs_review"].cast("long"), F.lit(0).cast("long"))
    marks = lambda subs: lambda r: sum((one(r[s]) for s in subs), F.lit(0).cast("long"))
    for f in _LISTED:
        each = marks(record.RECORDS[f]) if f in record.RECORDS else one
        flagged = flagged + F.coalesce(F.aggregate(F.transform(F.col(f"entities.{f}"), each), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    return rows.select("doc_id", "status", "document_type", "error", "n_withheld", *(F.col(f"entities.{f}.text").alias(f) for f in record.SINGLE), *(F.coalesce(joined(f), F.lit("")).alias(f) for f in _LISTED), flagged.alias("n_review"))


# ---- checks


@query(f"""WITH {_DOCS}, {sql.lines('docs')}, {sql.reasons()}, doubts AS (SELECT doc_id, line_no, reason FROM reasons WHERE reason IS NOT NULL UNION ALL SELECT doc_id, line_no, 'long line' FROM lines WHERE length(line) > 400)
SELECT l.doc_id, l.line_no, coalesce(d.reasons, '') AS reasons FROM lines l LEFT JOIN (SELECT doc_id, line_no, string_agg(DISTINCT reason, '|' ORDER BY reason) AS reasons FROM doubts GROUP BY ALL) d USING (doc_id, line_no)""")
def doubt_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.line_reasons(lines.split_lines(texts(spark, sf_dir)))
    doubts = judged.select("doc_id", "line_no", F.explode(F.filter(F.array("reason", F.when(F.length("line") > 400, "long line")), lambda r: r.isNotNull())).alias("reason"))
    return checks.overlay(lines.split_lines(texts(spark, sf_dir)).select("doc_id", "line_no"), doubts).select("doc_id", "line_no", F.array_join("reasons", "|").alias("reasons"))


#: Names of tests out of part keys, with a misreading in most.
_SEEN = "CASE p_partkey % 11 WHEN 0 THEN 'HbAlc' WHEN 1 THEN 'T5H level' WHEN 2 THEN 'ESR' WHEN 3 THEN 'LDI cholesterol' WHEN 4 THEN 'Serum 8UN' WHEN 5 THEN 'B1Z' WHEN 6 THEN p_name WHEN 7 THEN 'H8 ' || p_size WHEN 8 THEN 'hBAlC' WHEN 9 THEN 'FT' || (p_partkey % 5) || ' and TSH' ELSE upper(p_name) END"


@query(f"""WITH names AS (SELECT DISTINCT {_SEEN} AS name FROM part), {sql.MISREAD_WORDS} SELECT n.name, m.meant FROM names n LEFT JOIN misread m USING (name)""")
def confusable_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.confusable_names(table(spark, sf_dir, "part").select(F.expr(_SEEN).alias("name")).distinct())


_MISREAD = "CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN replace(line, '0', 'O') WHEN 1 THEN replace(line, '1-0-1', '1-O-1') WHEN 2 THEN replace(line, 'MG OD', 'MG D') ELSE line END"


@query(ctes("prescriptions") + f""", bad AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS line_no, dosage, {_MISREAD} AS line FROM items),
judged AS (SELECT doc_id, line_no, line, {group('line', P.DOSE_WITH_LETTERS.parts, 2)} AS dose_letters, {group('line', P.CODE_WITH_LETTERS.parts, 2)} AS code_letters,
  CASE WHEN instr(line, dosage) > 0 AND {has("substring(line, instr(line, dosage) + length(dosage), 3)", P.STRAY_CAPITAL)} THEN trim(substring(line, instr(line, dosage) + length(dosage), 2)) END AS stray_capital FROM bad WHERE dosage IS NOT NULL)
SELECT * FROM judged WHERE dose_letters IS NOT NULL OR code_letters IS NOT NULL OR stray_capital IS NOT NULL""")
def dose_and_code_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prescription lines with misreadings put in."""
    rows = corpus.prescription_items(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no"), "dosage", F.expr(_MISREAD).alias("line")).distinct()
    found = checks.misread_doses(rows).drop("dosage")
    return found.where("dose_letters is not null or code_letters is not null or stray_capital is not null")


@query(ctes("lab_reports") + f""", {sql.lines('lab_reports')}, rows_ AS (SELECT doc_id, line_no, {group('line', P.LAB_ROW, 4)} AS value, {group('line', P.LAB_ROW, 8)} AS ref FROM lines WHERE {sql.LAB}),
n AS (SELECT *, value::double AS x, CASE WHEN {has('ref', P.RANGE)} THEN regexp_extract(ref, '{P.RANGE}', 1)::double ELSE 0 END AS lo, CASE WHEN {has('ref', P.RANGE)} THEN regexp_extract(ref, '{P.RANGE}', 2)::double END AS hi FROM rows_)
SELECT doc_id, line_no, value, ref AS reference_range FROM n WHERE (hi > 0 AND x > 10 * hi) OR (lo > 0 AND x < lo / 10)""")
def decimal_slips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.lab_results(lines.split_lines(corpus.lab_reports(spark, sf_dir)))
    return rows.where(checks.decimal_slip(F.col("value"), F.col("reference_range"))).select("doc_id", "line_no", "value", "reference_range")


_DATE_TEXT = "CASE o_orderkey % 7 WHEN 0 THEN '31/02/2001' WHEN 1 THEN '05|06|1999' WHEN 2 THEN '12-11-98' WHEN 3 THEN '25/12/2199' WHEN 4 THEN '12/31/1931' WHEN 5 THEN '3 Mar 2001' ELSE {} END"


@query(f"""WITH d AS (SELECT o_orderkey, {_DATE_TEXT.format("strftime(o_orderdate, '%d/%m/%Y')")} AS date FROM orders) SELECT o_orderkey, date, array_to_string({sql.date_reasons('date', "DATE '2026-01-01'")}, '|') AS reasons FROM (SELECT *, {sql.DATE_PARTS('date')} FROM d)""")
def date_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as printed, with faulty ones put in; judged as of 1 January 2026."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DATE_TEXT.format("date_format(o_orderdate, 'dd/MM/yyyy')")).alias("date"))
    return rows.withColumn("reasons", F.array_join(checks.date_reasons(F.col("date"), F.lit("2026-01-01").cast("date")), "|"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: least(1.0, abs(x::double) * 4)) AS p, [substring('aB 7.-Ωx ', 1 + (i % 9)::int, 1) FOR i IN range(len(embedding))] AS c FROM embeddings),
k AS (SELECT *, list_transform(list_filter(range(1, len(p) + 1), lambda i: regexp_matches(c[i], '[\\p{L}\\p{N}]')), lambda i: round(p[i] * 1000000)::bigint) AS alnum, list_transform(list_filter(range(1, len(p) + 1), lambda i: c[i] <> ' '), lambda i: round(p[i] * 1000000)::bigint) AS ink FROM e)
SELECT vec_id, round(list_min(p[5:16]), 3) AS ocr_confidence, round(list_sum(alnum)::double / len(alnum) / 1000000, 3) AS mean_confidence, round(list_sum(ink)::double / len(ink) / 1000000, 3) AS line_confidence FROM k""".replace("\\\\", "\\"))
def confidence_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings stand for the probabilities of a page's characters: the least of a value, the mean of letters and digits for the
    document and of all but white space for a line."""
    p = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.abs(x.cast("double")) * 4))
    text = F.array_join(F.transform(p, lambda x, i: F.substring(F.lit("aB 7.-Ωx "), (i % 9 + 1), F.lit(1))), "")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(4).alias("start"), F.lit(16).alias("end"), p.alias("confidence"), text.alias("text"))
    mean = lambda pattern: checks.mean_confidence(F.col("text"), F.col("confidence"), pattern)
    return checks.span_confidence(rows).select("vec_id", "ocr_confidence", mean(r"[\p{L}\p{N}]").alias("mean_confidence"), mean(r"[^\s]").alias("line_confidence"))


@query(ctes("prescriptions") + f""", {sql.lines('prescriptions')}, spans AS (SELECT doc_id, line_no, start + CASE WHEN (doc_id + line_no) % 11 = 0 THEN 1 ELSE 0 END AS start, start + length(line) AS end_, line AS text FROM lines WHERE line <> ''),
held AS (SELECT doc_id, line_no FROM lines WHERE (doc_id + line_no) % 13 = 0 AND line <> '')
SELECT s.doc_id, s.line_no FROM spans s JOIN prescriptions p USING (doc_id) WHERE end_ < start OR end_ > length(raw_text) OR substring(raw_text, (start + 1)::int, (end_ - start)::int) <> text OR EXISTS (SELECT 1 FROM held h WHERE h.doc_id = s.doc_id AND h.line_no = s.line_no)""")
def grounding_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans; every eleventh has its start moved by one, and every thirteenth line is withheld."""
    docs = corpus.prescriptions(spark, sf_dir)
    rows = lines.split_lines(docs).where("line <> ''")
    moved = F.when((F.col("doc_id") + F.col("line_no")) % 11 == 0, 1).otherwise(0)
    end = (F.col("start") + F.length("line")).cast("int").alias("end")
    spans = rows.select("doc_id", "line_no", (F.col("start") + moved).cast("int").alias("start"), end, F.col("line").alias("text"))
    held = rows.where((F.col("doc_id") + F.col("line_no")) % 13 == 0).select("doc_id", "start", end)
    return checks.ungrounded(spans, docs, held).select("doc_id", "line_no")


@query(f"""WITH {_DOCS}, {sql.lines('docs')}, {sql.reasons()} SELECT doc_id, CASE WHEN sum(CASE WHEN reason IS NULL THEN {LEGIBLE('line')} ELSE 0 END) < {P.LEGIBLE_CHARS} THEN 'unreadable' WHEN bool_or(length(line) > 5000) THEN 'failed'
  WHEN count(reason) > 0 OR count(*) FILTER (line LIKE '%�%') > 0 OR count(*) FILTER (length(line) > 2000) > 0 OR count(*) > 200 OR doc_id % 10 < 1 THEN 'low_confidence' ELSE 'ok' END AS status, count(reason) AS n_withheld FROM reasons GROUP BY doc_id""")
def document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader would say of a document is taken from its lines: odd characters (read with low probability), long lines
    (doubtful), many lines (a suspect page), very long ones (failed), and a mean probability from doc_id."""
    judged = quality.line_reasons(lines.split_lines(texts(spark, sf_dir)))
    n = lambda c: F.count(F.when(c, 1))
    rows = judged.groupBy("doc_id").agg(
        F.sum(F.when(F.col("reason").isNull(), lines.legible(F.col("line"))).otherwise(0)).alias("legible"), F.count("reason").alias("n_withheld"), n(F.col("line").contains("�")).alias("n_low_lines"),
        n(F.length("line") > 2000).alias("n_doubts"), (F.count("*") > 200).cast("int").alias("n_suspect_pages"), F.bool_or(F.length("line") > 5000).alias("failed"),
    )
    rows = rows.withColumn("mean_confidence", 0.75 + (F.col("doc_id") % 10) * 0.05)
    return checks.document_status(rows).select("doc_id", "status", "n_withheld")


# ---- scores

_SUBS = ("name", "dosage", "frequency", "duration")
_IN_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice"
#: The truth of prescriptions, as known from their rows: one in 17 lacks its dosage, one in 13 has another duration, one in 7 has
#: another spelling of the name beside it, one in 23 lacks its first medicine; one in 5 declares that it has no vital signs.
_TRUTH = f"""SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_IN_ORDER}) - 1 AS INT) AS item_no, name, CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE dosage END AS dosage, frequency,
  CASE WHEN l_orderkey % 13 = 0 THEN '99 days' ELSE duration END AS duration, l_orderkey % 7 = 0 AS respelt FROM {{}} WHERE NOT (l_orderkey % 23 = 0 AND l_linenumber = 1)"""


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, field, item_no, sub, alternatives)."""
    rows = spark.sql(_TRUTH.format("{items}"), items=corpus.prescription_items(spark, sf_dir))
    given = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    name = F.when(F.col("respelt"), F.array(F.concat(F.lit("Tab "), "name"), F.col("name"))).otherwise(F.array("name"))
    subs = [F.struct(F.lit(s).alias("sub"), (name if s == "name" else given(s)).alias("alternatives")) for s in _SUBS]
    long = rows.select("doc_id", F.lit("medications").alias("field"), "item_no", F.inline(F.array(*subs)))
    fixed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(0).alias("item_no"), F.lit("text").alias("sub"), a.alias("alternatives")) for f, a in (
        ("doctor_name", F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Dr Nobody"))).otherwise(F.array(F.concat(F.lit("Dr S"), corpus.letters(F.col("o_custkey") % 97), F.lit(" Rao"))))),
        ("date", F.when(F.col("o_orderkey") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.date_format("o_orderdate", "d/M/yyyy"), F.date_format("o_orderdate", "dd/MM/yyyy")))),
    )))))
    declared = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("vitals").alias("field"), F.lit(0).alias("item_no"), F.lit("name").alias("sub"), F.array(F.lit("BP")).alias("alternatives"))
    docs = corpus.prescriptions(spark, sf_dir).select("doc_id")
    return long.unionByName(fixed.join(docs, "doc_id", "left_semi")).unionByName(declared.join(docs, "doc_id", "left_semi"))


def _read(docs: DataFrame) -> DataFrame:
    """docs with a vital sign more in every second one."""
    return docs.withColumn("raw_text", F.when(F.col("doc_id") % 2 == 0, F.concat("raw_text", F.lit("\nPulse 80"))).otherwise(F.col("raw_text")))


def _scored(values: DataFrame) -> DataFrame:
    return values.where(F.col("field").isin("medications", "doctor_name", "date", "vitals"))


def _got(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in prescriptions, with a vital sign more in every second one."""
    return _scored(record.values(record.items(_read(corpus.prescriptions(spark, sf_dir)))))


_OUTCOMES = ctes("prescriptions") + f""", read_ AS (SELECT doc_id, raw_text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Pulse 80' ELSE '' END AS raw_text FROM prescriptions), {sql.entities('read_')},
rows_ AS ({_TRUTH.format('items')}),
truth AS (SELECT doc_id, 'medications' AS field, item_no, 'name' AS sub, CASE WHEN respelt THEN ['Tab ' || name, name] ELSE [name] END AS alts FROM rows_
  {' '.join(f"UNION ALL SELECT doc_id, 'medications', item_no, '{s}', CASE WHEN {s} IS NULL THEN [] ELSE [{s}] END FROM rows_" for s in _SUBS[1:])}
  UNION ALL SELECT o_orderkey, 'doctor_name', 0, 'text', CASE WHEN o_orderkey % 3 = 0 THEN ['Dr Nobody'] ELSE ['Dr S' || translate(CAST(o_custkey % 97 AS VARCHAR), '0123456789', 'abcdefghij') || ' Rao'] END FROM orders WHERE o_orderkey IN (SELECT doc_id FROM prescriptions)
  UNION ALL SELECT o_orderkey, 'date', 0, 'text', CASE WHEN o_orderkey % 11 = 0 THEN [] ELSE [strftime(o_orderdate, '%-d/%-m/%Y'), strftime(o_orderdate, '%d/%m/%Y')] END FROM orders WHERE o_orderkey IN (SELECT doc_id FROM prescriptions)
  UNION ALL SELECT o_orderkey, 'vitals', 0, 'name', ['BP'] FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey IN (SELECT doc_id FROM prescriptions)),
got AS (SELECT doc_id, field, item_no, sub, text, len(reasons) > 0 AS review FROM entities WHERE field IN ('medications', 'doctor_name', 'date') OR field = 'vitals' AND doc_id IN (SELECT doc_id FROM truth WHERE field = 'vitals')),
-- every alternative of a name here differs from all other names, so the n-th of a name is the n-th of its truth
gn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field, key ORDER BY item_no) AS nth FROM (SELECT *, CASE WHEN field = 'date' THEN {VALUE_KEY('text')} ELSE {NAME_KEY('text')} END AS key FROM got WHERE sub IN ('name', 'text'))),
tn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field, keys[-1] ORDER BY item_no) AS nth FROM (SELECT *, list_transform(alts, lambda a: CASE WHEN field = 'date' THEN {VALUE_KEY('a')} ELSE {NAME_KEY('a')} END) AS keys FROM truth WHERE sub IN ('name', 'text') AND len(alts) > 0)),
pairs AS (SELECT g.doc_id, g.field, g.item_no AS g, t.item_no AS t FROM gn g JOIN tn t ON g.doc_id = t.doc_id AND g.field = t.field AND list_contains(t.keys, g.key) AND g.nth = t.nth),
head_rows AS (SELECT g.doc_id, g.field, t.alts AS expected, g.text AS got, g.review, true AS same FROM pairs p JOIN gn g ON g.doc_id = p.doc_id AND g.field = p.field AND g.item_no = p.g JOIN tn t ON t.doc_id = p.doc_id AND t.field = p.field AND t.item_no = p.t
  UNION ALL SELECT doc_id, field, NULL, text, review, false FROM gn g WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = g.doc_id AND p.field = g.field AND p.g = g.item_no)
  UNION ALL SELECT doc_id, field, alts, NULL, NULL, false FROM tn t WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.doc_id = t.doc_id AND p.field = t.field AND p.t = t.item_no)),
subs AS (SELECT p.doc_id, p.field || '.' || t.sub AS field, CASE WHEN len(t.alts) > 0 THEN t.alts END AS expected, g.text AS got, g.review FROM pairs p JOIN truth t ON t.doc_id = p.doc_id AND t.field = p.field AND t.item_no = p.t AND t.sub NOT IN ('name', 'text')
  LEFT JOIN got g ON g.doc_id = p.doc_id AND g.field = p.field AND g.item_no = p.g AND g.sub = t.sub),
single AS (SELECT doc_id, field, max(expected) AS expected, max(got) AS got, max(review) AS review, bool_or(same) AS same FROM head_rows WHERE field IN ('doctor_name', 'date') GROUP BY ALL),
outcomes AS (SELECT doc_id, field, CASE WHEN same THEN 'true_positive' WHEN got IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected_value' ELSE 'wrong_value' END AS kind, expected, got, review FROM single
  UNION ALL SELECT doc_id, field, CASE WHEN same THEN 'true_positive' WHEN got IS NULL THEN 'missing' ELSE 'false_positive' END, expected, got, review FROM head_rows WHERE field NOT IN ('doctor_name', 'date')
  UNION ALL SELECT doc_id, field, CASE WHEN got IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected_value' WHEN list_contains(list_transform(expected, lambda a: {VALUE_KEY('a')}), {VALUE_KEY('got')}) THEN 'true_positive' ELSE 'wrong_value' END, expected, got, review
    FROM subs WHERE expected IS NOT NULL OR got IS NOT NULL) """


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.outcomes(_got(spark, sf_dir), _truth(spark, sf_dir))


@query(_OUTCOMES + "SELECT doc_id, field, g::int AS got_no, t::int AS true_no FROM pairs")
def one_to_one_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of prescriptions with their truths; a name may be spelt in several ways."""
    return score.match(_got(spark, sf_dir), _truth(spark, sf_dir)).where("got_no is not null and true_no is not null")


@query(_OUTCOMES + "SELECT doc_id, field, kind, array_to_string(expected, '|') AS expected, got, review AS needs_review FROM outcomes")
def field_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).withColumn("expected", F.array_join("expected", "|"))


@query(_OUTCOMES + """SELECT coalesce(field, 'overall') AS field, tp, fp, fn, round(tp / nullif(tp + fp, 0), 3) AS precision, round(tp / nullif(tp + fn, 0), 3) AS recall FROM (SELECT field, count(*) FILTER (kind = 'true_positive') AS tp,
  count(*) FILTER (kind IN ('false_positive', 'unexpected_value', 'wrong_value')) AS fp, count(*) FILTER (kind IN ('missing', 'wrong_value')) AS fn FROM outcomes GROUP BY ROLLUP (field))""")
def field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.field_scores(_outcomes(spark, sf_dir))


_PLACED = ("doctor_name", "date", "medications", "medications.dosage", "medications.frequency", "medications.duration")
_HELD = f"""held AS (SELECT DISTINCT doc_id, other, list_position({list(_PLACED)}, other) AS rank, unnest(['n' || {NAME_KEY('a')}, 'v' || {VALUE_KEY('a')}]) AS key FROM (SELECT doc_id, CASE WHEN sub IN ('name', 'text') THEN field ELSE field || '.' || sub END AS other, unnest(alts) AS a FROM truth) WHERE other IN {_PLACED}),
errors AS (SELECT row_number() OVER () AS id, *, ['n' || {NAME_KEY('got')}, 'v' || {VALUE_KEY('got')}] AS ks FROM outcomes WHERE kind <> 'true_positive'),
placed AS (SELECT e.*, h.other AS placement FROM errors e LEFT JOIN (SELECT id, arg_min(other, rank) AS other FROM errors JOIN held ON held.doc_id = errors.doc_id AND list_contains(ks, key) AND other <> field WHERE got IS NOT NULL GROUP BY id) h USING (id)) """


@query(_OUTCOMES + f", {_HELD} SELECT field, kind, count(*) AS n, count(placement) AS n_placed, count(*) FILTER (got IS NOT NULL AND NOT review) AS n_unflagged FROM placed GROUP BY ALL")
def placement_and_unflagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by field: how many values are the truth of another field, and how many nothing marks for review."""
    errors = _outcomes(spark, sf_dir).where(F.col("kind").isin(*score.ERRORS))
    placed = score.placements(errors, _truth(spark, sf_dir), _PLACED)
    unflagged = F.count(F.when(F.col("got").isNotNull() & ~F.col("needs_review"), 1))
    return placed.groupBy("field", "kind").agg(F.count("*").alias("n"), F.count("placement").alias("n_placed"), unflagged.alias("n_unflagged"))


@query(_OUTCOMES + f""", {_HELD} SELECT count(*) FILTER (kind IN ('false_positive', 'unexpected_value')) AS false_positives, count(*) FILTER (kind = 'missing') AS false_negatives, count(*) FILTER (kind = 'wrong_value') AS wrong_values,
  count(*) FILTER (got IS NOT NULL AND NOT review) AS unflagged_errors, count(placement) AS placement_errors, (SELECT count(*) FROM entities e JOIN prescriptions p USING (doc_id) WHERE field <> 'medication_mentions' AND substring(p.raw_text, start + 1, end_ - start) <> e.text) AS grounding_failures,
  (SELECT round(avg((kind = 'prescription')::int), 3) FROM classified) AS document_type_accuracy FROM placed""")
def score_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven counters over prescriptions; values of the text that was read are looked for in the text without its last line."""
    docs = corpus.prescriptions(spark, sf_dir)
    read = _read(docs)
    values = stored.once(record.values(record.items(read)))  # outcomes and grounding start from it
    truth = _truth(spark, sf_dir)
    found = score.outcomes(_scored(values), truth)
    placed = score.placements(found.where(F.col("kind").isin(*score.ERRORS)), truth, _PLACED)
    every = values.where("field <> 'medication_mentions'")
    kinds = classify.classify(read).select(F.lit("prescription").alias("expected"), F.col("kind").alias("got"))
    return score.counters(placed, checks.ungrounded(every, docs), kinds)


@query(f"""WITH {_DOCS}, {sql.lines('docs')}, {sql.reasons()}, gate AS (SELECT doc_id, (count(reason) = 0)::int AS good FROM reasons GROUP BY doc_id)
SELECT count(*) FILTER (good = 1 AND quality = 1) AS tp, count(*) FILTER (good = 1 AND quality = 0) AS fp, count(*) FILTER (good = 0 AND quality = 1) AS fn,
  round(count(*) FILTER (good = 1 AND quality = 1) / nullif(count(*) FILTER (good = 1), 0), 3) AS precision, round(count(*) FILTER (good = 1 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0), 3) AS recall
FROM gate JOIN labels USING (doc_id)""")
def label_micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the absence of withheld lines stands for the label of quality."""
    gate = quality.line_reasons(lines.split_lines(texts(spark, sf_dir))).groupBy("doc_id").agg((F.count("reason") == 0).alias("good"))
    rows = gate.join(table(spark, sf_dir, "labels"), "doc_id")
    n = lambda c: F.count(F.when(c, 1))
    sums = rows.agg(n(F.col("good") & (F.col("quality") == 1)).alias("tp"), n(F.col("good") & (F.col("quality") == 0)).alias("fp"), n(~F.col("good") & (F.col("quality") == 1)).alias("fn"))
    rate = lambda o: F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col(o)), 3)
    return sums.select("tp", "fp", "fn", rate("fp").alias("precision"), rate("fn").alias("recall"))


_READ = "replace(replace(raw_text, '7MG', '1MG'), 'TAB. RED', 'TAB. RFD')"


@query(ctes("prescriptions") + f""", want AS (SELECT DISTINCT l_orderkey AS doc_id, category, alts FROM (SELECT l_orderkey, 'medicine_name' AS category, CASE WHEN l_orderkey % 7 = 0 THEN ['Tab ' || name, name] ELSE [name] END AS alts FROM items UNION ALL SELECT l_orderkey, 'dosage', [dosage] FROM items
  UNION ALL SELECT l_orderkey, 'duration', [duration] FROM items)),
marked AS (SELECT doc_id, {sql.token_places('raw_text')} AS a, {sql.token_places(_READ)} AS b FROM prescriptions),
tried AS (SELECT doc_id, category, alts, a, b, i, alts[i] AS token, len(regexp_extract_all(a, {sql.token_pattern('alts[i]')})) AS n FROM want JOIN marked USING (doc_id), unnest(range(1, len(alts) + 1)) AS r(i)),
best AS (SELECT DISTINCT doc_id, category, token, n, b FROM (SELECT * FROM tried QUALIFY row_number() OVER (PARTITION BY doc_id, category, alts ORDER BY CASE WHEN n > 0 THEN length(token) ELSE 0 END DESC, i) = 1))
SELECT category, sum(greatest(1, n))::bigint AS expected, sum(least(greatest(1, n), len(regexp_extract_all(b, {sql.token_pattern('token')}))))::bigint AS found FROM best GROUP BY category""")
def critical_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prescriptions against a copy of them with misreadings."""
    items = corpus.prescription_items(spark, sf_dir).withColumnRenamed("l_orderkey", "doc_id")
    names = F.when(F.col("doc_id") % 7 == 0, F.array(F.concat(F.lit("Tab "), "name"), F.col("name"))).otherwise(F.array("name"))
    each = F.array(*(F.struct(F.lit(c).alias("category"), a.alias("alternatives")) for c, a in (("medicine_name", names), ("dosage", F.array("dosage")), ("duration", F.array("duration")))))
    docs = corpus.prescriptions(spark, sf_dir).select("doc_id", F.col("raw_text").alias("true_text"), F.expr(_READ).alias("read_text"))
    return score.critical_tokens(items.select("doc_id", F.inline(each)), docs)


_HYP = "replace(replace(c_name, '0', 'O'), 'Customer', 'Customr ')"


@query(f"SELECT c_custkey, round(levenshtein({SQUEEZED(_HYP)}, {SQUEEZED('c_name')}) / length({SQUEEZED('c_name')}), 3) AS cer FROM customer")
def character_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").withColumn("hyp", F.expr(_HYP))
    return rows.select("c_custkey", score.character_error_rate(F.col("hyp"), F.col("c_name")).alias("cer"))


#: Names and, in one of three, another name that an output could come from.
_SOURCES = "SELECT p_name AS source FROM {0} UNION SELECT substring(p_name, 3) || 'x' AS source FROM {0} WHERE p_partkey % 3 = 0"


@query(f"""WITH s AS ({_SOURCES.format('part')}), o AS (SELECT source AS own, substring(replace(source, 'e', 'a'), 2) || 's' AS output FROM s),
d AS (SELECT own, source, levenshtein(output, source) / length(source) AS cer FROM o, s)
SELECT own, source AS nearest, source = own AS distinct_ FROM d QUALIFY row_number() OVER (PARTITION BY own ORDER BY cer, source) = 1""")
def nearest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is each output nearer to its own source than to all others?"""
    s = spark.sql(_SOURCES.format("{p}"), p=table(spark, sf_dir, "part"))
    o = s.select(F.col("source").alias("own"), F.concat(F.expr("substring(replace(source, 'e', 'a'), 2)"), F.lit("s")).alias("output"))
    return score.nearest_sources(o, s).select("own", "nearest", (F.col("nearest") == F.col("own")).alias("distinct_"))


_INVENTED = "Tab. Inventol 500 mg BD"
#: Lines visible on the page: what was written, or less, where the writing is dense.
_VISIBLE = "CASE WHEN doc_id % 4 = 0 THEN lines_read WHEN doc_id % 4 = 1 THEN lines_read - 1 ELSE CAST(lines_read / 4 AS INT) END"


@query(ctes("prescriptions") + f""", spoilt AS (SELECT doc_id, array_to_string(ls[1:len(ls) // 2] || ['{_INVENTED}'] || ls[len(ls) // 2 + 1:], chr(10)) AS raw_text FROM (SELECT doc_id, string_split(raw_text, chr(10)) AS ls FROM prescriptions)),
{sql.lines('spoilt')}, {sql.medicines('lines', 'false')}, n AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN lines_read WHEN doc_id % 4 = 1 THEN lines_read - 1 ELSE floor(lines_read / 4)::int END AS visible FROM (SELECT doc_id, count(*) AS lines_read FROM lines WHERE trim(line) <> '' GROUP BY doc_id))
SELECT n.doc_id, n.lines_read, CASE WHEN visible = 0 THEN 'withhold: nothing visible' WHEN lines_read <= visible THEN 'ok' WHEN lines_read >= 2 * greatest(1, visible) + 6 THEN 'withhold: more than the page holds' WHEN lines_read >= greatest(1.5 * visible + 4, visible + 6) THEN 'doubt: text may be invented'
  ELSE 'doubt: extra text or dense layout' END AS verdict, count(m.name) FILTER (m.name = 'Inventol') AS n_invented FROM n LEFT JOIN medicines m USING (doc_id) GROUP BY ALL""")
def invented_line_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invented medicine in the middle of each prescription: is it read, and does the count of lines give it away?"""
    ls = F.split("raw_text", "\n")
    half = F.floor(F.size(ls) / 2).cast("int")
    spoilt = corpus.prescriptions(spark, sf_dir).select("doc_id", F.array_join(F.concat(F.slice(ls, 1, half), F.array(F.lit(_INVENTED)), F.slice(ls, half + 1, F.size(ls))), "\n").alias("raw_text"))
    rows = lines.split_lines(spoilt)
    n = spoilt.select("doc_id", F.size(F.filter(ls, lambda x: F.trim(x) != "")).cast("long").alias("lines_read"))
    seen = extract.prescribed_medicines(rows).where("name = 'Inventol'").groupBy("doc_id").agg(F.count("*").alias("n_invented"))
    joined = n.join(seen, "doc_id", "left").withColumn("visible", F.expr(_VISIBLE.replace("CAST(lines_read / 4 AS INT)", "CAST(floor(lines_read / 4) AS INT)")))
    return joined.select("doc_id", "lines_read", quality.line_count_verdict(F.col("lines_read"), F.col("visible")).alias("verdict"), F.coalesce("n_invented", F.lit(0)).alias("n_invented"))


@query("""SELECT p_brand AS engine, p_type AS "group", sum(expected)::bigint AS expected, sum(found)::bigint AS found, round(sum(found) / sum(expected), 3) AS accuracy FROM (SELECT p_brand, p_type, p_size AS expected, p_size - p_partkey % (p_size + 1) AS found FROM part) GROUP BY ROLLUP (p_brand, p_type) HAVING p_brand IS NOT NULL""")
def engine_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for documents: their brand for the reader, their type for the group, their size for the tokens expected."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("engine"), F.col("p_type").alias("group"), F.col("p_size").alias("expected"), F.expr("p_size - p_partkey % (p_size + 1)").alias("found"))
    return score.group_accuracy(rows)


_ANSWER_JSON = """'{"kind": "p_type", "values": [{"text": "' || upper(p_name) || '"}, ["' || p_brand || '", 5, null]], "n": ' || p_size || '}'"""


@query(f"""WITH t AS (SELECT p_partkey AS doc_id, '  ' || replace(p_name, ' ', '  ') || ' ' || p_size AS raw_text, replace({_ANSWER_JSON}, 'p_type', p_type) AS j FROM part)
SELECT DISTINCT doc_id, value FROM (SELECT doc_id, raw_text, unnest([json_extract_string(j, '$.kind'), json_extract_string(j, '$.values[0].text'), json_extract_string(j, '$.values[1][0]')]) AS value FROM t) WHERE NOT contains({SQUEEZED('raw_text')}, {SQUEEZED('value')})""")
def ungrounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested answers about parts: which of their strings aren't in the part's text?"""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.expr("'  ' || replace(p_name, ' ', '  ') || ' ' || p_size").alias("raw_text"), F.expr(f"replace({_ANSWER_JSON}, 'p_type', p_type)").alias("json"))
    return score.ungrounded_strings(rows)


# ---- files and privacy


@query("""WITH names AS (SELECT DISTINCT 'order_' || (o_orderkey % 40) || '_page_' || (o_orderkey % 3) AS name FROM orders), stems AS (SELECT DISTINCT unnest(['order_' || (o_custkey % 30), 'order_' || (o_custkey % 20) || '_page', 'order_']) AS stem FROM orders)
SELECT name, arg_max(stem, length(stem)) AS stem FROM names LEFT JOIN stems ON name = stem OR starts_with(name, stem || '_') GROUP BY name""")
def longest_prefix_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    names = orders.select(F.expr("concat('order_', o_orderkey % 40, '_page_', o_orderkey % 3)").alias("name"))
    stems = orders.select(F.explode(F.expr("array(concat('order_', o_custkey % 30), concat('order_', o_custkey % 20, '_page'), 'order_')")).alias("stem"))
    return readers.longest_stem(names, stems)


@query("""WITH listed AS (SELECT 'doc' || doc_id AS name, sha256(CASE WHEN doc_id % 31 = 0 THEN 'x' ELSE coalesce(text, '') END) AS digest FROM documents WHERE doc_id % 29 <> 0), files AS (SELECT 'doc' || doc_id AS name, sha256(coalesce(text, '')) AS found FROM documents WHERE doc_id % 37 <> 0)
SELECT name, problem FROM (SELECT name, CASE WHEN found IS NULL THEN 'missing' WHEN digest IS NULL THEN 'added' WHEN digest <> found THEN 'changed' END AS problem FROM listed FULL OUTER JOIN files USING (name)) WHERE problem IS NOT NULL""")
def manifest_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    listed = docs.where("doc_id % 29 <> 0").select("name", F.sha2(F.when(F.col("doc_id") % 31 == 0, "x").otherwise(F.col("text")), 256).alias("digest"))
    return readers.manifest_problems(listed, docs.where("doc_id % 37 <> 0").select("name", F.col("text").cast("binary").alias("content")))


_ALL_KEYS = readers.REQUIRED + readers.OPTIONAL


@query(f"""WITH t AS (SELECT event_id, '{{' || '"' || CASE event_id % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'patient_name' ELSE 'weather' END || '": 1, ' || substring(props, 2) AS j FROM events), k AS (SELECT event_id, json_keys(j) AS ks FROM t)
SELECT event_id, len(list_filter({list(readers.REQUIRED)}, lambda x: NOT list_contains(ks, x))) AS n_missing, array_to_string(list_sort(list_filter(ks, lambda x: NOT list_contains({list(_ALL_KEYS)}, x))), '|') AS unknown FROM k""")
def truth_key_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("event_id") % 3 == 0, "date").when(F.col("event_id") % 3 == 1, "patient_name").otherwise("weather")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"'), key, F.lit('": 1, '), F.expr("substring(props, 2)")).alias("json"))
    return readers.truth_keys(rows).select("event_id", F.size("missing").cast("long").alias("n_missing"), F.array_join(F.array_sort("unknown"), "|").alias("unknown"))


#: Truth files out of event keys, with every sort of value.
_TRUTH_JSON = """'{"document_type": "' || CASE event_id % 4 WHEN 0 THEN 'letter' ELSE 'prescription' END || '", "patient_name": ' || CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"Asha"' ELSE '["Asha", "A. Rao"]' END || ', "doctor_name": null, "date": "1/2/2020", "medications": [{"name": ["Dolo", "Dolo ' || event_id || '"], "dosage": null, "frequency": "BD"' || CASE event_id % 5 WHEN 0 THEN '' ELSE ', "duration": "' || event_id || ' days"' END || '}], "tests": ["CBC", ["LFT", "liver"]], "vitals": [{"name": "BP"}], "diagnoses": [], "symptoms": [], "allergies": [], "test_results": []}'"""
_SUB = ("name", "dosage", "frequency", "duration")


@query(f"""WITH t AS (SELECT event_id AS doc_id, {_TRUTH_JSON} AS j FROM events),
v AS (SELECT doc_id, unnest([{{'field': 'patient_name', 'item_no': 0, 'sub': 'text', 'v': j -> '$.patient_name'}}, {{'field': 'doctor_name', 'item_no': 0, 'sub': 'text', 'v': j -> '$.doctor_name'}}, {{'field': 'date', 'item_no': 0, 'sub': 'text', 'v': j -> '$.date'}},
  {{'field': 'tests', 'item_no': 0, 'sub': 'text', 'v': j -> '$.tests[0]'}}, {{'field': 'tests', 'item_no': 1, 'sub': 'text', 'v': j -> '$.tests[1]'}}, {{'field': 'vitals', 'item_no': 0, 'sub': 'name', 'v': j -> '$.vitals[0].name'}},
  {', '.join(f"{{{{'field': 'medications', 'item_no': 0, 'sub': '{s}', 'v': j -> '$.medications[0].{s}'}}}}".replace('{{', '{').replace('}}', '}') for s in _SUB)}], recursive := true) FROM t)
SELECT doc_id, field, item_no, sub, CASE WHEN json_type(v) = 'NULL' THEN '' WHEN json_type(v) = 'ARRAY' THEN array_to_string(from_json(v, '["VARCHAR"]'), '|') ELSE v ->> '$' END AS alternatives FROM v WHERE v IS NOT NULL""")
def truth_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth files made of events: a value may be null, a text or a list of accepted texts."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.expr(_TRUTH_JSON).alias("json"))
    return readers.truth_values(rows).select("doc_id", "field", "item_no", "sub", F.array_join("alternatives", "|").alias("alternatives"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'medications' ELSE '' END AS items, event_id % 4 = 0 AS bad_type FROM events""")
def truth_items_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth truth file lacks a key of a record, every fourth has a type that there is none of."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_TRUTH_JSON).alias("json"))
    return readers.truth_keys(rows).select("event_id", F.array_join("items", "|").alias("items"), "bad_type")


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'pdf' ELSE 'text' END AS kind, CASE WHEN octet_length(encode(h)) > 3000 THEN 'file_too_large' WHEN h = '' THEN 'empty_file' WHEN page_id % 4 = 0 THEN 'needs a PDF reader' END AS error
FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '%PDF-1.4' || html WHEN page_id % 7 = 0 THEN '' ELSE coalesce(html, '') END AS h FROM pages)""")
def load_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: what they are, and which are refused, with a limit that some are over."""
    content = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("%PDF-1.4"), "html")).when(F.col("page_id") % 7 == 0, "").otherwise(F.coalesce("html", F.lit("")))
    rows = table(spark, sf_dir, "pages").select("page_id", content.cast("binary").alias("content"))
    return readers.gate(rows, most=3000).select("page_id", "kind", "error")


@query("""SELECT l_orderkey AS doc_id, l_linenumber AS page, sum(greatest(0, least(x1, 100) - greatest(x0, 0)) * greatest(0, least(y1, 150) - greatest(y0, 0))) / 15000 AS coverage FROM (
  SELECT *, (l_partkey % 130 - 20)::double AS x0, (l_partkey % 130 + l_quantity)::double AS x1, (l_suppkey % 170 - 10)::double AS y0, (l_suppkey % 170 + l_quantity * 2)::double AS y1 FROM lineitem) GROUP BY ALL""")
def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as boxes of images, some of them partly off the page."""
    box = {"x0": "l_partkey % 130 - 20", "x1": "l_partkey % 130 + l_quantity", "y0": "l_suppkey % 170 - 10", "y1": "l_suppkey % 170 + l_quantity * 2"}
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(100.0).alias("width"), F.lit(150.0).alias("height"), *(F.expr(f"CAST({e} AS DOUBLE)").alias(c) for c, e in box.items()))
    return readers.image_coverage(rows)


_MARK = "'| ' || coalesce(CAST(field AS VARCHAR), '-') || ' | ' || tp || ' | ' || fp || ' | ' || fn || ' |'"


@query(_OUTCOMES + """SELECT doc_id, '| ' || doc_id || ' | prescription | ok | ' || count(*) FILTER (kind = 'true_positive') || ' | ' || count(*) FILTER (kind IN ('false_positive', 'unexpected_value', 'wrong_value')) || ' | ' || count(*) FILTER (kind IN ('missing', 'wrong_value')) || ' |' AS markdown FROM outcomes GROUP BY doc_id""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's line for each prescription."""
    n = lambda *kinds: F.count(F.when(F.col("kind").isin(*kinds), 1))
    per = _outcomes(spark, sf_dir).groupBy("doc_id").agg(n("true_positive").alias("tp"), n("false_positive", "unexpected_value", "wrong_value").alias("fp"), n("missing", "wrong_value").alias("fn"))
    return readers.markdown_documents(per.withColumns({"document_type": F.lit("prescription"), "status": F.lit("ok")}))


#: Paths out of part and supplier keys: folders, names and suffixes in all combinations.
_FOLDERS = ("eval/dev", "docs", "private", "models", "eval/real_world", "eval/real_world_2/deep", "a/.cache", "eval/reports/model_selection_real_world", "eval/aggregates", "eval/reports", "src", "eval/heldout", "tmp/x", "prescription-data")
_NAMES = ("a.png", "scan.PDF", ".env", ".env.example", "w.safetensors", "manifest.json", "page1.txt", "README.md", "truth_template.json", "summary.json", "real_world_baseline.json", "SUMMARY.md", "b.tar", "photo.jpeg", ".png", ".env.local")
_PATHS = f"SELECT DISTINCT f || '/' || n AS path FROM (SELECT CASE p_partkey % {len(_FOLDERS)} {' '.join(f'WHEN {i} THEN {x!r}' for i, x in enumerate(_FOLDERS))} END AS f, CASE CAST(floor(p_partkey / {len(_FOLDERS)}) AS INT) % {len(_NAMES)} {' '.join(f'WHEN {i} THEN {x!r}' for i, x in enumerate(_NAMES))} END AS n FROM {{}}) AS t"


@query(rf"""WITH p AS ({_PATHS.format('part')}), q AS (SELECT path, string_split(path, '/') AS parts, parts[-1] AS name, CASE WHEN regexp_matches(name, '^[.][^.]*$') THEN '' ELSE lower(regexp_extract(name, '[.]([^.]+)$', 1)) END AS suffix,
  list_position(list_transform(parts, lambda x: starts_with(x, 'real_world')), true) AS real FROM p)
SELECT path, CASE WHEN list_has_any(parts, {list(privacy.PRIVATE_PARTS)}) THEN 'private folder' WHEN name = '.env' OR (starts_with(name, '.env.') AND name <> '.env.example') THEN 'environment file' WHEN suffix IN {privacy.WEIGHTS} THEN 'weights or archive'
  WHEN path = '{privacy.BASELINE}' THEN NULL WHEN real > 0 AND NOT (len(parts) = real + 1 AND name IN {privacy.REAL_METADATA}) THEN 'real source or annotation' WHEN starts_with(path, '{privacy.REPORTS}') AND path <> '{privacy.AGGREGATE}' THEN 'report of single real documents'
  WHEN path = '{privacy.SUMMARY}' THEN 'combined report' WHEN suffix IN {privacy.MEDIA} AND NOT ({' OR '.join(f"starts_with(path, '{f}')" for f in privacy.FIXTURES)}) THEN 'media outside fixtures' END AS problem FROM q""")
def privacy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PATHS.format("{p}"), p=table(spark, sf_dir, "part")).withColumn("problem", privacy.path_problem(F.col("path")))


_CONTENT = """CASE event_id % 5 WHEN 0 THEN 'HF_TOKEN=' || event_id WHEN 1 THEN '# x' || chr(10) || ' export HF_TOKEN = ' WHEN 2 THEN 'ghp_' || repeat('a', 30 + CAST(event_id % 9 AS INT)) WHEN 3 THEN '{"a": {"b": [' || event_id || ']}}' ELSE '{"a": {"b": ' || event_id || '}}' END"""
_FILE = f"CASE CAST(floor(event_id / 5) AS INT) % 3 WHEN 0 THEN 'x/.env.example' WHEN 1 THEN '{privacy.AGGREGATE}' ELSE 'notes.txt' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 'secret' WHEN path = '{privacy.AGGREGATE}' AND event_id % 5 <> 4 THEN 'aggregate with text' WHEN path = 'x/.env.example' AND event_id % 5 = 0 THEN 'template with a token' END AS problem FROM (SELECT event_id, {_FILE} AS path FROM events)""")
def content_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of settings, aggregates and notes, with a token, a secret, a list or a nested number in turn."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_FILE).alias("path"), F.expr(_CONTENT).alias("text"))
    return rows.select("event_id", privacy.content_problem(F.col("path"), F.col("text")).alias("problem"))


@query(f"SELECT doc_id, token FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ghp' ELSE 'hf' END AS token, text || CASE WHEN doc_id % 11 = 0 THEN ' ' || CASE doc_id % 3 WHEN 0 THEN 'ghp_' ELSE 'hf_' END || md5(CAST(doc_id AS VARCHAR)) ELSE '' END AS t FROM documents) WHERE regexp_matches(t, '{P.SECRET}')")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every eleventh of which has a credential added."""
    kind = F.when(F.col("doc_id") % 3 == 0, "ghp").otherwise("hf")
    more = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit(" "), kind, F.lit("_"), F.md5(F.col("doc_id").cast("string")))).otherwise("")
    return table(spark, sf_dir, "documents").where(privacy.has_secret(F.concat("text", more))).select("doc_id", kind.alias("token"))


_AGGREGATES = """CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN regexp_replace(props, '[}]$', ', "note": "seen"}') WHEN 2 THEN '{"a": {"raw_text": 1, "b": ' || props || '}}' WHEN 3 THEN '{"a": {"b": {"c": ' || event_id || '}}, "d": null, "e": true}'
 WHEN 4 THEN '{"a": [1, 2]}' WHEN 5 THEN '{"a: [b]": -1.5e3}' WHEN 6 THEN '{"a": ' ELSE '[' || event_id || ']' END"""


@query(f"""WITH t AS (SELECT event_id, {_AGGREGATES} AS j FROM events), n AS (SELECT event_id, bool_or(e.type IN ('VARCHAR', 'ARRAY') OR coalesce(e.key IN {privacy.RAW_KEYS}, false)) AS bad FROM t, json_tree(CASE WHEN json_valid(j) THEN j ELSE '[]' END) AS e GROUP BY event_id)
SELECT event_id, json_valid(j) AND NOT bad AS numbers FROM t JOIN n USING (event_id)""")
def numeric_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as aggregates, nested or not; some hold a text, a list, a key that stands for raw text, or aren't JSON."""
    return table(spark, sf_dir, "events").select("event_id", privacy.numbers_only(F.expr(_AGGREGATES)).alias("numbers"))


# ---- recognisers and differences

#: A lexicon of one, two and three words.
_LEXICON = "SELECT p_name AS word FROM {0} UNION SELECT p_name || '  1MG' FROM {0} UNION SELECT split_part(p_name, ' ', 1) FROM {0} WHERE p_partkey % 5 = 0"
_SPAN_SQL = lambda source, lexicon: f"""lexicon AS (SELECT DISTINCT lower(trim(regexp_replace(word, '\\s+', ' ', 'g'))) AS word FROM ({lexicon})), sized AS (SELECT word, len(regexp_extract_all(word, '[\\p{{L}}\\p{{N}}]+')) AS k FROM lexicon),
pieces AS (SELECT doc_id, line_no, start, line, string_split(regexp_replace(line, '([\\p{{L}}\\p{{N}}]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS ps FROM {source}),
spans AS (SELECT doc_id, line_no, line, word, gram, (start + at_)::int AS start, (start + at_ + length(gram))::int AS end_ FROM (SELECT doc_id, line_no, start, line, k, array_to_string(ps[i : i + 2 * k - 2], '') AS gram, coalesce(list_sum(list_transform(ps[1:i - 1], lambda x: length(x))), 0) AS at_
  FROM pieces, (SELECT DISTINCT k FROM sized), unnest(range(2, len(ps) + 1, 2)) AS r(i) WHERE i + 2 * k - 2 <= len(ps)) g JOIN sized s ON s.k = g.k AND s.word = lower(regexp_replace(gram, '\\s+', ' ', 'g')))""".replace("\\\\", "\\")  # noqa: E731


@query(ctes("prescriptions") + f""", {sql.lines('prescriptions')}, {_SPAN_SQL('lines', _LEXICON.format('part'))} SELECT doc_id, line_no, start, end_ AS "end", gram AS text FROM spans""")
def lexicon_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names of one to three words found by lexicon, in place of a neural recogniser: every occurrence."""
    rows = lines.split_lines(corpus.prescriptions(spark, sf_dir))
    words = spark.sql(_LEXICON.format("{p}"), p=table(spark, sf_dir, "part"))
    found = plugins.from_lexicon(rows.withColumn("at", F.col("start")), words, "drug", ("at", "line"))
    return found.select("doc_id", "line_no", "start", "end", F.expr("substring(line, start - at + 1, end - start)").alias("text"))


#: A prescription fits in one chunk.
_CHUNKS = "cut AS (SELECT doc_id, 0 AS line_no, 0 AS start, raw_text AS line FROM prescriptions)"
_SCORED = "((length(word) * 7) % 10) / 10.0"


@query(ctes("prescriptions") + f""", {_CHUNKS}, {_SPAN_SQL('cut', _LEXICON.format('part'))},
scored AS (SELECT DISTINCT doc_id, start, end_, ({_SCORED.replace('word', 'gram')})::double AS score FROM spans),
sorted AS (SELECT doc_id, list([{{'start': start, 'end_': end_, 'score': score}}] ORDER BY score DESC, start - end_, start) AS ss FROM scored GROUP BY doc_id),
kept AS (SELECT doc_id, unnest(list_reduce(ss, lambda a, x: CASE WHEN len(list_filter(a, lambda k: k.start < x[1].end_ AND x[1].start < k.end_)) > 0 THEN a ELSE list_concat(a, x) END)) AS s FROM sorted)
SELECT k.doc_id, (s.start - length(replace(substring(raw_text, 1, s.start), chr(10), '')))::int AS line_no, s.start AS start, s.end_ AS "end", s.score AS score FROM kept k JOIN prescriptions p USING (doc_id)""")
def flat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product names of one to three words, which overlap, with a score by their length: the best ones that don't."""
    words = spark.sql(_LEXICON.format("{p}"), p=table(spark, sf_dir, "part"))

    def find(parts: DataFrame) -> DataFrame:
        return plugins.from_lexicon(parts, words, "drug").withColumn("score", F.expr(_SCORED.replace("length(word)", "(end - start)")).cast("double"))

    return plugins.by_chunks(corpus.prescriptions(spark, sf_dir), find).select("doc_id", "line_no", "start", "end", "score")


_TERMS = "SELECT 'penicillin' AS word UNION ALL SELECT 'lipid profile' UNION ALL SELECT 'omez' UNION ALL SELECT 'montek' UNION ALL SELECT 'asthma' UNION ALL SELECT 'complete blood count' UNION ALL SELECT 'chest pain'"


@query(ctes("notes") + f""", {sql.lines('notes')}, {_SPAN_SQL('lines', _TERMS)} SELECT s.doc_id, s.line_no, s.word FROM spans s JOIN lines l USING (doc_id, line_no) WHERE s.start - l.start >= 12""")
def residual_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon spans that don't begin within the first twelve characters of their line, which count as claimed."""
    rows = lines.split_lines(corpus.notes(spark, sf_dir))
    claimed = rows.select("doc_id", "line_no", "start", (F.col("start") + 12).alias("end"))
    left = plugins.outside(plugins.from_lexicon(rows.withColumn("at", F.col("start")), spark.sql(_TERMS), "test", ("at", "line")), claimed)
    return left.select("doc_id", "line_no", F.lower(F.expr("substring(line, start - at + 1, end - start)")).alias("word"))


@query()
def recognised_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of notes with the spans of lexicons for medicines, tests, diseases and symptoms; tests hold it against examples."""
    docs = corpus.notes(spark, sf_dir)
    rows = lines.split_lines(docs)
    terms = {"drug": ("penicillin", "dolo", "calpol", "insulin", "vitamin d"), "test": ("tsh", "lipid profile", "sgpt", "alt", "hb"), "disease": ("asthma", "gout", "t2dm", "htn"), "symptom": ("fever", "headache", "chest pain")}
    spans = None
    for kind, words in terms.items():
        found = plugins.from_lexicon(rows, spark.createDataFrame([(w,) for w in words], "word string"), kind)
        spans = found if spans is None else spans.unionByName(found)
    return record.values(record.items(docs, spans)).select("doc_id", "field", "item_no", "sub", "text", "start", "end", "method", F.array_join("reasons", "|").alias("reasons"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.when(F.col("doc_id") % 5 == 0, F.concat("raw_text", F.lit("\nwholly unrelated words that were never written"))).otherwise(F.expr(_READ))
    return corpus.prescriptions(ready(spark), sf_dir).select("doc_id", F.col("raw_text").alias("true_text"), read.alias("read_text"))


@query()
def unsupported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.unsupported_lines(_pairs(spark, sf_dir))


@query()
def word_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.substitutions(_pairs(spark, sf_dir))
