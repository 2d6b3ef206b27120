"""Benchmark decontamination by templates, in DataFrame functions only.

Numbers, runs of capitalised words, and units after a number become typed placeholders, so that a question asked again with
other parameters has the same template. At the head of a text or sentence, and after a number or quote, a capitalised word
counts as a name too, unless it is one of the words that sentences begin with (STARTERS). Windows of template tokens are
hash-joined to those of the benchmark; where the item has placeholders, the values that fill them in the document must be
consistent with the item's: one value for each value of the item.

Each text is read in two views. In the first, names are placeholders, told by their capitals; in the second, in lower case, only
numbers and units are, so that an item is found in a copy in small letters or in capitals as well. What the first view can't
tell is a limit: a word of STARTERS that is a name, a name that stands first in a sentence and is not one of a known kind, and
names in capitals are words of the template, and such an item asked again with other names is found by its other windows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import cut, written
from doclens.operators.lines import staged

#: Tokens of a template window; an item with fewer is one window.
WINDOW = 8
#: An item is found in a document that holds this share of its windows in one alignment.
SHARE = 0.3
#: Benchmark windows, and bytes of its texts, that are broadcast; more are joined by a shuffle.
BROADCAST_MOST, BROADCAST_BYTES = 500_000, 64 << 20
#: Rows with an alignment whose keys are broadcast to fetch their texts.
FOUND_MOST = 1_000_000
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
#: Words that begin sentences and are no names, in four languages.
STARTERS = (
    "The|This|That|These|Those|There|They|Their|What|Which|Who|Whose|When|Where|Why|How|If|In|On|At|By|For|From|To|Of|With|And|But|Or|So|As|An|It|Its|He|She|We|You|His|Her|Our|Your|My|Is|Are|Was|Were|Do|Does|Did|"
    "Can|Could|Will|Would|Should|Has|Have|Had|Each|Every|Some|Many|Most|All|Both|One|Two|After|Before|During|Then|Now|Find|Given|Let|Suppose|Since|While|Because|Not|No|Yes|"
    "Le|La|Les|Un|Une|Des|Du|De|Ce|Cette|Ces|Il|Elle|Ils|Elles|On|Nous|Vous|Et|Ou|Mais|Dans|Sur|Pour|Par|Avec|Si|Quand|Que|Qui|Quel|Quelle|Combien|"
    "Der|Die|Das|Ein|Eine|Den|Dem|Es|Er|Sie|Wir|Ihr|Und|Oder|Aber|Im|Am|Auf|Mit|Von|Zu|Wenn|Wie|Was|Wer|Wo|Wann|Warum|Welche|"
    "El|Los|Las|Una|Unos|Unas|Del|Al|En|Con|Por|Para|Y|O|Pero|Ella|Ellos|Cuando|Como|Quien|Cual|Cuanto"
)
STARTER = rf"(^|[.!?:\x22\x01]\s*)((?:{STARTERS})[^\p{{L}}])"
NAME = r"(^\s*|[.!?:;,\x22\x01]\s*|\p{Ll} )(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"
UNITS = "%|percent|kg|km|cm|mm|ml|mg|lbs|lb|oz|miles|mile|meters|meter|metres|metre|feet|foot|inches|inch|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|dollars|dollar|cents|cent|euros|euro|pounds|pound|liters|liter|litres|litre|gallons|gallon|degrees|degree"
UNIT = rf"(\x01 *)({UNITS})([^\p{{L}}\p{{N}}]|$)"
BREAK = r"[^\p{L}\p{N}\x01-\x03]+"


VIEWS = (0, 1)


def _joined(first: Column, then: Column, width: int) -> Column:
    """Hashes of what begins with `width` places of one array of hashes and goes on in another."""
    of = lambda s: F.transform(F.slice(s["then"], width + 1, F.greatest(F.size(s["then"]), F.lit(0))), lambda x, i: F.xxhash64(F.get(s["first"], i), x))
    return F.get(F.transform(F.array(F.struct(first.alias("first"), then.alias("then"))), of), F.lit(0))  # a lambda's argument is computed once


def _windows(hashes: Column, width: int) -> Column:
    """The hash of each window of tokens: that of its halves' hashes. A text with fewer tokens has none."""
    if width == 1:
        return hashes
    most = (width + 1) // 2
    if 2 * most > width:
        return _joined(_windows(hashes, most), _windows(hashes, width - most), most)
    return F.get(F.transform(F.array(_windows(hashes, most)), lambda v: _joined(v, v, most)), F.lit(0))


def _marked(text: Column) -> tuple[Column, Column]:
    """A text without control marks, and with its numbers marked."""
    known = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(known.rlike("[\x01-\x04]"), F.translate(known, "\x01\x02\x03\x04", "    ")).otherwise(known)
    return plain, F.regexp_replace(plain, NUMBER, " \x01 ")


def _views(numbered: Column) -> tuple[tuple[Column, Column], ...]:
    """For each view of a text with its numbers marked: the text as names are looked for in it (\x04 keeps a starter from being
    one), and as units are."""
    starters = F.regexp_replace(numbered, STARTER, "$1\x04$2")
    return (starters, F.regexp_replace(starters, NAME, "$1 \x02 ")), (F.lit(""), F.lower(numbered))


def template(named: Column) -> Column:
    """The template tokens of a text whose numbers and names are marked: \x01 (number), \x02 (name) and \x03 (unit)."""
    return F.array_remove(F.split(F.lower(F.regexp_replace(named, UNIT, "$1 \x03 $3")), BREAK), "")


def templates(rows: DataFrame, text: str) -> DataFrame:
    """rows with `views`, an array of (view, tokens)."""
    plain = staged(rows, _plain=_marked(F.col(text))[0])
    numbered = staged(plain, _numbered=F.regexp_replace("_plain", NUMBER, " \x01 ")).drop("_plain")
    views = F.array(*(F.struct(F.lit(v).alias("view"), template(named).alias("tokens")) for v, (_, named) in zip(VIEWS, _views(F.col("_numbered")))))
    return staged(numbered, views=views).drop("_numbered")


def slots(text: Column, view: Column, tokens: Column) -> Column:
    """A map from a token's position to the value that its placeholder stands for, in one view of a text."""
    plain, numbered = _marked(text)
    values = []
    for starters, named in _views(numbered):
        values.append((F.regexp_extract_all(plain, F.lit(f"({NUMBER})"), F.lit(1)), F.regexp_extract_all(starters, F.lit(NAME), F.lit(2)), F.regexp_extract_all(named, F.lit(UNIT), F.lit(2))))
    found = [F.when(view == 0, a).otherwise(b) for a, b in zip(*values)]
    at = [F.filter(F.transform(tokens, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull()) for mark in ("\x01", "\x02", "\x03")]
    return F.map_from_entries(F.concat(*(F.arrays_zip(a, v) for a, v in zip(at, found))))


def _row() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _texts_of(docs: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """(doc_id, row, text) of the rows in found(doc_id, row): their keys are broadcast if they are few, counted first."""
    keys = written(found.select("doc_id", "row").distinct(), "hits")
    keys = F.broadcast(keys) if keys.count() <= most else keys
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _row().alias("row"))
    return rows.join(keys, ["doc_id", "row"], "left_semi")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, broadcast_most: int = BROADCAST_MOST, found_most: int = FOUND_MOST) -> DataFrame:
    """(doc_id, row, item_id, view, shift, n_windows, item_windows, n_slots, exact) of every alignment of an item in a row that is
    filled consistently; `row` is a hash of the row's text (see find)."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.col("text").cast("string").alias("item_text")).where("item_id is not null").distinct()
    items = templates(items, "item_text").select("item_id", "item_text", F.inline("views")).where(F.size("tokens") > 0)
    items = items.withColumn("width", F.least(F.size("tokens"), F.lit(window)))
    wide = items.withColumn("h", F.transform("tokens", lambda x: F.xxhash64(x)))
    size = items.groupBy("width").agg(F.sum(F.size("tokens") - F.col("width") + 1).alias("n"), F.sum(F.octet_length("item_text")).alias("b")).collect()  # at most `window` rows
    widths = sorted(r["width"] for r in size)
    if not widths:
        return spark.createDataFrame([], "doc_id long, row long, item_id long, view int, shift int, n_windows long, item_windows long, n_slots long, exact boolean")
    small = sum(r["n"] for r in size) <= broadcast_most and sum(r["b"] for r in size) <= BROADCAST_BYTES
    either = lambda df: F.broadcast(df) if small else df
    parts = [wide.where(F.col("width") == w).select("item_id", "view", F.posexplode(_windows(F.col("h"), w)).alias("item_at", "window")) for w in widths]
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.unionByName(p)
    rows = docs.select(F.col("doc_id").cast("long"), _row().alias("row"), "text").where("doc_id is not null")
    rows = templates(rows, "text").select("doc_id", "row", F.inline("views"))
    rows = rows.select("doc_id", "row", "view", F.transform("tokens", lambda x: F.xxhash64(x)).alias("h"))
    places = [rows.select("doc_id", "row", "view", F.posexplode(_windows(F.col("h"), w)).alias("at", "window")) for w in widths]
    seen = places[0]
    for p in places[1:]:
        seen = seen.unionByName(p)
    hits = seen.join(either(keys), ["view", "window"])
    aligned = hits.groupBy("doc_id", "row", "item_id", "view", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.count_distinct("item_at").alias("n_windows"), F.min("item_at").alias("low"), F.max("item_at").alias("high"))
    sized = items.select("item_id", "view", "width", (F.size("tokens") - F.col("width") + 1).cast("long").alias("item_windows"), slots(F.col("item_text"), F.col("view"), F.col("tokens")).alias("item_slots"))
    found = cut(aligned.join(either(sized), ["item_id", "view"]).where(F.col("n_windows") >= share * F.col("item_windows")))
    alignment = ["doc_id", "row", "item_id", "view", "shift", "n_windows", "item_windows"]
    plain = found.where(F.size("item_slots") == 0).select(*alignment, F.lit(0).cast("long").alias("n_slots"), F.lit(True).alias("exact"))
    filled = found.where(F.size("item_slots") > 0)
    # slots are read once a text, however many alignments it has
    texts = templates(_texts_of(docs, filled, found_most), "text").select("doc_id", "row", "text", F.inline("views"))
    got = texts.select("doc_id", "row", "view", F.explode(slots(F.col("text"), F.col("view"), F.col("tokens"))).alias("pos", "got")).distinct()
    # an alignment may leave out the ends: only placeholders from its first window to its last, with a counterpart, are compared
    covered = filled.select(*alignment, "low", (F.col("high") + F.col("width")).alias("end"), F.explode("item_slots").alias("item_at", "value")).where("low <= item_at and item_at < end")
    pairs = covered.withColumn("pos", F.col("item_at") + F.col("shift")).join(got, ["doc_id", "row", "view", "pos"], "left")
    judged = pairs.groupBy(*alignment).agg(
        F.count_distinct(F.when(F.col("got").isNotNull(), F.col("value"))).alias("values"), F.count_distinct(F.when(F.col("got").isNotNull(), F.struct("value", "got"))).alias("pairs"),
        F.count("got").alias("n_slots"), F.coalesce(F.bool_and(F.col("got") == F.col("value")), F.lit(False)).alias("exact"),
    )
    bare = filled.where(~F.exists(F.map_keys("item_slots"), lambda i: (F.col("low") <= i) & (i < F.col("high") + F.col("width"))))
    return plain.unionByName(bare.select(*alignment, F.lit(0).cast("long").alias("n_slots"), F.lit(False).alias("exact"))).unionByName(judged.where("values = pairs").select(plain.columns))


def find(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots, exact) for every item found in a document, consistently filled.

    The whole text of each row of docs(doc_id, text) is read in both views, and every alignment that holds the share of an item's
    windows is judged by itself. n_windows counts the item's windows in the best of the consistently filled alignments (the one
    with most, then the earliest, then the one with names). exact: every placeholder has the item's own value (an item without
    placeholders has; one with placeholders, none of which the alignment covers, has not). Null ids are not reported, null and
    empty texts have no windows, items without a token are not looked for. Rows with one doc_id are judged each by its own text
    and reported together; equal rows count once, as do equal rows of the benchmark. Other columns are not read. A window that
    very many texts hold makes a large key only in the join by shuffle, which Spark splits.
    """
    best = F.max_by(F.struct("n_windows", "item_windows", "n_slots", "exact"), F.struct("n_windows", -F.col("shift"), "n_slots", "exact", -F.col("view"))).alias("b")
    return matches(docs, benchmark, **how).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all columns, that hold no item; rows without a doc_id stay, and so do other rows of a doc_id."""
    found = written(matches(docs, benchmark, **how).select("doc_id", F.col("row").alias("_row")).distinct(), "found")
    return docs.withColumn("_row", _row()).join(found, ["doc_id", "_row"], "left_anti").select(docs.columns)


ORACLE = rf"""
WITH steps AS (
  SELECT row_number() OVER () AS row, id, side, plain FROM (SELECT DISTINCT doc_id AS id, 'd' AS side, coalesce(text, '') AS plain FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT item_id, 'b', coalesce(text, '') FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))),
s1 AS (SELECT *, 0 AS view, regexp_replace(regexp_replace(plain, '{NUMBER}', ' ' || chr(1) || ' ', 'g'), '{STARTER}', '\1' || chr(4) || '\2', 'g') AS numbered FROM steps
  UNION ALL SELECT *, 1, lower(regexp_replace(plain, '{NUMBER}', ' ' || chr(1) || ' ', 'g')) FROM steps),
s2 AS (SELECT *, CASE WHEN view = 0 THEN regexp_replace(numbered, '{NAME}', '\1 ' || chr(2) || ' ', 'g') ELSE numbered END AS named FROM s1),
s3 AS (SELECT *, list_filter(regexp_split_to_array(lower(regexp_replace(named, '{UNIT}', '\1 ' || chr(3) || ' \3', 'g')), '{BREAK}'), lambda x: x <> '') AS tokens FROM s2),
items AS (SELECT row AS item_row, view, id AS item_id, tokens, least(len(tokens), {WINDOW}) AS width, len(tokens) - least(len(tokens), {WINDOW}) + 1 AS item_windows,
   list_sum(list_transform(tokens, lambda x: (x IN (chr(1), chr(2), chr(3)))::int))::bigint AS slots, plain, numbered, named FROM s3 WHERE side = 'b' AND len(tokens) > 0),
keys AS (SELECT item_row, view, p AS item_at, array_to_string(tokens[p + 1 : p + width], ' ') AS w FROM items, unnest(range(0, item_windows)) AS r(p)),
places AS (SELECT s.row, s.view, p AS pos, array_to_string(tokens[p + 1 : p + k.width], ' ') AS w
   FROM s3 s, (SELECT DISTINCT width FROM items) k, unnest(range(0, greatest(len(tokens) - k.width + 1, 0))) AS r(p) WHERE side = 'd'),
aligned AS (SELECT row, item_row, view, pos - item_at AS shift, count(DISTINCT item_at) AS n_windows, min(item_at) AS low, max(item_at) AS high FROM places JOIN keys USING (view, w) GROUP BY ALL),
found AS (SELECT a.*, i.item_windows, i.slots, i.width FROM aligned a JOIN items i USING (item_row, view) WHERE n_windows >= {SHARE} * item_windows),
filled AS (
  SELECT row, view, side, p AS at, CASE tokens[p + 1]
    WHEN chr(1) THEN regexp_extract_all(plain, '{NUMBER}')[len(list_filter(tokens[1 : p + 1], lambda x: x = chr(1)))]
    WHEN chr(2) THEN regexp_extract_all(numbered, '{NAME}', 2)[len(list_filter(tokens[1 : p + 1], lambda x: x = chr(2)))]
    ELSE regexp_extract_all(named, '{UNIT}', 2)[len(list_filter(tokens[1 : p + 1], lambda x: x = chr(3)))] END AS value
  FROM s3, unnest(range(0, len(tokens))) AS r(p)
  WHERE tokens[p + 1] IN (chr(1), chr(2), chr(3)) AND ((side = 'b') OR (row, view) IN (SELECT (row, view) FROM found WHERE slots > 0))),
judged AS (
  SELECT f.row, f.item_row, f.view, f.shift, f.n_windows, f.item_windows, count(d.value) AS n_slots, coalesce(bool_and(d.value = i.value), false) AS exact,
    count(DISTINCT CASE WHEN d.value IS NOT NULL THEN i.value END) AS vals, count(DISTINCT CASE WHEN d.value IS NOT NULL THEN i.value || chr(1) || d.value END) AS pairs
  FROM found f LEFT JOIN filled i ON i.side = 'b' AND i.row = f.item_row AND i.view = f.view AND i.at BETWEEN f.low AND f.high + f.width - 1 LEFT JOIN filled d ON d.side = 'd' AND d.row = f.row AND d.view = f.view AND d.at = i.at + f.shift
  WHERE f.slots > 0 GROUP BY ALL),
every AS (SELECT row, item_row, view, shift, n_windows, item_windows, 0::bigint AS n_slots, true AS exact FROM found WHERE slots = 0
  UNION ALL SELECT row, item_row, view, shift, n_windows, item_windows, n_slots, exact FROM judged WHERE vals = pairs)
SELECT d.id AS doc_id, i.item_id, n_windows, e.item_windows, n_slots, exact FROM every e JOIN s3 d USING (row, view) JOIN items i USING (item_row, view)
QUALIFY row_number() OVER (PARTITION BY d.id, i.item_id ORDER BY n_windows DESC, shift, n_slots DESC, exact DESC, e.view) = 1
"""
