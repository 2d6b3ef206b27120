"""URL filtering by dated lists, in DataFrame functions only.

A list says on which day an entry (a domain or a domain with a path) came on or went off it. For each entry and category
the days become validity intervals; each capture is judged by the intervals that hold at its fetch time, looked up under
every parent domain of its host and every prefix of its path. The most specific entry decides; at the same length an
allow list decides before a block list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Days in a slice of time; captures and intervals meet by entry and slice, so that a host with many captures and many list
#: changes spreads over tasks.
SLICE_DAYS = 90
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)"


def plain_host(host: Column) -> Column:
    """A host in lower case without a leading www. and a trailing dot."""
    return F.regexp_replace(F.lower(host), r"^www\.|\.$", "")


def plain_entry(entry: Column) -> Column:
    """A list entry as captures are looked up: its host as plain_host has it, its path in lower case without empty steps. An entry is
    a domain, or a domain and a path; one that is written with a scheme, a port or a leading "*." matches nothing."""
    steps = F.filter(F.split(F.lower(F.trim(entry)), "/"), lambda s: s != "")
    path = F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0)))
    return F.nullif(F.when(F.size(steps) > 0, F.array_join(F.concat(F.array(plain_host(F.get(steps, F.lit(0)))), path), "/")), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, category, allow, valid_from, valid_to) from entries(entry, category, allow, day, listed).

    Entries are written plainly first (plain_entry), so that all spellings of one share a history. An entry holds from a
    day on which it is listed until the next day on which it is taken off (exclusive; null: it still holds). Of several rows
    for one day the one that lists it counts. Rows with a null or empty entry or a null day are left out.
    """
    days = entries.withColumn("entry", plain_entry(F.col("entry"))).where("entry is not null and day is not null")
    days = days.groupBy("entry", "category", "allow", "day").agg(F.bool_or("listed").alias("listed"))
    w = Window.partitionBy("entry", "category", "allow").orderBy("day")
    turns = days.withColumn("was", F.lag("listed", 1, False).over(w)).where("listed <> was")
    spans = turns.withColumn("valid_to", F.lead("day").over(w)).where("listed")
    return spans.select("entry", "category", "allow", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, slice_days: int = SLICE_DAYS) -> DataFrame:
    """(page_id, url, fetched, host, entry, category, valid_from, blocked) for each distinct capture (page_id, url, fetched).

    entry, category and valid_from are null, and blocked is false, if nothing holds; so too for a null or malformed url or a
    null day of fetching. Equal captures come out once. Other columns are not read.
    """
    seen = captures.select("page_id", "url", F.col("fetched").cast("date")).distinct()
    seen = seen.withColumn("host", plain_host(F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1), F.lit(""))))
    labels, steps = F.split("host", r"\."), F.filter(F.split(F.lower(F.regexp_extract("url", _PATH, 1)), "/"), lambda s: s != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat_ws("/", "host", F.array_join(F.slice(steps, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    part = F.floor(F.unix_date("fetched") / slice_days)
    keyed = seen.where("host is not null and fetched is not null").select("page_id", "url", "fetched", part.alias("part"), F.explode(F.concat(domains, paths)).alias("entry"))
    # an interval is dealt only to slices in which its entry was fetched, so a stray date far away adds one slice, not all between
    low, high = F.floor(F.unix_date("valid_from") / slice_days), F.floor((F.unix_date("valid_to") - 1) / slice_days)
    dealt = keyed.select("entry", "part").distinct().join(intervals(entries), "entry").where((F.col("part") >= low) & F.coalesce(F.col("part") <= high, F.lit(True)))
    held = keyed.join(dealt, ["entry", "part"]).where("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    # more specific first, then allow, then the least category
    rank = F.struct((-F.length("entry")).alias("a"), (~F.col("allow")).alias("b"), "category", "entry", "valid_from")
    best = held.groupBy("page_id", "url", "fetched").agg(F.min(rank).alias("r"))
    best = best.select("page_id", "url", "fetched", "r.entry", "r.category", "r.valid_from", F.col("r.b").alias("hit"))
    s, b = seen.alias("s"), best.alias("b")
    same = F.col("s.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("s.url") == F.col("b.url")) & (F.col("s.fetched") == F.col("b.fetched"))
    return s.join(b, same, "left").select("s.page_id", "s.url", "s.fetched", "s.host", "b.entry", "b.category", "b.valid_from", F.coalesce("b.hit", F.lit(False)).alias("blocked"))


#: The dated lists of the registered query: (entry, category, allow, day, listed).
LISTS = """
VALUES ('casino-win.example.com', 'gambling', false, DATE '2020-02-01', true), ('casino-win.example.com', 'gambling', false, DATE '2021-06-15', false),
  ('casino-win.example.com', 'gambling', false, DATE '2022-01-10', true), ('free-bets.example.com', 'gambling', false, DATE '2021-03-01', true),
  ('cheap-pills.example.com', 'pharmacy', false, DATE '2019-11-20', true), ('cheap-pills.example.com', 'pharmacy', false, DATE '2023-01-01', false),
  ('example.net', 'parked', false, DATE '2022-05-01', true), ('example.net', 'parked', false, DATE '2022-08-01', false),
  ('example.net/en', 'reviewed', true, DATE '2022-06-01', true), ('tionsh.example.net', 'spam', false, DATE '2020-07-01', true),
  ('tionsh.example.net', 'trusted', true, DATE '2021-07-01', true), ('tionsh.example.net', 'trusted', true, DATE '2021-12-01', false),
  ('example.org', 'malware', false, DATE '2023-03-01', true), ('example.org', 'malware', false, DATE '2023-03-09', false),
  ('WWW.Free-Bets.example.com/', 'gambling', false, DATE '2022-02-01', false), ('www.Cheap-Pills.example.com', 'pharmacy', false, DATE '2023-06-01', true)
"""
#: Pages carry no fetch time: it is taken from page_id, over four years.
FETCHED = "CAST(DATE '2020-01-01' + CAST((page_id * 37) % 1461 AS INT) AS DATE)"


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    fixed = spark.sql(f"SELECT * FROM ({LISTS}) AS t(entry, category, allow, day, listed)")
    captures = pages.select("page_id", "url", F.expr(FETCHED).alias("fetched"))
    # every twelfth letter-sum of a host also came on a review list in the month that its name gives, and went off in the next year
    hosts = pages.select(F.regexp_replace(F.lower(F.regexp_extract("url", _HOST, 1)), r"^www\.", "").alias("entry")).where("entry <> ''").distinct()
    at = F.expr("length(entry) * 7 % 12")
    hosts = hosts.where("length(entry) % 3 = 0").select("entry", F.lit("review").alias("category"), F.lit(False).alias("allow"), F.add_months(F.lit("2020-01-01").cast("date"), at).alias("on"))
    dated = hosts.select("entry", "category", "allow", F.explode(F.array(F.struct(F.col("on").alias("day"), F.lit(True).alias("listed")), F.struct(F.add_months("on", 13).alias("day"), F.lit(False).alias("listed")))).alias("e"))
    return judge(captures, fixed.unionByName(dated.select("entry", "category", "allow", "e.day", "e.listed")))


ORACLE = rf"""
WITH caps AS (SELECT DISTINCT page_id, url, {FETCHED} AS fetched FROM pages),
hosts AS (SELECT *, regexp_replace(lower(nullif(regexp_extract(coalesce(url, ''), '{_HOST}', 1), '')), '^www\.|\.$', '', 'g') AS host FROM caps),
listed AS (SELECT * FROM ({LISTS}) AS t(entry, category, allow, day, listed)
  UNION ALL
  SELECT entry, 'review', false, unnest([d, CAST(d + INTERVAL 13 MONTH AS DATE)]), unnest([true, false])
  FROM (SELECT entry, CAST(DATE '2020-01-01' + to_months(CAST(length(entry) * 7 % 12 AS INT)) AS DATE) AS d
        FROM (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '^www\.', '') AS entry FROM pages) WHERE entry <> '' AND length(entry) % 3 = 0)),
plain AS (SELECT array_to_string(list_concat([regexp_replace(steps[1], '^www\.|\.$', '', 'g')], steps[2:]), '/') AS entry, category, allow, day, bool_or(listed) AS listed
  FROM (SELECT *, list_filter(string_split(lower(trim(entry)), '/'), lambda s: s <> '') AS steps FROM listed) WHERE len(steps) > 0 GROUP BY ALL),
turns AS (SELECT * FROM (SELECT *, lag(listed, 1, false) OVER (PARTITION BY entry, category, allow ORDER BY day) AS was FROM plain WHERE entry <> '') WHERE listed <> was),
spans AS (SELECT * FROM (SELECT entry, category, allow, listed, day AS valid_from, lead(day) OVER (PARTITION BY entry, category, allow ORDER BY day) AS valid_to FROM turns) WHERE listed),
keyed AS (
  SELECT page_id, url, fetched, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') AS entry FROM hosts, unnest(range(1, len(string_split(host, '.')) + 1)) AS r(i)
  UNION ALL
  SELECT page_id, url, fetched, host || '/' || array_to_string(list_slice(steps, 1, i), '/')
  FROM (SELECT *, list_filter(string_split(lower(regexp_extract(url, '{_PATH}', 1)), '/'), lambda s: s <> '') AS steps FROM hosts), unnest(range(1, len(steps) + 1)) AS r(i)),
held AS (SELECT k.*, s.category, s.allow, s.valid_from FROM keyed k JOIN spans s USING (entry) WHERE s.valid_from <= fetched AND (s.valid_to IS NULL OR fetched < s.valid_to)),
best AS (SELECT * FROM held QUALIFY row_number() OVER (PARTITION BY page_id, url, fetched ORDER BY length(entry) DESC, allow DESC, category, entry, valid_from) = 1)
SELECT h.page_id, h.url, h.fetched, h.host, b.entry, b.category, b.valid_from, coalesce(NOT b.allow, false) AS blocked
FROM hosts h LEFT JOIN best b ON h.page_id IS NOT DISTINCT FROM b.page_id AND h.url = b.url AND h.fetched = b.fetched
"""
