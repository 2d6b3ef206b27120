"""How filters of a corpus interact, by inclusion and exclusion, in DataFrame functions only.

Each text has a flag for each filter that it fails. All that an order of the filters removes, loses or counts twice follows
from 32 numbers for each part of the corpus: J(S), the documents that fail every filter of S, which are sums of products of
flags. Signed sums of J over the subsets of a set of filters give what survives it; over the supersets, what fails exactly it.
With v(P) the documents that the filters P remove, the dividends of v are J(S) with the sign of S's size, so that a filter's
Shapley value is the sum of the dividends of the sets with it, each shared among its members.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: Least words; least per cent of distinct words; most per cent of capitals.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows without a doc_id are dealt over so many keys when labels are looked up.
SPREAD = 997
N = len(FILTERS)
_COUNTS = ("n", "good", "toxic")


def text_flags(text: Column) -> Column:
    """The filters A to D that a text fails, as a sum of 1 << k."""

    def of(words: Column) -> Column:
        capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
        fails = (F.size(words) < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words), 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike(SYMBOLS))
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    # a lambda's argument is computed once
    return F.get(F.transform(F.array(F.array_remove(F.split(text, SPACE), "")), of), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and by the filters that they fail, filter k by the bit 1 << k; good and
    toxic count those that labels call so.

    The corpus is read once; from then on a row is a doc_id, a fingerprint of the text and flags. Copies of one text have one
    set of flags but for E, so that a group of copies of any size meets as counts for each part and label, summed before it
    is shuffled. A null doc_id is smaller and larger than none: such a row neither fails E nor makes another fail it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    # 256 bits tell texts apart
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("same"), text_flags(F.col("text")).alias("mask"))
    once = rows.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))
    once = once.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("same") % SPREAD).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = once.join(known.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").select("doc_id", "part", "same", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    group = labelled.groupBy("same", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    both = group.withColumn("first", F.min("least").over(Window.partitionBy("same")))
    # a group's rows pass E if they have the least doc_id of all equal texts, or none
    passing = F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0) + F.col("n_null")
    split = both.select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("mask"), passing.alias("n")), F.struct((F.col("mask") + (1 << (N - 1))).alias("mask"), (F.col("n") - passing).alias("n")))))
    return split.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def joint_failures(counts: DataFrame) -> DataFrame:
    """(part, joint): for each part an array over all sets S of filters, by number, of the documents that fail all of S."""
    sets = counts.select("part", "mask", *_COUNTS, F.explode(F.sequence(F.lit(0), F.lit((1 << N) - 1))).alias("set"))
    flag = lambda k: F.when((F.col("set").bitwiseAND(1 << k)) == 0, 1).otherwise(F.col("mask").bitwiseAND(1 << k) / (1 << k))
    product = flag(0)
    for k in range(1, N):
        product = product * flag(k)
    sums = sets.groupBy("part", "set").agg(*(F.sum(F.col(c) * product.cast("long")).alias(c) for c in _COUNTS))
    return sums.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("set", *_COUNTS))), lambda s: F.struct(*(s[c].alias(c) for c in _COUNTS))).alias("joint"))


def signed(count: str, over: Column) -> Column:
    """The sum of a count of `joint` over sets(number, sign)."""
    return F.aggregate(over, F.lit(0).cast("long"), lambda a, s: a + s["sign"] * F.get("joint", s["set"])[count])


def steps() -> Column:
    """An array of (filter_order, step, before, own): all orders of the filters with the sets of those before each step."""
    rows = []
    for order in permutations(range(N)):
        before = 0
        for step, k in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "before": before, "own": 1 << k})
            before |= 1 << k
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,before:int,own:int>>")


def subsets() -> Column:
    """For each set of filters, by number, its subsets with the signs of their sizes."""
    signs = [[{"set": s, "sign": -1 if s.bit_count() % 2 else 1} for s in range(1 << N) if s & of == s] for of in range(1 << N)]
    return F.from_json(F.lit(json.dumps(signs)), "array<array<struct<set:int,sign:long>>>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each value of
    lang (a null is the empty string), each order of the five filters and each step.

    docs(doc_id, text, lang) and labels(doc_id, quality, toxic) are read whole; a null text is empty. Rows count one each,
    repeated ones too: of rows equal in doc_id and text none is smaller. Of several labels of a doc_id the larger holds. An empty
    table has no parts and no rows. Other columns are not read.
    """
    rows = joint_failures(failures(docs, labels))
    full = (1 << N) - 1
    dividends = [{"set": s, "sign": (1 if s.bit_count() % 2 else -1) * (factorial(N) // s.bit_count())} for s in range(1, 1 << N)]
    shares = F.from_json(F.lit(json.dumps(dividends)), "array<struct<set:int,sign:long>>")
    # what survives each set, and each filter's Shapley value, once a part
    of_part = rows.select(
        "part", "joint", F.transform(subsets(), lambda of: F.struct(*(signed(c, of).alias(c) for c in _COUNTS))).alias("left"),
        F.transform(F.array(*(F.lit(1 << k) for k in range(N))), lambda k: signed("n", F.filter(shares, lambda s: s["set"].bitwiseAND(k) != 0))).alias("shares"),
    )
    each = of_part.select("part", "joint", "left", "shares", F.explode(steps()).alias("s"))
    left = lambda of, c="n": F.get("left", of)[c]
    before, after = F.col("s.before"), F.col("s.before").bitwiseOR(F.col("s.own"))
    others = F.lit(full).bitwiseXOR(F.col("s.own"))
    removed = left(before) - left(after)
    return each.select(
        "part", "s.filter_order", "s.step", left(after).alias("kept"), removed.alias("removed"), (F.get("joint", F.col("s.own"))["n"] - removed).alias("redundant"), (left(others) - left(F.lit(full))).alias("unique_fails"),
        (left(before, "good") - left(after, "good")).alias("good_lost"), (left(before, "toxic") - left(after, "toxic")).alias("toxic_lost"), F.get("shares", F.log2(F.col("s.own").cast("double")).cast("int")).alias("shapley"),
    )


#: Every document goes through every order, filter by filter.
ORACLE = rf"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM docs),
known AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT part, coalesce(good, 0) AS good, coalesce(k.toxic, 0) AS toxic, [len(words) < {MIN_WORDS}, 100 * len(list_distinct(words)) < {MIN_DISTINCT} * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITALS} * length(text),
  regexp_matches(text, '{SYMBOLS}'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS f FROM w LEFT JOIN known k USING (doc_id)),
masks AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
five AS (SELECT unnest(range(1, 6)) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM five a, five b, five c, five d, five e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
gone AS (SELECT *, coalesce(list_min(list_filter([1, 2, 3, 4, 5], lambda s: f[o[s]])), 6) AS hit FROM masks, orders),
rows AS (SELECT part, o, s, sum(CASE WHEN hit > s THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit = s THEN n ELSE 0 END) AS removed, sum(CASE WHEN f[o[s]] AND hit < s THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN f[o[s]] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN hit = s THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit = s THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone, unnest(range(1, 6)) AS r(s) GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda k: '{FILTERS}'[k]), '') AS filter_order, s::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
  good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, o[s]))::bigint AS shapley FROM rows
"""
