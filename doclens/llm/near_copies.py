"""All pairs of texts whose sets of word shingles have a Jaccard similarity of at least 0.8, without a false or lost one.

Sets that similar share an element among their first n - ceil(0.8 n) + 1 in any common order, so a hash join of these
prefixes finds every pair; lengths, places in the order and the number of shared prefix elements drop most others, and the
rest are compared whole. The order puts shingles that are frequent in a sample last. Which shingles the sample names
changes the work, never the result. Texts with equal sets are one node before the join, so exact copies cost nothing.

A sample can't tell what few sets hold in a large corpus, and long texts that share a passage would meet in pairs without
end. So the order starts with elements that one set alone holds: those among a quarter of all hashes are counted exactly. As
many of them as a set has, so many fewer of its prefix are left for the join; most sets without a near copy have none left.

Only prefix elements that several sets hold go on. A large group of near copies must not become all its pairs: first every
set is compared with one pivot of each of its prefix elements, the least set and then, where several groups are left, sets
that come first in other orders, which joins nearly all of such a group; then only pairs from different groups meet, at
elements that sets of several groups hold.

Each set has a parity map: a bit for each bucket of hashes that holds an odd number of its elements. Two maps differ in at
most as many bits as the sets have elements that aren't shared, so pairs whose maps differ in more go without a look at the
sets. A map of 64 * WORDS bits stands in the join; one that grows with the set (folded to the smaller, by exclusive or)
goes over what the join lets through, and few pairs that aren't similar have their texts read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import hash_order, written
from doclens.llm.features import slices
from doclens.llm.simhash import SEED, components, row_key, shingles, without

SHINGLE = 5
#: Similarity in tenths, so that bounds are whole numbers.
TENTHS = 8
#: Documents sampled for the order, times that a shingle is seen in them before it counts as frequent, and most such shingles.
SAMPLE, FREQUENT, FREQUENT_MOST = 10_000, 3, 200_000
#: Longs of the parity map that stands in the join: 1,024 bits still part sets of some 2,000 elements.
WORDS = 16
#: Sets of at least LONG elements have a second map there, of MORE longs, which their full maps fill.
LONG, MORE = 2048, 64
#: Hashes below this, a quarter of all, are counted to find elements that one set alone holds.
COUNTED = np.uint64(1 << 62)
#: Orders in which pivots are chosen, one after another.
ROUNDS = 3


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; all words are one shingle if there are fewer."""
    joined, starts, ends = shingles(text, shingle)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends)))


def prefix_length(n: int, tenths: int = TENTHS) -> int:
    return n - -(-tenths * n // 10) + 1 if n else 0


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", row_key())
    return rows.where("doc_id is not null and text is not null")


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for b in slices(batches):
        yield b, [shingle_set(t, shingle) for t in b.column("text").cast(pa.binary()).to_pylist()]


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _longs(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def frequent(docs: DataFrame, shingle: int = SHINGLE, sample: int = SAMPLE) -> np.ndarray:
    """The shingles that several documents of a sample hold, the rarest first."""
    every = max(1, docs.count() // sample)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    seen = _texts(docs).where(F.pmod(hash_order("doc_id"), F.lit(every)) == 0).mapInArrow(work, "h long").groupBy("h").agg(F.count("*").alias("n"))
    top = seen.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(FREQUENT_MOST).toArrow()
    return top.column("h").to_numpy().view(np.uint64)[::-1].copy()


def parity(found: np.ndarray) -> np.ndarray:
    """The parity map of a set, in longs: a power of two of them, at least WORDS, with 2 to 4 bits an element."""
    bits = max(64 * WORDS, 1 << int(2 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


def may_be_similar(n: int, m: int, x: np.ndarray, y: np.ndarray, tenths: int = TENTHS) -> bool:
    """False only if sets of n and m elements with these parity maps have a similarity below tenths / 10."""
    words = min(len(x), len(y))
    differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
    return (10 + tenths) * differ <= (10 - tenths) * (n + m)


class Similar(NamedTuple):
    #: (s, doc_id, row, n): each row with words, by the hash of its set.
    rows: DataFrame
    #: (s, doc_id, row): the least row of each set.
    least: DataFrame
    #: (a, b): links between sets whose components are those of all pairs of similar sets.
    links: DataFrame


def _likely(pairs: DataFrame, maps: DataFrame, tenths: int) -> DataFrame:
    """Those pairs(s, t) whose parity maps(s, n, bits) allow that they are similar."""
    sides = pairs.join(maps, "s").join(maps.select(F.col("s").alias("t"), F.col("n").alias("m"), F.col("bits").alias("other")), "t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column("n").to_pylist(), b.column("m").to_pylist()
            maps = ((b.column("bits")[k].values.to_numpy().view(np.uint64), b.column("other")[k].values.to_numpy().view(np.uint64)) for k in range(b.num_rows))
            keep = [may_be_similar(n[k], m[k], x, y, tenths) for k, (x, y) in enumerate(maps)]
            yield b.select(["s", "t"]).filter(pa.array(keep, pa.bool_()))

    return sides.mapInArrow(work, "s long, t long")


def _verified(pairs: DataFrame, docs: DataFrame, least: DataFrame, shingle: int, tenths: int) -> DataFrame:
    """(a, b) of those pairs(s, t) of sets that are similar, from their whole texts."""
    pairs = written(pairs, "pairs")
    needed = pairs.select("s").union(pairs.select("t")).distinct().join(least, "s").select("doc_id", "row")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, shingle):
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in sets], pa.int64()), _longs(sets)], ["s", "held"])

    texts = _texts(docs).join(needed, ["doc_id", "row"], "left_semi").select("text")
    sets = written(texts.mapInArrow(whole, "s long, held array<long>").dropDuplicates(["s"]), "held")
    sides = pairs.join(sets, "s").select("s", "t", F.col("held").alias("x")).join(sets.withColumnRenamed("s", "t"), "t")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i in range(b.num_rows):
                x, y = (b.column(c)[i].values.to_numpy() for c in ("x", "held"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(10 * both >= tenths * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("s"), b.column("t")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(sides.select("s", "t", "x", "held").mapInArrow(compared, "a long, b long"), "links")


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, tenths: int = TENTHS, sample: int = SAMPLE) -> Similar:
    """The sets of docs(doc_id, text) and links between them. Wordless texts have no set; rows without doc_id are left out."""
    common = frequent(docs, shingle, sample)
    by_hash = np.argsort(common)
    common = common[by_hash]

    def first(found: np.ndarray) -> np.ndarray:
        """The prefix as far as the sample tells: of what it doesn't name, counted elements stand last, since those that are
        not alone, which go to the front, are known to be shared."""
        at = np.searchsorted(common, found)
        at[at == len(common)] = 0
        counted = (found < COUNTED).astype(np.int64)
        rank = np.where(common[at] == found, by_hash[at] + 2, counted) if len(common) else counted
        return found[np.lexsort((found, rank))][: prefix_length(len(found), tenths)]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, sets in _sets(batches, shingle):
            heads = [first(x) for x in sets]
            few = [x[: np.searchsorted(x, COUNTED)] for x in sets]
            inside = [np.isin(x, h, assume_unique=True) for x, h in zip(few, heads)]
            columns = [b.column("doc_id"), b.column("row"), pa.array([_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), _longs(heads)]
            columns += [_longs([x[~i] for x, i in zip(few, inside)]), _longs([x[i] for x, i in zip(few, inside)]), _longs([parity(x) for x in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "s", "n", "prefix", "outside", "inside", "bits"])

    schema = "doc_id long, row long, s long, n int, prefix array<long>, outside array<long>, inside array<long>, bits array<long>"
    rows = written(_texts(docs).mapInArrow(prefixes, schema).where("n > 0"), "prefixes")
    least = written(rows.groupBy("s").agg(F.min(F.struct("doc_id", "row")).alias("r"), F.count("*").alias("m")).select("s", "r.doc_id", "r.row", "m"), "sets")
    # rows that aren't their set's least are left out where any are; a repeated row stands twice and does no harm
    twins = least.where("m > 1")
    one = rows.join(twins, "s", "left_anti").unionByName(rows.join(twins.select("s", "doc_id", "row"), ["s", "doc_id", "row"], "left_semi"))
    counted = one.select("s", F.size("outside").alias("k"), F.posexplode(F.concat("outside", "inside")).alias("at", "h")).select("s", "h", (F.col("at") >= F.col("k")).alias("i"))
    alone = counted.groupBy("h").agg(F.count("*").alias("m"), F.min("s").alias("s"), F.min("i").alias("i")).where("m = 1")
    alone = alone.groupBy("s").agg(F.count("*").cast("int").alias("alone"), F.collect_list(F.when(F.col("i"), F.col("h"))).alias("gone"))
    # a set's elements that it alone holds are the first of its prefix; none of them can have a partner
    heads = one.select("s", "n", "prefix").join(alone, "s", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).where(F.col("alone") < F.size("prefix"))
    heads = heads.withColumn("prefix", F.slice(F.when(F.size("gone") > 0, F.array_except("prefix", "gone")).otherwise(F.col("prefix")), F.lit(1), F.size("prefix") - F.col("alone")))
    heads = written(heads.drop("gone"), "heads")
    shared = heads.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    places = heads.select("s", "n", "alone", F.posexplode("prefix").alias("at", "h")).withColumn("at", F.col("at") + F.col("alone")).drop("alone")
    places = written(places.join(shared, "h").distinct(), "places")
    maps = written(one.select("s", "n", "bits").join(places.select("s").distinct(), "s", "left_semi").dropDuplicates(["s"]), "maps")

    grouped, links = places.withColumn("g", F.col("s")), None
    sized = 10 * F.least("n", "m") >= tenths * F.greatest("n", "m")
    for k in range(ROUNDS):
        order = F.xxhash64("s", F.lit(k)) if k else F.col("s")
        pivots = grouped.groupBy("h").agg(F.min(F.struct(order.alias("o"), "s", "n", "g")).alias("p")).select("h", F.col("p.s").alias("t"), F.col("p.n").alias("m"), F.col("p.g").alias("q"))
        starred = grouped.join(pivots, "h").where(sized & (F.col("g") != F.col("q"))).select("s", "t").distinct()
        stars = _verified(_likely(starred, maps, tenths), docs, least, shingle, tenths)
        links = stars if links is None else links.unionByName(stars)
        groups = components(links).withColumnsRenamed({"id": "s", "root": "g"})
        grouped = grouped.drop("g").join(groups, "s", "left").withColumn("g", F.coalesce("g", "s"))
        mixed = grouped.groupBy("h").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("h")
        grouped = written(grouped.join(mixed, "h", "left_semi"), "grouped")

    word = lambda k, words: F.aggregate(F.sequence(k, F.size("bits") - 1, F.lit(words)), F.lit(0).cast("long"), lambda a, i: a.bitwiseXOR(F.get("bits", i)))
    more = F.when(F.col("n") >= LONG, F.transform(F.sequence(F.lit(0), F.lit(MORE - 1)), lambda k: word(k, MORE)))
    small = maps.select("s", more.alias("more"), *(word(F.lit(k), WORDS).alias(f"b{k}") for k in range(WORDS)))
    grouped = written(grouped.join(small, "s"), "mixed")
    l, r = grouped.alias("l"), grouped.alias("r")
    differ = sum((F.bit_count(F.col(f"l.b{k}").bitwiseXOR(F.col(f"r.b{k}"))) for k in range(WORDS)), F.lit(0))
    most = F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) + F.least("l.at", "r.at")
    may = (F.col("l.g") != F.col("r.g")) & (F.col("l.s") < F.col("r.s")) & (10 * F.least("l.n", "r.n") >= tenths * F.greatest("l.n", "r.n")) & ((10 + tenths) * most >= tenths * (F.col("l.n") + F.col("r.n")))
    far = F.aggregate(F.zip_with("l.more", "r.more", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    for bits in (differ, F.coalesce(far, F.lit(0))):
        may = may & ((10 + tenths) * bits <= (10 - tenths) * (F.col("l.n") + F.col("r.n")))
    hits = l.join(r, (F.col("l.h") == F.col("r.h")) & may).groupBy(F.col("l.s").alias("s"), F.col("r.s").alias("t"), F.col("l.n").alias("n"), F.col("r.n").alias("m")).agg(F.count("*").alias("hits"))
    # what two sets share is in both prefixes or among what the prefix of one of them leaves
    rest = F.ceil(F.greatest("n", "m") * tenths / F.lit(10)) - 1
    pairs = hits.where((10 + tenths) * (F.col("hits") + rest) >= tenths * (F.col("n") + F.col("m"))).select("s", "t")
    return Similar(rows.drop("prefix", "outside", "inside", "bits"), least, links.unionByName(_verified(_likely(pairs, maps, tenths), docs, least, shingle, tenths)))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with all columns, but those whose set is linked with that of a smaller doc_id, or equal to it.

    Of each group of linked sets the row with the least (doc_id, hash of the text) stays, and rows equal to it in both. Wordless
    texts and rows without a doc_id stay.
    """
    found = similar_sets(docs, **how)
    group = found.least.join(components(found.links).withColumnsRenamed({"id": "s", "root": "g"}), "s", "left").withColumn("g", F.coalesce("g", "s"))
    kept = group.groupBy("g").agg(F.min(F.struct("doc_id", "row")).alias("k"))
    joined = group.select("s", "g", "m").join(kept, "g").select("s", "k", "m")
    # a set alone with one row has nothing to lose
    rows = found.rows.join(joined, "s").where(~F.struct("doc_id", "row").eqNullSafe(F.col("k")))
    return without(docs, written(rows.select("doc_id", "row").distinct(), "copies"))
