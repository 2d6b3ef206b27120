"""SimHash near-duplicates: BK-trees over shards of the distinct fingerprints, then connected components.

Two fingerprints that differ in at most 2 of 64 bits agree in at least 2 of 4 blocks of 16 bits, so a shard holds the
fingerprints that agree in one choice of 2 blocks (6 choices) and every link lies within a shard. A shard with more than
`most` members is dealt again by 2 of 4 blocks of 8 bits of the other 32; as fingerprints are distinct, such a shard
has at most 2**16. In each shard a BK-tree (children keyed by their Hamming distance to the parent) is grown, and each
member is looked up along the edges within the radius before it goes in. The trees stand in the tasks that hold their
shards: a broadcast of all trees would grow with the corpus. A shard emits a spanning star for each linked set, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import cut, written
from doclens.llm.features import slices

RADIUS = 2
SHINGLE = 3
#: Members above which a shard is dealt by a finer key.
SHARD_MOST = 2048
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """A text's words joined by spaces, and where each of its shingles begins (and more words do) and ends."""
    joined = b" ".join(text.translate(_LOWER).split())
    if not joined:
        return joined, [], []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    return joined, starts, ends[min(shingle, len(ends)) - 1 :]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text's word shingles, repeats included; 0 without words."""
    joined, starts, ends = shingles(text, shingle)
    if not joined:
        return 0
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:], ends[at : at + (1 << 16)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, row: bool = False) -> DataFrame:
    """(doc_id, fp long) of every row, with `row`, a hash of its text, if asked for; a null text counts as empty."""
    keys = ["doc_id", "row"] if row else ["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*map(b.column, keys), pa.array(fps)], [*keys, "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("row", row_key())
    return rows.select(*keys, "text").mapInArrow(work, ", ".join(f"{k} long" for k in (*keys, "fp")))


class BKTree:
    """Distinct integers by Hamming distance."""

    def __init__(self) -> None:
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, value: int) -> None:
        self.children[value] = {}
        if self.root is None:
            self.root = value
            return
        at = self.root
        while True:
            below, d = self.children[at], (at ^ value).bit_count()
            if d not in below:
                below[d] = value
                return
            at = below[d]

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [] if self.root is None else [self.root]
        while todo:
            at = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = self.children[at]
            for k in range(max(0, d - radius), d + radius + 1):
                if k in below:
                    todo.append(below[k])
        return found


def shard_links(fps: list[int], ids: list[int], radius: int) -> list[tuple[int, int]]:
    """(id, smallest id of its linked set) for each member that isn't the smallest."""
    tree, number, up = BKTree(), {}, {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for fp, i in sorted(zip(fps, ids), key=lambda x: x[1]):
        up[i] = i
        for near in tree.within(fp, radius):
            low, high = sorted((top(i), top(number[near])))
            up[high] = low
        tree.add(fp)
        number[fp] = i
    return [(i, top(i)) for i in up if top(i) != i]


def _pairs(parts: list[Column], width: int, base: Column) -> Column:
    """An array of (key, rest): the choice of 2 parts with their bits, and the bits of the other parts."""
    out = []
    for n, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        key = base + F.lit(n).cast("long") * (1 << 2 * width) + parts[i] * (1 << width) + parts[j]
        out.append(F.struct(key.alias("key"), (parts[k] * (1 << width) + parts[m]).alias("rest")))
    return F.array(*out)


def _blocks(col: str, width: int) -> list[Column]:
    return [F.shiftrightunsigned(col, width * k).bitwiseAND((1 << width) - 1) for k in range(4)]


def links(nodes: DataFrame, radius: int = RADIUS, most: int = SHARD_MOST) -> DataFrame:
    """(a, b) with a > b over the ids of nodes(id, fp), distinct fps: a spanning forest of each shard's links."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree only up to a radius of 2")
    keyed = nodes.select("id", "fp", F.inline(_pairs(_blocks("fp", 16), 16, F.lit(0).cast("long"))))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = cut(keyed.join(shared, "key"))
    small = keyed.where(F.col("n") <= most).select("key", F.lit(-1).cast("long").alias("sub"), "id", "fp")
    large = keyed.where(F.col("n") > most)
    large = large.select("key", F.inline(_pairs(_blocks("rest", 8), 8, F.lit(0).cast("long"))).alias("sub", "_rest"), "id", "fp")
    shards = (
        small.unionByName(large.drop("_rest"))
        .groupBy("key", "sub").agg(F.collect_list("fp").alias("fps"), F.collect_list("id").alias("ids"))
        .where(F.size("ids") > 1).select("fps", "ids")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                fps = [x & 0xFFFFFFFFFFFFFFFF for x in b.column("fps")[at].as_py()]
                if found := shard_links(fps, b.column("ids")[at].as_py(), radius):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return shards.mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of edges(a, b), root being the smallest id that it reaches.

    Large-star and small-star steps in turn until the edges are stars; each turn is cut in the shared folder.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a > b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, most: int = SHARD_MOST) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs(doc_id, text).

    Words are runs of characters other than ASCII white space, A-Z in lower case; shingles are 3 words, or all of them if
    fewer. A null or wordless text has fingerprint zero and links like any other. Repeated rows come out as often as they
    went in; a row without doc_id keeps a null component unless its fingerprint has other documents. Other columns of
    docs are not read. An empty table gives none.
    """
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = components(links(nodes.where("id is not null"), radius, most))
    class_of = nodes.join(roots, "id", "left").select("fp", F.coalesce("root", "id").alias("component_id"))
    return fps.join(class_of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_key() -> Column:
    """A hash of a row's text, null for a null."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with all columns, that aren't among gone(doc_id, row); rows without a doc_id stay. Spark broadcasts
    `gone`, as it was written, where its size allows; else both sides are dealt by doc_id."""
    d, g = docs.alias("d"), gone.alias("g")
    same = (F.col("d.doc_id").cast("long") == F.col("g.doc_id")) & row_key().eqNullSafe(F.col("g.row"))
    return d.join(g, same, "left_anti").select("d.*")


def one_of_each(docs: DataFrame, radius: int = RADIUS, most: int = SHARD_MOST) -> DataFrame:
    """One row of each component of linked fingerprints in docs, with all columns: the one with the least doc_id.

    Of several such rows (one doc_id with texts that link) the one with the least fingerprint and hash of the text stays; of
    rows equal in doc_id and text the least by a hash of all columns. Rows of one doc_id whose texts don't link are of
    different components and stand for themselves. Rows without a doc_id stay.
    """
    found = fingerprints(docs, row=True).where("doc_id is not null").groupBy("doc_id", "row", "fp").agg(F.count("*").alias("n"))
    found = cut(found)
    roots = components(links(found.select(F.col("fp").alias("id"), "fp").distinct(), radius, most)).withColumnsRenamed({"id": "fp", "root": "g"})
    found = found.join(roots, "fp", "left").withColumn("g", F.coalesce("g", "fp"))
    me = F.struct("doc_id", "fp", "row")
    marked = cut(found.join(found.groupBy("g").agg(F.min(me).alias("kept")), "g").select("doc_id", "row", "n", me.eqNullSafe(F.col("kept")).alias("kept")))
    gone = written(marked.where("not kept").select("doc_id", "row"), "copies")
    twice = written(marked.where("kept and n > 1").select("doc_id", "row"), "repeated")
    rest = without(docs, gone)
    if twice.isEmpty():
        return rest
    hashed = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    d, t = rest.alias("d"), twice.alias("t")
    same = (F.col("d.doc_id").cast("long") == F.col("t.doc_id")) & row_key().eqNullSafe(F.col("t.row"))
    again = d.join(t, same, "left_semi").select("d.*").withColumn("_row", row_key())
    least = again.groupBy("doc_id", "_row").agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in hashed))).alias("_kept"))
    return without(rest, twice).unionByName(least.select("_kept.*"))
