"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms (words and character trigrams, hashed, and a few terms of its shape, weighed like all others) are weighted by
log counts and by inverse document frequencies over all documents, and projected to RANK dimensions by a singular value
decomposition of labelled rows. The labelled vectors are bounded by a parameter and broadcast; every document's cosines to
all of them are exact, computed in blocks, and its nearest ones vote by similarity. A labelled row has no vote for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm import features as T
from doclens.llm.common import labelled_sample, written
from doclens.llm.quality_rules import base_counts

#: Labelled rows of each class with a vector, at most.
SAMPLE = 2000
BITS = 12
RANK = 64
NEIGHBOURS = 25
#: Rows whose term counts stand in memory at a time, and rows whose cosines do.
ROWS, BLOCK = 128, 64
#: Tasks that hold the sample.
FITTERS = 8
#: Neighbours weigh by this power of their cosine's share of the nearest one's.
POWER = 32
THRESHOLD = 0.3
#: Hash buckets of terms, then the terms of shape.
SHAPE = 12
#: Digits that cosines are rounded to, so that they don't depend on how many rows a block has.
DIGITS = 9
DIM = (1 << BITS) + SHAPE
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_MARK = np.isin(np.arange(256), list(b"!?#*$%&|<>=@_~^+\\{}[]"))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)


class Space(NamedTuple):
    idf: np.ndarray
    #: DIM x RANK
    project: np.ndarray
    #: Labelled unit vectors, their labels, and the weight of a vote by its label.
    vectors: np.ndarray
    #: Their doc_ids, ascending.
    ids: np.ndarray
    labels: np.ndarray
    weigh: np.ndarray
    prior: float


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x DIM, the logs of counts of terms; shape terms are logs of what they measure per hundred words."""
    n, mask = len(offsets) - 1, np.uint64((1 << BITS) - 1)
    values = data.astype(np.uint64) + np.uint64(1)
    words = T.runs(~T.SPACE[data], offsets)
    h = T.span_hashes(T.prefix_sums(values), words.starts, words.ends)
    row = words.row
    out = np.bincount(row * DIM + (h & mask).astype(np.int64), minlength=n * DIM).astype(np.float32)
    tri = (T.gram_hashes(values, 3) & mask).astype(np.int64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    same = of[: len(tri)] == of[len(of) - len(tri) :]
    out += np.bincount((of[: len(tri)] * DIM + tri)[same], minlength=n * DIM)
    out = np.log1p(out.reshape(n, DIM))
    base = base_counts(data, offsets)
    before = np.zeros(len(h), bool)
    before[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    of_rows = lambda m: np.bincount(of[m], minlength=n)
    size = np.maximum(base["n_words"], 1)
    shape = [np.bincount(row[before], minlength=n), base["n_dup_lines"] * 5, base["n_repeat_words"], base["n_symbols"], of_rows(_UPPER[data]) / 5, of_rows(_MARK[data]), of_rows(_DIGIT[data]) / 5, of_rows(data == 10)]
    out[:, DIM - SHAPE : DIM - SHAPE + len(shape)] = np.log1p(100 * np.array(shape) / size).T
    out[:, DIM - 4] = 4.0 * (base["n_words"] < 3)
    out[:, DIM - 3] = 4.0 * (base["n_words"] < 20)
    out[:, DIM - 2] = np.log1p(base["word_chars"] / size)
    out[:, DIM - 1] = 4.0 * (base["n_words"] == 0)
    return out


def _document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and for each hashed term those that hold it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIM, np.int64)
        for b in T.slices(batches, rows=ROWS):
            n, df = n + b.num_rows, df + (term_counts(*T.text_buffers(b.column("text"))) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], df]))], ["term", "df"])

    got = docs.mapInArrow(work, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow().sort_by("term")
    if not got.num_rows:
        return 0, np.zeros(DIM, np.int64)
    df = got["df"].to_numpy()
    return int(df[0]), df[1:]


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _units((counts * idf).astype(np.float64))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit_space(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, seed: int = 11) -> Space | None:
    """A space from at most 2 * per_class of the labelled rows given; None without a row of each class.

    The sample's vectors stay in tasks: the decomposition is a subspace iteration whose products are summed over tasks, and what
    reaches the driver are matrices of RANK + 16 columns.
    """
    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    docs = docs.select("doc_id", F.col("text").cast("string"))
    texts = docs.join(F.broadcast(labelled_sample(labels, "quality", per_class)), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches, rows=ROWS):
            x = term_counts(*T.text_buffers(b.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    in_order = texts.repartition(FITTERS, "doc_id").sortWithinPartitions("doc_id")
    rows = written(in_order.mapInArrow(work, "doc_id long, label int, x binary"), "sample")
    y = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(y) < 2:
        return None
    n, df = _document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + 0.1
    q = np.random.default_rng(seed).standard_normal((DIM, RANK + 16))
    for _ in range(4):  # subspace iteration
        q, _ = np.linalg.qr(_gram_times(rows, idf, q))
    seen = _projected(rows, idf, q)
    _, _, v = np.linalg.svd(seen.x, full_matrices=False)
    ones = y[1] / (y[0] + y[1])
    prior = sizes[1] / (sizes[0] + sizes[1])
    return Space(idf, np.ascontiguousarray(q @ v[:RANK].T), _units(seen.x @ v[:RANK].T), seen.ids, seen.labels, np.array([(1 - prior) / (1 - ones), prior / ones], np.float32), prior)


class Sample(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], idf: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Weighted unit vectors of the sample's rows, ROWS at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            yield b, _weighted(np.frombuffer(b"".join(b.column("x").to_pylist()), np.float16).reshape(-1, DIM).astype(np.float32), idf)


def _gram_times(rows: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X'Xq for the sample's vectors X, summed over tasks."""
    held = rows.sparkSession.sparkContext.broadcast((idf, q))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(q.shape)
        for _, x in _blocks(batches, held.value[0]):
            total += x.T @ (x @ held.value[1])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["x"])

    out = np.zeros(q.shape)
    for part in rows.mapInArrow(work, "x binary").toArrow()["x"]:  # FITTERS matrices at most
        out += np.frombuffer(part.as_buffer()).reshape(q.shape)
    held.destroy()
    return out


def _projected(rows: DataFrame, idf: np.ndarray, q: np.ndarray) -> Sample:
    """The sample's rows in the space of q, by doc_id."""
    held = rows.sparkSession.sparkContext.broadcast((idf, q))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, held.value[0]):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([r.tobytes() for r in x @ held.value[1]], pa.binary())], ["doc_id", "label", "x"])

    got = rows.mapInArrow(work, "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    held.destroy()
    return Sample(got["doc_id"].to_numpy(), got["label"].to_numpy().astype(np.float32), np.frombuffer(b"".join(got["x"].to_pylist())).reshape(got.num_rows, -1))


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """The places of each row's k greatest cosines; of equal ones at the edge the first."""
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(cos, near, axis=1).min(axis=1, keepdims=True)
    for row in np.flatnonzero((cos >= edge).sum(axis=1) > k):
        near[row] = np.argsort(-cos[row], kind="stable")[:k]
    return near


def votes(space: Space, data: np.ndarray, offsets: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The share of label 1 in the votes on each text; ids are the rows' own."""
    v = _units(_weighted(term_counts(data, offsets), space.idf) @ space.project)
    mine = np.asarray(pc.fill_null(ids, -1), np.int64)
    place = np.searchsorted(space.ids, mine)
    place[place == len(space.ids)] = 0
    own = (space.ids[place] == mine) & ~np.asarray(pc.is_null(ids))
    out, k = np.empty(len(v)), min(NEIGHBOURS, len(space.labels))
    for at in range(0, len(v), BLOCK):
        cos = np.round(v[at : at + BLOCK] @ space.vectors.T, DIGITS)
        known = np.flatnonzero(own[at : at + BLOCK])
        cos[known, place[at : at + BLOCK][known]] = -2
        near = nearest(cos, k)
        found = np.take_along_axis(cos, near, axis=1)
        near_by = np.clip(found, 1e-3, 1)
        w = np.where(found == -2, 0, (near_by / near_by.max(axis=1, keepdims=True)) ** POWER)
        label = space.labels[near]
        w = w * space.weigh[label.astype(np.int64)]
        out[at : at + BLOCK] = ((w * label).sum(axis=1) + 1e-12 * space.prior) / (w.sum(axis=1) + 1e-12)
    return out


def score(docs: DataFrame, space: Space | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs, from its whole text; score is an estimate of P(quality = 1).

    A null text counts as empty; an empty one has only its terms of shape. Of equally near neighbours at the edge of the k
    nearest those with the least doc_ids vote. Repeated rows come out repeated, other columns aren't read.
    Without a space (no labels of one class) every score is 0.5.
    """
    held = docs.sparkSession.sparkContext.broadcast(space)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for b in T.slices(batches, rows=ROWS):
            p = np.clip(votes(s, *T.text_buffers(b.column("text")), b.column("doc_id")), 0, 1) if s else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, space: Space | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose score reaches the threshold; scored as by score()."""
    held, names = docs.sparkSession.sparkContext.broadcast(space), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = held.value
        for b in T.slices(batches, rows=ROWS):
            yield b.filter(pa.array(votes(s, *T.text_buffers(b.column("text")), b.column("doc_id").cast(pa.int64())) >= threshold)) if s else b

    return docs.select(names).mapInArrow(work, docs.schema)


def held_out(col: str = "doc_id"):
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(False))
