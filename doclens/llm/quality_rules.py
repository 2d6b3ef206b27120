"""Quality rules: base counts of each text, and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm import features as T
from doclens.llm import linear as L
from doclens.llm.common import labelled_sample

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 1500
GRAMS = L.Grams(chars=(3,), words=(1, 2), norm=0.5, lower=False, wordy=False)
HOW = {"l1": 0.01, "rate": 0.2}
FOLDS = 2
#: A text that passes the base rules is kept from this probability of quality 1 on.
KEEP = 0.3
MIN_WORDS = 20
#: Per cent of the words that may stand in repeated windows.
MAX_REPEATED = 30
WINDOW = 8
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LEAD = (np.arange(256) & 0xC0) != 0x80


class Model(NamedTuple):
    weights: np.ndarray
    dense: np.ndarray
    platt: tuple[float, float]
    #: Added to the calibrated log-odds: the sample holds as many rows of each class, the labels don't.
    prior: float


def sums(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def same_bytes(data: np.ndarray, spans: T.Spans, first: np.ndarray) -> bool:
    """Whether each span has the bytes of the span that `first` names for it."""
    size = spans.ends - spans.starts
    if not np.array_equal(size, size[first]):
        return False
    other = np.flatnonzero(first != np.arange(len(first)))
    ends = np.cumsum(size[other])
    begin = 0
    while begin < len(other):  # so many bytes at a time
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + T.CHUNK, "right")))
        some = other[begin:end]
        within = np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        if not np.array_equal(data[np.repeat(spans.starts[some], size[some]) + within], data[np.repeat(spans.starts[first[some]], size[some]) + within]):
            return False
        begin = end
    return True


def identities(data: np.ndarray, spans: T.Spans, hashes: np.ndarray) -> np.ndarray:
    """A number for each span, equal for those of equal bytes only: by their hashes if these are right, else by the bytes."""
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    if same_bytes(data, spans, first[back]):
        return back
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(data[a:z].tobytes(), len(known)) for a, z in zip(spans.starts, spans.ends)], np.int64)


def occurrences(row: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows and rows of ids(place, part), the first place with the same, and how many there are."""
    h = T.mix(row.astype(np.uint64) + np.uint64(1))
    for k in range(ids.shape[1]):
        h = T.mix(h + ids[:, k].astype(np.uint64) + np.uint64(1))
    _, first, back, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    first = first[back]
    if not (np.array_equal(row, row[first]) and np.array_equal(ids, ids[first])):
        _, first, back, count = np.unique(np.column_stack([row, ids]), axis=0, return_index=True, return_inverse=True, return_counts=True)
        first = first[back.reshape(-1)]
        back = back.reshape(-1)
    return first, count[back]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; equal lines and windows are told by their
    hashes, and these are compared by their bytes."""
    n_rows, inside = len(offsets) - 1, ~T.SPACE[data]
    words = T.runs(inside, offsets)
    prefix = T.prefix_sums(data.astype(np.uint64) + np.uint64(1))
    out = {"n_words": np.diff(words.first), "word_chars": sums(inside & _LEAD[data], offsets), "n_symbols": sums(_SYMBOL[data], offsets)}
    lines = T.runs(data != 10, offsets)
    # a run of non-breaks may be followed by breaks only, so what reduceat adds up to the next start is the line's own
    full = np.add.reduceat(inside, lines.starts, dtype=np.int64) > 0 if len(lines.starts) else np.zeros(0, bool)
    row, written = lines.row[full], T.Spans(lines.starts[full], lines.ends[full], lines.first)
    line = identities(data, written, T.span_hashes(prefix, written.starts, written.ends))
    first, _ = occurrences(row, line[:, None])
    out["n_dup_lines"] = np.bincount(row[first != np.arange(len(first))], minlength=n_rows)
    word, row = identities(data, words, T.span_hashes(prefix, words.starts, words.ends)), words.row
    n = max(0, len(word) - WINDOW + 1)
    at = np.flatnonzero(row[:n] == row[WINDOW - 1 :][:n])
    _, count = occurrences(row[at], word[at[:, None] + np.arange(WINDOW)])
    at = at[count > 1]
    step = np.bincount(at, minlength=len(word) + 1) - np.bincount(at + WINDOW, minlength=len(word) + 1)
    out["n_repeat_words"] = sums(np.cumsum(step)[:-1] > 0, words.first)
    return {k: v.astype(np.int64) for k, v in out.items()}


def fit_model(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Model | None:
    """A model fitted on at most 2 * per_class labelled rows, calibrated out of fold; None without a row of each class."""
    one = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in one.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(labelled_sample(labels, "quality", per_class)), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            yield L.sparse_batch(GRAMS, b, ["doc_id", "label"])

    got = texts.mapInArrow(work, "doc_id long, label int, ids binary, vals binary").toArrow().sort_by("doc_id")
    y = got["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    x = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["ids"].to_pylist(), got["vals"].to_pylist())]
    held = L.out_of_fold(x, y, L.folds(got["doc_id"].to_numpy(), FOLDS), 1 << GRAMS.bits, **HOW)
    prior = np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (1 - y).sum())
    return Model(*L.fit(x, y, 1 << GRAMS.bits, **HOW), L.platt(held, y), float(prior))


def apply_rules(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, p_quality, kept) of every row.

    Whole texts; a null has no words, fails the base rules and isn't kept, like an empty one. Lines end at \\n. Repeated
    rows come out repeated and other columns of docs are not read. Without a model the base rules alone decide and
    p_quality is null.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in T.slices(batches):
            data, offsets = T.text_buffers(b.column("text"))
            base = base_counts(data, offsets)
            failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED * base["n_words"])
            p = np.full(b.num_rows, np.nan)
            if m:
                odds = L.weighted(GRAMS, L.positions(GRAMS, data, offsets), m.weights) + m.dense[0]
                p = L.sigmoid(m.platt[0] * odds + m.platt[1] + m.prior)
            kept = ~failed & ((p >= keep) | np.isnan(p))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(base[k]) for k in names), pa.array(failed), pa.array(p, mask=np.isnan(p)), pa.array(kept)],
                ["doc_id", *names, "base_failed", "p_quality", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, p_quality double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
