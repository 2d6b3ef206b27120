"""Toxicity by a classifier chain.

Each category has a linear model over hashed n-grams and the probabilities of the categories before it; those come from
models that hadn't seen the row (out of fold) when the next one is fitted. The labels know only toxic or not, so the
earlier categories are its rows that hold a word of the category (SEEDS); the last category is the label itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm import features as T
from doclens.llm import linear as L
from doclens.llm.common import labelled_sample

#: Labelled rows of each class that the chain is fitted on, at most.
SAMPLE = 1500
SEEDS = {
    "insult": r"(?i)\b(idiot|moron|clown|loser|stupid)\b",
    "contempt": r"(?i)\b(trash|scum|pathetic|worthless|disgusting)\b",
}
GRAMS = L.Grams(chars=(6,), words=(1,), norm=0.5)
HOW = {"l1": 0.05, "rate": 2.0, "epochs": 6}
FOLDS = 4
#: A document is toxic from this probability on.
THRESHOLD = 0.3


class Chain(NamedTuple):
    categories: list[str]
    models: list[tuple[np.ndarray, np.ndarray]]
    #: Turns the last model's log-odds into a probability.
    platt: tuple[float, float]


def _fits(spark: SparkSession, rows: Broadcast, y: np.ndarray, fold: np.ndarray, dense: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(a model of all rows, out-of-fold log-odds): each fold's model, and that of all, is fitted in a task of its own.

    `rows` are the sample's n-grams, sent once for all categories; labels and earlier probabilities go with each fit."""
    held = spark.sparkContext.broadcast((y, fold, dense))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("id").to_pylist():
                x, (label, of, more) = rows.value, held.value
                inside, outside = np.flatnonzero(of == k), np.flatnonzero(of != k)
                w, wd = L.fit([x[i] for i in outside], label[outside], 1 << GRAMS.bits, more[outside], **HOW)
                odds = L.predict([x[i] for i in inside], (w, wd), more[inside])
                kinds = [w if k < 0 else w[:0], wd, odds]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([np.asarray(v).tobytes()], pa.binary()) for v in kinds)], ["id", "w", "wd", "odds"])

    folds = [-1, *np.unique(fold).tolist()]
    jobs = spark.createDataFrame([(int(k),) for k in folds], "id long").repartitionByRange(len(folds), "id")
    got = {r["id"]: r for r in jobs.mapInArrow(work, "id long, w binary, wd binary, odds binary").toArrow().to_pylist()}
    held.destroy()
    score = np.zeros(len(y))
    for k in folds[1:]:
        score[fold == k] = np.frombuffer(got[k]["odds"])
    return (np.frombuffer(got[-1]["w"], np.float32), np.frombuffer(got[-1]["wd"])), score


def fit_chain(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Chain | None:
    """A chain fitted on at most 2 * per_class labelled rows; None without a row of each class."""
    sample = labelled_sample(labels, "toxic", per_class)
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.coalesce(F.max("text"), F.lit("")).alias("text"))
    texts = texts.withColumns({c: (F.col("label") == 1) & F.col("text").rlike(p) for c, p in SEEDS.items()})
    names, keep = [*SEEDS, "toxic"], ["doc_id", "label", *SEEDS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            yield L.sparse_batch(GRAMS, b, keep)

    kinds = ", ".join(f"{c} boolean" for c in SEEDS)
    got = texts.mapInArrow(work, f"doc_id long, label int, {kinds}, ids binary, vals binary").toArrow().sort_by("doc_id")
    if got.num_rows == 0 or len(set(got["label"].to_pylist())) < 2:
        return None
    x = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["ids"].to_pylist(), got["vals"].to_pylist())]
    fold = L.folds(got["doc_id"].to_numpy(), FOLDS)
    models, dense = [], np.zeros((len(x), 0))
    rows = docs.sparkSession.sparkContext.broadcast(x)
    for name in names:
        y = got["label" if name == "toxic" else name].to_numpy().astype(float)
        model, score = _fits(docs.sparkSession, rows, y, fold, dense)
        models.append(model)
        dense = np.column_stack([dense, L.sigmoid(score)])
    rows.destroy()
    return Chain(names, models, L.platt(score, y))


def score(docs: DataFrame, chain: Chain | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_<category> double ..., toxic boolean) for every row of docs.

    The whole text is read; a null counts as empty. An empty or very short text is scored like any other. Repeated rows
    come out repeated, other columns of docs are not read. Without a chain every probability is 0.
    """
    names = chain.categories if chain else [*SEEDS, "toxic"]
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in names) + ", toxic boolean"
    held = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for b in T.slices(batches):
            found = [np.zeros(b.num_rows)] * len(names)
            if model:
                grams = L.positions(GRAMS, *T.text_buffers(b.column("text")))
                dense = np.ones((b.num_rows, 1))
                for w, wd in model.models:
                    odds = L.weighted(GRAMS, grams, w) + dense @ wd
                    dense = np.column_stack([dense, L.sigmoid(odds)])
                found = [*dense[:, 1:-1].T, L.sigmoid(model.platt[0] * odds + model.platt[1])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, found), pa.array(found[-1] >= threshold)], ["doc_id", *(f"p_{c}" for c in names), "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)
