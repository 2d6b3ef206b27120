"""Language-model scores by online logistic mixing of hashed-context bit predictors.

A text is predicted bit by bit: its UTF-8 bytes, A-Z in lower case, then one end byte that no text holds. Each predictor has a
context (the last 2 or 4 bytes, or the word so far) whose hash, with the bits of the byte already seen, names a place of
its table; how often zeros and ones followed there, in all training texts of the corpus, is its prediction, as log-odds. A gate,
the last context in the list that training has seen, chooses one of several sets of weights; the weighted sum of log-odds is
the mixed prediction. A last stage refines the mixed probability by what it has come to mean for this bit of a byte within the
text so far. Weights and refinement learn from each byte before the next one. The bits' costs add up to the text's score.

Counts are gathered in tasks, each with tables of fixed size, and summed by pieces of a table; texts are scored in lanes, one
byte of all lanes at a time. So that a very long text takes no longer than others, weights and refinement begin anew every
BLOCK bytes; contexts reach across.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm import features as T
from doclens.llm.common import written

#: Bytes of each context; 0 is the word so far.
ORDERS = (2, 4, 0)
LONGEST = max(ORDERS)
#: The byte after each text, and those before it.
END, BEFORE = 0xFF, 0x00
#: A table has 2^bits places: one for about so many bytes of training, within these bounds, which bound a worker's memory.
BYTES_A_SLOT, LEAST_BITS, MOST_BITS = 128, 16, 20
#: Training bytes for each task, at least; slots in a piece of a table.
TASK_BYTES, PIECE = 48 << 20, 1 << 14
#: Added to a slot's zeros and ones; log-odds are kept within a bound as signed bytes.
PRIOR, MOST_ODDS = 0.4, 8.0
SCALE = 127 / MOST_ODDS
#: Bytes after which weights begin anew; bytes of text in lanes at a time; bytes whose predictions are looked up at a time.
BLOCK, SLICE, WINDOW = 2048, 2 << 20, 32
#: Texts worked on at a time, at most.
MOST_ROWS = 1 << 14
#: Steps of the weights and of the refinement, the steps between refined values, and the share of the refined value.
RATE, REFINE_RATE, REFINE_STEPS, REFINED = 0.005, 0.03, 24, 0.75
#: The weights of the gate's own context and of the others, before learning.
LEADS, REST = 0.45, 0.35
#: Words with at least this share of all tokens are looked up by broadcast; there are at most 1 / SHARE of them.
SHARE = 4e-6
#: Distinct words that a task holds before it passes their counts on.
FLUSH = 200_000
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def held_out() -> Column:
    """Rows that nothing is learnt from: those whose crc32 of doc_id has a remainder of 2 by 7. Without a doc_id, none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 7 == 2, F.lit(False))


class Flat(NamedTuple):
    """Texts one after another, each between BEFORE bytes and an END byte."""

    data: np.ndarray
    #: Where each text's first byte stands, and how many bytes it has with the END.
    start: np.ndarray
    size: np.ndarray
    #: For each byte the hash of the word before it, as far as it goes.
    word: np.ndarray


def flat(col: pa.Array) -> Flat:
    raw, offsets = T.text_buffers(col)
    n, size = len(offsets) - 1, np.diff(offsets) + 1
    start = np.cumsum(size + LONGEST) - size
    data = np.full(int((size + LONGEST).sum()), BEFORE, np.uint8)
    data[np.repeat(start - offsets[:-1], size - 1) + np.arange(len(raw))] = T.LOWER[raw]
    data[start + size - 1] = END
    inside = ~T.SPACE[data] & (data != BEFORE) & (data != END)
    # a byte's word begins after the last byte that is in no word
    last = np.maximum.accumulate(np.where(inside, 0, np.arange(1, len(data) + 1)))
    begin = np.concatenate([[0], last[:-1]]) if len(data) else last
    sums = T.prefix_sums(data.astype(np.uint64) + np.uint64(1))
    word = T.span_hashes(sums, begin, np.arange(len(data))) if len(data) else np.zeros(0, np.uint64)
    return Flat(data, start, size, word)


def context_hashes(f: Flat, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each predictor, the hashes of the contexts of the bytes at these places."""
    seen = [f.data[at - j].astype(np.uint64) for j in range(1, LONGEST + 1)]
    for k in ORDERS:
        if k == 0:
            yield f.word[at] ^ _M[2]
            continue
        h = np.full(at.shape, k, np.uint64)
        for j in range(k):
            h = (h + seen[j] + np.uint64(1)) * _M[0]
            h ^= h >> np.uint64(29)
        yield h


def places_of(h: np.ndarray, byte: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """For each half of a byte, the higher one first, its place in a table: the line of sixteen that its context and, for the
    lower half, the higher one name, and in it the half byte."""
    shift, mask = np.uint64(64 - bits), np.uint64(((1 << bits) - 1) & ~15)
    high = (byte >> 4).astype(np.uint64)
    yield (((h * _M[2]) >> shift) & mask | high).astype(np.int64)
    yield (((h + (high + np.uint64(1)) * _M[1]) * _M[2] >> shift) & mask | (byte & 15).astype(np.uint64)).astype(np.int64)


# ---- counts of the corpus


def table_bits(training: DataFrame) -> int:
    total = training.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("b")).collect()[0]["b"]
    return min(max(int(total // BYTES_A_SLOT).bit_length(), LEAST_BITS), MOST_BITS)


def count_halves(f: Flat, counts: np.ndarray) -> None:
    """Adds all texts' half bytes to counts(predictor, place): a bit's zeros and ones are sums of these."""
    edge = np.bincount(f.start, minlength=len(f.data) + 1) - np.bincount(f.start + f.size, minlength=len(f.data) + 1)
    at = np.flatnonzero(np.cumsum(edge)[:-1])
    bits, byte = counts.shape[1].bit_length() - 1, f.data[at]
    for k, h in enumerate(context_hashes(f, at)):
        where = np.concatenate([*places_of(h, byte, bits)])
        counts[k] += np.bincount(where, minlength=counts.shape[1]).astype(np.int32)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """(place, 4): for each half byte of a line, the log-odds with which its four bits, one after the other, are foretold to be
    one, as signed bytes; from counts of half bytes."""
    halves = counts.reshape(-1, 16)
    out = np.zeros((*halves.shape, 4), np.int8)
    for depth in range(4):
        sides = halves.reshape(-1, 1 << depth, 2, 8 >> depth).sum(axis=3)
        odds = np.log((sides[:, :, 1] + PRIOR) / (sides[:, :, 0] + PRIOR))
        out[:, :, depth] = np.repeat(np.rint(np.clip(odds, -MOST_ODDS, MOST_ODDS) * SCALE), 16 >> depth, axis=1)
    return out.reshape(-1, 4)


def narrow(x: np.ndarray) -> bytes:
    """Counts in as few bytes as they need; the first byte says how many."""
    size = 1 if (top := x.max()) < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def widen(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def odds_tables(training: DataFrame, bits: int) -> np.ndarray:
    """(predictor, place, 4): the log-odds from the counts of all training texts; 0 where there is none.

    Each task sends the pieces of its tables that hold anything, in as few bytes as their counts need; what is summed for a
    piece is one row from each task. The tables that reach the driver have four bytes for each place.
    """
    pieces = max(1, (1 << bits) // PIECE)
    tasks = training.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    tasks = max(training.sparkSession.sparkContext.defaultParallelism, int(tasks // TASK_BYTES))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(ORDERS), 1 << bits), np.int32)
        for b in T.slices(batches, most=SLICE // 8):
            count_halves(flat(b.column("text")), counts)
        for k, row in enumerate(counts.reshape(len(ORDERS), pieces, -1)):
            full = np.flatnonzero(row.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array((k * pieces + full).astype(np.int32)), pa.array([narrow(row[p]) for p in full], pa.binary())], ["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, c in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist()):
                total[p] = total[p] + widen(c) if p in total else widen(c)
        for p, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([log_odds(c).tobytes()], pa.binary())], ["piece", "odds"])

    parts = training.select("text").coalesce(tasks).mapInArrow(gather, "piece int, counts binary")
    got = parts.repartition("piece").mapInArrow(add, "piece int, odds binary").toArrow()
    out = np.zeros((len(ORDERS) * pieces, (4 << bits) // pieces), np.int8)
    for p, o in zip(got["piece"].to_pylist(), got["odds"]):
        out[p] = np.frombuffer(o.as_buffer(), np.int8)
    return out.reshape(len(ORDERS), 1 << bits, 4)


# ---- scores of texts


def first_weights() -> np.ndarray:
    """(gate, predictor); gate 0 has seen no context."""
    w = np.full((len(ORDERS) + 1, len(ORDERS)), REST, np.float32)
    w[np.arange(1, len(ORDERS) + 1), np.arange(len(ORDERS))] = LEADS
    return w


def added(rows: np.ndarray) -> np.ndarray:
    """The sum of rows, one after another, so that a lane's sum doesn't depend on how many lanes there are."""
    out = rows[0].copy()
    for row in rows[1:]:
        out += row
    return out


def bits_of(f: Flat, tables: np.ndarray) -> np.ndarray:
    """The bits that each text takes."""
    n_parts = -(-f.size // BLOCK)
    of = np.repeat(np.arange(len(f.size)), n_parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
    begin, size = f.start[of] + nth * BLOCK, np.minimum(BLOCK, f.size[of] - nth * BLOCK)
    order = np.argsort(-size, kind="stable")  # lanes that end first stand last
    begin, size, of = begin[order], size[order], of[order]
    n, gates = len(of), len(ORDERS) + 1
    bits, cost = tables.shape[1].bit_length() - 1, np.zeros(n)
    packed = tables.view(np.int32)[:, :, 0]  # a half byte's four predictions are read at once
    weights = np.ascontiguousarray(np.tile(first_weights(), (n, 1)).T)
    # each stretch between two refined values has both of them, as one number of 64 bits
    knots = (1 / (1 + np.exp(-np.linspace(-MOST_ODDS, MOST_ODDS, REFINE_STEPS + 1)))).astype(np.float32)
    refined = np.tile(np.ascontiguousarray(np.column_stack([knots[:-1], knots[1:]])).view(np.int64)[:, 0], 8 * n)
    own = (np.arange(8 * n, dtype=np.int32) * REFINE_STEPS).reshape(8, n)
    edge, per, rate, step, part = (np.float32(v) for v in (MOST_ODDS - 1e-3, REFINE_STEPS / (2 * MOST_ODDS), RATE, REFINE_RATE, REFINED))
    for at in range(0, int(size[0]) if n else 0, WINDOW):
        live = int(np.searchsorted(-size, -at))  # lanes with a byte at this place
        span = min(WINDOW, int(size[0]) - at)
        places = np.minimum(begin[:live] + at + np.arange(span)[:, None], len(f.data) - 1)  # beyond a lane's end nothing is counted
        byte = f.data[places]
        x = np.empty((span, len(ORDERS), 8, live), np.float32)
        gate = np.zeros((span, live), np.int64)
        for j, h in enumerate(context_hashes(f, places)):
            for half, s in enumerate(places_of(h, byte, bits)):
                odds = packed[j].take(s).view(np.int8).reshape(span, live, 4)
                for b in range(4):
                    np.multiply(odds[:, :, b], np.float32(1 / SCALE), out=x[:, j, 4 * half + b])
                if half == 0:
                    gate[odds[:, :, 0] != 0] = j + 1
        ones = (byte[:, None] >> np.arange(7, -1, -1, dtype=np.uint8)[:, None] & 1).astype(np.float32)
        zeros, won = 1 - ones, np.ones((span, 8, live), np.float32)
        room = np.empty((5, 8, live), np.float32)
        for t in range(span):
            m = int(np.searchsorted(-size, -(at + t)))
            if not m:
                break
            xs, one, (mixed, p, share, q, spare) = x[t, :, :, :m], ones[t, :, :m], room[:, :, :m]
            row = np.arange(m) * gates + gate[t, :m]
            w = weights[:, row]
            np.multiply(w[0], xs[0], out=mixed)
            for k in range(1, len(ORDERS)):
                mixed += np.multiply(w[k], xs[k], out=spare)
            np.clip(mixed, -edge, edge, out=mixed)
            np.exp(np.negative(mixed, out=p), out=p)
            p += 1
            np.reciprocal(p, out=p)
            missed = np.subtract(one, p, out=q)
            for k in range(len(ORDERS)):
                w[k] += rate * added(np.multiply(missed, xs[k], out=spare))
            weights[:, row] = w
            mixed += np.float32(MOST_ODDS)
            mixed *= per
            np.floor(mixed, out=spare)
            np.subtract(mixed, spare, out=share)
            cell = spare.astype(np.int32)
            cell += own[:, :m]
            ends = refined.take(cell)
            left, right = np.moveaxis(ends.view(np.float32).reshape(8, m, 2), 2, 0)
            np.subtract(right, left, out=q)
            q *= share
            q += left
            q -= p
            q *= part
            q += p
            np.subtract(zeros[t, :, :m], q, out=won[t, :, :m])  # q of a one, 1 - q of a zero, but for the sign
            share *= step
            np.subtract(step, share, out=spare)
            left += np.multiply(np.subtract(one, left, out=q), spare, out=q)
            right += np.multiply(np.subtract(one, right, out=q), share, out=q)
            refined[cell] = ends
        cost[:live] -= added(np.log2(np.abs(won, out=won), out=won).reshape(-1, live).astype(np.float64))
    return np.bincount(of, cost, len(f.size))


# ---- words


def words(text: str | None) -> list[bytes]:
    """A text's words, A-Z in lower case, parted by what is white space in ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_counts(training: DataFrame) -> DataFrame:
    """(word binary, n): the tokens of all training texts; the end has the empty word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column("text"):
                seen.update(words(text.as_py()))
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    return training.select("text").mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row of docs.

    Whole texts are learnt from and scored; a null is empty, and of an empty text the end alone is scored. score is the log10 of
    the model's probability of the text's bytes and its end, bits_per_byte the same by bytes, the end among them. Rows without a
    doc_id are not held out. Repeated rows count as often as they stand and come out each. Other columns are not read. Without a
    training row N and V are 0 and bits are foretold by refinement alone.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), held_out().alias("held_out"))
    training = rows.where(~F.col("held_out"))
    vocabulary = written(word_counts(training), "words")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).collect()[0]
    # no more words than 1 / SHARE can have that share of all tokens
    frequent = vocabulary.where(F.col("n") >= max(1.0, SHARE * total["n"])).toArrow()
    sc = docs.sparkSession.sparkContext
    held: Broadcast = sc.broadcast((odds_tables(training, table_bits(training)), dict(zip(frequent["word"].to_pylist(), np.log10(frequent["n"].to_numpy() + 1.0).tolist()))))
    least = float(np.log10(total["n"] + total["v"] + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, known = held.value
        for b in T.slices(batches, most=SLICE, rows=MOST_ROWS):
            f = flat(b.column("text"))
            cost = bits_of(f, tables)
            n_tokens, n_known, sums, words_, times, ends = [], [], [], [], [], [0]
            for text in b.column("text"):
                counted = Counter(words(text.as_py()))
                counted[b""] = 1
                n_tokens.append(counted.total())
                some, add = 0, 0.0
                for w, n in counted.items():
                    if (log := known.get(w)) is None:
                        words_.append(w)
                        times.append(n)
                    else:
                        some += n
                        add += n * log
                n_known.append(some)
                sums.append(add)
                ends.append(len(words_))
            rare = pa.StructArray.from_arrays([pa.array(words_, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare), pa.array(cost), pa.array(f.size.astype(np.int64))],
                ["doc_id", "held_out", "n_tokens", "known", "sum", "rare", "bits", "n_bytes"],
            )

    scored = written(rows.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, known long, sum double, rare array<struct<word:binary,n:long>>, bits double, n_bytes long"), "scored")
    numbered = scored.withColumn("row", F.monotonically_increasing_id())  # within one job over a written table
    # words that aren't frequent are looked up by a shuffle, in which no word has more than SHARE of the rows
    asked = numbered.where(F.size("rare") > 0).select("row", F.inline("rare")).withColumnRenamed("n", "times")
    met = asked.join(vocabulary, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("add"))
    out = numbered.drop("rare").join(met, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total["n"])).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("add", F.lit(0.0)) - F.col("n_tokens") * F.lit(least)).alias("base_score"), (-F.col("bits") * float(np.log10(2))).alias("score"), "n_bytes", (F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )
