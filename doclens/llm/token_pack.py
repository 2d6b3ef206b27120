"""Token ids in fixed-width bit packing.

A file is a Parquet table of blocks, written by Spark's own writer (so a lost executor's work is done again and only
committed files count) in ascending doc_id order. A block's payload stands on its own:

    b"FWBP", bits, documents n, ids m (little-endian uint32 each), doc_ids (int64 * n), first id of each document
    (uint32 * (n + 1)), then the ids, `bits` bits each, lowest bit first, without gaps.

As every id has the same width, id i begins at bit i * bits: any range is unpacked by one numpy expression without
reading what stands before it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.llm.features import slices

MAGIC = b"FWBP"
END_ID = 2
#: Ids in a block before the next one is begun; a document isn't split.
BLOCK = 1 << 20
#: Words whose ids a worker remembers.
REMEMBERED = 500_000
#: Before punctuation at the end of a word; it never joins with the letter before it (so no apostrophe, and only letters that
#: stay one letter when composed and in lower case).
_TAIL = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-įı-ɏ])(?=[.,;:!?*#$%&|]+(?: |$))")
BLOCKS = "shard int, block int, shard_start long, n_docs long, n_ids long, payload binary"


def width(vocab_size: int) -> int:
    """The least number of bits that holds every id."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of 8 ids fills whole bytes
        part = ids[at : at + (1 << 16)].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(part, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes())
    return b"".join(out)


def unpack(raw: bytes | memoryview, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids begin to end (exclusive) of a packed run, as uint32."""
    if end <= begin:
        return np.zeros(0, np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", end - begin, begin * bits // 8).astype(np.uint32)
    low = begin * bits // 8
    part = np.frombuffer(raw, np.uint8, -(-end * bits // 8) - low, low)
    flat = np.unpackbits(part, bitorder="little")[begin * bits - 8 * low :][: (end - begin) * bits].reshape(-1, bits)
    full = np.zeros((len(flat), 32), np.uint8)
    full[:, :bits] = flat
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def make_block(doc_ids: np.ndarray, first: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    return MAGIC + struct.pack("<3I", bits, len(doc_ids), len(ids)) + doc_ids.astype("<i8").tobytes() + first.astype("<u4").tobytes() + pack(ids, bits)


class Block:
    """Random access to a block's documents."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of packed ids")
        self.bits, n, self.n_ids = struct.unpack_from("<3I", payload, 4)
        self.doc_ids = np.frombuffer(payload, "<i8", n, 16)
        self.first = np.frombuffer(payload, "<u4", n + 1, 16 + 8 * n)
        self._packed = memoryview(payload)[16 + 8 * n + 4 * (n + 1) :]

    def __getitem__(self, k: int) -> np.ndarray:
        return unpack(self._packed, self.bits, int(self.first[k]), int(self.first[k + 1]))

    def all(self) -> np.ndarray:
        return unpack(self._packed, self.bits, 0, self.n_ids)


class WordEncoder:
    """Encodes texts by the words between spaces and line breaks, each encoded once by the library and remembered.

    Exact for a vocabulary that drops white space and never merges across it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.library.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first = [0, 0]

    def _store(self, word: str, ids: np.ndarray | list[int]) -> None:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.number[word] = len(self.number)
        self.first.append(self.used)

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters only are one pre-token each, whose last id is one that ends a word."""
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                self._learn_any(part)
                continue
            for word, a, b in zip(part, [0, *ends.tolist()], ends.tolist()):
                self._store(word, ids[a:b])

    def _learn_any(self, words: list[str]) -> None:
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            for word, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                self._store(word, e.ids)

    def _learn(self, words: set[str]) -> None:
        letters = {w for w in words if w.isalpha()}
        self._learn_letters(sorted(letters))
        self._learn_any(sorted(words - letters))

    @staticmethod
    def _apart(text: str) -> list[str]:
        """The text in parts whose ids, one after the other, are the text's: at spaces, line breaks and before a run of
        punctuation that ends a word. Latin-1 letters lose their case here, as they would in the library, but not where a
        special token may stand: the library looks for those before it takes the case away."""
        text = text.replace("\n", " ")
        if "<|" in text:
            return text.split(" ")
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:  # case there may depend on what stands around a letter
            pass
        return _TAIL.sub(" ", text).split(" ")

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with end_id; the first of each text, one more at the end)."""
        if len(self.number) > REMEMBERED:
            self.forget()
        split = [self._apart(t) for t in texts]
        every = [*chain.from_iterable(split)]
        if new := set(every).difference(self.number):
            self._learn(new)
        words = np.fromiter(map(self.number.__getitem__, every), np.int64, len(every))
        first = np.array(self.first, np.int64)
        begin, size = first[words], first[words + 1] - first[words]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - before[:-1], size) + np.arange(before[-1])]
        ends = before[np.cumsum([len(s) for s in split])]
        return np.insert(ids, ends, end_id), np.concatenate([[0], ends + np.arange(1, len(texts) + 1)])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_packed(docs: DataFrame, path: str, tokenizer: str, vocab_size: int, end_id: int = END_ID, block: int = BLOCK) -> None:
    """Encodes every row of docs(doc_id, text) and writes blocks to `path`, in ascending order of doc_id.

    Rows with one doc_id stand in the order of their texts' hashes; null doc_ids come first (kept as the least integer);
    a null text has the end id only. An empty table gives a table of no blocks.
    """
    bits = width(vocab_size)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, number = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block_of() -> pa.RecordBatch:
            doc_ids, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[2] for h in held])
            base = np.concatenate([[0], np.cumsum([len(h[2]) for h in held])])
            first = np.concatenate([*(h[1][:-1] + b for h, b in zip(held, base)), base[-1:]])
            row = [[shard], [number], [before], [len(doc_ids)], [len(ids)], [make_block(doc_ids, first, ids, bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "block", "shard_start", "n_docs", "n_ids", "payload"])

        for b in slices(batches):
            ids, first = encoder(tokenizer).encode(b.column("text").to_pylist(), end_id)
            held.append((np.asarray(b.column("doc_id")), first, ids))
            if sum(len(h[2]) for h in held) >= block:
                yield (out := block_of())
                before, number = before + out.column("n_ids")[0].as_py(), number + 1
                held.clear()
        if held:
            yield block_of()

    rows.mapInArrow(work, BLOCKS).write.parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the blocks at `path`, from unpacking them."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each task that wrote
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    placed = blocks.join(F.broadcast(totals), "shard").select((F.col("before") + F.col("shard_start")).alias("start"), "payload")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, payload in zip(b.column("start").to_pylist(), b.column("payload")):
                block = Block(payload.as_py())
                raw, first = memoryview(block.all().astype("<u4").tobytes()), block.first.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist())]
                null = block.doc_ids == -(1 << 63)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, mask=null), pa.array(start + first[:-1]), pa.array(np.diff(first)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
