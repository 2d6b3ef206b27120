import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from doclens.llm import token_pack as K
from doclens.llm.common import new_path

WORDS = "word_bpe_49k.json"


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 32), st.integers(0, 200), st.data())
def test_packing(bits, n, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), min_size=n, max_size=n)), np.uint32)
    packed = K.pack(ids, bits)
    assert len(packed) == -(-n * bits // 8)
    a = data.draw(st.integers(0, n))
    z = data.draw(st.integers(a, n))
    assert (K.unpack(packed, bits, a, z) == ids[a:z]).all()


@pytest.mark.parametrize("size, bits", [(1, 1), (2, 1), (3, 2), (49408, 16), (65536, 16), (65537, 17)])
def test_width(size, bits):
    assert K.width(size) == bits


#: Letters, and special tokens in every case and in parts.
PIECES = st.one_of(
    st.text(alphabet="abCÉſΣİ'.,!-#1 \n\t\u0301漢<|>", max_size=12),
    st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|StartOfText|>", "<|endoftext", "endoftext|>", " <|endoftext|> ", "<|\nendoftext|>", "x<|endoftext|>.", "É<|endoftext|>É"]),
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=5).map("".join), min_size=1, max_size=5))
def test_words_encode_as_whole_texts(path_texts):
    same_as_library(path_texts)


def test_special_tokens_count_in_their_own_case_only():
    same_as_library(["<|ENDOFTEXT|>", "<|EndOfText|> a", "<|endoftext|>", "A <|endoftext|>B", "Plain Words, here."])


def same_as_library(path_texts):
    from doclens.llm.queries import tokenizer_path

    ids, first = K.encoder(tokenizer_path(WORDS)).encode(path_texts, 2)
    library = Tokenizer.from_file(tokenizer_path(WORDS))
    for k, t in enumerate(path_texts):
        assert ids[first[k] : first[k + 1]].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_files(spark, sf, path, block):
    docs = sf["documents"].where("doc_id < 150").repartition(3)
    out = new_path(spark, "t")
    K.write_packed(docs, out, path(WORDS), 49408, block=block)
    library, n = Tokenizer.from_file(path(WORDS)), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in K.read_packed(spark, out).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        assert got[r.doc_id] == (n, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        n += len(ids)
    one = K.Block(spark.read.parquet(out).orderBy("shard", "block").first().payload)
    assert (np.concatenate([one[k] for k in range(len(one.doc_ids))]) == one.all()).all()


def test_edges(spark, edges, none, path):
    """Null ids first, equal ids in the order of their texts' hashes, null and empty texts as the end id alone."""
    library = Tokenizer.from_file(path(WORDS))
    out = new_path(spark, "t")
    K.write_packed(edges, out, path(WORDS), 49408)
    rows = sorted(K.read_packed(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6, 7]
    texts = {r.doc_id: r.text or "" for r in edges.collect()}
    at = 0
    for r in rows:
        ids = [*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert [r.n_tokens for r in rows[1:4]] == [1, 1, 1]
    out = new_path(spark, "t")
    K.write_packed(none, out, path(WORDS), 49408)
    assert K.read_packed(spark, out).collect() == []


def test_different_texts_of_one_id_are_in_the_order_of_their_hashes(spark, docs_of, path):
    texts = ["one", "two two", "three three three"]
    out = new_path(spark, "t")
    K.write_packed(docs_of(*((5, t) for t in texts)), out, path(WORDS), 49408)
    order = [r.text for r in docs_of(*((5, t) for t in texts)).selectExpr("text", "xxhash64(text) AS h").orderBy("h").collect()]
    got = sorted(K.read_packed(spark, out).collect(), key=lambda r: r.start)
    assert [r.n_tokens - 1 for r in got] == [len(t.split()) for t in order]
