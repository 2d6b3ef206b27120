from itertools import product
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from doclens.llm import features as T
from doclens.llm import sp_sampling as S

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def s(path):
    return S.Sampler(path(MODEL))


def enumerate_all(s, text):
    """Every segmentation of a text with its log-probability."""
    lattices, units, _ = s.units([text])

    def of(unit):
        out = []

        def go(node, codes, logp):
            for e in range(lattices.node_first[node], lattices.node_first[node + 1]):
                nxt = [*codes, int(lattices.code[e])], logp + lattices.logp[e]
                out.append(nxt) if lattices.to[e] < 0 else go(lattices.to[e], *nxt)

        go(lattices.root[unit], [], 0.0)
        return out

    return {tuple(c for codes, _ in way for c in codes): sum(p for _, p in way) for way in product(*map(of, units))}


def by_pieces_alone(path, text):
    """Every segmentation of a text with its log-probability, from the library's list of pieces and nothing else."""
    library = sentencepiece.SentencePieceProcessor(model_file=path(MODEL))
    size = library.vocab_size()
    usual = {library.id_to_piece(i): i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    byte = {int(library.id_to_piece(i)[3:5], 16): i for i in range(size) if library.is_byte(i)}
    whole, found = "▁" + text.replace(" ", "▁"), {}

    def go(at, codes, weight):
        if at == len(whole):
            found[codes] = weight
            return
        for end in range(at + 1, len(whole) + 1):
            if (i := usual.get(whole[at:end])) is not None:
                go(end, (*codes, i), weight - np.log(S.OFFSET - library.get_score(i)))
        if whole[at] not in usual:
            raw = whole[at].encode()
            go(at + 1, (*codes, *(byte[b] for b in raw)), weight - len(raw) * np.log(size + S.OFFSET))

    go(0, (), 0.0)
    total = np.logaddexp.reduce([*found.values()])
    return {codes: weight - total for codes, weight in found.items()}


@pytest.mark.parametrize("text", ["the cat", "a   b", " x", "    ", "a\n  b", "é漢🎉 ", "ab, ab."])
def test_segmentations_are_those_of_the_pieces_alone(s, path, text):
    """Also where several spaces stand in a row, which are pieces of their own; the library's segmentation is among them."""
    ways = by_pieces_alone(path, text)
    out = s.sample([text], np.array([5], np.uint64), len(ways) + 1)
    got = {tuple(r["ids"].tolist()): r["log_prob"][0] for r in out if len(r["row"])}
    assert got.keys() == ways.keys()
    assert all(got[k] == pytest.approx(ways[k], abs=1e-9) for k in ways)
    assert tuple(sentencepiece.SentencePieceProcessor(model_file=path(MODEL)).encode(text)) in ways


def test_long_runs_of_spaces(s):
    texts = [" " * 20_000 + "x", "a" + " " * 300 + "b"]
    out = s.sample(texts, np.array([5, 6], np.uint64), 2)
    assert all(sorted(r["row"].tolist()) == [0, 1] for r in out)


def draws(s, text, n, k):
    out = s.sample([text] * n, T.mix(np.arange(n).astype(np.uint64) + np.uint64(99)), k)
    return [[(tuple(r["ids"][r["first"][i] : r["first"][i + 1]].tolist()), r["log_prob"][i], r["value"][i], r["inclusion"][i]) for r in out] for i in range(n)]


def test_draws_have_the_lattices_probabilities(s):
    ways = enumerate_all(s, "the cat")
    p = {k: np.exp(v) for k, v in ways.items()}
    assert sum(p.values()) == pytest.approx(1)
    n = 6000
    found = draws(s, "the cat", n, 3)
    assert all(len({x[0] for x in d}) == 3 and d[0][2] >= d[1][2] >= d[2][2] for d in found)
    assert all(x[1] == pytest.approx(ways[x[0]]) for d in found[:100] for x in d)
    first, both = Counter(d[0][0] for d in found), Counter((d[0][0], d[1][0]) for d in found)
    for k, c in first.most_common(3):
        assert c / n == pytest.approx(p[k], abs=0.02)
    for (a, b), c in both.most_common(4):  # without replacement
        assert c / n == pytest.approx(p[a] * p[b] / (1 - p[a]), abs=0.02)
    weights = [sum(np.exp(x[1]) / x[3] for x in d) for d in found]
    assert np.mean(weights) == pytest.approx(1, abs=0.02)


def test_all_segmentations_of_a_small_text(s):
    ways = enumerate_all(s, "ab")
    out = s.sample(["ab"], np.array([5], np.uint64), 2 * len(ways))
    ids = [tuple(r["ids"].tolist()) for r in out if len(r["row"])]
    assert sorted(ids) == sorted(ways)
    assert all(r["inclusion"][0] == 1 for r in out if len(r["row"]))


def test_batches_make_no_difference(s):
    texts = ["hello there", "", "général 漢字🎉", "x" * 300, "a\nb  c"]
    keys = T.mix(np.arange(5).astype(np.uint64))
    whole = s.sample(texts, keys, 2)
    for k, t in enumerate(texts):
        for a, b in zip(whole, s.sample([t], keys[k : k + 1], 2)):
            at = np.flatnonzero(a["row"] == k)
            got = a["ids"][a["first"][at[0]] : a["first"][at[0] + 1]].tolist() if len(at) else None
            assert got == (b["ids"].tolist() if len(b["row"]) else None)


def test_round_trip_and_edges(spark, edges, none, path):
    encoded = S.encode(edges, path(MODEL), samples=2)
    rows = encoded.collect()
    times = Counter(r.doc_id for r in rows)
    assert (times[1], times[2], times[4], times[5], times[6]) == (1, 1, 2, 4, 2)
    library = sentencepiece.SentencePieceProcessor(model_file=path(MODEL))
    text = {r.doc_id: r.text or "" for r in edges.collect()}
    decoded = {(r.doc_id, r.sample): r.text for r in S.decode(encoded, path(MODEL), ["doc_id", "sample"]).collect()}
    for r in rows:
        assert decoded[r.doc_id, r.sample] == text[r.doc_id]
        if r.doc_id not in (4, 7):
            assert library.decode(r.ids) == text[r.doc_id]
    assert S.encode(none, path(MODEL)).count() == 0
    odd = spark.createDataFrame([(1, [0, 40000, -1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.text for r in S.decode(odd, path(MODEL), ["doc_id"]).collect()} == {""}
