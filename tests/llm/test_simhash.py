import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from doclens.llm import simhash as S


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    up = {i: i for i, _ in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if (a ^ b).bit_count() <= radius:
                low, high = sorted((top(i), top(j)))
                up[high] = low
    return {i: top(i) for i in up}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBß \n\t\x1c 漢", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == brute_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 255), max_size=30), st.integers(0, 255), st.integers(0, 3))
def test_tree_finds_all_within_the_radius(values, x, radius):
    tree = S.BKTree()
    for v in sorted(values):
        tree.add(v)
    assert sorted(tree.within(x, radius)) == sorted(v for v in values if (v ^ x).bit_count() <= radius)


@pytest.mark.parametrize("most", [2048, 1])
def test_components_of_random_chains(spark, most):
    """Random fingerprints with chains of small steps, shards dealt once and dealt again."""
    r = np.random.default_rng(3)
    fps = set()
    for _ in range(30):
        x = int(r.integers(0, 1 << 63))
        for _ in range(8):
            fps.add(x)
            for _ in range(int(r.integers(1, 4))):
                x ^= 1 << int(r.integers(0, 64))
    rows = [(i, x) for i, x in enumerate(sorted(fps))]
    nodes = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "id long, fp long")
    got = {r.id: r.root for r in S.components(S.links(nodes, most=most)).collect()}
    want = brute_components(rows)
    assert {i: got.get(i, i) for i, _ in rows} == want
    assert len(set(want.values())) > 30


def test_documents_against_brute_force(spark, sf):
    docs = sf["documents"].limit(400)
    rows = {r.doc_id: r for r in S.near_duplicates(docs).collect()}
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(fps)
    assert {i: (f"{x:016x}", want[i]) for i, x in fps} == {i: (r.fingerprint, r.component_id) for i, r in rows.items()}


def test_edges(edges, none):
    rows = S.near_duplicates(edges).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fingerprint == "0" * 16
    assert by[5].component_id == 5
    assert S.near_duplicates(none).count() == 0
    kept = S.one_of_each(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7]
