import numpy as np

import corpus_pipeline
from doclens.llm import near_copies as N
from doclens.llm import simhash as S


def brute_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)} - {""}


def brute_roots(rows):
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [(i, brute_set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 10 * len(a & b) >= 8 * len(a | b):
                low, high = sorted((top(i), top(j)))
                up[high] = low
    return {i: top(i) for i in up}


def edited(seed=5):
    """Texts with 1 to 5 words changed, so that similarities lie on both sides of 0.8, with boilerplate that many share."""
    r, rows = np.random.default_rng(seed), []
    shared = " ".join(f"all{i}" for i in range(12))
    for k in range(25):
        words = [f"w{r.integers(0, 5000)}" for _ in range(int(r.integers(3, 150)))]
        for n in range(5):
            copy = list(words)
            for at in r.integers(0, len(words), n):
                copy[at] = f"x{r.integers(0, 5000)}"
            rows.append((k * 5 + n, " ".join(copy) + (" " + shared if k % 2 else "")))
    return [*rows, (900, rows[7][1].upper()), (901, None), (902, " "), (903, shared)]


def test_pairs_are_those_of_brute_force(spark, docs_of):
    rows = edited()
    want = brute_roots(rows)
    assert groups(docs_of(*rows)) == want
    assert 30 < len(set(want.values())) < 120
    assert groups(docs_of(*rows), sample=1) == want  # other frequent shingles, same groups
    left = {r.doc_id for r in N.one_of_each(docs_of(*rows)).collect()}
    assert left == set(want.values())


def groups(docs, **how):
    """The least doc_id of each document's group."""
    found = N.similar_sets(docs, **how)
    root = {r.id: r.root for r in S.components(found.links).collect()}
    of = {r.doc_id: root.get(r.s, r.s) for r in found.rows.collect()}
    least = {}
    for i, g in of.items():
        least[g] = min(i, least.get(g, i))
    return {r.doc_id: least[of[r.doc_id]] if r.doc_id in of else r.doc_id for r in docs.collect()}


def test_a_large_group_of_near_copies_makes_few_pairs(spark, docs_of, monkeypatch):
    """300 texts, each with another word changed: all link by way of pivots, and no pair is left for the second step."""
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*words[: k % 110], f"x{k}", *words[k % 110 + 1 :]])) for k in range(300)]
    sizes, verified = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *rest: sizes.append(pairs.count()) or verified(pairs, *rest))
    assert [r.doc_id for r in N.one_of_each(docs_of(*rows)).collect()] == [0]
    assert sum(sizes) < 30 * len(rows)


def test_long_texts_with_a_shared_passage_make_no_pairs(spark, docs_of, monkeypatch):
    """150 texts that share a passage which no sample names, and two near copies: only those meet, though all hold its shingles."""
    shared = " ".join(f"p{i}" for i in range(60))
    rows = [(k, " ".join(f"w{k}x{i}" for i in range(400)) + " " + shared) for k in range(150)]
    rows.append((150, rows[7][1].replace("w7x200", "changed")))
    made, written = {}, N.written

    def keep(name, df):
        return made.setdefault(name, df) if name == "places" else df

    monkeypatch.setattr(N, "written", lambda df, name: keep(name, written(df, name)))
    assert {k: g for k, g in groups(docs_of(*rows), sample=1).items() if k != g} == {150: 7}
    assert made["places"].select("s").distinct().count() <= 12


def test_long_sets_are_told_apart_in_the_join(spark, docs_of):
    """Sets of 2,500 that share half, and a near copy: both maps of long sets let the right pair through."""
    half = [f"h{i}" for i in range(1250)]
    rows = [(k, " ".join([*half, *(f"w{k}x{i}" for i in range(1250))])) for k in range(4)]
    rows.append((9, rows[2][1].replace("w2x600", "changed")))
    assert groups(docs_of(*rows)) == {0: 0, 1: 1, 2: 2, 3: 3, 9: 2}


def test_parity_maps_never_hide_a_similar_pair():
    r = np.random.default_rng(8)
    for _ in range(400):
        n, apart = int(r.integers(1, 900)), int(r.integers(0, 120))
        shared, x, y = (np.unique(r.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, apart // 2, apart - apart // 2))
        a, b = np.union1d(shared, x), np.union1d(shared, y)
        both = len(np.intersect1d(a, b))
        if 10 * both >= 8 * (len(a) + len(b) - both):
            assert N.may_be_similar(len(a), len(b), N.parity(a), N.parity(b))
    far = [np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2)]
    assert not N.may_be_similar(300, 300, *map(N.parity, far))


def test_rows_of_one_doc_id_stand_for_themselves(spark, docs_of):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = docs_of((1, a), (1, b), (2, b), (3, c), (3, c), (None, c), (4, None), (4, ""))
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    got = sorted(((r.doc_id or 0), (r.text or "")[:1]) for r in stage(spark, docs, "").collect())
    assert got == [(0, "c"), (1, "a"), (1, "b"), (3, "c"), (4, "")]


def test_stage_drops_edited_copies_that_fingerprints_miss(spark, docs_of):
    base = [f"word{i}" for i in range(60)]
    copy = [*base[:20], "changed", *base[21:]]
    a, b = " ".join(base), " ".join(copy)
    assert (S.fingerprint(a.encode()) ^ S.fingerprint(b.encode())).bit_count() > S.RADIUS
    docs = docs_of((1, a), (2, b), (3, "something else altogether is written in here"), (None, b))
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
    assert stage(spark, docs.limit(0), "").count() == 0


def test_no_near_copy_is_left(spark, sf):
    left = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, sf["documents"], "")
    rows = [(r.doc_id, r.text) for r in left.collect()]
    by_shingle, sets = {}, {i: brute_set(t) for i, t in rows}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(i, j) for ids in by_shingle.values() for i in ids for j in ids if i < j}
    assert not [p for p in pairs if 10 * len(sets[p[0]] & sets[p[1]]) >= 8 * len(sets[p[0]] | sets[p[1]])]
