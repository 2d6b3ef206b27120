import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyarrow as pa
from doclens.llm import features as T
from doclens.llm import linear as L
from doclens.llm import quality_knn, quality_rules, toxicity


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab é#\n\t", max_size=80), min_size=1, max_size=4))
def test_base_counts(texts):
    base = quality_rules.base_counts(*T.text_buffers(pa.array(texts)))
    got = zip(*(base[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))
    assert [*got] == [brute_counts(t) for t in texts]


def thue_morse(n, a, b):
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join((a, b)[x] for x in bits[:n])


def test_base_counts_of_texts_that_collide():
    """Polynomial hashes modulo 2^64 are equal for a Thue-Morse string and its complement."""
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    spans = T.Spans(np.array([0, 1024]), np.array([1024, 2048]), np.array([0, 2]))
    data = np.frombuffer((one + two).encode(), np.uint8)
    h = T.span_hashes(T.prefix_sums(data.astype(np.uint64) + np.uint64(1)), spans.starts, spans.ends)
    assert h[0] == h[1] and len(set(quality_rules.identities(data, spans, h))) == 2
    rest = " ".join(f"w{k}" for k in range(7))
    texts = [f"{one}\n{two}\n{one}", f"{one} {rest}\n{two} {rest}", f"{one} {rest} {one} {rest}"]
    base = quality_rules.base_counts(*T.text_buffers(pa.array(texts)))
    assert list(zip(*(base[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))) == [brute_counts(t) for t in texts]
    row, ids = np.array([0, 0, 1, 0]), np.array([[1, 2], [1, 2], [1, 2], [2, 1]])
    assert [x.tolist() for x in quality_rules.occurrences(row, ids)] == [[0, 0, 2, 3], [2, 2, 1, 1]]


def test_the_space_is_the_best_one_of_its_rank(sf):
    """Against a full decomposition of the sample in one place: as near to the sample, with vectors made one text at a time."""
    labels = sf["labels"].where("doc_id is not null")
    space = quality_knn.fit_space(sf["documents"], labels, per_class=50)
    texts = {r.doc_id: r.text for r in sf["documents"].collect()}
    every = [quality_knn.term_counts(*T.text_buffers(pa.array([t])))[0].astype(np.float64) for t in texts.values()]
    idf = np.log((len(every) + 1) / ((np.array(every) > 0).sum(axis=0) + 1)) + 0.1
    assert np.allclose(space.idf, idf, atol=1e-5)
    x = np.array([quality_knn.term_counts(*T.text_buffers(pa.array([texts[i]])))[0].astype(np.float16).astype(np.float64) * idf for i in space.ids.tolist()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    left = lambda basis: np.linalg.norm(x - x @ basis @ basis.T) ** 2
    best = np.linalg.svd(x, full_matrices=False)[2][: quality_knn.RANK].T
    assert np.allclose(space.project.T @ space.project, np.eye(quality_knn.RANK), atol=1e-6)
    assert left(space.project) < 1.02 * left(best) + 1e-6
    assert np.allclose(space.vectors, quality_knn._units(x @ space.project), atol=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é.\n", max_size=40), min_size=1, max_size=5))
def test_grams_do_not_depend_on_the_batch(texts):
    g = L.Grams(bits=12, chars=(3,), words=(1, 2))
    weights = np.random.default_rng(0).standard_normal(1 << 12).astype(np.float32)
    whole = L.weighted(g, L.positions(g, *T.text_buffers(pa.array(texts))), weights)
    alone = [L.weighted(g, L.positions(g, *T.text_buffers(pa.array([t]))), weights)[0] for t in texts]
    assert np.array_equal(whole, alone)
    rows = L.rows(g, L.positions(g, *T.text_buffers(pa.array(texts))))
    assert np.allclose(whole, [weights[i] @ v for i, v in rows], atol=1e-4)


def held_out_accuracy(rows, label, predicted):
    r = rows.select(F.avg((F.col(label) == F.col(predicted).cast("int")).cast("double"))).first()[0]
    return r


def test_rules_on_held_out_labels(sf):
    split = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    model = quality_rules.fit_model(sf["documents"], sf["labels"].where(~split))
    rows = quality_rules.apply_rules(sf["documents"], model).join(sf["labels"].where(split), "doc_id")
    passed = rows.where("not base_failed")
    assert held_out_accuracy(passed, "quality", "kept") > 0.9
    assert passed.where("quality = 1 and not kept").count() <= 0.05 * passed.count()


def test_neighbours_on_held_out_labels(sf):
    out = quality_knn.held_out()
    space = quality_knn.fit_space(sf["documents"], sf["labels"].where(~out))
    rows = quality_knn.score(sf["documents"], space).join(sf["labels"].where(out), "doc_id")
    assert held_out_accuracy(rows, "quality", "predicted") > 0.93


def test_exact_votes_by_blocks(sf):
    """Blocked products and partial sorting give the same votes as a full sort, one text at a time, to the last bit; a labelled
    row has no vote for itself; of equally near rows the least doc_ids vote."""
    space = quality_knn.fit_space(sf["documents"], sf["labels"], per_class=60)
    rows = sf["documents"].limit(40).collect() + sf["documents"].where(F.col("doc_id").isin([int(i) for i in space.ids[:10]])).collect()
    texts, ids = [r.text for r in rows], [r.doc_id for r in rows]
    got = quality_knn.votes(space, *T.text_buffers(pa.array(texts)), pa.array(ids))
    assert np.isin(ids, space.ids).any()
    for k, (text, i) in enumerate(zip(texts, ids)):
        one = T.text_buffers(pa.array([text]))
        assert quality_knn.votes(space, *one, pa.array([i])) == got[k]
        v = quality_knn._units(quality_knn._weighted(quality_knn.term_counts(*one), space.idf) @ space.project)
        cos = np.round(space.vectors @ v[0], quality_knn.DIGITS)
        near = [n for n in sorted(range(len(cos)), key=lambda n: (-cos[n], n)) if space.ids[n] != i][: quality_knn.NEIGHBOURS]
        w = (np.clip(cos[near], 1e-3, 1) / cos[near].max()) ** quality_knn.POWER * space.weigh[space.labels[near].astype(int)]
        assert got[k] == pytest.approx((w * space.labels[near]).sum() / w.sum(), abs=1e-9)


def test_nearest_takes_the_first_of_equals():
    cos = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.3, 0.3, 0.3, 0.3, 0.3]])
    assert [sorted(r) for r in quality_knn.nearest(cos, 2).tolist()] == [[0, 1], [0, 1]]


def test_chain_on_held_out_labels(spark):
    """Some forty toxic words in four languages take a few hundred toxic rows to learn."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    split = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    chain = toxicity.fit_chain(docs, labels.where(~split))
    assert chain.categories == ["insult", "contempt", "toxic"]
    rows = toxicity.score(docs, chain).withColumnRenamed("toxic", "predicted").join(labels.where(split), "doc_id").cache()
    assert held_out_accuracy(rows, "toxic", "predicted") > 0.95
    assert rows.where("toxic = 1 and predicted").count() > 0.9 * rows.where("toxic = 1").count()
    assert rows.where("toxic = 0 and predicted").count() < 0.04 * rows.where("toxic = 0").count()
    # later models read the earlier probabilities
    assert [len(wd) for _, wd in chain.models] == [1, 2, 3]


def test_out_of_fold_scores_come_from_models_without_the_row():
    x = [(np.array([k], np.int32), np.ones(1, np.float32)) for k in range(40)]
    y = np.tile([0.0, 1.0], 20)
    fold = np.arange(40) % 2
    score = L.out_of_fold(x, y, fold, 64)
    # each row has a bucket of its own: unseen, it can only get the others' bias
    assert len({round(s, 9) for s in score[fold == 0]}) == 1


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_edges(spark, edges, none, sf, label):
    bad = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0), (2, 1, 1), (5, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    if label == "quality":
        model, space = quality_rules.fit_model(edges, bad), quality_knn.fit_space(edges, bad)
        assert quality_rules.apply_rules(edges, model).count() == quality_knn.score(edges, space).count() == 9
        assert quality_rules.fit_model(edges, bad.limit(0)) is None and quality_knn.fit_space(none, bad) is None
        rows = quality_rules.apply_rules(edges, None).collect()
        assert all(r.base_failed == (r.doc_id not in () and (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)) and r.p_quality is None for r in rows)
        assert quality_rules.apply_rules(none, model).count() == quality_knn.score(none, space).count() == 0
        assert {r.score for r in quality_knn.score(edges, None).collect()} == {0.5}
        assert quality_knn.keep(edges, None).columns == edges.columns
    else:
        chain = toxicity.fit_chain(edges, bad)
        assert toxicity.score(edges, chain).count() == 9 and toxicity.score(none, chain).count() == 0
        assert toxicity.fit_chain(none, bad) is None and not toxicity.score(edges, None).where("toxic").count()
