import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from doclens.llm import lm_mixing as M
from doclens.llm.queries import op11_lm_mixing

U = (1 << 64) - 1
M0, M1, M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def _mix(x):
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> 33)) * c & U
    return x ^ (x >> 33)


def _contexts(data, i):
    """The hashes of a byte's contexts, one byte at a time."""
    out = []
    for k in (2, 4):
        h = k
        for j in range(1, k + 1):
            h = (h + (data[i - j] if i >= j else 0) + 1) * M0 & U
            h ^= h >> 29
        out.append(h)
    begin = i
    while begin and data[begin - 1] not in (9, 10, 11, 12, 13, 32):
        begin -= 1
    h = (sum((b + 1) * pow(M0, n, 1 << 64) for n, b in enumerate(data[begin:i])) + i - begin) & U
    return [*out, _mix(h) ^ M2]


def _nodes(h, byte, bits):
    mask = ((1 << bits) - 1) & ~15
    for part, half in ((0, byte >> 4), ((byte >> 4) + 1, byte & 15)):
        line = ((h + part * M1) * M2 & U) >> (64 - bits) & mask
        for b in range(4):
            yield line | (half | 16) >> (4 - b), half >> (3 - b) & 1


def plain(training, texts, bits):
    """(bits) of each text, bit by bit, without arrays."""
    seen = [{} for _ in range(3)]
    as_bytes = lambda t: (t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) + b"\xff"
    for t in map(as_bytes, training):
        for i in range(len(t)):
            for k, h in enumerate(_contexts(t, i)):
                for slot, bit in _nodes(h, t[i], bits):
                    seen[k].setdefault(slot, [0, 0])[bit] += 1
    odds = [{s: round(max(-8, min(8, math.log((o + 0.4) / (z + 0.4)))) * 127 / 8) / (127 / 8) for s, (z, o) in c.items()} for c in seen]
    out = []
    for t in map(as_bytes, texts):
        total = 0.0
        for i in range(len(t)):
            if i % M.BLOCK == 0:
                w = {g: [M.LEADS if k == g - 1 else M.REST for k in range(3)] for g in range(4)}
                at = [1 / (1 + math.exp(-(-8 + 16 * k / M.REFINE_STEPS))) for k in range(M.REFINE_STEPS + 1)]
                ends = [[[a, z] for a, z in zip(at, at[1:])] for _ in range(8)]
            found = [[(odds[k].get(s, 0.0), bit) for s, bit in _nodes(h, t[i], bits)] for k, h in enumerate(_contexts(t, i))]
            gate = max([k + 1 for k in range(3) if found[k][0][0] != 0], default=0)
            steps, moves = [0.0] * 3, []
            for b in range(8):
                x, bit = [found[k][b][0] for k in range(3)], found[0][b][1]
                z = max(-8 + 1e-3, min(8 - 1e-3, sum(a * c for a, c in zip(w[gate], x))))
                p = 1 / (1 + math.exp(-z))
                place = (z + 8) * M.REFINE_STEPS / 16
                low, share = int(place), place - int(place)
                left, right = ends[b][low]
                q = (1 - M.REFINED) * p + M.REFINED * (left + share * (right - left))
                total -= math.log2(q if bit else 1 - q)
                steps = [s + M.RATE * (bit - p) * a for s, a in zip(steps, x)]
                moves.append((b, low, M.REFINE_RATE * (1 - share) * (bit - left), M.REFINE_RATE * share * (bit - right)))
            w[gate] = [a + s for a, s in zip(w[gate], steps)]
            for b, low, a, c in moves:
                ends[b][low][0] += a
                ends[b][low][1] += c
        out.append(total)
    return out


def base(rows):
    train = Counter()
    tokens = {}
    for n, (d, text) in enumerate(rows):
        ts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]
        tokens[n] = ts
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            train.update(ts)
    total, v = sum(train.values()), len(train)
    return [(len(ts), sum(train[t] > 0 for t in ts), total, sum(math.log10((train[t] + 1) / (total + v + 1)) for t in ts)) for ts in tokens.values()]


TEXTS = ["the cat sat on the mat", "The CAT\x0bsat", "", None, "żółw 漢字 🎉 the", " \t\n", "a" * 50, "the cat sat on the mat", "unseen words here", "x\u0085y z"]


def test_costs_equal_a_plain_bit_by_bit_version(monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 24)
    g = np.random.default_rng(1)
    texts = [*TEXTS, *(" ".join(g.choice(["the", "cat", "Dog", "runs", "ünder", "1,5"], 40)) for _ in range(4))]
    for n_train in (0, 6, len(texts)):
        counts = np.zeros((len(M.ORDERS), 1 << 12), np.int32)
        M.count_halves(M.flat(pa.array(texts[:n_train], pa.string())), counts)
        tables = np.array([M.log_odds(c) for c in counts])
        got = M.bits_of(M.flat(pa.array(texts, pa.string())), tables)
        assert np.allclose(got, plain(texts[:n_train], texts, 12), rtol=2e-5)


def test_costs_do_not_depend_on_the_batch():
    counts = np.zeros((len(M.ORDERS), 1 << 14), np.int32)
    texts = [*TEXTS, "lorem ipsum dolor sit amet " * 300, "short"]
    M.count_halves(M.flat(pa.array(texts, pa.string())), counts)
    tables = np.array([M.log_odds(c) for c in counts])
    together = M.bits_of(M.flat(pa.array(texts, pa.string())), tables)
    assert np.array_equal(together, np.concatenate([M.bits_of(M.flat(pa.array([t], pa.string())), tables) for t in texts]))


def test_counts_in_few_bytes():
    for top in (0, 255, 256, 70_000, 1 << 33):
        x = np.array([0, 1, top])
        assert np.array_equal(M.widen(M.narrow(x)), x)


def test_whole_query_over_odd_rows(spark, edges, docs_of):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = {}
    for r in M.score(edges).collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for (d, text), (n, known, total, score) in zip(rows, base(rows)):
        for r in got[d, len((text or "").encode()) + 1]:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert math.isclose(r.base_score, score, rel_tol=1e-9) and r.score < 0
            assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 7 == 2)
            assert math.isclose(r.score, -r.bits_per_byte * r.n_bytes * math.log10(2), rel_tol=1e-9)


def test_rare_words_are_looked_up_by_a_shuffle(spark, docs_of, monkeypatch):
    monkeypatch.setattr(M, "SHARE", 0.2)
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)]
    got = sorted(M.score(docs_of(*rows)).collect(), key=lambda r: r.doc_id)
    for r, (n, known, total, score) in zip(got, base(rows)):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, score, rel_tol=1e-9)


def test_no_rows_and_no_training(spark, none, docs_of):
    assert M.score(none).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = M.score(docs_of((held, "two words"))).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and 7 < r.bits_per_byte <= 8


def test_held_out_texts_teach_nothing(spark, docs_of):
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    rows = [(k, t) for k, t in enumerate(TEXTS) if k not in held]
    one = {r.doc_id: r for r in M.score(docs_of(*rows, (held[0], "qqq www"))).collect()}
    two = {r.doc_id: r for r in M.score(docs_of(*rows, (held[0], "qqq www"), (held[1], "qqq www"), (held[2], "the cat " * 500))).collect()}
    assert all(two[k] == r for k, r in one.items())


def test_better_than_single_words_on_held_out_texts(spark):
    got = op11_lm_mixing(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(bits_per_byte * n_bytes) / sum(n_bytes) b").collect()[0]
    assert got.b < 3.2
