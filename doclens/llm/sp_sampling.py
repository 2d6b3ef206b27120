"""Distinct sampled SentencePiece segmentations by Gumbel top-k, and decoding.

A text's lattice has a node at each character and an edge for each piece. Every prefix of a segmentation stands for the
set of segmentations that go on from it; its perturbed log-probability is the greatest among them. The search is A-star
with that exact bound: it takes the open set with the greatest value, follows it edge by edge to a whole segmentation
(the maximum passes to one edge, drawn by its conditional probability) and leaves, at each node, the set of the other
edges open with a Gumbel value truncated at the maximum. So the first k that come out are k draws without replacement.
Backward sums over the lattice give the conditional probabilities. Draws are a hash of the row's key, the path and the
place, hence the same however rows are batched. Lattices, walks and open sets are made for
all texts of a slice at once in numpy.

The model's scores are ranks of merges, not log-probabilities; a piece of rank r weighs 1 / (r + OFFSET), raised to alpha.
The text is the library's: one space before it, spaces as U+2581, bytes for characters without a piece. No piece
spans most pairs of neighbouring characters (a word and a following space or comma), so a text falls into short units;
equal units of a slice share a lattice. A run of spaces and the word after it are one unit, as pieces of several spaces are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm import features as T

#: Segmentations of each text.
SAMPLES = 2
ALPHA = 1.0
OFFSET = 20.0
SEED = 2024
#: Bytes of text in a walk.
WALK = 1 << 17
SPACE = "▁"
#: Edges from a node at most, as a piece has at most 16 characters.
FAN = 32


class Pieces:
    """The model's pieces with weights, and the bytes of each for decoding."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.id: dict[str, int] = {}
        self.weight = np.zeros(self.size)
        raw: list[bytes] = []
        self.byte = np.zeros(256, np.int32)
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                raw.append(b"")
            else:
                raw.append(piece.replace(SPACE, " ").encode())
                self.id[piece] = i
                self.weight[i] = -alpha * np.log(-sp.get_score(i) + OFFSET)
        self.byte_weight = -alpha * np.log(self.size + OFFSET)
        self._grow_trie()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_first = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        # which characters stand next to each other in a piece
        chars = sorted({c for p in self.id if len(p) > 1 for c in p})
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.next_to = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.id:
            for a, b in zip(p, p[1:]):
                self.next_to[self.kind[ord(a)], self.kind[ord(b)]] = True


    def _grow_trie(self) -> None:
        """The pieces' prefixes as nodes: sorted (node, character) keys and the nodes they lead to."""
        chars = sorted({c for p in self.id for c in p})
        self.char = np.zeros(0x110000, np.int64)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n_chars = len(chars) + 1
        number, piece, keys = {"": 0}, [-1], {}
        for p in sorted(self.id):
            for n in range(1, len(p) + 1):
                if p[:n] not in number:
                    number[p[:n]] = len(piece)
                    keys[number[p[: n - 1]] * self.n_chars + int(self.char[ord(p[n - 1])])] = len(piece)
                    piece.append(-1)
            piece[number[p]] = self.id[p]
        self.trie_keys = np.array(sorted(keys), np.int64)
        self.trie_child = np.array([keys[k] for k in sorted(keys)], np.int64)
        self.trie_piece = np.array(piece, np.int64)


class Lattices:
    """The lattices of distinct units, one after the other."""

    def __init__(self, pieces: Pieces, units: list[str]):
        self.pieces = p = pieces
        code_point = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        n = len(code_point)
        size = np.array([len(u) for u in units], np.int64)
        end = np.repeat(np.cumsum(size), size)
        #: First node of each unit. A node is a character.
        self.root = np.cumsum(size) - size
        char = p.char[code_point]
        # edges: all places go down the trie together
        place, node, found = np.arange(n), np.zeros(n, np.int64), []
        length = 0
        while len(place):
            key = node * p.n_chars + char[place + length]
            at = np.minimum(np.searchsorted(p.trie_keys, key), len(p.trie_keys) - 1)
            hit = np.flatnonzero(p.trie_keys[at] == key)
            place, node, length = place[hit], p.trie_child[at[hit]], length + 1
            piece = p.trie_piece[node]
            whole = piece >= 0
            found.append((place[whole], np.full(int(whole.sum()), length), piece[whole]))
            on = place + length < end[place]
            place, node = place[on], node[on]
        alone = np.ones(n, bool)
        if found:
            alone[found[0][0]] = False
        rare, which = np.unique(code_point[alone], return_inverse=True)
        #: Ids of the bytes that stand for characters without a piece.
        self.extra_ids = [[int(p.byte[b]) for b in chr(c).encode("utf-8", "surrogatepass")] for c in rare.tolist()]
        found.append((np.flatnonzero(alone), np.ones(len(which), np.int64), p.size + which))
        place, length, code = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        by_place = np.argsort(place * FAN + (FAN - 1 - length), kind="stable")  # long pieces are likelier, so they go first
        place, length, code = place[by_place], length[by_place], code[by_place]
        weight = np.concatenate([p.weight, p.byte_weight * np.array([len(x) for x in self.extra_ids])])[code]
        to = place + length
        last = to == end[place]
        # backward sums, place by place from the units' ends
        back, logp = np.zeros(n + 1), np.empty(len(place))
        distance = end[place] - place
        order = np.argsort(distance, kind="stable")
        cuts = np.searchsorted(distance[order], np.arange(1, int(distance.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e = order[a:b]
            value = weight[e] + np.where(last[e], 0.0, back[to[e]])
            at = place[e]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            many = np.diff(np.append(first, len(e)))
            top = np.maximum.reduceat(value, first)
            back[at[first]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, many)), first))
            logp[e] = value - back[at]
        #: First edge of each node; of each edge: its log-probability at the node, the probability up to it, the next node
        #: (-1: the unit's end) and its piece (from pieces.size on: an entry of extra_ids).
        self.node_first = np.searchsorted(place, np.arange(n + 1))
        self.logp = np.where(np.diff(self.node_first)[place] == 1, 0.0, logp)
        run = np.concatenate([[0.0], np.cumsum(np.exp(self.logp))])
        self.cum = run[1:] - run[self.node_first[:-1]][place]
        self.cum[self.node_first[1:] - 1] = 2.0  # the last takes what rounding leaves
        self.to = np.where(last, -1, to)
        self.code = code


class Path(NamedTuple):
    """One segmentation of each text: edges in order, by unit (first) and text (row_first)."""

    first: np.ndarray
    row_first: np.ndarray
    node: np.ndarray
    edge: np.ndarray
    #: Log-probability of the whole, by text, and the perturbed one; -inf where there is no such segmentation.
    log_prob: np.ndarray
    value: np.ndarray
    #: Of the set of other edges that stays open at each node: its perturbed value, and the edges that are out of it.
    open_value: np.ndarray
    out: np.ndarray
    #: Log-probability of what comes before each node.
    before: np.ndarray


_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _uniform(key: np.ndarray, unit: np.ndarray, step: np.ndarray | int, draw: int) -> np.ndarray:
    """In (0, 1): the same for the same text's key, unit, step and draw."""
    x = key + unit.astype(np.uint64) * _C[0] + np.atleast_1d(np.asarray(step, np.uint64)) * _C[1] + np.uint64(draw * int(_C[2]) & 0xFFFFFFFFFFFFFFFF)
    return ((T.mix(x) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _truncated(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at a location, conditional on being at most bound."""
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        return np.where(np.isneginf(location), -np.inf, location - np.log(np.exp(np.minimum(location - bound, 700)) - np.log(u)))


class Walker:
    """The search over the texts of one slice."""

    def __init__(self, lattices: Lattices, units: np.ndarray, row_units: np.ndarray, keys: np.ndarray):
        x = lattices
        self.root, self.node_first, self.cum, self.logp, self.to, self.code = x.root, x.node_first, x.cum, x.logp, x.to, x.code
        self.units, self.row_units = units, row_units
        self.n = len(row_units) - 1
        self.row = np.repeat(np.arange(self.n), np.diff(row_units))
        self.key = keys[self.row]
        self.place = np.arange(len(units)) - row_units[self.row]
        self.keys = keys

    def walk(self, unit: np.ndarray, node: np.ndarray, step: np.ndarray, draw: int) -> list[tuple[np.ndarray, ...]]:
        """From nodes of units to the units' ends: (unit, step, node, edge) of each round."""
        rounds = []
        while len(unit):
            u = _uniform(self.key[unit], self.place[unit], step, 2 * draw)
            edge = self.node_first[node].copy()
            rest = np.flatnonzero(u >= self.cum[edge])
            while len(rest):
                edge[rest] += 1
                rest = rest[u[rest] >= self.cum[edge[rest]]]
            rounds.append((unit, step, node, edge))
            node = self.to[edge]
            on = np.flatnonzero(node >= 0)
            unit, node, step = unit[on], node[on], step[on] + 1
        return rounds

    def _path(self, rounds: list[tuple[np.ndarray, ...]], value: np.ndarray, kept: list, draw: int, fresh: np.ndarray | None) -> Path:
        """Puts edges in order and opens the sets beside the fresh ones (all, if None: (unit, step) from which on, by row)."""
        steps = np.zeros(len(self.units), np.int64)
        for unit, step, *_ in rounds + kept:
            np.maximum.at(steps, unit, step + 1) if len(unit) < 1000 else steps.__setitem__(unit, np.maximum(steps[unit], step + 1))
        first = np.concatenate([[0], np.cumsum(steps)])
        node, edge = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        old = np.zeros(first[-1], bool)
        for new, part in ((True, rounds), (False, kept)):
            for unit, step, a, b in part:
                at = first[unit] + step
                node[at], edge[at], old[at] = a, b, not new
        row_first = first[self.row_units]
        row = np.repeat(np.arange(self.n), np.diff(row_first))
        logp = self.logp[edge]
        total = np.concatenate([[0.0], np.cumsum(logp)])
        before = total[:-1] - total[row_first[:-1]][row]
        unit = np.repeat(np.arange(len(self.units)), steps)
        u = _uniform(self.key[unit], self.place[unit], np.arange(first[-1]) - first[unit], 2 * draw + 1)
        with np.errstate(divide="ignore"):
            other = np.where(self.node_first[node + 1] - self.node_first[node] > 1, np.log(-np.expm1(np.minimum(logp, -1e-300))), -np.inf)
        open_value = _truncated(before + other, value[row], u)
        open_value[old] = -np.inf
        out = np.left_shift(1, edge - self.node_first[node])
        return Path(first, row_first, node, edge, total[row_first[1:]] - total[row_first[:-1]], value, open_value, out, before)

    def best(self) -> Path:
        units = np.arange(len(self.units))
        zero = np.zeros(self.n)
        value = -np.log(-np.log(_uniform(self.keys, np.zeros(self.n), 0, 1 << 20))) + zero
        rounds = self.walk(units, self.root[self.units], np.zeros(len(units), np.int64), 0)
        return self._path(rounds, value, [], 0, None)

    @staticmethod
    def tops(p: Path) -> tuple[np.ndarray, np.ndarray]:
        """By text, the greatest open value of a path and its place."""
        n = len(p.row_first) - 1
        value, at = np.full(n, -np.inf), np.zeros(n, np.int64)
        full = np.flatnonzero(np.diff(p.row_first))
        if len(full):
            value[full] = np.maximum.reduceat(p.open_value, p.row_first[full])
            row = np.repeat(np.arange(n), np.diff(p.row_first))
            hit = np.flatnonzero((p.open_value == value[row]) & ~np.isneginf(p.open_value))
            at[row[hit[::-1]]] = hit[::-1]  # the first
        return value, at

    def after(self, paths: list[Path], draw: int) -> Path:
        """The next segmentation of each text; the paths' open sets change in place."""
        tops = [self.tops(p) for p in paths]
        which = np.argmax(np.stack([v for v, _ in tops]), axis=0)
        value = np.max(np.stack([v for v, _ in tops]), axis=0)
        rounds, kept = [], []
        starts_u, starts_n, starts_s = [], [], []
        for k, p in enumerate(paths):
            rows = np.flatnonzero((which == k) & ~np.isneginf(value))
            if not len(rows):
                continue
            at = tops[k][1][rows]
            node, mask, before = p.node[at], p.out[at], p.before[at]
            # one of the edges that aren't out, by their probabilities
            lo, size = self.node_first[node], self.node_first[node + 1] - self.node_first[node]
            fan = np.arange(int(size.max()))
            grid = np.minimum(lo[:, None] + fan, (lo + size - 1)[:, None])
            prob = np.where((fan < size[:, None]) & (np.right_shift(mask[:, None], fan) & 1 == 0), np.exp(self.logp[grid]), 0.0)
            unit_of = np.searchsorted(p.first, at, "right") - 1
            step = at - p.first[unit_of]
            run = np.cumsum(prob, axis=1)
            u = _uniform(self.keys[rows], self.place[unit_of], step, (1 << 21) + draw) * run[:, -1]
            pick = np.minimum((run <= u[:, None]).sum(axis=1), size - 1)
            pick = np.where(prob[np.arange(len(rows)), pick] > 0, pick, prob.argmax(axis=1))
            edge = lo + pick
            # the set at this place without the edge taken now
            p.out[at] = mask | np.left_shift(1, pick)
            left = run[:, -1] - prob[np.arange(len(rows)), pick]
            count = (prob > 0).sum(axis=1)
            with np.errstate(divide="ignore"):
                location = np.where(count > 1, before + np.log(np.maximum(left, 1e-300)), -np.inf)
            p.open_value[at] = _truncated(location, value[rows], _uniform(self.keys[rows], self.place[unit_of], step, (1 << 22) + draw))
            # what comes before stays, this edge is new, and so is all that follows
            chosen = np.zeros(self.n, bool)
            chosen[rows] = True
            limit = np.zeros(self.n, np.int64)
            limit[rows] = at
            row = np.repeat(np.arange(self.n), np.diff(p.row_first))
            head = np.flatnonzero(chosen[row] & (np.arange(len(row)) < limit[row]))
            unit = np.searchsorted(p.first, head, "right") - 1
            kept.append((unit, head - p.first[unit], p.node[head], p.edge[head]))
            kept.append((unit_of, step, node, edge))
            going = np.flatnonzero(self.to[edge] >= 0)
            starts_u.append(unit_of[going]), starts_n.append(self.to[edge[going]]), starts_s.append(step[going] + 1)
            last = np.zeros(self.n, np.int64)
            last[rows] = unit_of
            later = np.flatnonzero(chosen[self.row] & (np.arange(len(self.units)) > last[self.row]))
            starts_u.append(later), starts_n.append(self.root[self.units[later]]), starts_s.append(np.zeros(len(later), np.int64))
        if starts_u:
            rounds = self.walk(np.concatenate(starts_u), np.concatenate(starts_n), np.concatenate(starts_s), draw)
        return self._path(rounds, value, kept, draw, None)


class Sampler:
    """Encodes texts with a model."""

    def __init__(self, path: str, alpha: float = ALPHA):
        self.pieces = Pieces(path, alpha)

    def units(self, texts: list[str]) -> tuple[Lattices, np.ndarray, np.ndarray]:
        """Lattices of the distinct units of all texts; the unit at each place, and the first place of each text."""
        whole = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(whole)
        kind = self.pieces.kind[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        begins = np.ones(len(kind), bool)
        begins[1:] = ~self.pieces.next_to[kind[:-1], kind[1:]]
        edges = np.concatenate([[0], np.cumsum([len(w) for w in whole])])
        begins[edges[:-1][edges[:-1] < len(kind)]] = True
        starts = np.flatnonzero(begins)
        at = starts.tolist()
        found = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)])]
        distinct = sorted(set(found))
        number = dict(zip(distinct, range(len(distinct))))
        return Lattices(self.pieces, distinct), np.array([number[x] for x in found], np.int64), np.searchsorted(starts, edges)

    def sample(self, texts: list[str], keys: np.ndarray, samples: int) -> list[dict[str, np.ndarray]]:
        """For each rank: row (those that have one), ids and their first, log_prob, value, inclusion."""
        lattices, units, row_units = self.units(texts)
        w = Walker(lattices, units, row_units, keys)
        paths = [w.best()]
        for k in range(1, samples):
            paths.append(w.after(paths, k))
        kappa = np.max(np.stack([Walker.tops(p)[0] for p in paths]), axis=0)
        extra = lattices.extra_ids
        size = np.concatenate([np.ones(self.pieces.size, np.int64), np.array([len(x) for x in extra], np.int64)])
        start = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate([np.arange(self.pieces.size), np.array([i for x in extra for i in x], np.int64)]).astype(np.int32)
        out = []
        for k, p in enumerate(paths):
            rows = np.flatnonzero(~np.isneginf(p.value)) if k else np.arange(len(texts))
            code = w.code[p.edge]
            n = size[code]
            before = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(start[code] - before[:-1], n) + np.arange(before[-1])]
            first = before[p.row_first]
            with np.errstate(over="ignore"):
                inclusion = np.where(np.isneginf(kappa), 1.0, -np.expm1(-np.exp(np.minimum(p.log_prob - kappa, 700))))
            out.append({"row": rows, "ids": ids, "first": np.concatenate([first[rows], first[-1:]]), "log_prob": p.log_prob[rows], "value": p.value[rows], "inclusion": inclusion[rows]})
        return out


_samplers: dict[tuple[str, float], Sampler] = {}


def sampler(path: str, alpha: float) -> Sampler:
    if (path, alpha) not in _samplers:
        _samplers[path, alpha] = Sampler(path, alpha)
    return _samplers[path, alpha]


def decoded(p: Pieces, ids: np.ndarray, first: np.ndarray) -> Iterator[str]:
    """The texts of runs of ids: pieces' characters and bytes, without the space before the text. Ids outside the
    vocabulary stand for nothing."""
    for at in range(0, len(first) - 1, 64):
        part = ids[first[at] : first[min(at + 64, len(first) - 1)]].astype(np.int64)
        part = np.where((part >= 0) & (part < p.size), part, 0)
        size = np.diff(p.raw_first)[part]
        before = np.concatenate([[0], np.cumsum(size)])
        raw = p.raw[np.repeat(p.raw_first[part] - before[:-1], size) + np.arange(before[-1])].tobytes()
        cut = before[first[at : at + 65] - first[at]].tolist()
        for x, y in zip(cut, cut[1:]):
            yield raw[x:y].decode("utf-8", "replace").removeprefix(" ")


ENCODED = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double, round_trip boolean"


def encode(docs: DataFrame, model: str, samples: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Up to `samples` distinct segmentations of every row of docs(doc_id, text), the greatest perturbed value first.

    inclusion is 1 - exp(-exp(log_prob - kappa)), kappa being the next perturbed value: a segmentation's chance to be
    among those drawn, given that threshold. A text with fewer segmentations gives them all, with inclusion 1; an empty or
    null text has one, without ids. round_trip: the ids decode to the text (with any U+2581 in it as a space). Draws depend on
    doc_id and seed, so rows with one doc_id and text come out alike; null doc_ids draw like 0. Other columns aren't read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sampler(model, alpha)
        for b in T.slices(batches, most=WALK):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = np.asarray(b.column("doc_id").fill_null(0)).astype(np.uint64)
            want = [t.replace(SPACE, " ") for t in texts]
            for k, r in enumerate(s.sample(texts, T.mix(ids * _C[3] + np.uint64(seed)), samples)):
                rows, first = r["row"], r["first"]
                if not len(rows):
                    continue
                same = [t == want[i] for t, i in zip(decoded(s.pieces, r["ids"], first), rows.tolist())]
                # rows without a k-th segmentation have no ids, so the lists are one run
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(r["ids"], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(rows)), pa.array(np.full(len(rows), k, np.int32)), lists, pa.array(r["log_prob"]), pa.array(r["value"]), pa.array(r["inclusion"]), pa.array(same)],
                    ["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, ENCODED)


def decode(encoded: DataFrame, model: str, keep: list[str], alpha: float = ALPHA) -> DataFrame:
    """keep's columns, and `text`: what each row's ids stand for. Ids outside the vocabulary and null ids stand for nothing."""
    rows = encoded.select(*dict.fromkeys([*keep, "ids"]))
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*(encoded.schema[c] for c in keep), StructField("text", StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sampler(model, alpha).pieces
        for b in batches:
            texts: list[str] = []
            for at in range(0, b.num_rows, 64):
                lists = b.column("ids").slice(at, 64)
                n_ids = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
                texts += decoded(p, np.asarray(lists.flatten().fill_null(0)), np.concatenate([[0], np.cumsum(n_ids)]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return rows.mapInArrow(work, schema)
