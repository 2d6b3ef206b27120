"""Personal data: base patterns, and further spans from weakly supervised labelers.

Base spans (email, ip, card, phone) are exact patterns. Beside them the text gives candidates: long mixed strings, digit
groups that are no base span, and handles. Labelers of three sorts (patterns, word lists, context) vote for or against each
candidate or abstain. Expectation-maximisation over the counts of all vote patterns in the corpus estimates how reliable
each labeler is and gives every pattern a probability; a final span classifier over features of the span and its context
is trained on a bounded sample of candidates with these probabilities, and decides which candidates are spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm import features as T
from doclens.llm.linear import sigmoid

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "handle")
RANK = {k: i for i, k in enumerate(BASE + ADDED)}
#: Candidates that the span classifier is trained on, at most.
SAMPLE = 4000
THRESHOLD = 0.5
#: Characters of context on either side that labelers read.
CONTEXT = 40

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}")
_NUMBER = re.compile(r"(?<![A-Za-z0-9.])[0-9](?:[\x20./()-]{0,2}[0-9]){6,}(?![A-Za-z0-9])")
#: Telephone and card numbers that stand next to more digits, so that the base match is too long.
_TEL = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])")
_PAN = re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+@-])@[A-Za-z_][A-Za-z0-9_]{2,30}(?![A-Za-z0-9_@.])")

_KEYWORD = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[ _-]?key|access[ _-]?key|bearer|credential)s?\b")
_ASSIGN = re.compile(r"[=:]\s*[\"'`]?$")
_PERSONAL = re.compile(r"(?i)\b(?:phone|tel|call|fax|mobile|cell|ssn|social security|passport|account|iban|id|patient|born|dob|card|licen[cs]e no)\b")
_SOCIAL = re.compile(r"(?i)\b(?:twitter|follow|contact|instagram|telegram|user(?:name)?|dm|by)\b")
_NEUTRAL = re.compile(r"(?i)\b(?:version|section|chapter|page|figure|isbn|doi|copyright|total|volume|equation|row)\b")
_DATE = re.compile(r"(?:1[89]|20)\d\d[-/. ]\d{1,2}[-/. ]\d{1,2}|\d{1,2}[-/. ]\d{1,2}[-/. ](?:1[89]|20)\d\d")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Names after "@" that stand for groups or code, not for a person.
_GROUPS = frozenset("all channel everyone here media import override param return property".split())
#: How key issuers begin their keys.
_ISSUED = ("ghp_", "gho_", "sk_live_", "sk-", "AKIA", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that don't overlap others of the kind; those that fail a check are dropped."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], RANK[s[0]]))


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Spans that may be personal data, apart from base spans and from each other."""
    taken, out = sorted((a, b) for _, a, b in base), []
    for kind, pattern in (("secret", _SECRET), ("number", _TEL), ("number", _PAN), ("number", _NUMBER), ("handle", _HANDLE)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == "secret" and not (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])):
                continue
            out.append((kind, a, b))
    free, end, k = [], 0, 0
    for kind, a, b in sorted(out, key=lambda s: (s[1], RANK[s[0]], s[2])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= end and not (k < len(taken) and taken[k][0] < b):
            free.append((kind, a, b))
            end = b
    return free


LABELERS = ("pattern", "shape", "issuer list", "group list", "keyword before", "assignment", "personal words", "neutral words")


def _number_vote(value: str, digits: int) -> int:
    if value[0] == "+":
        return 1 if digits >= 10 else 0
    if _DATE.search(value) or digits > 19:
        return -1
    return (1 if luhn(value) else -1) if digits >= 14 and digits == len(value) else 0


def votes(kind: str, value: str, before: str, after: str) -> list[int]:
    """1, 0 or -1 of each labeler: for, abstains, against."""
    digits = sum(c.isdigit() for c in value)
    share = digits / len(value)
    return [
        {"secret": 1 if _HEX.fullmatch(value) and len(value) in (32, 40, 64) else 0, "number": _number_vote(value, digits), "handle": 1}[kind],
        {"secret": 1 if 0.15 <= share <= 0.9 and len(set(value)) >= 10 else -1, "number": -1 if len(set(value)) <= 3 else 1 if value[0] == "+" and value[-1].isdigit() else 0, "handle": 0}[kind],
        1 if value.startswith(_ISSUED) else 0,
        -1 if value.lstrip("@").lower() in _GROUPS else 0,
        1 if _KEYWORD.search(before) else 0,
        1 if _ASSIGN.search(before) else 0,
        1 if (_SOCIAL if kind == "handle" else _PERSONAL).search(before) else 0,
        -1 if _NEUTRAL.search(before) or _NEUTRAL.search(after) or after.lstrip().startswith(("%", "=")) else 0,
    ]


def span_features(kind: str, value: str, before: str, after: str) -> list[float]:
    n = len(value)
    digits, upper, alpha = (sum(f(c) for c in value) / n for f in (str.isdigit, str.isupper, str.isalpha))
    return [
        1.0, *(float(kind == k) for k in ADDED), np.log(n), digits, upper, alpha, len(set(value)) / n, float(bool(_HEX.fullmatch(value))),
        float(before[-1:] in "\"'`") if before else 0.0, float(bool(_ASSIGN.search(before))), float(bool(_KEYWORD.search(before))),
        float(bool(_PERSONAL.search(before))), float(bool(_NEUTRAL.search(before))), float(bool(_SOCIAL.search(before))),
        float(before[-1:].isspace()), float(after[:1].isspace() or not after), float(bool(_DATE.search(value))),
        float(value[0] == "+"), float(kind == "number" and digits == 1 and luhn(value)),
    ]


class Model(NamedTuple):
    weights: np.ndarray
    #: By kind, for each labeler: P(vote | not personal) and P(vote | personal) of votes -1, 0 and 1.
    reliability: dict[str, np.ndarray]


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each vote pattern, each labeler's reliability) under labelers that are independent given the truth."""
    post = sigmoid(patterns.sum(axis=1).astype(float))
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    theta = np.full((patterns.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - post), counts * post])
        theta = np.einsum("yp,pjv->jyv", mass, onehot) + 0.5
        theta /= theta.sum(axis=2, keepdims=True)
        prior = (mass.sum(axis=1) + 1) / (mass.sum() + 2)
        odds = np.log(prior[1] / prior[0]) + np.einsum("pjv,jv->p", onehot, np.log(theta[:, 1] / theta[:, 0]))
        new = sigmoid(odds)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, theta


def _soft_logistic(x: np.ndarray, p: np.ndarray, w: np.ndarray, rounds: int = 60) -> np.ndarray:
    c = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = sigmoid(x @ c)
        h = (x * (w * q * (1 - q))[:, None]).T @ x + 1.0 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (w * (q - p)) + 1.0 * c)
        c -= step
        if np.abs(step).max() < 1e-8:
            break
    return c


def _suspects(b: pa.RecordBatch) -> tuple[list[int], list[str]]:
    """Rows whose text holds a digit or an @ (no other text has a span or a candidate), and their texts."""
    data, offsets = T.text_buffers(b.column("text"))
    hit = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data >= 48) & (data <= 57)) | (data == 64), out=hit[1:])
    at = np.flatnonzero(hit[offsets[1:]] > hit[offsets[:-1]])
    return at.tolist(), b.column("text").take(pa.array(at)).to_pylist()


def _around(text: str, a: int, b: int) -> tuple[str, str, str]:
    return text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]


def fit_model(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Reliabilities from the vote patterns of all candidates in docs, and a classifier from at most `sample` of them.

    None if there is no candidate.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            found = []
            for text in _suspects(b)[1]:
                for kind, a, z in candidates(text, base_spans(text)):
                    parts = _around(text, a, z)
                    found.append((f"{kind}|" + ",".join(map(str, votes(kind, *parts))), span_features(kind, *parts)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found]), pa.array([x for _, x in found], pa.list_(pa.float64()))], ["votes", "x"])

    docs = docs.select(F.col("text").cast("string"))
    seen = docs.mapInArrow(work, "votes string, x array<double>")
    # each vote pattern with its count and the first of its candidates by hash: as many patterns as the labelers allow
    pattern = seen.groupBy("votes", "x").agg(F.count("*").alias("n"))
    rows = pattern.withColumn("h", F.xxhash64("votes", "x")).persist()
    try:
        counts = rows.groupBy("votes").agg(F.sum("n").alias("n")).toPandas().sort_values("votes")
        some = rows.orderBy("h", "votes").limit(sample).toPandas()
    finally:
        rows.unpersist()
    if not len(counts):
        return None
    p, reliability = {}, {}
    for kind, part in counts.groupby(counts["votes"].str.split("|").str[0]):  # a labeler may be good for one kind only
        patterns = np.array([[int(v) for v in s.split("|")[1].split(",")] for s in part["votes"]])
        post, reliability[kind] = expectation_maximisation(patterns, part["n"].to_numpy(float))
        p |= dict(zip(part["votes"], post))
    x = np.array(some["x"].tolist())
    return Model(_soft_logistic(x, some["votes"].map(p).to_numpy(float), np.log1p(some["n"].to_numpy(float))), reliability)


def all_spans(text: str, model: Model | None, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text, in order of start, then kind."""
    base = base_spans(text)
    more = candidates(text, base) if model else []
    if more:
        p = sigmoid(np.array([span_features(k, *_around(text, a, z)) for k, a, z in more]) @ model.weights)
        more = [s for s, q in zip(more, p) if q >= threshold]
    return base, sorted([*base, *more], key=lambda s: (s[1], RANK[s[0]]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def find(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs.

    Offsets are code points of the whole text, the end exclusive; a null text counts as empty and has no spans. Repeated rows
    come out repeated and other columns of docs aren't read. Without a model (no candidate anywhere) base spans are all.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    none = hashlib.sha256(b"").hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            n = np.zeros((4, b.num_rows), np.int64)
            digest, spans = [none] * b.num_rows, [""] * b.num_rows
            for k, text in zip(*_suspects(b)):
                base, every = all_spans(text, held.value, threshold)
                for kind, _, _ in base:
                    n[RANK[kind], k] += 1
                digest[k], spans[k] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, n), pa.array(digest), pa.array(spans)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or each run of overlapping ones, replaced by <KIND> of the first."""
    out, end = [], 0
    for kind, a, z in spans:
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, z)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of `text` masked; all other columns as they were, n_chars (if there) counted anew. A null text stays."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in T.slices(batches):
            at, texts = _suspects(b)
            new = {k: masked(t, all_spans(t, held.value, threshold)[1]) for k, t in zip(at, texts)}
            whole = b.column("text").to_pylist() if new else None
            col = b.column("text") if not new else pa.array([new.get(k, t) for k, t in enumerate(whole)], b.schema.field("text").type)
            yield pa.RecordBatch.from_arrays([col if c == "text" else b.column(c) for c in names], names)

    out = docs.mapInArrow(work, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
