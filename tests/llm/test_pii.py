import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from doclens.llm import pii as K

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and K.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, a, z) for a, _, kind, z in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0145()é", max_size=50))
def test_base_spans_are_the_plain_matches(text):
    assert K.base_spans(text) == brute(text)


def test_luhn():
    assert K.luhn("4111111111111111") and not K.luhn("4111111111111112")


def test_documents(sf):
    docs = sf["documents"]
    model = K.fit_model(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    kinds = set()
    for r in K.find(docs, model).collect():
        want = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == b for k, _, _ in want) for b in K.BASE)
        every = [x for x in r.spans.split(",") if x]
        assert {f"{k}:{a}:{z}" for k, a, z in want} <= set(every)
        kinds |= {x.split(":")[0] for x in every}
        assert all(text[r.doc_id][int(x.split(":")[1]) - 9 :].startswith('token = "') for x in every if x.startswith("secret"))
    assert kinds >= {*K.BASE, "secret"}


def test_labelers_that_agree_are_believed():
    import numpy as np

    patterns = np.array([[1, 1, 0], [-1, -1, 1], [1, 0, 1], [0, 0, 1]])
    p, theta = K.expectation_maximisation(patterns, np.array([400.0, 400.0, 30.0, 30.0]))
    assert p[0] > 0.9 and p[1] < 0.1
    assert theta[0, 1, 2] > theta[2, 1, 2]


def test_masks(spark, edges, none):
    docs = spark.createDataFrame([(1, "mail a.b@c.org now", "x", 18), (2, None, "y", None), (3, "1.2.3.4 and 5.6.7.8", "z", 19)], "doc_id long, text string, spans string, n_chars long")
    rows = K.redact(docs, None).orderBy("doc_id").collect()
    assert [(r.text, r.spans, r.n_chars) for r in rows] == [("mail <EMAIL> now", "x", 16), (None, "y", None), ("<IP> and <IP>", "z", 13)]
    assert K.masked("abcdef", [("a", 1, 4), ("b", 2, 5)]) == "a<A>f"
    assert K.redact(edges, K.fit_model(edges)).count() == 9 and K.fit_model(none) is None and K.find(none, None).count() == 0
    assert K.find(edges, None).where("spans = ''").count() == 9


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "+" + "(" * 200_000, "1." * 100_000, "@" * 100_000):
        K.all_spans(text, None)
