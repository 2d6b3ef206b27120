import pytest

from oracle import SF, same

from doclens.llm import queries as Q

N_DOCS = 200


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert same(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)


@pytest.mark.parametrize("name, columns", [
    ("op2_toxicity", {"doc_id", "toxic"}), ("op4_quality_rules", {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}),
    ("op7_pii", {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}), ("op8_token_pack", {"doc_id", "start", "n_tokens", "ids_crc32"}),
    ("op9_quality_knn", {"doc_id", "held_out", "score", "predicted"}), ("op10_simhash_near_dedup", {"doc_id", "fingerprint", "component_id"}),
])
def test_a_row_for_each_document(spark, name, columns):
    rows = Q.queries()[name](spark, SF)
    assert columns <= set(rows.columns)
    assert rows.count() == rows.select("doc_id").distinct().count() == N_DOCS


def test_nothing_else_imports_the_package():
    from pathlib import Path

    root = Path(Q.__file__).resolve().parents[1]
    users = [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and "doclens.llm" in p.read_text()]
    assert users == []
