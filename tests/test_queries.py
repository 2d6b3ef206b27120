import pytest

from oracle import SF, same

from doclens.plans import registry

MAY_BE_EMPTY = {"secret_scan"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    n = same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)
    assert n or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count()


def test_entry(spark):
    assert registry.entry(spark, SF).columns == ["doc_id", "line_no", "name", "dosage"]


@pytest.mark.parametrize("name, most", [("entities_long", 80), ("field_scores", 80), ("documents_record", 180)])
def test_lines_are_gone_through_once(spark, name, most):
    """A record's items come from one pass over the lines of a corpus, so that few patterns stand in its plan."""
    assert registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") < most


def test_values_of_records_are_found_once(spark):
    """What checks and records start from is kept, so that the last plan holds no extraction."""
    assert registry.queries()["documents_record"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") < 60
