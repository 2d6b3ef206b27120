import pytest

from doclens.llm.queries import tokenizer_path

CLASHING = ["label", "score", "h", "n", "key", "fp", "id", "term", "path", "line", "window", "at", "value", "_nth", "shift", "host", "part"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs(doc_id, text) with null, empty, very long and repeated rows as given, and columns whose names clash."""

    def make(*rows):
        names = ", ".join(f"`{c}` string" for c in CLASHING)
        return spark.createDataFrame([(*r, *["x"] * (len(CLASHING) - 1), None) for r in rows], f"doc_id long, text string, {names}")

    return make


LONG = "lorem ipsum dolor sit amet " * 20_000
EDGES = ((1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "one two three"), (5, "one two three"), (None, "null id"), (6, "żółw 漢字 🎉"), (7, "x" * 100_000))


@pytest.fixture(scope="session")
def edges(docs_of):
    return docs_of(*EDGES)


@pytest.fixture(scope="session")
def none(docs_of, edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def sf(spark):
    return {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").cache() for t in ("documents", "labels", "benchmark", "pages")}


@pytest.fixture(scope="session")
def path():
    return tokenizer_path
