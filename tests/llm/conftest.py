import pytest

WORDS = "the of and river stone cloud green walk seven light paper often".split()
LONG = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + str(i % 13) for i in range(12_000))
EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two  three"), (5, "one two three"), (6, "one two three"), (6, "one two three"),
    (7, "one\ttwo three"), (8, LONG), (9, LONG + " end"), (10, "Zürich ﬁn 日本語 ▁ x"), (11, "a" * 5000), (12, "One Two THREE"), (None, "no id here at all"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, blanks, repeated rows, very long texts, and extra columns with clashing names."""
    rows = [(i, t, "k", True, 3, 0.5) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, keep_id string, kept boolean, id int, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra string")


@pytest.fixture(scope="session")
def texts(spark, small):
    """doc_id and text of the small table, null as empty."""
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    return {r[0]: r[1] or "" for r in rows}
