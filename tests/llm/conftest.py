import pytest

# Names the operators use inside, to show that a table may have them too.
EXTRA = ("size", "score", "key", "target", "id_range", "tie", "node", "hash", "start", "items", "spans", "range")

LONG = " ".join(f"word{i % 4000}" for i in range(30_000))


def documents(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *range(len(EXTRA))) for i, t, s in rows], schema)


MESSY = [
    (None, None, None),
    (None, "a text without an id", "b"),
    (1, "", "a"),
    (2, None, "a"),
    (3, " \t\n ", None),
    (4, "one", "b"),
    (5, "the same words in two places of this table are a copy of each other", "a"),
    (6, "the same words in two places of this table are a copy of each other", "b"),
    (6, "the same words in two places of this table are a copy of each other", "b"),
    (6, "another text under an id that is not its own", "c"),
    (7, LONG, "a"),
    (8, LONG + " end", None),
    (-9, "größe ñandú 漢字 \U0001f600 naïve\x1cx\x85y", "z"),
]


@pytest.fixture(scope="session")
def messy(spark):
    return documents(spark, MESSY)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


@pytest.fixture(scope="session")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
