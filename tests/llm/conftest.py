import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rid string, words string, h string, look string"


@pytest.fixture(scope="session")
def make(spark, tmp_path_factory):
    """Rows (doc_id, text, lang, source) as a stored table with further columns whose names operators use inside."""

    def build(rows):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        full = [(d, t, lang, s, None if t is None else len(t), "r", "w", "h", "l") for d, t, lang, s in rows]
        spark.createDataFrame(full, SCHEMA).repartition(2).write.parquet(path)
        return spark.read.parquet(path)

    return build


LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))
EDGE = [
    (1, "Hello  big\tworld, this is one text.", "en", "a"), (2, "Hello big world, this is one text.", "en", "a"), (3, None, None, None), (4, "", "fr", "a"), (5, "   ", "fr", "b"),
    (6, "!!! 123 ###", None, "b"), (7, LONG, "en", "a"), (8, LONG, "en", "a"), (2, "Hello big world, this is one text.", "en", "a"), (None, "no id here", "de", "c"), (None, "no id here", "de", "c"),
    (9, "Ünïcödé ÀÉ straße naïve 漢字 кот", "de", None),
]


@pytest.fixture(scope="session")
def edge(make):
    return make(EDGE)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
