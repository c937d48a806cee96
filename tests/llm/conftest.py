import pytest

SF001, SF01, SF1 = (f"/root/testdata/sf{x}" for x in ("0.001", "0.01", "0.1"))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n int, node string, h string, score string, kept string, l int, c int, rid int, label string"


def document_frame(spark, rows):
    """``rows`` of (doc_id, text, lang, source); the other columns carry names that operators use inside."""
    return spark.createDataFrame([(*r, None, -1, -2, "x", "y", "s", "k", 3, 4, 5, None) for r in rows], SCHEMA)


LONG = " ".join(f"wort{i % 977} lang{i % 31}" for i in range(60_000))
EDGES = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", None, "a"),
    (4, "one two three", "en", None),
    (4, "one two three", "en", None),
    (None, "a row without an id, of more than five words", "en", "a"),
    (5, LONG, "de", "b"),
    (6, LONG, "de", "b"),
    (7, "12 345 --- !!", None, "b"),
    (8, "Öl über älteren Maß\n\nÖl über älteren Maß", "de", "b"),
    (9, "<|endoftext|> is a special string", "en", "a"),
    (10, "x" * 50_000, "en", "a"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return document_frame(spark, EDGES)


@pytest.fixture(scope="session")
def empty(spark):
    return document_frame(spark, [])
