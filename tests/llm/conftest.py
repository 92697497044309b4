import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven old monks sing quietly near an open gate".split()

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int, score double, component string, node string"


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, None if text is None else len(text), 1, 0.5, "x", "y")


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, and columns whose names clash."""
    base = " ".join(WORDS[(i * i) % 19] + str(i) for i in range(200))
    near = base + " tail"
    rows = [
        doc(1, base),
        doc(2, base),
        doc(3, near, source=None),
        doc(4, None),
        doc(5, ""),
        doc(6, " \t\n"),
        doc(7, "one two", lang=None),
        doc(8, "ONE two"),
        doc(9, "word " * 30_000, source="t"),
        doc(10, "é漢🎉 " * 50, lang="fr"),
        doc(10, "é漢🎉 " * 50, lang="fr"),
        doc(11, "x" * 50_000),
        doc(12, "a b c d e f g"),
        doc(13, "\x00\x0b12345 67"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
