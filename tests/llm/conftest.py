import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with every odd case: nulls, empty texts, repeats, near copies, clashing columns."""
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60 ", "x60 ")
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, f"start {passage} end", "de", "a"),
        (5, f"other Words {passage} tail", "de", None), (6, None, "en", "a"), (7, "", None, "b"), (8, "one two", "en", "a"),
        (9, "one two", "en", "a"), (10, "  \t\n ", "en", "a"), (None, base, None, None), (None, "lonely text without an id", "en", "a"),
        (12, "word " * 300, "en", "a"), (13, "word " * 300, "en", "a"), (14, "é ü ñ " * 4000, "fr", "c"), (14, "é ü ñ " * 4000, "fr", "c"),
        (16, "#### $$$$ %%%%\nline one\nline one\n", "en", "b"), (17, "Released under the MIT License. the mit license", "en", "b"),
    ]
    rows = [(*r, len(r[1] or ""), "mine", 7) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_hash string, score int").repartition(5)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
