import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    passage = " ".join(f"passage{i}" for i in range(60))
    texts = [
        (0, "First line of some length\n  A shared LINE here \nshort\nshort", "en", "a", 1),
        (1, "a shared line here\nown line of document one\n\n", "en", "a", None),
        (2, "A SHARED LINE HERE", None, "a", 3),
        (3, None, "en", None, None),
        (4, "", "en", "b", 0),
        (5, passage, "de", "b", 5),
        (6, passage + " extra", "de", "b", 5),
        (6, passage + " extra", "de", "b", 5),
        (7, "x" * 5000 + " " + " ".join(f"w{i % 977}" for i in range(30_000)), "fr", "c", 9),
        (None, "a shared line here", "en", "c", 1),
        (8, " \n \t \n", "en", "c", 1),
        (9, "Grüße ñandú Ünïcode déjà-vu 你好 世界 \U0001f600", "es", "c", 1),
    ]
    clash = [(*t, -1, -2, "x") for t in texts]
    return spark.createDataFrame(clash, DOCS + ", n_lines long, score long, h1 string")
