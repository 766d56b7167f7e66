import pytest


def same(rows):
    return sorted(map(str, rows))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns that clash with the operators' own names."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    rows = [
        (1, word * 3, "en", "a", 1), (2, None, "en", "a", 1), (3, "", None, None, None), (4, " \n\t ", "en", "b", 3),
        (None, word * 3, "en", "a", 1), (None, None, None, None, None), (5, word * 3, "en", "a", 1), (5, word * 3, "en", "a", 1),
        (6, "one two", "en", "c", 7), (7, "x" * 70_000, "en", "b", 70_000), (8, "mail a.b@c.example.org now\n" * 4000, "en", "b", 9),
        (9, "call +66 81 234 5678 or 10.0.0.1 and é▁\x00 \U0001f600", "fr", None, 5),
    ]
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(f"own {c}") for c in ("key", "k", "score", "spans", "node", "row", "size", "token", "turn", "start", "kept", "label", "host", "n", "a", "b")}
    return df.withColumns(extra)
