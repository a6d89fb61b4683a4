import pytest

#: Columns whose names the operators use themselves.
CLASH = ("fp", "key", "h", "lang", "n", "page", "sig", "held", "block", "token", "_id", "_key", "members", "score", "_language", "_line_dedup_found", "_near_key", "number", "kept")


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text) as documents, with columns whose names clash with inner ones."""

    def make(rows, lang=None):
        df = spark.createDataFrame([(*r[:2], r[2] if len(r) > 2 else lang, "src", len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        from pyspark.sql import functions as F

        return df.select("*", *(F.lit(1).alias(c) for c in CLASH if c not in df.columns))

    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty and blank texts, repeated rows, a null id, case, a very long text, odd characters."""
    words = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    return [
        (1, "Alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "alpha BETA gamma delta epsilon zeta"), (4, "alpha BETA gamma delta epsilon zeta"), (5, " \t\n\v\f\r "), (None, "alpha beta gamma delta epsilon zeta"), (6, words), (7, words + "."),
        (8, "naïve Straße ÄÖÜ  x😀\u0085y"), (9, "one"), (10, "a b c d e f g\na b c d e f g\n\nshort\na b c d e f g h"),
    ]
