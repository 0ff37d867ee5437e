import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents out of (doc_id, text[, lang, source]) tuples."""

    def docs(rows, extra=""):
        full = [(*r, *("en", "a")[len(r) - 2 :], None if r[1] is None else len(r[1])) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, DOCS + extra)

    return docs


@pytest.fixture(scope="session")
def odd(spark, make):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns whose names clash with internal ones."""
    long = "the quick brown fox jumps over the lazy dog and runs away again. " * 400
    rows = [
        (1, "alpha beta gamma delta epsilon", "en", "a"), (2, None, "fr", "b"), (None, "alpha beta gamma delta epsilon", None, None), (4, "", None, "a"), (5, long, "en", "b"), (6, long + "x", "en", "b"), (7, " \t\n ", "en", None),
        (8, "alpha beta gamma delta epsilon", "en", "a"), (8, "alpha beta gamma delta epsilon", "en", "a"), (9, "a\nb\nc\nd\ne\na\nb\nc\nd\ne", "de", "c"), (None, None, None, None),
    ]
    from pyspark.sql import functions as F

    clash = {c: F.lit(7) for c in ("_key", "_row", "key", "size", "shard", "id", "nul", "copies", "_copies", "rank", "n", "_keep", "_bad", "fp", "node", "language", "kept", "_id", "_y", "_src", "_part", "_unit", "_h", "_nul", "held_out", "window", "start", "_turned", "row", "take", "phrase", "asked", "word", "seg", "_place", "_share")}
    return make(rows).withColumns(clash)


@pytest.fixture(scope="session")
def none(make):
    return make([])
