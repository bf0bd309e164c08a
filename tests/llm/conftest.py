import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("shard", T.StringType()),
        T.StructField("copy", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("fp", T.StringType()),
    ]
)

LONG = "the quick brown fox jumps over the lazy dog and runs away " * 4000
ODD_TEXTS = [None, "", " \n\t", "one", "two words", LONG, LONG + "x", "Ünïcode ſtraße ΑΣ", "a b c d e f g", "a b c d e f g"]


@pytest.fixture
def make_docs(spark):
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [
            (i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"src{n % 2}", None, "s", "c", "x", "f")
            for n, (i, t) in enumerate(zip(ids, texts))
        ]
        return spark.createDataFrame(rows, DOC)

    return make


@pytest.fixture
def odd_docs(make_docs):
    """Nulls, empty and very long texts, repeated rows, repeated and null ids, clashing names."""
    return make_docs(ODD_TEXTS + ODD_TEXTS[-3:], [0, 1, 2, 3, None, None, 6, 7, 8, 9, 7, 8, 8])
