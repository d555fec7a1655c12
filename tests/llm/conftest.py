import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with the other columns filled in."""
    def make(pairs, lang="en", source="src0"):
        return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(docs_of):
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30000))
    pairs = [(1, None), (2, ""), (3, "   \n\t "), (4, long), (5, long), (6, "one two three"), (6, "one two three"), (6, "other text"),
             (None, "no id here at all"), (7, "a " * 60), (8, "a " * 45 + "b"), (9, "\n\n\n"), (10, "é ü 日本   x")]
    return docs_of(pairs).withColumns({c: F.lit("clash") for c in ("_id", "_text", "blk", "bucket", "length", "host", "h", "label", "g", "piece", "_host", "_drop", "_salt", "_spread", "_kept", "_lines", "_dropped", "_row_key", "_rank", "_again")})
