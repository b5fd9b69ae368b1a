import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

LONG = "word " * 30_000 + "x" * 50_000

#: Nulls, empty and very long texts, ties and repeated rows.
ODD = [
    (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "   \n\t", None, None, 5), (4, LONG, "en", "s", len(LONG)),
    (5, "a b c d e f", "en", "s", 11), (5, "a b c d e f", "en", "s", 11), (None, "a b c d e f", None, "t", 11),
    (6, "中文 \U0001f600 é", "zh", "t", 6), (7, "A B C D E F", "en", "s", 11), (8, "!!! ###", None, None, 7),
]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from rows; ``clash`` adds columns whose names an operator may use inside."""
    def make(rows, clash=()):
        schema = T.StructType(DOCS.fields + [T.StructField(c, T.StringType()) for c in clash])
        return spark.createDataFrame([(*r, *["x" for _ in clash]) for r in rows], schema)
    return make


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD, clash=["size", "fp", "label", "count", "own", "_id", "_text", "_data", "node", "component_id"])
