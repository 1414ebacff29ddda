"""Awkward documents that every operator must take."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("label", T.StringType()), T.StructField("node", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("score", T.DoubleType())])
LONG = "word number one and two, " * 40_000
ROWS = [
    (1, None, "en", "a", 0, "x", 1, "k", 0.1), (2, "", "en", "a", 0, "x", 1, "k", 0.1), (3, " \t\n ", None, "a", 4, "x", 1, "k", 0.1),
    (4, "four words are here", "en", None, 19, "x", 1, "k", None), (5, "Four  words\tARE here", "en", "b", 19, "x", 1, "k", 0.1),
    (6, LONG, "en", "a", len(LONG), None, None, None, None), (7, LONG, "en", "a", len(LONG), "x", 1, "k", 0.1),
    (8, "une phrase à part, écrite ici pour voir", "fr", "a", 30, "x", 1, "k", 0.1), (8, "une phrase à part, écrite ici pour voir", "fr", "a", 30, "x", 1, "k", 0.1),
    (9, "日本語 😀 １２３ \x00 ▁ ​ end  ", "ja", "c", 10, "x", 1, "k", 0.1), (None, "no id on this row at all today", "en", "c", 10, "x", 1, "k", 0.1),
    (10, "12345 67890 --- !!!", "en", "c", 10, "x", 1, "k", 0.1),
]


def edge_docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
