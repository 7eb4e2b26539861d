"""Documents that every operator has to cope with."""

from pyspark.sql import types as T

# Helper names of the operators as extra columns: they must not clash.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(n, T.StringType()) for n in ("fp", "uid", "size", "salt", "rank", "score", "spans", "_id", "g", "node")),
])


def frame(spark, texts, ids=None):
    """A documents table with clashing extra columns; ``ids`` may repeat or be null."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, None if i and i % 3 == 0 else "en", "s", len(t or ""), *["x"] * 10) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \t\n", "x", "a b c", "é" * 50, "word " * 3000, "\x00\x0b weird\r\n", "0" * 5000, "same text here", "same text here"]
