from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("h", T.StringType()),
    T.StructField("node", T.StringType()), T.StructField("candidate", T.StringType()), T.StructField("size", T.StringType()),
])


def docs(spark, rows):
    """rows of (doc_id, text, lang, source); the other columns clash with names used inside the operators."""
    return spark.createDataFrame([(*r, None, "x", "y", "z", "w") for r in rows], SCHEMA)


def awkward(spark, n=60):
    rows = [(i, f"Word{i % 7} alpha beta {i} gamma\tdelta" * (1 + i % 3), "en" if i % 3 else None, f"s{i % 4}") for i in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, " \n\t ", "en", None), (n + 3, "long " * 20000, "de", "s2"), (n + 4, "é😀 ü" * 5, "fr", "s\U0001F600")]
    rows += [(3, "Word3 alpha beta 3 gamma\tdelta", "en", "s3")] * 2 + [(None, "no id", "en", "s0")]
    rows += [(1000 + i, "hot copy of a text", "en", "s0") for i in range(30)]
    return docs(spark, rows)
