"""Small tables with what operators must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], DOCS)


LONG = "Der lange Text hat viele Wörter und hört nicht auf. " * 4000
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n ", None, None), (4, "One two three four five six seven", "en", "a"), (5, "ONE two three four five six seven", "en", None),
    (5, "ONE two three four five six seven", "en", None), (None, "one two three four five six seven", "de", "b"), (7, LONG, "de", "b"), (8, "Éa éa", None, "b"), (9, "12 34 !", "en", "c"), (10, " x  y", "en", "c"),
]


def clashing(df, *names):
    """``df`` with further columns of these names."""
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("mine"))
    return df
