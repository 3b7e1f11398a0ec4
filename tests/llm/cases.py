"""Odd rows that every operator must take."""

from pyspark.sql import functions as F

LONG = "long words " * 20000
ODD = [(1001, None), (None, "an id that is null and a text"), (None, None), (1002, ""), (1003, " \n\t "), (1004, LONG), (1005, "same text here twice"), (1005, "same text here twice"), (1006, "same text here twice"), (1007, "x" * 50000), (1008, "日本語 😀 é")]


def frame(spark, rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string").repartition(3)


def with_clashes(df):
    """Extra columns named as operators' own are."""
    for name in ("keep_id", "key", "root", "node", "id", "rest", "spans", "lo", "tag", "of", "ids", "bin_id", "digest", "a", "b", "dk", "n", "k", "__d", "__id", "__all", "__any", "__text", "__g", "row_id", "mark_id", "text_of_row", "a.b", "x`y"):
        df = df.withColumn(name, F.lit(7))
    return df.withColumn("n_chars", F.char_length("text").cast("long"))
