"""The choice of a clip: bounds of length, score, ties."""

from pyspark.sql import functions as F

from reelspark.operators.catalogue import ranked_clips


def ranked(spark, rows, words=("Trailer",)):
    clips = spark.createDataFrame(rows, "k string, item_id long, title string, duration int, most int")
    return sorted((r.k, r["rank"], r.item_id, r.score) for r in ranked_clips(clips, ["k"], list(words), 20, F.col("most")).collect())


def test_order_bounds_and_ties(spark):
    rows = [
        ("a", 1, "the TRAILER", 700, 1200), ("a", 2, "trailer", 300, 600), ("a", 3, "clip", 60, 600), ("a", 4, "trailer", 299, 600), ("a", 5, None, 59, 600),
        ("a", 6, "trailer", 19, 600), ("a", 7, "trailer", None, 600), ("a", 8, "trailer", 601, 600), ("a", 9, "clip", 20, 600), ("b", 10, "clip", 30, 600), ("b", 11, "clip", 600, 600), ("b", 12, "clip", 30, 600),
    ]
    assert ranked(spark, rows) == [("a", 1, 4, 5), ("a", 2, 2, 5), ("a", 3, 1, 3), ("a", 4, 3, 2), ("a", 5, 5, 1), ("a", 6, 9, 0), ("b", 1, 10, 1), ("b", 2, 12, 1), ("b", 3, 11, 1)]
    assert ranked(spark, []) == []
    assert [r[2] for r in ranked(spark, rows, ()) if r[0] == "a"] == [3, 4, 2, 5, 9, 1]
