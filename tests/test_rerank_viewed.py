"""Re-ranking by users' own views in one pass: as tag_affinity and rerank after each other, and with little to shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators import hybrid, statistics
from reelspark.plans import recommendation as R


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    watches = [(rng.randrange(1, 30), rng.choice([None, *range(40)]), rng.choice([None, 0.0, 0.25, 0.5, 1.0])) for _ in range(900)] + [(99, 3, 0.5), (None, 3, 0.5), (None, 3, 1.0)]
    candidates = [(rng.randrange(0, 32), rng.choice([None, *range(45)]), rng.choice([0.1, 0.25, 0.5, 0.9999999, 1.0]), rng.choice(["CF", "VISUAL"])) for _ in range(900)] + [(None, 3, 0.5, "CF"), (31, 44, 0.5, "CF")]
    tags = {(i, c, f"{c}{rng.randrange(9)}") for i in range(36) for c in ("genre", "director") for _ in range(3)}
    return (
        spark.createDataFrame(watches, "user_id long, item_id long, completion double"), spark.createDataFrame(candidates, "user_id long, item_id long, score double, type string"),
        spark.createDataFrame(sorted(tags), "item_id long, category string, value string"),
    )


@pytest.mark.parametrize(("together", "slots"), [(100_000, 0), (1, 0), (100, 3)])
def test_as_affinities_and_rerank(spark, tables, monkeypatch, together, slots):
    monkeypatch.setattr(hybrid, "TOGETHER", together)
    watches, candidates, tags = tables
    views = watches.select("user_id", "item_id", F.lit(1).alias("views"), "completion", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("type"))
    rows = views.unionByName(candidates.withColumns({"views": F.lit(0), "completion": F.lit(None).cast("double")}))
    best = candidates.groupBy("user_id", "item_id").agg(F.max("score").alias("score"), F.min("type").alias("type"))
    want = hybrid.rerank(best, tags, statistics.tag_affinity(watches, tags), 4, "CF", slots)
    with_batches, spark_conf = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf
    spark_conf.set(with_batches, "7")
    try:
        got = hybrid.rerank_viewed(rows, tags, 4, "CF", slots)
        columns = ["user_id", "item_id", "score", "type", "rank"]
        show = lambda f: sorted((tuple(-1 if x is None else x for x in r) for r in f.select(*columns).collect()), key=repr)
        assert show(got) == show(want)
    finally:
        spark_conf.unset(with_batches)


def test_tags_travel_as_numbers_and_once(spark, small):
    text = R.r3(spark, small)._jdf.queryExecution().sparkPlan().toString()
    assert text.count("Generate") <= 1 and "MapInArrow" in text and text.count("SortMergeJoin") <= 2


def test_fallback_meets_the_short_list_as_one_row(spark):
    frame = spark.createDataFrame
    own = frame([(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 7, 1)], "user_id long, item_id long, rank int")
    popular, users = frame([(5, 1), (6, 2), (7, 3), (8, 4)], "item_id long, rank int"), frame([(1,), (2,), (3,), (4,)], "user_id long")
    watches = frame([(2, 5), (2, 5), (2, 99), (4, 5), (4, 6), (4, 7), (4, 8)], "user_id long, item_id long")
    found = hybrid.filled_up(own, popular, users, watches, 3)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 7, 1, True), (1, 8, 2, True), (1, 9, 3, True), (2, 6, 2, False), (2, 7, 1, True), (2, 7, 3, False), (3, 5, 1, False), (3, 6, 2, False), (3, 7, 3, False)]
    assert "inline" in found._jdf.queryExecution().toString()


def test_tags_have_numbers_of_their_own(spark):
    tags = spark.range(200_000).select(F.lit("genre").alias("category"), F.col("id").cast("string").alias("value"))
    number = hybrid._number(tags)
    assert tags.select(number.alias("n")).distinct().count() == 200_000
