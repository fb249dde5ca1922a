"""Offline evaluation of ranked recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.ranking import top_per_group


def single_truth(recommended: DataFrame, truth: DataFrame, k: int, catalogue_size: int | None = None) -> DataFrame:
    """One row: users, NDCG, MRR, hit rate and precision at ``k`` where each user has one true item, and how many items were shown.

    ``recommended``: user_id, item_id, rank; ``truth``: user_id, item_id. Users without recommendations count as missed.
    """
    shown = recommended.filter(F.col("rank") <= k)
    hits = truth.join(shown, ["user_id", "item_id"], "left")
    gain = F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0))
    one = hits.agg(F.count(F.lit(1)).alias("users"), F.avg(gain).alias("ndcg"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.avg(F.col("rank").isNotNull().cast("double")).alias("hit_rate"))
    out = one.withColumn("precision", F.col("hit_rate") / k)
    items = shown.agg(F.count_distinct("item_id").alias("items_shown"))
    return out.crossJoin(items)


def set_truth(recommended: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hit rate, precision, recall and NDCG at ``k`` over users that have both recommendations and true items."""
    shown = recommended.filter(F.col("rank") <= k)
    both = shown.select("user_id").distinct().intersect(truth.select("user_id").distinct())
    n_true = truth.join(both, "user_id", "left_semi").groupBy("user_id").agg(F.count_distinct("item_id").alias("t"))
    hits = shown.join(truth.distinct(), ["user_id", "item_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("h"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("t"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    rows = n_true.join(hits, "user_id", "left").withColumns({"h": F.coalesce("h", F.lit(0)), "dcg": F.coalesce("dcg", F.lit(0.0))})
    return rows.agg(F.count(F.lit(1)).alias("users"), F.avg((F.col("h") > 0).cast("double")).alias("hit_rate"), F.avg(F.col("h") / k).alias("precision"), F.avg(F.col("h") / F.col("t")).alias("recall"), F.avg(F.col("dcg") / ideal).alias("ndcg"))


def via_history(similar: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """(user_id, item_id, rank): item-to-item lists as recommendations: for each user the best rank over all watched sources, watched items left out.

    ``similar``: source_id, item_id, rank.
    """
    # a source's list travels as one row; taken apart where the user is, it meets there what the user has watched
    found = F.struct("item_id", "rank", F.lit(False).alias("seen"))
    lists = similar.groupBy("source_id").agg(F.collect_list(found).alias("_similar")).hint("merge")
    own = F.array(F.struct(F.col("source_id").alias("item_id"), F.lit(None).cast(similar.schema["rank"].dataType).alias("rank"), F.lit(True).alias("seen")))
    past = history.select("user_id", F.col("item_id").alias("source_id")).join(lists, "source_id", "left")
    past = past.select("user_id", F.concat(own, F.coalesce("_similar", F.slice(own, 1, 0))).alias("_items")).repartition(int(history.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")
    best = past.select("user_id", F.inline("_items")).groupBy("user_id", "item_id").agg(F.min("rank").alias("best"), F.bool_or("seen").alias("seen"))
    return top_per_group(best.filter("NOT seen"), ["user_id"], [F.col("best"), F.col("item_id")], k).select("user_id", "item_id", "rank")


def by_series(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, item_id[, rank]) with the smallest item of the series in place of an episode, so that any episode counts as a hit."""
    key = items.filter("series_nm IS NOT NULL").groupBy("series_nm").agg(F.min("item_id").alias("_first"))
    series = items.select("item_id", "series_nm").join(key, "series_nm").select("item_id", "_first")
    out = rows.join(series, "item_id", "left").withColumn("item_id", F.coalesce("_first", "item_id")).drop("_first")
    if "rank" in rows.columns:
        return out.groupBy("user_id", "item_id").agg(F.min("rank").alias("rank"))
    return out.select("user_id", "item_id").distinct()


def attribute_precision(similar: DataFrame, items: DataFrame, attribute: str, k: int) -> DataFrame:
    """One row: the mean over sources of the share of their ``k`` neighbours that share the attribute; nulls are left out."""
    a = items.select(F.col("item_id").alias("source_id"), F.col(attribute).alias("_a"))
    b = items.select("item_id", F.col(attribute).alias("_b"))
    rows = similar.filter(F.col("rank") <= k).join(a, "source_id").join(b, "item_id").filter("_a IS NOT NULL AND _b IS NOT NULL")
    each = rows.groupBy("source_id").agg(F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("p"))
    return each.agg(F.count(F.lit(1)).alias("sources"), F.avg("p").alias("precision"))
