"""Aggregates over viewing history: items, days, age groups, users, satisfaction, popularity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.cleaning import freshness
from reelspark.operators.ranking import top_per_group


def watch_stats(watches: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Views of each item, those of the last ``days``, and mean completion and satisfaction."""
    recent = F.col("started_at") >= F.date_sub(as_of, days)
    return watches.groupBy("item_id").agg(F.count(F.lit(1)).alias("views"), F.count_if(recent).alias("views_7d"), F.avg("completion").alias("completion"), F.avg("satisfaction").alias("satisfaction"))


def tag_affinity(watches: DataFrame, tags: DataFrame, least: int = 2) -> DataFrame:
    """How much each user likes each tag of what they watched, 0 to 1, and on how many views that rests.

    Views are aggregated by user and item and meet each item's tags as one list, which is taken apart
    only where a user's rows are together: what is shuffled is a row for each user and item, not one for each tag of it.
    """
    by_item = watches.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"), F.sum("completion").alias("c"), F.count("completion").alias("k"))
    total = watches.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    listed = tags.groupBy("item_id").agg(F.collect_list(F.struct("category", "value")).alias("_tags")).hint("merge")  # small to Spark, which can't see what lists hold
    mine = by_item.join(listed, "item_id").repartition("user_id").select("user_id", "n", "c", "k", F.inline("_tags"))
    liked = mine.groupBy("user_id", "category", "value").agg(F.sum("n").alias("watch_count"), (F.sum("c") / F.nullif(F.sum("k"), F.lit(0))).alias("avg"))
    affinity = F.least(F.lit(1.0), F.col("watch_count") / F.col("total") * F.coalesce("avg", F.lit(0.5)) * 2)
    return liked.filter(F.col("watch_count") >= least).join(total, "user_id").select("user_id", "category", "value", affinity.alias("affinity"), "watch_count")


def bayesian_satisfaction(watches: DataFrame, seconds: Column, m: int = 5, least_seconds: int = 60) -> DataFrame:
    """Watches with completion and satisfaction: (v R + m C) / (v + m), v views of the item, R this view's completion, C the mean of all."""
    rate = F.when((seconds > 0) & (F.col("use_tms") > least_seconds), F.least(F.col("use_tms") / seconds, F.lit(1.0)))
    rated = watches.withColumn("_r", rate)
    mean = rated.agg(F.coalesce(F.avg("_r"), F.lit(0.5)).alias("_c"))
    counts = watches.groupBy("item_id").agg(F.count(F.lit(1)).alias("_v"))
    value = (F.col("_v") * F.col("_r") + m * F.col("_c")) / (F.col("_v") + m)
    return rated.join(counts, "item_id").crossJoin(F.broadcast(mean)).withColumns({"completion": F.round(F.coalesce("_r", F.lit(0.0)), 4), "satisfaction": F.round(F.coalesce(value, F.lit(0.0)), 4)}).drop("_r", "_v", "_c")


@dataclass(frozen=True)
class Popularity:
    """Weights of the popularity score: of items without history, and of those with enough of it."""

    cold_vote: float = 0.45
    cold_fresh: float = 0.55
    warm_heat: float = 0.45
    warm_quality: float = 0.25
    warm_vote: float = 0.15
    warm_fresh: float = 0.15
    warm_views: int = 10
    quality_views: int = 5
    vote_cap: int = 10


def popularity(series: DataFrame, stats: DataFrame, as_of: Column, p: Popularity = Popularity()) -> DataFrame:
    """Items with their popularity score, blended from votes, freshness, recent views and quality.

    ``series``: item_id, vote_avg, vote_cnt, release_date; ``stats`` as from watch_stats. The two
    figures over all items are one row each.
    """
    rows = series.join(stats.select("item_id", "views", "views_7d", "completion", "satisfaction"), "item_id", "left")
    overall = rows.agg(F.max(F.coalesce("vote_cnt", F.lit(0))).alias("_most"), F.avg(F.when(F.col("views_7d") > 0, F.col("views_7d"))).alias("_heat"))
    rows = rows.crossJoin(F.broadcast(overall))
    votes, views = F.coalesce("vote_cnt", F.lit(0)), F.coalesce("views", F.lit(0))
    vote = F.when(F.col("_most") > 0, F.coalesce("vote_avg", F.lit(0.0)) / 10 * F.log1p(votes) / F.log1p("_most") * F.least(votes, F.lit(p.vote_cap)) / p.vote_cap).otherwise(0.0)
    heat = F.coalesce(F.least(F.coalesce("views_7d", F.lit(0)) / F.col("_heat"), F.lit(5.0)) / 5.0, F.lit(0.0))
    quality = F.when(views >= p.quality_views, F.coalesce("completion", F.lit(0.0)) * F.coalesce("satisfaction", F.lit(0.0))).otherwise(0.0)
    fresh = freshness(F.col("release_date"), as_of)
    cold = p.cold_vote * vote + p.cold_fresh * fresh
    warm = p.warm_heat * heat + p.warm_quality * quality + p.warm_vote * vote + p.warm_fresh * fresh
    blend = F.least(views / p.warm_views, F.lit(1.0))
    return rows.withColumns({"vote_score": vote, "freshness": fresh, "watch_heat": heat, "quality": quality, "score": (1 - blend) * cold + blend * warm}).drop("_most", "_heat", "views", "views_7d", "completion", "satisfaction")


def activity_segment(watches: DataFrame, warm: int, hot: int) -> DataFrame:
    """Users as cold, warm or hot by how many items they watched."""
    n = watches.groupBy("user_id").agg(F.count_distinct("item_id").alias("items"))
    return n.withColumn("segment", F.when(F.col("items") >= hot, "hot").when(F.col("items") >= warm, "warm").otherwise("cold"))


def profile(frame: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """One row for each column: rows, nulls, and values out of range. One pass over the data."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(frame.columns):
        aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{i}")]
        lo, hi = ranges.get(c, (None, None))
        aggs += [(F.count_if(~F.col(c).between(lo, hi)) if lo is not None else F.lit(0).cast("long")).alias(f"out_{i}")]
    one = frame.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("rows"), F.col(f"null_{i}").alias("nulls"), F.col(f"out_{i}").alias("out_of_range")) for i, c in enumerate(frame.columns)])
    return one.select(F.inline(cells))


def profile_keys(rows: DataFrame, key: str, value: str, expected: DataFrame, least: float, most: float) -> DataFrame:
    """(key, rows, nulls, least, most, out_of_range, state) of each key of ``rows`` and of ``expected`` (key): state is ok, missing (expected, and without a row) or unexpected.

    Null keys of ``rows`` are a key that none expects.
    """
    of_key = rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(value).alias("least"), F.max(value).alias("most"), F.count_if(~F.col(value).between(least, most)).alias("out_of_range"))
    both = of_key.join(expected.select(F.col(key).alias("_want")).filter("_want IS NOT NULL").distinct(), F.col("_key") == F.col("_want"), "full_outer")
    state = F.when(F.col("rows").isNull(), "missing").when(F.col("_want").isNull(), "unexpected").otherwise("ok")
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(F.coalesce("_key", "_want").alias(key), none("rows"), none("nulls"), "least", "most", none("out_of_range"), state.alias("state"))


def top_by_group(watches: DataFrame, owners: DataFrame, group: str, n: int = 50, least: int = 10) -> DataFrame:
    """(group, item_id, views, satisfaction, rank): in each group of users the ``n`` items of highest mean satisfaction, of those with at least ``least`` views in it."""
    stats = watches.join(owners.select("user_id", group), "user_id").groupBy(group, "item_id").agg(F.count(F.lit(1)).alias("views"), F.round(F.avg("satisfaction"), 6).alias("satisfaction"))
    return top_per_group(stats.filter(F.col("views") >= least), [group], [F.desc("satisfaction"), F.col("item_id")], n)


def coverage_by_type(items: DataFrame, vectors: DataFrame, kind: str, length: Column, least: float, most: float) -> DataFrame:
    """(kind, items, with_vector, odd): of each type how many items there are, how many have a vector, and how many vectors are of odd ``length``."""
    measured = vectors.select("item_id", length.alias("_length"))
    return items.select("item_id", kind).join(measured, "item_id", "left").groupBy(kind).agg(F.count(F.lit(1)).alias("items"), F.count("_length").alias("with_vector"), F.count_if(~F.col("_length").between(least, most)).alias("odd"))


def gap_runs(rows: DataFrame, keys: list[str], at: Column, gap: float) -> DataFrame:
    """Rows with the number of their run: a new one begins after more than ``gap``."""
    w = Window.partitionBy(*keys).orderBy("_at")
    r = rows.withColumn("_at", at)
    return r.withColumn("_s", F.coalesce((F.col("_at") - F.lag("_at").over(w) > gap).cast("int"), F.lit(1))).withColumn("run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_at", "_s")
