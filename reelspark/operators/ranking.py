"""Ranking, de-duplication and splits. Every order ends with an id, so ties are settled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with a rank from 1. Spark keeps only ``n`` rows of a group before it shuffles."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def deduplicated_top(rows: DataFrame, keys: list[str], series: Column, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, one for each series, ranked anew."""
    one = top_per_group(rows.withColumn("_series", series), [*keys, "_series"], order, 1, "_first").drop("_first", "_series")
    return top_per_group(one, keys, order, n)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``, given descending."""
    return top_per_group(rows, keys, order, 1, "_n").drop("_n")


#: Rounds of ``greedy_distinct``; what is still open then is decided by a fold.
ROUNDS = 24


def greedy_distinct(candidates: DataFrame, one_source_types: tuple[str, ...], write: Callable[[DataFrame], DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """Each user's candidates by falling score, without items and sources that an accepted one before has.

    Sources count only for the types named. A row that is turned down for its source doesn't use up
    its item. Equal scores go by type, item and source; null items and sources never clash.
    ``candidates``: user_id, item_id, score, type, source_id. ``write`` writes a frame to shared
    storage and reads it back.

    Works in rounds. Within an item, what comes after a row without a source is turned down, and its first row has the item
    for itself; such a row uses up its source too, by itself or by one before it, so what comes after it in the source is turned down. A row that
    is the first of its item and of its source is accepted. So no list of a user is ever in one place, a round moves
    all rows by item once and those with a source once more, and most rows are decided in the first. Chains of clashes, of which each round takes a link, are left to a
    fold over a user's remaining rows in their order, which keeps only what they have used up.
    """
    columns = ["user_id", "item_id", "score", "type", "source_id"]
    source = F.when(F.coalesce(F.col("type").isin(*one_source_types), F.lit(False)), F.col("source_id"))
    order = [-F.col("score"), F.col("type"), F.col("item_id"), F.col("source_id")]
    by_item = Window.partitionBy("user_id", "item_id").orderBy(*order)
    by_source = Window.partitionBy("user_id", "_s").orderBy(*order, F.desc("_first"))  # of equal rows the one that is the first of the item
    item = F.col("item_id").isNotNull()

    def none_before(flag: Column, w) -> Column:
        return ~F.coalesce(F.max(flag).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))

    left, accepted = candidates.select(*columns), []
    for _ in range(rounds):
        marks = {"_open": ~item | none_before(F.col("_s").isNull(), by_item), "_first": ~item | (F.row_number().over(by_item) == 1), "_more": item & F.lead(F.lit(True)).over(by_item).isNotNull()}
        marked = write(left.withColumn("_s", source).withColumns(marks).filter("_open").drop("_open", "_s")).withColumn("_s", source)
        firsts = marked.filter("_s IS NOT NULL").withColumns({"_open": none_before(F.col("_first"), by_source), "_wins": F.col("_first") & (F.row_number().over(by_source) == 1)})
        picked = write(firsts.filter("_open").drop("_open", "_s"))
        won = picked.filter("_wins")
        accepted += [marked.filter("_s IS NULL AND _first").select(*columns), won.select(*columns)]
        rest = marked.filter("_s IS NULL AND NOT _first").select(*columns).unionByName(picked.filter("NOT _wins").select(*columns))
        left = write(rest.join(won.filter("_more").select("user_id", "item_id"), ["user_id", "item_id"], "left_anti").select(*columns))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, accepted)
    ordered = left.withColumn("_s", source).repartition("user_id").sortWithinPartitions("user_id", *order)
    return reduce(DataFrame.unionByName, [*accepted, ordered.mapInPandas(_folded, left.schema)])


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by user and order in, those out that clash with none before."""
    user, items, sources = None, set(), set()
    for batch in batches:
        keep = []
        for u, i, s in zip(batch["user_id"], batch["item_id"], batch["_s"], strict=True):
            if u != user:
                user, items, sources = u, set(), set()
            clashes = not pd.isna(i) and i in items or not pd.isna(s) and s in sources
            if not clashes:
                items.add(i)
                sources.add(s)
            keep.append(not clashes)
        yield batch[keep].drop(columns="_s")


def quota_blend(scored: DataFrame, engine: str, slots: int, n: int) -> DataFrame:
    """``n`` rows for each user: the best ``slots`` of one engine first, then the others by score. ``scored``: user_id, item_id, score, type."""
    order = [F.desc("score"), F.col("item_id")]
    mine = F.row_number().over(Window.partitionBy("user_id", "type").orderBy(*order))
    first = (F.col("type") == engine) & (mine <= slots)
    rows = scored.withColumn("_first", first.cast("int"))
    return top_per_group(rows, ["user_id"], [F.desc("_first"), *order], n).drop("_first")


def minmax_by_type(rows: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within each type; one value alone becomes 0.5; a single type stays as it is."""
    stats = rows.groupBy("type").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    types = stats.agg(F.count(F.lit(1)).alias("_types"))
    scaled = F.when(F.col("_types") <= 1, F.col("score")).when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    # a row for each type: as many as there are engines
    return rows.join(F.broadcast(stats.crossJoin(types)), "type").withColumn("score", scaled).select(rows.columns)


def holdout_last_item(watches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train, truth): of each user with at least two distinct items the greatest item is held out."""
    pairs = watches.select("user_id", "item_id").distinct()
    truth = pairs.groupBy("user_id").agg(F.max("item_id").alias("item_id"), F.count(F.lit(1)).alias("n")).filter("n >= 2").select("user_id", "item_id")
    return pairs.join(truth, ["user_id", "item_id"], "left_anti"), truth


def stratified(rows: DataFrame, stratum: str, quotas: DataFrame, total: int, order: list[Column]) -> DataFrame:
    """The first rows of each stratum up to its quota, then others in order until there are ``total``. ``quotas``: stratum, quota."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).join(F.broadcast(quotas), stratum, "left")
    within = F.coalesce(F.col("_n") <= F.col("quota"), F.lit(False))
    return ranked.withColumn("_late", (~within).cast("int")).orderBy("_late", *order).limit(total).drop("_n", "quota", "_late")
