"""Connected components of a graph that stays on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import materialise, remove, shared_folder

#: A node with more neighbours than this, and more than one in HUBS_MOST of all ends of edges, is a hub.
HUB_LEAST, HUBS_MOST = 50_000, 50_000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node of its component.

    Alternates the large-star and small-star steps until nothing changes; each round is written to
    shared storage, and the one before is removed. Minima are pre-aggregated. The neighbours of a
    hub don't meet in one task: its minimum goes to them as a broadcast, of HUBS_MOST rows at most,
    as there can't be more hubs. Self links and repeated edges are harmless; an edge with a null end
    is left out.

    Rounds grow with the logarithm of the longest path (its square at worst), so that 60 are enough
    for any graph that can be stored; an error tells if they weren't.
    """
    spark = edges.sparkSession
    a, b = F.least("a", "b"), F.greatest("a", "b")
    path = shared_folder(spark)
    now = materialise(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(b.alias("u"), a.alias("v")).distinct(), path)
    seen = _state(now)
    for _ in range(most_rounds):
        if seen[0] == 0:
            break
        hub = max(HUB_LEAST, -(-2 * seen[0] // HUBS_MOST))
        hub = hub if seen[2] > hub else None
        after = shared_folder(spark)
        now = materialise(_small_star(_large_star(now, hub), hub), after)
        remove(spark, path)
        path, state = after, _state(now)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """How many edges there are, a sum of their hashes, and the most that one node has."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("u"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("h"))
    by_node = ends.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"))
    row = by_node.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("h"), F.lit(0)).alias("h"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    return row["n"] // 2, int(row["h"]), row["most"]


def _with_least(edges: DataFrame, least: DataFrame, hub: int | None) -> DataFrame:
    """``edges`` with the ``m`` of their ``u`` from ``least`` (u, m, n). Nodes of over ``hub`` edges are hubs; None: there are none."""
    if hub is None:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= hub).select("u", "m"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def _large_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """Each node sends the smallest of its neighbours and itself to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.filter("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, hub: int | None) -> DataFrame:
    """Each node sends the smallest of its smaller neighbours to those and itself. Edges run from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(edges, least, hub).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
