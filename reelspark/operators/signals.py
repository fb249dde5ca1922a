"""Detections on an item's timeline: boxes, buckets, clusters, triggers and their verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes [x1, y1, x2, y2]."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    shared = width * height
    return F.when(shared > 0, shared / (area(a) + area(b) - shared)).otherwise(0.0)


def suppress_frames(scores: DataFrame, threshold: float, frame: tuple[str, ...] = ("item_id", "at")) -> DataFrame:
    """Positive concepts at or over ``threshold``, without frames whose best negative score is no lower than their best positive one.

    ``scores`` needs concept, score, negative (boolean) and the frame's columns. One shuffle by frame.
    """
    w = Window.partitionBy(*frame)
    negative = F.coalesce(F.max(F.when(F.col("negative"), F.col("score"))).over(w), F.lit(0.0))
    positive = F.coalesce(F.max(F.when(~F.col("negative") & (F.col("score") >= threshold), F.col("score"))).over(w), F.lit(0.0))
    rows = scores.withColumns({"_n": negative, "_p": positive})
    return rows.filter(~((F.col("_n") >= F.col("_p")) & (F.col("_n") > 0)) & ~F.col("negative") & (F.col("score") >= threshold)).drop("_n", "_p", "negative")


def with_context(detections: DataFrame, context_labels: list[str], frame: tuple[str, ...] = ("item_id", "at")) -> DataFrame:
    """Detections on frames that also show one of the context labels."""
    frames = detections.filter(F.col("label").isin(*context_labels)).select(*frame).distinct()
    return detections.join(frames, list(frame), "left_semi")


def in_buckets(points: DataFrame, spans: DataFrame, seconds: int = 10) -> DataFrame:
    """(item_id, bucket, kind, ...): points in [t, t + seconds), spans in every bucket that they overlap.

    ``points`` has item_id, at, kind; ``spans`` has item_id, since, until, kind. Spans are exploded to
    the buckets they touch, so the join partner is an equality on the bucket.
    """
    p = points.select("item_id", "kind", F.floor(F.col("at") / seconds).cast("long").alias("bucket"))
    first = F.floor(F.col("since") / seconds).cast("long")
    last = F.greatest(F.ceil(F.col("until") / seconds).cast("long") - 1, first)  # a span that ends where a bucket starts isn't in it
    s = spans.filter("until > since").select("item_id", "kind", F.explode(F.sequence(first, last)).alias("bucket"))
    return p.unionByName(s)


WEIGHTS = {"yolo": 3, "stt": 3, "clip": 2, "ocr": 2}


def trigger_verdicts(bucketed: DataFrame) -> DataFrame:
    """One row for each bucket with signals: weight, kinds, and the verdict on it.

    A ``place`` column (null: none) names the place that a signal speaks of. A caption alone triggers
    if its place is heard anywhere in the item, and a scene of a place triggers by itself.
    """
    has = lambda k: F.max((F.col("kind") == k).cast("int"))
    rows = bucketed if "place" in bucketed.columns else bucketed.withColumn("place", F.lit(None).cast("string"))
    rows = rows.filter(F.col("kind").isin(*WEIGHTS))
    heard = rows.filter("kind = 'stt' AND place IS NOT NULL").select("item_id", "place").distinct().withColumn("_heard", F.lit(1))
    rows = rows.join(heard, ["item_id", "place"], "left")
    rows = rows.groupBy("item_id", "bucket").agg(*[has(k).alias(k) for k in WEIGHTS], F.max(F.when(F.col("kind") == "ocr", F.col("_heard"))).alias("_told"), F.max(((F.col("kind") == "clip") & F.col("place").isNotNull()).cast("int")).alias("_scene"))
    weight = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0))
    kinds = sum((F.col(k) for k in WEIGHTS), F.lit(0))
    verdict = (
        F.when((weight >= 3) & (kinds >= 2), "trigger").when((F.col("_told") == 1) & (kinds == 1), "trigger_place")
        .when((F.col("_scene") == 1) & (weight >= 2) & (kinds == 1), "trigger_scene").when((weight >= 3) & (kinds == 1), "single").otherwise("weak")
    )
    return rows.select("item_id", "bucket", weight.cast("int").alias("weight"), kinds.cast("int").alias("kinds"), verdict.alias("verdict"))


def first_cluster(frames: DataFrame, gap: float = 30.0, least: int = 2) -> DataFrame:
    """(item_id, at): where the first run of at least ``least`` frames no more than ``gap`` seconds apart begins."""
    w = Window.partitionBy("item_id").orderBy("at")
    starts = F.coalesce((F.col("at") - F.lag("at").over(w) > gap).cast("int"), F.lit(1))
    runs = frames.select("item_id", "at", starts.alias("s")).withColumn("run", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("item_id", "run").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).groupBy("item_id").agg(F.min("at").alias("at"))


def trigger_time(frames: DataFrame, fallback: DataFrame, source: str, skip: float = 0.0, share: float = 0.5) -> DataFrame:
    """(item_id, trigger_at, source): the first cluster, else the first frame, else ``share`` of the fallback's last second.

    Frames before ``skip`` of an item's last one are passed over, unless it has no others.
    """
    w = Window.partitionBy("item_id")
    marked = frames.select("item_id", "at", (F.col("at") >= F.max("at").over(w) * skip).alias("late"))
    taken = marked.withColumn("any", F.max(F.col("late").cast("int")).over(w)).filter(F.col("late") | (F.col("any") == 0)).select("item_id", "at")
    first = taken.groupBy("item_id").agg(F.min("at").alias("first"))
    found = first.join(first_cluster(taken), "item_id", "left").select("item_id", F.coalesce("at", "first").alias("trigger_at"), F.lit(source).alias("source"))
    other = fallback.groupBy("item_id").agg(F.max("at").alias("m")).filter("m > 0").join(found, "item_id", "left_anti").select("item_id", (F.col("m") * share).alias("trigger_at"), F.lit("stt").alias("source"))
    return found.unionByName(other)
