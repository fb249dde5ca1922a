"""Recommendations from factors: blocks meet where they are used, and a task sends a user's best once."""

import numpy as np
from pyspark.sql import functions as F

from reelspark.operators import als
from reelspark.plans import views as V


def model(spark, users=90, items=70, rank=4):
    rng = np.random.default_rng(11)
    sides = []
    for n in (users, items):
        rows = []
        for block in range(3):
            ids = [i for i in range(n) if i % 3 == block]
            rows.append((block, ids, bytearray(rng.standard_normal((len(ids), rank)).astype(np.float32).tobytes())))
        sides.append(spark.createDataFrame(rows, "block int, ids array<long>, f binary"))
    seen = [(int(u), int(i)) for u, i in zip(rng.integers(0, users + 5, 2000), rng.integers(0, items + 5, 2000), strict=True)] + [(4, None), *((5, i) for i in range(items - 2))]
    return als.Factors(*sides, rank), spark.createDataFrame(seen, "user_id long, item_id long"), set(seen)


def flat(side):
    return {i: x for r in side.collect() for i, x in zip(r.ids, np.frombuffer(bytes(r.f), np.float32).reshape(len(r.ids), -1), strict=True)}


def test_recommendations_are_exact_and_never_shuffled_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(als, "ROWS", 7)
    monkeypatch.setattr(als, "BLOCK", 8)
    factors, watched, seen = model(spark)
    users, items = flat(factors.users), flat(factors.items)
    for classes in (1, 4):
        found = als.recommend(factors, watched, 5, V.written, classes)
        want = set()
        for u, x in users.items():
            s = {i: round(float(x.astype(np.float64) @ y), 5) for i, y in items.items() if (u, i) not in seen}
            want |= {(u, i, k + 1) for k, i in enumerate(sorted(s, key=lambda i: (-s[i], i))[:5])}
        assert {(r.user_id, r.item_id, r["rank"]) for r in found.collect()} == want
        text = found._jdf.queryExecution().sparkPlan().toString()
        assert "LeftOuter" not in text and "SortMergeJoin" not in text


def test_a_task_sends_the_best_of_a_block_once(spark):
    factors, watched, _ = model(spark)
    items = als.factor_rows(factors.items, 4).select(F.col("id").alias("item_id"), "vector", "length")
    packed = items.groupBy((F.col("item_id") % 10).alias("part")).agg(F.collect_list(F.struct("item_id", "vector")).alias("rows"), F.max("length").alias("longest"))
    tiles = als._beside(factors.users, watched).crossJoin(packed.coalesce(1)).withColumn("least", F.lit(None).cast("array<double>"))
    sent = als._in_tiles(tiles.coalesce(1).sortWithinPartitions("block"), 4, 3).groupBy("user_id").count().collect()
    assert len(sent) >= 89 and max(r["count"] for r in sent) == 3
