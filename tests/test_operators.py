"""Operators whose rules depend on order or state, against brute force and hand-made cases."""

import pytest
from pyspark.sql import functions as F

from reelspark.operators import hybrid, ranking, signals, statistics, vectors
from reelspark.plans import views as V
from reelspark.sources import tables
from reelspark.streaming import flows


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_greedy_distinct_is_a_fold(spark):
    """A row that is turned down for its source leaves its item free."""
    c = spark.createDataFrame([(1, 1, 0.9, "VS", 7), (1, 2, 0.8, "VS", 7), (1, 1, 0.7, "CF", None), (1, 2, 0.6, "CF", None), (1, 3, 0.5, "VS", None)], "user_id long, item_id long, score double, type string, source_id long")
    got = rows(ranking.greedy_distinct(c, ("VS",), V.written), "item_id", "type")
    assert got == [(1, "VS"), (2, "CF"), (3, "VS")]


def test_greedy_distinct_brute_force(spark):
    import random

    rnd = random.Random(5)
    data = [(u, rnd.randrange(8), rnd.randrange(1000) / 1000, rnd.choice(["VS", "CF"]), rnd.choice([None, 1, 2])) for u in range(20) for _ in range(15)]
    want = []
    for u in range(20):
        items, sources = set(), set()
        for r in sorted((r for r in data if r[0] == u), key=lambda r: (-r[2], r[3], r[1], (r[4] is not None, r[4] or 0))):
            if r[1] in items or r[3] == "VS" and r[4] is not None and r[4] in sources:
                continue
            items.add(r[1])
            if r[3] == "VS" and r[4] is not None:
                sources.add(r[4])
            want.append((u, r[1], r[2], r[3]))
    c = spark.createDataFrame(data, "user_id long, item_id long, score double, type string, source_id long")
    assert rows(ranking.greedy_distinct(c, ("VS",), V.written), "user_id", "item_id", "score", "type") == sorted(want)


def test_hybrid_score_by_hand(spark):
    c = spark.createDataFrame([(1, 1, 0.9, "CF"), (1, 2, 0.9, "CF"), (2, 1, 1.5, "CF")], "user_id long, item_id long, score double, type string")
    tags = spark.createDataFrame([(1, "director", "x"), (1, "genre", "y")], "item_id long, category string, value string")
    prefs = spark.createDataFrame([(1, "director", "x", 0.8)], "user_id long, category string, value string, affinity double")
    got = {(r["user_id"], r["item_id"]): r["score"] for r in hybrid.hybrid_scores(c, tags, prefs).collect()}
    assert got == {(1, 1): pytest.approx(0.86), (1, 2): pytest.approx(0.54), (2, 1): 1.5}


def test_first_cluster(spark):
    f = spark.createDataFrame([(1, 0.0), (1, 50.0), (1, 70.0), (1, 99.0), (2, 5.0), (2, 36.0)], "item_id long, at double")
    assert rows(signals.first_cluster(f), "item_id", "at") == [(1, 50.0)]


def test_bucket_edges(spark):
    p = spark.createDataFrame([(1, 10.0, "a"), (1, 9.99, "a")], "item_id long, at double, kind string")
    s = spark.createDataFrame([(1, 5.0, 10.0, "s"), (1, 10.0, 20.5, "t")], "item_id long, since double, until double, kind string")
    assert rows(signals.in_buckets(p, s), "kind", "bucket") == [("a", 0), ("a", 1), ("s", 0), ("t", 1), ("t", 2)]


def test_stateful_upserts_are_idempotent(spark):
    w = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 1)], "k long, g long, v long")
    once = tables.upsert(w.limit(0), w, ["k"], [F.desc("v")])
    assert rows(tables.upsert(once, w, ["k"], [F.desc("v")]), "k", "v") == rows(once, "k", "v") == [(1, 2), (2, 1)]
    assert rows(tables.insert_absent(once, w, ["k"], [F.col("v")]), "k", "v") == [(1, 2), (2, 1)]


def test_popularity_without_history(spark):
    s = spark.createDataFrame([(1, 8.0, 100, None), (2, None, None, None)], "item_id long, vote_avg double, vote_cnt long, release_date date")
    none = spark.createDataFrame([], "item_id long, views long, views_7d long, completion double, satisfaction double")
    got = {r["item_id"]: r["score"] for r in statistics.popularity(s, none, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {1: pytest.approx(0.45 * 0.8), 2: 0.0}


def test_nearest_leaves_itself_out(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(12)], "item_id long, vector array<double>")
    got = vectors.nearest(v.withColumnRenamed("item_id", "query_id"), v, 3, block=5).collect()
    assert len(got) == 36 and all(r["query_id"] != r["item_id"] for r in got)


def test_inverted_lists_recall(spark, small):
    from reelspark.operators.factors import inverted_lists, probe
    from reelspark.plans import views as V

    v = V.vectors(spark, small).select("item_id", F.col("visual").alias("vector"))
    q = v.filter("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    index, model = inverted_lists(v, 16)
    got = {(r["query_id"], r["item_id"]) for r in probe(index, model, q, 10, 8).collect()}
    want = {(r["query_id"], r["item_id"]) for r in vectors.nearest(q, v, 10).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_late_heartbeats_are_dropped(spark, tmp_path):
    """What arrives behind the watermark in a later batch doesn't count."""
    schema = "user_id long, item_id long, progress double, ts timestamp"
    src = f"file://{tmp_path}/in"
    first = [(1, 1, 0.1, "2024-01-01 00:00:10"), (1, 1, 0.2, "2024-01-01 00:00:50"), (1, 1, 0.3, "2024-01-01 02:00:00")]
    late = [(1, 1, 0.9, "2024-01-01 00:00:55"), (1, 1, 0.4, "2024-01-01 05:00:00")]
    frame = lambda data: spark.createDataFrame(data, "user_id long, item_id long, progress double, t string").selectExpr("user_id", "item_id", "progress", "cast(t AS timestamp) AS ts")
    for n, data in enumerate((first, late)):
        frame(data).coalesce(1).write.mode("append").parquet(src)
        stream = flows.compact_heartbeats(spark.readStream.schema(schema).parquet(src), "60 seconds", "1 minute")
        out = flows.run_available(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert rows(out, "progress")[0] == (0.2,) and (0.9,) not in rows(out, "progress")


def test_batch_upsert_survives_a_repeat(spark, tmp_path):
    write = flows.upsert_batches(f"file://{tmp_path}/t", ["user_id"], "ts")
    a = spark.createDataFrame([(1, 1), (1, 3)], "user_id long, ts long")
    b = spark.createDataFrame([(1, 2), (2, 1)], "user_id long, ts long")
    write(a, 0)
    write(b, 1)
    write(b, 1)
    assert rows(spark.read.parquet(f"{tmp_path}/t/v1"), "user_id", "ts") == [(1, 3), (2, 1)]


def test_schema_helpers(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert tables.read_or_empty(spark, f"file://{tmp_path}/none", schema).count() == 0
    frame = spark.createDataFrame([(1, 2.0)], "a long, c double")
    assert tables.schema_drift(frame, schema) == [("b", "missing", "string", None), ("c", "extra", None, "double")]
    assert tables.conform(frame, schema, {"b": "x"}).collect()[0][:] == (1, "x")


def test_trigger_exceptions(spark):
    b = spark.createDataFrame([(1, 0, "ocr", "busan"), (1, 5, "stt", "busan"), (1, 7, "clip", "jeju"), (1, 8, "clip", None), (1, 9, "yolo", None), (1, 9, "clip", None), (2, 0, "ocr", "busan")], "item_id long, bucket long, kind string, place string")
    got = rows(signals.trigger_verdicts(b), "item_id", "bucket", "verdict")
    assert got == [(1, 0, "trigger_place"), (1, 5, "single"), (1, 7, "trigger_scene"), (1, 8, "weak"), (1, 9, "trigger"), (2, 0, "weak")]


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    data = spark.createDataFrame([(i, None if i % 3 else f"n{i}") for i in range(40)], "id long, name string")
    tables.write_jdbc(data, url, "items", properties=driver)
    back = tables.read_jdbc(spark, url, 'SELECT * FROM items WHERE "id" < 30', "id", (0, 30), 3, driver)
    assert back.rdd.getNumPartitions() == 3
    assert sorted((r["id"], r["name"] or "") for r in back.collect()) == sorted((r["id"], r["name"] or "") for r in data.filter("id < 30").collect())


def test_regions_by_weight_of_evidence(spark):
    """Stated places, towns and sights in conflict; ties by source, then by first mention; no evidence."""
    from reelspark.operators import advertising

    items = spark.createDataFrame([(i,) for i in range(1, 7)], "item_id long")
    mentions = [(1, "태종대", "spoken", 1.0), (1, "태종대", "written", 2.0), (1, "강릉", "written", 3.0), (2, "한라산", "written", 1.0), (2, "한라산", "spoken", 9.0), (2, None, "spoken", 0.0), (3, "전주", "spoken", 5.0), (3, "제주", "written", 1.0), (3, "서울", "spoken", 4.0), (4, "부산", "spoken", 1.0), (6, "오사", "spoken", 1.0)]
    stated = [(4, "제주"), (4, "강릉"), (5, "대전"), (6, None)]
    got = advertising.item_regions(items, spark.createDataFrame(mentions, "item_id long, place string, source string, at double"), spark.createDataFrame(stated, "item_id long, place string"))
    assert {r["item_id"]: (r["regions"], r["region"], r["basis"]) for r in got.collect()} == {
        1: (["태종대", "강릉"], "강릉", "town"), 2: (["한라산"], "한라산", "sight"), 3: (["서울", "전주", "제주"], "서울", "town"), 4: (["부산"], "강릉", "stated"), 5: ([], "대전", "stated"), 6: (["오사"], "오사", "sight"),
    }


def test_place_hints_take_the_last_keyword(spark):
    from reelspark.operators import advertising

    words = spark.createDataFrame([("부산", "place", "", 1), ("콩나물", "food", "", 2), ("나물", "food", "", 3), ("제주", "place", "", 4), ("회", "food", "", 5)], "keyword string, category string, hint string, position int")
    texts = spark.createDataFrame([(1, "제주에서 부산까지 콩나물"), (2, "콩나물을"), (3, "회"), (4, None), (5, "부산은 나물")], "id long, t string")
    got = advertising.place_hints(texts, "id", "t", words, "place")
    assert sorted(map(tuple, got.collect())) == [(1, "place", "제주"), (2, "food", None), (5, "food", "부산")]
