"""Queries from detection signals to advertising, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.operators import advertising, signals
from reelspark.plans import views as V
from reelspark.plans.views import with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, **more: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, **more)
        return f

    return add


BUCKETS = """SELECT item_id, kind, CAST(floor(signals.at / 10) AS BIGINT) AS bucket FROM signals WHERE kind IN ('yolo', 'clip', 'ocr')
    UNION ALL SELECT item_id, 'stt', unnest(range(CAST(floor(signals.at / 10) AS BIGINT), greatest(CAST(ceil((signals.at + 12) / 10) AS BIGINT), CAST(floor(signals.at / 10) AS BIGINT) + 1))) FROM signals WHERE kind = 'stt'"""


def bucketed(spark, d):
    s = V.signals(spark, d)
    spans = s.filter("kind = 'stt'").select("item_id", "kind", F.col("at").alias("since"), (F.col("at") + 12).alias("until"))
    return signals.in_buckets(s.filter(F.col("kind").isin("yolo", "clip", "ocr")), spans, 10)


@query("j10_bucket_overlap", "SELECT item_id, kind, bucket, count(*) AS n FROM buckets GROUP BY ALL", buckets=BUCKETS)
def j10(spark, d):
    return bucketed(spark, d).groupBy("item_id", "kind", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query("a15_multi_signal", "SELECT item_id, bucket, count(DISTINCT kind) AS kinds FROM buckets GROUP BY ALL HAVING count(DISTINCT kind) >= 2", buckets=BUCKETS)
def a15(spark, d):
    return bucketed(spark, d).groupBy("item_id", "bucket").agg(F.count_distinct("kind").alias("kinds")).filter("kinds >= 2")


@query("a16_trigger_verdicts", "SELECT item_id, bucket, CAST(w AS INTEGER) AS weight, CAST(k AS INTEGER) AS kinds, CASE WHEN w >= 3 AND k >= 2 THEN 'trigger' WHEN w >= 3 THEN 'single' ELSE 'weak' END AS verdict FROM (SELECT item_id, bucket, count(DISTINCT kind) AS k, sum(DISTINCT CASE kind WHEN 'yolo' THEN 3.0 WHEN 'stt' THEN 3.001 WHEN 'clip' THEN 2.0 ELSE 2.001 END) // 1 AS w FROM buckets GROUP BY ALL)", buckets=BUCKETS)
def a16(spark, d):
    return signals.trigger_verdicts(bucketed(spark, d))


@query("a14_item_summary", "SELECT item_id, kinds, top_kinds, signals, coalesce(m, 0) AS multi_buckets FROM (SELECT item_id, string_agg(kind, ',' ORDER BY kind) AS kinds, string_agg(CASE WHEN r <= 3 THEN kind END, ',' ORDER BY r) AS top_kinds, CAST(sum(n) AS BIGINT) AS signals FROM (SELECT item_id, kind, count(*) AS n, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, kind) AS r FROM signals GROUP BY item_id, kind) GROUP BY item_id) LEFT JOIN (SELECT item_id, count(*) AS m FROM (SELECT item_id, bucket FROM buckets GROUP BY ALL HAVING count(DISTINCT kind) >= 2) GROUP BY item_id) USING (item_id)", buckets=BUCKETS)
def a14(spark, d):
    return advertising.item_summary(V.signals(spark, d), bucketed(spark, d))


RUNS = "SELECT item_id, t, sum(s) OVER (PARTITION BY item_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT item_id, f.at AS t, CASE WHEN f.at - lag(f.at) OVER (PARTITION BY item_id ORDER BY f.at) > 30 THEN 1 WHEN lag(f.at) OVER (PARTITION BY item_id ORDER BY f.at) IS NULL THEN 1 ELSE 0 END AS s FROM signals f WHERE kind = 'yolo')"


@query("w14_first_cluster", "SELECT item_id, min(first) AS at FROM (SELECT item_id, run, min(t) AS first FROM runs GROUP BY ALL HAVING count(*) >= 2) GROUP BY item_id", runs=RUNS)
def w14(spark, d):
    return signals.first_cluster(V.signals(spark, d).filter("kind = 'yolo'"))


@query("w15_trigger_time", "SELECT item_id, coalesce(c.first, f.first) AS trigger_at, 'yolo' AS source FROM (SELECT item_id, min(t) AS first FROM runs GROUP BY 1) f LEFT JOIN (SELECT item_id, min(first) AS first FROM (SELECT item_id, run, min(t) AS first FROM runs GROUP BY ALL HAVING count(*) >= 2) GROUP BY 1) c USING (item_id) UNION ALL SELECT item_id, max(s.at) * 0.5, 'stt' FROM signals s WHERE kind = 'clip' AND item_id NOT IN (SELECT item_id FROM runs) GROUP BY item_id", runs=RUNS)
def w15(spark, d):
    s = V.signals(spark, d)
    return signals.trigger_time(s.filter("kind = 'yolo'"), s.filter("kind = 'clip'"), "yolo")


@query("f8_id_from_file", "SELECT item_id FROM items WHERE ct_cl IN ('PROMO', 'LARGE')")
def f8(spark, d):
    items = V.items(spark, d)
    files = items.select(F.concat("provider", F.lit("|"), F.col("item_id").cast("string"), F.lit("__trailer.mp4")).alias("f")).select(F.regexp_replace("f", r"\|", "#").alias("file"))
    ids = files.select(F.split(F.element_at(F.split(F.regexp_replace("file", "#([0-9]+)__", "|$1__"), "__"), 1), r"\|")[1].cast("long").alias("item_id"))
    return ids.join(items.filter(F.col("ct_cl").isin("PROMO", "LARGE")), "item_id", "left_semi")


@query("f9_negative_frames", "SELECT event_id FROM (SELECT event_id, kind, score, max(CASE WHEN kind = 'scene' THEN score END) OVER w AS neg, max(CASE WHEN kind <> 'scene' AND score >= 4 THEN score END) OVER w AS pos FROM signals WINDOW w AS (PARTITION BY item_id, floor(signals.at / 10))) WHERE kind <> 'scene' AND score >= 4 AND NOT (coalesce(neg, 0) >= coalesce(pos, 0) AND coalesce(neg, 0) > 0)")
def f9(spark, d):
    s = V.signals(spark, d).select("event_id", "item_id", F.floor(F.col("at") / 10).alias("at"), F.col("kind").alias("concept"), "score", (F.col("kind") == "scene").alias("negative"))
    return signals.suppress_frames(s, 4.0).select("event_id")


@query("f10_food_context", "SELECT event_id FROM signals WHERE kind IN ('yolo', 'clip') AND (item_id, floor(signals.at / 10)) IN (SELECT (item_id, floor(s.at / 10)) FROM signals s WHERE kind = 'ocr')")
def f10(spark, d):
    s = V.signals(spark, d).select("event_id", "item_id", F.floor(F.col("at") / 10).alias("at"), F.col("kind").alias("label"))
    return signals.with_context(s, ["ocr"]).filter(F.col("label").isin("yolo", "clip")).select("event_id")


@query("f11_context_verdict", """SELECT event_id, CASE WHEN kind = 'scene' THEN 'brand_safety' WHEN score > 6 AND kind = 'ocr' THEN 'brand_safety_secondary' WHEN kind = 'clip' AND score < 0.22 THEN 'travel_and_condition'
    WHEN kind <> 'yolo' THEN 'non_food_category' WHEN user_id % 2 = 0 THEN 'no_tableware_with_food' ELSE 'eating_scene' END AS reason FROM signals""")
def f11(spark, d):
    s = V.signals(spark, d)
    top = F.struct(F.when(F.col("kind") == "scene", "a Gun").otherwise("a calm view").alias("concept"), (F.col("score") + 10).alias("score"), F.lit("other").alias("category"))
    second = F.struct(F.when(F.col("kind") == "ocr", "blood").otherwise("sea").alias("concept"), F.when((F.col("kind") == "ocr") & (F.col("score") <= 6), 0.0).when(F.col("kind") == "ocr", F.col("score")).otherwise(F.col("score")).alias("score"), F.col("kind").alias("category"))
    labels = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("pizza"))).otherwise(F.array(F.lit("pizza"), F.lit("bowl")))
    frames = s.select("event_id", F.col("kind").alias("category"), labels.alias("labels"), F.array(top, second).alias("scores"))
    out = advertising.context_verdict(frames, ["gun", "blood"], ["trash"], 0.26, ["yolo"], ["clip"], 1, ["pizza"], ["bowl"])
    return out.select("event_id", F.col("context_reason").alias("reason"))


DICT = [("나물", "food", "a"), ("콩나물", "food", "b"), ("오리", "food", "c")]


@query("h19_keyword_spotting", "SELECT item_id, CASE item_id % 4 WHEN 0 THEN '콩나물' WHEN 1 THEN '나물' WHEN 2 THEN '오리' END AS keyword FROM items WHERE item_id % 4 < 3")
def h19(spark, d):
    k = F.col("item_id") % 4
    said = F.concat("genre", F.lit(" "), F.when(k == 0, "콩나물을").when(k == 1, "나물 무침").when(k == 2, "오리는").otherwise("오리털"), F.lit(" "), F.col("ct_cl"))
    words = spark.createDataFrame(DICT, "keyword string, category string, hint string")
    return advertising.spot_keywords(V.items(spark, d).select("item_id", said.alias("said")), "said", words).select("item_id", "keyword")


@query("p2_enrichment", "SELECT item_id, 'food' AS category, CASE item_id % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'a' ELSE 'c' END AS hint FROM items WHERE item_id % 4 < 3")
def p2(spark, d):
    k = F.col("item_id") % 4
    said = F.when(k == 0, "콩나물을").when(k == 1, "나물 무침").when(k == 2, "오리는").otherwise("오리털")
    words = spark.createDataFrame(DICT, "keyword string, category string, hint string")
    hits = advertising.spot_keywords(V.items(spark, d).select("item_id", said.alias("said")), "said", words)
    return hits.groupBy("item_id").agg(F.max("category").alias("category"), F.max_by("hint", "keyword").alias("hint"))


@query("h21_region_prefix", "SELECT item_id, CASE WHEN genre IN ('red', 'hot') THEN genre WHEN starts_with(genre, 'b') THEN 'b' END AS region FROM items")
def h21(spark, d):
    regions = F.array(*[F.lit(r) for r in ("red", "hot", "b")])
    name = F.col("genre_detail")
    first = F.regexp_replace(F.split(name, " ")[0], ",", "")
    return V.items(spark, d).select("item_id", F.when(F.array_contains(regions, first), first).otherwise(F.try_element_at(F.filter(regions, lambda r: name.startswith(r)), F.lit(1))).alias("region"))


@query("p1_ad_matching", "SELECT item_id, CASE WHEN genre = 'red' THEN 'fair ' || genre ELSE 'dish ' || series_nm END AS ad, CASE WHEN genre = 'red' THEN 'event' ELSE 'product' END AS source, CAST(CASE WHEN genre = 'red' THEN 1 WHEN genre = 'hot' THEN 5 ELSE 2 END AS INTEGER) AS score FROM items WHERE series_nm IS NOT NULL")
def p1(spark, d):
    items = V.items(spark, d).filter("series_nm IS NOT NULL")
    rows = items.select("item_id", F.col("genre").alias("place"), F.array("series_nm").alias("foods"), F.col("title").alias("text"))
    events = spark.createDataFrame([("red", "fair red")], "place string, event string")
    products = items.select("series_nm", "genre").distinct().select(F.col("series_nm").alias("food"), F.when(F.col("genre") == "hot", "hot").alias("region"), F.concat(F.lit("dish "), "series_nm").alias("product"))
    return advertising.match_ads(rows, events, products)


# places are nations, and sights in them where a signal is strong; every fifth item states a nation of its own
MENTIONS = "SELECT s.item_id, CASE WHEN s.score > 20 THEN n_name || '산' ELSE n_name END AS place, CASE WHEN kind = 'stt' THEN 0 ELSE 1 END AS written, s.at AS moment FROM signals s JOIN nation ON n_nationkey = s.event_id % 7 WHERE kind IN ('stt', 'ocr')"
PLACES = """SELECT item_id, place, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, w, moment, place) AS rank FROM (SELECT item_id, place, count(*) AS n, min(written) AS w, arg_min(moment, (written, moment)) AS moment FROM mentions GROUP BY ALL)"""
REGIONS = """SELECT i.item_id, coalesce(p.regions, '') AS regions, coalesce(n.n_name, p.town, p.sight) AS region, CASE WHEN n.n_name IS NOT NULL THEN 'stated' WHEN p.town IS NOT NULL THEN 'town' WHEN p.sight IS NOT NULL THEN 'sight' END AS basis FROM items i
    LEFT JOIN (SELECT item_id, string_agg(place, ',' ORDER BY rank) FILTER (rank <= 5) AS regions, arg_min(place, rank) FILTER (NOT place LIKE '%산') AS town, arg_min(place, rank) FILTER (place LIKE '%산') AS sight FROM places WHERE rank <= 10 GROUP BY item_id) p USING (item_id)
    LEFT JOIN nation n ON i.item_id % 5 = 0 AND n.n_nationkey = i.item_id % 25"""
REGION = {"mentions": MENTIONS, "places": PLACES, "regions": REGIONS}


def regions(spark, d):
    nation = V.table(spark, d, "nation").select("n_nationkey", "n_name")
    said = V.signals(spark, d).filter(F.col("kind").isin("stt", "ocr")).join(nation, F.col("event_id") % 7 == F.col("n_nationkey"))
    place = F.when(F.col("score") > 20, F.concat("n_name", F.lit("산"))).otherwise(F.col("n_name"))
    mentions = said.select("item_id", place.alias("place"), F.when(F.col("kind") == "stt", "spoken").otherwise("written").alias("source"), "at")
    stated = V.items(spark, d).filter("item_id % 5 = 0").join(nation, F.col("item_id") % 25 == F.col("n_nationkey")).select("item_id", F.col("n_name").alias("place"))
    return advertising.item_regions(V.items(spark, d), mentions, stated)


@query("a14_regions", "SELECT * FROM regions", **REGION)
def a14_regions(spark, d):
    return regions(spark, d).withColumn("regions", F.array_join("regions", ","))


# events in the nations of two regions; a product of each series comes from the nation of its first item
P1 = """WITH rows AS (SELECT i.item_id, i.series_nm, r.region AS place, i.title || ' ' || n.n_name AS text FROM items i JOIN regions r USING (item_id) JOIN nation n ON n.n_nationkey = i.item_id % 25 WHERE series_nm IS NOT NULL),
products AS (SELECT series_nm, n_name AS region, 'dish ' || series_nm AS product FROM (SELECT series_nm, min(item_id) AS m FROM items WHERE series_nm IS NOT NULL GROUP BY 1) JOIN nation ON n_nationkey = m % 25)
SELECT item_id, coalesce('fair ' || n.n_name, product) AS ad, CASE WHEN n.n_name IS NULL THEN 'product' ELSE 'event' END AS source, CAST(CASE WHEN n.n_name IS NULL THEN 2 + 2 * CAST(contains(text, p.region) AS INTEGER) + CAST(coalesce(p.region = place, false) AS INTEGER) ELSE 1 END AS INTEGER) AS score
FROM rows JOIN products p USING (series_nm) LEFT JOIN nation n ON n.n_name = place AND n.n_regionkey < 2"""


@query("p1_by_region", f"SELECT * FROM ({P1})", **REGION)
def p1_by_region(spark, d):
    nation = V.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    items = V.items(spark, d).filter("series_nm IS NOT NULL")
    of = lambda rows, key: rows.join(nation, F.col(key) % 25 == F.col("n_nationkey"))
    rows = of(items, "item_id").join(regions(spark, d).select("item_id", "region"), "item_id").select("item_id", F.col("region").alias("place"), F.array("series_nm").alias("foods"), F.concat("title", F.lit(" "), "n_name").alias("text"))
    products = of(items.groupBy("series_nm").agg(F.min("item_id").alias("m")), "m").select(F.col("series_nm").alias("food"), F.col("n_name").alias("region"), F.concat(F.lit("dish "), "series_nm").alias("product"))
    events = nation.filter("n_regionkey < 2").select(F.col("n_name").alias("place"), F.concat(F.lit("fair "), "n_name").alias("event"))
    return advertising.match_ads(rows, events, products)


# two nations in each text; some names hold others, and a name is passed over where the longest that holds it is found too
@query("p2_place_hints", "SELECT item_id, arg_max(CASE WHEN n_regionkey < 3 THEN 'place' ELSE 'food' END, n_nationkey) AS category, arg_max(n_name, n_nationkey) FILTER (n_regionkey < 3) AS place FROM (SELECT item_id, a.n_name || ' / ' || b.n_name AS text FROM items JOIN nation a ON a.n_nationkey = item_id % 25 JOIN nation b ON b.n_nationkey = item_id * 7 % 25) JOIN (SELECT n.*, (SELECT arg_max(o.n_name, (length(o.n_name), o.n_name)) FROM nation o WHERE contains(o.n_name, n.n_name) AND o.n_name <> n.n_name) AS longer FROM nation n) n ON contains(text, n_name) AND NOT coalesce(contains(text, longer), false) GROUP BY item_id")
def p2_place_hints(spark, d):
    nation = V.table(spark, d, "nation")
    name = lambda n: nation.select(F.col("n_nationkey").alias(f"k{n}"), F.col("n_name").alias(f"n{n}"))
    texts = V.items(spark, d).join(name(1), F.col("item_id") % 25 == F.col("k1")).join(name(2), F.col("item_id") * 7 % 25 == F.col("k2")).select("item_id", F.concat_ws(" / ", "n1", "n2").alias("text"))
    words = nation.select(F.col("n_name").alias("keyword"), F.when(F.col("n_regionkey") < 3, "place").otherwise("food").alias("category"), F.lit("").alias("hint"), F.col("n_nationkey").alias("position"))
    return advertising.place_hints(texts, "item_id", "text", words, "place")


@query("p3_event_feed", "SELECT series_nm, release_date, min(item_id) AS item_id FROM items WHERE year(release_date) = 2000 AND series_nm IS NOT NULL GROUP BY ALL")
def p3(spark, d):
    feed = V.items(spark, d).filter((F.year("release_date") == 2000) & F.col("series_nm").isNotNull())
    return feed.groupBy("series_nm", "release_date").agg(F.min("item_id").alias("item_id"))


@query("p4_schedule_feed", "SELECT provider, release_date, max(item_id) AS item_id, any_value(t) AS starts FROM (SELECT provider, release_date, item_id, lpad(CAST(date_diff('day', DATE '1999-01-01', release_date) % 24 AS VARCHAR), 2, '0') || ':30' AS t FROM items WHERE contains(director, provider)) GROUP BY provider, release_date")
def p4(spark, d):
    from reelspark.sources.tables import upsert

    hour = F.lpad((F.datediff("release_date", F.lit("1999-01-01").cast("date")) % 24).cast("string"), 2, "0")
    feed = V.items(spark, d).filter(F.contains("director", F.col("provider"))).select("provider", "release_date", "item_id", F.concat_ws(":", hour, F.lit("30")).alias("starts"))
    empty = feed.limit(0)
    return upsert(empty, feed, ["provider", "release_date"], [F.desc("item_id")])


@query("p5_clean_frames", "SELECT item_id, min(f.at) AS at FROM (SELECT item_id, s.at, max(s.at) OVER (PARTITION BY item_id) AS m FROM signals s WHERE kind = 'yolo') f WHERE f.at >= m * 0.5 AND (item_id, floor(f.at)) NOT IN (SELECT (item_id, floor(c.at)) FROM signals c WHERE kind IN ('ocr', 'stt')) GROUP BY item_id")
def p5(spark, d):
    s = V.signals(spark, d)
    return advertising.clean_frames(s.filter("kind = 'yolo'").select("item_id", "at"), s.filter(F.col("kind").isin("ocr", "stt")))


@query("h44_theme", "SELECT item_id, CASE WHEN item_id % 50 = 0 THEN 'manual' WHEN contains(title, 'red') THEN 'color' WHEN contains(title, 'plate') OR contains(title, 'bowl') THEN 'kitchen' ELSE 'other' END AS theme FROM items")
def h44(spark, d):
    items = V.items(spark, d)
    override = items.filter("item_id % 50 = 0").select("item_id", F.lit("manual").alias("m"))
    text = F.regexp_replace(F.concat(F.lit("<b>"), "title", F.lit("</b>")), "<[^>]*>", "")
    return items.join(override, "item_id", "left").select("item_id", F.coalesce("m", advertising.first_keyword(text, [("color", ["red"]), ("kitchen", ["plate", "bowl"])], "other")).alias("theme"))
