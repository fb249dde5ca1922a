"""Queries over viewing history: filters, joins, aggregates, windows, top-k and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reelspark.functions.cleaning import percent
from reelspark.operators import catalogue, joins, ranking, statistics
from reelspark.plans import views as V
from reelspark.plans.views import AS_OF, with_views

QUERIES, ORACLES = {}, {}


def today():
    return F.lit(AS_OF).cast("date")


def query(name: str, sql: str | None = None, **views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, **views)
        return f

    return add


TAGS = """SELECT DISTINCT * FROM (SELECT item_id, 'director' AS category, trim(unnest(string_split(director, ','))) AS value, confidence FROM conf
    UNION ALL SELECT item_id, 'genre', genre, confidence FROM conf UNION ALL SELECT item_id, 'genre_detail', trim(unnest(string_split(genre_detail, ','))), confidence FROM conf
    UNION ALL SELECT item_id, 'actor_guest', trim(unnest(CAST(json(cast_guest) AS VARCHAR[]))), confidence FROM conf
    UNION ALL SELECT item_id, 'actor_lead', trim(unnest(CAST(json(cast_lead) AS VARCHAR[]))), confidence FROM conf)"""
CONF = "SELECT *, CASE WHEN vote_cnt > 0 AND vote_avg > 0 THEN round(least(ln(vote_cnt + 1) / ln(40001.0) * vote_avg / 10, 1.0), 6) ELSE 0.1 END AS confidence FROM items"
PREFS = """SELECT user_id, category, value, least(1.0, n / total * coalesce(c, 0.5) * 2) AS affinity, n AS watch_count FROM (
    SELECT user_id, category, value, count(*) AS n, avg(completion) AS c FROM watches JOIN tags USING (item_id) GROUP BY ALL HAVING count(*) >= 2)
    JOIN (SELECT user_id, count(*) AS total FROM watches GROUP BY user_id) USING (user_id)"""


def tags(spark, d):
    from reelspark.operators.hybrid import item_tags

    return item_tags(V.items(spark, d))


def preferences(spark, d):
    return statistics.tag_affinity(V.watches(spark, d), tags(spark, d))


# ---- filters ----


@query("f1_quality_filter", "SELECT watch_id FROM watches WHERE completion IS NOT NULL AND item_id IN (SELECT item_id FROM items WHERE poster_url IS NOT NULL) AND item_id IN (SELECT item_id FROM vectors) AND user_id IN (SELECT user_id FROM users WHERE NOT is_test)")
def f1(spark, d):
    ok = V.items(spark, d).filter("poster_url IS NOT NULL")
    return V.watches(spark, d).filter("completion IS NOT NULL").join(ok, "item_id", "left_semi").join(V.vectors(spark, d), "item_id", "left_semi").join(V.users(spark, d).filter(~F.col("is_test")), "user_id", "left_semi").select("watch_id")


@query("f2_tester_isolation", "SELECT is_test, count(*) AS n FROM watches JOIN users USING (user_id) GROUP BY is_test")
def f2(spark, d):
    return V.watches(spark, d).join(V.users(spark, d), "user_id").groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


@query("f3_not_expired", f"SELECT watch_id FROM watches WHERE watch_id % 5 = 0 OR started_at + INTERVAL 21 DAY > TIMESTAMP '{AS_OF}'")
def f3(spark, d):
    expires = F.when(F.col("watch_id") % 5 != 0, F.col("started_at") + F.expr("INTERVAL 21 DAYS"))
    rows = V.watches(spark, d).withColumn("expires_at", expires)
    return rows.filter(F.col("expires_at").isNull() | (F.col("expires_at") > today())).select("watch_id")


@query("f4_recent_complete", f"SELECT item_id FROM items WHERE release_date >= DATE '{AS_OF}' - INTERVAL 24 MONTH AND poster_url IS NOT NULL AND series_nm IS NOT NULL")
def f4(spark, d):
    return V.items(spark, d).filter((F.col("release_date") >= F.add_months(today(), -24)) & F.col("poster_url").isNotNull() & F.col("series_nm").isNotNull()).select("item_id")


@query("f5_exclusions", "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM items WHERE genre = 'red' AND ct_cl = 'PROMO')")
def f5(spark, d):
    items = V.items(spark, d)
    return items.join(items.filter("genre = 'red' AND ct_cl = 'PROMO'").select("item_id"), "item_id", "left_anti").select("item_id")


@query("f6_least_evidence", "SELECT user_id, count(*) AS views FROM watches GROUP BY user_id HAVING count(*) >= 40")
def f6(spark, d):
    return V.watches(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("views")).filter("views >= 40")


@query("f12_major_network", "SELECT item_id, EXISTS (SELECT 1 FROM (VALUES ('brand#1'), ('brand#24')) n(name) WHERE contains(lower(provider), name) OR contains(name, lower(provider))) AS major FROM items")
def f12(spark, d):
    names = spark.createDataFrame([("brand#1",), ("brand#24",)], "name string")
    items = V.items(spark, d)
    low = F.lower("provider")
    hit = items.join(F.broadcast(names), F.contains(low, F.col("name")) | F.contains(F.col("name"), low), "left_semi").select("item_id", F.lit(True).alias("m"))
    return items.select("item_id").join(hit, "item_id", "left").select("item_id", F.coalesce("m", F.lit(False)).alias("major"))


@query("f13_best_candidate", """SELECT series_nm, item_id, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY series_nm ORDER BY score DESC, duration, item_id) AS n FROM (
    SELECT series_nm, item_id, duration, CASE WHEN contains(lower(title), 'red') OR contains(lower(title), '7회') THEN 3 ELSE 0 END + CASE WHEN duration BETWEEN 60 AND 300 THEN 2 WHEN duration BETWEEN 30 AND 600 THEN 1 ELSE 0 END AS score
    FROM (SELECT *, episode_no * 20 AS duration FROM items WHERE series_nm IS NOT NULL) WHERE duration BETWEEN 40 AND CASE WHEN ct_cl LIKE 'PROMO%' THEN 1200 WHEN ct_cl LIKE 'ECONOMY%' THEN 300 ELSE 600 END)) WHERE n = 1""")
def f13(spark, d):
    clips = V.items(spark, d).filter("series_nm IS NOT NULL").select("series_nm", "item_id", "title", "ct_cl", (F.col("episode_no") * 20).alias("duration"))
    most = F.when(F.col("ct_cl").startswith("PROMO"), 1200).when(F.col("ct_cl").startswith("ECONOMY"), 300).otherwise(600)
    return catalogue.ranked_clips(clips, ["series_nm"], ["Red", "7회"], 40, most).filter("rank = 1").select("series_nm", "item_id", "score")


@query("f14_relabel", "SELECT item_id, CASE WHEN ct_cl <> 'PROMO' AND genre = 'hot' AND episode_no IN (1, 2, 3) THEN 'PAID' ELSE ct_cl END AS ct_cl FROM items")
def f14(spark, d):
    from reelspark.functions.titles import episode_number

    problems = spark.createDataFrame([("hot", [1, 2, 3])], "genre string, episodes array<int>").select("genre", F.explode("episodes").alias("episode"), F.lit(True).alias("hit"))
    rows = V.items(spark, d).withColumn("episode", episode_number(F.col("title"))).join(F.broadcast(problems), ["genre", "episode"], "left")
    return rows.select("item_id", F.when(F.col("hit") & (F.col("ct_cl") != "PROMO"), "PAID").otherwise(F.col("ct_cl")).alias("ct_cl"))


@query("f15_entitlement", f"SELECT user_id, item_id, CASE WHEN permanent THEN 'permanent' WHEN bought + INTERVAL 48 HOUR > TIMESTAMP '{AS_OF}' THEN 'active' ELSE 'expired' END AS status FROM (SELECT user_id, item_id, max(started_at) AS bought, arg_max(watch_id % 3 = 0, (started_at, watch_id)) AS permanent FROM watches GROUP BY user_id, item_id)")
def f15(spark, d):
    last = V.watches(spark, d).groupBy("user_id", "item_id").agg(F.max(F.struct("started_at", "watch_id")).alias("m"))
    active = F.col("m.started_at") + F.expr("INTERVAL 48 HOURS") > today()
    return last.select("user_id", "item_id", F.when(F.col("m.watch_id") % 3 == 0, "permanent").when(active, "active").otherwise("expired").alias("status"))


# each item is linked to the one after it, the last to none
@query("f16_match_conflict", """SELECT item_id, CASE WHEN match_id IS NULL THEN 'missing' WHEN s < 0.4 THEN 'title' WHEN (children OR shows) AND (contains(words, 'hot') OR contains(words, 'blue') OR contains(words, 'red')) THEN 'genre'
    WHEN children AND even AND NOT contains(words, 'green') THEN 'kind' WHEN (children OR shows OR drama) AND other_language AND s < 0.7 THEN 'language' ELSE 'ok' END AS verdict FROM (
    SELECT a.item_id, b.item_id AS match_id, 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) AS s, string_split(b.genre_detail, ', ') AS words,
      a.ct_cl LIKE 'PROMO%' AS children, a.ct_cl LIKE 'ECONOMY%' AS shows, a.ct_cl LIKE 'MEDIUM%' AS drama, b.episode_no % 2 = 0 AS even, b.provider <> a.provider AS other_language
    FROM named a LEFT JOIN named b ON b.item_id = a.item_id + 1)""", named="SELECT *, genre || right(provider, 3) AS name FROM items")
def f16(spark, d):
    from reelspark.functions.titles import sequence_similarity

    items = V.items(spark, d).select("item_id", F.split("ct_cl", " ")[0].alias("ct_cl"), F.concat("genre", F.right("provider", F.lit(3))).alias("name"), "provider", "genre_detail", "episode_no")
    match = items.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("match_id"), F.col("name").alias("match_name"), F.col("provider").alias("match_provider"), F.split("genre_detail", ", ").alias("genres"), F.when(F.col("episode_no") % 2 == 0, "movie").otherwise("tv").alias("kind"))
    linked = items.join(match, "item_id", "left").withColumn("similarity", sequence_similarity(F.col("name"), F.col("match_name"))).withColumn("match_language", F.when(F.col("match_provider") == F.col("provider"), "ko").otherwise("en"))
    classes = {"children": ["PROMO"], "shows": ["ECONOMY"], "television": ["PROMO", "ECONOMY", "MEDIUM"]}
    return linked.select("item_id", catalogue.match_conflict(classes, ["hot", "blue", "red"], ["green"], "ko").alias("verdict"))


# ---- joins ----


@query("j1_multi_join", "SELECT u.age_grp, t.category, count(*) AS n FROM watches w JOIN tags t USING (item_id) JOIN users u USING (user_id) GROUP BY ALL", tags=TAGS, conf=CONF)
def j1(spark, d):
    # views of an item by age group meet its tags by category: as many rows as items, not as views
    views = V.watches(spark, d).select("user_id", "item_id").join(V.users(spark, d), "user_id").groupBy("item_id", "age_grp").agg(F.count(F.lit(1)).alias("v"))
    kinds = tags(spark, d).groupBy("item_id", "category").agg(F.count(F.lit(1)).alias("t"))
    return views.join(kinds, "item_id").groupBy("age_grp", "category").agg(F.sum(F.col("v") * F.col("t")).alias("n"))


@query("j2_left_enrichment", "SELECT r.item_id, a.title AS title, b.title AS source_title FROM (SELECT item_id, (item_id * 7) % 3000 AS source_id FROM items) r LEFT JOIN items a ON a.item_id = r.item_id LEFT JOIN items b ON b.item_id = r.source_id")
def j2(spark, d):
    items = V.items(spark, d)
    names = items.select("item_id", "title")
    rows = items.select("item_id", (F.col("item_id") * 7 % 3000).alias("source_id"))
    return rows.join(names, "item_id", "left").join(names.select(F.col("item_id").alias("source_id"), F.col("title").alias("source_title")), "source_id", "left").select("item_id", "title", "source_title")


@query("j3_semi", "SELECT DISTINCT user_id FROM watches WHERE item_id IN (SELECT item_id FROM watches JOIN users USING (user_id) WHERE is_test) AND user_id NOT IN (SELECT user_id FROM users WHERE is_test)")
def j3(spark, d):
    w = V.watches(spark, d)
    testers = V.users(spark, d).filter("is_test").select("user_id")
    return w.join(w.join(testers, "user_id", "left_semi").select("item_id"), "item_id", "left_semi").select("user_id").distinct().join(testers, "user_id", "left_anti")


@query("j4_anti", "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM watches WHERE started_at >= TIMESTAMP '2000-01-01')")
def j4(spark, d):
    return V.items(spark, d).join(V.watches(spark, d).filter("started_at >= '2000-01-01'"), "item_id", "left_anti").select("item_id")


@query("j5_two_vector_sets", "SELECT count(a.item_id) FILTER (b.item_id IS NOT NULL) AS both_sides, count(a.item_id) FILTER (b.item_id IS NULL) AS left_only, count(b.item_id) FILTER (a.item_id IS NULL) AS right_only FROM (SELECT item_id FROM vectors WHERE item_id % 3 <> 0) a FULL JOIN (SELECT item_id FROM vectors WHERE item_id % 4 <> 0) b ON a.item_id = b.item_id")
def j5(spark, d):
    v = V.vectors(spark, d)
    a = v.filter("item_id % 3 <> 0").select("item_id", F.lit(1).alias("a"))
    b = v.filter("item_id % 4 <> 0").select("item_id", F.lit(1).alias("b"))
    j = a.join(b, "item_id", "full_outer")
    n = lambda c: F.count_if(c)
    return j.agg(n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_sides"), n(F.col("b").isNull()).alias("left_only"), n(F.col("a").isNull()).alias("right_only"))


@query("j6_lateral_first", "SELECT u.user_id, min(w.started_at) AS first_at FROM users u LEFT JOIN watches w ON w.user_id = u.user_id AND w.completion > 0.9 GROUP BY u.user_id")
def j6(spark, d):
    first = V.watches(spark, d).filter("completion > 0.9").groupBy("user_id").agg(F.min("started_at").alias("first_at"))
    return V.users(spark, d).select("user_id").join(first, "user_id", "left")


@query("j8_containment", "SELECT i.item_id, count(*) AS n FROM items i JOIN (SELECT item_id, ct_cl, unnest(string_split(genre_detail, ', ')) AS tag FROM items) s ON i.ct_cl = s.ct_cl AND contains(i.title, s.tag) GROUP BY i.item_id")
def j8(spark, d):
    items = V.items(spark, d)
    s = items.select("ct_cl", F.explode(F.split("genre_detail", ", ")).alias("tag")).groupBy("ct_cl", "tag").agg(F.count(F.lit(1)).alias("n"))
    found = joins.ngram_containing(items.select("item_id", "ct_cl", "title"), "title", s, "tag", 1, 16, ("ct_cl",))
    return found.groupBy("item_id").agg(F.sum("n").alias("n"))


TERMS = [("red", "color"), ("bolt", "part"), ("plate", "part"), ("hot", "heat")]
TERMS_SQL = "(VALUES ('red', 'color'), ('bolt', 'part'), ('plate', 'part'), ('hot', 'heat')) t(term, kind)"


@query("j9_keyword_join", f"SELECT item_id, string_agg(term, ',' ORDER BY term) AS terms FROM items JOIN {TERMS_SQL} ON contains(title, term) GROUP BY item_id")
def j9(spark, d):
    terms = spark.createDataFrame(TERMS, "term string, kind string")
    return joins.containing(V.items(spark, d), "title", terms, "term").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("term")), ",").alias("terms"))


SPANS = "SELECT item_id, signals.at AS since, signals.at + 25 AS until, event_id AS span_id FROM signals WHERE kind = 'stt'"


@query("j11_point_in_span", "SELECT p.event_id, s.span_id FROM signals p JOIN spans s ON p.item_id = s.item_id AND p.at BETWEEN s.since AND s.until WHERE p.kind = 'clip'", spans=SPANS)
def j11(spark, d):
    s = V.signals(spark, d)
    spans = s.filter("kind = 'stt'").select("item_id", F.col("at").alias("since"), (F.col("at") + 25).alias("until"), F.col("event_id").alias("span_id"))
    return joins.point_in_span(s.filter("kind = 'clip'"), spans, ["item_id"], "at", "since", "until", 30.0).select("event_id", "span_id")


@query("j12_next_schedule", "SELECT p.event_id, min(s.at) AS next_at FROM signals p LEFT JOIN signals s ON s.item_id = p.item_id AND s.kind = 'ocr' AND s.at > p.at WHERE p.kind = 'yolo' GROUP BY p.event_id")
def j12(spark, d):
    s = V.signals(spark, d)
    then = s.filter("kind = 'ocr'").select("item_id", F.col("at").alias("next_at"))
    return joins.next_after(s.filter("kind = 'yolo'").select("event_id", "item_id", "at"), then, ["item_id"], "at", "next_at").select("event_id", "next_at")


@query("j13_region_boxes", "SELECT user_id, CASE WHEN balance BETWEEN 0 AND 3000 AND user_id % 360 BETWEEN 0 AND 120 THEN 'low' WHEN balance BETWEEN 2000 AND 6000 AND user_id % 360 BETWEEN 100 AND 250 THEN 'mid' END AS region FROM users")
def j13(spark, d):
    boxes = spark.createDataFrame([(1, "low", 0.0, 3000.0, 0.0, 120.0), (2, "mid", 2000.0, 6000.0, 100.0, 250.0)], "order int, name string, lat0 double, lat1 double, lng0 double, lng1 double")
    return joins.region_boxes(V.users(spark, d).withColumn("lng", (F.col("user_id") % 360).cast("double")), boxes, "balance", "lng", ["user_id"])


@query("j14_key_list", "SELECT item_id, category, value FROM tags WHERE (category = 'genre' AND value = 'red') OR (category = 'director' AND value = 'Brand#7')", tags=TAGS, conf=CONF)
def j14(spark, d):
    keys = spark.createDataFrame([("genre", "red"), ("director", "Brand#7")], "category string, value string")
    return tags(spark, d).join(F.broadcast(keys), ["category", "value"]).select("item_id", "category", "value")


@query("j16_fallback_key", "SELECT coalesce(series_nm, title) AS k, count(*) AS n FROM items GROUP BY ALL")
def j16(spark, d):
    return V.items(spark, d).groupBy(F.coalesce("series_nm", "title").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("j17_fuzzy_join", """SELECT item_id, match_id FROM (SELECT l.item_id, r.item_id AS match_id, row_number() OVER (PARTITION BY l.item_id ORDER BY p.same DESC, p.s DESC, r.item_id) AS n FROM named l
    JOIN (SELECT * FROM (SELECT a.name AS a, a.type AS ta, b.name AS b, b.type AS tb, a.type = b.type AS same, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS s FROM kinds a, kinds b) WHERE s > 0.3
      QUALIFY rank() OVER (PARTITION BY a, ta ORDER BY same DESC, s DESC) <= 2) p ON p.a = l.name AND p.ta = l.type JOIN named r ON r.name = p.b AND r.type = p.tb AND r.item_id <> l.item_id) WHERE n = 1""",
    named="SELECT item_id, genre_detail || provider AS name, ct_cl AS type FROM items", kinds="SELECT DISTINCT name, type FROM named")
def j17(spark, d):
    from reelspark.operators.search import fuzzy_match

    items = V.items(spark, d).select("item_id", F.concat("genre_detail", "provider").alias("name"), F.col("ct_cl").alias("type"))
    return fuzzy_match(items, items.select(F.col("item_id").alias("match_id"), F.col("name").alias("match_name"), F.col("type").alias("match_type")), V.written)


@query("j18_orphans", "SELECT (SELECT count(*) FROM watches WHERE item_id NOT IN (SELECT item_id FROM vectors)) AS no_vector, (SELECT count(*) FROM vectors WHERE item_id NOT IN (SELECT item_id FROM watches)) AS no_watch")
def j18(spark, d):
    w, v = V.watches(spark, d), V.vectors(spark, d)
    a = w.join(v, "item_id", "left_anti").agg(F.count(F.lit(1)).alias("no_vector"))
    return a.crossJoin(v.join(w, "item_id", "left_anti").agg(F.count(F.lit(1)).alias("no_watch")))


@query("j19_propagation", "SELECT i.item_id, s.from_item_id FROM items i JOIN (SELECT series_nm, ct_cl, min(item_id) AS from_item_id FROM items WHERE item_id IN (SELECT item_id FROM vectors) AND series_nm IS NOT NULL AND ct_cl <> 'PROMO' GROUP BY ALL) s USING (series_nm, ct_cl) WHERE i.item_id NOT IN (SELECT item_id FROM vectors)")
def j19(spark, d):
    return catalogue.propagate_vectors(V.items(spark, d), V.vectors(spark, d), ("PROMO",))


@query("j20_exact_then_partial", "SELECT item_id, CASE WHEN provider IN ('Brand#1', 'Brand#2') THEN provider WHEN contains(provider, 'Brand#1') THEN 'Brand#1' WHEN contains(provider, 'Brand#2') THEN 'Brand#2' END AS name FROM items")
def j20(spark, d):
    names = spark.createDataFrame([(1, "Brand#1"), (2, "Brand#2")], "ord int, name string")
    return joins.exact_then_partial(V.items(spark, d).select("item_id", "provider"), "provider", names, "name", "ord").select("item_id", "name")


@query("j21_ngram_join", f"SELECT item_id, min(term) AS term FROM items JOIN {TERMS_SQL} ON contains(title, term) GROUP BY item_id")
def j21(spark, d):
    terms = spark.createDataFrame(TERMS, "term string, kind string")
    return joins.ngram_containing(V.items(spark, d).select("item_id", "title"), "title", F.broadcast(terms), "term", 3, 5).groupBy("item_id").agg(F.min("term").alias("term"))


@query("j22_source_merge", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN genre WHEN item_id % 3 = 0 THEN provider END AS genre, CASE WHEN item_id % 3 = 0 THEN provider END AS network, concat_ws('+', CASE WHEN item_id % 2 = 0 THEN 'A' END, CASE WHEN item_id % 3 = 0 THEN 'B' END) AS provenance FROM items")
def j22(spark, d):
    items = V.items(spark, d)
    a = items.filter("item_id % 2 = 0").select("item_id", "genre", F.lit(None).cast("string").alias("network"))
    b = items.filter("item_id % 3 = 0").select("item_id", F.col("provider").alias("genre"), F.col("provider").alias("network"))
    return catalogue.merge_sources(items.select("item_id"), [("A", a), ("B", b)], "item_id", ["genre", "network"])


@query("j24_missing_episodes", "SELECT s.series_nm, CAST(s.e AS INTEGER) AS episode, m.ct_cl, m.genre FROM (SELECT series_nm, unnest(range(1, 21)) AS e FROM (SELECT DISTINCT series_nm FROM items WHERE series_nm IS NOT NULL)) s JOIN (SELECT series_nm, max(ct_cl) AS ct_cl, max(genre) AS genre FROM items GROUP BY ALL) m USING (series_nm) WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.series_nm = s.series_nm AND i.episode_no = s.e)")
def j24(spark, d):
    from reelspark.functions.titles import episode_number

    items = V.items(spark, d)
    expected = items.filter("series_nm IS NOT NULL").select("series_nm").distinct().withColumn("episodes", F.lit(20))
    return catalogue.missing_episodes(items, expected, episode_number(F.col("title"))).select("series_nm", "episode", "ct_cl", "genre")


# ---- aggregates ----


@query("a1_watch_stats", f"SELECT item_id, count(*) AS views, count(*) FILTER (started_at >= DATE '{AS_OF}' - 365) AS views_7d, round(avg(completion), 6) AS completion, round(avg(satisfaction), 6) AS satisfaction FROM watches GROUP BY item_id")
def a1(spark, d):
    s = statistics.watch_stats(V.watches(spark, d), today(), 365)
    return s.withColumns({c: F.round(c, 6) for c in ("completion", "satisfaction")})


@query("a2_item_stats", "SELECT item_id, count(*) AS views, count(DISTINCT user_id) AS viewers, round(avg(completion), 6) AS completion, max(started_at) AS last_at FROM watches GROUP BY item_id")
def a2(spark, d):
    return V.watches(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("viewers"), F.round(F.avg("completion"), 6).alias("completion"), F.max("started_at").alias("last_at"))


@query("a3_age_group_stats", "SELECT age_grp, item_id, count(*) AS views, round(avg(satisfaction), 6) AS satisfaction FROM watches JOIN users USING (user_id) WHERE satisfaction > 0.6 GROUP BY ALL HAVING count(*) >= 5")
def a3(spark, d):
    return V.watches(spark, d).filter("satisfaction > 0.6").join(V.users(spark, d), "user_id").groupBy("age_grp", "item_id").agg(F.count(F.lit(1)).alias("views"), F.round(F.avg("satisfaction"), 6).alias("satisfaction")).filter("views >= 5")


@query("a4_daily_stats", "SELECT CAST(started_at AS DATE) AS day, count(*) AS views, count(DISTINCT user_id) AS users FROM watches GROUP BY ALL")
def a4(spark, d):
    return V.watches(spark, d).groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("views"), F.count_distinct("user_id").alias("users"))


@query("a5_top_satisfaction", "SELECT item_id, count(*) AS views, round(avg(satisfaction), 6) AS satisfaction FROM watches GROUP BY item_id HAVING count(*) >= 10 ORDER BY 3 DESC, item_id LIMIT 100")
def a5(spark, d):
    return V.watches(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("views"), F.round(F.avg("satisfaction"), 6).alias("satisfaction")).filter("views >= 10").orderBy(F.desc("satisfaction"), "item_id").limit(100)


@query("a5_top_by_age", "SELECT age_grp, item_id, views, satisfaction, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY age_grp ORDER BY satisfaction DESC, item_id) AS rank FROM (SELECT age_grp, item_id, count(*) AS views, round(avg(satisfaction), 6) AS satisfaction FROM watches JOIN users USING (user_id) GROUP BY ALL HAVING count(*) >= 5)) WHERE rank <= 50")
def a5_by_age(spark, d):
    return statistics.top_by_group(V.watches(spark, d), V.users(spark, d), "age_grp", 50, 5)


@query("a6_user_timeline", "SELECT user_id, item_id, title, started_at, watch_id FROM watches JOIN items USING (item_id) WHERE started_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-01-01'")
def a6(spark, d):
    w = V.watches(spark, d).filter(F.col("started_at").between("1998-01-01", "1999-01-01"))
    return w.join(V.items(spark, d), "item_id").select("user_id", "item_id", "title", "started_at", "watch_id")


ROLLUP = """SELECT min(item_id) AS item_id, series_nm, arg_min(genre, item_id) AS genre, arg_min(ct_cl, item_id) AS ct_cl, max(release_date) AS release_date, avg(vote_avg) AS vote_avg, CAST(sum(vote_cnt) AS BIGINT) AS vote_cnt FROM items WHERE series_nm IS NOT NULL GROUP BY series_nm
    UNION ALL SELECT item_id, series_nm, genre, ct_cl, release_date, vote_avg, vote_cnt FROM items WHERE series_nm IS NULL"""


@query("a7_series_rollup", "SELECT item_id, series_nm, genre, ct_cl, release_date, round(vote_avg, 6) AS vote_avg, vote_cnt FROM rolled", rolled=ROLLUP)
def a7(spark, d):
    return catalogue.series_rollup(V.items(spark, d)).withColumn("vote_avg", F.round("vote_avg", 6))


@query("a8_tag_affinity", "SELECT user_id, category, value, round(affinity, 6) AS affinity, watch_count FROM prefs", prefs=PREFS, tags=TAGS, conf=CONF)
def a8(spark, d):
    return preferences(spark, d).withColumn("affinity", F.round("affinity", 6))


@query("a9_cold_start_tags", "SELECT age_grp, value, users, rank FROM (SELECT age_grp, value, count(DISTINCT user_id) AS users, CAST(row_number() OVER (PARTITION BY age_grp ORDER BY count(DISTINCT user_id) DESC, value) AS INTEGER) AS rank FROM watches JOIN users USING (user_id) JOIN tags USING (item_id) WHERE NOT is_test AND category = 'genre' GROUP BY age_grp, value HAVING count(DISTINCT user_id) >= 3) WHERE rank <= 5", tags=TAGS, conf=CONF)
def a9(spark, d):
    from reelspark.operators.hybrid import cold_start_tags

    return cold_start_tags(V.watches(spark, d), V.users(spark, d), tags(spark, d), "genre", 5)


@query("a10_first_purchase", "SELECT user_id, series_nm, min(started_at) AS first_at FROM watches JOIN items USING (item_id) WHERE ct_cl IS DISTINCT FROM 'PROMO' AND series_nm IS NOT NULL GROUP BY ALL")
def a10(spark, d):
    items = V.items(spark, d).filter(~F.col("ct_cl").eqNullSafe("PROMO") & F.col("series_nm").isNotNull())
    return V.watches(spark, d).join(items, "item_id").groupBy("user_id", "series_nm").agg(F.min("started_at").alias("first_at"))


@query("a11_balance", "SELECT user_id, round(sum(CASE WHEN kind IN ('stt', 'ocr') THEN score ELSE -score END), 4) AS balance FROM signals GROUP BY user_id")
def a11(spark, d):
    signed = F.when(F.col("kind").isin("stt", "ocr"), F.col("score")).otherwise(-F.col("score"))
    return V.signals(spark, d).groupBy("user_id").agg(F.round(F.sum(signed), 4).alias("balance"))


@query("a12_collisions", "SELECT item_id, CASE WHEN n > 1 THEN series_nm || ' (' || ct_cl || ')' ELSE series_nm END AS series_nm, CASE WHEN n > 1 THEN NULL ELSE poster_url END AS poster_url FROM items LEFT JOIN (SELECT series_nm, count(DISTINCT ct_cl) AS n FROM items GROUP BY ALL) USING (series_nm)")
def a12(spark, d):
    return catalogue.rename_collisions(V.items(spark, d)).select("item_id", "series_nm", "poster_url")


@query("a13_top_keywords", "SELECT item_id, kind, n, rank FROM (SELECT item_id, kind, count(*) AS n, CAST(row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, kind) AS INTEGER) AS rank FROM signals GROUP BY item_id, kind) WHERE rank <= 2")
def a13(spark, d):
    n = V.signals(spark, d).groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return ranking.top_per_group(n, ["item_id"], [F.desc("n"), F.col("kind")], 2)


@query("a18_satisfaction", "SELECT watch_id, round(CASE WHEN use_tms > 60 THEN r ELSE 0 END, 4) AS completion, round(CASE WHEN use_tms > 60 THEN (v * r + 5 * c) / (v + 5) ELSE 0 END, 4) AS satisfaction FROM (SELECT watch_id, item_id, use_tms, least(use_tms / 2400.0::DOUBLE, 1.0) AS r, count(*) OVER (PARTITION BY item_id) AS v FROM watches), (SELECT avg(least(use_tms / 2400.0::DOUBLE, 1.0)) AS c FROM watches WHERE use_tms > 60)")
def a18(spark, d):
    return statistics.bayesian_satisfaction(V.watches(spark, d), F.lit(2400.0)).select("watch_id", "completion", "satisfaction")


@query("a19_profile", "SELECT 'item_id' AS column, count(*) AS rows, count(*) FILTER (item_id IS NULL) AS nulls, 0::BIGINT AS out_of_range FROM items UNION ALL SELECT 'series_nm', count(*), count(*) FILTER (series_nm IS NULL), 0 FROM items UNION ALL SELECT 'vote_avg', count(*), count(*) FILTER (vote_avg IS NULL), count(*) FILTER (vote_avg NOT BETWEEN 2 AND 8) FROM items")
def a19(spark, d):
    return statistics.profile(V.items(spark, d).select("item_id", "series_nm", "vote_avg"), {"vote_avg": (2.0, 8.0)})


@query("a19_key_profile", "SELECT coalesce(r.genre, e.genre) AS genre, coalesce(rows, 0) AS rows, coalesce(nulls, 0) AS nulls, least, most, coalesce(out_of_range, 0) AS out_of_range, CASE WHEN rows IS NULL THEN 'missing' WHEN e.genre IS NULL THEN 'unexpected' ELSE 'ok' END AS state FROM (SELECT genre, count(*) AS rows, count(*) FILTER (vote_avg IS NULL) AS nulls, min(vote_avg) AS least, max(vote_avg) AS most, count(*) FILTER (vote_avg NOT BETWEEN 2 AND 8) AS out_of_range FROM items GROUP BY genre) r FULL OUTER JOIN (SELECT DISTINCT genre FROM items WHERE length(genre) <> 4 UNION ALL SELECT DISTINCT upper(genre) FROM items WHERE length(genre) = 3) e ON r.genre = e.genre")
def a19_keys(spark, d):
    items = V.items(spark, d)
    expected = items.filter(F.length("genre") != 4).select("genre").unionByName(items.filter(F.length("genre") == 3).select(F.upper("genre").alias("genre")))
    return statistics.profile_keys(items, "genre", "vote_avg", expected, 2.0, 8.0)


@query("a20_validation", "SELECT (SELECT count(*) - count(DISTINCT watch_id) FROM watches) AS repeated, (SELECT count(*) FROM watches WHERE user_id NOT IN (SELECT user_id FROM users)) AS orphans, (SELECT count(*) FROM watches WHERE completion NOT BETWEEN 0 AND 1) AS out_of_range, (SELECT count(*) FROM items WHERE series_nm IS NULL) AS nulls")
def a20(spark, d):
    w = V.watches(spark, d)
    one = w.agg((F.count(F.lit(1)) - F.count_distinct("watch_id")).alias("repeated"), F.count_if(~F.col("completion").between(0, 1)).alias("out_of_range"))
    orphans = w.join(V.users(spark, d), "user_id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return one.crossJoin(orphans).crossJoin(V.items(spark, d).agg(F.count_if(F.col("series_nm").isNull()).alias("nulls")))


@query("a22_coverage_by_type", "SELECT ct_cl, count(*) AS items, count(v.item_id) AS with_vector, count(*) FILTER (sqrt(list_dot_product(visual, visual)) NOT BETWEEN 0.01 AND 0.8) AS odd FROM items i LEFT JOIN (SELECT item_id, visual FROM vectors) v USING (item_id) GROUP BY ct_cl")
def a22_by_type(spark, d):
    from reelspark.operators.vectors import norm

    return statistics.coverage_by_type(V.items(spark, d), V.vectors(spark, d), "ct_cl", norm(F.col("visual")), 0.01, 0.8)


@query("a22_vector_coverage", "SELECT (SELECT count(*) FROM items) AS items, (SELECT count(*) FROM items WHERE item_id IN (SELECT item_id FROM vectors)) AS with_vector, (SELECT count(*) FROM vectors WHERE sqrt(list_dot_product(visual, visual)) NOT BETWEEN 0.01 AND 0.8) AS odd")
def a22(spark, d):
    from reelspark.operators.vectors import norm

    items, v = V.items(spark, d), V.vectors(spark, d)
    n = items.join(v.select("item_id", F.lit(1).alias("v")), "item_id", "left").agg(F.count(F.lit(1)).alias("items"), F.count("v").alias("with_vector"))
    return n.crossJoin(v.agg(F.count_if(~norm(F.col("visual")).between(0.01, 0.8)).alias("odd")))


@query("a23_nearest_user", "SELECT user_id, nearest, round(j, 6) AS jaccard FROM (SELECT a.user_id, b.user_id AS nearest, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j, row_number() OVER (PARTITION BY a.user_id ORDER BY count(*) / (any_value(a.n) + any_value(b.n) - count(*)) DESC, b.user_id) AS k FROM sets a JOIN sets b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY a.user_id, b.user_id) WHERE k = 1", sets="SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT DISTINCT user_id, item_id FROM watches)")
def a23(spark, d):
    return joins.most_similar_set(V.watches(spark, d), "user_id", "item_id", V.written).withColumn("jaccard", F.round("jaccard", 6))


@query("a25_distribution", "SELECT ct_cl, genre, count(*) AS n, count(*) FILTER (genre NOT IN ('red', 'hot', 'blue')) AS unmapped FROM items GROUP BY ALL")
def a25(spark, d):
    return V.items(spark, d).groupBy("ct_cl", "genre").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("genre").isin("red", "hot", "blue")).alias("unmapped"))


# ---- windows ----


@query("w1_latest_per_series", "SELECT user_id, series_nm, arg_max(watch_id, (started_at, watch_id)) AS watch_id FROM (SELECT user_id, item_id, started_at, watch_id FROM watches UNION ALL SELECT user_id, item_id, ts, event_id FROM signals) JOIN items USING (item_id) WHERE series_nm IS NOT NULL GROUP BY ALL")
def w1(spark, d):
    rows = V.watches(spark, d).select("user_id", "item_id", "started_at", "watch_id").unionByName(V.signals(spark, d).select("user_id", "item_id", F.col("ts").alias("started_at"), F.col("event_id").alias("watch_id")))
    rows = rows.join(V.items(spark, d).filter("series_nm IS NOT NULL").select("item_id", "series_nm"), "item_id")
    return ranking.latest(rows, ["user_id", "series_nm"], [F.desc("started_at"), F.desc("watch_id")]).select("user_id", "series_nm", "watch_id")


@query("w2_latest_progress", "SELECT user_id, item_id, CAST(least(round_even(100 * arg_max(completion, (started_at, watch_id)), 0), 100) AS INTEGER) AS progress FROM watches GROUP BY ALL")
def w2(spark, d):
    return ranking.latest(V.watches(spark, d), ["user_id", "item_id"], [F.desc("started_at"), F.desc("watch_id")]).select("user_id", "item_id", percent(F.col("completion")).alias("progress"))


@query("w3_provider_priority", "SELECT title, item_id FROM (SELECT title, item_id, row_number() OVER (PARTITION BY title ORDER BY CASE provider WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 3 END, item_id) AS n FROM items) WHERE n = 1")
def w3(spark, d):
    first = F.when(F.col("provider") == "Brand#1", 1).when(F.col("provider") == "Brand#2", 2).otherwise(3)
    return catalogue.first_per_group(V.items(spark, d), ["title"], [first, "item_id"]).select("title", "item_id")


@query("w4_representative", "SELECT series_nm, item_id, episodes FROM (SELECT series_nm, item_id, count(*) OVER (PARTITION BY series_nm) AS episodes, row_number() OVER (PARTITION BY series_nm ORDER BY poster_url IS NULL, item_id) AS n FROM items WHERE series_nm IS NOT NULL) WHERE n = 1")
def w4(spark, d):
    rows = V.items(spark, d).filter("series_nm IS NOT NULL").withColumn("episodes", F.count(F.lit(1)).over(Window.partitionBy("series_nm")))
    return catalogue.first_per_group(rows, ["series_nm"], [F.col("poster_url").isNull(), "item_id"]).select("series_nm", "item_id", "episodes")


POP = f"""SELECT *, (1 - least(v / 10, 1)) * (0.45 * vote + 0.55 * fresh) + least(v / 10, 1) * (0.45 * heat + 0.25 * quality + 0.15 * vote + 0.15 * fresh) AS score FROM (
    SELECT r.*, coalesce(s.views, 0) AS v, vote_avg / 10 * ln(vote_cnt + 1) / ln(m.most + 1) * least(vote_cnt, 10) / 10 AS vote, greatest(1 - date_diff('day', release_date, DATE '{AS_OF}') / 365, 0.0) AS fresh,
      coalesce(least(coalesce(views_7d, 0) / h.heat, 5) / 5, 0) AS heat, CASE WHEN coalesce(s.views, 0) >= 5 THEN s.completion * s.satisfaction ELSE 0 END AS quality
    FROM rolled r LEFT JOIN stats s USING (item_id), (SELECT max(vote_cnt) AS most FROM rolled) m, (SELECT avg(views_7d) AS heat FROM rolled JOIN stats USING (item_id) WHERE views_7d > 0) h)"""
STATS = f"SELECT item_id, count(*) AS views, count(*) FILTER (started_at >= DATE '{AS_OF}' - 365) AS views_7d, avg(completion) AS completion, avg(satisfaction) AS satisfaction FROM watches GROUP BY item_id"


def popular(spark, d):
    stats = statistics.watch_stats(V.watches(spark, d), today(), 365)
    return statistics.popularity(catalogue.series_rollup(V.items(spark, d)), stats, today())


@query("r6_popularity", "SELECT item_id, round(score, 6) AS score FROM pop", pop=POP, rolled=ROLLUP, stats=STATS)
def r6(spark, d):
    return popular(spark, d).select("item_id", F.round("score", 6).alias("score"))


@query("w5_top_per_class", "SELECT ct_cl, item_id, score, rank FROM (SELECT ct_cl, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY ct_cl ORDER BY round(score, 6) DESC, item_id) AS INTEGER) AS rank FROM pop) WHERE rank <= 20", pop=POP, rolled=ROLLUP, stats=STATS)
def w5(spark, d):
    rows = popular(spark, d).select("ct_cl", "item_id", F.round("score", 6).alias("score"))
    return ranking.top_per_group(rows, ["ct_cl"], [F.desc("score"), F.col("item_id")], 20)


@query("w6_tag_slots", "SELECT user_id, category, value, rank FROM (SELECT user_id, category, value, CAST(row_number() OVER (PARTITION BY user_id, category ORDER BY round(affinity, 6) DESC, value) AS INTEGER) AS rank FROM prefs) WHERE rank <= 3", prefs=PREFS, tags=TAGS, conf=CONF)
def w6(spark, d):
    p = preferences(spark, d).withColumn("affinity", F.round("affinity", 6))
    return ranking.top_per_group(p, ["user_id", "category"], [F.desc("affinity"), F.col("value")], 3).select("user_id", "category", "value", "rank")


@query("w7_items_per_tag", "SELECT category, value, item_id, rank FROM (SELECT category, value, item_id, CAST(row_number() OVER (PARTITION BY category, value ORDER BY confidence DESC, item_id) AS INTEGER) AS rank FROM tags) JOIN items USING (item_id) WHERE rank <= 50 AND poster_url IS NOT NULL", tags=TAGS, conf=CONF)
def w7(spark, d):
    top = ranking.top_per_group(tags(spark, d), ["category", "value"], [F.desc("confidence"), F.col("item_id")], 50)
    return top.join(V.items(spark, d).filter("poster_url IS NOT NULL"), "item_id", "left_semi").select("category", "value", "item_id", "rank")


CAND = """SELECT user_id, item_id, round(completion * satisfaction, 6) AS score, CASE WHEN watch_id % 3 = 0 THEN 'VISUAL' ELSE 'CF' END AS type, CASE WHEN watch_id % 3 = 0 THEN watch_id % 4 END AS source_id FROM watches"""


def candidates_of(watches, *more):
    k = F.col("watch_id") % 3 == 0
    return watches.select("user_id", "item_id", *more, F.round(F.col("completion") * F.col("satisfaction"), 6).alias("score"), F.when(k, "VISUAL").otherwise("CF").alias("type"), F.when(k, F.col("watch_id") % 4).alias("source_id"))


def candidates(spark, d):
    return candidates_of(V.watches(spark, d))


@query("w8_deduplicated_top", "SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id, CASE WHEN ct_cl = 'PROMO' THEN CAST(item_id AS VARCHAR) ELSE coalesce(series_nm, CAST(item_id AS VARCHAR)) END ORDER BY score DESC, item_id) AS n FROM (SELECT user_id, item_id, max(score) AS score FROM cand GROUP BY ALL) JOIN items USING (item_id)) WHERE n = 1) WHERE rank <= 5", cand=CAND)
def w8(spark, d):
    best = candidates(spark, d).groupBy("user_id", "item_id").agg(F.max("score").alias("score")).join(V.items(spark, d).select("item_id", "ct_cl", "series_nm"), "item_id")
    series = F.when(F.col("ct_cl") == "PROMO", F.col("item_id").cast("string")).otherwise(F.coalesce("series_nm", F.col("item_id").cast("string")))
    return ranking.deduplicated_top(best, ["user_id"], series, [F.desc("score"), F.col("item_id")], 5).select("user_id", "item_id", "score", "rank")


# a fold over each user's sorted rows, held as lists of one row
W10 = """SELECT user_id, k.i AS item_id, k.x AS score, k.t AS type, k.s AS source_id FROM (SELECT user_id, unnest(list_reduce(list(c ORDER BY c[1].o, c[1].t, c[1].i, c[1].s NULLS FIRST),
    lambda kept, c: CASE WHEN len(list_filter(kept, lambda k: k.i = c[1].i OR (c[1].t = 'VISUAL' AND k.t = 'VISUAL' AND k.s = c[1].s))) > 0 THEN kept ELSE list_concat(kept, c) END)) AS k
    FROM (SELECT user_id, [{'o': -score, 't': type, 'i': item_id, 's': source_id, 'x': score}] AS c FROM cand) GROUP BY user_id)"""


@query("w10_greedy_distinct", W10, cand=CAND)
def w10(spark, d):
    return ranking.greedy_distinct(candidates(spark, d), ("VISUAL",), V.written)


@query("w11_quota_blend", "SELECT user_id, item_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN type = 'CF' AND n <= 3 THEN 0 ELSE 1 END, score DESC, item_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY score DESC, item_id) AS n FROM best)) WHERE rank <= 6", best="SELECT user_id, item_id, max(score) AS score, min(type) AS type FROM cand GROUP BY user_id, item_id", cand=CAND)
def w11(spark, d):
    best = candidates(spark, d).groupBy("user_id", "item_id").agg(F.max("score").alias("score"), F.min("type").alias("type"))
    return ranking.quota_blend(best, "CF", 3, 6).select("user_id", "item_id", "score", "rank")


@query("w12_leave_one_out", "SELECT user_id, max(item_id) AS item_id FROM watches GROUP BY user_id HAVING count(DISTINCT item_id) >= 2")
def w12(spark, d):
    return ranking.holdout_last_item(V.watches(spark, d))[1]


@query("w13_temporal_split", "SELECT CASE WHEN started_at < TIMESTAMP '2000-01-01' THEN 'train' ELSE 'truth' END AS part, count(*) AS n, count(DISTINCT user_id) AS users FROM watches GROUP BY ALL")
def w13(spark, d):
    part = F.when(F.col("started_at") < "2000-01-01", "train").otherwise("truth")
    return V.watches(spark, d).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("w16_stratified", "SELECT item_id FROM (SELECT item_id, row_number() OVER (PARTITION BY ct_cl ORDER BY item_id) AS n, CASE ct_cl WHEN 'PROMO' THEN 10 WHEN 'LARGE' THEN 20 ELSE 0 END AS q FROM items) ORDER BY CASE WHEN n <= q THEN 0 ELSE 1 END, item_id LIMIT 60")
def w16(spark, d):
    quotas = spark.createDataFrame([("PROMO", 10), ("LARGE", 20)], "ct_cl string, quota int")
    return ranking.stratified(V.items(spark, d).select("item_id", "ct_cl"), "ct_cl", quotas, 60, [F.col("item_id")]).select("item_id")


@query("w17_sequence_weight", "SELECT DISTINCT user_id, started_at, CAST(greatest(100 - 15 * (dense_rank() OVER (PARTITION BY user_id ORDER BY started_at DESC) - 1), 40) AS INTEGER) AS weight FROM watches")
def w17(spark, d):
    # a user's rows lie in order for the rank, so repeats of a time are told by the row before: nothing is hashed or shuffled for them
    w = Window.partitionBy("user_id").orderBy(F.desc("started_at"))
    times = V.dealt(V.watches(spark, d).select("user_id", "started_at"), "user_id")
    ranked = times.select("user_id", "started_at", F.dense_rank().over(w).alias("n"), F.row_number().over(w).alias("_r"), F.lag("started_at").over(w).alias("_before"))
    first = (F.col("_r") == 1) | ~F.col("started_at").eqNullSafe(F.col("_before"))
    return ranked.filter(first).select("user_id", "started_at", F.greatest(100 - 15 * (F.col("n") - 1), F.lit(40)).cast("int").alias("weight"))


@query("w18_segments", "SELECT user_id, count(DISTINCT item_id) AS items, CASE WHEN count(DISTINCT item_id) >= 45 THEN 'hot' WHEN count(DISTINCT item_id) >= 35 THEN 'warm' ELSE 'cold' END AS segment FROM watches GROUP BY user_id")
def w18(spark, d):
    return statistics.activity_segment(V.watches(spark, d), 35, 45)


@query("w19_work_list", "SELECT series_nm, season, min(item_id) AS item_id FROM (SELECT series_nm, item_id % 3 + 1 AS season, item_id FROM items WHERE poster_url IS NULL AND series_nm IS NOT NULL) GROUP BY ALL")
def w19(spark, d):
    rows = V.items(spark, d).filter("poster_url IS NULL AND series_nm IS NOT NULL").withColumn("season", F.col("item_id") % 3 + 1)
    return catalogue.first_per_group(rows, ["series_nm", "season"], ["item_id"]).select("series_nm", "season", "item_id")


# ---- top-k and sets ----


@query("t1_global_top", "SELECT item_id, vote_avg FROM items ORDER BY vote_avg DESC, item_id LIMIT 15")
def t1(spark, d):
    return V.items(spark, d).select("item_id", "vote_avg").orderBy(F.desc("vote_avg"), "item_id").limit(15)


@query("t3_ordered_lists", "SELECT user_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY score DESC, item_id) AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS n FROM best) WHERE n <= 10 GROUP BY user_id", best="SELECT user_id, item_id, max(score) AS score FROM cand GROUP BY ALL", cand=CAND)
def t3(spark, d):
    best = candidates(spark, d).groupBy("user_id", "item_id").agg(F.max("score").alias("score"))
    top = ranking.top_per_group(best, ["user_id"], [F.desc("score"), F.col("item_id")], 10)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return top.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda s: s.item_id.cast("string")), ",").alias("items"))


@query("u1_union_histories", "SELECT kind, count(*) AS n, round(sum(pct), 4) AS pct FROM (SELECT 'watch' AS kind, completion * 100 AS pct FROM watches UNION ALL SELECT 'signal', score FROM signals) GROUP BY kind")
def u1(spark, d):
    a = V.watches(spark, d).select(F.lit("watch").alias("kind"), (F.col("completion") * 100).alias("pct"))
    return a.unionByName(V.signals(spark, d).select(F.lit("signal").alias("kind"), F.col("score").alias("pct"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("pct"), 4).alias("pct"))


@query("u2_union_distinct", "SELECT item_id, CASE WHEN item_id IN (SELECT item_id FROM vectors UNION SELECT item_id FROM signals) THEN poster_url END AS poster_url FROM items")
def u2(spark, d):
    served = V.vectors(spark, d).select("item_id").union(V.signals(spark, d).select("item_id")).distinct().withColumn("s", F.lit(True))
    return V.items(spark, d).join(served, "item_id", "left").select("item_id", F.when(F.col("s"), F.col("poster_url")).alias("poster_url"))


@query("u3_intersect", "SELECT user_id FROM watches WHERE started_at < TIMESTAMP '1997-01-01' INTERSECT SELECT user_id FROM watches WHERE started_at >= TIMESTAMP '2001-01-01'")
def u3(spark, d):
    w = V.watches(spark, d)
    return w.filter("started_at < '1997-01-01'").select("user_id").intersect(w.filter("started_at >= '2001-01-01'").select("user_id"))


@query("u4_difference", "SELECT item_id FROM items EXCEPT SELECT item_id FROM vectors")
def u4(spark, d):
    return V.items(spark, d).select("item_id").exceptAll(V.vectors(spark, d).select("item_id"))


@query("u5_served_audit", "SELECT series_nm, min(item_id) AS item_id, max(poster_url) AS poster_url FROM items WHERE series_nm IS NOT NULL AND item_id IN (SELECT item_id FROM vectors UNION SELECT item_id FROM signals UNION SELECT item_id FROM watches WHERE completion > 0.9) GROUP BY series_nm")
def u5(spark, d):
    served = V.vectors(spark, d).select("item_id").union(V.signals(spark, d).select("item_id")).union(V.watches(spark, d).filter("completion > 0.9").select("item_id")).distinct()
    return V.items(spark, d).filter("series_nm IS NOT NULL").join(served, "item_id", "left_semi").groupBy("series_nm").agg(F.min("item_id").alias("item_id"), F.max("poster_url").alias("poster_url"))


@query("w9_ordered_distinct", "SELECT user_id, item_id, watch_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, watch_id DESC, item_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY started_at DESC, watch_id DESC) AS n FROM watches) WHERE n = 1) WHERE rank <= 20")
def w9(spark, d):
    rows = ranking.deduplicated_top(V.watches(spark, d), ["user_id"], F.col("item_id"), [F.desc("started_at"), F.desc("watch_id"), F.col("item_id")], 20)
    return rows.select("user_id", "item_id", "watch_id", "rank")


@query("r2_preferences", "SELECT user_id, category, value, round(affinity, 6) AS affinity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY round(affinity, 6) DESC, value) AS rank FROM prefs) WHERE rank <= 10", prefs=PREFS, tags=TAGS, conf=CONF)
def r2(spark, d):
    rows = preferences(spark, d).withColumn("affinity", F.round("affinity", 6))
    return ranking.top_per_group(rows, ["user_id", "category"], [F.desc("affinity"), F.col("value")], 10).select("user_id", "category", "value", "affinity", "rank")
