"""Queries for sources, sinks and the upkeep of the catalogue, with their SQL. Those that write use a folder of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelspark.functions import cleaning as C
from reelspark.operators import repair
from reelspark.operators.catalogue import season_work_list
from reelspark.plans import views as V
from reelspark.plans.views import with_views
from reelspark.sources import tables as S

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, **more: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, **more)
        return f

    return add


folder = V.folder


@query("s1_csv_load", "SELECT user_id AS id, age_grp FROM users")
def s1(spark, d):
    path = folder(spark)
    V.users(spark, d).select("user_id", "age_grp").write.option("header", True).csv(path)
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("age_grp", T.StringType())])
    return S.read_csv(spark, path, schema, {"user_id": "id"})


@query("s4_keyed_scan", "SELECT watch_id FROM watches WHERE user_id IN (SELECT user_id FROM users WHERE user_id % 10 = 4)")
def s4(spark, d):
    return V.watches(spark, d).join(V.users(spark, d).filter("user_id % 10 = 4"), "user_id", "left_semi").select("watch_id")


@query("s5_json_lines", "SELECT item_id, genre FROM items")
def s5(spark, d):
    path = folder(spark)
    S.write_json_lines(V.items(spark, d).select("item_id", "genre"), path)
    return spark.read.schema("item_id long, genre string").json(path)


@query("s6_dictionary", "SELECT item_id, CASE WHEN genre IN ('red', 'blue') THEN 'color' WHEN genre = 'hot' THEN 'heat' END AS category FROM items")
def s6(spark, d):
    terms = S.flatten_dictionary(spark, {"color": ["red", "blue"], "heat": ["hot"]}).withColumnRenamed("term", "genre")
    return V.items(spark, d).join(F.broadcast(terms), "genre", "left").select("item_id", "category")


@query("s7_s8_snapshot_append", "SELECT item_id, count(*) AS n FROM (SELECT item_id FROM items UNION ALL SELECT item_id FROM items WHERE item_id % 2 = 0) GROUP BY item_id")
def s7(spark, d):
    items = V.items(spark, d).select("item_id")
    path = S.write_snapshot(items, folder(spark), V.AS_OF)
    S.append_parquet(items.filter("item_id % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query("s9_null_marker", "SELECT item_id, series_nm FROM items")
def s9(spark, d):
    path = folder(spark)
    V.items(spark, d).select("item_id", "series_nm").write.option("nullValue", "\\N").csv(path)
    return spark.read.schema("item_id long, series_nm string").option("nullValue", "\\N").csv(path)


@query("s10_replace_by_type", "SELECT type, count(*) AS n, max(score) AS top FROM (SELECT 'A' AS type, least(vote_avg, 1.0) AS score FROM items WHERE item_id % 3 = 0 UNION ALL SELECT 'B', least(vote_avg, 1.0) FROM items WHERE item_id % 2 = 0) GROUP BY type")
def s10(spark, d):
    path, items = folder(spark), V.items(spark, d).select("item_id", F.col("vote_avg").alias("score"))
    S.replace_by_type(items.withColumn("type", F.lit("A")).unionByName(items.filter("item_id % 2 = 0").withColumn("type", F.lit("B"))), path)
    S.replace_by_type(items.filter("item_id % 3 = 0").withColumn("type", F.lit("A")), path)
    return spark.read.parquet(path).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))


@query("s11_upsert", "SELECT user_id, item_id, arg_max(watch_id, (started_at, watch_id)) AS watch_id FROM watches GROUP BY ALL")
def s11(spark, d):
    w = V.watches(spark, d).select("user_id", "item_id", "watch_id", "started_at")
    latest = [F.desc("started_at"), F.desc("watch_id")]
    empty = w.limit(0)
    old = S.upsert(empty, w.filter("started_at < '1998-06-01'"), ["user_id", "item_id"], latest)
    return S.upsert(old, w.filter("started_at >= '1998-06-01'"), ["user_id", "item_id"], latest).select("user_id", "item_id", "watch_id")


@query("s12_insert_absent", "SELECT series_nm, coalesce(min(CASE WHEN item_id % 2 = 0 THEN item_id END), min(item_id)) AS item_id FROM items WHERE series_nm IS NOT NULL GROUP BY 1")
def s12(spark, d):
    items = V.items(spark, d).filter("series_nm IS NOT NULL").select("series_nm", "item_id")
    order = [F.col("item_id")]
    old = S.insert_absent(items.limit(0), items.filter("item_id % 2 = 0"), ["series_nm"], order)
    return S.insert_absent(old, items.filter("item_id % 2 = 1"), ["series_nm"], order)


FILL = "SELECT series_nm, min(poster_url) AS p FROM items WHERE series_nm IS NOT NULL GROUP BY 1"


@query("s13_fill_nulls", "SELECT item_id, coalesce(poster_url, p) AS poster_url FROM items LEFT JOIN fill USING (series_nm)", fill=FILL)
def s13(spark, d):
    items = V.items(spark, d)
    source = items.filter("series_nm IS NOT NULL").groupBy("series_nm").agg(F.min("poster_url").alias("poster_url"))
    return S.fill_nulls(items.select("item_id", "series_nm", "poster_url"), source, "series_nm", ["poster_url"]).select("item_id", "poster_url")


@query("s14_keyed_update", "SELECT item_id, CASE WHEN p IS NOT NULL THEN p ELSE poster_url END AS poster_url FROM items LEFT JOIN (SELECT p_name AS s, p_size AS season, 'u/' || min(p_partkey) AS p FROM part GROUP BY ALL) ON s = series_nm AND season = episode_no", fill=FILL)
def s14(spark, d):
    items = V.items(spark, d).withColumn("k", F.concat_ws("|", F.coalesce("series_nm", F.lit("?")), F.col("episode_no").cast("string")))
    part = V.table(spark, d, "part").groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("m"))
    source = part.select(F.concat_ws("|", "p_name", F.col("p_size").cast("string")).alias("k"), F.concat(F.lit("u/"), F.col("m").cast("string")).alias("poster_url"))
    return S.fill_nulls(items, source, "k", ["poster_url"], replace=True).select("item_id", "poster_url")


def titled(spark, d):
    """Items whose titles name a season: every third by a word, every third by a number, the others not at all."""
    k = F.col("item_id")
    name = F.regexp_replace("title", r" \d+회$", "")
    season = (k % 4 + 1).cast("string")
    return V.items(spark, d).withColumn("title", F.when(k % 3 == 0, F.concat(name, F.lit(" 시즌"), season, F.lit(" 01회"))).when(k % 3 == 1, F.concat(name, F.lit(" "), season, F.lit(" 02회"))).otherwise(F.col("title")))


SEASON = "CAST(CASE WHEN item_id % 3 = 2 THEN 1 ELSE item_id % 4 + 1 END AS INTEGER)"


@query("s14_by_season", f"SELECT item_id, coalesce(p, poster_url) AS poster_url FROM (SELECT *, {SEASON} AS season FROM items) LEFT JOIN (SELECT series_nm AS s, item_id % 4 + 1 AS of, 'u/' || min(item_id) AS p FROM items WHERE item_id % 2 = 0 AND series_nm IS NOT NULL GROUP BY ALL) ON s = series_nm AND of = season")
def s14_by_season(spark, d):
    source = V.items(spark, d).filter("item_id % 2 = 0 AND series_nm IS NOT NULL").groupBy("series_nm", (F.col("item_id") % 4 + 1).alias("season")).agg(F.concat(F.lit("u/"), F.min("item_id").cast("string")).alias("poster_url"))
    return S.update_by_season(titled(spark, d), source, ["poster_url"]).select("item_id", "poster_url")


@query("w19_by_season", f"SELECT series_nm, {SEASON} AS season, min(item_id) AS item_id FROM items WHERE poster_url IS NULL AND series_nm IS NOT NULL GROUP BY ALL")
def w19_by_season(spark, d):
    return season_work_list(titled(spark, d), "poster_url").withColumn("season", F.col("season").cast("int"))


@query("s3_jdbc_extract", "SELECT item_id, title, vote_avg FROM items")
def s3(spark, d):
    # a database in the memory of this process, so for local masters
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    S.write_jdbc(V.items(spark, d).select("item_id", "title", "vote_avg"), url, "items", properties=driver)
    return S.extract_jdbc(spark, url, "SELECT * FROM items", "item_id", folder(spark), 6, 3, driver)


@query("s15_merge_parts", "SELECT series_nm, coalesce(min(CASE WHEN item_id % 3 = 0 THEN item_id END), min(CASE WHEN item_id % 3 = 1 THEN item_id END)) AS item_id FROM items WHERE series_nm IS NOT NULL AND item_id % 3 < 2 GROUP BY 1")
def s15(spark, d):
    items = V.items(spark, d).filter("series_nm IS NOT NULL")
    part = lambda k: items.filter(f"item_id % 3 = {k}").groupBy("series_nm").agg(F.min("item_id").alias("item_id"))
    return S.merge_parts([part(0), part(1)], ["series_nm"])


@query("s16_resume", "SELECT item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM vectors)")
def s16(spark, d):
    return S.pending(V.items(spark, d), V.vectors(spark, d), "item_id").select("item_id")


@query("s17_weekly_layout", "SELECT CAST(started_at AS DATE) - CAST(dayofweek(started_at) AS INTEGER) AS week_start, count(*) AS n FROM watches WHERE started_at >= TIMESTAMP '1998-01-01' AND started_at < TIMESTAMP '1998-04-01' GROUP BY ALL")
def s17(spark, d):
    path = folder(spark)
    S.write_weekly(V.watches(spark, d), path, "started_at")
    return S.read_weeks(spark, path, "1998-01-01", "1998-04-01", "started_at").groupBy("week_start").agg(F.count(F.lit(1)).alias("n"))


@query("s19_backfill_list", "SELECT item_id FROM items WHERE series_nm IS NULL OR poster_url IS NULL OR director IS NULL OR cast_lead IS NULL OR rating IS NULL OR release_date IS NULL")
def s19(spark, d):
    return repair.backfill_list(V.items(spark, d), ["series_nm", "poster_url", "director", "cast_lead", "rating", "release_date"]).select("item_id")


@query("s20_provider_json", "SELECT item_id, title, CASE WHEN item_id % 2 = 0 THEN 'Brand#0' ELSE provider END AS director, genre, lpad(CAST(episode_no * 3 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(episode_no * 3 % 60 AS VARCHAR), 2, '0') AS disp_rtm, CASE WHEN item_id % 3 = 0 THEN 'k1' ELSE 'k2' END AS trailer FROM items")
def s20(spark, d):
    k = F.col("item_id")
    crew = F.array(F.struct(F.lit("Creator").alias("job"), F.col("provider").alias("name")), F.struct(F.when(k % 2 == 0, "Director").otherwise("Editor").alias("job"), F.lit("Brand#0").alias("name")))
    videos = F.array(F.struct(F.lit("en").alias("lang"), F.lit("Trailer").alias("kind"), F.lit("k2").alias("key")), F.struct(F.when(k % 3 == 0, "ko").otherwise("fr").alias("lang"), F.lit("Teaser").alias("kind"), F.lit("k1").alias("key")))
    nested = F.to_json(F.struct("title", F.array("genre", "ct_cl").alias("genres"), (F.col("episode_no") * 3).alias("runtime"), crew.alias("crew"), F.array("provider").alias("cast"), videos.alias("videos")))
    return S.flatten_provider(V.items(spark, d).select("item_id", nested.alias("j")), "j").select("item_id", "title", "director", "genre", "disp_rtm", "trailer")


@query("s21_conform", "SELECT item_id, CAST(genre AS VARCHAR) AS genre, 7 AS extra FROM items")
def s21(spark, d):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("genre", T.StringType()), T.StructField("extra", T.IntegerType())])
    return S.conform(V.items(spark, d), schema, {"extra": 7})


@query("a21_schema_drift", "SELECT item_id, 'missing' AS what FROM items WHERE item_id < 0 UNION ALL SELECT item_id, 'extra' FROM items")
def a21(spark, d):
    from pyspark.sql import types as T

    items = V.items(spark, d).select("item_id", "genre")
    drift = S.schema_drift(items, T.StructType([T.StructField("item_id", T.LongType())]))
    return items.select("item_id", F.explode(F.array(*[F.lit(what) for _, what, _, _ in drift])).alias("what"))


# ---- repair of names, genres and sentences ----


@query("h22_keyword_genre", "SELECT item_id, CASE WHEN contains(title, 'red') AND contains(title, 'ring') THEN NULL WHEN contains(title, 'red') THEN 'color' WHEN contains(title, 'bolt') OR contains(title, 'nut') THEN 'hardware' END AS genre, CASE WHEN contains(title, 'red') AND contains(title, 'ring') THEN 'ambiguous' WHEN contains(title, 'red') OR contains(title, 'bolt') OR contains(title, 'nut') THEN 'keyword' ELSE 'unresolved' END AS method FROM items")
def h22(spark, d):
    genre, method, _ = repair.keyword_genre(F.col("title"), [("color", ["red"]), ("hardware", ["bolt", "nut"])], [("red", "ring")])
    return V.items(spark, d).select("item_id", genre.alias("genre"), method.alias("method"))


@query("h23_genre_remap", "SELECT item_id, CASE WHEN genre_detail = 'red, ring' THEN 'jewel' WHEN ct_cl = 'PROMO' THEN 'ad' ELSE genre END AS genre FROM items")
def h23(spark, d):
    return repair.remap_genre(V.items(spark, d), {"red, ring": "jewel"}, {"PROMO": "ad"}).select("item_id", "genre")


@query("h24_unify", "SELECT CASE WHEN ct_cl LIKE 'PROMO%' THEN 'VALUE' || substr(ct_cl, 6) WHEN ct_cl LIKE 'ECONOMY%' THEN 'VALUE' || substr(ct_cl, 8) ELSE ct_cl END AS ct_cl, count(*) AS n, 0::BIGINT AS residual FROM items GROUP BY 1")
def h24(spark, d):
    found = repair.unify(V.items(spark, d), "ct_cl", {"^PROMO": "VALUE", "^ECONOMY": "VALUE"})
    return found.groupBy("ct_cl").agg(F.count(F.lit(1)).alias("n"), F.count_if("residual").alias("residual"))


# two names spelt from the letters of an item's words, in one of eight kinds of synopsis
LETTERS, FAMILY, GIVEN = "abcdefghijklmnopqrstuvwxyz", "김이박최정강조윤장임한오서신권황안송류전홍고문양손배", "민준연지우현수진영호선태경미혜정훈성희재윤하빈솔찬람"
NAMED = "SELECT item_id, " + ", ".join(f"translate(substr(split_part(genre_detail, ', ', {i}), 1, 1), '{LETTERS}', '{FAMILY}') || translate(substr(split_part(genre_detail, ', ', {i}), 2, 2), '{LETTERS}', '{GIVEN}') AS {n}" for i, n in ((1, "a"), (2, "b"))) + " FROM items"


@query("h26_guest_names", "SELECT item_id, CASE WHEN item_id % 8 IN (0, 2, 3) THEN CASE WHEN a = b THEN a ELSE a || '|' || b END WHEN item_id % 8 IN (1, 4, 5) THEN a ELSE '' END AS guests FROM people", people=NAMED)
def h26(spark, d):
    word = F.split("genre_detail", ", ")
    a, b = (F.concat(F.translate(F.substring(word[i], 1, 1), LETTERS, FAMILY), F.translate(F.substring(word[i], 2, 2), LETTERS, GIVEN)) for i in (0, 1))
    told = F.array(
        F.concat(F.lit("게스트: "), a, F.lit(", "), b, F.lit("가 출연")), F.concat(F.lit("특별 출연 "), a), F.concat(F.lit("가수 "), a, F.lit("의 무대, 셰프 "), b, F.lit("의 요리")), F.concat(a, F.lit("X"), b, F.lit(" 특집")),
        F.concat(a, F.lit("가 전격 합류")), F.concat(a, F.lit("과 함께 오늘의 이야기")), F.col("genre_detail"), F.lit("갈매기가 등장"),
    )
    texts = V.dealt(V.items(spark, d).select("item_id", F.get(told, (F.col("item_id") % 8).cast("int")).alias("text")), "item_id")
    return texts.select("item_id", F.array_join(repair.guest_names(F.col("text")), "|").alias("guests"))


@query("h27_romanised", "SELECT item_id, CASE WHEN item_id % 3 < 2 THEN (['김민수', '박지영'])[item_id % 3 + 1] END AS name FROM items")
def h27(spark, d):
    k = F.col("item_id") % 3
    raw = F.when(k == 0, "Kim Min-su").when(k == 1, "park ji yeong").otherwise(F.col("genre"))
    table = {"kim": "김", "min": "민", "su": "수", "park": "박", "ji": "지", "yeong": "영"}
    return V.items(spark, d).select("item_id", repair.romanised_name(raw, table).alias("name"))


@query("h28_name_replacement", "SELECT item_id, array_to_string(list_distinct_ordered, ', ') AS director FROM (SELECT item_id, list_filter(list_transform(l, lambda x: CASE x WHEN 'Brand#1' THEN 'Eins' WHEN 'Brand#2' THEN 'Eins' ELSE x END), lambda x, i: list_position(list_transform(l, lambda y: CASE y WHEN 'Brand#1' THEN 'Eins' WHEN 'Brand#2' THEN 'Eins' ELSE y END), x) = i) AS list_distinct_ordered FROM (SELECT item_id, list_transform(string_split(director, ','), lambda x: trim(x)) AS l FROM items))")
def h28(spark, d):
    return V.items(spark, d).select("item_id", repair.replace_names(F.col("director"), {"Brand#1": "Eins", "Brand#2": "Eins"}).alias("director"))


RENAMED = {"Brand#11": "Eins", "Brand#12": "Eins", "Brand#13": "Eins", "Brand#21": "Brand#22", "Brand#31": "Brand#32"}
OLD = "CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RENAMED.items()) + " ELSE {x} END"
NAMED = """SELECT item_id, 'director' AS category, unnest(l) AS value, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, list_transform(string_split(director, ','), lambda x: trim(x)) AS l FROM items)
    UNION ALL SELECT item_id, 'actor_lead', unnest(l), unnest(range(1, len(l) + 1)) FROM (SELECT item_id, list_transform(from_json(cast_lead, '["VARCHAR"]'), lambda x: trim(x)) AS l FROM items) UNION ALL SELECT item_id, 'provider', provider, 1 FROM items"""
ONCE = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"


@query(
    "h28_rename_cascade",
    f"""SELECT 'item' AS part, item_id AS id, array_to_string({ONCE.format(l='dl')}, ', ') AS a, '["' || array_to_string({ONCE.format(l='cl')}, '","') || '"]' AS b, NULL::DOUBLE AS x, NULL::BIGINT AS n FROM (SELECT item_id,
        list_transform(string_split(director, ','), lambda x: {OLD.format(x='trim(x)')}) AS dl, list_transform(from_json(cast_lead, '["VARCHAR"]'), lambda x: {OLD.format(x='trim(x)')}) AS cl FROM items)
    UNION ALL SELECT 'tag', item_id, category, CASE WHEN category = 'provider' THEN value ELSE {OLD.format(x='value')} END AS v, round(max(0.5 + 0.1 * i), 6), NULL FROM named GROUP BY item_id, category, v
    UNION ALL SELECT 'preference', user_id, category, CASE WHEN category = 'provider' THEN value ELSE {OLD.format(x='value')} END AS v, round(max(a), 6), sum(n)::BIGINT FROM (SELECT user_id, category, value, max(completion) AS a, count(*) AS n FROM watches JOIN named USING (item_id) GROUP BY ALL) GROUP BY user_id, category, v""",
    named=NAMED,
)
def h28_cascade(spark, d):
    items = V.items(spark, d)
    listed = lambda names, category: items.select("item_id", F.lit(category).alias("category"), F.posexplode(names).alias("i", "value"))
    tags = listed(C.comma_names(F.col("director")), "director").unionByName(listed(C.json_names(F.col("cast_lead")), "actor_lead")).unionByName(listed(F.array("provider"), "provider"))
    tags = tags.select("item_id", "category", "value", (F.lit(0.5) + 0.1 * (F.col("i") + 1)).alias("confidence"))
    # an item's tags travel as one list and are taken apart where a user's rows are together
    lists = tags.groupBy("item_id").agg(F.collect_list(F.struct("category", "value")).alias("_tags")).hint("merge")
    views = V.watches(spark, d).select("user_id", "item_id", "completion")
    mine = V.dealt(views.join(lists, "item_id"), "user_id").select("user_id", "completion", F.inline("_tags"))
    liked = mine.groupBy("user_id", "category", "value").agg(F.max("completion").alias("affinity"), F.count(F.lit(1)).alias("watch_count"))
    a, b, c = repair.rename_people(items, tags, liked, RENAMED)
    row = lambda rows, part, *columns: rows.select(F.lit(part).alias("part"), *[x.alias(n) for x, n in zip(columns, ("id", "a", "b", "x", "n"), strict=True)])
    none = F.lit(None)
    out = row(a, "item", F.col("item_id"), F.col("director"), F.col("cast_lead"), none.cast("double"), none.cast("long"))
    out = out.unionByName(row(b, "tag", F.col("item_id"), F.col("category"), F.col("value"), F.round("confidence", 6), none.cast("long")))
    return out.unionByName(row(c, "preference", F.col("user_id"), F.col("category"), F.col("value"), F.round("affinity", 6), F.col("watch_count")))


@query("h33_templates", "SELECT item_id, CASE WHEN genre = 'red' THEN 'all red things' WHEN genre = 'hot' THEN 'hot for you' ELSE 'more ' || genre END AS label FROM items")
def h33(spark, d):
    overrides = spark.createDataFrame([("red", "all red things")], "value string, special string")
    labels = spark.createDataFrame([("hot", "{value} for you")], "value string, template string")
    rows = V.items(spark, d).withColumnRenamed("genre", "value").join(F.broadcast(overrides), "value", "left").join(F.broadcast(labels), "value", "left")
    return rows.select("item_id", F.coalesce("special", F.replace(F.coalesce("template", F.lit("more {value}")), F.lit("{value}"), F.col("value"))).alias("label"))


@query("h35_sentence_rules", "SELECT item_id, CASE WHEN length(s) < 20 THEN 'length' ELSE '' END || CASE WHEN contains(s, 'red') THEN 'banned' ELSE '' END AS flags FROM (SELECT item_id, title || ' ' || ct_cl AS s FROM items)")
def h35(spark, d):
    flags = repair.sentence_flags(F.concat("title", F.lit(" "), "ct_cl"), F.lit("zzz"), ["red"])
    return V.items(spark, d).select("item_id", F.array_join(flags, "").alias("flags"))


@query("h36_search_queries", "SELECT item_id, CASE WHEN ct_cl = 'PROMO' THEN p_name || '|' || p_name || ' trailer' ELSE title || '|' || p_name || '|' || p_name || ' preview' END AS queries FROM items JOIN part ON item_id = p_partkey")
def h36(spark, d):
    return V.items(spark, d).select("item_id", F.array_join(repair.search_queries(F.col("title"), F.col("ct_cl") == "PROMO"), "|").alias("queries"))


@query("j7_nearest_source", "SELECT item_id, source_id FROM (SELECT a.item_id, b.item_id AS source_id, row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_cosine_similarity(a.visual, b.visual), 6) DESC, b.item_id) AS n FROM vectors a JOIN vectors b ON a.ct_cl = b.ct_cl AND a.item_id <> b.item_id) WHERE n = 1")
def j7(spark, d):
    from reelspark.operators.vectors import nearest

    v = V.vectors(spark, d).select("item_id", F.col("visual").alias("vector"), "ct_cl")
    return nearest(v.withColumnRenamed("item_id", "query_id"), v, 1, by="ct_cl").select(F.col("query_id").alias("item_id"), F.col("item_id").alias("source_id"))


GUESTS = """SELECT i.item_id, CASE WHEN i.item_id % 5 = 0 THEN ['Text#' || i.item_id] WHEN i.ct_cl LIKE 'PROMO%' THEN e.g ELSE s.g END AS guests, CASE WHEN i.item_id % 5 = 0 THEN 'text' WHEN i.ct_cl LIKE 'PROMO%' AND e.g IS NOT NULL THEN 'episode' WHEN i.ct_cl NOT LIKE 'PROMO%' AND s.g IS NOT NULL THEN 'series' END AS source
    FROM items i LEFT JOIN (SELECT p_name AS series_nm, p_size AS episode_no, list(DISTINCT p_brand ORDER BY p_brand) AS g FROM part WHERE p_partkey % 2 = 0 GROUP BY ALL) e ON e.series_nm = i.series_nm AND e.episode_no = i.episode_no
    LEFT JOIN (SELECT p_name AS series_nm, list(DISTINCT p_brand ORDER BY p_brand) AS g FROM part GROUP BY ALL) s ON s.series_nm = i.series_nm"""


@query("j23_guest_merge", "SELECT item_id, array_to_string(guests, ',') AS guests, source FROM guests", guests=GUESTS)
def j23(spark, d):
    items, part = V.items(spark, d), V.table(spark, d, "part").select(F.col("p_name").alias("series_nm"), F.col("p_size").alias("episode_no"), F.col("p_brand").alias("name"), "p_partkey")
    text = items.filter("item_id % 5 = 0").select("item_id", F.concat(F.lit("Text#"), F.col("item_id").cast("string")).alias("name"))
    found = repair.merge_guests(items, text, part.filter("p_partkey % 2 = 0"), part, F.col("ct_cl").startswith("PROMO"))
    return found.select("item_id", F.array_join("guests", ",").alias("guests"), "source")


@query("j25_guests_by_episode", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'own' ELSE g END AS guests FROM items LEFT JOIN (SELECT p_name, p_size, min(p_brand) AS g FROM part GROUP BY ALL) ON p_name = series_nm AND p_size = episode_no")
def j25(spark, d):
    from reelspark.functions.titles import episode_number

    source = V.table(spark, d, "part").groupBy(F.col("p_name").alias("series_nm"), F.col("p_size").alias("episode")).agg(F.min("p_brand").alias("g"))
    rows = V.items(spark, d).withColumn("episode", episode_number(F.col("title"))).join(source, ["series_nm", "episode"], "left")
    return rows.select("item_id", F.when(F.col("item_id") % 3 == 0, "own").otherwise(F.col("g")).alias("guests"))


@query("r12_sentence_lookup", """SELECT i.item_id, CAST(u.s AS INTEGER) AS segment, arg_min(d.doc_id, CASE WHEN d.doc_id % 5 = u.s THEN 0 ELSE 1 END * 1000000000 + d.doc_id) AS sentence_id FROM items i, (SELECT unnest(range(5)) AS s) u
    JOIN (SELECT doc_id, doc_id % (SELECT max(item_id) + 1 FROM items) AS item_id FROM documents) d ON d.item_id = i.item_id AND (d.doc_id % 5 = u.s OR d.doc_id % 5 = 4) WHERE i.rating <> '19' OR u.s <> 0 GROUP BY ALL""")
def r12_lookup(spark, d):
    items = V.items(spark, d).select("item_id", "rating")
    most = items.agg(F.max("item_id")).first()[0] + 1
    sentences = V.table(spark, d, "documents").select((F.col("doc_id") % most).alias("item_id"), (F.col("doc_id") % 5).cast("int").alias("segment"), F.col("doc_id").alias("sentence_id"))
    asked = items.select("item_id", "rating", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("segment"))
    return repair.sentence_lookup(asked.filter(repair.tone_allowed(C.normal_rating(F.col("rating")), F.col("segment"), {0: ("청소년관람불가",)})), sentences, 4).select("item_id", "segment", "sentence_id")


@query("r12_r16_sentences", "SELECT item_id, CAST(s AS INTEGER) AS segment, rating <> '19' OR s <> 0 AS allowed FROM items, (SELECT unnest(range(5)) AS s)")
def r12(spark, d):
    rows = V.items(spark, d).select("item_id", "rating", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("segment"))
    return rows.select("item_id", "segment", repair.tone_allowed(C.normal_rating(F.col("rating")), F.col("segment"), {0: ("청소년관람불가",)}).alias("allowed"))


@query("s2_read_or_empty", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def s2(spark, d):
    """The event files and a folder that isn't there: the rows of the first."""
    schema = V.table(spark, d, "events").schema
    both = S.read_or_empty(spark, f"{d}/events.parquet", schema).unionByName(S.read_or_empty(spark, f"{d}/no-such-signals.parquet", schema))
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
