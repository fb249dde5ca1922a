"""Queries that apply the column functions to whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.functions import cleaning as C
from reelspark.functions import titles as N
from reelspark.plans import views as V
from reelspark.plans.views import with_views

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, **views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, **views)
        return f

    return add


def korean(key):
    """Two syllables that follow from a key: the tables hold no Hangul titles of their own."""
    syllable = lambda n: F.decode(F.unhex(F.concat(*[F.lpad(F.hex(b), 2, "0") for b in (224 + F.shiftright(n, 12), 128 + F.shiftright(n, 6).bitwiseAND(63), 128 + n.bitwiseAND(63))])), "UTF-8")
    return F.concat(syllable((44032 + key * 37 % 11172).cast("int")), syllable((44032 + key * 91 % 11172).cast("int")))


KOREAN = "chr(CAST(44032 + item_id * 37 % 11172 AS INTEGER)) || chr(CAST(44032 + item_id * 91 % 11172 AS INTEGER))"


@query("h1_duration", "SELECT item_id, CAST(CAST(split_part(disp_rtm, ':', 1) AS INTEGER) * 3600 + CAST(split_part(disp_rtm, ':', 2) AS INTEGER) * 60 AS INTEGER) AS seconds FROM items")
def h1(spark, d):
    return V.items(spark, d).select("item_id", C.duration_seconds(F.col("disp_rtm")).alias("seconds"))


@query("h2_yes_no", "SELECT user_id, CASE WHEN is_test THEN TRUE WHEN user_id % 3 = 0 THEN FALSE END AS flag FROM users")
def h2(spark, d):
    raw = F.when(F.col("is_test"), " y").when(F.col("user_id") % 3 == 0, "N ").otherwise("?")
    return V.users(spark, d).select("user_id", C.yes_no(raw).alias("flag"))


@query("h3_placeholder", "SELECT item_id, CASE WHEN item_id % 4 >= 2 THEN genre END AS genre FROM items")
def h3(spark, d):
    k = F.col("item_id") % 4
    raw = F.when(k == 0, " - ").when(k == 1, "").otherwise(F.concat(F.lit(" "), "genre"))
    return V.items(spark, d).select("item_id", C.placeholder_to_null(raw).alias("genre"))


@query("h4_percent", "SELECT watch_id, CAST(least(round_even(completion * 100, 0), 100) AS INTEGER) AS pct, round(least(greatest(completion * 1.2, 0.0), 1.0), 6) AS clipped FROM watches")
def h4(spark, d):
    return V.watches(spark, d).select("watch_id", C.percent(F.col("completion")).alias("pct"), F.round(C.unit_range(F.col("completion") * 1.2), 6).alias("clipped"))


@query("h5_json_names", "SELECT item_id, array_to_string(list_transform(CAST(json(cast_lead) AS VARCHAR[]), lambda x: trim(x)), '|') AS names FROM items")
def h5(spark, d):
    return V.items(spark, d).select("item_id", F.array_join(C.json_names(F.col("cast_lead")), "|").alias("names"))


@query("h6_comma_names", "SELECT item_id, array_to_string(list_transform(string_split(director, ','), lambda x: trim(x)), '|') AS names FROM items")
def h6(spark, d):
    return V.items(spark, d).select("item_id", F.array_join(C.comma_names(F.col("director")), "|").alias("names"))


@query("h7_detail_genres", "SELECT item_id, CASE WHEN genre_detail IN ('red, ring', 'hot, plate') THEN '' ELSE replace(genre_detail, ', ', '|') END AS genres FROM items")
def h7(spark, d):
    return V.items(spark, d).select("item_id", F.array_join(C.detail_genres(F.col("genre_detail"), ("red, ring", "hot, plate")), "|").alias("genres"))


@query("h8_rating", "SELECT item_id, CASE rating WHEN '7' THEN '7세이상관람가' WHEN '12세이상' THEN '12세이상관람가' WHEN '15' THEN '15세이상관람가' WHEN '19' THEN '청소년관람불가' ELSE rating END AS rating FROM items")
def h8(spark, d):
    return V.items(spark, d).select("item_id", C.normal_rating(F.col("rating")).alias("rating"))


@query("h9_confidence", "SELECT item_id, CASE WHEN vote_cnt > 0 AND vote_avg > 0 THEN round(least(ln(vote_cnt + 1) / ln(40001.0) * vote_avg / 10, 1.0), 6) ELSE 0.1 END AS confidence FROM items")
def h9(spark, d):
    return V.items(spark, d).select("item_id", C.item_confidence(F.col("vote_cnt"), F.col("vote_avg")).alias("confidence"))


@query(
    "h10_initials",
    f"""SELECT item_id, array_to_string(list_transform(string_split(ko || genre, ''), lambda c: CASE WHEN unicode(c) BETWEEN 44032 AND 55203
        THEN ('ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ')[CAST((unicode(c) - 44032) // 588 AS INTEGER) + 1] ELSE c END), '') AS initials FROM ko""",
    ko=f"SELECT item_id, genre, {KOREAN} AS ko FROM items",
)
def h10(spark, d):
    return V.items(spark, d).select("item_id", N.initials(F.concat(korean(F.col("item_id")), "genre")).alias("initials"))


@query("h11_episode", "SELECT item_id, CAST(episode_no AS INTEGER) AS episode FROM items")
def h11(spark, d):
    return V.items(spark, d).select("item_id", N.episode_number(F.col("title")).alias("episode"))


@query(
    "h12_trigram_similarity",
    """SELECT item_id, CASE WHEN n > 0 THEN round(i / n, 6) ELSE 0 END AS similarity FROM (
        SELECT item_id, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS n FROM tri)""",
    tri="""SELECT item_id, list_distinct(flatten(list_transform(string_split(genre || ' ' || lower(ct_cl), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS a,
        list_distinct(flatten(list_transform(string_split(replace(genre_detail, ',', ''), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS b FROM items""",
)
def h12(spark, d):
    return V.items(spark, d).select("item_id", F.round(N.trigram_similarity(F.concat("genre", F.lit(" "), "ct_cl"), F.col("genre_detail")), 6).alias("similarity"))


@query("h13_series_name", "SELECT item_id, p_name AS series FROM items JOIN part ON item_id = p_partkey")
def h13(spark, d):
    return V.items(spark, d).select("item_id", N.series_name(F.col("title")).alias("series"))


@query("h14_grouping_title", "SELECT item_id, p_name AS grouped FROM items JOIN part ON item_id = p_partkey")
def h14(spark, d):
    raw = F.concat(F.lit("[4K] "), "title", F.lit(" 시즌 2"), F.lit(" (더빙)"))
    return V.items(spark, d).select("item_id", N.grouping_title(raw).alias("grouped"))


@query("h15_item_text", "SELECT item_id, title || ' ' || ct_cl || ' ' || genre || ' ' || genre_detail || ' 감독: ' || director || ' ' || year(release_date) AS text FROM items")
def h15(spark, d):
    fields = [("", F.col("title")), ("", F.col("ct_cl")), ("", F.col("genre")), ("", F.col("genre_detail")), ("감독", F.col("director")), ("조연", F.lit(None).cast("string"))]
    return V.items(spark, d).select("item_id", C.item_text(fields, F.col("release_date")).alias("text"))


@query("h16_product_name", "SELECT item_id, p_name AS product FROM items JOIN part ON item_id = p_partkey")
def h16(spark, d):
    raw = F.concat(F.lit("Chef [무료] "), F.regexp_replace("title", r" \d+회$", ""), F.lit(" ★ 10박스 초특가"))
    return V.items(spark, d).select("item_id", N.product_name(raw).alias("product"))


@query("h17_promoted_series", "SELECT item_id, CASE WHEN item_id % 3 = 0 AND series_nm IS NOT NULL THEN series_nm || ' 시즌' || (item_id % 9) ELSE series_nm END AS series FROM items")
def h17(spark, d):
    title = F.when(F.col("item_id") % 3 == 0, F.concat("series_nm", F.lit(" 시즌"), (F.col("item_id") % 9).cast("string"), F.lit(" 1회"))).otherwise(F.col("title"))
    return V.items(spark, d).select("item_id", N.promoted_series(title, F.col("series_nm")).alias("series"))


@query("h18_season", "SELECT item_id, p_name AS base, CAST(CASE WHEN item_id % 3 = 0 THEN item_id % 8 + 2 WHEN item_id % 3 = 1 THEN item_id % 5 + 1 ELSE 1 END AS INTEGER) AS season FROM items JOIN part ON item_id = p_partkey")
def h18(spark, d):
    k, name = F.col("item_id"), F.regexp_replace("title", r" \d+회$", "")
    title = F.when(k % 3 == 0, F.concat(name, F.lit(" 시즌"), (k % 8 + 2).cast("string"), F.lit(" 01회"))).when(k % 3 == 1, F.concat(name, F.lit(" "), (k % 5 + 1).cast("string"), F.lit(" 02회"))).otherwise(F.col("title"))
    base, season = N.season_of(title)
    return V.items(spark, d).select("item_id", base.alias("base"), season.cast("int").alias("season"))


@query("h20_region", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '부산' WHEN item_id % 3 = 1 THEN genre ELSE '서울' END AS region FROM items")
def h20(spark, d):
    k = F.col("item_id") % 3
    area = F.when(k == 0, "부산광역시 해운대구").when(k == 1, F.concat(F.lit("경기도 "), "genre", F.lit("군"))).otherwise("서울특별시")
    return V.items(spark, d).select("item_id", N.region_of(area).alias("region"))


@query(
    "h25_validators",
    """SELECT item_id, item_id % 5 = 4 AS rating_ok, TRUE AS cast_ok, item_id % 2 = 0 AS date_ok, CASE WHEN item_id % 2 = 0 THEN 0.97::DOUBLE ELSE 0.82::DOUBLE END AS confidence FROM items""",
)
def h25(spark, d):
    day = F.when(F.col("item_id") % 2 == 0, F.date_format("release_date", "yyyy-MM-dd")).otherwise("2001-02-30")
    ok = C.valid_date(day)
    names = F.transform(C.json_names(F.col("cast_lead")), lambda n: F.regexp_replace(n, "#", "-"))
    return V.items(spark, d).select("item_id", C.valid_rating(F.col("rating")).alias("rating_ok"), C.valid_cast(names).alias("cast_ok"), ok.alias("date_ok"), C.field_confidence(ok, F.lit("imdb")).alias("confidence"))


@query(
    "h29_title_similarity",
    """SELECT item_id, round(CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN r
        ELSE len(list_intersect(list_distinct(string_split(a, '')), list_distinct(string_split(b, '')))) / greatest(len(list_distinct(string_split(a, ''))), len(list_distinct(string_split(b, '')))) * r END, 6) AS similarity
        FROM (SELECT item_id, replace(genre_detail, ', ', '') AS a, lower(replace(genre || ct_cl, ' ', '')) AS b,
          least(length(replace(genre_detail, ', ', '')), length(genre || ct_cl)) / greatest(length(replace(genre_detail, ', ', '')), length(genre || ct_cl)) AS r FROM items)""",
)
def h29(spark, d):
    return V.items(spark, d).select("item_id", F.round(N.title_similarity(F.regexp_replace("genre_detail", ",", ""), F.concat("genre", F.lit(" "), "ct_cl")), 6).alias("similarity"))


@query("h30_sequence_similarity", "SELECT item_id, round(1 - levenshtein(genre_detail, provider) / greatest(length(genre_detail), length(provider)), 6) AS similarity FROM items")
def h30(spark, d):
    return V.items(spark, d).select("item_id", F.round(N.sequence_similarity(F.col("genre_detail"), F.col("provider")), 6).alias("similarity"))


@query("h31_deterministic_id", "SELECT item_id, 'yt|' || sha256(title)[:16] AS asset_id FROM items")
def h31(spark, d):
    return V.items(spark, d).select("item_id", C.deterministic_id(F.col("title")).alias("asset_id"))


@query("h32_date_label", "SELECT item_id, month(release_date) || '월 ' || day(release_date) || '일(' || ('월화수목금토일')[isodow(release_date)] || ')' AS label FROM items")
def h32(spark, d):
    return V.items(spark, d).select("item_id", C.date_label(F.col("release_date")).alias("label"))


@query("h34_asset_url", "SELECT item_id, CASE WHEN poster_url IS NOT NULL THEN poster_url ELSE 'https://store/ads/' || replace(genre_detail, ', ', '%2C%20') || '.gif' END AS url FROM items")
def h34(spark, d):
    path = F.coalesce("poster_url", F.concat(F.lit("ads/"), "genre_detail", F.lit(".gif")))
    return V.items(spark, d).select("item_id", C.asset_url(path, "https://store/").alias("url"))


@query("h37_genre_match", "SELECT item_id, genre IN ('red', 'hot') OR ct_cl = 'PROMO' AS matches FROM items")
def h37(spark, d):
    parts = F.transform(F.split(F.concat("genre", F.lit(" / "), "ct_cl"), "/"), lambda g: F.trim(g))
    return V.items(spark, d).select("item_id", F.arrays_overlap(parts, F.array(F.lit("red"), F.lit("hot"), F.lit("PROMO"))).alias("matches"))


@query("h38_explanation", "SELECT item_id, '[{\"category\":\"genre\",\"value\":\"' || genre || '\"},{\"category\":\"provider\",\"value\":\"' || provider || '\"}]' AS tags FROM items")
def h38(spark, d):
    tag = lambda c: F.struct(F.lit(c).alias("category"), F.col(c).alias("value"))
    return V.items(spark, d).select("item_id", F.to_json(F.array(tag("genre"), tag("provider"))).alias("tags"))


@query(
    "h39_box_overlap",
    """SELECT item_id, round(CASE WHEN i > 0 THEN i / (100 + 100 - i) ELSE 0 END, 6) AS iou FROM (
        SELECT item_id, greatest(0, 10 - x) * greatest(0, 10 - y) AS i FROM (SELECT item_id, item_id % 13 AS x, item_id % 7 AS y FROM items))""",
)
def h39(spark, d):
    from reelspark.operators.signals import box_iou

    x, y = (F.col("item_id") % 13).cast("double"), (F.col("item_id") % 7).cast("double")
    a = F.array(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    return V.items(spark, d).select("item_id", F.round(box_iou(a, F.array(x, y, x + 10, y + 10)), 6).alias("iou"))


@query("h40_freshness", f"SELECT item_id, round(greatest(1 - date_diff('day', release_date, DATE '{V.AS_OF}') / 365, 0.0), 6) AS freshness FROM items")
def h40(spark, d):
    return V.items(spark, d).select("item_id", F.round(C.freshness(F.col("release_date"), F.lit(V.AS_OF).cast("date")), 6).alias("freshness"))


@query(
    "h41_episode_expansion",
    """SELECT item_id, CAST(e AS INTEGER) AS episode, p_name || ' ' || lpad(CAST(e AS VARCHAR), 2, '0') || '회' AS title
        FROM (SELECT item_id, p_name, unnest(range(1, CAST(p_size AS BIGINT) + 1)) AS e FROM items JOIN part ON item_id = p_partkey WHERE p_size <= 40)
        UNION ALL SELECT item_id, NULL, p_name FROM items JOIN part ON item_id = p_partkey WHERE p_size > 40""",
)
def h41(spark, d):
    from reelspark.operators.catalogue import expand_episodes

    shows = V.items(spark, d).select("item_id", F.regexp_replace("title", r" \d+회$", "").alias("title"), F.col("episode_no").alias("episodes"))
    return expand_episodes(shows, most=40).select("item_id", "episode", "title")


@query("h42_media_class", "SELECT item_id, CASE WHEN ct_cl = 'PROMO' THEN '영화' WHEN genre = 'red' THEN 'TV애니메이션' WHEN genre = 'hot' THEN 'TV 연예/오락' ELSE 'TV드라마' END AS class FROM items")
def h42(spark, d):
    genres = F.array(F.when(F.col("genre") == "red", "Animation").when(F.col("genre") == "hot", "Reality").otherwise("Drama"))
    return V.items(spark, d).select("item_id", C.media_class(F.when(F.col("ct_cl") == "PROMO", "movie").otherwise("tv"), genres).alias("class"))


@query("h43_cast_split", "SELECT item_id, split_part(director, ', ', 1) AS lead, split_part(director, ', ', 2) AS guests FROM items")
def h43(spark, d):
    lead, guests = C.lead_and_guests(C.comma_names(F.col("director")), 1)
    return V.items(spark, d).select("item_id", lead.alias("lead"), guests.alias("guests"))


@query("a24_completeness", "SELECT series_nm, max(n) AS completeness, min(CASE WHEN n = m THEN item_id END) AS item_id FROM (SELECT *, max(n) OVER (PARTITION BY series_nm) AS m FROM (SELECT series_nm, item_id, 2 + CASE WHEN poster_url IS NULL THEN 0 ELSE 1 END AS n FROM items WHERE series_nm IS NOT NULL)) GROUP BY series_nm")
def a24(spark, d):
    n = C.completeness([F.col("director"), F.col("poster_url"), F.col("release_date")])
    rows = V.items(spark, d).filter("series_nm IS NOT NULL").select("series_nm", "item_id", n.alias("n"))
    best = rows.groupBy("series_nm").agg(F.max(F.struct("n", (-F.col("item_id")).alias("i"))).alias("b"))
    return best.select("series_nm", F.col("b.n").alias("completeness"), (-F.col("b.i")).alias("item_id"))
