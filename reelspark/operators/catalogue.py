"""Upkeep of the item catalogue: expansion, propagation, repair, merging of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.titles import season_of


def expand_episodes(shows: DataFrame, most: int = 200) -> DataFrame:
    """One row for each episode of a show, its number in the title; a show with over ``most`` stays one row."""
    many = F.col("episodes") > most
    numbers = F.when(many | F.col("episodes").isNull() | (F.col("episodes") < 1), F.array(F.lit(None).cast("int"))).otherwise(F.sequence(F.lit(1), F.col("episodes").cast("int")))
    title = F.when(F.col("episode").isNull(), F.col("title")).otherwise(F.concat("title", F.lit(" "), F.lpad(F.col("episode").cast("string"), 2, "0"), F.lit("회")))
    return shows.withColumn("episode", F.explode(numbers)).withColumn("title", title)


def series_rollup(items: DataFrame) -> DataFrame:
    """One row for each series: smallest id with its fields, newest date, mean rating, sum of votes. Items without a series stay.

    ``items``: item_id, series_nm, genre, ct_cl, release_date, vote_avg, vote_cnt.
    """
    columns = ["item_id", "series_nm", "genre", "ct_cl", "release_date", "vote_avg", "vote_cnt"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("item_id"))).alias(c)
    rolled = items.filter("series_nm IS NOT NULL").groupBy("series_nm").agg(F.min("item_id").alias("item_id"), first("genre"), first("ct_cl"), F.max("release_date").alias("release_date"), F.avg("vote_avg").alias("vote_avg"), F.coalesce(F.sum("vote_cnt"), F.lit(0)).alias("vote_cnt"))
    return rolled.select(columns).unionByName(items.filter("series_nm IS NULL").select(columns))


def propagate_vectors(items: DataFrame, vectors: DataFrame, per_episode: tuple[str, ...] = ()) -> DataFrame:
    """(item_id, from_item_id): items without a vector get the one of the smallest sibling (same series and class) that has one."""
    known = items.filter("series_nm IS NOT NULL")
    if per_episode:
        known = known.filter(~F.col("ct_cl").isin(*per_episode))
    have = vectors.select("item_id").distinct()
    source = known.join(have, "item_id", "left_semi").groupBy("series_nm", "ct_cl").agg(F.min("item_id").alias("from_item_id"))
    return known.join(have, "item_id", "left_anti").join(source, ["series_nm", "ct_cl"]).select("item_id", "from_item_id")


def merge_sources(base: DataFrame, sources: list[tuple[str, DataFrame]], key: str, fields: list[str]) -> DataFrame:
    """Each field from the first source that has it, in order; ``provenance`` names those that gave something, joined by +."""
    out, gave = base, []
    values: dict[str, list[Column]] = {f: [] for f in fields}
    for name, source in sources:
        out = out.join(source.select(key, *[F.col(f).alias(f"_{name}_{f}") for f in fields]), key, "left")
        used = F.lit(False)
        for f in fields:
            mine = F.col(f"_{name}_{f}")
            used = used | (mine.isNotNull() & (F.coalesce(*values[f]).isNull() if values[f] else F.lit(True)))
            values[f].append(mine)
        gave.append(F.when(used, name))
    return out.select(*base.columns, *[F.coalesce(*values[f]).alias(f) for f in fields], F.concat_ws("+", *gave).alias("provenance"))


def missing_episodes(items: DataFrame, expected: DataFrame, episode: Column) -> DataFrame:
    """(series_nm, episode, ct_cl, genre): expected episodes that no title has, with their series' fields.

    ``expected``: series_nm, episodes (how many there should be).
    """
    have = items.filter("series_nm IS NOT NULL").select("series_nm", episode.alias("episode")).filter("episode IS NOT NULL").distinct()
    wanted = expected.select("series_nm", F.explode(F.sequence(F.lit(1), F.col("episodes").cast("int"))).alias("episode"))
    fields = items.filter("series_nm IS NOT NULL").groupBy("series_nm").agg(F.max("ct_cl").alias("ct_cl"), F.max("genre").alias("genre"))
    return wanted.join(have, ["series_nm", "episode"], "left_anti").join(fields, "series_nm")


def season_work_list(items: DataFrame, column: str) -> DataFrame:
    """(series_nm, season, item_id): the first item of each series and season, as titles name it, that lacks ``column``. ``items``: item_id, series_nm, title."""
    season = F.when(F.col("title").isNull(), 1).otherwise(season_of(F.col("title"))[1])
    rows = items.filter(F.col(column).isNull() & F.col("series_nm").isNotNull()).withColumn("season", season)
    return rows.groupBy("series_nm", "season").agg(F.min("item_id").alias("item_id"))


def rename_collisions(items: DataFrame) -> DataFrame:
    """Series whose name stands for several classes get their class in the name, and lose their poster."""
    several = items.filter("series_nm IS NOT NULL").groupBy("series_nm").agg(F.count_distinct("ct_cl").alias("_classes")).filter("_classes > 1")
    rows = items.join(several, "series_nm", "left")
    clash = F.col("_classes").isNotNull()
    return rows.withColumns({"series_nm": F.when(clash, F.concat("series_nm", F.lit(" ("), "ct_cl", F.lit(")"))).otherwise(F.col("series_nm")), "poster_url": F.when(~clash, F.col("poster_url"))}).drop("_classes").select(items.columns)


def first_per_group(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row of each group: the first in that order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: Lengths in seconds that suit a trailer best, and next best.
BEST_LENGTH, NEXT_LENGTH = (60, 300), (30, 600)


def ranked_clips(clips: DataFrame, keys: list[str], words: list[str], least: int, most: Column) -> DataFrame:
    """``clips`` (item_id, title, duration in seconds) of a length that is allowed, with their score and rank within ``keys``.

    A word of trailers in the title, in either case, counts three; the length one or two. Equal scores go to the shorter clip, then to the smaller id.
    A clip without a length is too short; one without a title has no such word. ``most`` may differ by row.
    """
    duration = F.coalesce("duration", F.lit(0))
    named = F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(F.coalesce("title", F.lit(""))), w)) if words else F.lit(False)
    length = F.when(duration.between(*BEST_LENGTH), 2).when(duration.between(*NEXT_LENGTH), 1).otherwise(0)
    rows = clips.filter((duration >= least) & (duration <= most)).withColumn("score", F.when(named, 3).otherwise(0) + length)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "duration", "item_id")
    return rows.withColumn("rank", F.row_number().over(order))


def match_conflict(classes: dict[str, list[str]], clashing: list[str], harmless: list[str], language: str, least: float = 0.4, sure: float = 0.7) -> Column:
    """Why a link to another catalogue is doubtful, the first reason that holds: missing, title, genre, kind or language; else ok.

    Of columns ct_cl, match_id, similarity, genres (the match's), kind (movie or tv) and match_language. ``classes`` lists those for children, of shows, and of
    all that runs on television. Genres that clash do so with the first two; a film for children needs a harmless one; a match in another language must be the surer for television.
    Null genres are none, a null similarity is 0, a null language is another one.
    """
    of = lambda name: F.coalesce(F.col("ct_cl").isin(*classes[name]), F.lit(False))
    genres = F.coalesce("genres", F.array().cast("array<string>"))
    any_of = lambda listed: F.arrays_overlap(F.filter(genres, lambda g: g.isNotNull()), F.array(*[F.lit(g) for g in listed]).cast("array<string>"))
    near = F.coalesce("similarity", F.lit(0.0))
    return (
        F.when(F.col("match_id").isNull(), "missing").when(near < least, "title").when((of("children") | of("shows")) & any_of(clashing), "genre")
        .when(of("children") & F.col("kind").eqNullSafe("movie") & ~any_of(harmless), "kind")
        .when(of("television") & ~F.col("match_language").eqNullSafe(language) & (near < sure), "language").otherwise("ok")
    )
