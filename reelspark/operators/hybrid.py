"""Tags, preferences, re-ranking and shelves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.cleaning import comma_names, detail_genres, item_confidence, json_names
from reelspark.operators.ranking import quota_blend, top_per_group


def item_tags(items: DataFrame) -> DataFrame:
    """(item_id, category, value, confidence): directors, leading and guest actors, genre and detail genres of each item.

    Items are dealt by their id before they become tags: a few MB of items are many times that in
    tags, so no task makes more than its share, and copies of a tag are dropped where they arise. For
    the same reason Spark takes the tags for smaller than they are; the hint keeps it from broadcasting them.
    """
    genre = F.trim("genre")
    values = {
        "director": comma_names(F.col("director")), "actor_lead": json_names(F.col("cast_lead")), "actor_guest": json_names(F.col("cast_guest")),
        "genre": F.when(genre != "", F.array(genre)), "genre_detail": detail_genres(F.col("genre_detail")),
    }
    lists = F.array(*[F.struct(F.lit(k).alias("category"), v.alias("values")) for k, v in values.items()])
    dealt = items.select("item_id", "director", "cast_lead", "cast_guest", "genre", "genre_detail", "vote_cnt", "vote_avg").repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item_id")
    rows = dealt.select("item_id", item_confidence(F.col("vote_cnt"), F.col("vote_avg")).alias("confidence"), F.explode(lists).alias("t"))
    tags = rows.select("item_id", F.col("t.category").alias("category"), F.explode("t.values").alias("value"), "confidence")
    return tags.dropDuplicates(["item_id", "category", "value"]).hint("merge")


def cold_start_tags(watches: DataFrame, users: DataFrame, tags: DataFrame, category: str, n: int, least: int = 3) -> DataFrame:
    """The tags of one category that most users of an age group watched, testers left out."""
    return _common_tags(watches, users, tags.filter(F.col("category") == category), F.lit(n), least).select("age_grp", "value", "users", "rank")


def _common_tags(watches: DataFrame, users: DataFrame, tags: DataFrame, most: Column, least: int) -> DataFrame:
    """(age_grp, category, value, users, rank): of each category the ``most`` tags that most users of an age group watched, testers left out.

    An item's tags travel as one list, and a user's tags come together where the user is, so what is shuffled on is a count for each task.
    """
    listed = tags.groupBy("item_id").agg(F.collect_list(F.struct("category", "value")).alias("_tags")).hint("merge")
    mine = watches.select("user_id", "item_id").join(listed, "item_id").join(users.filter(~F.col("is_test")).select("user_id", "age_grp"), "user_id")
    mine = mine.repartition(int(watches.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")
    once = mine.select("user_id", "age_grp", F.inline("_tags")).dropDuplicates(["user_id", "age_grp", "category", "value"])
    counted = once.groupBy("age_grp", "category", "value").agg(F.count(F.lit(1)).alias("users")).filter(F.col("users") >= least)
    return top_per_group(counted, ["age_grp", "category"], [F.desc("users"), F.col("value")], 1 << 30).filter(F.col("rank") <= most)


def hybrid_scores(candidates: DataFrame, tags: DataFrame, preferences: DataFrame, beta: float = 0.6, top_tags: int = 3, explained: int = 5) -> DataFrame:
    """Candidates with beta * score + (1 - beta) * mean of the best matched affinities, 1 at most, and the tags that explain it.

    A user without preferences keeps the scores as they are. ``candidates``: user_id, item_id, score, type.
    """
    # an item's tags travel as one list and are taken apart where the user's preferences are
    listed_tags = tags.groupBy("item_id").agg(F.collect_list(F.struct("category", "value")).alias("_tags")).hint("merge")
    mine = candidates.select("user_id", "item_id").distinct().join(listed_tags, "item_id").repartition("user_id").select("user_id", "item_id", F.inline("_tags"))
    matched = mine.join(preferences.select("user_id", "category", "value", "affinity"), ["user_id", "category", "value"])
    # an item has few tags, so those that match meet in one short list
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("affinity")).alias("o"), "category", "value"))), 1, max(top_tags, explained))
    overlap = matched.groupBy("user_id", "item_id").agg(listed.alias("_l"))
    first = F.slice("_l", 1, top_tags)
    mean = F.aggregate(first, F.lit(0.0), lambda t, x: t - x["o"]) / F.size(first)
    why = F.transform(F.slice("_l", 1, explained), lambda x: F.struct(x["category"].alias("category"), x["value"].alias("value"), (-x["o"]).alias("affinity")))
    overlap = overlap.select("user_id", "item_id", mean.alias("_t"), why.alias("explanation"))
    known = preferences.select("user_id").distinct().withColumn("_known", F.lit(True))
    rows = candidates.join(overlap, ["user_id", "item_id"], "left").join(known, "user_id", "left")
    score = F.when(F.col("_known"), F.round(F.least(beta * F.col("score") + (1 - beta) * F.coalesce("_t", F.lit(0.0)), F.lit(1.0)), 6)).otherwise(F.col("score"))
    return rows.withColumn("score", score).drop("_t", "_known")


def rerank(candidates: DataFrame, tags: DataFrame, preferences: DataFrame, n: int = 10, engine: str = "CF", slots: int = 0, beta: float = 0.6) -> DataFrame:
    """The ``n`` best of each user by hybrid score; with ``slots``, one engine's best come first."""
    scored = hybrid_scores(candidates, tags, preferences, beta)
    if slots:
        return quota_blend(scored, engine, slots, n)
    return top_per_group(scored, ["user_id"], [F.desc("score"), F.col("item_id")], n)


#: Rows of users that are scored together, more only where one user has more, and what stands for a null id there.
TOGETHER, NONE = 100_000, -(1 << 63)


def rerank_viewed(rows: DataFrame, tags: DataFrame, n: int = 10, engine: str = "CF", slots: int = 0, beta: float = 0.6, top_tags: int = 3, least: int = 2) -> DataFrame:
    """``rerank`` of candidates by the affinities that ``statistics.tag_affinity`` finds in the same users' views: user_id, item_id, score, type, rank.

    ``rows``: user_id, item_id, views (0 or more), completion, score, type; a row is some views of an item, a candidate, or both (without a
    type it is no candidate). A candidate that comes several times has its highest score and first type. A row meets its item's tags
    as a list of numbers and goes to its user once: affinities are counted, matched and summed up there, and only what may be among the best leaves.
    """
    listed = tags.groupBy("item_id").agg(F.collect_list(_number(tags)).alias("_tags")).hint("merge")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select("user_id", "item_id", F.col("views").cast("int").alias("views"), "completion", "score", "type").join(listed, "item_id", "left").repartition(parts, "user_id").sortWithinPartitions("user_id")
    run = _scored(n, engine, slots, beta, top_tags, least)
    found = met.select("user_id", "item_id", "views", "completion", "score", "type", "_tags").mapInArrow(run, "user_id long, item_id long, score double, type string, _t double, _known boolean")
    score = F.when(F.col("_known"), F.round(F.least(beta * F.col("score") + (1 - beta) * F.col("_t"), F.lit(1.0)), 6)).otherwise(F.col("score"))
    scored = found.withColumn("score", score).drop("_t", "_known")
    return quota_blend(scored, engine, slots, n) if slots else top_per_group(scored, ["user_id"], [F.desc("score"), F.col("item_id")], n)


def _number(tags: DataFrame) -> Column:
    """A hash that gives no two of the tags the same number: of 32 bits where one of a few does, else of 64."""
    each = tags.select("category", "value").distinct()
    for hashed in (F.hash, F.xxhash64):
        for salt in range(8):
            number = hashed(F.lit(salt), "category", "value")
            if each.groupBy(number).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
                return number
    raise ValueError("tags have the same numbers with every salt")


def _scored(n: int, engine: str, slots: int, beta: float, top_tags: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by user in; out the candidates that may be among the ``n`` best of their user, with the mean of their best affinities and whether the user has any."""

    def first(group: np.ndarray, most: int) -> np.ndarray:
        """Which rows are among the first ``most`` of their group; equal groups lie together."""
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        return np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)])) < most

    def may_be(user: np.ndarray, raw: np.ndarray, most: int, users: int) -> np.ndarray:
        """Whether a row may be among the ``most`` highest of its user once scores are rounded to six places."""
        order = np.lexsort((-raw, user))
        kept, last = order[first(user[order], most)], np.full(users, np.inf)
        np.minimum.at(last, user[kept], raw[kept])
        return raw >= last[user] - 2e-6

    def ids(column: pa.ChunkedArray) -> np.ndarray:
        return column.fill_null(NONE).to_numpy()

    def back(some: np.ndarray) -> pa.Array:
        return pa.array(some, pa.int64(), mask=some == NONE)

    def some(rows: pa.Table) -> pa.RecordBatch:
        users, user = np.unique(ids(rows["user_id"]), return_inverse=True)
        views, item = rows["views"].to_numpy(), ids(rows["item_id"])
        completion, score = rows["completion"].to_numpy(), rows["score"].to_numpy()  # null is NaN
        lists = rows["_tags"].combine_chunks()
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row, tag = np.repeat(np.arange(len(user)), lengths), lists.flatten().to_numpy()
        # affinities: of each user and tag the views and their mean completion
        tags, tag = np.unique(tag, return_inverse=True)
        pairs, pair = np.unique(user[row] * max(1, len(tags)) + tag, return_inverse=True)
        there = views * ~np.isnan(completion)
        seen, known, watched = (np.bincount(pair, weights=x[row], minlength=len(pairs)) for x in (views, there, np.where(there > 0, completion, 0.0) * there))
        total, owner = np.bincount(user, weights=views, minlength=len(users)), pairs // max(1, len(tags))
        with np.errstate(divide="ignore", invalid="ignore"):
            affinity = np.minimum(1.0, seen / total[owner] * np.where(known > 0, watched / known, 0.5) * 2)
        liked = seen >= least
        has = np.zeros(len(users), bool)
        has[owner[liked]] = True
        has &= users != NONE
        # candidates, each with the tags of one of its rows
        kinds = rows["type"].combine_chunks().dictionary_encode()
        names = np.array(kinds.dictionary.to_pylist(), object)
        place = np.argsort(names) if len(names) else np.zeros(0, np.int64)
        kind = np.where(kinds.indices.is_valid().to_numpy(zero_copy_only=False), kinds.indices.fill_null(0).to_numpy(zero_copy_only=False), -1)
        rank = np.empty(len(names), np.int64)
        rank[place] = np.arange(len(names))
        of = np.flatnonzero(kind >= 0)
        of = of[np.lexsort((-np.nan_to_num(score[of], nan=-np.inf), item[of], user[of]))]
        new = np.r_[True, (user[of][1:] != user[of][:-1]) | (item[of][1:] != item[of][:-1])] if len(of) else np.zeros(0, bool)
        best = of[new]
        kind = np.minimum.reduceat(rank[kind[of]], np.flatnonzero(new)) if len(of) else np.zeros(0, np.int64)
        candidate = np.full(len(user), -1)
        candidate[best] = np.arange(len(best))
        at = np.flatnonzero((candidate[row] >= 0) & liked[pair])
        group, value = candidate[row[at]], affinity[pair[at]]
        order = np.lexsort((-value, group))
        group, value = group[order], value[order]
        keep = first(group, top_tags)
        sums, counts = (np.bincount(group[keep], weights=w, minlength=len(best)) for w in (value[keep], None))
        mean = sums / np.maximum(counts, 1)
        user, score = user[best], score[best]
        raw = np.where(has[user], np.nan_to_num(np.minimum(beta * score + (1 - beta) * mean, 1.0), nan=1.0), np.nan_to_num(score, nan=-1e300))
        able = may_be(user, raw, n, len(users))
        if slots:
            mine = np.flatnonzero(names[place][kind] == engine) if len(best) else np.zeros(0, np.int64)
            able[mine] |= may_be(user[mine], raw[mine], slots, len(users))
        return pa.RecordBatch.from_arrays(
            [back(users[user[able]]), back(item[best][able]), pa.array(score[able], from_pandas=True), pa.array(names[place][kind[able]].tolist(), pa.string()), pa.array(mean[able]), pa.array(has[user[able]])],
            names=["user_id", "item_id", "score", "type", "_t", "_known"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, enough = [], 0, TOGETHER
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= enough:
                rows = pa.Table.from_batches(held)
                user = ids(rows["user_id"])
                whole = int(np.searchsorted(user, user[-1]))  # the last user may go on
                if whole:
                    yield some(rows.slice(0, whole))
                held, size = rows.slice(whole).to_batches(), len(user) - whole
                enough = max(TOGETHER, 2 * size)
        if size:
            yield some(pa.Table.from_batches(held))

    return run


def expand_series(candidates: DataFrame, representatives: DataFrame, items: DataFrame, engine: str) -> DataFrame:
    """Candidates of one engine also for the other episodes of the series they stand for, unless the user has these already.

    ``representatives``: item_id, series_nm.
    """
    episodes = representatives.withColumnRenamed("item_id", "rep").join(items.filter("series_nm IS NOT NULL").select("item_id", "series_nm"), "series_nm").filter("item_id <> rep").select("rep", "item_id")
    mine = candidates.filter(F.col("type") == engine)
    new = mine.withColumnRenamed("item_id", "rep").join(episodes, "rep").join(candidates.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    best = top_per_group(new, ["user_id", "item_id"], [F.desc("score"), F.col("rep")], 1, "_n")
    return candidates.unionByName(best.select(candidates.columns))


def liked_tags(preferences: DataFrame, watches: DataFrame, users: DataFrame, tags: DataFrame, slots: dict[str, int], extra: int = 10, least: int = 3) -> DataFrame:
    """(user_id, category, value, _r): each user's tags by affinity, ``extra`` more than there are ``slots`` of a category.

    Who likes fewer tags of a category than it has slots also gets those that most users of their age group watched, after their own.
    """
    near = _cuts(slots) + extra
    own = _own_tags(preferences, slots)
    cold = _common_tags(watches, users, tags.filter(F.col("category").isin(*slots)), near, least).select("age_grp", "category", "value", "rank")
    return own.filter(F.col("_r") <= near).unionByName(_spare_tags(_short(users, own, slots), F.broadcast(cold), own))


def _cuts(slots: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in slots.items() for x in pair]), F.col("category"))


def _own_tags(preferences: DataFrame, slots: dict[str, int]) -> DataFrame:
    return preferences.filter(F.col("category").isin(*slots)).select("user_id", "category", "value", F.row_number().over(Window.partitionBy("user_id", "category").orderBy(F.desc(F.round("affinity", 6)), "value")).alias("_r"))


def _short(users: DataFrame, own: DataFrame, slots: dict[str, int]) -> DataFrame:
    """(user_id, age_grp, category): where a user likes fewer tags than there are slots."""
    each = users.select("user_id", "age_grp", F.explode(F.array(*[F.lit(c) for c in slots])).alias("category"))
    return each.join(own.filter(F.col("_r") == _cuts(slots)).select("user_id", "category"), ["user_id", "category"], "left_anti")


def _spare_tags(short: DataFrame, cold: DataFrame, own: DataFrame) -> DataFrame:
    """(user_id, category, value, _r): the age group's tags that a user doesn't have, after their own."""
    spare = short.join(cold, ["age_grp", "category"]).join(own.select("user_id", "category", "value"), ["user_id", "category", "value"], "left_anti")
    return spare.select("user_id", "category", "value", (F.col("rank") + 1000).alias("_r"))


def tag_shelves(liked: DataFrame, tags: DataFrame, items: DataFrame, watches: DataFrame, slots: dict[str, int], per_tag: int = 10, buffer: int = 500) -> DataFrame:
    """(user_id, category, value, tag_rank, item_id, item_rank): shelves of the tags a user likes, each with ``per_tag`` unseen items of as many series.

    ``liked`` as from ``liked_tags``. A tag with fewer among its first ``buffer`` items is passed over and the next one of its category moves up.
    ``whole_tag_shelves`` has no such bounds.
    """
    shelf = top_per_group(tags.filter(F.col("category").isin(*slots)), ["category", "value"], [F.desc("confidence"), F.col("item_id")], buffer, "_c").join(_shown(items), "item_id").select("category", "value", "item_id", "_c", "_s")
    return _in_slots(_filled(liked, shelf, watches, per_tag).filter(F.size("_items") == per_tag), slots)


def whole_tag_shelves(preferences: DataFrame, watches: DataFrame, users: DataFrame, tags: DataFrame, items: DataFrame, slots: dict[str, int], write: Callable[[DataFrame], DataFrame], per_tag: int = 10, head: int = 60, extra: int = 10, least: int = 3) -> DataFrame:
    """As ``tag_shelves`` of ``liked_tags``, over all items of all tags that a user likes or that their age group watched.

    Most shelves are full from the first ``head`` items of a tag, and most users from ``extra`` tags more than there are slots.
    Only what these leave open is looked for in whole shelves and among all the other tags. ``write`` writes a frame to shared storage and reads it back.
    """
    tag, near = ["category", "value"], _cuts(slots) + extra
    mine = tags.filter(F.col("category").isin(*slots))
    shelf = write(mine.join(_shown(items), "item_id").select(*tag, "item_id", (-F.col("confidence")).alias("_o"), "_s"))
    heads = write(top_per_group(shelf, tag, [F.col("_o"), F.col("item_id")], head, "_c").select(*tag, "item_id", "_c", "_s"))
    longer = shelf.groupBy(*tag).agg((F.count(F.lit(1)) > head).alias("_longer"))
    own = write(_own_tags(preferences, slots))
    cold = write(_common_tags(watches, users, mine, F.lit(1 << 30), least).select("age_grp", *tag, "rank"))
    short = write(_short(users, own, slots))

    def full(rows: DataFrame) -> DataFrame:
        tried = write(_filled(rows, heads, watches, per_tag).join(longer, tag))
        left = tried.filter((F.size("_items") < per_tag) & F.col("_longer")).select("user_id", *tag, "_r")
        done = tried.filter(F.size("_items") == per_tag).drop("_longer")
        return done if left.isEmpty() else done.unionByName(write(_from_whole_shelves(left, shelf, watches, per_tag)))

    first = full(own.filter(F.col("_r") <= near).unionByName(_spare_tags(short, F.broadcast(cold.filter(F.col("rank") <= near)), own)))
    enough = write(first.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= _cuts(slots)).select("user_id", "category"))
    at = ["user_id", "category"]
    rest = write(own.filter(F.col("_r") > near).join(enough, at, "left_anti").unionByName(_spare_tags(short.join(enough, at, "left_anti"), cold.filter(F.col("rank") > near), own)))
    return _in_slots(first if rest.isEmpty() else first.unionByName(full(rest)), slots)


def _shown(items: DataFrame) -> DataFrame:
    return items.filter("poster_url IS NOT NULL").select("item_id", F.coalesce("series_nm", F.col("item_id").cast("string")).alias("_s"))


def _filled(liked: DataFrame, shelf: DataFrame, watches: DataFrame, per_tag: int) -> DataFrame:
    """(user_id, category, value, _r, _items): of each tag a user likes the first ``per_tag`` unseen items of as many series, or fewer.

    A shelf is a short list; of a user's history only what stands on a shelf of theirs matters, and who has none of that there gets the shelf's first items.
    """
    tag = ["user_id", "category", "value"]
    listed = shelf.groupBy("category", "value").agg(F.array_sort(F.collect_list(F.struct("_c", "item_id", "_s"))).alias("_shelf"))
    places = shelf.groupBy("item_id").agg(F.collect_list(F.struct("category", "value")).alias("_on"))
    seen = watches.select("user_id", "item_id").join(places, "item_id").distinct().select("user_id", "item_id", F.inline("_on")).groupBy(*tag).agg(F.collect_list("item_id").alias("_seen"))
    rows = liked.select(*tag, "_r").join(seen, tag, "left")
    none = F.array().cast("array<bigint>")
    start = F.struct(none.alias("items"), F.array().cast("array<string>").alias("series"))

    def add(kept: Column, x: Column) -> Column:
        """The next unseen item of a series that isn't there yet, until there are enough."""
        skip = (F.size(kept["items"]) >= per_tag) | F.array_contains(F.coalesce(F.col("_seen"), none), x["item_id"]) | F.array_contains(kept["series"], x["_s"])
        return F.when(skip, kept).otherwise(F.struct(F.array_append(kept["items"], x["item_id"]).alias("items"), F.array_append(kept["series"], x["_s"]).alias("series")))

    first = listed.withColumn("_seen", none).withColumn("_first", F.aggregate("_shelf", start, add)["items"]).drop("_seen")
    met = rows.join(first, ["category", "value"])
    # the fold runs only where a seen item is among the first ones
    items_of = F.when(F.arrays_overlap("_first", F.coalesce("_seen", none)), F.aggregate("_shelf", start, add)["items"]).otherwise(F.col("_first"))
    return met.select(*tag, "_r", items_of.alias("_items"))


def _from_whole_shelves(left: DataFrame, shelf: DataFrame, watches: DataFrame, per_tag: int) -> DataFrame:
    """As ``_filled``, from all items of a tag, and only what is full. ``shelf``: category, value, item_id, _o (order, before item_id), _s.

    Who has seen n items of a shelf needs no more than its first n + ``per_tag`` series and the first n + 1 items of each: n seen
    items leave so many series with an unseen one before any later series begins. So rows meet cuts of their shelf, made for n up to 1, 2, 4, ...
    """
    tag, of = ["category", "value"], ["user_id", "category", "value"]
    shelf = shelf.join(left.select(*tag).distinct(), tag, "left_semi")
    order = [F.col("_o"), F.col("item_id")]
    by_series = Window.partitionBy(*tag, "_s").orderBy(*order)
    placed = shelf.withColumns({"_within": F.row_number().over(by_series), "_begin": F.first(F.struct(*order)).over(by_series)}).withColumn("_series", F.dense_rank().over(Window.partitionBy(*tag).orderBy("_begin")))
    history = watches.select("user_id", "item_id").join(left.select("user_id").distinct(), "user_id", "left_semi").distinct()
    seen = history.join(shelf.select(*tag, "item_id"), "item_id").join(left.select(*of), of, "left_semi").select(*of, "item_id")
    size = F.ceil(F.log2(F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1)))).cast("int")
    asked = left.join(seen.groupBy(*of).agg(F.count(F.lit(1)).alias("_n")), of, "left").withColumn("_size", size).drop("_n")
    most = F.pow(F.lit(2.0), F.col("_size"))
    cut = placed.join(asked.select(*tag, "_size").distinct(), tag).filter((F.col("_series") <= most + per_tag) & (F.col("_within") <= most + 1)).select(*tag, "_size", *order, "_s")
    unseen = asked.join(cut, [*tag, "_size"]).join(seen, [*of, "item_id"], "left_anti")
    one = top_per_group(unseen, [*of, "_s"], order, 1, "_n")
    best = top_per_group(one, of, order, per_tag, "_c").groupBy(*of, "_r").agg(F.array_sort(F.collect_list(F.struct("_c", "item_id"))).alias("_l"))
    return best.filter(F.size("_l") == per_tag).select(*of, "_r", F.transform("_l", lambda x: x["item_id"]).alias("_items"))


def _in_slots(full: DataFrame, slots: dict[str, int]) -> DataFrame:
    """Full shelves as rows of items, as many of a category as it has slots."""
    tag = ["user_id", "category", "value"]
    ranked = full.withColumn("tag_rank", F.dense_rank().over(Window.partitionBy("user_id", "category").orderBy("_r"))).filter(F.col("tag_rank") <= _cuts(slots))
    return ranked.select(*tag, "tag_rank", F.posexplode("_items").alias("_p", "item_id")).select(*tag, "tag_rank", "item_id", (F.col("_p") + 1).alias("item_rank"))


def similar_or_popular(items: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """(item_id, similar_id, rank): for an item page: the nearest items with a poster, or for an item without a vector the best rated of its class and genre.

    The fallback takes the best ``n`` + 1 of each class and genre once, so items don't meet each other.
    """
    from reelspark.operators.vectors import nearest

    shown = items.filter("poster_url IS NOT NULL")
    near = nearest(vectors.withColumnRenamed("item_id", "query_id"), vectors.join(shown.select("item_id"), "item_id", "left_semi"), n)
    near = near.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("similar_id"), "rank")
    best = top_per_group(shown.select("ct_cl", "genre", F.col("item_id").alias("similar_id"), "vote_avg"), ["ct_cl", "genre"], [F.desc("vote_avg"), F.col("similar_id")], n + 1, "_n")
    rest = items.join(vectors.select("item_id"), "item_id", "left_anti").join(best, ["ct_cl", "genre"]).filter("item_id <> similar_id")
    return near.unionByName(top_per_group(rest, ["item_id"], [F.col("_n")], n).select("item_id", "similar_id", "rank"))


def personal_sections(shelves: DataFrame, preferences: DataFrame, n: int, reasons: dict[str, str]) -> DataFrame:
    """(user_id, section, category, value, reason, items): a user's ``n`` best shelves over all categories, one for each name.

    A name that two categories share counts for the one that the user likes better.
    """
    listed = shelves.groupBy("user_id", "category", "value").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_rank", "item_id"))), lambda s: s.item_id.cast("string")), ",").alias("items"))
    rows = listed.join(preferences.select("user_id", "category", "value", F.round("affinity", 6).alias("_a")), ["user_id", "category", "value"], "left").fillna(0.0, ["_a"])
    one = top_per_group(rows, ["user_id", "value"], [F.desc("_a"), F.col("category")], 1, "_n")
    best = top_per_group(one, ["user_id"], [F.desc("_a"), F.col("category"), F.col("value")], n, "section")
    texts = F.create_map(*[F.lit(x) for pair in reasons.items() for x in pair])
    return best.select("user_id", "section", "category", "value", F.concat(F.element_at(texts, F.col("category")), "value").alias("reason"), "items")


def filled_up(own: DataFrame, popular: DataFrame, users: DataFrame, watches: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, rank, personal): each user's own list, filled up to ``n`` with popular items that they haven't watched.

    ``own``: user_id, item_id, rank; ``popular``: item_id, rank, a short list; only users whose own list is short meet it.
    """
    full = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    short = users.select("user_id").join(full, "user_id", "left_anti")
    # the short list goes as one row; of a history only what is on the list matters, and of the list a user's first n
    ids = F.broadcast(popular.select("item_id"))
    seen = watches.select("user_id", "item_id").join(ids, "item_id", "left_semi").groupBy("user_id").agg(F.collect_set("item_id").alias("_seen"))
    listed = popular.agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("_list"))
    unseen = F.filter("_list", lambda x: ~F.coalesce(F.array_contains("_seen", x["item_id"]), F.lit(False)))
    spare = short.join(seen, "user_id", "left").crossJoin(F.broadcast(listed)).select("user_id", F.inline(F.slice(unseen, 1, n)))
    rows = own.select("user_id", "item_id", "rank", F.lit(True).alias("personal")).unionByName(spare.select("user_id", "item_id", "rank", F.lit(False).alias("personal")))
    order = [F.desc("personal"), F.col("_o"), F.col("item_id")]
    return top_per_group(rows.withColumnRenamed("rank", "_o"), ["user_id"], order, n).select("user_id", "item_id", "rank", "personal")
