"""What must hold for plans whose small tables grow into large ones on the way."""

from reelspark.operators import hybrid, statistics
from reelspark.plans import history as H
from reelspark.plans import views as V


def plan(frame) -> str:
    return frame._jdf.queryExecution().sparkPlan().toString()


def test_tags_are_not_broadcast(spark, small):
    watches = V.watches(spark, small)
    for frame in (watches.join(H.tags(spark, small), "item_id"), H.preferences(spark, small), H.j1(spark, small)):
        below = plan(frame).split("BroadcastHashJoin")[1:]
        assert not any("Generate" in part.splitlines()[0] or "[item_id#" in part.splitlines()[0] for part in below), plan(frame)
    assert "SortMergeJoin" in plan(watches.join(H.tags(spark, small), "item_id"))


def test_items_are_dealt_before_they_become_tags(spark, small):
    text = H.tags(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert text.index("Generate") < text.index("Exchange"), text  # plans are written from the end
    tags = H.tags(spark, small)
    assert tags.count() == tags.select("item_id", "category", "value").distinct().count()


def test_affinity_of_items_without_tags_and_of_null_completion(spark):
    watches = spark.createDataFrame([(1, 1, 0.5), (1, 1, None), (1, 2, 1.0), (1, 9, 1.0), (2, 1, None), (2, 2, None)], "user_id long, item_id long, completion double")
    tags = spark.createDataFrame([(1, "genre", "a"), (2, "genre", "a"), (2, "director", "d")], "item_id long, category string, value string")
    got = {(r.user_id, r.category, r.value): (r.affinity, r.watch_count) for r in statistics.tag_affinity(watches, tags).collect()}
    assert got == {(1, "genre", "a"): (1.0, 3), (2, "genre", "a"): (1.0, 2)}


def test_scores_where_no_tag_is_known(spark):
    cand = spark.createDataFrame([(1, 1, 0.5, "CF"), (1, 7, 0.5, "CF"), (2, 1, 0.5, "CF")], "user_id long, item_id long, score double, type string")
    tags = spark.createDataFrame([(1, "genre", "a"), (1, "genre", "b")], "item_id long, category string, value string")
    prefs = spark.createDataFrame([(1, "genre", "a", 0.5)], "user_id long, category string, value string, affinity double")
    got = {(r.user_id, r.item_id): round(r.score, 6) for r in hybrid.hybrid_scores(cand, tags, prefs).collect()}
    assert got == {(1, 1): 0.5, (1, 7): 0.3, (2, 1): 0.5}


def test_dictionary_is_broadcast_and_stretches_are_not(spark, small):
    from reelspark.operators.joins import ngram_containing

    text = plan(H.j21(spark, small))
    assert "BroadcastHashJoin" in text and "BuildRight" in text, text
    terms = spark.createDataFrame([("red",)], "term string")
    assert "SortMergeJoin" in plan(ngram_containing(V.items(spark, small).select("item_id", "title"), "title", terms, "term", 3, 5))


def test_segments_of_no_or_one_user(spark):
    from reelspark.operators import factors

    schema = "user_id long, vector array<double>, items long"
    for rows, want in (([(1, [0.6, 0.8], 3)], []), ([], []), ([(1, [0.6, 0.8], 30), (2, [0.6, 0.8], 1)], [(1, 0)])):
        frame = spark.createDataFrame(rows, schema)
        assert [tuple(r) for r in factors.segments(frame).collect()] == want
        assert [tuple(r) for r in factors.elbow(frame, (2, 3)).collect()] == [(2, 0.0), (3, 0.0)]


def test_half_milliseconds_round_as_in_sql(spark):
    import duckdb

    sql = "SELECT i, round((epoch_us(ts) % 600000000) / 1e6, 3) AS at FROM (SELECT i, TIMESTAMP '2024-01-01 00:10:00' + to_microseconds(i * 1000 + 500) AS ts FROM range(0, 600000, 7) t(i))"
    want = dict(duckdb.sql(sql).fetchall())
    ts = "TIMESTAMP_NTZ '2024-01-01 00:10:00' + make_dt_interval(0, 0, 0, (id * 1000 + 500) / 1000000)"
    got = {r.id: r["at"] for r in spark.range(0, 600000, 7).selectExpr("id", f"{ts} AS ts").select("id", V.seconds_of("ts").alias("at")).collect()}
    assert len(got) == len(want) and not [k for k in want if want[k] != got[k]]


def test_users_vectors_count_their_items(spark):
    from reelspark.operators.vectors import user_vectors

    watches = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5), (1, 2, 1.0), (1, 9, 1.0), (2, 9, 1.0), (3, 2, 0.0)], "user_id long, item_id long, completion double")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item_id long, v array<double>")
    (row,) = user_vectors(watches, items, "v").collect()
    assert (row.user_id, row["items"], [round(x, 6) for x in row.vector]) == (1, 2, [0.707107, 0.707107])


def test_items_that_come_in_again_meet_wishes_once(spark):
    from reelspark.streaming.flows import episode_notices

    new = spark.createDataFrame([(1, "s"), (1, "s"), (2, "s")], "item_id long, series_nm string")
    wishes = spark.createDataFrame([(7, "s"), (8, "s")], "user_id long, series_nm string")
    got = sorted((r.user_id, r.item_id) for r in episode_notices(new, wishes).collect())
    assert got == [(7, 1), (7, 2), (8, 1), (8, 2)]


def test_overlapping_slots_of_an_ad_are_one(spark):
    from reelspark.streaming.flows import _merged

    rows = [(1, "a", 0.0, 40.0), (1, "a", 10.0, 20.0), (1, "a", 30.0, 70.0), (1, "a", 70.0, 71.0), (1, "a", 71.5, 80.0), (1, "b", 0.0, 5.0), (2, "a", 0.0, 5.0), (1, "a", 0.0, 40.0)]
    got = sorted(tuple(r) for r in _merged(spark.createDataFrame(rows, "item_id long, ad string, since double, until double")).collect())
    assert got == [(1, "a", 0.0, 71.0), (1, "a", 71.5, 80.0), (1, "b", 0.0, 5.0), (2, "a", 0.0, 5.0)]


def test_items_are_dealt_before_their_guests_are_looked_for(spark, small):
    from reelspark.plans import upkeep

    text = upkeep.h26(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert text.index("regexp_extract_all") < text.index("Exchange"), text


def test_weights_of_a_sequence_hash_nothing(spark, small):
    assert "HashAggregate" not in plan(H.w17(spark, small))


def test_renamed_tags_travel_as_lists(spark, small):
    from reelspark.plans import upkeep

    assert "inline(_tags" in plan(upkeep.h28_cascade(spark, small))


def test_shelves_are_taken_apart_only_where_a_seen_item_is_among_the_first(spark):
    items = spark.createDataFrame([(i, f"s{i // 2}" if i < 8 else None, "p" if i != 9 else None) for i in range(12)], "item_id long, series_nm string, poster_url string")
    tags = spark.createDataFrame([(i, "genre", "a", 0.5) for i in range(12)] + [(i, "genre", "b", 0.5) for i in range(3)], "item_id long, category string, value string, confidence double")
    watches = spark.createDataFrame([(1, 11), (2, 0), (2, 2), (2, 0), (3, 0), (3, 1)], "user_id long, item_id long")
    liked = spark.createDataFrame([(u, "genre", v, r) for u in (1, 2, 3, 4) for r, v in enumerate("ba", 1)], "user_id long, category string, value string, _r int")
    found = hybrid.tag_shelves(liked, tags, items, watches, {"genre": 2}, per_tag=4, buffer=60)
    assert "arrays_overlap" in plan(found)
    got = {}
    for r in found.orderBy("user_id", "item_rank").collect():
        got.setdefault((r.user_id, r.value, r.tag_rank), []).append(r.item_id)
    assert got == {(1, "a", 1): [0, 2, 4, 6], (2, "a", 1): [1, 3, 4, 6], (3, "a", 1): [2, 4, 6, 8], (4, "a", 1): [0, 2, 4, 6]}


def test_lists_meet_a_history_where_the_user_is(spark):
    from reelspark.operators import evaluation

    similar = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2)], "source_id long, item_id long, rank int")
    history = spark.createDataFrame([(7, 1), (7, 1), (7, 9), (8, 1), (8, 2), (9, 9)], "user_id long, item_id long")
    found = evaluation.via_history(similar, history, 5)
    assert "LeftAnti" not in plan(found) and "inline(_items" in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == [(7, 2, 1), (7, 3, 2), (8, 3, 1)]


def test_candidates_are_dealt_by_user_before_they_are_grouped(spark, small):
    from reelspark.plans import recommendation as R

    text = R.candidates(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and "hashpartitioning(user_id" in text and ", item_id" not in text.split("Exchange hashpartitioning(")[1].splitlines()[0].split("),")[0], text
