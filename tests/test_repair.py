"""Renaming with clashes, season-keyed updates, key profiles, and an extract that goes on where it broke off."""

import shutil

import pytest
from pyspark.sql import functions as F

from reelspark.operators import catalogue, repair, statistics
from reelspark.sources import tables


def test_rename_people_merges_what_clashes(spark):
    items = spark.createDataFrame([(1, "Kim, Lee", '["Kim","Park"]', None), (2, None, "not a list", '["Lee"]'), (3, "Park", "[]", '["Kim","김"]')], "item_id long, director string, cast_lead string, cast_guest string")
    tags = spark.createDataFrame([(1, "director", "Kim", 0.4), (1, "director", "김", 0.9), (1, "genre", "Kim", 0.1), (2, "actor_lead", "Park", 0.5), (2, "actor_lead", None, 0.2)], "item_id long, category string, value string, confidence double")
    likes = spark.createDataFrame([(7, "director", "Kim", 0.9, 2), (7, "director", "김", 0.3, 5), (7, "genre", "Kim", 0.5, 1), (8, "actor_guest", "Kim", 0.2, 1)], "user_id long, category string, value string, affinity double, watch_count long")
    a, b, c = repair.rename_people(items, tags, likes, {"Kim": "김", "Park": "Kim"})
    assert sorted(map(tuple, a.collect())) == [(1, "김, Lee", '["김","Kim"]', None), (2, None, "not a list", '["Lee"]'), (3, "Kim", "[]", '["김"]')]
    assert {tuple(r) for r in b.collect()} == {(1, "director", "김", 0.9), (1, "genre", "Kim", 0.1), (2, "actor_lead", "Kim", 0.5), (2, "actor_lead", None, 0.2)}
    assert {tuple(r) for r in c.collect()} == {(7, "director", "김", 0.9, 7), (7, "genre", "Kim", 0.5, 1), (8, "actor_guest", "김", 0.2, 1)}


def test_updates_by_season(spark):
    items = spark.createDataFrame([(1, "A", "A 시즌2 3회", None), (2, "A", "A 3회", "old"), (3, "A", "A 2 1회", "old"), (4, None, "A 1회", "old"), (5, "B", None, None), (6, "A", "A 시즌9 1회", "old")], "item_id long, series_nm string, title string, poster_url string")
    source = spark.createDataFrame([("A", 1, "one"), ("A", 2, "two"), ("B", 1, None), ("A", 9, None)], "series_nm string, season int, poster_url string")
    got = tables.update_by_season(items, source, ["poster_url"])
    assert got.columns == items.columns and {r["item_id"]: r["poster_url"] for r in got.collect()} == {1: "two", 2: "one", 3: "two", 4: "old", 5: None, 6: "old"}
    work = catalogue.season_work_list(items.withColumn("poster_url", F.lit(None)), "poster_url")
    assert sorted(map(tuple, work.collect())) == [("A", 1, 2), ("A", 2, 1), ("A", 9, 6), ("B", 1, 5)]


def test_key_profile(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 9.0), (None, 3.0)], "k string, v double")
    got = statistics.profile_keys(rows, "k", "v", spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "k string"), 0.0, 5.0)
    assert {tuple(r) for r in got.collect()} == {("a", 2, 1, 1.0, 1.0, 0, "ok"), ("b", 1, 0, 9.0, 9.0, 1, "unexpected"), (None, 1, 0, 3.0, 3.0, 0, "unexpected"), ("z", 0, 0, None, None, 0, "missing")}


DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


def test_an_extract_goes_on_where_it_broke_off(spark, tmp_path):
    """A row that can't be read stops the extract halfway; once it is mended only the folders that are missing are read."""
    url, path = f"jdbc:derby:{tmp_path}/db;create=true", f"file://{tmp_path}/out"
    rows = lambda bad: spark.range(100).select("id", F.when(F.col("id") == bad, 0).otherwise(1).alias("d"))
    query = 'SELECT "id", 1 / "d" AS "q" FROM t'
    tables.write_jdbc(rows(-1), url, "t", properties=DRIVER)
    tables.extract_jdbc(spark, url, query, "id", path, 10, 2, DRIVER)
    for folder in tmp_path.glob("out/wave=*"):
        shutil.rmtree(folder)  # only the ranges are left
    tables.write_jdbc(rows(60), url, "t", "overwrite", properties=DRIVER)
    with pytest.raises(Exception, match="(?i)zero"):
        tables.extract_jdbc(spark, url, query, "id", path, 10, 2, DRIVER)
    before = {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("out/wave=*/*.parquet")}
    assert before
    tables.write_jdbc(spark.range(130).select("id", F.lit(1).alias("d")), url, "t", "overwrite", properties=DRIVER)
    got = tables.extract_jdbc(spark, url, query, "id", path, 10, 2, DRIVER)
    assert sorted(r["id"] for r in got.collect()) == list(range(130))  # later rows are in the last range
    after = {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("out/wave=*/*.parquet")}
    assert before.items() <= after.items() and len(after) > len(before)
    again = tables.extract_jdbc(spark, url, query, "id", path, 10, 2, DRIVER)
    assert again.count() == 130 and {p.name: p.stat().st_mtime_ns for p in tmp_path.glob("out/wave=*/*.parquet")} == after


def test_extract_of_few_rows(spark, tmp_path):
    """An empty table, and one with a null key and one key."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    frame = spark.createDataFrame([(None, 1), (5, 2)], "id long, v int")
    tables.write_jdbc(frame, url, "t", properties=DRIVER)
    assert sorted(r["v"] for r in tables.extract_jdbc(spark, url, "SELECT * FROM t", "id", f"file://{tmp_path}/a", 4, 2, DRIVER).collect()) == [1, 2]
    tables.write_jdbc(frame.limit(0), url, "e", properties=DRIVER)
    assert tables.extract_jdbc(spark, url, "SELECT * FROM e", "id", f"file://{tmp_path}/b", 4, 2, DRIVER).count() == 0
