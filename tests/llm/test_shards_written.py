"""The shards hold the documents themselves."""

import tempfile

from pyspark.sql import functions as F

from reelspark.llm.sharding import write_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_documents_are_written(spark):
    rows = [(i, f"text {i % 7}" if i % 5 else None, None if i % 3 else "en", "a", i) for i in range(100)] + [(3, "twice", "a", None, 1)] * 9 + [(3, "twice", None, "a", 1)]
    path = tempfile.mkdtemp(prefix="spark-shards-") + "/out"
    got = write_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), path, 7, bucket_bytes=20)
    assert sorted(map(repr, got.select("doc_id", "text", "lang", "source", "n_chars").collect())) == sorted(map(repr, spark.createDataFrame(rows, SCHEMA).collect()))
    slots = {}
    for r in spark.read.parquet(path).collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_no_documents(spark):
    path = tempfile.mkdtemp(prefix="spark-shards-") + "/out"
    assert write_shards(spark.createDataFrame([], SCHEMA), path, 3).count() == 0


def test_query_reads_what_it_wrote(spark, small):
    from reelspark.llm.sharding import op9_sharding

    frame = op9_sharding(spark, small)
    files = frame.inputFiles()
    assert files and all("shard=" in f for f in files)
    assert frame.agg(F.count(F.lit(1))).first()[0] == spark.read.parquet(f"{small}/documents.parquet").count()
