"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash and counts them;
pass two shuffles each bucket in memory with Spark's own Fisher-Yates (``shuffle`` with a seed).
The buckets laid end to end are one random permutation, which is cut into shards whose row counts
differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.llm.common import materialise, nonnull_text, read_table, shared_folder

#: Records that one bucket holds on average; one bucket is shuffled in one task's memory.
BUCKET_ROWS = 20_000
#: Copies of one record that are counted out in one place.
COPIES_AT_ONCE = 10_000
#: Buckets whose starts are summed up in one task; then sums of so many buckets are.
BUCKETS_AT_ONCE = 1024


def shuffle_into_shards(records: DataFrame, shards: int, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Deal all rows of ``records`` into ``shards`` shards at random: adds shard and slot.

    Counts of shards differ by at most one, and slots run from 0 without gaps. Which bucket a record
    goes to follows from the seed alone; its place within also from the task that shuffles it, as
    Spark seeds its random numbers by task. The shuffled buckets are written before places are dealt,
    so a task that runs again deals the same. Nulls are values like any other; repeated rows are told
    apart by their number, so many copies of one row spread over all buckets; an empty input gives an
    empty result. Columns named like the added ones are replaced.

    A hot record's copies are counted out in parts, and where buckets start is summed up in two
    levels, so neither falls to one task.

    Rows of ``records`` should be small: for long payloads, pass keys and join the payload after
    (``write_shards`` does).
    """
    taken = [c for c in records.columns if c not in ("shard", "slot")]
    keys = [F.col(f"`{c}`") for c in taken]
    packed = records.select(F.struct(*keys).alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"))
    packed = materialise(packed)
    n = packed.agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-n // bucket_rows))
    # pass one: scatter, counting what each bucket gets
    copies = _copies(packed.filter(F.col("_copies") <= COPIES_AT_ONCE).withColumn("_from", F.lit(1).cast("long")))
    most = packed.filter(F.col("_copies") > COPIES_AT_ONCE).withColumn("_from", F.explode(F.sequence(F.lit(1).cast("long"), "_copies", F.lit(COPIES_AT_ONCE).cast("long"))))
    copies = copies.unionByName(_copies(most.repartition("_row", "_from")))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("_row"), F.col("_copy")), F.lit(buckets))
    scattered = copies.select("_row", "_copy", place.alias("_bucket"))
    # pass two: a fixed order to start from, then Fisher-Yates within the bucket
    shuffled = scattered.groupBy("_bucket").agg(F.shuffle(F.array_sort(F.collect_list(F.struct(F.xxhash64("_row", "_copy").alias("h"), "_copy", "_row"))), seed).alias("_rows"))
    shuffled = materialise(shuffled.select("_bucket", F.size("_rows").alias("_n"), "_rows"))
    starts = _bucket_starts(shuffled)  # Spark broadcasts it as long as it is small
    at = F.col("_start") + F.col("_pos")
    dealt = shuffled.join(starts, "_bucket").select("_start", F.posexplode("_rows").alias("_pos", "_item")).select(at.alias("_at"), "_item._row")
    # row p of the permutation belongs to shard floor(p * shards / n), which starts at ceil(shard * n / shards)
    n = max(n, 1)
    shard = f"(_at * {shards}L) div {n}L"
    first = f"(({shard}) * {n}L + {shards - 1}L) div {shards}L"
    return dealt.select("_row.*", F.expr(shard).cast("int").alias("shard"), F.expr(f"_at - {first}").alias("slot"))


def _copies(counted: DataFrame) -> DataFrame:
    """(_row, _copy): up to COPIES_AT_ONCE copies of each row, numbered from ``_from`` on."""
    to = F.least("_copies", F.col("_from") + (COPIES_AT_ONCE - 1))
    return counted.select("_row", F.explode(F.sequence("_from", to)).alias("_copy"))


def _bucket_starts(shuffled: DataFrame) -> DataFrame:
    """(_bucket, _start): where each bucket starts in the permutation.

    Buckets are summed up within runs of BUCKETS_AT_ONCE, the runs' sums (one short row for some 20
    million records) in one task.
    """
    sizes = shuffled.select("_bucket", F.col("_n").cast("long").alias("_n"), F.floor(F.col("_bucket") / BUCKETS_AT_ONCE).alias("_run"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = sizes.groupBy("_run").agg(F.sum("_n").alias("_n")).select("_run", before(Window.orderBy("_run")).alias("_of_run"))
    within = sizes.select("_bucket", "_run", before(Window.partitionBy("_run").orderBy("_bucket")).alias("_in_run"))
    return within.join(runs, "_run").select("_bucket", (F.col("_of_run") + F.col("_in_run")).alias("_start"))


def write_shards(documents: DataFrame, path: str, shards: int, seed: int = 42, bucket_bytes: int = 64 << 20) -> DataFrame:
    """Shuffle whole documents, text and all, and write them as Parquet below ``path``, one folder a shard. Returns the written table, with shard and slot.

    Only two hashes of each row are shuffled into places; rows follow by them once places are dealt, one of equal
    rows to all the places of its copies. A task writes about ``bucket_bytes`` of text, in order of slots, so a large shard is several files.
    """
    names = [c for c in documents.columns if c not in ("shard", "slot")]
    columns = [F.col(f"`{c}`") for c in names]
    # hashes pass over nulls, so which columns are null is hashed too
    hashed = [F.xxhash64(F.lit(k), *[c.isNull() for c in columns], *columns).alias(name) for k, name in ((1, "_a"), (2, "_b"))]
    total = documents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(nonnull_text())), F.lit(0)).alias("b")).first()
    rows = max(1, int(bucket_bytes / max(1.0, total["b"] / max(1, total["n"]))))
    places = materialise(shuffle_into_shards(documents.select(*hashed), shards, seed))
    one = documents.select(*hashed, *columns).dropDuplicates(["_a", "_b"])
    placed = places.join(one, ["_a", "_b"]).select(*columns, "slot", "shard")
    parts = max(shards, -(-total["n"] // rows))
    piece = F.floor(F.col("slot") / rows)
    placed.repartition(parts, "shard", piece).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path, compression="zstd")
    return documents.sparkSession.read.schema(placed.schema).parquet(path)


# ---- queries ----

SHARDS = 40


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt and written into 40 shards under the law ``rows``: counts at most one apart. What is returned is read from the shards."""
    text = nonnull_text()
    written = write_shards(read_table(spark, sf_dir, "documents"), shared_folder(spark), SHARDS)
    size, checksum = (F.octet_length(text) + 16).cast("long"), F.crc32(F.encode(text, "UTF-8"))
    return written.select("doc_id", size.alias("size"), checksum.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}
