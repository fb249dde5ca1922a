"""Views of the star-schema test tables as a media catalogue: in DataFrames, and as SQL for the oracles."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that stands for today in all queries: nothing reads the clock.
AS_OF = "2001-11-05"


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share (below ``spark.checkpoint.dir``). Only a local session may leave the setting out."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"file://{tempfile.gettempdir()}/reelspark-shared"
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to shared storage and read back: what several joins need is worked out once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the folder of a frame from ``written``."""
    session, (first, *_) = df.sparkSession, [*df.inputFiles(), None]
    if first:
        path = session._jvm.org.apache.hadoop.fs.Path(first).getParent()
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to as many tasks as the session shuffles to: for long work on each row of a small file, which one task would read."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("age_grp"), (F.col("c_custkey") % 50 == 0).alias("is_test"), F.col("c_acctbal").alias("balance"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, word = F.col("p_partkey"), F.split("p_name", " ")
    return table(spark, sf_dir, "part").select(
        k.alias("item_id"),
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("회")).alias("title"),
        F.col("p_type").alias("ct_cl"),
        F.when(k % 7 != 0, F.col("p_name")).alias("series_nm"),
        F.when(k % 2 == 0, F.concat("p_brand", F.lit(", Brand#"), (k % 25 + 1).cast("string"))).otherwise(F.col("p_brand")).alias("director"),
        F.concat(F.lit('["'), word[1], F.lit('", " '), F.col("p_brand"), F.lit('"]')).alias("cast_lead"),
        F.concat(F.lit('["Guest#'), (k % 40).cast("string"), F.lit('", " '), word[0], F.lit('"]')).alias("cast_guest"),
        F.col("p_brand").alias("provider"),
        F.col("p_size").alias("episode_no"),
        word[0].alias("genre"),
        F.regexp_replace("p_name", " ", ", ").alias("genre_detail"),
        F.element_at(F.array(F.lit("7"), F.lit("12세이상"), F.lit("15"), F.lit("19"), F.lit("전체관람가")), (k % 5 + 1).cast("int")).alias("rating"),
        F.round((F.col("p_retailprice") - 900) / 10, 2).alias("vote_avg"),
        (k * 37 % 5000).alias("vote_cnt"),
        F.date_add(F.lit("1999-01-01").cast("date"), (k % 1500).cast("int")).alias("release_date"),
        F.when(k % 10 != 0, F.concat(F.lit("http://img/"), k.cast("string"), F.lit(".jpg"))).alias("poster_url"),
        F.concat(F.lpad((F.col("p_size") % 3).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.col("p_size").cast("string"), 2, "0")).alias("disp_rtm"),
    )


def watches(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """Who watched what: order lines with their customers. The orders side is no dimension table: Spark picks the join.

    With ``of`` (item_id) only views of these items: other lines go before they meet orders.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_shipdate")
    if of is not None:
        lines = lines.join(of, F.col("l_partkey") == F.col("item_id"), "left_semi")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("started_at"), (F.col("l_quantity") / 50).alias("completion"),
        (1 - F.col("l_discount")).alias("satisfaction"), (F.col("l_quantity") * 60).cast("int").alias("use_tms"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("watch_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item vectors: 32 components seen, 32 described."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.slice(v, 1, 32).alias("visual"), F.slice(v, 33, 32).alias("meta"), F.col("label").alias("ct_cl"))


def seconds_of(ts: str) -> Column:
    """A time's seconds within its ten minutes, to three places as SQL rounds a double: by its product with 1000, halves up.

    Spark's own ``round`` goes by the decimal digits of a double, so half milliseconds may end up one apart.
    """
    micros = F.expr(f"(minute({ts}) % 10) * 60000000L + cast(extract(SECOND FROM {ts}) * 1000000 AS long)")
    thousands = micros / F.lit(1e6) * F.lit(1000.0)
    whole = F.floor(thousands)
    return (whole + F.when(thousands - whole >= 0.5, 1).otherwise(0)) / F.lit(1000.0)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections on a timeline of each item, in seconds."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "view", "yolo").when(F.col("event_type") == "click", "clip").when(F.col("event_type") == "purchase", "stt").when(F.col("event_type") == "signup", "ocr").otherwise("scene")
    return table(spark, sf_dir, "events").select("event_id", k.alias("item_id"), kind.alias("kind"), seconds_of("ts").alias("at"), F.col("value").alias("score"), "user_id", "ts")


SQL = {
    "users": "SELECT c_custkey AS user_id, c_mktsegment AS age_grp, c_custkey % 50 = 0 AS is_test, c_acctbal AS balance FROM customer",
    "items": """SELECT p_partkey AS item_id, p_name || ' ' || p_size || '회' AS title, p_type AS ct_cl,
        CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS series_nm,
        CASE WHEN p_partkey % 2 = 0 THEN p_brand || ', Brand#' || (p_partkey % 25 + 1) ELSE p_brand END AS director,
        '["' || split_part(p_name, ' ', 2) || '", " ' || p_brand || '"]' AS cast_lead,
        '["Guest#' || (p_partkey % 40) || '", " ' || split_part(p_name, ' ', 1) || '"]' AS cast_guest, p_brand AS provider, p_size AS episode_no,
        split_part(p_name, ' ', 1) AS genre, replace(p_name, ' ', ', ') AS genre_detail,
        (['7', '12세이상', '15', '19', '전체관람가'])[p_partkey % 5 + 1] AS rating,
        round((p_retailprice - 900) / 10, 2) AS vote_avg, p_partkey * 37 % 5000 AS vote_cnt,
        DATE '1999-01-01' + CAST(p_partkey % 1500 AS INTEGER) AS release_date,
        CASE WHEN p_partkey % 10 <> 0 THEN 'http://img/' || p_partkey || '.jpg' END AS poster_url,
        lpad(CAST(p_size % 3 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS disp_rtm
        FROM part""",
    "watches": """SELECT o_custkey AS user_id, l_partkey AS item_id, l_shipdate AS started_at, l_quantity / 50 AS completion, 1 - l_discount AS satisfaction,
        CAST(l_quantity * 60 AS INTEGER) AS use_tms, l_orderkey * 10 + l_linenumber AS watch_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "vectors": "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[])[1:32] AS visual, CAST(embedding AS DOUBLE[])[33:64] AS meta, label AS ct_cl FROM embeddings",
    "signals": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
        CASE event_type WHEN 'view' THEN 'yolo' WHEN 'click' THEN 'clip' WHEN 'purchase' THEN 'stt' WHEN 'signup' THEN 'ocr' ELSE 'scene' END AS kind,
        round((epoch_us(ts) % 600000000) / 1e6, 3) AS at, value AS score, user_id, ts FROM events""",
}


def with_views(sql: str, **more: str) -> str:
    """The statement with the views that it names, and further ones, in front."""
    named = {**SQL, **more}
    used: list[str] = []

    def need(text: str, within: tuple[str, ...]) -> None:
        for n, s in named.items():
            if n not in used and n not in within and _names(text, n):
                need(s, (*within, n))
                if n not in used:
                    used.append(n)

    need(sql, ())
    return "WITH " + ", ".join(f"{n} AS ({named[n]})" for n in used) + " " + sql if used else sql


def _names(text: str, name: str) -> bool:
    return re.search(rf"(?<![\w.]){name}(?![\w(])", text) is not None
