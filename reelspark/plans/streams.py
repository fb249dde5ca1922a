"""Queries that run the event-driven flows, as streams over the event table's files, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.plans import views as V
from reelspark.plans.upkeep import folder
from reelspark.plans.views import with_views
from reelspark.streaming import flows

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None, **more: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_views(sql, **more)
        return f

    return add


#: Batches that the event table comes in, in order of time.
BATCHES = 3

#: Rows of a file at least, where a batch has several.
FILE_ROWS = 100_000


def events(spark, d):
    """The event table as a stream of BATCHES batches in order of time, its times as instants."""
    table = V.table(spark, d, "events")
    table = table.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("item_id", F.get_json_object("props", "$.k").cast("long"))
    edges = table.select(F.unix_seconds("ts").cast("double").alias("s")).approxQuantile("s", [k / BATCHES for k in range(1, BATCHES)], 0.01)
    kind = sum((F.when(F.unix_seconds("ts") > e, 1).otherwise(0) for e in edges), F.lit(0))
    path = folder(spark)
    parts = {k: table.filter(kind == k) for k in range(BATCHES)}
    rows = dict(table.groupBy(kind.alias("k")).count().collect())
    # a batch is told by its number of files, so all have the same; a hash of the row's number leaves none of them empty, which would not be written
    files = max(1, min(rows.get(k, 0) for k in parts) // FILE_ROWS)
    for part in parts.values():  # a file stream takes the oldest file first
        spread = part.withColumn("_n", F.monotonically_increasing_id()).repartition(files, "_n").drop("_n") if files > 1 else part.coalesce(1)
        spread.write.mode("append").parquet(path)
    return flows.stream_of(spark, path, table, files)


def ran(spark, stream, mode="append"):
    top = folder(spark)
    return flows.run_available(stream, f"{top}/out", f"{top}/state", mode)


@query("st1_heartbeats", "SELECT user_id, item_id, count(*) AS windows FROM (SELECT DISTINCT user_id, signals.item_id, time_bucket(INTERVAL 1 HOUR, ts) AS w FROM signals) WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM signals) GROUP BY ALL")
def st1(spark, d):
    beats = events(spark, d).select("user_id", "item_id", F.col("value").alias("progress"), "ts")
    out = ran(spark, flows.compact_heartbeats(beats, "1 hour", "0 seconds"))
    return out.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("windows"))


# booked for three hours later; an error that follows a booking cancels it; every fifth booking comes in twice
@query("st2_due_reservations", "SELECT event_id AS reservation_id, user_id FROM events b WHERE event_type = 'signup' AND ts + INTERVAL 180 MINUTE <= (SELECT max(ts) FROM events) AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'error' AND c.event_id = b.event_id + 1 AND c.ts < b.ts + INTERVAL 180 MINUTE)")
def st2(spark, d):
    def row(of, at, action):
        return F.struct(of.cast("long").alias("reservation_id"), at.cast("timestamp").alias("alert_at"), F.lit(action).alias("action"))

    kind, none, i = F.col("event_type"), F.lit(None), F.col("event_id")
    book = row(i, F.col("ts") + F.expr("INTERVAL 180 MINUTES"), "book")
    changes = F.when((kind == "signup") & (i % 5 == 0), F.array(book, book)).when(kind == "signup", F.array(book)).when(kind == "error", F.array(row(i - 1, none, "cancel"))).otherwise(F.array(row(none, none, "tick")))
    stream = events(spark, d).select("user_id", "ts", F.explode(changes).alias("r")).select("r.*", "user_id", "ts")
    return ran(spark, flows.reservation_alerts(stream)).select("reservation_id", "user_id")


@query("st3_episode_notices", "SELECT DISTINCT w.user_id, i.item_id, i.series_nm FROM events e JOIN items i ON i.item_id = CAST(json_extract_string(e.props, '$.k') AS BIGINT) JOIN (SELECT DISTINCT user_id, series_nm FROM watches JOIN items USING (item_id) WHERE completion > 0.95 AND series_nm IS NOT NULL) w ON w.series_nm = i.series_nm")
def st3(spark, d):
    series = V.items(spark, d).filter("series_nm IS NOT NULL").select("item_id", "series_nm")
    wishes = V.watches(spark, d).filter("completion > 0.95").join(series, "item_id").select("user_id", "series_nm").distinct()
    new = events(spark, d).select("item_id").join(series, "item_id")
    return ran(spark, flows.episode_notices(new, wishes)).distinct()


@query("st4_running_balance", "SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN -value ELSE value END), 4) AS balance FROM events GROUP BY user_id")
def st4(spark, d):
    ledger = events(spark, d).select("user_id", F.when(F.col("event_type") == "purchase", "spend").otherwise("earn").alias("kind"), F.col("value").alias("points"))
    balance = flows.running_balance(ledger)
    top = folder(spark)
    flows.run_batches(balance, flows.log_batches(f"{top}/out", ["user_id"]), f"{top}/state", "update")
    return flows.latest_of(spark, f"{top}/out", ["user_id"], balance.schema).select("user_id", F.round("balance", 4).alias("balance"))


@query("st5_change_feed", "SELECT source, action, count(*) AS n FROM (SELECT 'wish' AS source, event_type AS action FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT 'purchase', event_type FROM events WHERE event_type = 'purchase') GROUP BY ALL")
def st5(spark, d):
    e = events(spark, d).withColumn("action", F.col("event_type"))
    out = ran(spark, flows.change_feed({"wish": e.filter(F.col("event_type").isin("click", "view")), "purchase": e.filter("event_type = 'purchase'")}))
    return out.groupBy("source", "action").agg(F.count(F.lit(1)).alias("n"))


# items as 20 channels, sessions of 7 days; a click dismisses what is active for its channel
ST6 = """WITH shows AS (SELECT p.user_id, 'ad' || (s.event_id % 50) AS ad, time_bucket(INTERVAL 7 DAY, p.ts, TIMESTAMP '1970-01-01') AS session, p.item_id % 20 AS channel, p.ts
    FROM signals p JOIN signals s ON s.kind = 'ocr' AND s.item_id % 20 = p.item_id % 20 AND p.at BETWEEN s.at AND s.at + 40 WHERE p.kind = 'yolo'),
firsts AS (SELECT DISTINCT ON (user_id, ad, session) * FROM shows ORDER BY user_id, ad, session, ts, channel)
SELECT user_id, ad, session, EXISTS (SELECT 1 FROM signals c WHERE c.kind = 'clip' AND c.user_id = f.user_id AND c.item_id % 20 = f.channel AND c.ts >= f.ts AND time_bucket(INTERVAL 7 DAY, c.ts, TIMESTAMP '1970-01-01') = f.session) AS dismissed FROM firsts f"""


@query("st6_ads_at_playback", f"SELECT * FROM ({ST6})")
def st6(spark, d):
    channel = (F.col("item_id") % 20).alias("item_id")
    slots = V.signals(spark, d).filter("kind = 'ocr'").select(channel, F.col("at").alias("since"), (F.col("at") + 40).alias("until"), F.concat(F.lit("ad"), (F.col("event_id") % 50).cast("string")).alias("ad"))
    slots = V.written(flows._merged(slots))  # a batch would merge them again
    at = V.seconds_of("ts")
    stream = events(spark, d)
    positions = stream.filter("event_type = 'view'").withColumn("at", at).select("user_id", channel, "at", "ts")
    dismissals = stream.filter("event_type = 'click'").select("user_id", channel, "ts")
    out = ran(spark, flows.ads_at_playback(positions, dismissals, slots, "7 days"))
    return out.groupBy("user_id", "ad", F.col("session").cast("timestamp_ntz").alias("session")).agg(F.bool_or(F.col("action") == "dismissed").alias("dismissed"))


@query("st7_trailing_counts", "SELECT item_id, w AS since, count(*) AS views FROM (SELECT item_id, unnest(range(CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 6 DAY, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS w FROM signals) WHERE w + INTERVAL 7 DAY <= (SELECT max(ts) FROM signals) GROUP BY ALL")
def st7(spark, d):
    views = events(spark, d).select("item_id", "ts")
    return ran(spark, flows.trailing_counts(views, late="0 seconds")).select("item_id", F.col("since").cast("timestamp_ntz").alias("since"), "views")
