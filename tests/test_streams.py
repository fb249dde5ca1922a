"""Streams over several batches, with restarts between."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from reelspark.streaming import flows

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Appends a batch of rows as one file and runs the stream over what is new, from the same checkpoint each time."""

    class Feed:
        def __init__(self, schema):
            self.schema, self.path = schema, f"file://{tmp_path}/in"
            spark.createDataFrame([], schema).write.parquet(self.path)

        def add(self, rows):
            spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

        def stream(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)

        def run(self, flow):
            return sorted(map(tuple, flows.run_available(flow(self.stream()), f"file://{tmp_path}/out", f"file://{tmp_path}/state").collect()), key=str)

    return Feed


def state_rows(spark, tmp_path):
    return spark.read.format("statestore").load(f"file://{tmp_path}/state").count()


def test_reservations_are_told_once(spark, tmp_path, feed):
    """Late, repeated, moved, cancelled and overdue reservations over four batches, with a restart before each; the state is empty in the end."""
    f = feed("reservation_id long, user_id long, alert_at timestamp, action string, ts timestamp")
    flow = lambda s: flows.reservation_alerts(s, keep="60 minutes").select("reservation_id", "user_id")
    tick = lambda m: (None, None, None, "tick", at(m))
    f.add([(1, 10, at(5), "book", at(0)), (2, 20, at(50), "book", at(0)), (3, 30, at(6), "book", at(0)), (3, 30, None, "cancel", at(1)), (4, 40, at(5), "book", at(2)), (4, 40, at(45), "book", at(3)), tick(10)])
    assert f.run(flow) == [(1, 10)]  # 3 was cancelled, 4 moved
    f.add([(1, 10, at(5), "book", at(11)), (5, 50, at(4), "book", at(12)), (2, 20, None, "cancel", at(51)), tick(30)])
    assert f.run(flow) == [(1, 10), (2, 20), (4, 40), (5, 50)]  # 1 comes again, 5 was overdue, 2 was cancelled after its time
    f.add([(5, 50, at(4), "book", at(52)), (6, 60, at(53), "book", at(20)), tick(60)])
    assert f.run(flow) == [(1, 10), (2, 20), (4, 40), (5, 50)]  # 6 is older than the watermark
    f.add([tick(200)])
    assert f.run(flow) == [(1, 10), (2, 20), (4, 40), (5, 50)]
    assert state_rows(spark, tmp_path) == 0


def test_reservations_share_states(spark, tmp_path, feed):
    """A group of reservations is one state, with the times of each kept apart: 300 bookings are no 300 calls."""
    f = feed("reservation_id long, user_id long, alert_at timestamp, action string, ts timestamp")
    flow = lambda s: flows.reservation_alerts(s, keep="10 minutes", groups=4).select("reservation_id", "user_id")
    tick = lambda m: (None, None, None, "tick", at(m))
    f.add([(i, i * 10, at(5 if i % 2 else 45), "book", at(0)) for i in range(300)] + [(i, i * 10, None, "cancel", at(1)) for i in range(0, 300, 10)] + [tick(10)])
    odd = [(i, i * 10) for i in range(1, 300, 2)]
    assert sorted(f.run(flow)) == odd
    assert 0 < state_rows(spark, tmp_path) <= 4
    f.add([tick(60)])
    assert sorted(f.run(flow)) == sorted(odd + [(i, i * 10) for i in range(0, 300, 2) if i % 10])
    f.add([tick(200)])
    assert len(f.run(flow)) == 270
    assert state_rows(spark, tmp_path) == 0


def test_dismissed_ads_stay_away(spark, tmp_path, feed):
    """Shows and dismissals over batches: an ad once a session, gone once dismissed, back in the next session."""
    slots = spark.createDataFrame([(1, 0.0, 100.0, "a"), (1, 50.0, 100.0, "b"), (2, 0.0, 100.0, "c"), (2, 0.0, 100.0, "a")], "item_id long, since double, until double, ad string")
    f = feed("user_id long, item_id long, at double, ts timestamp")

    def flow(s):
        return flows.ads_at_playback(s.filter("at IS NOT NULL"), s.filter("at IS NULL"), slots, "1 hour", "1 minute").select("user_id", "item_id", "ad", "action", "ts")

    f.add([(7, 1, 10.0, at(1)), (7, 1, 20.0, at(2)), (8, 1, 60.0, at(2))])
    one = [(7, 1, "a", "shown", at(1)), (8, 1, "a", "shown", at(2)), (8, 1, "b", "shown", at(2))]
    assert f.run(flow) == sorted(one, key=str)
    f.add([(7, 1, None, at(3)), (7, 1, 60.0, at(4)), (8, 2, None, at(5))])
    two = [*one, (7, 1, "a", "dismissed", at(3)), (7, 1, "b", "shown", at(4))]  # nothing of item 2 was active for 8
    assert f.run(flow) == sorted(two, key=str)
    f.add([(7, 1, 30.0, at(6)), (7, 2, 30.0, at(7)), (7, 1, None, at(8)), (7, 1, None, at(9))])
    three = [*two, (7, 2, "c", "shown", at(7)), (7, 1, "b", "dismissed", at(8))]  # a was dismissed, so it isn't shown for item 2 either
    assert f.run(flow) == sorted(three, key=str)
    f.add([(7, 1, 10.0, at(70))])
    assert f.run(flow) == sorted([*three, (7, 1, "a", "shown", at(70))], key=str)
    f.add([(9, 9, None, at(400))])
    f.run(flow)
    assert spark.read.format("statestore").load(f"file://{tmp_path}/state").filter("partition_id >= 0").select("key.user_id").distinct().collect() in ([], [(9,)])


@pytest.mark.parametrize("fold_every", [2, 100])
def test_balances_are_a_log(spark, tmp_path, fold_every):
    """Four batches, a restart with new files and one without: a batch writes its own rows only, and folding changes nothing."""
    schema, src, top = "user_id long, kind string, points long", f"file://{tmp_path}/in", f"file://{tmp_path}"
    batches = [[(1, "earn", 10), (2, "earn", 5)], [(1, "spend", 3)], [(3, "earn", 1), (1, "earn", 1)], [(2, "spend", 5)]]
    want, keys = {}, ["user_id"]
    for n, rows in enumerate([*batches, []]):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        balance = flows.running_balance(spark.readStream.schema(schema).parquet(src))
        numbers = flows.run_batches(balance, flows.log_batches(f"{top}/out", keys, fold_every), f"{top}/state", "update")
        assert numbers == ([n] if rows else [])
        for u, kind, p in rows:
            want[u] = want.get(u, 0) + (p if kind == "earn" else -p)
        got = flows.latest_of(spark, f"{top}/out", keys, balance.schema)
        assert {r["user_id"]: r["balance"] for r in got.collect()} == want
    assert len(flows._numbers(spark, f"{top}/out/log")) == (0 if fold_every == 2 else 4) and len(flows._numbers(spark, f"{top}/out/base")) == (1 if fold_every == 2 else 0)


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    top = f"file://{tmp_path}/t"
    write = flows.log_batches(top, ["user_id"])
    frame = lambda rows: spark.createDataFrame(rows, "user_id long, balance long")
    write(frame([(1, 5), (2, 6)]), 0)
    write(frame([(1, 7), (3, 1)]), 1)
    write(frame([(1, 8)]), 1)
    rows = flows.latest_of(spark, top, ["user_id"], frame([(1, 1)]).schema)
    assert sorted(map(tuple, rows.collect())) == [(1, 8), (2, 6)]
    assert flows.latest_of(spark, f"{top}-none", ["user_id"], frame([(1, 1)]).schema).count() == 0
    assert rows.filter(F.col("user_id") == 3).isEmpty()


def test_a_batch_of_the_event_table_is_several_files(spark, small, tmp_path, monkeypatch):
    """One task no longer writes or reads a whole third; batches stay in order of time, and rows are the same."""
    import glob
    import os

    from reelspark.plans import streams

    want = sorted(map(tuple, streams.st1(spark, small).collect()))
    monkeypatch.setattr(streams, "FILE_ROWS", 50, raising=False)
    assert sorted(map(tuple, streams.st1(spark, small).collect())) == want
    monkeypatch.setattr(streams, "folder", lambda spark: f"file://{tmp_path}/events")
    streams.events(spark, small)
    files = sorted(glob.glob(f"{tmp_path}/events/part-*"), key=lambda f: os.stat(f).st_mtime_ns)
    each = len(files) // streams.BATCHES
    assert len(files) == each * streams.BATCHES and each > 1
    spans = [spark.read.parquet(*(f"file://{f}" for f in files[k : k + each])).agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first() for k in range(0, len(files), each)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)) and sum(s[2] for s in spans) == spark.read.parquet(f"{small}/events.parquet").count()


def test_users_share_states_of_their_ads(spark, tmp_path):
    """Few states, whose calls see all sessions of many users: as a fold over each user's rows by time."""
    import random

    rng = random.Random(9)
    slots = [(i, float(t), t + 40.0, f"ad{rng.randrange(6)}") for i in range(4) for t in range(0, 200, 25)]
    day = dt.datetime(2024, 1, 1)
    rows = [(rng.randrange(9), rng.randrange(4), rng.choice([None, float(rng.randrange(240))]), day + dt.timedelta(minutes=k)) for k in range(600)]
    want, sent, active = [], {}, {}
    for u, i, at, ts in rows:
        of = (u, ts.replace(minute=0))
        if at is None:
            want += [(u, i, ad, "dismissed", ts) for ad, on in active.get(of, {}).items() if on == i]
            active[of] = {ad: on for ad, on in active.get(of, {}).items() if on != i}
        else:
            for ad in sorted({ad for j, since, until, ad in slots if j == i and since <= at <= until} - sent.get(of, set())):
                sent.setdefault(of, set()).add(ad)
                active.setdefault(of, {})[ad] = i
                want.append((u, i, ad, "shown", ts))
    schema = "user_id long, item_id long, at double, ts timestamp"
    path = str(tmp_path / "in")
    for k in range(0, 600, 150):
        spark.createDataFrame([(*r[:3], r[3].replace(tzinfo=dt.timezone.utc)) for r in rows[k : k + 150]], schema).coalesce(1).write.mode("append").parquet(path)
    s = flows.stream_of(spark, path, spark.read.parquet(path), 1)
    found = flows.ads_at_playback(s.filter("at IS NOT NULL"), s.filter("at IS NULL"), spark.createDataFrame(slots, "item_id long, since double, until double, ad string"), "1 hour", "1 minute", groups=2)
    out = flows.run_available(found, str(tmp_path / "out"), str(tmp_path / "state"))
    got = [(r.user_id, r.item_id, r.ad, r.action, dt.datetime.fromtimestamp(r.us / 1e6, dt.timezone.utc).replace(tzinfo=None)) for r in out.selectExpr("*", "unix_micros(ts) us").collect()]
    assert sorted(got) == sorted(want)
    assert 0 < state_rows(spark, tmp_path) <= 2
