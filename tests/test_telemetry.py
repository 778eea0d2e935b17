from pyspark.sql import functions as F

from netloom.operators import dashboard as dash
from netloom.operators import telemetry as tel

S = 1_000_000


def times(spark, *seconds):
    return spark.createDataFrame([(int(s * S),) for s in seconds], "t_us long")


def test_window_is_half_open_and_loss_clears(spark):
    rows = tel.telemetry(times(spark, 0.5, 1, 30, 30.000001, 95), times(spark, 30.5), times(spark, 60), times(spark, 60, 61)).orderBy("snapshot_us").collect()
    assert [r["snapshot_us"] // S for r in rows] == [30, 60, 90, 120]
    assert [r["received_per_window"] for r in rows] == [3, 1, 0, 1]
    assert [r["received_total"] for r in rows] == [3, 4, 4, 5]
    assert [r["packet_loss_detected"] for r in rows] == [False, True, False, False]
    assert [r["shadow_per_window"] for r in rows] == [0, 1, 1, 0]


def test_wider_window_sums_intervals(spark):
    none = times(spark, 1).limit(0)
    rows = tel.telemetry(times(spark, 1, 11, 21, 31), none, none, none, every_s=10, window_s=30).orderBy("snapshot_us").collect()
    assert [r["received_per_window"] for r in rows] == [1, 2, 3, 3]


def test_queue_usage(spark):
    row = spark.range(1).select(tel.queue_usage(F.lit(2), F.lit(10)).alias("a"), tel.queue_usage(F.lit(2), F.lit(0)).alias("b")).first()
    assert (row["a"], row["b"]) == (20.0, 0.0)


def test_engines_seen(spark):
    df = spark.createDataFrame([("a", 0), ("a", 100 * S), ("b", 69 * S)], "engine_id string, t_us long")
    got = {r["engine_id"]: r["online"] for r in tel.engines_seen(df, F.lit(100 * S)).collect()}
    assert got == {"a": True, "b": False}


def test_page_total_and_filters(spark):
    df = spark.range(30).select(F.col("id").alias("ts_us"), (F.col("id") % 2).alias("kind"), F.col("id").cast("string").alias("key"))
    rows = dash.list_rows(df, "ts_us", "key", limit=3, offset=1, kind=1, start_us=5).collect()
    assert [r["ts_us"] for r in rows] == [27, 25, 23] and {r["total_count"] for r in rows} == {13}


def test_rollup_of_hours_without_traffic(spark):
    h = 3600 * S
    act = spark.createDataFrame([(1,), (2,), (h + 1,)], "ts_us long")
    events = spark.createDataFrame([(1, "DoS"), (2, "Normal Traffic")], "ts_us long, prediction string")
    blocks = spark.createDataFrame([(2 * h, "block"), (2 * h, "unblocked")], "ts_us long, action_taken string")
    snaps = spark.createDataFrame([(1, 5, True)], "ts_us long, active_sessions long, lost boolean")
    got = {r["bucket_start_us"] // h: r for r in dash.rollup(act, events, blocks, snaps).collect()}
    assert (got[0]["threat_rate"], got[0]["active_sessions_peak"], got[0]["packet_loss_event_total"]) == (0.5, 5, 1)
    assert (got[1]["network_activity_total"], got[2]["blocked_event_total"], got[2]["threat_rate"]) == (1, 1, 0.0)


def test_latest_snapshot_at_or_before(spark):
    """Irregular snapshots with gaps, against a search of all of them."""
    import random

    from netloom.operators.dashboard import nearest_snapshot

    r = random.Random(4)
    times = sorted(r.sample(range(500, 60_000_000), 40)) + [59_000_000_000]
    snapshots = [(t, k) for k, t in enumerate(times)]
    asked = [(f"i{k}", r.choice([*times, r.randint(0, 70_000_000), r.randint(0, 70_000_000_000)])) for k in range(200)] + [("none", None), ("first", 3), ("late", 3_700_000_000)]
    got = nearest_snapshot(spark.createDataFrame(asked, "event_id string, last_seen_us long"), spark.createDataFrame(snapshots, "snapshot_us long, received long"), 1_000_000)
    want = {(i, *max((s for s in snapshots if t is not None and s[0] <= t), default=(None, None))) for i, t in asked}
    assert {(x.event_id, x.snapshot_us, x.received) for x in got.collect()} == want
    assert nearest_snapshot(got.select("event_id", "last_seen_us"), spark.createDataFrame([], "snapshot_us long, received long"), 1_000_000).filter("snapshot_us is null").count() == len(asked)
