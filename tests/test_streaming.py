"""Streams over several files, one micro-batch each, drained to the last row, against the batch operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from netloom.operators import detectors, features, response, sessions
from netloom.schema import FEATURES
from netloom.sources.derived import scored_packets
from netloom.sources.packets import packets, read_packets
from netloom.streaming import queries as st
from netloom.streaming.state import ACTIVE, CLOSING, MEASURES, DetectorState, SessionRecords, SessionState

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """The packets over several files, read one file per batch, each up to 8 s behind the ones before it."""
    root = str(tmp_path_factory.mktemp("feed"))
    rows = packets(spark, SF)
    cuts = rows.approxQuantile("t_us", [0.25, 0.5, 0.75], 0.0)
    late = F.col("t_us") + F.when(F.col("packet_id") % 2 == 0, 8_000_000).otherwise(0)
    bounds = [-1, *[int(c) for c in cuts], 1 << 62]
    for a, b in zip(bounds, bounds[1:], strict=False):
        rows.filter((late > a) & (late <= b)).coalesce(1).write.mode("append").parquet(f"{root}/p")
    return f"{root}/p"


def drained(spark, feed):
    return st.with_end(stream(spark, feed))


def stream(spark, feed):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    from netloom.schema import PACKET_SCHEMA

    return spark.readStream.schema(PACKET_SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(feed)


def test_packet_source_modes(spark, feed):
    assert read_packets(spark, feed).count() == 1000
    assert read_packets(spark, feed, streaming=True).isStreaming


SESSION_COLUMNS = ["flow_id", "start_us", "start_packet", "end_us", "packet_count", "byte_count", "reason"]


def test_sessions_equal_batch(spark, feed):
    p, finish = drained(spark, feed)
    out = st.run(spark, st.stream_sessions(p), "t_sessions", finish=finish)
    got = [tuple(r) for r in out.withColumns({"packet_count": F.col("n"), "byte_count": F.col("bytes")}).select(*SESSION_COLUMNS).collect()]
    batch = sessions.session_summary(sessions.assign_sessions(packets(spark, SF)), F.lit(st.FAR_US))
    assert sorted(got) == sorted(tuple(r) for r in batch.select(*SESSION_COLUMNS).collect()) and len(got) > 400


def test_scoring_points_equal_batch(spark, feed):
    """Measures at every scoring point, and of every ended session, as features."""
    p, finish = drained(spark, feed)
    out = features.to_features(st.run(spark, st.stream_sessions(p, live=True), "t_live", finish=finish))
    columns = ["flow_id", "start_us", "packet_id", "n", *FEATURES]
    assigned = sessions.assign_sessions(packets(spark, SF))
    points = features.live_features(assigned, sessions.predict_triggers(assigned))
    live = F.col("reason").isin(ACTIVE, CLOSING)
    got = sorted(tuple(r) for r in out.filter(live).select(*columns, "is_final").collect())
    assert got == sorted(tuple(r) for r in points.select(*columns, "is_final").collect()) and len(got) > 100
    ended = ["flow_id", "start_us", "n", *FEATURES]
    assert sorted(tuple(r) for r in out.filter(~live).select(*ended).collect()) == sorted(tuple(r) for r in features.session_features(assigned).select(*ended).collect())


def test_points_follow_the_rule():
    """Against the rule packet by packet, with sessions cut into arrivals anywhere."""
    rng = np.random.default_rng(3)
    state = SessionState(live=True)
    for _ in range(200):
        t = np.cumsum(rng.choice([1, 1000, 200_000, 400_000, 1_100_000], rng.integers(1, 40)))
        want, scored = [], None
        for i, now in enumerate(t):
            if i + 1 >= 5 and now - t[0] >= 1_000_000 and (scored is None or i - scored >= 5 or now - t[scored] >= 1_000_000):
                want.append(i)
                scored = i
        got, before = [], 0
        held = (0, 0)
        for part in np.split(t, sorted(rng.integers(0, len(t), 3))):
            for i in state._points(part, 0, len(part), int(t[0]), before, held):
                got.append(before + i)
                held = (before + i + 1, int(part[i]))
            before += len(part)
        assert got == want


def test_hot_flow_waits_in_slices(spark, tmp_path):
    """One flow with most rows, out of order over files; every state value holds rows of one second."""
    rows = [(i, 1_000_000 + i * 10_000, None, "10.0.0.1", "10.0.0.2", 17, 60, 1234, 53, None, None, None, 8, 0) for i in range(6000)]
    rows += [(6000 + i, (i + 1) * 1_000_000, None, f"10.0.1.{i}", "10.0.0.2", 1, 60, None, None, None, None, None, 8, 0) for i in range(40)]
    from netloom.schema import PACKET_SCHEMA

    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part[::-1], PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    p, finish = st.with_end(stream(spark, str(tmp_path / "p")))
    out = st.run(spark, st.stream_sessions(p, delay="100 seconds"), "t_hot", finish=finish).collect()
    assert sorted((r.src_ip, r.n, r.gap_sum) for r in out if r.src_ip == "10.0.0.1") == [("10.0.0.1", 6000, 59_990_000)]
    assert sum(r.src_ip.startswith("10.0.1.") and r.src_port is None for r in out) == 40


def test_rows_out_of_order_take_their_place(spark, tmp_path):
    """Ten packets a second apart, the odd ones in the second file, and a last one that lets the watermark pass."""
    rows = [(i, (i + 1) * 1_000_000, None, "10.0.0.1", "10.0.0.2", 6, 100, 1234, 80, 2, 1024, 20, 20, 0) for i in range(10)]
    end = (99, 200_000_000, None, "10.0.0.9", "10.0.0.2", 6, 100, 1234, 80, 16, 1024, 20, 20, 0)
    from netloom.schema import PACKET_SCHEMA

    for part in (rows[::2], rows[1::2], [end]):
        spark.createDataFrame(part, PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    got = st.run(spark, st.stream_sessions(stream(spark, str(tmp_path / "p"))), "t_order").collect()
    assert [(r.n, r.gap_sum, r.gap_min, r.gap_max, r.reason) for r in got] == [(10, 9_000_000, 1_000_000, 1_000_000, "idle_timeout")]
    found = st.run(spark, st.stream_detect(stream(spark, str(tmp_path / "p")), burst=(2, 3), syn=(3, 4)), "t_order").orderBy("packet_id").collect()
    assert [(r.scan_burst, r.syn_only_surge) for r in found] == [(i >= 2, i >= 3) for i in range(10)]


def test_manual_release_and_invalid_addresses(spark, tmp_path):
    rows = [("10.0.0.1", 1_000_000, 1, 300, False), ("10.0.0.1", 30_000_000, 2, 300, False), ("10.0.0.1", 31_000_000, 3, 0, True), ("10.0.0.1", 32_000_000, 4, 5, False), ("127.0.0.1", 1, 5, 5, False), ("10.0.0.2", 200_000_000, 6, 5, False)]
    schema = "ip string, t_us long, seq long, duration_s long, unblock boolean"
    for part in (rows[1::2], rows[::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "p"))
    got = {(r.ip, r.at_us, r.seq, r.status) for r in st.run(spark, st.stream_blocks(feed), "t_release").collect()}
    assert got == {
        ("10.0.0.1", 1_000_000, 1, "blocked"), ("10.0.0.1", 30_000_000, 2, "cooldown_active"), ("10.0.0.1", 31_000_000, 3, "unblocked"), ("10.0.0.1", 32_000_000, 4, "blocked"),
        ("10.0.0.1", 37_000_000, -1, "unblocked"), ("127.0.0.1", 1, 5, "invalid_or_loopback_ip"),
    }


def test_detectors_equal_batch(spark, feed):
    limits = dict(burst=(2, 5), sweep=(5, 4), syn=(3, 3))
    flags = ["packet_id", "scan_burst", "port_sweep", "syn_only_surge"]
    p, finish = drained(spark, feed)
    got = {tuple(r) for r in st.run(spark, st.stream_detect(p, **limits), "t_detect", finish=finish).select(*flags).collect()}
    batch = detectors.heuristic_decisions(packets(spark, SF), burst_n=5, sweep_n=4, syn_n=3)
    assert got == {tuple(r) for r in batch.select(*flags).collect()}
    assert any(r[1] for r in got) and any(r[2] for r in got) and any(r[3] for r in got)


class Held:
    """A value state in memory."""

    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_detectors_do_not_depend_on_slices():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = 60
        t = np.sort(rng.integers(0, 20_000_000, n))
        rows = pd.DataFrame({"t_us": t, "packet_id": np.arange(n), "dst_port": rng.integers(1, 8, n), "tcp_flags": rng.choice([2, 16, 18, 0], n)}).astype("Int64")
        seen = []
        for width in (1 << 40, 1_000_000, 100_000):
            state = DetectorState(burst=(2, 5), sweep=(5, 4), syn=(3, 3))
            state.recent = Held()
            found = [x for _, part in rows.groupby(rows.t_us // width) for x in state.take(("a",), part.reset_index(drop=True))]
            seen.append(pd.concat(found)[["scan_burst", "port_sweep", "syn_only_surge"]].to_numpy().tolist())
        assert seen[0] == seen[1] == seen[2]


def test_bruteforce_equals_batch(spark, feed):
    p, finish = drained(spark, feed)
    out = st.run(spark, st.stream_bruteforce(p, n=4), "t_brute", finish=finish)
    got = {(r["packet_id"], r["bruteforce"]) for r in out.collect()}
    assert got == {(r["packet_id"], r["bruteforce"]) for r in detectors.bruteforce(packets(spark, SF), n=4).collect()}


def test_blocks_equal_batch(spark, feed):
    requests, finish = st.with_end(response.ml_requests(scored_packets(stream(spark, feed))), ip="192.0.2.1")
    out = st.run(spark, st.stream_blocks(requests), "t_blocks", finish=finish)
    rows = out.collect()
    got = {(r["seq"], r["status"]) for r in rows if r["seq"] >= 0}
    dec = response.block_decisions(response.ml_requests(scored_packets(packets(spark, SF))))
    assert got == {(r["seq"], r["status"]) for r in dec.collect()}
    log = response.block_log(dec, F.lit(st.FAR_US)).filter("status = 'unblocked'")
    assert {(r["ip"], r["at_us"]) for r in log.collect()} == {(r["ip"], r["at_us"]) for r in rows if r["seq"] < 0}


def test_dedup_across_batches(spark, feed):
    rows = stream(spark, feed).select(F.col("t_us").alias("ts_us"), F.floor(F.col("packet_id") / 2).cast("string").alias("event_id"))
    out = st.run(spark, st.stream_dedup(rows, delay="3000 seconds"), "t_dedup")
    assert out.count() == 500


def _events_at(spark, folder, micros):
    """A driver's folder whose events lie so many microseconds after 2024-01-01, in turn of two users."""
    rows = [(30 * i + 2, 1_704_067_200_000_000 + us, 2 * (i % 2), "view", 10.0, "") for i, us in enumerate(micros)]
    frame = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double, props string")
    frame = frame.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")
    frame.toPandas().to_parquet(f"{folder}/events.parquet", coerce_timestamps="us")
    return folder


def test_events_of_one_millisecond_are_no_copies(spark, tmp_path):
    """Ids count milliseconds: two events of a session in one share an id, and only their own copies go."""
    from netloom.catalog import REGISTRY

    out = REGISTRY["st_dedup"](spark, _events_at(spark, str(tmp_path), [5_000_000, 6_000_000, 5_000_400])).collect()
    assert len(out) == 3 and len({r.event_id for r in out}) == 2


def test_telemetry_starts_after_the_epoch(spark, tmp_path):
    from netloom.catalog import REGISTRY

    out = REGISTRY["st_telemetry"](spark, _events_at(spark, str(tmp_path), [0, 10, 90_000, 180_000])).collect()
    assert sorted((r.snapshot_us, r.received) for r in out) == [(k * 5_000_000, 2) for k in range(1, 7)]


def test_keyed_state_takes_packets_at_and_before_the_epoch(spark, tmp_path):
    rows = [(i, t, None, "10.0.0.1", "10.0.0.2", 6, 100, 1234, 80, 2, 1024, 20, 20, 0) for i, t in enumerate([-90_000_000, -89_500_001, 0, 1, 2_000_000])]
    from netloom.schema import PACKET_SCHEMA

    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    for form in (st.stream_sessions, st.stream_sessions_simple):
        p, finish = st.with_end(stream(spark, str(tmp_path / "p")))
        out = st.run(spark, form(p), "t_epoch", finish=finish).filter("end_us < 100000000").collect()
        assert sorted((r.start_us, r.end_us) for r in out) == [(-90_000_000, -89_500_001), (0, 2_000_000)]


def test_feed_reads_its_table_a_fixed_number_of_times(spark, monkeypatch):
    """However many files the feed has; they hold every packet once, in the order of time in which they were written."""
    from pathlib import Path

    from netloom.sources import packets as source

    reads = spark.sparkContext.accumulator(0)

    def seen(t):
        reads.add(1)
        return t

    table, scratch, folders = source.packets, source.scratch, []

    def noted(*a):
        folders.append(scratch(*a))
        return folders[-1]

    monkeypatch.setattr(source, "packets", lambda *a: table(*a).withColumn("t_us", F.udf(seen, "long")("t_us")))
    monkeypatch.setattr(source, "scratch", noted)
    source.packet_feed(spark, SF, rows_per_file=50)
    assert 0 < reads.value <= 3000
    files = sorted(Path(folders[-1]).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) > 10
    parts = [pd.read_parquet(f) for f in files]
    assert all(a.t_us.max() < b.t_us.min() for a, b in zip(parts, parts[1:], strict=False))
    assert sorted(pd.concat(parts).packet_id) == sorted(r.packet_id for r in packets(spark, SF).select("packet_id").collect())


class HeldMap(dict):
    """A map state in memory."""

    updateValue, getValue, removeKey = dict.__setitem__, dict.__getitem__, dict.__delitem__


class Passed:
    """Timer values of a watermark later than every deadline."""

    def getCurrentWatermarkInMs(self):
        return (st.FAR_US + st.SHIFT_US) // 1000


class Handle:
    """Timers in memory."""

    def __init__(self):
        self.timers = []

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def test_thin_slices_are_taken_together():
    """Seconds with few packets cost no frame each, and the measures at points are those of all packets up to there."""
    rng = np.random.default_rng(5)
    n = 400
    t = np.cumsum(rng.choice([200_000, 900_000, 31_000_000], n, p=[0.5, 0.48, 0.02]))
    rows = pd.DataFrame({"t_us": t, "packet_id": np.arange(n), "packet_size": rng.integers(0, 1500, n), "payload_size": rng.integers(0, 3, n), "tcp_window_size": rng.integers(1, 9, n),
                         "transport_header_length": 20, "tcp_flags": rng.choice([16, 2, 17], n, p=[0.8, 0.18, 0.02])}).astype("Int64")
    seen = {}
    for chunk in (50_000, 40):
        state = SessionState(live=True)
        state.CHUNK = chunk
        state.handle, state.waiting, state.arrivals, state.open = Handle(), HeldMap(), Held(), Held()
        state.open.clear = lambda held=state.open: held.update(None)
        key = ("a", "10.0.0.1", "10.0.0.2", "1234", "", "6")
        # Arrivals out of order.
        list(state.handleInputRows(key, iter([rows[1::2], rows[::2]]), None))
        frames = list(state.handleExpiredTimer(key, Passed(), None))
        assert len(frames) <= (2 if chunk > n else 2 * n // chunk + 20)
        seen[chunk] = sorted(map(str, pd.concat(frames).itertuples(index=False, name=None)))
    assert seen[50_000] == seen[40] and len(seen[40]) > 60
    # Every measured row again, packet by packet.
    for r in pd.concat(frames).itertuples():
        part = rows[r.start_packet : r.packet_id + 1]
        gap = np.diff(part.t_us.to_numpy(np.int64))
        data = part.payload_size[part.payload_size > 0]
        assert (r.n, r.bytes, r.bytes_sq, r.size_min, r.size_max) == (len(part), part.packet_size.sum(), (part.packet_size**2).sum(), part.packet_size.min(), part.packet_size.max())
        assert (r.gaps, r.gap_sum, r.gap_sq) == (len(gap), gap.sum(), (gap * gap).sum())
        assert len(gap) == 0 or (r.gap_min, r.gap_max) == (gap.min(), gap.max())
        assert r.data_packets == len(data) and (len(data) == 0 or r.payload_min == data.min()) and r.window0 == part.tcp_window_size.iloc[0]
        assert r.syn == (part.tcp_flags & 2 > 0).sum() and r.fin == (part.tcp_flags & 1).sum() and r.header == 20 * r.n


def test_feed_batches_of_several_files(spark, monkeypatch):
    """A larger table comes in few batches of equally many files; no file of a batch is later than one of the next."""
    from pathlib import Path

    from netloom.sources import packets as source

    table, scratch, folders = source.packets, source.scratch, []

    def noted(*a):
        folders.append(scratch(*a))
        return folders[-1]

    monkeypatch.setattr(source, "scratch", noted)
    monkeypatch.setattr(source, "SHARED_ROWS", 20)
    # As they are, and with most packets at one time, which leaves ranges without rows.
    for t in (F.col("t_us"), F.when(F.col("packet_id") % 10 > 0, 50_000_000).otherwise(F.col("t_us"))):
        monkeypatch.setattr(source, "packets", lambda *a, t=t: table(*a).withColumn("t_us", t))
        feed = source.packet_feed(spark, SF, files_per_batch=4, rows_per_file=50)
        files = sorted(Path(folders[-1]).glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        parts = [pd.read_parquet(f) for f in files]
        batches = [pd.concat(parts[i : i + 4]) for i in range(0, len(parts), 4)]
        assert len(parts) % 4 == 0 and 1 < len(batches) <= 6 and min(map(len, parts)) > 0
        assert all(a.t_us.max() < b.t_us.min() for a, b in zip(batches, batches[1:], strict=False))
        assert sorted(pd.concat(parts).packet_id) == list(range(1000))
        query = feed.writeStream.format("memory").queryName("feed_batches").trigger(availableNow=True).start()
        query.awaitTermination()
        assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [len(b) for b in batches]


def test_session_records_hold_the_measures_of_sessions():
    """Records of few columns, which cost little to hand over, say the same as the wide rows."""
    rng = np.random.default_rng(6)
    n = 300
    rows = pd.DataFrame({"t_us": np.cumsum(rng.choice([300_000, 31_000_000], n, p=[0.95, 0.05])), "packet_id": np.arange(n), "packet_size": rng.integers(0, 1500, n), "payload_size": rng.integers(0, 2, n),
                         "tcp_window_size": pd.array([None if i % 3 else i for i in range(n)], "Int64"), "transport_header_length": 20, "tcp_flags": rng.choice([16, 17], n, p=[0.9, 0.1])})
    found = []
    for kind in (SessionState, SessionRecords):
        state = kind(live=True)
        state.handle, state.waiting, state.arrivals, state.open = Handle(), HeldMap(), Held(), Held()
        state.open.clear = lambda held=state.open: held.update(None)
        key = ("a", "10.0.0.1", "10.0.0.2", "1234", "", "6")
        list(state.handleInputRows(key, iter([rows]), None))
        found.append(pd.concat(list(state.handleExpiredTimer(key, Passed(), None))))
    wide, records = found
    assert len(records.columns) == 8 and len(records) == len(wide) > 50
    assert wide[MEASURES].astype("Int64").fillna(-1).to_numpy(np.int64).tolist() == np.stack(records.measures.to_list()).tolist()
    assert wide.reason.tolist() == records.reason.tolist() and set(records.dst_port) == {""} and wide.dst_port.isna().all()
