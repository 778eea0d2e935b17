import random

from conftest import packet
from pyspark.sql import functions as F

from netloom.operators.features import live_features, moments_divergence, session_features
from netloom.operators.sessions import assign_sessions, lifecycle, predict_triggers, session_summary


def plain_sessions(rows):
    """Reference semantics row by row: packet id -> first packet of its session."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        key, t, fin = (r[3], r[4], r[5], r[7], r[8]), r[1], bool((r[9] or 0) & 5)
        s = state.get(key)
        if s is None or s["fin"] or t - s["last"] >= 30_000_000 or t - s["start"] >= 120_000_000:
            s = {"start": t, "first": r[0]}
        s.update(last=t, fin=fin)
        state[key] = s
        out[r[0]] = s["first"]
    return out


def test_assignment_matches_row_by_row(make):
    rng = random.Random(7)
    rows, t = [], 0.0
    for i in range(1500):
        t += rng.choice([0, 0.000001, 0.4, 3, 29.999999, 30, 31]) if rng.random() < 0.3 else rng.random()
        flags = rng.choice([16] * 60 + [17, 4, None])
        rows.append(packet(i, t, sport=rng.choice([1, 1, 1, 2, None]), flags=flags))
    got = {r["packet_id"]: r["start_packet"] for r in assign_sessions(make(rows)).select("packet_id", "start_packet").collect()}
    assert got == plain_sessions(rows)


def test_long_steady_flow_is_cut_at_the_age_limit(make):
    rows = [packet(i, i * 0.7) for i in range(3000)]
    got = {r["packet_id"]: r["start_packet"] for r in assign_sessions(make(rows)).select("packet_id", "start_packet").collect()}
    assert got == plain_sessions(rows)
    assert len(set(got.values())) == 18


def test_reasons(make):
    rows = [packet(0, 0), packet(1, 5, flags=17), packet(2, 6), packet(3, 40), packet(4, 100, sport=9), packet(5, 130, sport=8)]
    s = session_summary(assign_sessions(make(rows)), 130_000_000)
    got = {r["start_packet"]: r["reason"] for r in s.collect()}
    assert got == {0: "flow_end", 2: "idle_timeout", 3: "idle_timeout", 4: "idle_timeout", 5: "active"}


def test_scoring_points(make):
    times = [0, 1.1, 1.2, 1.3, 1.4, 1.5, 2.6]
    rows = [packet(i, t) for i, t in enumerate(times)] + [packet(99, 0, sport=7, flags=1)]
    a = assign_sessions(make(rows))
    got = {r["packet_id"] for r in predict_triggers(a).collect()}
    assert got == {4, 6, 99}


def test_scoring_points_match_row_by_row(make):
    rng = random.Random(3)
    rows, want = [], set()
    for flow in range(20):
        t, n, start, c, last = 0.0, 0, None, 0, None
        for _ in range(rng.choice([3, 30, 120])):
            t += rng.choice([0, 0.01, 0.2, 0.9])
            if t > 100:
                break
            i = len(rows)
            rows.append(packet(i, t, sport=flow + 1))
            n += 1
            us = round(t * 1e6)
            start = us if start is None else start
            last = start if last is None else last
            if us - start >= 1_000_000 and n >= 5 and (c == 0 or n - c >= 5 or us - last >= 1_000_000):
                want.add(i)
                c, last = n, us
    got = {r["packet_id"] for r in predict_triggers(assign_sessions(make(rows))).collect()}
    assert got == want


def test_tcp_features(make):
    rows = [
        packet(0, 100.0, size=60, flags=0x02, window=64240, header=20, payload=0),
        packet(1, 100.25, size=110, flags=0x18, window=60000, header=20, payload=50),
        packet(2, 101.0, size=90, flags=0x34, window=58000, header=24, payload=30),
    ]
    f = session_features(assign_sessions(make(rows))).first()
    want = {
        "flow_duration": 1.0, "total_fwd_bytes": 260, "flow_packets_per_sec": 3, "packet_len_min": 60, "packet_len_max": 110,
        "flow_iat_min": 0.25, "flow_iat_max": 0.75, "fwd_iat_total": 1.0, "syn_flag_count": 1, "psh_flag_count": 1,
        "ack_flag_count": 2, "rst_flag_count": 1, "urg_flag_count": 1, "fwd_header_length": 64, "init_win_bytes_forward": 64240,
        "act_data_pkt_fwd": 2, "min_seg_size_forward": 30,
    }
    assert {k: f[k] for k in want} == want
    assert abs(f["packet_len_variance"] - 3800 / 9) < 1e-9


def test_udp_and_icmp_features(make):
    rows = [
        packet(0, 1, protocol=17, sport=5353, dport=53, flags=None, window=None, header=8),
        packet(1, 1, protocol=1, sport=None, dport=None, flags=None, window=None, header=8),
    ]
    f = {r["protocol"]: r for r in session_features(assign_sessions(make(rows))).collect()}
    assert (f[17.0]["dst_port"], f[17.0]["fwd_header_length"]) == (53.0, 8.0)
    assert (f[1.0]["dst_port"], f[1.0]["flow_duration"], f[1.0]["flow_bytes_per_sec"]) == (0.0, 0.0, 0.0)


def test_live_features_of_the_last_packet_equal_the_session(make):
    rows = [packet(i, i * 0.4, size=60 + 7 * i, payload=i) for i in range(9)] + [packet(9, 4.0, flags=17)]
    a = assign_sessions(make(rows))
    live = {r["packet_id"]: r for r in live_features(a, predict_triggers(a)).collect()}
    whole = session_features(a).first()
    assert all(live[9][c] == whole[c] for c in whole.asDict() if c in live[9].asDict() and c not in ("n", "bytes"))


def test_moments_do_not_diverge(make):
    sizes = [60, 110, 90, 1500, 40, 40, 1500, 88, 512, 64]
    m = moments_divergence(assign_sessions(make([packet(i, i, size=s) for i, s in enumerate(sizes)]))).first()
    assert (m["n"], m["total"], m["low"], m["high"], m["diverging"]) == (10, sum(sizes), 40, 1500, 0)


def test_lifecycle(make):
    rows = [packet(i, i * 0.3) for i in range(6)] + [packet(6, 2.0, flags=17)]
    a = assign_sessions(make(rows))
    out = lifecycle(a, session_summary(a, 10**9), predict_triggers(a))
    got = {(r["stage"], r["packet_count"]) for r in out.collect()}
    assert got == {("started", 1), ("active", 5), ("active", 7), ("finalized", 7)}
    assert out.filter(F.col("stage") == "finalized").first()["reason"] == "flow_end"
