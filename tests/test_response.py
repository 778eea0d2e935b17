import random

from pyspark.sql import functions as F

from netloom.functions.scalars import mixed_blockable_ip, normalized_label
from netloom.operators import activity, response
from netloom.operators.alerts import dedup_key, session_alerts
from netloom.operators.dashboard import shadow_pairs

S = 1_000_000


def plain_blocks(rows):
    last = until = None
    out = {}
    for ip, t, seq, dur, unblock in sorted(rows, key=lambda r: (r[1], r[2])):
        if until is not None and t >= until:
            last = until = None
        if unblock:
            last = until = None
            out[seq] = "unblocked"
        elif last is not None and t - last < 60 * S:
            out[seq] = "cooldown_active"
        else:
            out[seq] = "already_blocked" if until is not None else "blocked"
            last, until = t, t + max(1, dur) * S
    return out


def test_block_decisions_match_row_by_row(spark):
    rng = random.Random(11)
    rows, seq, want = [], 0, {}
    for ip in ("10.0.0.1", "2001:db8::1", "10.0.0.9"):
        mine, t = [], 0
        for _ in range(400):
            t += rng.choice([1, S // 3, 7 * S, 59 * S, 61 * S, 400 * S]) if rng.random() < 0.3 else rng.randrange(1, S)
            mine.append((ip, t, seq, rng.choice([0, 1, 20, 60, 300]), rng.random() < 0.03))
            seq += 1
        want.update(plain_blocks(mine))
        rows += mine
    rows.append(("127.0.0.1", 5, seq, 300, False))
    want[seq] = "invalid_or_loopback_ip"
    df = spark.createDataFrame(rows, "ip string, t_us long, seq long, duration_s long, unblock boolean")
    got = {r["seq"]: r["status"] for r in response.block_decisions(df).collect()}
    assert got == want


def test_expiry_log_and_flagged_packets(spark, make):
    from conftest import packet

    req = spark.createDataFrame([("10.0.0.1", 0, 0, 100), ("10.0.0.1", 70 * S, 4, 100), ("10.0.0.1", 300 * S, 8, 50)], "ip string, t_us long, seq long, duration_s long")
    dec = response.block_decisions(req)
    log = [(r["at_us"] // S, r["status"], r["times_blocked"]) for r in response.block_log(dec, F.lit(320 * S)).orderBy("at_us").collect()]
    assert log == [(0, "blocked", 1), (70, "already_blocked", 1), (170, "unblocked", 1), (300, "blocked", 2)]
    rows = [packet(0, 0), packet(1, 1), packet(2, 169), packet(3, 170), packet(4, 310), packet(5, 1, src="10.0.0.3")]
    flagged = response.flag_blocked_packets(make(rows), response.block_intervals(dec))
    assert sorted(r["packet_id"] for r in flagged.collect()) == [1, 2, 4]


def test_commands(spark):
    rows = [
        ("a", "block", "10.0.0.1", 300, 1), ("a", "block", "10.0.0.1", 300, 2), ("b", "BLOCK ", "10.0.0.1", None, 3), ("c", "unblock", "10.0.0.1", 0, 4),
        ("d", "block", "10.0.0.1", 0, 5), ("e", "reboot", "10.0.0.1", 1, 6), ("", "watchlist", "10.0.0.2", 1, 7), ("", "watchlist", "10.0.0.2", 1, 8),
        ("f", "unwatchlist", "10.0.0.2", 1, 9), ("g", "unwatchlist", "10.0.0.2", 1, 10), ("h", "block", "127.0.0.1", 1, 11), ("i", "", "10.0.0.1", 1, 12),
    ]
    df = spark.createDataFrame([(*r[:4], r[4] * S, r[4]) for r in rows], "command_id string, action string, ip_address string, duration_seconds long, t_us long, seq long")
    out = response.command_status(df)
    got = {r["seq"]: r["status"] for r in out.collect()}
    assert got == {1: "blocked", 2: "duplicate_command", 3: "cooldown_active", 4: "unblocked", 5: "blocked", 6: "unsupported_action", 7: "watchlisted",
                   8: "watchlisted", 9: "unwatchlisted", 10: "not_watchlisted", 11: "invalid_or_loopback_ip", 12: "invalid_command"}
    ids = {r["event_id"] for r in response.command_block_events(out).collect()}
    assert ids == {"cmd-a", "cmd-c", "cmd-d", "cmd-f", "cmd-10.0.0.2-watchlist"}


def test_refused_commands_may_come_again(spark):
    """Only ids that succeeded are remembered; a known id is a duplicate whatever it asks for."""
    rows = [
        ("z", "block", "10.0.0.1", 300, 0), ("a", "block", "10.0.0.1", 300, 30), ("a", "block", "10.0.0.1", 300, 90), ("a", "block", "10.0.0.1", 300, 200), ("a", "reboot", "10.0.0.1", 1, 201), ("a", "", "10.0.0.1", 1, 202),
        ("b", "block", "10.0.0.1", 300, 140), ("b", "unblock", "10.0.0.1", 1, 141), ("b", "block", "10.0.0.1", 300, 160), ("c", "block", "10.0.0.1", 300, 150),
    ]
    df = spark.createDataFrame([(*r[:4], r[4] * S, r[4]) for r in rows], "command_id string, action string, ip_address string, duration_seconds long, t_us long, seq long")
    got = {r["seq"]: r["status"] for r in response.command_status(df).collect()}
    assert got == {0: "blocked", 30: "cooldown_active", 90: "already_blocked", 140: "cooldown_active", 141: "unblocked", 150: "blocked", 160: "duplicate_command", 200: "duplicate_command", 201: "duplicate_command", 202: "invalid_command"}


def test_commands_and_detectors_share_one_block_state(spark):
    """A detector's block refuses a command for the cooldown, a command's block refuses a detector, a release frees both."""
    commands = spark.createDataFrame(
        [("a", "block", "10.0.0.1", 300, 30 * S, 1), ("a", "block", "10.0.0.1", 300, 100 * S, 2), ("b", "unblock", "10.0.0.1", 1, 130 * S, 3),
         ("b", "block", "10.0.0.1", 300, 131 * S, 4), ("w", "watchlist", "10.0.0.1", 1, 10 * S, 5), ("x", "unwatchlist", "10.0.0.1", 1, 20 * S, 6)],
        "command_id string, action string, ip_address string, duration_seconds long, t_us long, seq long",
    )
    columns = "ip string, t_us long, seq long, kind string, duration_s long, attack_type string"
    requests = spark.createDataFrame([("10.0.0.1", t * S, 4 * t, "heuristic", 300, "x") for t in (0, 120, 130, 150)], columns)
    statuses, decided = response.settle(commands, requests)
    got = {r["seq"]: r["status"] for r in statuses.collect()}
    assert got == {1: "cooldown_active", 2: "already_blocked", 3: "unblocked", 4: "duplicate_command", 5: "watchlisted", 6: "unwatchlisted"}
    auto = {r["t_us"] // S: r["status"] for r in decided.filter("kind = 'heuristic'").collect()}
    assert auto == {0: "blocked", 120: "cooldown_active", 130: "blocked", 150: "cooldown_active"}
    spans = response.watch_intervals(statuses, F.lit(200 * S)).collect()
    assert [(r["from_us"] // S, r["next_us"] // S) for r in spans] == [(10, 20)]
    log = response.block_log(decided, F.lit(200 * S))
    assert [r["at_us"] // S for r in log.filter("manual").collect()] == [130]


def test_session_alerts_drop_repeats(spark):
    rows = [(1, "DoS", 0.9, True, False), (2, "DoS", 0.90001, True, False), (3, "DoS", 0.9, False, False), (4, "DoS", 0.9, False, True), (5, "DoS", 0.9, False, True), (6, "DoS", 0.9, False, False)]
    df = spark.createDataFrame(
        [("10.0.0.1", 1, "10.0.0.2", 80, 6, i * 4000 * S, i, *r) for i, *r in rows],
        "src_ip string, src_port long, dst_ip string, dst_port long, protocol int, t_us long, seq long, attack_type string, confidence double, blocked boolean, is_final boolean",
    )
    got = [(r["seq"], r["update_type"]) for r in session_alerts(df).orderBy("seq").collect()]
    assert got == [(1, "new"), (3, "updated"), (4, "final"), (5, "final"), (6, "new")]


def test_activity_history(spark):
    feed = spark.createDataFrame([("a", i, i, f"t{i % 3}", "allowed") for i in range(60)] + [("b", 5, 0, "x", "blocked")], "ip string, t_us long, tie long, attack_type string, action string")
    got = {r["ip"]: r for r in activity.ip_activity(feed).collect()}
    assert [e["t_us"] for e in got["a"]["action_history"]] == list(range(35, 60))
    assert got["a"]["attack_types_used"] == ["t0", "t1", "t2"] and got["a"]["attempt_pattern"] == "repeated_attempts"
    assert got["b"]["attempt_pattern"] == "single_attempt" and got["b"]["total_attack_attempts"] == 1
    assert [r["ip"] for r in activity.latest_tracked(activity.ip_activity(feed), 1).collect()] == ["a"]


def test_dedup_key_ignores_case(spark):
    df = spark.createDataFrame([("Session-1", "Sensor-A", "DDoS", "Block"), ("session-1", "sensor-a", "ddos", "block")], "session_id string, source string, attack_type string, action string")
    keys = {r[0] for r in df.select(dedup_key()).collect()}
    assert len(keys) == 1 and len(keys.pop()) == len("alert:v1:") + 32


def test_shadow_pairs_take_the_nearest(spark):
    schema = "session_id string, ts_us long, prediction string"
    p = spark.createDataFrame([("s", 100, "A"), ("s", 60_000_000, "B"), ("t", 5, "A")], schema)
    s = spark.createDataFrame([("s", 90, "A"), ("s", 105, "B"), ("s", 59_999_995, "B"), ("t", 500, "A")], schema)
    got = {r["session_id"]: (r["pairs"], r["agreeing"]) for r in shadow_pairs(p, s, 20).collect()}
    assert got == {"s": (2, 1)}


def test_respond_defaults(spark):
    table = spark.createDataFrame([("a", "alert", "open"), ("b", "alert", "open")], "threat_id string, action_taken string, status string")
    upd = spark.createDataFrame([("a", "blocked", "closed", 1), ("a", "watched", None, 2)], "threat_id string, new_action string, new_state string, at_us long")
    got = {r["threat_id"]: (r["action_taken"], r["status"]) for r in response.respond(table, upd, "threat_id", "action_taken", "status", "open").collect()}
    assert got == {"a": ("watched", "open"), "b": ("alert", "open")}


def test_addresses_and_labels(spark):
    ips = {"10.0.0.1": True, "127.0.0.9": False, "::1": False, "2001:db8::1": True, "01.2.3.4": False, "256.1.1.1": False, "": False, "x": False}
    df = spark.createDataFrame([(k,) for k in ips], "ip string")
    assert {r[0]: r[1] for r in df.select("ip", mixed_blockable_ip("ip")).collect()} == ips
    labels = {
        "Benign": "Normal Traffic", "DDOS attack-HOIC": "DDoS", "DoS attacks-SlowHTTPTest": "DoS", "Brute Force -XSS": "Brute Force", "Bot": "Bots",
        "SQL Injection": "Web Attacks", "Infilteration": "Infiltration", "Heartbleed": "Heartbleed", " other ": "other", "XSS": "Web Attacks",
        "DDoS attacks-LOIC-HTTP": "DDoS", "SSH-Bruteforce": "Brute Force",
    }
    df = spark.createDataFrame([(k,) for k in labels], "l string")
    assert {r[0]: r[1] for r in df.select("l", normalized_label("l")).collect()} == labels


def test_running_activity_equals_a_walk(spark):
    rnd = random.Random(5)
    rows = [("a" if rnd.random() < 0.7 else rnd.choice("bc"), rnd.randrange(30) * 20_000_000, rnd.randrange(3), rnd.choice("xyz"), "allowed") for _ in range(150)]
    rows += rows[:5] + [(None, 1, 1, "x", "allowed"), ("", 1, 1, "x", "allowed")]
    feed = spark.createDataFrame(rows, "ip string, t_us long, tie long, attack_type string, action string")
    want = []
    for ip in "abc":
        mine = sorted(r[1:] for r in rows if r[0] == ip)
        for n in range(1, len(mine) + 1):
            kinds = sorted({r[2] for r in mine[:n]})
            want.append((ip, mine[0][0], mine[n - 1][0], n, kinds, "repeated_attempts" if n > 1 else "single_attempt", [(r[0], r[3], r[2]) for r in mine[max(0, n - 4) : n]]))
    got = [(*r[:6], [tuple(e) for e in r[6]]) for r in activity.running_activity(feed, history=4).collect()]
    assert sorted(got) == sorted(want)
    assert activity.running_activity(feed.limit(0)).count() == 0


def plain_settle(rows, requests):
    """All commands and requests of all addresses, one by one."""
    done, blocks, listed, out = set(), {}, set(), {}
    for t, _, seq, kind, ident, action, ip in sorted([(t, 0, s, "c", i, a, ip) for i, a, ip, _, t, s in rows] + [(t, 1, s, "r", "", "block", ip) for ip, t, s in requests]):
        last, until = blocks.get(ip, (None, None))
        if until is not None and t >= until:
            last = until = None
        if kind == "c" and ident in done:
            status = "duplicate_command"
        elif action == "unblock":
            status, last, until = "unblocked", None, None
        elif action == "watchlist":
            status = "watchlisted"
            listed.add(ip)
        elif action == "unwatchlist":
            status = "unwatchlisted" if ip in listed else "not_watchlisted"
            listed.discard(ip)
        elif last is not None and t - last < 60 * S:
            status = "cooldown_active"
        else:
            status, last, until = "already_blocked" if until is not None else "blocked", t, t + 300 * S
        blocks[ip] = (last, until)
        if kind == "c" and status not in ("cooldown_active", "not_watchlisted"):
            done.add(ident)
        out[kind, seq] = status
    return out


def test_settled_parts_equal_a_walk(spark):
    """Walked parts, and parts taken as long ones; ids repeat over addresses, and some commands share their moment with a release."""
    rnd = random.Random(7)
    actions = ["block"] * 5 + ["unblock", "watchlist", "unwatchlist", "unwatchlist"]
    rows, t = [], 0
    for seq in range(240):
        t += 0 if rnd.random() < 0.2 else rnd.randrange(1, 25) * S
        rows.append((f"i{rnd.randrange(140)}", rnd.choice(actions), f"10.0.0.{rnd.randrange(3)}", 300, t, seq))
    requests = [(f"10.0.0.{rnd.randrange(3)}", rnd.randrange(0, t), k) for k in range(80)]
    rows += [(f"x{k}", a, "10.0.0.1", 300, t + 1000 * S, 240 + k) for k, a in enumerate(["block", "unblock", "block"])]
    want = plain_settle(rows, requests)
    commands = spark.createDataFrame(rows, "command_id string, action string, ip_address string, duration_seconds long, t_us long, seq long")
    asked = spark.createDataFrame([(*r, "heuristic", 300) for r in requests], "ip string, t_us long, seq long, kind string, duration_s long")
    for long_rows in (1_000_000, 0):
        statuses, decided = response.settle(commands, asked, long_rows=long_rows)
        got = {("c", r.seq): r.status for r in statuses.collect()} | {("r", r.seq): r.status for r in decided.filter("kind = 'heuristic'").collect()}
        assert got == want


def test_repeats_within_a_chunk_need_no_round(spark, monkeypatch):
    """Ids that come again at their address within a chunk are settled by the first fold; short chunks and mixed parts give the same."""
    rnd = random.Random(8)
    rows, t = [("u", "unblock", "10.0.0.1", 300, 0, 1000), ("w", "watchlist", "10.0.0.1", 300, 0, 1001)], 0
    for seq in range(120):
        t += rnd.randrange(1, 12) * S
        rows.append((f"i{seq // 3}", rnd.choice(["block", "block", "unblock", "watchlist", "unwatchlist"]), "10.0.0.1", 300, t, seq))
    want = {k[1]: v for k, v in plain_settle(rows, []).items()}
    commands = spark.createDataFrame(rows, "command_id string, action string, ip_address string, duration_seconds long, t_us long, seq long")
    names, kept = [], response.stored
    monkeypatch.setattr(response, "stored", lambda df, name: names.append(name) or kept(df, name))
    got = {r["seq"]: r["status"] for r in response.settle(commands, chunk_s=1e6)[0].collect()}
    assert got == want and sum(n.startswith("outcomes") for n in names) == 1
    for options in ({"chunk_s": 20}, {"chunk_s": 1e6, "long_rows": 3}):
        assert {r["seq"]: r["status"] for r in response.settle(commands, **options)[0].collect()} == want
