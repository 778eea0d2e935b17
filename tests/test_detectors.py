import random

from conftest import packet

from netloom.operators.capture import capture_filter, normalize_packets
from netloom.operators.detectors import bruteforce, burst, heuristic_decisions, tracked_sources


def plain(rows, src, upto, width_s):
    """Packets of the source in the trailing window that had arrived by row `upto`."""
    me = rows[upto]
    return [r for r in rows if r[3] == src and me[1] - width_s * 1_000_000 <= r[1] <= me[1] and (r[1], r[0]) <= (me[1], me[0])]


def test_windows_match_counting(make):
    rng = random.Random(5)
    rows, t = [], 0.0
    for i in range(1200):
        t += rng.choice([0, 0.01, 0.05, 0.2, 2.0] if rng.random() < 0.2 else [0, 0.02])
        rows.append(
            packet(i, t, src=rng.choice(["10.0.0.1"] * 4 + ["10.0.0.2"]), dport=rng.choice([None, *range(1, 40)]), flags=rng.choice([2, 16, 18, None]))
        )
    got = {r["packet_id"]: r for r in heuristic_decisions(make(rows)).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        syn = sum(1 for o in plain(rows, r[3], i, 3) if (o[9] or 0) & 2 and not (o[9] or 0) & 16)
        want = (
            len(plain(rows, r[3], i, 2)) >= 40,
            len({o[8] for o in plain(rows, r[3], i, 5) if o[8] is not None}) >= 15,
            syn >= 20,
        )
        assert (got[i]["scan_burst"], got[i]["port_sweep"], got[i]["syn_only_surge"]) == want, i


def test_burst_boundary_is_inclusive(make):
    rows = [packet(i, 0.0) for i in range(39)] + [packet(39, 2.0), packet(40, 2.000001)]
    got = {r["packet_id"]: r["scan_burst"] for r in burst(make(rows)).collect()}
    assert got[39] and not got[40]


def test_reasons_and_scores(make):
    rows = [packet(0, 0, size=0, dport=22), packet(1, 1, sport=None, dport=None, size=39), packet(2, 2, dport=8080)]
    got = {r["packet_id"]: (r["score"], r["reason"], r["suspicious"]) for r in heuristic_decisions(make(rows)).collect()}
    assert got[0] == (5, "invalid_packet_size,tiny_packet,sensitive_service_probe", True)
    assert got[1] == (3, "no_transport_ports,tiny_packet", True)
    assert got[2] == (0, "clean", False)


def test_bruteforce_counts_per_service(make):
    rows = [packet(i, i * 3.75, dport=22) for i in range(26)] + [packet(100 + i, i, dport=80) for i in range(30)]
    got = {r["packet_id"]: r["bruteforce"] for r in bruteforce(make(rows)).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [24, 25]
    assert 100 not in got


def test_tracked_sources_keeps_the_latest(make):
    rows = [packet(i, i, src=f"10.0.0.{i}") for i in range(1, 6)]
    assert [r["src_ip"] for r in tracked_sources(make(rows), 2).collect()] == ["10.0.0.5", "10.0.0.4"]


def test_capture_filter(make):
    rows = [packet(0, 0, src="10.0.0.5"), packet(1, 0, dport=443), packet(2, 0, sport=None, dport=None), packet(3, 0, dst="10.0.0.5", dport=22)]
    df = make(rows)

    def ids(**kw):
        return sorted(r["packet_id"] for r in capture_filter(df, **kw).collect())

    assert ids() == [0, 1, 2, 3]
    assert ids(watch_ips=[" 10.0.0.5 ", "nonsense"], watch_ports=["443", "0", "70000"]) == [0, 1, 3]
    assert ids(watch_ips=["10.0.0.5"], exclude_ports=[22]) == [0]
    assert ids(exclude_ips=["10.0.0.5"], exclude_ports=["443"]) == [2]


def test_normalize(spark):
    cols = "packet_id int, is_ip boolean, has_tcp boolean, has_udp boolean, has_icmp boolean, sport int, dport int, flags int, window int, data_offset int, transport_payload int"
    df = spark.createDataFrame(
        [
            (0, True, True, False, False, 1, 2, 2, 9, 6, 5),
            (1, True, False, True, False, 1, 53, None, None, None, 7),
            (2, True, False, False, False, None, None, None, None, None, 7),
            (3, False, True, False, False, 1, 2, 2, 9, 5, 5),
            (4, True, True, False, False, 1, 2, 2, 9, None, 5),
        ],
        cols,
    )
    got = {r["packet_id"]: (r["protocol"], r["dst_port"], r["tcp_header_length"], r["transport_header_length"], r["payload_size"]) for r in normalize_packets(df).collect()}
    assert got == {0: (6, 2, 24, 24, 5), 1: (17, 53, None, 8, 7), 2: (0, None, None, None, 0), 4: (6, 2, 0, 0, 5)}
