"""Selecting and normalizing captured packets."""

import ipaddress

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.schema import ICMP, TCP, UDP, UNKNOWN


def _addresses(values) -> list[str]:
    good = []
    for text in (str(v).strip() for v in values or ()):
        try:
            ipaddress.ip_address(text)
            good.append(text)
        except ValueError:
            continue
    return good


def _ports(values) -> list[int]:
    good = []
    for v in values or ():
        try:
            port = int(str(v).strip())
        except ValueError:
            continue
        if 0 < port <= 65535:
            good.append(port)
    return good


def _touches(ips: list[str], ports: list[int]):
    cond = F.lit(False)
    if ips:
        cond = cond | F.col("src_ip").isin(ips) | F.col("dst_ip").isin(ips)
    if ports:
        for side in ("src_port", "dst_port"):
            cond = cond | F.coalesce(F.col(side).isin(ports), F.lit(False))
    return cond


def capture_filter(df: DataFrame, watch_ips=(), watch_ports=(), exclude_ips=(), exclude_ports=()) -> DataFrame:
    """Packets that touch a watched host or port (all, when none is named) and no excluded one.

    Unreadable addresses and ports out of range are skipped.
    """
    wi, wp, xi, xp = _addresses(watch_ips), _ports(watch_ports), _addresses(exclude_ips), _ports(exclude_ports)
    if wi or wp:
        df = df.filter(_touches(wi, wp))
    if xi or xp:
        df = df.filter(~_touches(xi, xp))
    return df


def normalize_packets(headers: DataFrame) -> DataFrame:
    """Protocol and transport facts from decoded header columns.

    Needs `is_ip`, `has_tcp`, `has_udp`, `has_icmp`, `sport`, `dport`, `flags`, `window`,
    `data_offset` (32-bit words), `transport_payload`. Rows that are not IP are dropped.
    """
    tcp, udp, icmp = F.col("has_tcp"), F.col("has_udp"), F.col("has_icmp")
    words = F.when(tcp, F.coalesce(F.col("data_offset") * 4, F.lit(0)))
    made = {
        "protocol": F.when(tcp, TCP).when(udp, UDP).when(icmp, ICMP).otherwise(UNKNOWN),
        "src_port": F.when(tcp | udp, F.col("sport")),
        "dst_port": F.when(tcp | udp, F.col("dport")),
        "tcp_flags": F.when(tcp, F.col("flags")),
        "tcp_window_size": F.when(tcp, F.col("window")),
        "tcp_header_length": words,
        "transport_header_length": F.when(tcp, words).when(udp | icmp, F.lit(8)),
        "payload_size": F.when(tcp | udp | icmp, F.col("transport_payload")).otherwise(0),
    }
    used = ["is_ip", "has_tcp", "has_udp", "has_icmp", "sport", "dport", "flags", "window", "data_offset", "transport_payload"]
    return headers.filter("is_ip").withColumns(made).drop(*used)
