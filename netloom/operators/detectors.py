"""Packet-level heuristics and password-guessing detection.

"At least n rows in the trailing window" holds exactly when the (n-1)-th row before is
inside the window, so a `lag` replaces a range frame: constant work per row under any
flood, and earlier arrivals only are counted when times tie. Distinct ports are counted
as a running sum of ports becoming fresh (+1) and stale (-1).
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import syn_only
from netloom.plans.slices import with_lookback
from netloom.schema import LOGIN_PORTS, SECOND, SENSITIVE_PORTS


def _reached(order_time: str, window, n: int, width_us: int):
    """True when the trailing window holds at least n rows of the partition."""
    if n <= 1:
        return F.lit(True)
    return F.coalesce(F.lag(order_time, n - 1).over(window) >= F.col(order_time) - width_us, F.lit(False))


def burst(df: DataFrame, window_s: float = 2, n: int = 40, slice_s: float = 10) -> DataFrame:
    """Flag `scan_burst`: at least n packets of the source in the trailing window."""
    width = int(window_s * SECOND)
    rows = with_lookback(df, int(slice_s * SECOND), width)
    w = Window.partitionBy("src_ip", "_slice").orderBy("t_us", "packet_id")
    flagged = rows.withColumn("scan_burst", _reached("t_us", w, n, width))
    return flagged.filter(~F.col("_halo")).drop("_slice", "_halo")


def _syn_flag(rows: DataFrame, n: int, width: int) -> DataFrame:
    """`syn_only_surge` inside (src_ip, _slice), also on packets that are not SYN-only."""
    alike = Window.partitionBy("src_ip", "_slice", "_syn").orderBy("t_us", "packet_id")
    so_far = (
        Window.partitionBy("src_ip", "_slice").orderBy("t_us", "packet_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    nth = F.when(F.col("_syn"), F.lag("t_us", n - 1).over(alike)) if n > 1 else F.when(F.col("_syn"), F.col("t_us"))
    return (
        rows.withColumn("_nth", nth)
        .withColumn("_nth", F.last("_nth", ignorenulls=True).over(so_far))
        .withColumn("syn_only_surge", F.coalesce(F.col("_nth") >= F.col("t_us") - width, F.lit(False)))
        .drop("_nth")
    )


def syn_surge(df: DataFrame, window_s: float = 3, n: int = 20, slice_s: float = 10) -> DataFrame:
    """Flag `syn_only_surge`: at least n SYN-without-ACK packets of the source."""
    width = int(window_s * SECOND)
    rows = with_lookback(df.withColumn("_syn", syn_only("tcp_flags")), int(slice_s * SECOND), width)
    return _syn_flag(rows, n, width).filter(~F.col("_halo")).drop("_slice", "_halo", "_syn")


def _sweep_flag(rows: DataFrame, n: int, width: int) -> DataFrame:
    """`port_sweep` inside (src_ip, _slice): running count of ports seen within the window."""
    same_port = Window.partitionBy("src_ip", "_slice", "dst_port").orderBy("t_us", "packet_id")
    has_port = F.col("dst_port").isNotNull()
    t = F.col("t_us")
    fresh = has_port & F.coalesce(t - F.lag(t).over(same_port) > width, F.lit(True))
    goes_stale = has_port & F.coalesce(F.lead(t).over(same_port) - t > width, F.lit(True))
    steps = rows.withColumn("_fresh", fresh).withColumn("_stale", goes_stale)

    def step(at, rank, delta):
        return F.struct(at.alias("at"), F.lit(rank).alias("rank"), delta.alias("delta"))

    here = step(t, 0, F.col("_fresh").cast("int"))
    gone = step(t + width, 1, F.lit(-1))
    both = F.when(F.col("_stale"), F.array(here, gone)).otherwise(F.array(here))
    running = (
        Window.partitionBy("src_ip", "_slice")
        .orderBy("_step.at", "_step.rank", "packet_id")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        steps.withColumn("_step", F.explode(both))
        .withColumn("_ports", F.sum("_step.delta").over(running))
        .filter(F.col("_step.rank") == 0)
        .withColumn("port_sweep", F.col("_ports") >= n)
        .drop("_step", "_ports", "_fresh", "_stale")
    )


def port_sweep(df: DataFrame, window_s: float = 5, n: int = 15, slice_s: float = 10) -> DataFrame:
    """Flag `port_sweep`: at least n distinct destination ports of the source."""
    width = int(window_s * SECOND)
    rows = with_lookback(df, int(slice_s * SECOND), width)
    return _sweep_flag(rows, n, width).filter(~F.col("_halo")).drop("_slice", "_halo")


def stateless_checks(df: DataFrame) -> DataFrame:
    """Flags that need only the packet itself."""
    return df.withColumns(
        {
            "no_transport_ports": F.col("src_port").isNull() & F.col("dst_port").isNull(),
            "invalid_packet_size": F.col("packet_size") <= 0,
            "tiny_packet": F.col("packet_size") < 40,
            "sensitive_service_probe": F.coalesce(F.col("dst_port").isin(SENSITIVE_PORTS), F.lit(False)),
        }
    )


# Points of each finding, in the order in which reasons are listed.
POINTS = {
    "no_transport_ports": 2,
    "invalid_packet_size": 3,
    "tiny_packet": 1,
    "sensitive_service_probe": 1,
    "scan_burst": 3,
    "port_sweep": 3,
    "syn_only_surge": 4,
}


def scored(df: DataFrame, findings: list[str], suspicious_from: int = 2) -> DataFrame:
    """`score`, `reason` and `suspicious` from boolean finding columns."""
    total = F.lit(0)
    for name in findings:
        total = total + F.when(F.col(name), POINTS[name]).otherwise(0)
    reason = F.concat_ws(",", *[F.when(F.col(name), name) for name in findings])
    return (
        df.withColumn("score", total)
        .withColumn("reason", F.when(reason == "", "clean").otherwise(reason))
        .withColumn("suspicious", F.col("score") >= suspicious_from)
    )


def stateless_decisions(df: DataFrame) -> DataFrame:
    names = list(POINTS)[:4]
    return scored(stateless_checks(df), names)


def heuristic_decisions(
    df: DataFrame,
    burst_s: float = 2,
    burst_n: int = 40,
    sweep_s: float = 5,
    sweep_n: int = 15,
    syn_s: float = 3,
    syn_n: int = 20,
    slice_s: float = 10,
) -> DataFrame:
    """All findings of every packet. The three windows share one exchange by (source, slice)."""
    burst_us, sweep_us, syn_us = (int(s * SECOND) for s in (burst_s, sweep_s, syn_s))
    rows = with_lookback(
        df.withColumn("_syn", syn_only("tcp_flags")), int(slice_s * SECOND), max(burst_us, sweep_us, syn_us)
    )
    w = Window.partitionBy("src_ip", "_slice").orderBy("t_us", "packet_id")
    rows = rows.withColumn("scan_burst", _reached("t_us", w, burst_n, burst_us))
    rows = _syn_flag(rows, syn_n, syn_us)
    rows = _sweep_flag(rows, sweep_n, sweep_us)
    rows = rows.filter(~F.col("_halo")).drop("_slice", "_halo", "_syn")
    return scored(stateless_checks(rows), list(POINTS))


def heuristic_action(score="score", high_from: int = 3):
    return F.when(F.col(score) >= high_from, "high_temp_block").otherwise("alert_only")


def bruteforce(
    df: DataFrame, window_s: float = 90, n: int = 25, ports: list[int] = LOGIN_PORTS, slice_s: float = 180
) -> DataFrame:
    """Packets to a login port that are at least the n-th try on one service within the window."""
    width = int(window_s * SECOND)
    tries = with_lookback(df.filter(F.col("dst_port").isin(ports)), int(slice_s * SECOND), width)
    w = Window.partitionBy("src_ip", "dst_ip", "dst_port", "_slice").orderBy("t_us", "packet_id")
    return (
        tries.withColumn("bruteforce", _reached("t_us", w, n, width))
        .filter(~F.col("_halo"))
        .drop("_slice", "_halo")
    )


def tracked_sources(df: DataFrame, keep: int = 10_000) -> DataFrame:
    """The most recently seen sources."""
    return (
        df.groupBy("src_ip")
        .agg(F.max("t_us").alias("last_seen_us"))
        .orderBy(F.desc("last_seen_us"), "src_ip")
        .limit(keep)
    )
