"""The 37 features of a session, of a whole session or of its prefix at a scoring point.

Every feature derives from mergeable integer measures (counts, sums, sums of squares,
extremes), so sessions aggregate partially before the shuffle and results do not depend
on the order of additions.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.scalars import has_flag, safe_rate
from netloom.operators.sessions import SESSION_KEY, close_reason
from netloom.schema import FEATURES, TCP_FLAG_BITS

DIMENSIONS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]


def _measures() -> dict[str, Column]:
    size, gap, payload = F.col("packet_size"), F.col("iat_us"), F.col("payload_size")
    out = {
        "n": F.count("*"),
        "end_us": F.max("t_us"),
        "bytes": F.sum(size),
        "bytes_sq": F.sum(size * size),
        "size_min": F.min(size),
        "size_max": F.max(size),
        "gaps": F.count(gap),
        "gap_sum": F.sum(gap),
        "gap_sq": F.sum(gap * gap),
        "gap_min": F.min(gap),
        "gap_max": F.max(gap),
        "header": F.sum("transport_header_length"),
        "data_packets": F.sum(F.when(payload > 0, 1).otherwise(0)),
        "payload_min": F.min(F.when(payload > 0, payload)),
    }
    for flag in TCP_FLAG_BITS:
        out[flag] = F.sum(has_flag("tcp_flags", flag).cast("int"))
    return out


def spread(n: str, total: str, squares: str) -> Column:
    """Population variance from integer moments, exact until the last division."""
    wide = "decimal(19,0)"
    num = F.col(n).cast(wide) * F.col(squares).cast(wide) - F.col(total).cast(wide) * F.col(total).cast(wide)
    return F.when(F.col(n) >= 2, num.cast("double") / (F.col(n) * F.col(n)).cast("double")).otherwise(0.0)


def mean(n: str, total: str) -> Column:
    return F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n)).otherwise(0.0)


def to_features(measured: DataFrame) -> DataFrame:
    """Replace the measures by the 37 features, as finite doubles in canonical order."""
    measured = measured.fillna(0, ["gap_sum", "gap_sq", "gap_min", "gap_max", "header", "payload_min", "window0"])
    n, secs = F.col("n"), (F.col("end_us") - F.col("start_us")).cast("double") / 1e6
    size_mean, size_var = mean("n", "bytes"), spread("n", "bytes", "bytes_sq")
    gap_std = F.sqrt(spread("gaps", "gap_sum", "gap_sq")) / 1e6
    gap = {k: F.col(f"gap_{k}") / F.lit(1e6) for k in ("min", "max", "sum")}
    gap["mean"] = mean("gaps", "gap_sum") / 1e6
    values = {
        "dst_port": F.coalesce("dst_port", F.lit(0)),
        "protocol": F.col("protocol"),
        "flow_duration": secs,
        "total_fwd_packets": n,
        "total_fwd_bytes": F.col("bytes"),
        "flow_bytes_per_sec": safe_rate("bytes", secs),
        "flow_packets_per_sec": safe_rate("n", secs),
        "packet_len_min": F.col("size_min"),
        "packet_len_max": F.col("size_max"),
        "packet_len_mean": size_mean,
        "packet_len_std": F.sqrt(size_var),
        "packet_len_variance": size_var,
        "avg_packet_size": size_mean,
        "flow_iat_min": gap["min"],
        "flow_iat_max": gap["max"],
        "flow_iat_mean": gap["mean"],
        "flow_iat_std": gap_std,
        "fwd_header_length": F.col("header"),
        "init_win_bytes_forward": F.col("window0"),
        "act_data_pkt_fwd": F.col("data_packets"),
        "min_seg_size_forward": F.col("payload_min"),
    }
    # The flow key is directed, so the forward direction is the whole session.
    for stat in ("min", "max", "mean", "std"):
        values[f"fwd_packet_len_{stat}"] = values[f"packet_len_{stat}"]
        values[f"fwd_iat_{stat}"] = values[f"flow_iat_{stat}"]
    values["fwd_iat_total"] = gap["sum"]
    values["fwd_packets_per_sec"] = values["flow_packets_per_sec"]
    for flag in TCP_FLAG_BITS:
        values[f"{flag}_flag_count"] = F.col(flag)
    keep = [c for c in measured.columns if c in ("flow_id", "start_us", "start_packet", "src_ip", "dst_ip", "src_port",
                                                 "t_us", "packet_id", "is_final", "end_us", "n", "bytes", "reason")]
    # Integer measures and guarded divisions leave nothing to sanitize.
    return measured.select(*keep, *[values[name].cast("double").alias(name) for name in FEATURES])


def session_measures(assigned: DataFrame) -> DataFrame:
    window = F.col("tcp_window_size")
    when_seen = F.when(window.isNotNull(), F.struct("t_us", "packet_id"))
    return assigned.groupBy(*SESSION_KEY, *DIMENSIONS).agg(
        *[e.alias(k) for k, e in _measures().items()], F.min_by(window, when_seen).alias("window0")
    )


def session_features(assigned: DataFrame) -> DataFrame:
    """One feature row per session."""
    return to_features(session_measures(assigned))


def summary_of_features(scored: DataFrame, cutoff) -> DataFrame:
    """Session summary taken from feature rows, so that both come from one aggregation."""
    port = F.when(F.col("src_port").isNotNull(), F.col("dst_port").cast("bigint"))
    out = scored.select(
        *SESSION_KEY,
        "src_ip",
        "dst_ip",
        "src_port",
        port.alias("dst_port"),
        F.col("protocol").cast("int").alias("protocol"),
        "end_us",
        F.col("n").alias("packet_count"),
        F.col("bytes").alias("byte_count"),
        (F.col("fin_flag_count") + F.col("rst_flag_count") > 0).alias("finished"),
        (F.col("end_us") - F.col("start_us")).alias("duration_us"),
        "label",
        "confidence",
    )
    return out.withColumn("reason", close_reason(cutoff))


def live_features(assigned: DataFrame, triggers: DataFrame) -> DataFrame:
    """One feature row per scoring point, over the session up to that packet."""
    w = Window.partitionBy(*SESSION_KEY).orderBy("t_us", "packet_id").rowsBetween(Window.unboundedPreceding, 0)
    running = assigned.select(
        *SESSION_KEY,
        *DIMENSIONS,
        "t_us",
        "packet_id",
        *[e.over(w).alias(k) for k, e in _measures().items()],
        F.first("tcp_window_size", ignorenulls=True).over(w).alias("window0"),
    )
    points = triggers.select(*SESSION_KEY, "packet_id", "is_final")
    return to_features(running.join(points, [*SESSION_KEY, "packet_id"]))


def moments_divergence(assigned: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Length statistics from mergeable moments beside the built-in two-pass ones.

    `diverging` counts those that differ by more than `tol`, relatively and absolutely.
    """
    size = F.col("packet_size")
    m = assigned.groupBy(*SESSION_KEY).agg(
        F.count("*").alias("n"),
        F.sum(size).alias("total"),
        F.sum(size * size).alias("squares"),
        F.min(size).alias("low"),
        F.max(size).alias("high"),
        F.avg(size).alias("_mean"),
        F.var_pop(size).alias("_var"),
        F.stddev_pop(size).alias("_std"),
    )
    pairs = [
        (mean("n", "total"), F.col("_mean")),
        (spread("n", "total", "squares"), F.col("_var")),
        (F.sqrt(spread("n", "total", "squares")), F.col("_std")),
    ]
    off = F.lit(0)
    for a, b in pairs:
        gap = F.abs(a - b)
        off = off + (gap > F.greatest(F.lit(tol), tol * F.greatest(F.abs(a), F.abs(b)))).cast("int")
    return m.withColumn("diverging", off).drop("_mean", "_var", "_std")
