"""Engine telemetry: counters at regular snapshots."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.schema import SECOND

#: Snapshots in one block of running totals.
BLOCK = 4096


def _snapshot_of(t: str, every_us: int) -> Column:
    """The first snapshot at or after t: intervals are open at the start, closed at the end."""
    return F.ceil(F.col(t) / F.lit(every_us)).cast("bigint")


def telemetry(
    received: DataFrame,
    dropped: DataFrame,
    predictions: DataFrame,
    shadow: DataFrame,
    every_s: float = 30,
    window_s: float = 30,
) -> DataFrame:
    """Totals and trailing-window counts at every snapshot. Inputs need `t_us` only.

    The window is half open: an event exactly `window_s` old is out. Counts are reduced to one row per snapshot
    interval before any ordering. Running totals add up inside blocks of snapshots, on top of the totals of the blocks
    before, so only one row for each block is ever ordered in one task.
    """
    every = int(every_s * SECOND)
    steps = int(window_s * SECOND) // every
    if steps * every != int(window_s * SECOND):
        raise ValueError("the window must be a multiple of the snapshot interval")
    names = ["received", "dropped", "predictions", "shadow"]
    parts = [
        df.select(_snapshot_of("t_us", every).alias("snap"), *[F.lit(int(n == m)).alias(m) for m in names])
        for n, df in zip(names, [received, dropped, predictions, shadow], strict=True)
    ]
    counts = reduce(DataFrame.unionByName, parts).groupBy("snap").agg(*[F.sum(m).alias(m) for m in names])
    recent = counts.select(F.explode(F.sequence("snap", F.col("snap") + (steps - 1))).alias("snap"), *names).groupBy("snap").agg(*[F.sum(m).alias(f"{m}_per_window") for m in names])
    ends = counts.agg(F.min("snap").alias("a"), F.max("snap").alias("b"))
    block = F.floor(F.col("snap") / F.lit(BLOCK)).cast("bigint")
    blocks = ends.select("a", "b", F.explode(F.sequence(F.floor(F.col("a") / F.lit(BLOCK)), F.floor(F.col("b") / F.lit(BLOCK)))).alias("block"))
    sums = counts.groupBy(block.alias("block")).agg(*[F.sum(m).alias(m) for m in names])
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.join(sums, "block", "left").select("block", "a", "b", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_before") for m in names])
    first, last = F.greatest("a", F.col("block") * BLOCK), F.least("b", F.col("block") * BLOCK + (BLOCK - 1))
    grid = before.repartition("block").withColumn("snap", F.explode(F.sequence(first, last)))
    rows = grid.join(counts, "snap", "left").join(recent, "snap", "left").fillna(0, [*names, *[f"{m}_per_window" for m in names]])
    so_far = Window.partitionBy("block").orderBy("snap").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select(
        (F.col("snap") * every).alias("snapshot_us"),
        *[(F.col(f"{m}_before") + F.sum(m).over(so_far)).alias(f"{m}_total") for m in names],
        *[f"{m}_per_window" for m in names],
    )
    return out.withColumn("packet_loss_detected", F.col("dropped_per_window") > 0)


def queue_usage(size, maxsize) -> Column:
    """Fill of a queue in percent, 4 digits; 0 for an unbounded queue."""
    size, maxsize = (F.col(c) if isinstance(c, str) else c for c in (size, maxsize))
    return F.when(maxsize > 0, F.round(size.cast("double") / maxsize * 100, 4)).otherwise(0.0)


def active_at_snapshots(summary: DataFrame, every_s: float = 30, idle_s: float = 30, max_s: float = 120) -> DataFrame:
    """(snapshot, session) pairs: sessions open at each snapshot.

    A session stays open until it finishes or its first deadline, hence at most a few
    snapshots each.
    """
    every = int(every_s * SECOND)
    deadline = F.least(F.col("end_us") + int(idle_s * SECOND), F.col("start_us") + int(max_s * SECOND))
    close = F.when(F.col("finished"), F.col("end_us")).otherwise(deadline)
    first = F.ceil(F.col("start_us") / F.lit(every)).cast("bigint")
    last = F.ceil(close / F.lit(every)).cast("bigint") - 1
    return summary.filter(first <= last).withColumn("snap", F.explode(F.sequence(first, last)))


def exchanges(summary: DataFrame, every_s: float = 30, top: int = 20, **limits) -> DataFrame:
    """Open sessions per snapshot and the first `top` of them as endpoint pairs."""
    open_now = active_at_snapshots(summary, every_s, **limits)
    counts = open_now.groupBy("snap").agg(F.count("*").alias("active_sessions"))
    order = Window.partitionBy("snap").orderBy("start_us", "start_packet")
    pair = F.struct(
        F.col("_rank").alias("rank"),
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"),
        F.col("dst_port").alias("destination_port"),
        "protocol",
        "packet_count",
        "byte_count",
        "duration_us",
    )
    listed = (
        open_now.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= top)
        .groupBy("snap")
        .agg(F.sort_array(F.collect_list(pair)).alias("active_network_exchanges"))
    )
    return counts.join(listed, "snap").withColumn("snapshot_us", F.col("snap") * int(every_s * SECOND)).drop("snap")


def engines_seen(telemetry_rows: DataFrame, now, heartbeat_s: float = 30, t: str = "t_us") -> DataFrame:
    """Last telemetry of each engine and whether it is within the heartbeat interval."""
    seen = telemetry_rows.groupBy("engine_id").agg(F.max(t).alias("last_seen_us"))
    return seen.withColumn("online", now - F.col("last_seen_us") <= int(heartbeat_s * SECOND))


def latest(snapshots: DataFrame, t: str = "snapshot_us") -> DataFrame:
    return snapshots.orderBy(F.desc(t)).limit(1)
