"""Sessions: runs of packets of one directed 5-tuple.

A session ends after an idle gap, after FIN or RST, or at the maximal age. Gaps and
flags are found inside time slices of each flow and stitched through a table with one
row per (flow, slice), so a flow of any size spreads over tasks. The age limit moves
the start of each following session; `greedy_chain` resolves it for the rows of runs
that outlive the limit.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.scalars import ends_flow, session_id
from netloom.plans.greedy_chain import greedy_chain
from netloom.plans.slices import slice_of
from netloom.schema import SECOND

SESSION_KEY = ["flow_id", "start_us", "start_packet"]


def _position(t="t_us", i="packet_id"):
    return F.struct(F.col(t).alias("t"), F.col(i).alias("i"))


def assign_sessions(df: DataFrame, idle_s: float = 30, max_s: float = 120, slice_s: float = 60) -> DataFrame:
    """Add `flow_id`, `start_us` and `start_packet` (first packet of the session), `iat_us`.

    `iat_us` is the time since the previous packet of the session, null for its first.
    """
    idle, limit, width = (int(s * SECOND) for s in (idle_s, max_s, slice_s))
    if width < idle:
        raise ValueError("slices must be at least as wide as the idle gap")
    flow = df.withColumns(
        {"flow_id": session_id(), "_slice": slice_of("t_us", width), "_fin": ends_flow("tcp_flags"), "_pos": _position()}
    )
    inside = Window.partitionBy("flow_id", "_slice").orderBy("t_us", "packet_id")
    rows = flow.withColumn("_prev", F.lag("t_us").over(inside)).withColumn(
        "_cut", F.coalesce(F.lag("_fin").over(inside) | (F.col("t_us") - F.col("_prev") >= idle), F.lit(False))
    )

    # One row per (flow, slice): where the run that is open at its start began.
    by_slice = Window.partitionBy("flow_id").orderBy("_slice")
    last = F.max(F.struct(F.col("t_us").alias("t"), F.col("packet_id").alias("i"), F.col("_fin").alias("fin")))
    stitched = (
        rows.groupBy("flow_id", "_slice")
        .agg(F.min("_pos").alias("_head"), last.alias("_tail"), F.max(F.when(F.col("_cut"), F.col("_pos"))).alias("_inner"))
        .withColumn("_before", F.lag("_tail").over(by_slice))
        .withColumn(
            "_fresh",
            F.coalesce(F.col("_before.fin") | (F.col("_head.t") - F.col("_before.t") >= idle), F.lit(True)),
        )
        .withColumn("_own", F.coalesce("_inner", F.when(F.col("_fresh"), F.col("_head"))))
        .withColumn(
            "_open",
            F.when(F.col("_fresh"), F.col("_head")).otherwise(
                F.last("_own", ignorenulls=True).over(by_slice.rowsBetween(Window.unboundedPreceding, -1))
            ),
        )
        .select("flow_id", "_slice", "_open", F.col("_before.t").alias("_before_t"))
    )
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        rows.withColumn("_inner_start", F.max(F.when(F.col("_cut"), F.col("_pos"))).over(so_far))
        .join(stitched, ["flow_id", "_slice"])
        .withColumn("_run", F.coalesce("_inner_start", "_open"))
        .withColumn("_prev", F.coalesce("_prev", "_before_t"))
        .drop("_inner_start", "_open", "_before_t", "_cut", "_fin")
    )

    # Rows beyond the age limit of their run: find the restarts among them.
    over = runs.filter(F.col("t_us") - F.col("_run.t") >= limit).select(
        "flow_id",
        F.col("_run.t").alias("_run_t"),
        F.col("_run.i").alias("_run_i"),
        "t_us",
        "packet_id",
        (F.col("t_us") + limit).alias("resume_us"),
    )
    restarts = greedy_chain(over, ["flow_id", "_run_t", "_run_i"], limit)
    # A restart matters in its own slice and in those its session can still reach.
    reach = -(-limit // width) + 1
    near = (
        restarts.select("flow_id", _position().alias("_restart"))
        .withColumn("_home", slice_of(F.col("_restart.t"), width))
        .withColumn("_slice", F.explode(F.sequence(F.col("_home"), F.col("_home") + (reach - 1))))
        .groupBy("flow_id", "_slice")
        .agg(F.min("_restart").alias("_r1"), F.max("_restart").alias("_r2"))
    )
    pos = F.col("_pos")
    start = F.greatest(
        "_run", F.when(F.col("_r1") <= pos, F.col("_r1")), F.when(F.col("_r2") <= pos, F.col("_r2"))
    )
    return (
        runs.join(near, ["flow_id", "_slice"], "left")
        .withColumn("_start", start)
        .withColumns(
            {
                "start_us": F.col("_start.t"),
                "start_packet": F.col("_start.i"),
                "iat_us": F.when(F.col("_start") < pos, F.col("t_us") - F.col("_prev")),
            }
        )
        .drop("_slice", "_pos", "_prev", "_run", "_r1", "_r2", "_start")
    )


def close_reason(cutoff, idle_s: float = 30, max_s: float = 120):
    """Why a session closed, from its own deadlines; `active` when they lie after the cutoff."""
    idle_at = F.col("end_us") + int(idle_s * SECOND)
    old_at = F.col("start_us") + int(max_s * SECOND)
    return (
        F.when(F.col("finished"), "flow_end")
        .when(F.least(idle_at, old_at) > cutoff, "active")
        .when(idle_at <= old_at, "idle_timeout")
        .otherwise("max_duration")
    )


def newest_time(packets: DataFrame):
    """The newest packet time as a scalar subquery: one column of one pass over the packets."""
    return packets.agg(F.max("t_us")).scalar()


def session_summary(assigned: DataFrame, cutoff) -> DataFrame:
    """One row per session; sessions whose deadlines lie after `cutoff` (number or column) are active."""
    cutoff = F.lit(cutoff) if isinstance(cutoff, int) else cutoff
    out = (
        assigned.groupBy(*SESSION_KEY, "src_ip", "dst_ip", "src_port", "dst_port", "protocol")
        .agg(
            F.max("t_us").alias("end_us"),
            F.count("*").alias("packet_count"),
            F.sum("packet_size").alias("byte_count"),
            F.max(ends_flow("tcp_flags")).alias("finished"),
        )
        .withColumn("duration_us", F.col("end_us") - F.col("start_us"))
    )
    return out.withColumn("reason", close_reason(cutoff))


def active_sessions(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("reason") == "active")


def _trigger_batches(every_n: int, every_us: int):
    """Mark scoring points in batches sorted by session; a session is shorter than its age limit."""

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        new = (frame[SESSION_KEY] != frame[SESSION_KEY].shift()).any(axis=1).to_numpy()
        session = np.cumsum(new) - 1
        t = frame["t_us"].to_numpy(np.int64)
        n = len(t)
        first = np.flatnonzero(new)
        end = np.append(first[1:], n)
        shift = session * (int(t.max() - t.min()) + 2 * every_us + 1) - t.min()
        line = t + shift
        following = np.minimum(np.arange(n) + every_n, np.searchsorted(line, line + every_us, side="left"))
        chosen = np.zeros(n, bool)
        at, stop = first.copy(), end
        while len(at):
            chosen[at] = True
            at = following[at]
            going = at < stop
            at, stop = at[going], stop[going]
        return frame[chosen]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            tail = (batch[SESSION_KEY] == batch[SESSION_KEY].iloc[-1]).all(axis=1).to_numpy()
            rest = batch[tail].reset_index(drop=True)
            if not tail.all():
                yield pick(batch[~tail])
        if rest is not None and len(rest):
            yield pick(rest)

    return run


def predict_triggers(
    assigned: DataFrame, min_age_s: float = 1, min_packets: int = 5, every_n: int = 5, every_s: float = 1
) -> DataFrame:
    """Packets at which a session is scored: those that finish it, and, once it is old and
    large enough, one after every `every_n` packets or `every_s` seconds, whichever is first.

    Adds `packet_no` and `is_final`.
    """
    w = Window.partitionBy(*SESSION_KEY).orderBy("t_us", "packet_id")
    rows = assigned.withColumn("packet_no", F.row_number().over(w)).withColumn("is_final", ends_flow("tcp_flags"))
    ready = rows.filter(
        (F.col("packet_no") >= min_packets)
        & (F.col("t_us") - F.col("start_us") >= int(min_age_s * SECOND))
        & ~F.col("is_final")
    ).select(*SESSION_KEY, "t_us", "packet_id", "packet_no")
    schema = T.StructType([f for f in ready.schema.fields])
    periodic = (
        ready.repartition(*SESSION_KEY)
        .sortWithinPartitions(*SESSION_KEY, "t_us", "packet_id")
        .mapInPandas(_trigger_batches(every_n, int(every_s * SECOND)), schema)
        .withColumn("is_final", F.lit(False))
    )
    closing = rows.filter("is_final").select(*SESSION_KEY, "t_us", "packet_id", "packet_no", "is_final")
    return periodic.unionByName(closing)


def lifecycle(assigned: DataFrame, summary: DataFrame, triggers: DataFrame) -> DataFrame:
    """`started`, `active` and `finalized` log rows with the counters at that moment."""
    w = Window.partitionBy(*SESSION_KEY).orderBy("t_us", "packet_id").rowsBetween(Window.unboundedPreceding, 0)
    running = assigned.select(
        *SESSION_KEY,
        "t_us",
        "packet_id",
        F.count("*").over(w).alias("packet_count"),
        F.sum("packet_size").over(w).alias("byte_count"),
        (F.col("t_us") - F.col("start_us")).alias("duration_us"),
    )
    cols = ["stage", "reason", "flow_id", "start_us", "t_us", "packet_count", "byte_count", "duration_us"]

    def stage(df, name, reason):
        return df.withColumns({"stage": F.lit(name), "reason": reason}).select(*cols)

    started = stage(running.filter(F.col("packet_count") == 1), "started", F.lit("new_session"))
    active = stage(
        running.join(triggers.select(*SESSION_KEY, "packet_id"), [*SESSION_KEY, "packet_id"], "left_semi"),
        "active",
        F.lit("prediction_trigger"),
    )
    done = summary.filter(F.col("reason") != "active").withColumn("t_us", F.col("end_us"))
    return started.unionByName(active).unionByName(stage(done, "finalized", F.col("reason")))
