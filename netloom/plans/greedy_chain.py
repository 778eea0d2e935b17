"""Greedy selection along a time line.

Several rules have the form "take the first row; then the first row at or after the
time that row allows (`resume`); and so on": the cut of long sessions, and requests
that are accepted only outside a cooldown. Each choice depends on the one before, yet a
hot key must not be walked by one task.

Only the first row of each key and microsecond can be chosen, so rows reduce to those
by partial aggregation first. Every (key, block of time) then reduces to a table "first
candidate time -> when the chain may resume after this block". Composing these tables,
`fan_in` at a time, gives the state at the start of each block, after which all blocks
mark their chosen rows independently. A group holds one block, whose size the time
resolution bounds, or `fan_in` tables, or (at the top) one table of each
`fan_in` ** `levels` blocks of a key. Nothing runs while the plan is built.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (used as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.plans.slices import slice_of

NEVER = np.iinfo(np.int64).max
START = np.iinfo(np.int64).min


def _successors(t: np.ndarray, resume: np.ndarray, reset: np.ndarray) -> np.ndarray:
    """Index of the row chosen after each row; len(t) when that lies beyond the block."""
    n = len(t)
    following = np.maximum(np.searchsorted(t, resume, side="left"), np.arange(1, n + 1))
    resets = np.flatnonzero(reset)
    if len(resets):
        at = np.searchsorted(resets, np.arange(n), side="right")
        following = np.minimum(following, np.append(resets, n)[at])
    return following


def _ends(following: np.ndarray) -> np.ndarray:
    """Last row of the block that the chain reaches from each row (pointer doubling)."""
    n = len(following)
    jump = np.where(following < n, following, np.arange(n))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def _thin(table: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring entries with the same outcome need only the last one."""
    same = (table["exit_us"].shift(-1) == table["exit_us"]) & (table["hold_us"].shift(-1) == table["hold_us"])
    return table[~same.to_numpy()]


def _enter(table: pd.DataFrame, ready: int, hold: int) -> tuple[int, int]:
    at = int(np.searchsorted(table["entry_us"].to_numpy(), ready, side="left"))
    if at == len(table):
        return ready, hold
    return int(table["exit_us"].iat[at]), int(table["hold_us"].iat[at])


def greedy_chain(
    df: DataFrame,
    keys: list[str],
    horizon_us: int,
    t: str = "t_us",
    tie: str = "packet_id",
    resume: str = "resume_us",
    hold: str | None = None,
    reset: str | None = None,
    block_us: int | None = None,
    fan_in: int = 512,
    levels: int = 1,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """The chosen rows: `keys`, `t`, `tie`, and `hold_before`, the `hold` value of the row
    chosen before (the least long for the first).

    `resume` of a row lies after it by at most `horizon_us`. A row with `reset` true is
    always chosen and should precede others of its time, unless columns `within` tell apart what lies before and after it.
    """
    block_us = block_us or 4 * horizon_us
    held = hold or resume
    flag = [F.coalesce(F.col(reset), F.lit(False)).alias("reset")] if reset else [F.lit(False).alias("reset")]
    first = F.min(F.struct(F.col(tie).alias("tie"), F.col(resume).alias("resume"), F.col(held).alias("hold")))
    firsts = df.groupBy(*keys, F.col(t).alias("t"), *flag, *within).agg(first.alias("_f"))
    base = firsts.select(*keys, "t", "reset", "_f.*", slice_of(F.col("t"), block_us).alias("_blk"))
    out_t, out_tie = t, tie
    key_fields = [f for f in base.schema.fields if f.name in keys]
    key_fields = [next(f for f in key_fields if f.name == k) for k in keys]
    table_schema = T.StructType(
        [
            *key_fields,
            T.StructField("_blk", T.LongType()),
            T.StructField("entry_us", T.LongType()),
            T.StructField("exit_us", T.LongType()),
            T.StructField("hold_us", T.LongType()),
        ]
    )
    start_schema = T.StructType(
        [
            *key_fields,
            T.StructField("_blk", T.LongType()),
            T.StructField("ready_us", T.LongType()),
            T.StructField("held_us", T.LongType()),
        ]
    )

    def arrays(rows: pa.Table):
        """Rows in time order, and as numpy only the columns the chain needs."""
        rows = rows.take(pa.compute.sort_indices(rows, sort_keys=[("t", "ascending"), ("tie", "ascending")]))
        times, resume, hold = (rows.column(c).to_numpy() for c in ("t", "resume", "hold"))
        return rows, times, resume, hold, rows.column("reset").to_numpy().astype(bool)

    def scalars(key: tuple) -> tuple:
        return tuple(v.as_py() for v in key)

    def labelled(frame: pd.DataFrame, key: tuple, schema: T.StructType) -> pd.DataFrame:
        for name, value in zip(keys, key, strict=False):
            frame[name] = value
        return frame[schema.fieldNames()]

    def block_table(key: tuple, rows: pa.Table) -> pa.Table:
        key = scalars(key)
        _, times, ready, held, flags = arrays(rows)
        ends = _ends(_successors(times, ready, flags))
        # A chain from the block before resumes within the horizon, or at a reset.
        count = int(np.searchsorted(times, key[-1] * block_us + horizon_us, side="left")) + 1
        count = min(count, len(times))
        entries = times[:count].copy()
        resets = np.flatnonzero(flags[:count])
        if len(resets):
            entries = entries[: resets[0] + 1]
            entries[-1] = NEVER
        last = ends[: len(entries)]
        out = pd.DataFrame({"entry_us": entries, "exit_us": ready[last], "hold_us": held[last]})
        out = labelled(_thin(out.assign(_blk=key[-1])), key, table_schema)
        return pa.Table.from_pandas(out, preserve_index=False)

    def split(tables: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
        yield from tables.sort_values(["_blk", "entry_us"], kind="stable").groupby("_blk", sort=True)

    def compose(key: tuple, tables: pd.DataFrame) -> pd.DataFrame:
        """One table for a run of blocks: push the first block's entries through all of them."""
        parts = [p for _, p in split(tables)]
        # A chain from outside resumes within the horizon, hence inside the first block
        # that has rows or, when it passes that one, at the start of the second.
        entries = parts[0]["entry_us"].to_numpy()
        if len(parts) > 1 and entries[-1] != NEVER:
            entries = np.append(entries, parts[1]["entry_us"].iat[0])
        exit_us, hold_us = entries.copy(), np.full(len(entries), START)
        for p in parts:
            at = np.searchsorted(p["entry_us"].to_numpy(), exit_us, side="left")
            hit = at < len(p)
            exit_us = np.where(hit, p["exit_us"].to_numpy()[np.minimum(at, len(p) - 1)], exit_us)
            hold_us = np.where(hit, p["hold_us"].to_numpy()[np.minimum(at, len(p) - 1)], hold_us)
        out = pd.DataFrame({"entry_us": entries, "exit_us": exit_us, "hold_us": hold_us})
        out = _thin(out.assign(_blk=key[-1]))
        return labelled(out, key, table_schema)

    def walk(key: tuple, tables: pd.DataFrame, ready: int, held: int) -> pd.DataFrame:
        blocks, readies, helds = [], [], []
        for blk, part in split(tables):
            blocks.append(blk)
            readies.append(ready)
            helds.append(held)
            ready, held = _enter(part, ready, held)
        out = pd.DataFrame({"_blk": blocks, "ready_us": readies, "held_us": helds}).astype("int64")
        return labelled(out, key, start_schema)

    def walk_from_start(key: tuple, tables: pd.DataFrame) -> pd.DataFrame:
        return walk(key, tables, START, START)

    def walk_from(key: tuple, tables: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        return walk(key, tables, int(starts["ready_us"].iat[0]), int(starts["held_us"].iat[0]))

    def block_starts(tables: DataFrame, level: int) -> DataFrame:
        if level == 0:
            return tables.groupBy(*keys).applyInPandas(walk_from_start, start_schema)
        wide = tables.withColumn("_run", F.floor(F.col("_blk") / fan_in).cast("bigint"))
        runs = wide.groupBy(*keys, "_run").applyInPandas(compose, table_schema)
        starts = block_starts(runs, level - 1).withColumnRenamed("_blk", "_run")
        return (
            wide.groupBy(*keys, "_run")
            .cogroup(starts.groupBy(*keys, "_run"))
            .applyInPandas(walk_from, start_schema)
        )

    def chosen_rows(rows: pa.Table, ready_us: int, hold_us: int) -> pa.Table:
        rows, times, ready, held, flags = arrays(rows)
        following = _successors(times, ready, flags)
        at = int(np.searchsorted(times, ready_us, side="left"))
        resets = np.flatnonzero(flags)
        if len(resets):
            at = min(at, int(resets[0]))
        picked, before = [], []
        while at < len(times):
            picked.append(at)
            before.append(hold_us)
            hold_us = int(held[at])
            at = int(following[at])
        out = rows.take(pa.array(picked, pa.int64())).append_column("hold_before", pa.array(before, pa.int64()))
        return out.select(out_schema.fieldNames())

    def mark(key: tuple, rows: pa.Table, starts: pa.Table) -> pa.Table:
        return chosen_rows(rows, starts.column("ready_us")[0].as_py(), starts.column("held_us")[0].as_py())

    out_schema = T.StructType([*key_fields, *[T.StructField(c, T.LongType()) for c in ("t", "tie", "hold_before")]])
    tables = base.groupBy(*keys, "_blk").applyInArrow(block_table, table_schema)
    starts = block_starts(tables, levels)
    out = base.groupBy(*keys, "_blk").cogroup(starts.groupBy(*keys, "_blk")).applyInArrow(mark, out_schema)
    return out.withColumnsRenamed({"t": out_t, "tie": out_tie})
