"""Cutting a keyed time line into slices, so that one hot key spreads over many tasks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_of(t_us, width_us: int) -> Column:
    t = F.col(t_us) if isinstance(t_us, str) else t_us
    return F.floor(t / F.lit(width_us)).cast("bigint")


def with_lookback(df: DataFrame, width_us: int, lookback_us: int, t: str = "t_us") -> DataFrame:
    """Add `_slice` and `_halo`: rows near a slice end are repeated in the next slice.

    A trailing window of at most `lookback_us` can then be computed inside (key, slice);
    rows flagged `_halo` only serve as history and are dropped afterwards.
    """
    if width_us < lookback_us:
        raise ValueError("a slice must be at least as wide as the window it serves")
    home = slice_of(t, width_us)
    late = F.pmod(F.col(t), F.lit(width_us)) >= width_us - lookback_us
    copies = F.when(late, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("_slice", F.explode(copies)).withColumn("_halo", F.col("_slice") != home)


def with_previous(
    df: DataFrame, keys: list[str], value: Column, out: str, width_us: int, t: str = "t_us", tie: str = "packet_id"
) -> DataFrame:
    """Add `out`: `value` of the previous row of the same key, however long ago it was.

    Inside a slice this is `lag`. The first row of a slice takes the last value of the
    nearest earlier slice, found on a table with one row per (key, slice).
    """
    keyed = df.withColumn("_slice", slice_of(t, width_us)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_slice").orderBy(t, tie)
    last = (
        keyed.groupBy(*keys, "_slice")
        .agg(F.max(F.struct(F.col(t).alias("t"), F.col(tie).alias("i"), F.col("_value").alias("v"))).alias("_last"))
        .withColumn("_before", F.lag("_last.v").over(Window.partitionBy(*keys).orderBy("_slice")))
        .select(*keys, "_slice", "_before")
    )
    rows = keyed.withColumn("_lag", F.lag("_value").over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    return (
        rows.join(last, [*keys, "_slice"])
        .withColumn(out, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")))
        .drop("_slice", "_value", "_lag", "_first", "_before")
    )
