"""Streaming forms of the operators, and running them to a table."""

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.functions.scalars import mixed_blockable_ip, session_id
from netloom.operators.features import to_features
from netloom.operators.ml import score
from netloom.schema import LOGIN_PORTS, NORMAL
from netloom.session import scratch
from netloom.sources.sinks import fan_out, read_table, upsert
from netloom.streaming import state
from netloom.streaming.state import (
    BLOCK_OUT,
    BRUTE_OUT,
    CLOSING,
    DETECT_OUT,
    MAY_LACK,
    MEASURES,
    SESSION_OUT,
    SESSION_RECORD,
    SHIFT_US,
    UNSET,
    BlockState,
    DetectorState,
    GuessState,
    SessionRecords,
)

# The driver-side worker that starts a stateful query sees no shipped files, hence the
# processors travel by value.
cloudpickle.register_pickle_by_value(state)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(df: DataFrame, t: str = "t_us", delay: str = "10 seconds") -> DataFrame:
    """Event time column with its watermark; later rows are dropped and counted by Spark."""
    return df.withColumn("ts", F.timestamp_micros(t)).withWatermark("ts", delay)


def with_shifted_time(df: DataFrame, t: str = "t_us", delay: str = "10 seconds") -> DataFrame:
    """As `with_event_time`, ahead of `t` by the shift of keyed state, so that rows at or before the epoch count too."""
    return df.withColumn("ts", F.timestamp_micros(F.col(t) + F.lit(SHIFT_US))).withWatermark("ts", delay)


#: Event time of the end marker of a finite input: later than any deadline.
FAR_US = 4_102_444_800_000_000


def with_end(stream: DataFrame, t: str = "t_us", **values) -> tuple[DataFrame, Callable[[], None]]:
    """A finite stream that can be drained, and what drains it.

    The stream also reads a folder that stays empty until the returned function puts one row there: an end marker far
    later than all rows, so that the watermark passes them. `run` calls it when the input is used up and lets the query go
    on from its checkpoint. The marker itself waits behind the watermark, so keyed operators never emit it. Columns of
    the marker are 0, false or `values`, texts say `end of input`.
    """
    spark = stream.sparkSession
    folder = scratch(spark, "end-of-input")
    spark.createDataFrame([], stream.schema).write.parquet(folder)

    def value(field):
        if field.name == t:
            return F.lit(FAR_US)
        if field.name in values:
            return F.lit(values[field.name])
        return F.lit("end of input" if field.dataType.typeName() == "string" else False if field.dataType.typeName() == "boolean" else 0)

    def finish() -> None:
        row = [value(f).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
        spark.range(1, numPartitions=1).select(*row).write.mode("append").parquet(folder)

    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)), finish


def stream_sessions(packets: DataFrame, delay: str = "10 seconds", idle_s: float = 30, max_s: float = 120, live: bool = False, **points) -> DataFrame:
    """Ended sessions with all their measures; with `live`, also the measures so far at every scoring point.

    `reason` tells them apart: `active` and `closing` (the packet that ends the flow) are scoring points, and `packet_id`
    is the last packet measured.
    """
    # Numbers are texts in the key: a number beside nulls of other keys would reach the worker as a float, and be another key.
    number = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("src_port", "dst_port", "protocol")}
    keyed = with_shifted_time(packets, delay=delay).select(
        session_id().alias("flow_id"), "src_ip", "dst_ip", *number.values(),
        "ts", "t_us", "packet_id", "packet_size", "payload_size", "tcp_window_size", "transport_header_length",
        F.col("tcp_flags").cast("bigint").alias("tcp_flags"),
    )
    records = keyed.groupBy("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol").transformWithStateInPandas(
        SessionRecords(idle_s, max_s, live, **points), SESSION_RECORD, "append", "EventTime"
    )
    measures = {k: F.col("measures")[i] for i, k in enumerate(MEASURES)}
    final = F.col("reason").isin(CLOSING, "flow_end")
    columns = {
        **{c: F.when(F.col(c) != "", F.col(c)).cast("bigint") for c in number},
        **{k: F.when(v != UNSET, v) if k in MAY_LACK else v for k, v in measures.items()},
        "finished": final,
        "is_final": final,
    }
    return records.withColumns(columns).select(SESSION_OUT.fieldNames())


def stream_sessions_simple(packets: DataFrame, delay: str = "10 seconds", idle: str = "30 seconds") -> DataFrame:
    """Sessions by idle gap alone, for cheap rollups."""
    return (
        with_shifted_time(packets, delay=delay)
        .groupBy(session_id().alias("flow_id"), F.session_window("ts", idle))
        .agg(F.min("t_us").alias("start_us"), F.max("t_us").alias("end_us"), F.count("*").alias("packet_count"), F.sum("packet_size").alias("byte_count"))
        .drop("session_window")
    )


def stream_detect(packets: DataFrame, delay: str = "10 seconds", **limits) -> DataFrame:
    """Window findings per packet; state per source is bounded by the thresholds."""
    rows = with_shifted_time(packets, delay=delay).select("src_ip", "ts", "t_us", "packet_id", "dst_port", "tcp_flags")
    return rows.groupBy("src_ip").transformWithStateInPandas(DetectorState(**limits), DETECT_OUT, "append", "EventTime")


def stream_bruteforce(packets: DataFrame, delay: str = "10 seconds", ports: list[int] = LOGIN_PORTS, **limits) -> DataFrame:
    # All packets move the watermark: naming `ts` keeps the filter above it.
    rows = with_shifted_time(packets, delay=delay).filter(F.when(F.col("ts").isNotNull(), F.col("dst_port").isin(ports)))
    rows = rows.select("src_ip", "dst_ip", "dst_port", "ts", "t_us", "packet_id")
    return rows.groupBy("src_ip", "dst_ip", "dst_port").transformWithStateInPandas(
        GuessState(**limits), BRUTE_OUT, "append", "EventTime"
    )


def stream_blocks(requests: DataFrame, delay: str = "10 seconds", cooldown_s: float = 60) -> DataFrame:
    """Outcomes of block requests and expiries, per address. Needs ip, t_us, seq, duration_s; `unblock` marks manual releases."""
    frame = requests if "unblock" in requests.columns else requests.withColumn("unblock", F.lit(False))
    good = mixed_blockable_ip("ip")
    rows = with_shifted_time(frame.filter(good), delay=delay).select("ip", "ts", "t_us", "seq", F.col("duration_s").cast("bigint").alias("duration_s"), F.coalesce("unblock", F.lit(False)).cast("bigint").alias("unblock"))
    none = F.lit(-1).cast("bigint")
    refused = frame.filter(~good).select("ip", F.col("t_us").alias("at_us"), "seq", F.lit("invalid_or_loopback_ip").alias("status"), none.alias("until_us"), F.lit(0).cast("bigint").alias("times_blocked"))
    return rows.groupBy("ip").transformWithStateInPandas(BlockState(cooldown_s), BLOCK_OUT, "append", "EventTime").unionByName(refused)


def stream_dedup(events: DataFrame, key: str | list[str] = "event_id", t: str = "ts_us", delay: str = "10 seconds") -> DataFrame:
    """One row per key, of one column or several, among rows within the watermark delay of each other."""
    return with_event_time(events, t, delay).dropDuplicatesWithinWatermark([key] if isinstance(key, str) else key).drop("ts")


def stream_telemetry(packets: DataFrame, delay: str = "10 seconds", window_s: int = 30, every_s: int = 5) -> DataFrame:
    """Received and dropped packets of the trailing window, every few seconds; of packets after the epoch, as in `with_event_time`."""
    # The watermark starts at the epoch: a packet there would miss the windows that end there, yet count in the later ones.
    packets = packets.filter(F.col("t_us") > 0)
    # A row exactly as old as the window is out, one at the snapshot is in: shift by 1 us.
    shifted = with_event_time(packets.withColumn("_t", F.col("t_us") - 1), "_t", delay)
    return (
        shifted.groupBy(F.window("ts", f"{window_s} seconds", f"{every_s} seconds").alias("w"))
        .agg(F.count("*").alias("received"), F.sum((F.col("packet_size") == 0).cast("bigint")).alias("dropped"))
        .select(F.unix_micros("w.end").alias("snapshot_us"), "received", "dropped", (F.col("dropped") > 0).alias("packet_loss_detected"))
    )


def stream_rollup(events: DataFrame, t: str = "ts_us", delay: str = "10 seconds") -> DataFrame:
    """Hourly threat and benign totals; run in update mode."""
    threat = F.col("prediction") != NORMAL
    return (
        with_event_time(events, t, delay)
        .groupBy(F.window("ts", "1 hour").alias("w"))
        .agg(
            F.count("*").alias("ml_prediction_total"),
            F.sum(threat.cast("bigint")).alias("threat_event_total"),
            F.sum((~threat).cast("bigint")).alias("benign_event_total"),
        )
        .select(F.unix_micros("w.start").alias("bucket_start_us"), "ml_prediction_total", "threat_event_total", "benign_event_total")
    )


def stream_score(sessions: DataFrame, primary: PipelineModel, secondary: PipelineModel | None = None) -> DataFrame:
    """Score sessions, or scoring points, in flight."""
    return score(to_features(sessions), primary, secondary)


def _rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def start_append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to parquet, taking what is available now."""
    _rocksdb(stream.sparkSession)
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def start_upsert(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, mode: str = "update") -> StreamingQuery:
    """Merge every micro-batch into a keyed table, the last value per key wins."""
    _rocksdb(stream.sparkSession)

    def write(batch: DataFrame, _batch_id: int) -> None:
        upsert(batch, path, key, "last", order)

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )


def start_fan_out(stream: DataFrame, path: str, checkpoint: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> StreamingQuery:
    """Feed several tables from one stream, each batch once in every table, also across restarts."""
    _rocksdb(stream.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        fan_out(batch, path, tables, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark so far."""
    return sum(
        op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators
    )


def run(spark: SparkSession, stream: DataFrame, name: str, start: Callable[..., StreamingQuery] = start_append, finish: Callable[[], None] | None = None, **options) -> DataFrame:
    """Run a stream over the available input and read its table. With `finish`, of `with_end`, all rows come out."""
    root = scratch(spark, name)
    for end in (None, finish) if finish else (None,):
        if end:
            end()
        query = start(stream, f"{root}/out", f"{root}/checkpoint", **options)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
    if start is start_upsert:
        return read_table(spark, f"{root}/out")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
