"""Tables the engine would be fed by its surroundings, derived from the driver's tables.

No packet capture, model or operator console exists here, so predictions, operator
commands and screening requests are projections of `events` and `orders`: one row per
source row, integer arithmetic only.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.scalars import ends_flow, event_id, session_id
from netloom.schema import FEATURES, LABEL, NORMAL, RAW_TO_FEATURE


def scored_packets(packets: DataFrame) -> DataFrame:
    """Stand-in model outputs per packet: primary and secondary label and confidence."""
    pid = F.col("packet_id")
    label = (
        F.when(pid % 3 == 0, NORMAL)
        .when(F.col("dst_port") == 22, "Brute Force")
        .when(F.col("tcp_flags") == 2, "DDoS")
        .when(F.col("tcp_flags") == 4, "DoS")
        .otherwise("Bots")
    )
    return (
        packets.withColumn("session_id", session_id())
        .withColumn("label", label)
        .withColumn("confidence", (50 + pid * 37 % 50).cast("double") / 100)
        .withColumn("shadow_label", F.when(pid % 4 == 0, NORMAL).otherwise(F.col("label")))
        .withColumn("shadow_confidence", (40 + pid * 53 % 60).cast("double") / 100)
        .withColumn("is_final", ends_flow("tcp_flags"))
        .withColumn(
            "event_type",
            F.when(F.col("is_final"), "ml_completed_flow_prediction").otherwise("ml_live_prediction"),
        )
    )


def rule_scorer(features: DataFrame) -> DataFrame:
    """Stand-in scorer over feature rows; any `DataFrame -> DataFrame` with these outputs will do."""
    n = F.col("total_fwd_packets")
    label = (
        F.when((F.col("dst_port") == 22) & (n >= 5), "Brute Force")
        .when(F.col("syn_flag_count") > F.col("ack_flag_count"), "DDoS")
        .when(F.col("rst_flag_count") > 0, "DoS")
        .otherwise(NORMAL)
    )
    return features.withColumn("label", label).withColumn(
        "confidence", (50 + n.cast("bigint") % 50).cast("double") / 100
    )


def ingest_events(scored: DataFrame) -> DataFrame:
    """Events as posted to the service, optional fields partly absent."""
    pid = F.col("packet_id")
    return scored.select(
        event_id("session_id", "event_type", "label", "wall_us").alias("event_id"),
        F.col("wall_us").alias("ts_us"),
        "packet_id",
        F.col("src_ip").alias("source"),
        F.when(pid % 2 == 0, F.col("src_ip")).alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"),
        F.col("dst_port").alias("destination_port"),
        "protocol",
        F.lit("primary").alias("model"),
        F.col("label").alias("prediction"),
        F.when(pid % 5 == 0, F.col("label")).alias("attack_type"),
        "confidence",
        F.when(pid % 7 == 0, F.col("confidence")).alias("confidence_score"),
        F.lit(None).cast("string").alias("threat_id"),
        F.when(pid % 2 == 1, F.col("event_type")).alias("detection_method"),
        F.when(F.col("label") == NORMAL, "allow").otherwise("alert").alias("action"),
        F.lit(None).cast("string").alias("action_taken"),
        F.lit(None).cast("double").alias("risk_score"),
        "session_id",
        "is_final",
    )


def operator_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator commands from `orders`; some ids are delivered again by the next order, others a minute later."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    # Order priority -> action.
    action = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "block")
        .when(F.col("o_orderpriority") == "2-HIGH", "unblock")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "watchlist")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unwatchlist")
        .otherwise("reboot")
    )
    first = key - F.when(key % 10 == 1, 1).when((key % 10 == 2) & (F.floor(key / 640) % 2 == 1), 640).otherwise(0)
    ip = (
        F.when(first % 29 == 0, "")
        .when(first % 23 == 0, "not-an-ip")
        .when(first % 19 == 0, "127.0.0.1")
        .otherwise(F.concat(F.lit("10.0.0."), (1 + first % 12).cast("string")))
    )
    return o.select(
        F.concat(F.lit("c-"), first.cast("string")).alias("command_id"),
        key.alias("seq"),
        (key * 100_000).alias("t_us"),
        action.alias("action"),
        ip.alias("ip_address"),
        F.when(cust % 3 == 0, 300 + cust % 50).cast("bigint").alias("duration_seconds"),
    )


def screening_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screening results posted for texts, one per document, each third id repeated."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i = F.col("doc_id")
    return d.select(
        F.concat(F.lit("r-"), (i - (i % 3 == 1).cast("int")).cast("string")).alias("request_id"),
        (i * 1_000_000).alias("ts_us"),
        F.col("source").alias("source"),
        F.col("text").alias("query"),
        (i % 4 == 0).alias("detected"),
        ((60 + i % 40).cast("double") / 100).alias("confidence"),
    )


def packet_headers(packets: DataFrame) -> DataFrame:
    """Decoded header columns as a dissector would hand them over, one row per event."""
    pid, tcp = F.col("packet_id"), F.col("protocol") == 6
    return packets.select(
        "packet_id",
        "t_us",
        "src_ip",
        "dst_ip",
        "packet_size",
        (pid % 31 != 0).alias("is_ip"),
        (tcp & (pid % 37 != 0)).alias("has_tcp"),
        (F.col("protocol") == 17).alias("has_udp"),
        (F.col("protocol") == 1).alias("has_icmp"),
        F.col("src_port").alias("sport"),
        F.col("dst_port").alias("dport"),
        F.col("tcp_flags").alias("flags"),
        F.col("tcp_window_size").alias("window"),
        (5 + pid % 3).alias("data_offset"),
        F.col("payload_size").alias("transport_payload"),
    )


def recorded_block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored block-event table: one row per order, with both spellings of actions."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    # Order priority -> recorded action.
    action = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.when(key % 2 == 0, "block").otherwise("blocked"))
        .when(F.col("o_orderpriority") == "2-HIGH", "unblocked")
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.when(key % 2 == 0, "watchlist").otherwise("watchlisted"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unwatchlisted")
        .otherwise("allowed")
    )
    ip = F.concat(F.lit("10.0.0."), (1 + cust % 12).cast("string"))
    ts = 1_704_067_200_000_000 + key * 173_000_000 % 2_592_000_000_000
    return o.select(
        F.concat(F.lit("b-"), key.cast("string")).alias("event_id"),
        ts.alias("ts_us"),
        ip.alias("source_ip"),
        action.alias("action_taken"),
        F.concat(F.lit("reason_"), (cust % 4).cast("string")).alias("reason"),
        F.when(cust % 2 == 0, "manual").otherwise("heuristic").alias("detection_method"),
        F.when(key % 2 == 0, F.concat(ip, F.lit(":40000-10.1.0."), (1 + cust % 3).cast("string"), F.lit(":22-6"))).alias("session_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", ts + 2_700_000_000).alias("expires_us"),
    )


def raw_flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw labelled flow rows as text under the raw column names, one per event.

    Every twentieth row repeats the row before it; some values and labels are unusable.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    r = F.col("event_id") - (F.col("event_id") % 20 == 1).cast("int")
    cols = {"Flow ID": F.concat(F.lit("f"), r.cast("string"))}
    for i, name in enumerate(RAW_TO_FEATURE):
        cols[name] = ((i + 1) * (1 + r % (11 + i))).cast("string")
    cols["Flow Byts/s"] = F.when(r % 50 == 0, "Infinity").when(r % 53 == 0, "NaN").otherwise(cols["Flow Byts/s"])
    cols["Flow IAT Std"] = F.when(r % 59 == 0, "n/a").otherwise(cols["Flow IAT Std"])
    # Raw labels in turn.
    cols["Label"] = (
        F.when(r % 41 == 0, " ")
        .when(r % 5 == 0, "Benign")
        .when(r % 5 == 1, "DDOS attack-HOIC")
        .when(r % 5 == 2, " FTP-BruteForce")
        .when(r % 5 == 3, "Bot")
        .otherwise("DoS attacks-Hulk")
    )
    return e.select(*[v.alias(k) for k, v in cols.items()])


def prepared_flow_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of prepared files, some dirty, one per event, with `day` 0..9."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    r = F.col("event_id")
    cols = {name: ((i + 1) * (1 + r % (11 + i))).cast("string") for i, name in enumerate(FEATURES)}
    cols["dst_port"] = F.when(r % 17 == 0, "70000").when(r % 19 == 0, "80.5").otherwise(cols["dst_port"])
    cols["protocol"] = F.when(r % 3 == 0, "6").when(r % 3 == 1, "17").otherwise("255")
    cols["flow_duration"] = F.when(r % 23 == 0, "inf").otherwise(cols["flow_duration"])
    cols["packet_len_mean"] = F.when(r % 29 == 0, "-5").otherwise(cols["packet_len_mean"])
    cols["flow_iat_mean"] = F.when(r % 31 == 0, "NaN").otherwise(cols["flow_iat_mean"])
    cols["fin_flag_count"] = F.when(r % 2 == 0, "2.5").otherwise("3.5")
    # Labels in turn.
    label = (
        F.when(r % 43 == 0, " ").when(r % 47 == 0, "NaN").when(r % 4 == 0, " Normal Traffic").when(r % 4 == 1, "DDoS")
        .when(r % 4 == 2, "Bots").otherwise("DoS")
    )
    return e.select((r % 10).alias("day"), *[v.alias(k) for k, v in cols.items()], label.alias(LABEL))


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(actual, predicted) pairs, one per event; a few actual labels are foreign."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    r = F.col("event_id")
    # Class of each residue.
    actual = F.when(r % 101 == 0, "Foreign").when(r % 4 == 0, NORMAL).when(r % 4 == 1, "DDoS").when(r % 4 == 2, "DoS").otherwise("Bots")
    shifted = F.when(r % 4 == 0, "DDoS").when(r % 4 == 1, NORMAL).when(r % 4 == 2, "DDoS").otherwise("DoS")
    return e.select(actual.alias("actual"), F.when((r % 7 == 0) | (r % 101 == 0), shifted).otherwise(actual).alias("predicted"))
