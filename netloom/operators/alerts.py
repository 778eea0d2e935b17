"""Alerts and the records sent on: IDS events, session records, block events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.scalars import (
    event_action,
    event_id,
    risk_score,
    session_action,
    session_id,
    severity,
)
from netloom.plans.slices import with_previous
from netloom.schema import FEATURES, NORMAL, SECOND

# Alert type of each kind of request.
ALERT_TYPE = {
    "heuristic": "heuristic_high_confidence",
    "bruteforce": "heuristic_bruteforce_detected",
    "ml_live": "ml_attack_detected",
    "ml_final": "ml_completed_flow_update",
}


def alerts(decisions: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One alert per decided request; `blocked` tells whether the address is now blocked."""
    kinds = kinds or list(ALERT_TYPE)
    name = F.lit(None).cast("string")
    for kind in kinds:
        name = F.when(F.col("kind") == kind, ALERT_TYPE[kind]).otherwise(name)
    return decisions.filter(F.col("kind").isin(kinds)).select(
        name.alias("type"),
        "attack_type",
        "confidence",
        F.col("ok").alias("blocked"),
        F.col("status").alias("block_status"),
        F.col("duration_s").alias("block_duration_s"),
        "src_ip",
        "dst_ip",
        "src_port",
        "dst_port",
        "protocol",
        "t_us",
        "packet_id",
        "seq",
        (F.col("kind") == "ml_final").alias("is_final"),
    )


def session_alerts(ml_alerts: DataFrame, slice_s: float = 3600) -> DataFrame:
    """Alerts of each session without repeats, tagged `new`, `updated` or `final`.

    A repeat has the attack type, confidence (4 digits) and block outcome of the alert
    before. Dropped repeats equal that alert, so comparing neighbours is enough; a final
    alert is always kept and starts afresh.
    """
    signature = F.struct("attack_type", F.round("confidence", 4).alias("confidence"), "blocked")
    rows = ml_alerts.withColumn("session_id", session_id()).withColumn("_sig", signature)
    state = F.struct(F.col("_sig").alias("sig"), F.col("is_final").alias("final"))
    rows = with_previous(rows, ["session_id"], state, "_prev", int(slice_s * SECOND), tie="seq")
    known = F.col("_prev").isNotNull() & ~F.col("_prev.final")
    repeat = F.coalesce(known & (F.col("_prev.sig") == F.col("_sig")), F.lit(False))
    return (
        rows.filter(F.col("is_final") | ~repeat)
        .withColumn(
            "update_type",
            F.when(F.col("is_final"), "final").when(F.coalesce(known, F.lit(False)), "updated").otherwise("new"),
        )
        .drop("_sig", "_prev")
    )


def ids_events(scored: DataFrame, event_type: str, is_final: bool, model: str = "primary") -> DataFrame:
    """Event records of scored sessions (columns of the feature rows, `label`, `confidence`)."""
    sid = session_id(protocol=F.col("protocol").cast("int"), dst_port=F.col("_dport"))
    base = scored.withColumn("_dport", F.when(F.col("src_port").isNull(), F.lit(None)).otherwise(F.col("dst_port").cast("bigint")))
    rows = base.withColumn("session_id", sid)
    action = event_action("label")
    forwarded = F.struct(
        *FEATURES,
        "session_id",
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"),
        F.col("_dport").alias("destination_port"),
        F.col("flow_duration").alias("session_duration"),
        F.col("n").alias("session_packet_count"),
        F.col("bytes").alias("session_byte_count"),
        F.lit(is_final).alias("is_final"),
    )
    return rows.select(
        F.lit("1.0").alias("schema_version"),
        event_id("session_id", F.lit(event_type), "label", "end_us").alias("event_id"),
        F.col("end_us").alias("ts_us"),
        F.col("src_ip").alias("source"),
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"),
        F.col("_dport").alias("destination_port"),
        F.col("protocol").cast("int").alias("protocol"),
        F.lit(model).alias("model"),
        F.col("label").alias("prediction"),
        F.col("label").alias("attack_type"),
        "confidence",
        F.col("confidence").alias("confidence_score"),
        severity("label", "confidence").alias("severity"),
        action.alias("action"),
        action.alias("action_taken"),
        F.lit(event_type).alias("detection_method"),
        "session_id",
        F.col("confidence").alias("risk_score"),
        F.col("n").alias("packet_count"),
        F.col("bytes").alias("byte_count"),
        F.round("flow_duration", 4).alias("flow_duration"),
        F.col("label").alias("ml_prediction"),
        forwarded.alias("features"),
    )


def shadow_events(scored: DataFrame, t: str = "t_us") -> DataFrame:
    """Event records of the secondary model. They carry no block outcome and lead to none."""
    kind = F.when(F.col("is_final"), "ml_completed_flow_secondary_shadow").otherwise("ml_live_secondary_shadow")
    label, conf = F.col("shadow_label"), F.col("shadow_confidence")
    return scored.withColumn("_kind", kind).select(
        F.lit("1.0").alias("schema_version"),
        event_id("session_id", "_kind", label, t).alias("event_id"),
        F.col(t).alias("ts_us"),
        F.col("src_ip").alias("source"),
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"),
        F.col("dst_port").alias("destination_port"),
        "protocol",
        F.lit("decision_tree").alias("model"),
        label.alias("prediction"),
        label.alias("attack_type"),
        conf.alias("confidence"),
        conf.alias("confidence_score"),
        severity(label, conf).alias("severity"),
        F.lit("shadow").alias("action"),
        F.lit("shadow").alias("action_taken"),
        F.col("_kind").alias("detection_method"),
        "session_id",
        conf.alias("risk_score"),
        "is_final",
        label.alias("ml_prediction"),
    )


def session_records(summary: DataFrame, scored: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """Session table rows. `scored` adds label and confidence per session (unless the summary
    has them already), `decisions` the heuristic result of its last packet."""
    key = ["flow_id", "start_us", "start_packet"]
    rows = summary
    if "label" in summary.columns:
        pass
    elif scored is not None:
        rows = rows.join(scored.select(*key, "label", "confidence"), key, "left")
    else:
        rows = rows.withColumns({"label": F.lit(None).cast("string"), "confidence": F.lit(0.0)})
    if decisions is not None:
        last = decisions.groupBy(*key).agg(F.max_by(F.struct("reason", "score"), F.struct("t_us", "packet_id")).alias("_h"))
        rows = rows.join(last, key, "left")
    else:
        rows = rows.withColumn("_h", F.struct(F.lit("clean").alias("reason"), F.lit(0).alias("score")))
    return rows.select(
        F.col("flow_id").alias("session_id"),
        F.col("start_us").alias("start_time_us"),
        F.col("end_us").alias("end_time_us"),
        F.col("src_ip").alias("source_ip"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"),
        F.col("dst_port").alias("destination_port"),
        "protocol",
        "packet_count",
        "byte_count",
        (F.col("duration_us").cast("double") / 1e6).alias("duration"),
        risk_score("label", F.coalesce("confidence", F.lit(0.0)), "_h.score").alias("risk_score"),
        F.col("label").alias("ml_prediction"),
        F.concat_ws(":", "_h.reason", F.col("_h.score").cast("string")).alias("heuristic_result"),
        F.col("reason").alias("state"),
        session_action("reason").alias("action_taken"),
    )


def backfilled(events: DataFrame) -> DataFrame:
    """Defaults of the optional fields of a posted event."""
    # Field <- field it defaults to.
    source_of = {
        "threat_id": F.col("event_id"),
        "source_ip": F.col("source"),
        "attack_type": F.col("prediction"),
        "confidence_score": F.col("confidence"),
        "detection_method": F.lit("ml"),
        "action_taken": F.col("action"),
        "risk_score": F.col("confidence"),
    }
    return events.withColumns({name: F.coalesce(F.col(name), default) for name, default in source_of.items()})


def dedup_key(session="session_id", source="source", attack_type="attack_type", action="action"):
    parts = [F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in (session, source, attack_type, action)]
    return F.concat(F.lit("alert:v1:"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))


def upsert_alerts(events: DataFrame, tie: str = "packet_id") -> DataFrame:
    """The alert table of a set of (back-filled) events: one row per key with first and last
    time, occurrences and the latest values. Benign events raise no alert."""
    latest = [
        "event_id", "prediction", "confidence", "action", "source", "threat_id", "detection_method", "action_taken",
        "session_id", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "risk_score", "is_final",
    ]
    attack = events.filter(F.col("prediction") != NORMAL).withColumn("dedup_key", dedup_key())
    return (
        attack.groupBy("dedup_key")
        .agg(
            F.max_by(F.struct(*latest), F.struct("ts_us", tie)).alias("l"),
            F.min("ts_us").alias("first_seen_us"),
            F.max("ts_us").alias("last_seen_us"),
            F.count("*").alias("occurrence_count"),
        )
        .select("dedup_key", "l.*", "first_seen_us", "last_seen_us", "occurrence_count")
        .withColumn("severity", severity("prediction", "confidence"))
        .withColumn("status", F.lit("open"))
        # The table's own id; a service would draw one, here it follows from the key.
        .withColumn("id", F.substring("dedup_key", 10, 32))
    )


def threats(alert_table: DataFrame) -> DataFrame:
    """Alerts under the names of the threat view."""
    return alert_table.select(
        F.coalesce("threat_id", "id").alias("threat_id"),
        F.col("last_seen_us").alias("ts_us"),
        "source_ip",
        "source_port",
        "destination_ip",
        "destination_port",
        "protocol",
        F.col("prediction").alias("attack_type"),
        "severity",
        F.col("confidence").alias("confidence_score"),
        "detection_method",
        F.coalesce("action_taken", "action").alias("action_taken"),
        "status",
        "session_id",
        F.col("id").alias("alert_id"),
    )


def threat_by_id(alert_table: DataFrame, threat_id: str) -> DataFrame:
    """The threat with this id, matched against either identifier."""
    return threats(alert_table).filter((F.col("threat_id") == threat_id) | (F.col("alert_id") == threat_id))


def sql_decisions(requests: DataFrame) -> DataFrame:
    """Decision per screening request; the first decision of an id stays (of several at one time, by a hash)."""
    decided = F.struct("ts_us", "source", "query_preview", "detected", "confidence")
    return (
        # The stored preview is cut first, so that no long text enters the shuffle.
        requests.withColumn("query_preview", F.substring("query", 1, 255))
        .groupBy("request_id")
        .agg(F.min_by(decided, F.struct("ts_us", F.xxhash64("source", "query_preview", "detected", "confidence"))).alias("d"))
        .select(
            "request_id",
            "d.ts_us",
            "d.source",
            "d.query_preview",
            "d.detected",
            "d.confidence",
            F.when(F.col("d.detected"), "block").otherwise("allow").alias("decision"),
            F.when(F.col("d.detected"), 400).otherwise(200).alias("http_status"),
        )
    )
