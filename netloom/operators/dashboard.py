"""Read models of the dashboard: lists, top lists, rollups, incidents, integrity checks."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.response import normalized_status
from netloom.schema import NORMAL, SECOND

HOUR_US = 3600 * SECOND


def page(df: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in a fixed order with `total_count`, counted apart from the page."""
    total = df.agg(F.count("*")).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total_count", total)


def list_rows(
    df: DataFrame,
    t: str,
    key: str,
    limit: int = 20,
    offset: int = 0,
    start_us: int | None = None,
    end_us: int | None = None,
    min_risk: float | None = None,
    **equal,
) -> DataFrame:
    """Filtered list, newest first. Filters left at None do not apply."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    if start_us is not None:
        df = df.filter(F.col(t) >= start_us)
    if end_us is not None:
        df = df.filter(F.col(t) <= end_us)
    if min_risk is not None:
        df = df.filter(F.col("risk_score") >= min_risk)
    return page(df, [F.desc(t), F.col(key)], limit, offset)


def hour_bucket(t_us) -> Column:
    t = F.col(t_us) if isinstance(t_us, str) else t_us
    return F.date_format(F.timestamp_micros(t), "yyyy-MM-dd HH:00")


def distribution(alerts: DataFrame, label: str = "prediction") -> DataFrame:
    return alerts.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("count"))


def over_time(rows: DataFrame, t: str) -> DataFrame:
    return rows.groupBy(hour_bucket(t).alias("bucket")).agg(F.count("*").alias("count"))


def top_n(rows: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        rows.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), column)
        .limit(n)
    )


def summary(
    alerts: DataFrame, sessions: DataFrame, control: DataFrame, blocks: DataFrame, latest_telemetry: DataFrame, day_start_us: int
) -> DataFrame:
    """The summary counters as one row; each table is read once by its own aggregate."""
    day_end = day_start_us + 24 * HOUR_US

    def count_if(cond: Column) -> Column:
        return F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))

    def today(t: str) -> Column:
        return (F.col(t) >= day_start_us) & (F.col(t) < day_end)

    def one(df: DataFrame, **cols: Column) -> DataFrame:
        return df.agg(F.struct(*[v.alias(k) for k, v in cols.items()]))

    a = one(
        alerts,
        total=F.count("*"),
        today=count_if(today("last_seen_us")),
        high=count_if(F.col("severity") == "high"),
    ).scalar()
    s = one(sessions, total=F.count("*"), active=count_if(F.col("state") == "active")).scalar()
    c = one(
        control,
        blocked=count_if(F.col("current_status") == "blocked"),
        watched=count_if(F.col("current_status") == "watchlisted"),
    ).scalar()
    b = one(
        blocks, today=count_if((normalized_status("action_taken") == "blocked") & today("ts_us"))
    ).scalar()
    row = alerts.sparkSession.range(1).select(a.alias("a"), s.alias("s"), c.alias("c"), b.alias("b"))
    tel = latest_telemetry.select(
        "packet_queue_usage_percent",
        F.col("received_per_window").alias("packets_received_per_30s"),
        F.col("predictions_per_window").alias("ml_predictions_per_30s"),
        "packet_loss_detected",
    )
    t = tel.agg(
        F.struct(*[F.first(c).alias(c) for c in tel.columns])
    ).scalar()
    return row.withColumn("t", t).select(
        F.col("a.total").alias("total_threats"),
        F.col("s.total").alias("total_sessions"),
        F.col("a.today").alias("threats_today"),
        F.col("s.active").alias("active_sessions"),
        F.col("c.blocked").alias("blocked_ips"),
        F.col("b.today").alias("blocked_events_today"),
        F.col("c.watched").alias("watchlisted_ips"),
        F.col("a.high").alias("high_severity_threats"),
        F.coalesce("t.packet_queue_usage_percent", F.lit(0.0)).alias("packet_queue_usage_percent"),
        F.coalesce("t.packets_received_per_30s", F.lit(0)).alias("packets_received_per_30s"),
        F.coalesce("t.ml_predictions_per_30s", F.lit(0)).alias("ml_predictions_per_30s"),
        F.coalesce("t.packet_loss_detected", F.lit(False)).alias("packet_loss_detected"),
        F.lit(0.0).alias("last_ml_prediction_latency_ms"),
    )


def rollup(
    activity: DataFrame, events: DataFrame, blocks: DataFrame, snapshots: DataFrame, hours: int = 48
) -> DataFrame:
    """Hourly totals of traffic, threats, benign events, blocks and telemetry; the last `hours`.

    Every input is reduced to one row per hour; the union of those small tables is then
    grouped once more, which is the outer join of all hours.
    `snapshots` needs `ts_us`, `active_sessions`, `lost`.
    """

    def hour(t: str) -> Column:
        return (F.floor(F.col(t) / F.lit(HOUR_US)) * HOUR_US).cast("bigint").alias("bucket_start_us")

    names = [
        "network_activity_total",
        "threat_event_total",
        "benign_event_total",
        "blocked_event_total",
        "telemetry_snapshot_count",
        "ml_prediction_total",
        "active_sessions_peak",
        "packet_loss_event_total",
    ]
    threat = F.col("prediction") != NORMAL
    block = normalized_status("action_taken") == "blocked"
    parts = [
        activity.groupBy(hour("ts_us")).agg(F.count("*").alias(names[0])),
        events.groupBy(hour("ts_us")).agg(
            F.sum(threat.cast("bigint")).alias(names[1]),
            F.sum((~threat).cast("bigint")).alias(names[2]),
            F.count("*").alias(names[5]),
        ),
        blocks.groupBy(hour("ts_us")).agg(F.sum(block.cast("bigint")).alias(names[3])),
        snapshots.groupBy(hour("ts_us")).agg(
            F.count("*").alias(names[4]),
            F.max("active_sessions").alias(names[6]),
            F.sum(F.col("lost").cast("bigint")).alias(names[7]),
        ),
    ]
    merged = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    out = merged.groupBy("bucket_start_us").agg(*[F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias(n) for n in names])
    rate = F.when(
        F.col(names[0]) > 0, F.round(F.col(names[1]).cast("double") / F.col(names[0]), 4)
    ).otherwise(0.0)
    return (
        out.withColumn("threat_rate", rate)
        .withColumn("bucket_size", F.lit("hour"))
        .orderBy(F.desc("bucket_start_us"))
        .limit(hours)
    )


def model_metrics(scored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Mean confidences, detection rate of the primary model, and precisions.

    The secondary counts as right when the primary also sees an attack; a screening
    decision counts as right when its confidence is at least 0.8.
    """
    p_attack, s_attack = F.col("label") != NORMAL, F.col("shadow_label") != NORMAL

    def ratio(hits: Column, all_: Column) -> Column:
        n = F.sum(all_.cast("bigint"))
        return F.when(n > 0, F.sum((hits & all_).cast("bigint")).cast("double") / n).otherwise(0.0)

    everything = F.lit(True)
    hundred = F.sum(F.round(F.col("confidence") * 100).cast("bigint")).cast("double") / 100 / F.count("*")
    shadow = F.sum(F.round(F.col("shadow_confidence") * 100).cast("bigint")).cast("double") / 100 / F.count("*")
    m = scored.agg(
        F.struct(
            hundred.alias("pc"), ratio(p_attack, everything).alias("pd"), shadow.alias("sc"), ratio(p_attack, s_attack).alias("sp")
        )
    ).scalar()
    d = decisions.agg(
        F.struct(hundred.alias("qc"), ratio(F.col("confidence") >= 0.8, F.col("detected")).alias("qp"))
    ).scalar()
    row = scored.sparkSession.range(1).select(m.alias("m"), d.alias("d"))
    return row.select(
        F.col("m.pc").alias("xgbooster_confidence"),
        F.col("m.pd").alias("xgbooster_detection_rate"),
        F.col("m.sc").alias("decision_tree_confidence"),
        F.col("m.sp").alias("decision_tree_precision"),
        F.col("d.qc").alias("sqli_confidence"),
        F.col("d.qp").alias("sqli_precision"),
    )


def nearest_snapshot(incidents: DataFrame, snapshots: DataFrame, slice_us: int, t: str = "last_seen_us") -> DataFrame:
    """Add the latest snapshot at or before each incident, null if there is none; snapshots may come at any times.

    Incidents and snapshots meet in slices of time, where the last snapshot so far is carried along. An incident without
    one in its slice takes the last of the slices before it, over a table with one row for each slice. Of snapshots at
    the same time the one with the greater hash counts.
    """
    names, far = snapshots.columns, 4096
    shot = F.struct(*names)
    asking = incidents.withColumns({"_slice": F.floor(F.col(t) / F.lit(slice_us)), "_t": F.col(t), "_ask": F.lit(True)})
    shots = snapshots.filter("snapshot_us is not null").select(
        F.floor(F.col("snapshot_us") / F.lit(slice_us)).alias("_slice"), F.col("snapshot_us").alias("_t"), F.lit(False).alias("_ask"), F.struct(F.col("snapshot_us").alias("at"), F.xxhash64(*names).alias("tie"), shot.alias("shot")).alias("_shot")
    )
    both = asking.unionByName(shots, allowMissingColumns=True)
    so_far = Window.partitionBy("_slice").orderBy("_t", "_ask", "_shot.tie").rowsBetween(Window.unboundedPreceding, 0)
    asked = both.withColumn("_near", F.last("_shot", ignorenulls=True).over(so_far)).filter("_ask").drop("_shot", "_t", "_ask")
    order = F.when(F.col("_shot").isNotNull(), F.struct("_shot.at", "_shot.tie"))
    ends = both.groupBy("_slice").agg(F.max_by("_shot", order).alias("_end")).withColumn("_far", F.expr(f"_slice div {far}"))
    before = Window.partitionBy("_far").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    groups = ends.groupBy("_far").agg(F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col("_slice"))).alias("_end"))
    earlier = Window.orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 4096 slices
    groups = groups.select("_far", F.last("_end", ignorenulls=True).over(earlier).alias("_beyond"))
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).join(groups, "_far").select("_slice", "_before", "_beyond")
    found = asked.join(ends, "_slice", "left").withColumn("_found", F.coalesce("_near", "_before", "_beyond"))
    return found.select(*incidents.columns, *(F.col(f"_found.shot.{c}").alias(c) for c in names))


def incident_sessions(alerts: DataFrame, sessions: DataFrame, incident_id: str) -> DataFrame:
    """All session rows of the incident's session."""
    hit = alerts.filter(F.col("event_id") == incident_id)
    return sessions.filter(F.col("session_id") == hit.agg(F.max("session_id")).scalar())


def incident_audit(alerts: DataFrame, blocks: DataFrame, incident_id: str) -> DataFrame:
    """All block events of the incident's session or source."""
    hit = alerts.filter(F.col("event_id") == incident_id)
    session, address = hit.agg(F.max("session_id")).scalar(), hit.agg(F.max("source_ip")).scalar()
    return blocks.filter((F.col("session_id") == session) | (F.col("source_ip") == address))


def incident_detail(alerts: DataFrame, sessions: DataFrame, blocks: DataFrame, snapshots: DataFrame, incident_id: str, slice_us: int) -> DataFrame:
    """One incident with its nearest telemetry, and the numbers of its related sessions and audit rows."""
    hit = alerts.filter(F.col("event_id") == incident_id)
    return nearest_snapshot(hit, snapshots, slice_us).withColumns(
        {
            "session_count": incident_sessions(alerts, sessions, incident_id).agg(F.count("*")).scalar(),
            "audit_count": incident_audit(alerts, blocks, incident_id).agg(F.count("*")).scalar(),
        }
    )


def incident_related(detail: DataFrame, sessions: DataFrame, audit: DataFrame, incident_id: str) -> DataFrame:
    """The incident, its sessions and its audit rows as one long table: all of them, however many."""
    own = F.lit(incident_id).alias("incident_id")
    return (
        detail.select(own, F.lit("incident").alias("kind"), F.col("event_id").alias("ref"), F.col("snapshot_us").alias("at_us"), F.col("prediction").alias("detail"), F.col("received_per_window").alias("n"))
        .unionByName(sessions.select(own, F.lit("session").alias("kind"), F.col("session_id").alias("ref"), F.col("start_time_us").alias("at_us"), F.col("state").alias("detail"), F.col("packet_count").alias("n")))
        .unionByName(audit.select(own, F.lit("audit").alias("kind"), F.col("event_id").alias("ref"), F.col("ts_us").alias("at_us"), F.col("action_taken").alias("detail"), F.lit(None).cast("bigint").alias("n")))
    )


def incident_report(detail: DataFrame, audit: DataFrame) -> DataFrame:
    """The incident as lines of markdown and CSV text.

    Lines are rows, as a busy source has more audit lines than one record should hold: the text of a `part` is its
    lines by `place`, newest first within a place, then by `ref`.
    """
    fields = ["event_id", "prediction", "severity", "source_ip", "destination_ip", "status", "occurrence_count"]
    heads = [
        F.lit("# Incident"), *[F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in fields],
        F.concat(F.lit("- sessions: "), F.col("session_count").cast("string")), F.lit("- audit:"),
    ]
    csv = [F.lit(",".join(fields)), F.to_csv(F.struct(*fields))]
    none = [F.lit(None).cast("bigint").alias("at_us"), F.lit(None).cast("string").alias("ref")]

    def lines(part: str, texts: list) -> DataFrame:
        return detail.select("event_id", F.lit(part).alias("part"), F.posexplode(F.array(*texts)).alias("place", "line")).select("event_id", "part", "place", *none, "line")

    said = F.concat(F.lit("  - "), "action_taken", F.lit(" "), "reason")
    incident = detail.select(F.col("event_id").alias("of"))
    rows = audit.select(F.lit("markdown").alias("part"), F.lit(len(heads)).alias("place"), F.col("ts_us").alias("at_us"), F.col("event_id").alias("ref"), said.alias("line"))
    each = rows.join(F.broadcast(incident)).select(F.col("of").alias("event_id"), "part", "place", "at_us", "ref", "line")  # one incident
    return lines("csv", csv).unionByName(lines("markdown", heads)).unionByName(each)


def orphans(sessions: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows of each table whose session id is set but unknown, counted by table and session."""
    known = sessions.select("session_id").distinct()
    parts = [
        df.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(F.count("*").alias("row_count"))
        .join(known, "session_id", "left_anti")
        .select(F.lit(name).alias("table_name"), "session_id", "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def shadow_pairs(primary: DataFrame, shadow: DataFrame, tol_us: int = SECOND, slice_us: int = 60 * SECOND) -> DataFrame:
    """Agreement of primary and shadow predictions of completed flows, per session.

    Each primary event meets the nearest shadow event of its session, at most `tol_us`
    away (the earlier one on a tie). Inputs need `session_id`, `ts_us`, `prediction`.
    """

    def side(df: DataFrame, mine: bool) -> DataFrame:
        t = F.col("ts_us")
        home = F.floor(t / F.lit(slice_us))
        near = F.sequence(F.floor((t - tol_us) / F.lit(slice_us)), F.floor((t + tol_us) / F.lit(slice_us)))
        s = F.explode(F.array(home) if mine else near)
        return df.select("session_id", t.alias("t"), F.col("prediction").alias("label"), F.lit(mine).alias("mine"), s.alias("_slice"))

    rows = side(primary, True).unionByName(side(shadow, False))
    # Shadow rows come first among equal times, so that an equal time is a match behind.
    w = Window.partitionBy("session_id", "_slice").orderBy("t", "mine")
    other = F.when(~F.col("mine"), F.struct("t", "label"))
    behind = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # The next one is the last of a descending window, which grows with the row; an unbounded frame ahead would be scanned again for each.
    back_w = Window.partitionBy("session_id", "_slice").orderBy(F.desc("t"), F.desc("mine"))
    ahead = F.last(other, ignorenulls=True).over(back_w.rowsBetween(Window.unboundedPreceding, 0))
    back, fore = F.col("t") - F.col("_a.t"), F.col("_z.t") - F.col("t")
    near_back, near_fore = F.coalesce(back <= tol_us, F.lit(False)), F.coalesce(fore <= tol_us, F.lit(False))
    use_back = near_back & (~near_fore | (back <= fore))
    return (
        rows.withColumns({"_a": behind, "_z": ahead})
        .filter("mine")
        .withColumn("_other", F.when(use_back, F.col("_a.label")).when(near_fore, F.col("_z.label")))
        .filter(F.col("_other").isNotNull())
        .groupBy("session_id")
        .agg(F.count("*").alias("pairs"), F.sum((F.col("label") == F.col("_other")).cast("bigint")).alias("agreeing"))
    )
