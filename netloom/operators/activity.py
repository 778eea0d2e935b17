"""Activity of addresses: the feed of all producers and the record per address."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.plans.slices import slice_of
from netloom.schema import SECOND


def _entries(df: DataFrame, ip, t, tie, attack_type, action) -> DataFrame:
    return df.select(
        F.col(ip).alias("ip"), F.col(t).alias("t_us"), tie.cast("bigint").alias("tie"), attack_type.alias("attack_type"), action.alias("action")
    )


def activity_feed(
    decisions: DataFrame,
    requests: DataFrame,
    log: DataFrame,
    blocked_packets: DataFrame | None = None,
    commands: DataFrame | None = None,
    watched_packets: DataFrame | None = None,
) -> DataFrame:
    """All producers as (ip, t_us, tie, attack_type, action).

    `decisions` are heuristic decisions per packet, `requests` decided block requests,
    `log` the block log with its manual releases, `commands` the outcomes of operator commands.
    """
    outcome = F.when(F.col("ok"), "blocked").otherwise("allowed")
    of_log = (
        F.when(F.col("status") == "blocked", "block_action")
        .when(F.col("status") == "already_blocked", "already_blocked_activity")
        .when(F.col("manual"), "manual_unblock")
        .otherwise("unblock_action")
    )
    feed = _entries(
        decisions.filter("suspicious"), "src_ip", "t_us", F.col("packet_id"), F.col("reason"), F.lit("allowed")
    )
    feed = feed.unionByName(
        _entries(requests.filter(~F.col("kind").isin("heuristic", "command")), "ip", "t_us", F.col("packet_id"), F.col("attack_type"), outcome)
    ).unionByName(
        _entries(log, "ip", "at_us", F.lit(-1), of_log, F.when(F.col("duration_s") > 0, "blocked").otherwise("unblocked"))
    )
    if blocked_packets is not None:
        feed = feed.unionByName(
            _entries(blocked_packets, "src_ip", "t_us", F.col("packet_id"), F.lit("blocked_ip_activity"), F.lit("blocked"))
        )
    if watched_packets is not None:
        feed = feed.unionByName(
            _entries(watched_packets, "src_ip", "t_us", F.col("packet_id"), F.lit("watchlisted_ip_activity"), F.lit("watchlisted"))
        )
    if commands is not None:
        watch = commands.filter("ok").filter(F.col("status").isin("watchlisted", "unwatchlisted"))
        feed = feed.unionByName(
            _entries(watch, "ip", "t_us", F.col("seq"), F.lit("watchlist_action"), F.col("status"))
        )
    return feed


def ip_activity(feed: DataFrame, history: int = 25) -> DataFrame:
    """Per address: first and last time, attempts, sorted kinds, the last `history` actions.

    The history is ranked first, so that every task passes on at most `history` rows of
    an address.
    """
    recent = Window.partitionBy("ip").orderBy(F.desc("t_us"), F.desc("tie"), F.desc("attack_type"), F.desc("action"))
    last = (
        feed.withColumn("_rank", F.row_number().over(recent))
        .filter(F.col("_rank") <= history)
        .groupBy("ip")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_rank")).alias("o"), "t_us", "action", "attack_type"))).alias("_h"))
        .select("ip", F.transform("_h", lambda e: F.struct(e["t_us"].alias("t_us"), e["action"].alias("action"), e["attack_type"].alias("attack_type"))).alias("action_history"))
    )
    totals = feed.groupBy("ip").agg(
        F.min("t_us").alias("first_detected_us"),
        F.max("t_us").alias("last_detected_us"),
        F.count("*").alias("total_attack_attempts"),
        F.array_sort(F.collect_set("attack_type")).alias("attack_types_used"),
    )
    return totals.withColumn("attempt_pattern", _pattern()).join(last, "ip")


def _pattern() -> Column:
    return F.when(F.col("total_attack_attempts") > 1, "repeated_attempts").otherwise("single_attempt")


def running_activity(feed: DataFrame, history: int = 25, slice_us: int = 60 * SECOND) -> DataFrame:
    """One record per activity: what is known of its address at that moment, itself included.

    Activities of an address follow each other by time, tie, kind and action; equal ones count each. Those without an
    address are left out. An address is cut into slices of time. Counts, kinds and the last actions run inside a slice;
    a table with one row per (address, slice) carries what earlier slices held: their count, the kinds first seen there
    and their last `history` actions, which lie in the last `history` slices.
    """
    keyed = feed.filter(F.col("ip") != "").withColumn("_slice", slice_of("t_us", slice_us))
    inside = Window.partitionBy("ip", "_slice").orderBy("t_us", "tie", "attack_type", "action")
    entry = F.struct("t_us", "action", "attack_type")
    rows = keyed.select(
        "ip", "_slice", "t_us",
        F.row_number().over(inside).alias("_n"),
        F.collect_set("attack_type").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_kinds"),
        F.collect_list(entry).over(inside.rowsBetween(1 - history, 0)).alias("_last"),
    )
    ends = rows.groupBy("ip", "_slice").agg(
        F.max("_n").alias("_rows"), F.min("t_us").alias("_first"), F.max_by(F.struct("_kinds", "_last"), "_n").alias("_end")
    )
    sighted = ends.select("ip", "_slice", F.explode("_end._kinds").alias("kind")).groupBy("ip", "kind").agg(F.min("_slice").alias("since"))
    kinds = sighted.groupBy("ip").agg(F.collect_list(F.struct("since", "kind")).alias("_seen"))
    along = Window.partitionBy("ip").orderBy("_slice")
    carried = ends.select(
        "ip", "_slice",
        F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.min("_first").over(along).alias("first_detected_us"),
        F.flatten(F.collect_list("_end._last").over(along.rowsBetween(-history, -1))).alias("_earlier"),
    ).join(kinds, "ip", "left")
    carried = carried.withColumn(
        "_known", F.transform(F.filter(F.coalesce("_seen", F.array()), lambda s: s["since"] < F.col("_slice")), lambda s: s["kind"])
    ).withColumn("_earlier", _newest("_earlier", history))
    out = rows.join(carried.drop("_seen"), ["ip", "_slice"]).select(
        "ip",
        "first_detected_us",
        F.col("t_us").alias("last_detected_us"),
        (F.col("_before") + F.col("_n")).alias("total_attack_attempts"),
        F.array_sort(F.array_union("_known", "_kinds")).alias("attack_types_used"),
        F.concat("_earlier", "_last").alias("action_history"),
    )
    return out.select(
        "ip", "first_detected_us", "last_detected_us", "total_attack_attempts", "attack_types_used",
        _pattern().alias("attempt_pattern"), _newest("action_history", history).alias("action_history"),
    )


def _newest(name: str, n: int) -> Column:
    return F.when(F.size(name) > n, F.slice(name, -n, n)).otherwise(F.col(name))


def latest_tracked(activity: DataFrame, keep: int = 10_000) -> DataFrame:
    return activity.orderBy(F.desc("last_detected_us"), "ip").limit(keep)
