"""Block requests, their decisions, operator commands, and packets of blocked addresses."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.functions.scalars import block_event_id, mixed_blockable_ip, session_id
from netloom.operators.detectors import bruteforce, heuristic_action, heuristic_decisions
from netloom.plans.greedy_chain import greedy_chain
from netloom.plans.slices import slice_of, with_previous
from netloom.schema import NORMAL, SECOND
from netloom.session import stored

# Block seconds by kind of request, and the order of kinds at one packet.
BLOCK_SECONDS = {"heuristic": 300, "bruteforce": 600, "ml_live": 900, "ml_final": 900}
KIND_ORDER = {"heuristic": 0, "bruteforce": 1, "ml_live": 2, "ml_final": 3}
EVENT_PREFIX = {"heuristic": "heuristic", "bruteforce": "bruteforce", "ml_live": "ml-live", "ml_final": "ml-final"}

#: Commands come before the packets of their moment.
COMMAND_SEQ = -(1 << 62)

_PACKET = ["packet_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"]


def _request(df: DataFrame, kind: Column, attack_type: Column, confidence: Column, score: Column) -> DataFrame:
    order = F.lit(None)
    seconds = F.lit(None)
    for name in KIND_ORDER:
        order = F.when(kind == name, KIND_ORDER[name]).otherwise(order)
        seconds = F.when(kind == name, BLOCK_SECONDS[name]).otherwise(seconds)
    return df.select(
        F.col("src_ip").alias("ip"),
        "t_us",
        (F.col("packet_id") * 4 + order).cast("bigint").alias("seq"),
        kind.alias("kind"),
        seconds.cast("bigint").alias("duration_s"),
        attack_type.alias("attack_type"),
        confidence.cast("double").alias("confidence"),
        score.cast("int").alias("score"),
        *[c for c in _PACKET],
    )


def heuristic_requests(decisions: DataFrame) -> DataFrame:
    high = decisions.filter(heuristic_action() == "high_temp_block")
    confidence = F.least(F.lit(0.99), F.col("score") / F.lit(10.0))
    return _request(high, F.lit("heuristic"), F.lit("Heuristic Suspicious Activity"), confidence, F.col("score"))


def bruteforce_requests(tries: DataFrame) -> DataFrame:
    return _request(
        tries.filter("bruteforce"), F.lit("bruteforce"), F.lit("Brute Force"), F.lit(0.9), F.lit(None)
    )


def ml_requests(scored: DataFrame, threshold: float = 0.8) -> DataFrame:
    sure = scored.filter((F.col("label") != NORMAL) & (F.col("confidence") >= threshold))
    kind = F.when(F.col("is_final"), "ml_final").otherwise("ml_live")
    return _request(sure, kind, F.col("label"), F.col("confidence"), F.lit(None))


def packet_requests(packets: DataFrame) -> DataFrame:
    """Requests of both packet-level detectors."""
    return heuristic_requests(heuristic_decisions(packets)).unionByName(bruteforce_requests(bruteforce(packets)))


def block_decisions(requests: DataFrame, cooldown_s: float = 60, **chain) -> DataFrame:
    """Add `status`, `ok` and `until_us` to block requests, per address in time order.

    Needs `ip`, `t_us`, `seq` (unique), `duration_s`; a boolean column `unblock` marks manual
    releases. The requests are read twice, so pass a stored table where they are costly. A block accepted earlier refuses others for the cooldown, unless it ended
    sooner; a request while the address is still blocked restarts its term.
    """
    cooldown = int(cooldown_s * SECOND)
    frame = requests if "unblock" in requests.columns else requests.withColumn("unblock", F.lit(False))
    term = F.greatest(F.col("duration_s"), F.lit(1)) * SECOND
    t = F.col("t_us")
    frame = frame.withColumns(
        {
            "_until": F.when(F.col("unblock"), t).otherwise(t + term).cast("bigint"),
            "_resume": F.when(F.col("unblock"), t).otherwise(t + F.least(term, F.lit(cooldown))).cast("bigint"),
        }
    )
    good = mixed_blockable_ip("ip")
    # The chosen requests are few (one per address and cooldown); all others stay where they are.
    took = greedy_chain(
        frame.filter(good), ["ip"], cooldown, tie="seq", resume="_resume", hold="_until", reset="unblock", **chain
    ).select("ip", "seq", "hold_before", F.lit(True).alias("chosen"))
    decided = frame.join(took, ["ip", "seq"], "left").withColumn(
        "status",
        F.when(~good, "invalid_or_loopback_ip")
        .when(F.col("unblock"), "unblocked")
        .when(F.col("chosen").isNull(), "cooldown_active")
        .when(F.col("hold_before") > t, "already_blocked")
        .otherwise("blocked"),
    ).drop("chosen", "hold_before")
    return (
        decided.withColumn("ok", F.col("status").isin("blocked", "already_blocked", "unblocked"))
        .withColumn("until_us", F.when(F.col("status").isin("blocked", "already_blocked"), F.col("_until")))
        .drop("_until", "_resume", "unblock")
    )


def _accepted(decisions: DataFrame) -> DataFrame:
    """Accepted changes of each address with the time of the next; at most one block per cooldown."""
    by_ip = Window.partitionBy("ip").orderBy("t_us", "seq")
    return (
        decisions.filter("ok")
        .withColumn("next_us", F.lead("t_us").over(by_ip))
        .withColumn("next_seq", F.lead("seq").over(by_ip))
        .withColumn(
            "times_blocked",
            F.sum((F.col("status") == "blocked").cast("int")).over(by_ip.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )


def block_log(decisions: DataFrame, cutoff) -> DataFrame:
    """Record of state changes: accepted requests, manual releases, and expiries up to `cutoff`."""
    acc = _accepted(decisions)
    changes = acc.select(
        "ip",
        F.col("t_us").alias("at_us"),
        "status",
        F.when(F.col("status") == "unblocked", F.lit(0)).otherwise(F.col("duration_s")).cast("bigint").alias("duration_s"),
        "until_us",
        F.col("times_blocked").cast("bigint").alias("times_blocked"),
        (F.col("status") == "unblocked").alias("manual"),
    )
    expired = acc.filter(F.col("until_us") <= F.coalesce("next_us", cutoff)).select(
        "ip",
        F.col("until_us").alias("at_us"),
        F.lit("unblocked").alias("status"),
        F.lit(0).cast("bigint").alias("duration_s"),
        F.lit(None).cast("bigint").alias("until_us"),
        F.col("times_blocked").cast("bigint").alias("times_blocked"),
        F.lit(False).alias("manual"),
    )
    return changes.unionByName(expired).withColumn(
        "current_status", F.when(F.col("duration_s") > 0, "blocked").otherwise("unblocked")
    )


def block_intervals(decisions: DataFrame) -> DataFrame:
    """Disjoint spans in which an address is blocked, bounded by the next change."""
    return _accepted(decisions).filter(F.col("until_us").isNotNull()).select(
        "ip", F.col("t_us").alias("from_us"), F.col("seq").alias("from_seq"), "until_us", "next_us", "next_seq"
    )


def flag_blocked_packets(packets: DataFrame, intervals: DataFrame, slice_s: float = 60) -> DataFrame:
    """Packets whose source was already blocked (or watch-listed) on arrival.

    Both sides meet on (address, time slice), which spreads one hot address.
    """
    width = int(slice_s * SECOND)
    spans = intervals.withColumn(
        "_slice",
        F.explode(F.sequence(slice_of("from_us", width), slice_of(F.least("until_us", F.coalesce("next_us", "until_us")), width))),
    )
    p = packets.withColumn("_slice", slice_of("t_us", width)).withColumn("_first_seq", F.col("packet_id") * 4)
    inside = (
        (p["src_ip"] == spans["ip"])
        & (p["_slice"] == spans["_slice"])
        & (p["t_us"] < spans["until_us"])
        & ((p["t_us"] > spans["from_us"]) | ((p["t_us"] == spans["from_us"]) & (p["_first_seq"] > spans["from_seq"])))
        & (
            spans["next_us"].isNull()
            | (p["t_us"] < spans["next_us"])
            | ((p["t_us"] == spans["next_us"]) & (p["_first_seq"] <= spans["next_seq"]))
        )
    )
    return p.join(spans, inside, "left_semi").drop("_slice", "_first_seq")


def _checked_commands(commands: DataFrame) -> DataFrame:
    """Commands with trimmed fields, `_broken` (their own fault) and `_ident` (null for a blank id, which is never a copy)."""
    c = commands.select(
        F.trim(F.coalesce("command_id", F.lit(""))).alias("command_id"),
        F.lower(F.trim(F.coalesce("action", F.lit("")))).alias("action"),
        F.trim(F.coalesce("ip_address", F.lit(""))).alias("ip"),
        F.greatest(F.coalesce(F.nullif(F.col("duration_seconds"), F.lit(0)), F.lit(300)), F.lit(1)).alias("duration_s"),
        "t_us",
        "seq",
    )
    known = F.col("action").isin("block", "unblock", "watchlist", "unwatchlist")
    blank = (F.col("action") == "") | (F.col("ip") == "")
    broken = (
        F.when(blank, "invalid_command")
        .when(~known, "unsupported_action")
        .when(F.col("action") == "unwatchlist", F.lit(None))
        .when(~mixed_blockable_ip("ip"), "invalid_or_loopback_ip")
    )
    ident = F.when(F.col("command_id") != "", F.col("command_id"))
    return c.withColumns({"_broken": broken, "_ident": ident, "_blank": blank})


#: What names a part of an address' time line: its kind, and the sure reset with which it begins.
_PART = ["watch", "ip", "from_us", "from_seq"]


def _in_parts(line: DataFrame, slice_us: int = 60 * SECOND) -> DataFrame:
    """Add `from_us` and `from_seq`: the last row with `resets` at or before each row of the same kind and address."""
    at, keys = F.struct("t_us", "seq"), ["watch", "ip", "_slice"]
    reset = F.when(F.col("resets"), at)
    rows = line.withColumn("_slice", slice_of("t_us", slice_us))
    inside = Window.partitionBy(*keys).orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("watch", "ip").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys).agg(F.max(reset).alias("_m")).withColumn("_carried", F.last("_m", ignorenulls=True).over(earlier)).drop("_m")
    rows = rows.withColumn("_own", F.last(reset, ignorenulls=True).over(inside)).join(carried, keys)
    since, never = F.coalesce("_own", "_carried"), F.lit(-(1 << 63)).cast("bigint")
    return rows.withColumns({"from_us": F.coalesce(since["t_us"], never), "from_seq": F.coalesce(since["seq"], never)}).drop("_slice", "_own", "_carried")


_KEPT = [*_PART, "t_us", "seq", "command", "_ident"]


def _walk(rows: DataFrame, remember: bool, chunk_us: int) -> DataFrame:
    """Rows that succeed, row by row: an address and the parts that begin in one chunk of time share a task, in order of time.

    A part begins anew, and its state is two times or one flag. With `remember`, ids that succeeded in the chunk are kept,
    and what repeats them comes out with the status `copy`.
    """
    keys = ["ip", "_chunk"]
    line = rows.withColumn("_chunk", slice_of("from_us", chunk_us)).select(*_KEPT, "release", "listed", "_until", "_resume", "_chunk")
    line = line.repartition(*keys).sortWithinPartitions(*keys, "t_us", "seq")
    schema = T.StructType([*[f for f in line.schema.fields if f.name in _KEPT], T.StructField("status", T.StringType())])
    kept = list(_KEPT)

    def values(column: pa.Array) -> list:
        text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
        return column.to_pylist() if text or column.null_count else column.to_numpy(zero_copy_only=False).tolist()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen, part, watched, listing, ready, hold = None, set(), None, None, False, 0, 0
        for batch in batches:
            columns = [values(batch.column(k)) for k in ("ip", "_chunk", "watch", "from_us", "from_seq", "t_us", "release", "listed", "_ident", "_until", "_resume")]
            picked, status = [], []
            for i, (ip, chunk, watch, us, seq, t, release, listed, ident, until, resume) in enumerate(zip(*columns, strict=True)):
                if group != (ip, chunk):
                    group, seen, part, watched = (ip, chunk), set(), None, None
                if watch and watched != (us, seq):
                    watched, listing = (us, seq), False
                elif not watch and part != (us, seq):
                    part, ready, hold = (us, seq), t, t
                if ident is not None and ident in seen:
                    picked.append(i)
                    status.append("copy")
                    continue
                if watch:
                    took = "watchlisted" if listed else "unwatchlisted" if listing else None
                    listing = listed
                else:
                    took = "unblocked" if release else None if t < ready else "already_blocked" if hold > t else "blocked"
                    if took:
                        ready, hold = resume, until
                if took:
                    picked.append(i)
                    status.append(took)
                    if remember and ident is not None:
                        seen.add(ident)
            out = batch.select(kept).take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(status, pa.string())], names=[*kept, "status"])

    return line.mapInArrow(walk, schema)


def _fold(line: DataFrame, cooldown_s: float, long_parts: DataFrame | None, remember: bool, chunk_us: int) -> DataFrame:
    """The rows that succeed, with their `status`; all other blocks meet a cooldown, all other entries no watch-list.

    Parts are walked, many in a task; `long_parts`, which may hold most rows of an address, go through `greedy_chain` and windows.
    """
    cooldown, t = int(cooldown_s * SECOND), F.col("t_us")
    term = F.greatest(F.col("duration_s"), F.lit(1)) * SECOND
    rows = line.withColumns(
        {
            "_until": F.when(F.col("release"), t).otherwise(t + term).cast("bigint"),
            "_resume": F.when(F.col("release"), t).otherwise(t + F.least(term, F.lit(cooldown))).cast("bigint"),
        }
    )
    if long_parts is None:
        return _walk(rows, remember, chunk_us)
    long_rows = rows.join(long_parts, _PART, "left_semi")
    watches = with_previous(long_rows.filter("watch"), ["ip"], F.col("listed"), "_listed", 3600 * SECOND, tie="seq")
    # The row that begins a part needs none before it, and no row looks beyond it.
    watches = watches.filter(F.col("listed") | F.col("_listed")).withColumn("status", F.when(F.col("listed"), "watchlisted").otherwise("unwatchlisted"))
    watches = watches.select(*_KEPT, "status")
    chained = long_rows.filter(~F.col("watch"))
    took = greedy_chain(
        chained, ["ip"], cooldown, tie="seq", resume="_resume", hold="_until", reset="release", within=("from_us", "from_seq")
    ).select("ip", "seq", "hold_before")
    status = F.when(F.col("release"), "unblocked").when(F.col("hold_before") > t, "already_blocked").otherwise("blocked")
    chained = chained.join(took, ["ip", "seq"]).withColumn("status", status).select(*_KEPT, "status")
    return _walk(rows.join(long_parts, _PART, "left_anti"), remember, chunk_us).unionByName(chained).unionByName(watches)


def settle(commands: DataFrame, requests: DataFrame | None = None, cooldown_s: float = 60, long_rows: int = 1_000_000, chunk_s: float = 900) -> tuple[DataFrame, DataFrame]:
    """Outcome of each operator command, and of each block request, in one order of time per address.

    `requests` are those of all detectors and models; they are read twice. Commands come before the packets of their
    moment. Returns the commands with `ok` and `status`, and the decisions of `block_decisions` over requests and block
    commands (kind `command`, `seq` shifted by `COMMAND_SEQ`); store them where they have several consumers.

    A delivery whose id succeeded before is acknowledged as a duplicate, whatever it asks for. An id that was refused is
    remembered by nobody: its next delivery is applied. Which deliveries are applied thus depends on what succeeded
    before them, and that on which were applied: the first successes are found again until they no longer change. Each
    round is right at least up to the first wrong one of the round before.

    A release, or an entry in the watch-list, that is the first delivery of its id succeeds whatever came before, and
    what follows depends on nothing before it. Such rows cut the line of an address into parts, and a round only folds
    the parts again in which a delivery became a copy or ceased to be one. The first fold already remembers the ids that
    succeeded at the same address within a chunk of `chunk_s`, so that rounds are left to ids that come again later or at
    another address. Parts of more than `long_rows` rows are not walked by one task.
    """
    at, usable = F.struct("t_us", "seq"), F.col("_broken").isNull()
    # Releases and entries in the watch-list always succeed: what repeats their ids later is known as a duplicate at once.
    always = F.col("action").isin("unblock", "watchlist")
    c = _checked_commands(commands).withColumn("seq", F.col("seq") + COMMAND_SEQ)
    named = c.filter("_ident is not null")
    facts = named.groupBy("_ident").agg(
        F.min(F.when(usable & always, at)).alias("_sure"), F.min(F.when(usable, at)).alias("_earliest"), F.count("*").alias("_n")
    )
    nothing = [F.lit(None).cast("struct<t_us:bigint,seq:bigint>").alias(k) for k in ("_sure", "_earliest")]
    c = c.filter("_ident is null").select("*", *nothing, F.lit(1).cast("bigint").alias("_n")).unionByName(named.join(facts, "_ident").select(*c.columns, "_sure", "_earliest", "_n"))
    # An id that came once needs no memory.
    c = stored(c.withColumn("_ident", F.when(F.col("_n") > 1, F.col("_ident"))).drop("_n"), "commands")
    later = F.coalesce(F.col("_ident").isNotNull() & (at > F.col("_earliest")), F.lit(False))
    line = c.filter(usable & (F.col("_sure").isNull() | (at <= F.col("_sure")))).select(
        "ip", "t_us", "seq", "duration_s", F.lit(True).alias("command"), F.col("action").isin("watchlist", "unwatchlist").alias("watch"),
        (F.col("action") == "unblock").alias("release"), (F.col("action") == "watchlist").alias("listed"), "_ident", later.alias("later"),
        (always & ~later).alias("resets"),
    )
    c = c.drop("_sure", "_earliest")
    if requests is not None:
        no, good = F.lit(False), requests.filter(mixed_blockable_ip("ip"))
        line = line.unionByName(good.select(
            "ip", "t_us", "seq", "duration_s", *[no.alias(k) for k in ("command", "watch", "release", "listed", "later", "resets")], F.lit(None).cast("string").alias("_ident"),
        ))
    line = stored(_in_parts(line), "block-line")
    long_parts = stored(line.groupBy(*_PART).count().filter(F.col("count") > long_rows).select(*_PART), "long-parts")
    long_parts = None if long_parts.isEmpty() else long_parts
    # Only parts with a later delivery can change, and only ids that came again are looked up: rounds read no more of the outcomes.
    later = stored(line.filter("later").select(*_PART, "t_us", "seq", "_ident"), "later-deliveries")
    chunk_us = int(chunk_s * SECOND)
    done = stored(_fold(line, cooldown_s, long_parts, True, chunk_us), "outcomes")
    hits = stored(done.filter(F.col("_ident").isNotNull()).select(*_PART, "t_us", "seq", "_ident", "status"), "repeated-ids")
    skipped = hits.filter("status = 'copy'").select("seq", F.lit(True).alias("_was"))
    done, hits = done.filter("status <> 'copy'"), hits.filter("status <> 'copy'").drop("status")

    def successes(hits: DataFrame) -> DataFrame:
        return stored(hits.groupBy("_ident").agg(F.min(at).alias("_first")), "first-successes")

    def copies(name: str) -> Column:
        return F.coalesce(at > F.col(name), F.lit(False))

    first, old, touched, redone = successes(hits), None, None, None
    while True:
        seen = later.join(first, "_ident", "left")
        if old is None:
            seen = seen.join(skipped, "seq", "left").withColumn("_was", F.coalesce("_was", F.lit(False)))
        else:
            seen = seen.join(old.withColumnRenamed("_first", "_old"), "_ident", "left").withColumn("_was", copies("_old"))
        parts = stored(seen.filter(copies("_first") != F.col("_was")).select(*_PART).distinct(), "moved-parts")
        if parts.isEmpty():
            break
        again = stored(line.join(parts, _PART, "left_semi"), "moved-line")
        applied = again.filter("later").join(first, "_ident", "left").filter(~copies("_first")).drop("_first")
        again = _fold(again.filter(~F.col("later")).unionByName(applied), cooldown_s, long_parts, False, chunk_us)
        redone = stored(again if redone is None else redone.join(parts, _PART, "left_anti").unionByName(again), "outcomes-again")
        touched = parts if touched is None else stored(touched.unionByName(parts).distinct(), "touched-parts")
        kept = hits.join(touched, _PART, "left_anti").unionByName(redone.filter(F.col("_ident").isNotNull()).select(*hits.columns))
        first, old = successes(kept), first
    if touched is not None:
        done = done.join(touched, _PART, "left_anti").unionByName(redone)

    copy = ~F.col("_blank") & copies("_first")
    refused = F.when(F.col("action") == "block", "cooldown_active").when(F.col("action") == "unwatchlist", "not_watchlisted")
    # Most rows have no id to look up: they stay out of the join, where their nulls would meet in one task.
    known = c.filter("_ident is not null").join(first, "_ident", "left").select(*c.columns, "_first")
    known = known.unionByName(c.filter("_ident is null").withColumn("_first", F.lit(None).cast(first.schema["_first"].dataType)))
    out = known.join(done.filter("command").select("seq", F.col("status").alias("_outcome")), "seq", "left").withColumn("_copy", copy)
    status = F.when(F.col("_copy"), "duplicate_command").otherwise(F.coalesce("_broken", "_outcome", refused))
    out = out.withColumns({"status": status, "ok": F.col("_copy") | F.col("_outcome").isNotNull()})
    until = F.when(F.col("status").isin("blocked", "already_blocked"), F.col("t_us") + F.greatest(F.col("duration_s"), F.lit(1)) * SECOND)
    decided = out.filter(F.col("_broken").isNull() & ~F.col("_copy") & F.col("action").isin("block", "unblock")).select(
        "ip", "t_us", "seq", F.lit("command").alias("kind"), "duration_s", "status", "ok"
    )
    if requests is not None:
        took = done.filter(~F.col("command")).select("ip", "seq", F.col("status").alias("_outcome"))
        status = F.when(~mixed_blockable_ip("ip"), "invalid_or_loopback_ip").otherwise(F.coalesce("_outcome", F.lit("cooldown_active")))
        auto = requests.join(took, ["ip", "seq"], "left").withColumns({"status": status, "ok": F.col("_outcome").isNotNull()}).drop("_outcome")
        decided = decided.unionByName(auto, allowMissingColumns=True)
    statuses = out.select("command_id", "action", "ip", "duration_s", "t_us", (F.col("seq") - COMMAND_SEQ).alias("seq"), "ok", "status")
    return statuses, decided.withColumn("until_us", until)


def command_status(commands: DataFrame, cooldown_s: float = 60) -> DataFrame:
    """Outcome of each operator command, where no detector asks for blocks."""
    return settle(commands, None, cooldown_s)[0]


def watch_intervals(statuses: DataFrame, until: Column) -> DataFrame:
    """Spans in which an address is watch-listed, up to `until` where it stays so; as `block_intervals`."""
    by_ip = Window.partitionBy("ip").orderBy("t_us", "seq")
    took = statuses.filter(F.col("status").isin("watchlisted", "unwatchlisted") & F.col("ok"))
    return (
        took.select("ip", F.col("t_us").alias("from_us"), (F.col("seq") + COMMAND_SEQ).alias("from_seq"), "status", F.lead("t_us").over(by_ip).alias("next_us"), (F.lead("seq").over(by_ip) + COMMAND_SEQ).alias("next_seq"))
        .filter(F.col("status") == "watchlisted")
        .withColumn("until_us", F.coalesce(F.col("next_us") + 1, until + 1))
        .filter(F.col("from_us") < F.col("until_us"))
        .drop("status")
    )


def command_block_events(statuses: DataFrame) -> DataFrame:
    """Block-event records of commands that took effect."""
    took = statuses.filter(F.col("ok") & (F.col("status") != "duplicate_command"))
    # Action -> recorded action.
    mapped = (
        F.when(F.col("action") == "unblock", "unblocked")
        .when(F.col("action") == "watchlist", "watchlisted")
        .when(F.col("action") == "unwatchlist", "unwatchlisted")
        .otherwise("blocked")
    )
    nothing = F.lit(None)
    return took.select(
        F.concat(
            F.lit("cmd-"),
            F.when(F.col("command_id") != "", F.col("command_id")).otherwise(F.concat_ws("-", "ip", "action")),
        ).alias("event_id"),
        F.col("t_us").alias("ts_us"),
        F.col("ip").alias("source_ip"),
        mapped.alias("action_taken"),
        F.concat(F.lit("manual_"), F.col("action")).alias("reason"),
        F.lit("manual").alias("detection_method"),
        nothing.cast("string").alias("session_id"),
        nothing.cast("bigint").alias("source_port"),
        nothing.cast("string").alias("destination_ip"),
        nothing.cast("bigint").alias("destination_port"),
        nothing.cast("int").alias("protocol"),
        F.when(F.col("action") == "block", F.col("t_us") + F.col("duration_s") * SECOND).alias("expires_us"),
    )


def request_block_events(decisions: DataFrame) -> DataFrame:
    """Block-event records of accepted requests of detectors and models."""
    took = decisions.filter(F.col("ok") & F.col("kind").isin(*EVENT_PREFIX))
    event, reason, method = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, prefix in EVENT_PREFIX.items():
        here = F.col("kind") == kind
        event = F.when(here, block_event_id(prefix, "ip", "t_us")).otherwise(event)
    reason = (
        F.when(F.col("kind") == "heuristic", "heuristic_high_confidence")
        .when(F.col("kind") == "bruteforce", "bruteforce_detected")
        .otherwise(F.col("attack_type"))
    )
    method = F.when(F.col("kind").startswith("ml"), "ml").otherwise("heuristic")
    return took.select(
        event.alias("event_id"),
        F.col("t_us").alias("ts_us"),
        F.col("ip").alias("source_ip"),
        F.lit("blocked").alias("action_taken"),
        reason.alias("reason"),
        method.alias("detection_method"),
        session_id().alias("session_id"),
        F.col("src_port").alias("source_port"),
        F.col("dst_ip").alias("destination_ip"),
        F.col("dst_port").alias("destination_port"),
        "protocol",
        F.col("until_us").alias("expires_us"),
    )


def normalized_status(action) -> Column:
    """Both spellings of recorded actions."""
    a = F.lower(F.col(action) if isinstance(action, str) else action)
    return F.when(a == "block", "blocked").when(a == "watchlist", "watchlisted").when(a == "unblock", "unblocked").otherwise(a)


def ip_control_state(block_events: DataFrame) -> DataFrame:
    """Latest status of each address with its first block and last references."""
    at = F.struct("ts_us", "event_id")
    status = normalized_status("action_taken")
    return (
        block_events.withColumn("_status", status)
        .groupBy(F.col("source_ip").alias("ip_address"))
        .agg(
            F.max_by(F.struct("_status", "reason", "detection_method", "expires_us", "event_id", "session_id", "ts_us"), at).alias("l"),
            F.min(F.when(F.col("_status") == "blocked", F.col("ts_us"))).alias("first_blocked_us"),
        )
        .select(
            "ip_address",
            F.col("l._status").alias("current_status"),
            F.col("l.detection_method").alias("control_source"),
            F.col("l.reason").alias("reason"),
            "first_blocked_us",
            F.col("l.ts_us").alias("last_changed_us"),
            F.when(F.col("l._status") == "blocked", F.col("l.expires_us")).alias("expires_us"),
            F.col("l.event_id").alias("last_block_event_id"),
            F.col("l.session_id").alias("last_session_id"),
        )
    )


def blocked_ip_summary(block_events: DataFrame, status: str | None = None) -> DataFrame:
    """Per address: status, reason, first and last time, attempts, kinds, last action, source."""
    at = F.struct("ts_us", "event_id")
    out = (
        block_events.withColumn("_status", normalized_status("action_taken"))
        .groupBy(F.col("source_ip").alias("ip_address"))
        .agg(
            F.max_by(F.struct("_status", "reason", "detection_method", "action_taken"), at).alias("l"),
            F.min("ts_us").alias("first_detected_us"),
            F.max("ts_us").alias("last_detected_us"),
            F.count("*").alias("total_attempts"),
            F.array_sort(F.collect_set("reason")).alias("attack_types"),
        )
        .select(
            "ip_address",
            F.col("l._status").alias("status"),
            F.col("l.reason").alias("reason"),
            "first_detected_us",
            "last_detected_us",
            "total_attempts",
            "attack_types",
            F.col("l.action_taken").alias("last_action"),
            F.col("l.detection_method").alias("source"),
        )
    )
    return out if status is None else out.filter(F.col("status") == status)


def ip_block_history(block_events: DataFrame, ip: str) -> DataFrame:
    return block_events.filter(F.col("source_ip") == ip).orderBy(F.desc("ts_us"), "event_id")


def respond(table: DataFrame, updates: DataFrame, key: str, action_col: str, state_col: str, state_default) -> DataFrame:
    """Apply the latest operator response to each row of a threat or session table.

    `updates` has the key, `new_action`, `new_state` (may be null) and `at_us`.
    """
    latest = updates.groupBy(key).agg(
        F.max_by(F.struct("new_action", "new_state"), F.struct("at_us", "new_action", "new_state")).alias("_u")
    )
    default = state_default if isinstance(state_default, Column) else F.lit(state_default)
    hit = F.col("_u").isNotNull()
    return (
        table.join(latest, key, "left")
        .withColumn(state_col, F.when(hit, F.coalesce("_u.new_state", default)).otherwise(F.col(state_col)))
        .withColumn(action_col, F.when(hit, F.col("_u.new_action")).otherwise(F.col(action_col)))
        .drop("_u")
    )
