"""Conversation repair: weighted CYK parsing of row intervals with a grammar of edits.

A good conversation's role initials are `(s?(ua)+)?`. In Chomsky normal form the grammar has a symbol X(p, q) for each
pair of the four positions in that pattern (nothing yet, after s, after u, after a), rules X(p, q) -> X(p, r) X(r, q),
and terminal rules for one row kept, given another role or deleted. A cell of an interval of rows holds, for each symbol,
the least (cost, audit), where the audit is the initials of the edits in order. Cells are closed under insertion: an
inserted row moves on in the pattern without a row.

Intervals are combined bottom-up by length: rows, then pairs of them, and so on. Each derivation of an interval passes one
position of the pattern at any split, and equally cheap audits of one interval are never prefixes of each other, so one
split of each interval gives its cell, and long conversations need no triangle of cells.

A conversation is cut into pieces of at most `piece` rows. Pieces are parsed on their own, their cells combined in groups
of `fan` level by level, and the audit of the whole is cut at the same places to write the repaired rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import batches, prepare, read, stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Steps of the pattern: position -> {role initial: next position}.
STEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
WRITABLE = {"u": "user", "a": "assistant"}
#: The symbols of the grammar: from a position only the later ones are in reach, but for the loop of u and a.
SYMBOLS = [(p, q) for p in range(4) for q in range(4) if p == q or (q >= 2 or (p, q) == (0, 1))]
RULES = [(p, r, q) for p, r in SYMBOLS for r2, q in SYMBOLS if r == r2 and (p, q) in SYMBOLS]

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent intervals: the least (cost, audit) over all binary rules."""
    out: Cell = {}
    for p, r, q in RULES:
        a, b = left.get((p, r)), right.get((r, q))
        if a is not None and b is not None:
            cost, best = a[0] + b[0], out.get((p, q))
            if best is None or cost < best[0] or (cost == best[0] and a[1] + b[1] < best[1]):
                out[p, q] = (cost, a[1] + b[1])
    return out


def insertions() -> Cell:
    """The cell of no rows: what inserted rows alone derive."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(2):
        for p, steps in STEPS.items():
            for initial, q in steps.items():
                if initial in WRITABLE:
                    for (o, p2), (cost, audit) in list(cell.items()):
                        if p2 == p and (cost + INSERT_COST, audit + INSERT) < cell.get((o, q), (99, "")):
                            cell[o, q] = (cost + INSERT_COST, audit + INSERT)
    return cell


NONE = insertions()


def row_cell(initial: str, fault: str | None) -> Cell:
    """The cell of one row, closed under insertion on both sides."""
    cell: Cell = {(p, p): (DELETE_COST, DELETE) for p in range(4)}
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED_COST if fault == "truncated" else 0
        for p, steps in STEPS.items():
            for to, q in steps.items():
                options = [(extra, KEEP)] if to == initial else []
                if to in WRITABLE:
                    options.append((REROLE_COST + extra, REROLE))
                if options:
                    cell[p, q] = min([*options, cell.get((p, q), (99, ""))])
    return combine(combine(NONE, cell), NONE)


def parse(cells: list[Cell]) -> Cell:
    """The cell of adjacent intervals, combined bottom-up by length."""
    while len(cells) > 1:
        cells = [combine(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0] if cells else NONE


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[0, q] for q in ENDS if (0, q) in cell)


def apply(audit: str, rows: list[tuple[str, str]], written: int, first_s: bool) -> tuple[list[tuple[str, str]], int]:
    """The repaired rows that an audit makes of rows, after `written` rows of the conversation; and how many are written then."""
    out, at = [], 0
    for edit in audit:
        wanted = WRITABLE["u" if (written - first_s) % 2 == 0 else "a"]
        if edit == INSERT:
            out.append((wanted, ""))
            written += 1
            continue
        role, text = rows[at]
        at += 1
        if edit != DELETE:
            out.append((role if edit == KEEP else wanted, text))
            written += 1
    return out, written


def conv_key(column: str = "conv_id") -> Column:
    """The conversation as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def faulty(rows: DataFrame) -> DataFrame:
    """key, turn, role, text, uid, fault of rows (conv_id, turn, role, text); the first that applies of blank, duplicate, truncated.

    A row is a duplicate if its role and text are those of a row before it.
    """
    plain = rows.select(conv_key().alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    plain = stored(plain.withColumn("uid", F.monotonically_increasing_id()), "repair-rows")
    said = F.sha2(F.concat_ws("\n", F.octet_length("role"), "role", "text"), 256)
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn", "uid")
    first = plain.groupBy("key", said.alias("said")).agg(F.min(place).alias("first"))
    seen = plain.withColumn("said", said).join(first, ["key", "said"]).withColumn("repeat", F.col("first.uid") != F.col("uid"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("repeat"), "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return seen.select("key", "turn", "role", "text", "uid", fault.alias("fault"))


def cut(rows: DataFrame, piece: int, piece_bytes: int = 4 << 20) -> DataFrame:
    """The rows in order (key, turn with nulls first, role, text), with the part, piece and place they have there."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, place, held = None, -1, 0, 0
        for batch in batches(parts):
            numbers, places = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != last or place + 1 == piece or held > piece_bytes:
                    number, place, held, last = number + 1, -1, 0, key
                place, held = place + 1, held + len(text)
                numbers.append(number)
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(places, pa.int64())], names=[*batch.schema.names, "piece", "place"])

    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("uid")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sorted_rows.schema.fields)
    return stored(sorted_rows.mapInArrow(run, f"{fields}, piece long, place long"), "repair-pieces")


CELLS = ", ".join(f"c{p}{q} long, a{p}{q} string" for p, q in SYMBOLS)


def _as_row(cell: Cell) -> dict:
    row = {}
    for p, q in SYMBOLS:
        row[f"c{p}{q}"], row[f"a{p}{q}"] = cell.get((p, q), (None, None))
    return row


def _as_cell(row: dict) -> Cell:
    return {(p, q): (row[f"c{p}{q}"], row[f"a{p}{q}"]) for p, q in SYMBOLS if row[f"c{p}{q}"] is not None}


FACTS = "key string, number long, n long, first string, last string, illegal long"
GOOD_PAIRS = ("su", "ua", "au")


def runs_of(table: pa.Table, by: list[str]) -> Iterator[pa.Table]:
    """The parts of a sorted table with equal values of some columns."""
    keys = list(zip(*(table.column(c).to_pylist() for c in by), strict=True))
    starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield table.slice(a, b - a)


def piece_cells(rows: DataFrame, together: int = 256) -> DataFrame:
    """One row per piece: its cell, its first and last role initial, and the adjacent initials inside that break the pattern.

    Pieces are taken `together` at a time, as most are short.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("piece", "ascending"), ("place", "ascending")])
        return pa.Table.from_pylist([facts(piece) for piece in runs_of(table, ["piece"])], schema=schema)

    def facts(table: pa.Table) -> dict:
        initials = [r[:1] for r in table.column("role").to_pylist()]
        cell = parse([row_cell(i, f) for i, f in zip(initials, table.column("fault").to_pylist(), strict=True)])
        broken = sum(a + b not in GOOD_PAIRS for a, b in zip(initials, initials[1:], strict=False))
        row = {"key": table.column("key")[0].as_py(), "part": table.column("part")[0].as_py(), "piece": table.column("piece")[0].as_py()}
        return row | {"n": len(initials), "first": initials[0], "last": initials[-1], "illegal": broken} | _as_row(cell)

    ints = {"piece": pa.int64(), "n": pa.int64(), "illegal": pa.int64(), "part": pa.int32()}
    names = ["key", "part", "piece", "n", "first", "last", "illegal", *(x for p, q in SYMBOLS for x in (f"c{p}{q}", f"a{p}{q}"))]
    schema = pa.schema([(c, ints.get(c, pa.int64() if c[0] == "c" else pa.string())) for c in names])
    fields = rows.select("key", "part", "piece", "place", "role", "fault")
    return fields.groupBy("part", F.expr(f"piece div {together}").alias("group")).applyInArrow(run, f"key string, part int, piece long, n long, first string, last string, illegal long, {CELLS}")


def whole_cells(pieces: DataFrame, fan: int) -> DataFrame:
    """One row per conversation from its numbered pieces: adjacent cells in groups of `fan`, level by level.

    Conversations share tasks by `bucket`, a hash of their key.
    """
    names = [f.name for f in pieces.select("bucket", "key", "number", "n", "first", "last", "illegal", *(x for p, q in SYMBOLS for x in (f"c{p}{q}", f"a{p}{q}"))).schema.fields]
    schema = pa.schema([(c, pa.string() if c in ("key", "first", "last") or (c[0] == "a" and len(c) == 3) else pa.int64()) for c in names])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("number", "ascending")])
        return pa.Table.from_pylist([joined(part.to_pylist()) for part in runs_of(table, ["key"])], schema=schema)

    def joined(held: list[dict]) -> dict:
        across = sum(a["last"] + b["first"] not in GOOD_PAIRS for a, b in zip(held, held[1:], strict=False))
        row = {"bucket": held[0]["bucket"], "key": held[0]["key"], "number": held[0]["number"] // fan, "n": sum(h["n"] for h in held), "first": held[0]["first"], "last": held[-1]["last"]}
        return row | {"illegal": across + sum(h["illegal"] for h in held)} | _as_row(parse([_as_cell(h) for h in held]))

    most = pieces.agg(F.max("number")).first()[0] or 0
    level = pieces.select(*names)
    while True:
        level = level.groupBy("bucket", F.expr(f"number div {fan}").alias("group")).applyInArrow(run, f"bucket long, {FACTS}, {CELLS}")
        most //= fan
        if not most:
            return level


def slices(parsed: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, part, piece, number, edits, written, first_s): each piece's edits out of the audit of the whole.

    A piece of n rows takes the edits after those of the rows before it, up to its last row; the last piece takes all.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        audits, rows = dict(zip(left.column("key").to_pylist(), left.column("audit").to_pylist(), strict=True)), []
        right = right.sort_by([("key", "ascending"), ("number", "ascending")])
        for part in runs_of(right, ["key"]):
            held = part.to_pylist()
            audit = audits[held[0]["key"]]
            at, written, first_s = 0, 0, sum(e != DELETE for e in audit) % 2 == 1
            for h in held:
                end, left_rows = at, h["n"]
                while left_rows:
                    left_rows -= audit[end] != INSERT
                    end += 1
                edits = audit[at:] if h is held[-1] else audit[at:end]
                rows.append({"key": h["key"], "part": h["part"], "piece": h["piece"], "number": h["number"], "edits": edits, "written": written, "first_s": first_s})
                written += sum(e != DELETE for e in edits)
                at = end
        return pa.Table.from_pylist(rows, schema=schema)

    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("piece", pa.int64()), ("number", pa.int64()), ("edits", pa.string()), ("written", pa.int64()), ("first_s", pa.bool_())])
    right = pieces.select("bucket", "key", "part", "piece", "number", "n")
    return parsed.select("bucket", "key", "audit").groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(run, "key string, part int, piece long, number long, edits string, written long, first_s boolean")


def write(rows: DataFrame, edits: DataFrame, together: int = 256) -> DataFrame:
    """(key, number, place, role, text): the repaired rows in order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("piece", "ascending"), ("place", "ascending")])
        wanted = {e["piece"]: e for e in right.to_pylist()}
        columns: list[list] = [[], [], [], [], []]
        for part in runs_of(left, ["piece"]):
            e = wanted[part.column("piece")[0].as_py()]
            made, _ = apply(e["edits"], list(zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)), e["written"], e["first_s"])
            n = len(made)
            for column, values in zip(columns, ([e["key"]] * n, [e["number"]] * n, range(n), [r for r, _ in made], [t for _, t in made]), strict=True):
                column.extend(values)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "number", "place", "role", "text"])

    group = F.expr(f"piece div {together}").alias("group")
    return rows.select("part", group, "piece", "place", "role", "text").groupBy("part", "group").cogroup(edits.withColumn("group", group).groupBy("part", "group")).applyInArrow(run, "key string, number long, place long, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(key, repaired_sha256) of rows as `role:text` with line ends between; rows stream through, one batch at a time."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in parts:
            keys, hashes = [], []
            for k, role, text in zip(*(batch.column(c).to_pylist() for c in ("key", "role", "text")), strict=True):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        hashes.append(state.hexdigest())
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(hashes, pa.string())], names=["key", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["key", "repaired_sha256"])

    return repaired.repartition("key").sortWithinPartitions("key", "number", "place").select("key", "role", "text").mapInArrow(run, "key string, repaired_sha256 string")


def repair(conversations: DataFrame, piece: int = 512, fan: int = 16) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of every conversation with rows: (reports, repaired rows).

    Reports: key (`conv_key` of the id), gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Repaired rows: key, number, place (their order), role, text. A null role or text is one space; null ids are one
    conversation; null turns come first. Rows of equal turn are in order of role and text, so repeated rows are
    adjacent. An empty table gives no rows. Only conv_id, turn, role and text are read. A conversation's hash runs
    through one task, as SHA-256 must, but holds one batch at a time; its audit is one string.
    """
    prepare(conversations.sparkSession)
    rows = cut(faulty(conversations), piece)
    cells = stored(piece_cells(rows), "repair-cells")
    buckets = max(1, -(-cells.count() // 2000))
    pieces = cells.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long")).withColumn("number", F.row_number().over(Window.partitionBy("key").orderBy("part", "piece")).cast("long") - 1)
    pieces = stored(pieces, "repair-numbered")
    best = F.least(*(F.when(F.col(f"c0{q}").isNotNull(), F.struct(F.col(f"c0{q}").alias("cost"), F.col(f"a0{q}").alias("audit"))) for q in ENDS))
    parsed = stored(whole_cells(pieces, fan).select("bucket", "key", "illegal", best.alias("best")).select("bucket", "key", "illegal", "best.cost", "best.audit"), "repair-parsed")
    repaired = stored(write(rows, slices(parsed, pieces)), "repair-written")
    kinds = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    turns = rows.groupBy("key", "turn").agg(*kinds)
    spans = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = turns.groupBy("key").agg(spans.alias("gaps"), *(F.sum(f).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")))
    reports = counts.join(parsed.drop("bucket"), "key").join(digests(repaired), "key", "left")
    reports = reports.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())))
    return reports.select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"), repaired


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults planted by crc32 of `conv_id:turn` (nulls: one space), modulo 20."""
    kind = F.crc32(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13(spark, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after damage."""
    given = read(spark, sf_dir, "conversations")
    reports, _ = repair(damaged(given))
    every = given.select("conv_id").distinct().withColumn("key", conv_key())
    out = every.join(reports, "key", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
