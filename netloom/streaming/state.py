"""Keyed state of the streaming operators: sessions, detector windows, blocks."""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from netloom.schema import SECOND, TCP_FLAG_BITS


def _longs(*names: str) -> list[StructField]:
    return [StructField(n, LongType()) for n in names]


#: The event time of keyed state runs this far ahead of `t_us`: a watermark starts at the epoch and drops what is not later.
SHIFT_US = 4_000_000_000_000_000


def _timer(at_us: int) -> int:
    """The timer (milliseconds of event time) that fires not before `at_us`."""
    return -(-(at_us + SHIFT_US) // 1000)


def _alarm(handle: StatefulProcessorHandle, at_us: int | None) -> None:
    """Keep exactly one timer per key."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    if at_us is not None:
        handle.registerTimer(_timer(at_us))


_NULL = np.iinfo(np.int64).min


def _packed(frame: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """The columns as one matrix of longs, with a fixed value for null."""
    # Longs without nulls need no copy with a mask.
    plain = [frame[c].dtype == np.int64 for c in columns]
    return np.stack([frame[c].to_numpy() if p else frame[c].astype("Int64").fillna(_NULL).to_numpy(np.int64) for c, p in zip(columns, plain, strict=True)], axis=1)


def _unpacked(rows: np.ndarray, columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.arrays.IntegerArray(rows[:, k].copy(), rows[:, k] == _NULL) for k, c in enumerate(columns)})


class InOrder(StatefulProcessor):
    """Hands the rows of a key on in the order of event time.

    Rows wait in map state by slice of event time, as one packed value for each arrival, until the watermark passes the end
    of the slice; so rows that arrive late within the delay, in any file or micro-batch, take their place. Slices are taken
    together up to CHUNK rows, so that thin ones cost little, and no more of a key than that or one slice is in memory, however
    many rows of a hot key wait. Subclasses name the columns they need (`t_us` and a tie-breaker first), process sorted rows
    in `take`, and act in `due` on deadlines before the last slice taken.
    """

    COLUMNS: list[str] = []
    CHUNK = 50_000
    SLICE = SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", StructType(_longs("slice", "arrival")), StructType([StructField("rows", BinaryType())]))
        self.arrivals = handle.getValueState("arrivals", StructType(_longs("n")))
        self.setup(handle)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def take(self, key: tuple, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def due(self, key: tuple, now_us: int) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def deadline(self) -> int | None:
        """The next time at which `due` has something to do."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        first = None
        arrival = self.arrivals.get()[0] if self.arrivals.exists() else 0
        for frame in rows:
            packed = _packed(frame, self.COLUMNS)
            slices = packed[:, 0] // self.SLICE
            order = np.argsort(slices, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(slices[order])) + 1):
                at = int(slices[part[0]])
                self.waiting.updateValue((at, arrival), (packed[part].tobytes(),))
                first = at if first is None else min(first, at)
            arrival += 1
        self.arrivals.update((arrival,))
        timers = list(self.handle.listTimers())
        if first is not None:
            end = (first + 1) * self.SLICE
            if not timers or _timer(end) < min(timers):
                _alarm(self.handle, end)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        settled = (timerValues.getCurrentWatermarkInMs() * 1000 - SHIFT_US) // self.SLICE
        ready: dict[int, list[tuple]] = {}
        rest = None
        for at, arrival in self.waiting.keys():
            if at < settled:
                ready.setdefault(at, []).append((at, arrival))
            else:
                rest = at if rest is None else min(rest, at)
        held, size = [], 0
        for at in sorted(ready):
            parts = [np.frombuffer(self.waiting.getValue(k)[0], np.int64).reshape(-1, len(self.COLUMNS)) for k in sorted(ready[at])]
            for k in ready[at]:
                self.waiting.removeKey(k)
            packed = np.concatenate(parts)
            if held and size + len(packed) > self.CHUNK:
                yield from self._taken(key, held)
                held, size = [], 0
            held.append(packed[np.lexsort((packed[:, 1], packed[:, 0]))])
            size += len(packed)
        if held:
            yield from self._taken(key, held)
        yield from self.due(key, settled * self.SLICE)
        due = self.deadline()
        times = [t for t in (None if due is None else -(-due // self.SLICE) * self.SLICE, None if rest is None else (rest + 1) * self.SLICE) if t is not None]
        _alarm(self.handle, min(times) if times else None)

    def _taken(self, key: tuple, slices: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        packed = np.concatenate(slices)
        for cut in range(0, len(packed), self.CHUNK):
            yield from self.take(key, _unpacked(packed[cut : cut + self.CHUNK], self.COLUMNS))

    def close(self) -> None:
        pass


# --- sessions ----------------------------------------------------------------------

MEASURES = [
    "start_us", "start_packet", "end_us", "packet_id", "n", "bytes", "bytes_sq", "size_min", "size_max", "gaps", "gap_sum", "gap_sq",
    "gap_min", "gap_max", "header", "data_packets", "payload_min", "window0", *TCP_FLAG_BITS,
]
SESSION_OUT = StructType(
    [
        StructField("flow_id", StringType()),
        StructField("src_ip", StringType()),
        StructField("dst_ip", StringType()),
        *_longs("src_port", "dst_port", "protocol"),
        *_longs(*MEASURES),
        StructField("finished", BooleanType()),
        StructField("reason", StringType()),
        StructField("is_final", BooleanType()),
    ]
)
#: The same rows as a processor hands them over: key parts as they are, measures as one array, with a fixed value for null.
SESSION_RECORD = StructType(
    [
        *[StructField(c, StringType()) for c in ("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")],
        StructField("measures", ArrayType(LongType())),
        StructField("reason", StringType()),
    ]
)
#: Measures that may be null.
MAY_LACK = ("gap_min", "gap_max", "payload_min", "window0")
#: Reasons of rows that measure a session up to a scoring point; all other rows measure an ended session.
ACTIVE, CLOSING = "active", "closing"
UNSET = -1


_HIGH = np.iinfo(np.int64).max


def _running(pick: np.ufunc, values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Running extreme inside sessions, of values of their pieces; `place` counts the earlier pieces of the same session."""
    step = 1
    while step <= place.max():
        later = np.flatnonzero(place >= step)
        values[later] = pick(values[later], values[later - step])
        step *= 2
    return values


def _measures(part: dict[str, np.ndarray], ends: np.ndarray, starts: np.ndarray, before: dict[str, int] | None) -> dict[str, np.ndarray]:
    """Measures of sessions from their first row up to the end of each of their pieces.

    Piece k ends before row `ends[k]` and belongs to the session that begins in row `starts[k]`; pieces cover all rows. The
    first session continues the one of measures `before`, if there are any. Gaps count from the second row of a session on.
    """
    t, size, payload, win = (part[c] for c in ("t_us", "packet_size", "payload_size", "tcp_window_size"))
    n = ends - starts
    heads = np.concatenate([[0], ends[:-1]])
    new = np.concatenate([[True], starts[1:] != starts[:-1]])
    place = np.arange(len(ends)) - np.maximum.accumulate(np.where(new, np.arange(len(ends)), 0))
    gap = np.diff(t, prepend=t[0])
    gap[starts] = 0
    counted = np.ones(len(t), bool)
    counted[starts] = False
    if before is not None:
        gap[0], counted[0] = max(0, int(t[0]) - before["end_us"]), True

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[ends] - sums[starts]

    def extreme(pick: np.ufunc, values: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        none = _HIGH if pick is np.minimum else UNSET
        found = _running(pick, pick.reduceat(values if known is None else np.where(known, values, none), heads), place)
        return found if known is None else np.where(found == none, UNSET, found)

    seen = np.flatnonzero(win >= 0)
    first = np.append(seen, len(win))[np.searchsorted(seen, starts)]
    flags = part["tcp_flags"]
    out = {
        "start_us": t[starts],
        "start_packet": part["packet_id"][starts],
        "end_us": t[ends - 1],
        "packet_id": part["packet_id"][ends - 1],
        "n": n,
        "bytes": total(size),
        "bytes_sq": total(size * size),
        "size_min": extreme(np.minimum, size),
        "size_max": extreme(np.maximum, size),
        "gaps": total(counted),
        "gap_sum": total(gap),
        "gap_sq": total(gap * gap),
        "gap_min": extreme(np.minimum, gap, counted),
        "gap_max": extreme(np.maximum, gap, counted),
        "header": total(part["transport_header_length"]),
        "data_packets": total(payload > 0),
        "payload_min": extreme(np.minimum, payload, payload > 0),
        "window0": np.where(first < ends, np.append(win, UNSET)[first], UNSET),
        **{k: total((flags & bit) != 0) for k, bit in TCP_FLAG_BITS.items()},
    }
    if before is not None:
        own = slice(0, int(np.searchsorted(starts, 0, "right")))
        for k in ("start_us", "start_packet"):
            out[k][own] = before[k]
        out["end_us"][own] = np.maximum(out["end_us"][own], before["end_us"])
        for k in ("n", "bytes", "bytes_sq", "gaps", "gap_sum", "gap_sq", "header", "data_packets", *TCP_FLAG_BITS):
            out[k][own] += before[k]
        for k, pick in (("size_min", np.minimum), ("size_max", np.maximum), ("gap_min", np.minimum), ("gap_max", np.maximum), ("payload_min", np.minimum)):
            if before[k] != UNSET:
                out[k][own] = np.where(out[k][own] == UNSET, before[k], pick(out[k][own], before[k]))
        if before["window0"] != UNSET:
            out["window0"][own] = before["window0"]
    return out


class SessionState(InOrder):
    """Open session of one flow; emits a session when it ends, and its measures so far at scoring points if asked for.

    A packet is a scoring point if it ends the flow, or if the session is old and large enough and `every_n` packets or
    `every_s` seconds have passed since the last one. Measures between points are merged, never taken again.
    Key: the flow text and its parts, numbers as text and empty for null.
    """

    COLUMNS = ["t_us", "packet_id", "packet_size", "payload_size", "tcp_window_size", "transport_header_length", "tcp_flags"]

    def __init__(self, idle_s: float = 30, max_s: float = 120, live: bool = False, min_age_s: float = 1, min_packets: int = 5, every_n: int = 5, every_s: float = 1):
        self.idle, self.limit, self.live = int(idle_s * SECOND), int(max_s * SECOND), live
        self.min_age, self.min_packets, self.every_n, self.every = int(min_age_s * SECOND), min_packets, every_n, int(every_s * SECOND)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", StructType(_longs(*MEASURES, "scored_n", "scored_us")))

    def _expired(self, start_us: np.ndarray, end_us: np.ndarray) -> np.ndarray:
        return np.where(end_us + self.idle <= start_us + self.limit, "idle_timeout", "max_duration")

    def _frame(self, key: tuple, m: dict[str, np.ndarray], reason: np.ndarray) -> pd.DataFrame:
        size = len(reason)

        def number(text: str) -> pd.arrays.IntegerArray:
            return pd.arrays.IntegerArray(np.full(size, int(text or 0), np.int64), np.full(size, not text))

        finished = np.isin(reason, [CLOSING, "flow_end"])
        shown = {k: pd.arrays.IntegerArray(m[k], m[k] == UNSET) if k in MAY_LACK else m[k] for k in MEASURES}
        columns = {**dict(zip(("flow_id", "src_ip", "dst_ip"), key[:3], strict=True)),
                   **{c: number(text) for c, text in zip(("src_port", "dst_port", "protocol"), key[3:], strict=True)},
                   **shown, "finished": finished, "reason": reason, "is_final": finished}
        return pd.DataFrame(columns, index=range(size))

    def _ended(self, key: tuple, m: dict[str, int]) -> pd.DataFrame:
        """The row of the open session, which ends by a deadline."""
        one = {k: np.array([v], np.int64) for k, v in m.items()}
        return self._frame(key, one, self._expired(one["start_us"], one["end_us"]))

    def _load(self) -> tuple[dict[str, int] | None, tuple[int, int]]:
        """The open session, and the packet count and time of its last scoring point (a count of 0: none yet)."""
        if not self.open.exists():
            return None, (0, 0)
        held = tuple(self.open.get())
        return dict(zip(MEASURES, held, strict=False)), held[len(MEASURES) :]

    def _points(self, t: np.ndarray, at: int, stop: int, start_us: int, before: int, scored: tuple[int, int]) -> list[int]:
        """Scoring points among rows at..stop of a session that has `before` rows already, without a closing one."""
        first = max(at + self.min_packets - 1 - before, bisect_left(t, start_us + self.min_age), at)
        if scored[0]:
            first = max(min(at + scored[0] + self.every_n - before - 1, bisect_left(t, scored[1] + self.every)), at)
        found = []
        while first < stop:
            found.append(first)
            first = bisect_left(t, t[first] + self.every, first + 1, min(first + self.every_n, len(t)))
        return found

    def _cuts(self, part: dict[str, np.ndarray], start_us: int) -> list[int]:
        """Where sessions end: after a packet that ends the flow, before an idle gap, and at the age limit."""
        t = part["t_us"]
        ends = np.flatnonzero(part["tcp_flags"] & 5) + 1
        known = np.union1d(np.union1d(ends, np.flatnonzero(np.diff(t) >= self.idle) + 1), [len(t)])
        begins = t[np.concatenate([[0], known[:-1]])]
        begins[0] = start_us
        old = known[t[known - 1] - begins >= self.limit]
        found = known.tolist()
        for stop, start in zip(old.tolist(), begins[np.searchsorted(known, old)].tolist(), strict=True):
            while (at := int(np.searchsorted(t, start + self.limit, "left"))) < stop:
                found.append(at)
                start = int(t[at])
        return sorted(found)

    def take(self, key, frame):
        part = {c: frame[c].fillna(-1 if c == "tcp_window_size" else 0).to_numpy(np.int64) for c in self.COLUMNS}
        t = part["t_us"]
        current, scored = self._load()
        if current is not None and (t[0] - current["end_us"] >= self.idle or t[0] - current["start_us"] >= self.limit):
            yield self._ended(key, current)
            current, scored = None, (0, 0)
        stops = self._cuts(part, current["start_us"] if current is not None else int(t[0]))
        closed = (part["tcp_flags"][np.array(stops) - 1] & 5) != 0
        times = t.tolist()
        ends, starts, active, at = [], [], [], 0
        for stop, final in zip(stops, closed.tolist(), strict=True):
            fresh = at > 0 or current is None
            points = [] if not self.live else self._points(times, at, stop - final, times[at], 0, (0, 0)) if fresh else self._points(times, at, stop - final, current["start_us"], current["n"], scored)
            cuts = [i + 1 for i in points]
            active += range(len(ends), len(ends) + len(cuts))
            if not cuts or cuts[-1] < stop:
                cuts.append(stop)
            ends += cuts
            starts += [at] * len(cuts)
            at = stop
        ends, starts, active = (np.array(x, np.int64) for x in (ends, starts, active))
        m = _measures(part, ends, starts, current)
        last = np.searchsorted(ends, stops)
        over = last if closed[-1] else last[:-1]
        final = last[closed]
        how = np.where(closed[: len(over)], "flow_end", self._expired(m["start_us"][over], m["end_us"][over]))
        shown = np.concatenate([active, final if self.live else final[:0], over])
        if len(shown):
            reason = np.concatenate([np.full(len(active), ACTIVE), np.full(len(final) if self.live else 0, CLOSING), how]).astype(object)
            yield self._frame(key, {k: v[shown] for k, v in m.items()}, reason)
        if closed[-1]:
            self.open.clear()
            return
        points = active[starts[active] == starts[-1]]
        if len(points):
            scored = int(m["n"][points[-1]]), int(m["end_us"][points[-1]])
        elif starts[-1] > 0:
            scored = 0, 0
        self.open.update((*(int(m[k][-1]) for k in MEASURES), *scored))

    def deadline(self):
        current, _ = self._load()
        return None if current is None else min(current["end_us"] + self.idle, current["start_us"] + self.limit)

    def due(self, key, now_us):
        at = self.deadline()
        if at is not None and at <= now_us:
            current, _ = self._load()
            self.open.clear()
            yield self._ended(key, current)


class SessionRecords(SessionState):
    """As `SessionState`, with rows of few columns: every frame is an Arrow batch, and one costs by its columns, not by its rows."""

    def _frame(self, key: tuple, m: dict[str, np.ndarray], reason: np.ndarray) -> pd.DataFrame:
        size = len(reason)
        parts = {c: np.full(size, text, object) for c, text in zip(SESSION_RECORD.fieldNames(), key, strict=False)}
        return pd.DataFrame({**parts, "measures": list(np.stack([m[k] for k in MEASURES], axis=1)), "reason": reason}, index=range(size))


# --- detectors ---------------------------------------------------------------------

DETECT_OUT = StructType(
    [
        *_longs("packet_id", "t_us"),
        StructField("src_ip", StringType()),
        StructField("scan_burst", BooleanType()),
        StructField("port_sweep", BooleanType()),
        StructField("syn_only_surge", BooleanType()),
    ]
)


def reached(history: np.ndarray, t: np.ndarray, n: int, width: int) -> np.ndarray:
    """True where the trailing window over history and rows holds at least n times."""
    line = np.concatenate([history, t])
    at = np.arange(len(history), len(line))
    nth = at - (n - 1)
    return (nth >= 0) & (line[np.maximum(nth, 0)] >= t - width)


class DetectorState(InOrder):
    """Recent times of one source: the last n-1 packets and n SYNs, the last time of each recent port."""

    COLUMNS = ["t_us", "packet_id", "dst_port", "tcp_flags"]

    def __init__(self, burst=(2, 40), sweep=(5, 15), syn=(3, 20)):
        self.burst, self.sweep, self.syn = ((int(w * SECOND), n) for w, n in (burst, sweep, syn))

    def setup(self, handle: StatefulProcessorHandle) -> None:
        fields = [StructField(n, ArrayType(LongType())) for n in ("times", "syns", "ports", "port_times")]
        self.recent = handle.getValueState("recent", StructType(fields))

    def take(self, key, frame):
        past = self.recent.get() if self.recent.exists() else ([], [], [], [])
        times, syns, ports, port_times = (np.array(p, np.int64) for p in past)
        t = frame["t_us"].to_numpy(np.int64)
        flags = frame["tcp_flags"].astype("Int64").fillna(0).to_numpy(np.int64)

        burst = reached(times, t, self.burst[1], self.burst[0])
        width, n = self.syn
        line = np.concatenate([syns, t[(flags & 2 != 0) & (flags & 16 == 0)]])
        upto = len(syns) + np.cumsum((flags & 2 != 0) & (flags & 16 == 0))
        nth = upto - n
        surge = (nth >= 0) & (line[np.maximum(nth, 0)] >= t - width if len(line) else False)

        # Distinct ports: a port counts from a fresh sighting until it was unseen for the window.
        width, n_ports = self.sweep
        p = np.concatenate([ports, frame["dst_port"].astype("Int64").fillna(-1).to_numpy(np.int64)])
        pt = np.concatenate([port_times, t])
        real = p >= 0
        order = np.lexsort((np.arange(len(p)), p))
        same_next = np.zeros(len(p), bool)
        same_next[order[:-1]] = p[order[1:]] == p[order[:-1]]
        nxt = np.full(len(p), -1)
        nxt[order[:-1]] = order[1:]
        again = same_next & (pt[nxt] - pt <= width)
        fresh = real.copy()
        fresh[nxt[again]] = False
        gone = np.sort(pt[real & ~again] + width)
        alive = np.cumsum(fresh)[len(ports):] - np.searchsorted(gone, t, "left")
        sweep = alive >= n_ports

        now = int(t[-1])
        keep = real & ~same_next & (pt >= now - width)
        by_time = np.flatnonzero(keep)[np.argsort(pt[keep], kind="stable")]
        self.recent.update(
            (
                [int(v) for v in np.concatenate([times, t])[-(self.burst[1] - 1):]],
                [int(v) for v in line[-self.syn[1]:]],  # all n: a packet that is no SYN looks back on as many
                [int(v) for v in p[by_time]],
                [int(v) for v in pt[by_time]],
            )
        )
        yield pd.DataFrame(
            {"packet_id": frame["packet_id"].to_numpy(np.int64), "t_us": t, "src_ip": key[0], "scan_burst": burst, "port_sweep": sweep, "syn_only_surge": surge}
        )

    def deadline(self):
        if not self.recent.exists():
            return None
        return self.recent.get()[0][-1] + max(self.burst[0], self.sweep[0], self.syn[0]) + 1000

    def due(self, key, now_us):
        at = self.deadline()
        if at is not None and at <= now_us:
            self.recent.clear()
        yield from ()


BRUTE_OUT = StructType([*_longs("packet_id", "t_us"), StructField("bruteforce", BooleanType())])


class GuessState(InOrder):
    """The last n-1 tries on one service by one source."""

    COLUMNS = ["t_us", "packet_id"]

    def __init__(self, window_s: float = 90, n: int = 25):
        self.width, self.n = int(window_s * SECOND), n

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.tries = handle.getValueState("tries", StructType([StructField("times", ArrayType(LongType()))]))

    def take(self, key, frame):
        past = np.array(self.tries.get()[0] if self.tries.exists() else [], np.int64)
        t = frame["t_us"].to_numpy(np.int64)
        hit = reached(past, t, self.n, self.width)
        self.tries.update(([int(v) for v in np.concatenate([past, t])[-(self.n - 1):]],))
        yield pd.DataFrame({"packet_id": frame["packet_id"].to_numpy(np.int64), "t_us": t, "bruteforce": hit})

    def deadline(self):
        return self.tries.get()[0][-1] + self.width + 1000 if self.tries.exists() else None

    def due(self, key, now_us):
        at = self.deadline()
        if at is not None and at <= now_us:
            self.tries.clear()
        yield from ()


# --- blocks ------------------------------------------------------------------------

BLOCK_OUT = StructType(
    [
        StructField("ip", StringType()),
        *_longs("at_us", "seq"),
        StructField("status", StringType()),
        *_longs("until_us", "times_blocked"),
    ]
)


class BlockState(InOrder):
    """Block of one address. Emits the outcome of every request and the expiry of the block (seq -1)."""

    COLUMNS = ["t_us", "seq", "duration_s", "unblock"]

    def __init__(self, cooldown_s: float = 60):
        self.cooldown = int(cooldown_s * SECOND)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("block", StructType(_longs("last_us", "until_us", "times")))

    def _get(self) -> tuple[int | None, int | None, int]:
        return tuple(self.state.get()) if self.state.exists() else (None, None, 0)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["at_us", "seq", "status", "until_us", "times_blocked"])
        return frame.assign(ip=key[0])[BLOCK_OUT.fieldNames()]

    def take(self, key, frame):
        last, until, times = self._get()
        out = []
        for t, seq, duration, unblock in frame.itertuples(index=False):
            if until is not None and until <= t:
                out.append((until, -1, "unblocked", -1, times))
                last = until = None
            if unblock:
                status, last, until = "unblocked", None, None
            elif last is not None and t < last + self.cooldown:
                status = "cooldown_active"
            else:
                status = "blocked" if until is None else "already_blocked"
                times += status == "blocked"
                last, until = int(t), int(t + max(1, duration) * SECOND)
            out.append((int(t), int(seq), status, until if status.endswith("blocked") and not unblock else -1, times))
        self.state.update((last, until, times))
        yield self._frame(key, out)

    def deadline(self):
        return self._get()[1]

    def due(self, key, now_us):
        last, until, times = self._get()
        if until is not None and until <= now_us:
            # The count of blocks outlives the block itself; the cooldown does not.
            self.state.update((None, None, times))
            yield self._frame(key, [(until, -1, "unblocked", -1, times)])
