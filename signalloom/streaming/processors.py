"""State machines of streams (``transformWithState``): requests in flight, pending metric rows, life cycles of connections, reassembly of HTTP heads.

They need the RocksDB state store (``with_rocksdb``). Rows whose order matters wait until the watermark has passed them and are handled in order then,
so a result doesn't depend on how rows were dealt to batches; what never comes is ended by a timer.

Keys are dealt to buckets by hash, and a bucket's keys are held as one state: a batch costs a few calls of the state store for each bucket it touches, not for each key or row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.requests import IN_FLIGHT, TIMEOUT, fifo
from .streams import event_time

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MS = 1_000_000


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _tuples(df: pd.DataFrame, columns: Sequence[str]) -> Iterator[tuple]:
    return zip(*(df[c].tolist() for c in columns), strict=True)


#: Buckets that keys are dealt to. A bucket's state is read and written whole, so many more keys want more of them.
BUCKETS = 1024


def bucketed(rows: DataFrame, keys: Sequence[str], buckets: int, *rest: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(``rows`` with ``state_bucket``, ``state_key`` and the columns ``rest``, what gives a table with ``state_key`` the key's columns back)."""
    types = rows.select(*keys).schema

    def named(out: DataFrame) -> DataFrame:
        return out.withColumn("state_key", F.from_json("state_key", types)).select(*[F.col("state_key")[k].alias(k) for k in keys], *[c for c in out.columns if c != "state_key"])

    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("state_bucket"), F.to_json(F.struct(*keys)).alias("state_key"), *rest), named


class Bucket(StatefulProcessor):
    """The states of many keys as one value, with one timer: ``wake`` moves it to an earlier time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.alarm = handle, handle.getValueState("alarm", "at long")
        self.held = handle.getValueState("held", "states binary")

    def states(self) -> dict:
        return pickle.loads(self.held.get()[0]) if self.held.exists() else {}

    def keep(self, states: dict) -> None:
        if states:
            self.held.update((pickle.dumps(states),))
        else:
            self.held.clear()

    def wake(self, at: int) -> None:
        """At ``at`` milliseconds, or sooner if the timer is set sooner."""
        now = self.alarm.get()[0] if self.alarm.exists() else None
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def close(self) -> None:
        pass


class Ordered(Bucket):
    """Holds rows (columns ``row``, the first one a time in nanoseconds) until the watermark is behind them; ``advance`` gets a key's in order."""

    row: Sequence[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for df in rows for r in _tuples(df, (*self.row, "state_key"))]
        if new:
            self.waiting.appendValue((pickle.dumps(new),))
            self.wake(min(r[0] for r in new) // MS + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        now = timerValues.getCurrentWatermarkInMs()
        ready, later = {}, []
        for (part,) in self.waiting.get() if self.waiting.exists() else ():
            for r in pickle.loads(part):
                if r[0] // MS < now:
                    ready.setdefault(r[-1], []).append(r[:-1])
                else:
                    later.append(r)
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.appendValue((pickle.dumps(later),))
        states, out = self.states(), []  # of each key: what it holds, and when to look again
        for k in {**ready, **{k: None for k, (_, due) in states.items() if due <= now * MS}}:
            held, rows, due = self.advance(states.pop(k, (None,))[0], sorted(ready.get(k, ())), now * MS)
            out += [(k, *r) for r in rows]
            if held is not None:
                states[k] = held, due
        self.keep(states)
        times = [min(r[0] for r in later) // MS + 1] if later else []
        times += [-(-min(due for _, due in states.values()) // MS)] if states else []
        if times:
            self.wake(min(times))
        if out:
            yield self.frame(out)

    def advance(self, held, rows: list[tuple], now: int) -> tuple[object, list[tuple], int | None]:
        """Handles a key's rows before ``now`` (nanoseconds), and what has waited until then: (what it holds on to, rows of the result, the time to look again)."""
        raise NotImplementedError

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError


def _nullable(rows: list[tuple], names: Sequence[str], numbers: Sequence[str]) -> pd.DataFrame:
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    return pd.DataFrame({n: pd.array(list(c), "Int64") if n in numbers else list(c) for n, c in columns.items()})


class Fifo(Ordered):
    row = ("ts", "kind", "seq")

    def __init__(self, timeout: int, most: int):
        self.timeout, self.most = timeout, most

    def advance(self, held, rows, now):
        flying, feed = fifo(self.timeout, self.most, strict=True)
        flying.extend(held or ())
        out = [x for r in rows for x in feed(*r)]
        while flying and now - flying[0][1] >= self.timeout:  # no answer can come in time any more
            out.append((*flying.popleft(), None, None, "expired"))
        return (list(flying), out, flying[0][1] + self.timeout) if flying else (None, out, None)

    def frame(self, rows):
        names = ("state_key", "seq", "start", "end", "response_seq", "outcome")
        return _nullable(rows, names, names[1:5])


def match_fifo_stream(rows: DataFrame, timeout: int = TIMEOUT, most: int = IN_FLIGHT, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """``fifo_rows`` as a stream -> requests with their answers (T8): what ``match_fifo(strict=True)`` gives, whatever the batches are.

    A request that isn't answered within ``timeout`` comes out of a timer, without an end, as ``expired``. At most ``most`` requests of a connection are in flight.
    Rows behind the watermark are ignored.
    """
    timed = rows.withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", delay)
    dealt, named = bucketed(timed, ("host", "connection"), buckets, *Fifo.row, "event_time")
    schema = "state_key string, seq long, start long, end long, response_seq long, outcome string"
    return named(dealt.groupBy("state_bucket").transformWithStateInPandas(Fifo(timeout, most), schema, "Append", "EventTime"))


#: Nanoseconds a metric row waits for a later one of its millisecond, and after which a silent series is forgotten.
COALESCE_DELAY, STALE = 250 * MS, 600_000 * MS


class Guard(Ordered):
    row = ("arrived", "seq", "ts")

    def __init__(self, delay: int, stale: int):
        self.delay, self.stale = delay, stale

    def advance(self, held, rows, now):
        newest, pending, last_seq, last_ts, updated, seen = held or (None, False, None, None, None, None)
        out, dropped, suppressed = [], 0, 0

        def flush():
            nonlocal pending
            if pending:
                out.append((last_seq, last_ts, 0, 0))
            pending = False

        for arrived, seq, ts in rows:
            if seen is not None and arrived - seen >= self.stale:
                flush()
                newest = None
            elif pending and arrived - updated >= self.delay:
                flush()
            seen, ms = arrived, ts // MS
            if newest is not None and ms < newest:
                dropped += 1
                continue
            if ms == newest:
                suppressed += 1
                if not pending:
                    continue
            else:
                flush()
            newest, pending, last_seq, last_ts, updated = ms, True, seq, ts, arrived
        if pending and now - updated >= self.delay:
            flush()
        if dropped or suppressed:
            out.append((None, None, dropped, suppressed))
        if seen is None or now - seen >= self.stale:
            return None, out, None
        return (newest, pending, last_seq, last_ts, updated, seen), out, min(updated + self.delay, seen + self.stale) if pending else seen + self.stale

    def frame(self, rows):
        return _nullable(rows, ("state_key", "seq", "ts", "dropped", "suppressed"), ("seq", "ts", "dropped", "suppressed"))


def timestamp_guard_stream(records: DataFrame, delay: int = COALESCE_DELAY, stale: int = STALE, late: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """One row of each series and millisecond, never older than one sent before (T7): series, seq, ts; and rows with counts of what was dropped and suppressed.

    ``records``: series, seq, ts and arrived (nanoseconds; when the row came, which is what order and timers go by). The newest row waits: a later
    one of its millisecond takes its place; it is sent when a newer millisecond comes or nothing has replaced it for ``delay``. Further rows of a sent
    millisecond are suppressed, older ones dropped. A series that is silent for ``stale`` is forgotten.
    """
    timed = records.withColumn("event_time", event_time(F.col("arrived"))).withWatermark("event_time", late)
    dealt, named = bucketed(timed, ("series",), buckets, *Guard.row, "event_time")
    schema = "state_key string, seq long, ts long, dropped long, suppressed long"
    return named(dealt.groupBy("state_bucket").transformWithStateInPandas(Guard(delay, stale), schema, "Append", "EventTime"))


CONNECTION = ("host", "pid", "fd", "remote_address", "remote_port")
#: What stands for an unknown time of opening.
UNKNOWN = -1


_EVENT = ("seq", "kind", "ts", "opened_at", "bytes_sent", "bytes_received")


def _steps(rows: Sequence[tuple], before: dict[int, tuple]) -> tuple[list[tuple], dict[int, tuple]]:
    """``cycle_intervals`` of rows (``_EVENT``) in order."""
    now = next((c for c, s in before.items() if s[3]), UNKNOWN)
    if now == UNKNOWN:
        now = next((r[3] for r in rows if r[3] != UNKNOWN), UNKNOWN)
        if UNKNOWN in before and now not in before:  # the unknown one turns out to be this
            before = {now if c == UNKNOWN else c: s for c, s in before.items()}
    after, out = {c: (*s[:3], False) for c, s in before.items()}, []
    for seq, kind, ts, opened, sent, received in rows:
        now = now if opened == UNKNOWN else opened
        was_sent, was_received, closed, _ = after.get(now, (0, 0, ts, False) if kind == "close" else (0, 0, ts - 1, False))
        if closed is None:
            out.append((seq, sent - was_sent if sent >= was_sent else sent, received - was_received if received >= was_received else received))
        elif kind == "close" or ts > closed:
            out.append((seq, sent, received))
        else:
            continue
        after[now] = (sent, received, ts if kind == "close" else None, False)
    if now in after:
        after[now] = (*after[now][:3], True)
    return out, after


def cycle_intervals(rows: pd.DataFrame, before: dict[int, tuple]) -> tuple[pd.DataFrame, dict[int, tuple]]:
    """Bytes since the event before of the same life cycle: (seq, sent, received), and the cycles' states.

    ``rows``: seq, kind (snapshot or close), ts, opened_at (UNKNOWN if it isn't known), bytes_sent, bytes_received; at least one. A state is (sent, received, closed_at, whether
    the last row was of this cycle); of a closed cycle only the time of its close counts. A row without a time of opening belongs to the cycle before it; what began unknown is the first known one.
    A snapshot at or before the close of its cycle is late and gives nothing; a later one begins anew.
    """
    out, after = _steps(list(_tuples(rows.sort_values("seq", kind="stable"), _EVENT)), before)
    return pd.DataFrame(out, columns=["seq", "sent", "received"]), after


class Cycles(StatefulProcessor):
    """The life cycles of a bucket's connections: of each, the states by time of opening, each with the time of its last change."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "states binary", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((r for df in rows for r in _tuples(df, ("state_key", *_EVENT))), key=itemgetter(0, 1))
        if not new:
            return
        held = pickle.loads(self.held.get()[0]) if self.held.exists() else {}
        now = 0 if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        if self.ttl_ms is not None:
            held = {k: live for k, c in held.items() if (live := {o: s for o, s in c.items() if now - s[1] < self.ttl_ms})}
        out = []
        for k, mine in groupby(new, key=itemgetter(0)):
            before = held.get(k, {})
            found, after = _steps([r[1:] for r in mine], {o: s for o, (s, _) in before.items()})
            held[k] = {o: before[o] if o in before and before[o][0] == s else (s, now) for o, s in after.items()}
            out += [(k, *r) for r in found]
        self.held.update((pickle.dumps(held),))
        if out:
            yield pd.DataFrame(out, columns=["state_key", "seq", "sent", "received"])

    def close(self) -> None:
        pass


def flow_interval_stream(events: DataFrame, ttl_ms: int | None = 900_000, buckets: int = BUCKETS) -> DataFrame:
    """Bytes since the event before on the same life cycle of a connection (T4): the connection, seq, sent, received.

    ``events``: CONNECTION, seq, kind, ts, bytes_sent, bytes_received, and opened_at if it is known. Each life cycle of a connection (its time of opening) has its own counters, so
    a file descriptor that is used again, or a snapshot that comes late, doesn't disturb another. A close leaves a tombstone: a late snapshot of that cycle gives nothing.
    States go ``ttl_ms`` after their last change (None: never; a stream that is read to its end stops there).
    """
    opened = F.coalesce(F.col("opened_at"), F.lit(UNKNOWN)).cast("long") if "opened_at" in events.columns else F.lit(UNKNOWN).cast("long")
    rows = events.where("kind in ('snapshot', 'close') and fd is not null").select(*CONNECTION, "seq", "kind", "ts", opened.alias("opened_at"), F.coalesce("bytes_sent", F.lit(0)).alias("bytes_sent"), F.coalesce("bytes_received", F.lit(0)).alias("bytes_received"))
    dealt, named = bucketed(rows, CONNECTION, buckets, *_EVENT)
    schema = "state_key string, seq long, sent long, received long"
    return named(dealt.groupBy("state_bucket").transformWithStateInPandas(Cycles(ttl_ms), schema, "Append", "None" if ttl_ms is None else "ProcessingTime"))


#: Nanoseconds after which a silent connection is given up, and most bytes of a head, or held behind a gap.
HTTP_STALE, MOST_BYTES = 300_000 * MS, 1 << 16


class HeadReader:
    """Heads of HTTP/1 messages from the bytes of one direction of a connection, in order. Bodies are skipped by their content length."""

    def __init__(self, held: bytes = b"", at: int | None = None, skip: int = 0, since: int | None = None, dead: bool = False, most: int = MOST_BYTES):
        self.held, self.at, self.skip, self.since, self.dead, self.most = held, at, skip, since, dead, most

    def feed(self, offset: int, ts: int, data: bytes) -> list[tuple]:
        """(ts, head, error) of what the bytes complete; a gap or a head above ``most`` bytes ends the connection with an error."""
        if self.dead:
            return []
        self.at = offset if self.at is None else self.at
        if offset > self.at:
            self.dead = True
            return [(ts, None, "gap")]
        data, out = bytes(data[self.at - offset :]), []
        self.at += len(data)
        taken = min(self.skip, len(data))
        self.skip, data = self.skip - taken, data[taken:]
        if data and not self.held:
            self.since = ts
        self.held += data
        while (end := self.held.find(b"\r\n\r\n")) >= 0:
            head, self.held = self.held[:end], self.held[end + 4 :]
            length = next((int(v) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]) if k.strip().lower() == b"content-length" and v.strip().isdigit()), 0)
            out.append((self.since, head.decode("latin-1"), None))
            taken = min(length, len(self.held))
            self.skip, self.held, self.since = length - taken, self.held[taken:], ts
        if len(self.held) > self.most:
            self.dead = True
            out.append((ts, None, "too_long"))
        return out


class Heads(Bucket):
    """Of each connection's direction: the reader, the chunks behind a gap by offset, the last time, and the bytes behind the gap."""

    def __init__(self, stale: int, most: int):
        self.stale, self.most = stale, most

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((r for df in rows for r in _tuples(df, ("state_key", "offset", "ts", "data"))), key=itemgetter(0, 1, 2))
        if not new:
            return
        states, out, due = self.states(), [], []
        for k, mine in groupby(new, key=itemgetter(0)):
            state = states.get(k) or (HeadReader(at=0, most=self.most), {}, 0, 0)
            found, states[k] = self._feed(mine, *state)
            out += [(k, *r) for r in found]
            due.append(states[k][2] + self.stale)
        self.keep(states)
        self.wake(-(-min(due) // MS))
        if out:
            yield self._frame(out)

    def _feed(self, rows, reader: HeadReader, gap: dict, seen: int, behind: int) -> tuple[list[tuple], tuple]:
        out: list[tuple] = []
        for _, offset, ts, data in rows:
            seen = max(seen, ts)
            if reader.dead:
                continue
            if offset <= reader.at:
                out += reader.feed(offset, ts, data)
                continue
            known = gap.get(offset)
            if known is None or len(known[1]) < len(data):
                behind += len(data) - (len(known[1]) if known else 0)
                gap[offset] = (ts, bytes(data))
        for offset in sorted(gap):
            if offset > reader.at or reader.dead:
                break
            ts, data = gap.pop(offset)
            out += reader.feed(offset, ts, data)
            behind -= len(data)
        if behind > self.most and not reader.dead:
            reader.dead = True
            out.append((seen, None, "gap"))
        if reader.dead:
            gap, reader.held, behind = {}, b"", 0
        return out, (reader, gap, seen, behind)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.alarm.clear()
        states, now, out = self.states(), timerValues.getCurrentWatermarkInMs() * MS, []
        for k in [k for k, s in states.items() if now - s[2] >= self.stale]:
            reader, _, seen, behind = states.pop(k)
            if not reader.dead and (behind or reader.held or reader.skip):
                out.append((k, seen, None, "gap" if behind else "unfinished"))
        self.keep(states)
        if states:
            self.wake(-(-(min(s[2] for s in states.values()) + self.stale) // MS))
        if out:
            yield self._frame(out)

    def _frame(self, rows) -> pd.DataFrame:
        return _nullable(rows, ("state_key", "ts", "head", "error"), ("ts",))


def http_heads_stream(chunks: DataFrame, stale: int = HTTP_STALE, most: int = MOST_BYTES, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Request and response heads of HTTP/1 from a stream of chunks in any order (T10): host, connection, direction, ts, head, error.

    ``chunks``: host, connection, direction, offset (bytes from 0), ts, data. A chunk behind a gap waits in the state until the gap closes; bytes that come again are left out. A connection ends with
    an error where a head is above ``most`` bytes or as many wait behind a gap (``too_long``, ``gap``), and, silent for ``stale``, where a gap or a message is still open (``gap``, ``unfinished``).
    """
    rows = chunks.where("offset is not null and ts is not null and data is not null").select("host", "connection", "direction", "offset", "ts", "data")
    timed = rows.withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", delay)
    dealt, named = bucketed(timed, ("host", "connection", "direction"), buckets, "offset", "ts", "data", "event_time")
    schema = "state_key string, ts long, head string, error string"
    return named(dealt.groupBy("state_bucket").transformWithStateInPandas(Heads(stale, most), schema, "Append", "EventTime"))
