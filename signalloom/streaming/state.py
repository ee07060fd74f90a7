"""Stream forms that keep state by key, with timeouts."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.common import in_order
from .processors import BUCKETS, CONNECTION, MOST_BYTES, HeadReader, bucketed


def _timeout(ms: int | None) -> str:
    """Without a timeout a stream that is read to its end stops there; with one it goes on to look for idle keys."""
    return GroupStateTimeout.NoTimeout if ms is None else GroupStateTimeout.ProcessingTimeTimeout


def active_gauge_stream(events: DataFrame, idle_ms: int | None = 86_400_000, buckets: int = BUCKETS) -> DataFrame:
    """+1 for an open of a connection that isn't open, -1 for a close of one that is (T5): seq, delta.

    Connections are dealt to ``buckets``; the open ones of a bucket are one state, with the time of their last event. One that is silent for ``idle_ms`` counts as closed.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = pickle.loads(state.get[0]) if state.exists else {}
        now = 0 if idle_ms is None else state.getCurrentProcessingTimeMs()
        rows = [] if state.hasTimedOut else sorted((r for df in batches for r in zip(*(df[c].tolist() for c in ("state_key", "ts", "seq", "kind")), strict=True)), key=itemgetter(0, 1, 2))
        out, open_, quiet = [], {}, dict(known)
        for k, mine in groupby(rows, key=itemgetter(0)):
            is_open = quiet.pop(k, None) is not None
            for _, _, seq, kind in mine:
                if (kind == "open") != is_open:
                    is_open = not is_open
                    out.append((k, seq, 1 if is_open else -1))
            if is_open:
                open_[k] = now
        open_ |= quiet if idle_ms is None else {k: t for k, t in quiet.items() if now - t < idle_ms}
        if open_:
            state.update((pickle.dumps(open_),))
            if idle_ms is not None:
                state.setTimeoutDuration(max(min(open_.values()) + idle_ms - now, 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["state_key", "seq", "delta"])

    rows, named = bucketed(events.where("kind in ('open', 'close') and fd is not null"), CONNECTION, buckets, "ts", "seq", "kind")
    return named(rows.groupBy("state_bucket").applyInPandasWithState(step, "state_key string, seq long, delta int", "held binary", "append", _timeout(idle_ms)))


def http_heads(chunks: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Request and response heads of HTTP/1 from a table of chunks of bytes (T10): host, connection, direction, ts, head, error.

    ``chunks``: host, connection, direction, offset, ts, data. Chunks are put in order by offset; at most a head is held. A gap or a head above ``most`` bytes ends a connection with an error.
    """

    def begin():
        return HeadReader(most=most).feed, lambda: []

    rows = chunks.select("host", "connection", "direction", "offset", "ts", "data")
    return in_order(rows, ("host", "connection", "direction"), ("offset", "ts"), begin, "host string, connection string, direction string, ts long, head string, error string")
