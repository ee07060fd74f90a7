"""Keyed state over several batches, timers and caps, against plain loops."""

import random

import pandas as pd
import pytest

from signalloom.operators import peer
from signalloom.plans.streams import _drain
from signalloom.streaming import processors


def feed(spark, tmp_path, rows, schema, batches):
    """A stream that gets ``rows`` in so many batches, a file each."""
    for k in range(batches):
        part = rows[k * len(rows) // batches : (k + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")


# --- life cycles --------------------------------------------------------------------------------------------------------


def loop(rows):
    """Life cycles by a plain loop: rows are (seq, kind, ts, opened_at, sent)."""
    state, now, out = {}, processors.UNKNOWN, {}
    known = [r[3] for r in rows if r[3] != processors.UNKNOWN]
    for seq, kind, ts, opened, sent in rows:
        if opened != processors.UNKNOWN:
            now = opened
        elif now == processors.UNKNOWN and known:
            now = known[0]
        before, closed = state.get(now, (None, None))
        if kind == "snapshot" and closed is not None and ts <= closed:
            continue
        out[seq] = sent if before is None or sent < before else sent - before
        state[now] = (None, ts) if kind == "close" else (sent, None)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_life_cycles_in_any_batches(seed):
    rng = random.Random(seed)
    cycles = rng.choice([[1, 2, 3], [1, 2, 3, processors.UNKNOWN], [processors.UNKNOWN]])
    rows = [(k, rng.choice(["snapshot", "snapshot", "close"]), rng.randrange(30), rng.choice(cycles), rng.randrange(100)) for k in range(40)]
    if cycles[-1] == processors.UNKNOWN and len(cycles) > 1:
        rows[0] = (*rows[0][:3], 2, rows[0][4])  # else what begins unknown depends on what is known by then
    for size in (1, 3, 40):
        state, got = {}, {}
        for at in range(0, len(rows), size):
            df = pd.DataFrame([(*r, r[4] * 2) for r in rows[at : at + size]], columns=["seq", "kind", "ts", "opened_at", "bytes_sent", "bytes_received"])
            out, state = processors.cycle_intervals(df.sample(frac=1, random_state=seed), state)
            assert (out["received"] == out["sent"] * 2).all()
            got |= dict(zip(out["seq"], out["sent"], strict=True))
        assert got == loop(rows)


def test_an_unknown_cycle_becomes_the_first_known_one():
    first = pd.DataFrame([(1, "snapshot", 5, processors.UNKNOWN, 10, 0)], columns=["seq", "kind", "ts", "opened_at", "bytes_sent", "bytes_received"])
    _, state = processors.cycle_intervals(first, {})
    out, state = processors.cycle_intervals(first.assign(seq=2, opened_at=3, bytes_sent=14), state)
    assert out["sent"].tolist() == [4] and list(state) == [3]


# --- requests in flight -------------------------------------------------------------------------------------------------


def test_unanswered_requests_come_out_of_the_timer(spark, tmp_path):
    """33 requests and no answer: the oldest is pushed out, the others come when the watermark passes; a late answer finds nothing; an answer in a later batch finds its request."""
    s = 1_000_000_000
    rows = [("h", "full", (100 + k) * 1000, 0, k) for k in range(1, 34)] + [("h", "late", s, 0, 50), ("h", "ok", 2 * s, 0, 60)]
    rows += [("h", "ok", 20 * s, 1, 61), ("h", "late", 32 * s, 1, 51), ("h", "ok", 33 * s, 1, 62)]
    rows += [("h", "end", 90_000 * s, 0, 70)]
    out = _drain(processors.match_fifo_stream(feed(spark, tmp_path, rows, "host string, connection string, ts long, kind int, seq long", 3), delay="1 hour"))
    got = {(r.connection, r.seq): (r.outcome, r.end) for r in out.collect()}
    assert got.pop(("full", 1)) == ("overflow", None)
    assert got == {("full", k): ("expired", None) for k in range(2, 34)} | {("late", 50): ("expired", None), ("ok", 60): ("matched", 20 * s)}


# --- HTTP heads ---------------------------------------------------------------------------------------------------------


def test_heads_with_gaps(spark, tmp_path):
    s = 1_000_000_000
    message = b"GET /%d HTTP/1.1\r\nContent-Length: 5\r\n\r\nhello"
    whole = b"".join(message % k for k in range(6))
    cut = [("h", "good", "in", at, s + at, whole[at : at + 11]) for at in range(0, len(whole), 11)]
    random.Random(1).shuffle(cut)
    cut += [("h", "good", "in", 0, s, whole[:30])]  # sent again
    cut += [("h", "gap", "in", 10, s, b"xx"), ("h", "long", "in", 0, s, b"x" * 300), ("h", "behind", "in", 9, s, b"y" * 300), ("h", "cut", "in", 0, s, b"GET / HT")]
    cut += [("h", "end", "in", 0, 9_000 * s, b"A /b\r\n\r\n")]
    stream = feed(spark, tmp_path, cut, "host string, connection string, direction string, offset long, ts long, data binary", 3)
    got = sorted((r.connection, r.error or "", (r.head or "").split(" HTTP")[0]) for r in _drain(processors.http_heads_stream(stream, most=200, delay="1 hour")).collect())
    assert got == sorted([("good", "", f"GET /{k}") for k in range(6)] + [("gap", "gap", ""), ("long", "too_long", ""), ("behind", "gap", ""), ("cut", "unfinished", ""), ("end", "", "A /b")])


# --- series alive -------------------------------------------------------------------------------------------------------


def admit(rows, most, idle, live=()):
    """Places by a plain loop: rows are (host, key, ts, seq, bytes)."""
    places, out = {k: list(v) for k, v in live}, {}
    for host, key, ts, seq, size in sorted(rows, key=lambda r: (r[2], r[3])):
        places = {k: v for k, v in places.items() if k[0] != host or ts - v[1] < idle}
        mine = places.get((host, key))
        if mine:
            mine[1] = max(mine[1], ts)
        elif size == 0:
            continue
        elif sum(k[0] == host for k in places) < most:
            mine = places[host, key] = [ts, ts]
        out[seq] = mine[0] if mine else None
    return out, places


SCHEMA = "host string, key string, ts long, seq long, bytes long"


@pytest.mark.parametrize(("seed", "most", "idle"), [(1, 2, 5), (2, 3, 9), (3, 1, 3), (4, 50, 5), (5, 0, 5)])
def test_the_cap_holds_for_series_alive(spark, seed, most, idle):
    rng = random.Random(seed)
    rows, t = [], 0
    for k in range(250):
        t += rng.choice([0, 0, 1, 1, 2, 20 if k % 60 == 0 else 0])
        rows.append((rng.choice(["a", "a", None]), rng.choice("klmnopq"), t, k, rng.choice([0, 1, 2])))
    got, alive = peer.admitted(spark.createDataFrame(rows, SCHEMA), ("host", "key"), ("host",), most, idle)
    want, places = admit(rows, most, idle)
    assert {r.seq: r.born for r in got.collect()} == want and all(r.overflow == (r.born is None) for r in got.collect())
    assert {((r.host, r.key), (r.born, r.end)) for r in alive.collect()} == {(k, tuple(v)) for k, v in places.items() if t - v[1] < idle}


def test_the_cap_goes_on_from_batch_to_batch(spark):
    rng = random.Random(9)
    rows = [("a", rng.choice("klmnop"), k // 2, k, rng.choice([0, 1])) for k in range(120)]
    want, _ = admit(rows, 2, 4)
    got, live = {}, None
    for at in range(0, 120, 40):
        part, live = peer.admitted(spark.createDataFrame(rows[at : at + 40], SCHEMA), ("host", "key"), ("host",), 2, 4, live)
        got |= {r.seq: r.born for r in part.collect()}
    assert got == want
