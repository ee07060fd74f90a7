"""Running values, sessions and ranks in slices, against plain loops; a busy key is read by several tasks."""

import random

from pyspark.sql import functions as F

from signalloom.operators import requests, running


def table(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.randrange(300), k, rng.choice([None, *range(-5, 9)])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "k string, ts long, seq long, v long")


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], r[2]))


def test_running_values(spark):
    rows, df = table(spark)
    kinds = {"total": ("sum", "v"), "low": ("min", "v"), "high": ("max", F.col("v") + 1), "latest": ("last", "v")}
    for inclusive in (True, False):
        got = {r.seq: (r.total, r.low, r.high, r.latest) for r in running.running(df, ["k"], ["ts", "seq"], kinds, inclusive, splits=[30, 31, 90, 200]).collect()}
        seen, want = {}, {}
        for k, _, seq, v in in_order(rows):
            before = seen.setdefault(k, [])
            if inclusive and v is not None:
                before.append(v)
            want[seq] = (sum(before), min(before), max(before) + 1, before[-1]) if before else (None,) * 4
            if not inclusive and v is not None:
                before.append(v)
        assert got == want


def test_sessions(spark):
    rows, df = table(spark, 300, 2)
    at = F.when(F.col("v") > 0, F.col("ts"))
    got = {r.seq: (r.session, r.n) for r in running.sessions(df.withColumn("at", at), ["k"], ["ts", "seq"], "at", 4, total="n", splits=[20, 100, 101, 250]).collect()}
    seen, number, want = {}, {}, {}
    for k, ts, seq, v in in_order(rows):
        if v is not None and v > 0:
            if k not in seen or ts - seen[k] >= 4:
                number[k] = number.get(k, 0) + 1
            seen[k] = ts
        want[seq] = number.get(k, 0)
    assert {s: g[0] for s, g in got.items()} == want
    keys = {seq: k for k, _, seq, _ in rows}
    assert all(g[1] == number.get(keys[s], 0) for s, g in got.items())


def test_dense_ids(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]), rng.choice([None, "", "x", "ä", "zz", *map(str, range(200))]), rng.randrange(3)) for _ in range(900)]
    got = {(r.k, r.s, r.n): r.id for r in running.dense_ids(spark.createDataFrame(rows, "k string, s string, n int"), ["k"], ["s", "n"], "id").collect()}
    for k in "ab":
        mine = sorted({r for r in rows if r[0] == k}, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[2]))
        assert [got[r] for r in mine] == list(range(1, len(mine) + 1))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, ts long, seq long, v long")
    assert running.running(df, ["k"], ["ts"], {"t": ("sum", "v")}).collect() == []
    assert running.sessions(df, ["k"], ["ts"], "ts", 5).collect() == []
    assert running.dense_ids(df, ["k"], ["v"], "id").collect() == []


def test_a_busy_key_is_read_by_several_tasks(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), F.lit(1).alias("one"))
    out = running.running(df, ["k"], ["seq"], {"n": ("sum", "one")})
    sizes = [r["n"] for r in running._sliced(df, ["seq"], None).groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert [r.n for r in out.orderBy("seq").collect()] == list(range(1, 4001))


def test_pieces_of_a_connection_give_what_one_pass_gives(spark):
    """The same queue over a connection as a whole, in a plain loop; limits are met, and times tie."""
    rng = random.Random(4)
    rows, t = [], 0
    for k in range(800):
        t += rng.choice([0, 1, 1, 2, 3, 9])
        rows.append(("h", rng.choice(["hot", "hot", "cold"]), t, rng.choice([0, 0, 0, 1, 1, 2]), k))
    ask = spark.createDataFrame([r for r in rows if r[3] == 0], "host string, connection string, ts long, kind int, seq long")
    answer = spark.createDataFrame([r for r in rows if r[3]], "host string, connection string, ts long, kind int, seq long").withColumn("all", F.col("kind") == 2)
    for strict in (False, True):
        got = sorted(tuple(r) for r in requests.match_fifo(ask, answer, 6, 3, "all", strict).select("connection", "seq", "start", F.coalesce("end", F.lit(-1)), "outcome").collect())
        want = []
        for c in ("hot", "cold"):
            flying, feed = requests.fifo(6, 3, strict)
            done = [x for r in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[3], r[4])) for x in feed(*r[2:])]
            want += [(c, s, a, -1 if e is None else e, o) for s, a, e, _, o in [*done, *[(*f, None, None, "pending") for f in flying]]]
        assert got == sorted(want)
        assert {"expired", "matched", "overflow"} <= {o for *_, o in want}
