"""Requests and responses in order: limits, late answers, answers to all; ids of ten fields."""

from signalloom.functions import hashing
from signalloom.operators import requests

REQUEST = "host string, connection string, ts long, seq long"


def fifo(spark, asked, answered, **limits):
    """seq -> (end, outcome) of one connection; requests and answers by time, answers to all as negative times."""
    ask = spark.createDataFrame([("h", "c", t, k) for k, t in enumerate(asked)], REQUEST)
    answer = spark.createDataFrame([("h", "c", abs(t), 100 + k, t < 0) for k, t in enumerate(answered)], REQUEST + ", whole boolean")
    return {r.seq: (r.end, r.outcome) for r in requests.match_fifo(ask, answer, answers_all="whole", **limits).collect()}


def test_a_full_queue_gives_up_the_oldest(spark):
    assert fifo(spark, [1, 2, 10], [3, 4, 11], most=1) == {0: (None, "overflow"), 1: (3, "matched"), 2: (11, "matched")}
    got = fifo(spark, list(range(5000, 5033)), [])
    assert got[0] == (None, "overflow") and sum(v[1] == "pending" for v in got.values()) == 32


def test_stale_requests_go_before_a_new_one(spark):
    assert fifo(spark, [0, 10], [11], timeout=5) == {0: (None, "expired"), 1: (11, "matched")}
    assert fifo(spark, [0, 5], [6], timeout=5) == {0: (None, "expired"), 1: (6, "matched")}
    # only a request looks for stale ones: an answer that comes late still answers
    assert fifo(spark, [0], [99], timeout=5) == {0: (99, "matched")}


def test_an_answer_to_all(spark):
    assert fifo(spark, [1, 2, 4], [-3, 5, 6]) == {0: (3, "matched"), 1: (3, "matched"), 2: (5, "matched")}
    assert fifo(spark, [3], [1, 2, 4]) == {0: (4, "matched")}


def test_keys_don_t_mix(spark):
    rows = [("h", c, t, t) for c in ("a", "b", None) for t in (1, 2)]
    back = [("h", c, t, t) for c in ("b", None) for t in (3, 4)]
    got = requests.match_fifo(spark.createDataFrame(rows, REQUEST), spark.createDataFrame(back, REQUEST)).collect()
    assert {(r.connection, r.seq, r.end) for r in got} == {("a", 1, None), ("a", 2, None), ("b", 1, 3), ("b", 2, 4), (None, 1, 3), (None, 2, 4)}


def fnv(data, seed):
    for b in data:
        seed = (seed ^ b) * hashing.PRIME % 2**64
    return seed


def test_ids_of_ten_fields(spark):
    rows = [("http", "server", 5, 9, 7, 3, "GET", "/a", 200, None, "10.0.0.1", 80), ("http", "server", 5, 9, 7, 3, "GET", "/a", 200, None, "10.0.0.2", 80), ("http", "server", 5, 9, 7, 4, "GET", "/a", 200, "x.example", "10.0.0.2", None), ("redis", None, 5, None, None, None, None, None, None, None, None, None)]
    schema = "protocol string, role string, start long, end long, pid long, cgroup_id long, method string, path string, status_code int, peer_domain string, peer_address string, peer_port int"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "array(named_struct('key', 'x', 'value', 'y'), named_struct('key', 'url.path', 'value', path)) AS attributes")
    from pyspark.sql import functions as F

    got = [r.i for r in df.orderBy("peer_address", "cgroup_id").select(requests._identity_ids(df, F.lit(True)).alias("i")).collect()]
    want = []
    for p, role, a, z, pid, cg, m, path, st, dom, addr, port in (rows[3], rows[0], rows[1], rows[2]):
        h = [fnv(v.encode(), hashing.OFFSET) if v is not None else 0 for v in (m, path)]
        peer = f"domain:{fnv(dom.encode(), hashing.OFFSET):016x}:{port or 'unknown'}" if dom else f"address:{fnv(addr.encode(), hashing.OFFSET):016x}:{port or 'unknown'}" if addr else "unknown-peer"
        text = f"{p.title()}|{f'Some({role.title()})' if role else 'None'}|{a}|{z or 0}|{pid or 0}|{cg or 0}|{h[0]}|{h[1]}|{st or 0}|{peer}".encode()
        x, y, s = (fnv(text, seed) for seed in hashing.SEEDS)
        want.append((f"{x:016x}{y:016x}", f"{s:016x}"))
    assert [tuple(i) for i in got] == want and len(set(got)) == 4
    assert df.select(requests._identity_ids(df, F.lit(False)).alias("i")).where("i.trace_id is not null").count() == 0


def test_addresses(spark):
    from pyspark.sql import functions as F

    from signalloom.functions.text import is_external

    want = {"2001:db8::1": True, "::1": False, "::": False, "fe80::1": False, "febf::": False, "fec0::1": True, "fc00::": False, "fdff:1::2": False, "ff02::1": False, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "::ffff:0808:0808": True, "::ffff:7f00:1": False,
            "1:2:3:4:5:6:7:8": True, "1:2:3:4:5:6:7": False, "1:2:3:4:5:6:7:8:9": False, "1::2::3": False, "1:2:3:4:5:6:7::8": False, "g::1": False, "64:ff9b::1.2.3.4": True, "64:ff9b::1.2.3.400": False, ":::": False, "8.8.8.8": True, "8.8.8": False, "192.168.1.1": False, "": False, None: False}
    got = spark.createDataFrame([(k,) for k in want], "a string").select("a", is_external(F.col("a")).alias("e")).collect()
    assert {r.a: bool(r.e) for r in got} == want


def test_answers_by_id(spark):
    """Against a plain loop: ids that are used again, answers at the same time, late ones, unknown keys."""
    import random

    rng = random.Random(8)
    asked = [("h", rng.choice(["hot", "c", None]), rng.choice([1, 1, 2, None]), rng.randrange(60), k) for k in range(200)]
    answered = [("h", rng.choice(["hot", "c", None]), rng.choice([1, 2, 2, None]), rng.randrange(60), k) for k in range(60)]
    schema, kv = "host string, connection string, correlation_id int, ts long, seq long", "array(named_struct('key', '{0}', 'value', string(seq)))"
    ask, answer = (spark.createDataFrame(rows, schema).selectExpr("*", kv.format(key) + " AS attributes") for rows, key in ((asked, "a"), (answered, "b")))
    got = {r.seq: (r.end, [a["value"] for a in r.attributes if a["key"] == "b"]) for r in requests.match_by_id(ask, answer, 4).collect()}
    for h, c, i, ts, seq in asked:
        mine = [] if c is None or i is None else [(t, s) for h2, c2, i2, t, s in answered if (h2, c2, i2) == (h, c, i) and ts <= t <= ts + 4]
        assert got[seq] == ((mine[0][0], [str(mine[0][1])]) if len(mine) == 1 else (None, []))
    assert sum(v[0] is not None for v in got.values()) > 5
