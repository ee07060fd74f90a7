"""Operators that split busy keys, against plain loops."""

import random

from signalloom.operators import common, export, profiling


def test_bounds_by_slices(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "cold", None]), k, rng.choice([None, *range(500)])) for k in range(900)]
    got = common.bounds_extensions(spark.createDataFrame(rows, "k string, seq long, at long"), ["k"], ["seq"], "at", width=7)
    assert got.columns == ["k", "seq", "at", "extends"]
    seen, want = {}, {}
    for k, seq, at in rows:
        low, high = seen.get(k, (None, None))
        want[seq] = int(low is None or (at is not None and (at < low or at > high)))
        if at is not None:
            seen[k] = (at, at) if low is None else (min(low, at), max(high, at))
    assert {r.seq: r.extends for r in got.collect()} == want


def test_jit_ranges_of_every_size(spark):
    rng = random.Random(6)
    ranges = [("h", 1, start, size, f"f{n}", n) for n, (start, size) in enumerate((rng.randrange(1 << 47), 1 << rng.choice([3, 12, 21, 30, 40, 46])) for _ in range(300))]
    ranges.append(("h", 1, ranges[0][2], ranges[0][3], "again", 300))
    points = [("h", 1, k % 90, r[2] + rng.randrange(r[3])) for k, r in enumerate(ranges)] + [("h", 2, 0, ranges[0][2])]
    points += points[:5]  # repeated rows stay
    got = profiling.resolve_jit(spark.createDataFrame(points, "host string, pid int, seq int, ip long"), spark.createDataFrame(ranges, "host string, pid int, start long, size long, name string, line_no int"))

    def best(host, pid, ip):
        held = [(r[2], r[5], r[4]) for r in ranges if (r[0], r[1]) == (host, pid) and r[2] <= ip < r[2] + r[3]]
        return max(held)[2] if held else None

    assert sorted((r.seq, r.ip, str(r.function)) for r in got.collect()) == sorted((p[2], p[3], str(best(p[0], p[1], p[3]))) for p in points)


def test_functions_of_repeated_addresses(spark):
    frames = spark.createDataFrame([(k, m, o) for k in range(3) for m, o in (("m", 15), ("m", 25), ("m", 5), (None, 15), ("m", None))], "seq int, module string, module_offset long")
    symbols = spark.createDataFrame([("m", 10, 10, "a"), ("m", 20, 0, "b")], "module string, start long, size long, name string")
    got = [(r.seq, r.module, r.module_offset, r.function) for r in profiling.resolve_function(frames, symbols).collect()]
    assert len(got) == 15
    assert {x[1:] for x in got} == {("m", 15, "a"), ("m", 25, "b"), ("m", 5, None), (None, 15, None), ("m", None, None)}


def test_groups_have_a_bounded_size(spark):
    spans = spark.range(1000).selectExpr("if(id < 900, 'hot', null) AS host", "md5(string(id)) AS trace_id", "substr(md5(string(id)), 1, 16) AS span_id", "'n' AS name", "id AS start", "id AS end")
    got = export.group_for_export(spans, ["host"], most=50).collect()
    assert sum(len(r.spans) for r in got) == 1000
    assert max(len(r.spans) for r in got) < 100
    assert {r.host for r in got} == {"hot", None}
