"""Scalar functions against plain Python models and literal cases."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalloom.functions import bounds, hashing, policy, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def fnv(data: bytes, h: int = hashing.OFFSET) -> int:
    for b in data:
        h = (h ^ b) * hashing.PRIME & (1 << 64) - 1
    return h


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=20))
def test_fnv_model(values):
    assert hashing.fnv1a64_many(values).tolist() == [fnv(v) for v in values]


def test_truncate_model(spark):
    words = ["", "a", "éé", "漢字かな", "🙂🙂", "a🙂b", "x" * 9, "ééééé", "ab漢"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    for limit in (1, 2, 3, 4, 5, 7):
        got = [r[0] for r in rows.select(text.truncate_utf8(F.col("w"), limit)).collect()]
        assert got == [w.encode()[:limit].decode(errors="ignore") if len(w.encode()) > limit else w for w in words]


def test_domains(spark):
    cases = {" Example.COM.. ": "example.com", "a_b.com": None, "-a.com": None, "a-.com": None, "": None, "a" * 64 + ".com": None, "x.y": "x.y", ".".join(["a" * 60] * 5): None}
    rows = spark.createDataFrame(list(cases.items()), "name string, want string")
    assert rows.where(~text.normalize_domain(F.col("name")).eqNullSafe(F.col("want"))).count() == 0


def test_external_addresses(spark):
    cases = {"8.8.8.8": True, "10.1.2.3": False, "172.16.0.1": False, "172.32.0.1": True, "192.168.1.1": False, "127.0.0.1": False, "169.254.1.1": False, "224.0.0.1": False, "255.255.255.255": False, "0.0.0.0": False, "::ffff:10.0.0.1": False, "::ffff:8.8.8.8": True, "bad": False, "1.2.3.400": False}
    rows = spark.createDataFrame(list(cases.items()), "a string, want boolean")
    assert rows.where(text.is_external_ipv4(F.col("a")) != F.col("want")).count() == 0


def test_redaction(spark):
    def run(*args):
        return one(spark, bounds.redact_argv(F.array(*map(F.lit, args))))

    assert run("--password=x", "y") == ["--password=<redacted>", "y"]
    assert run("--token", "abc", "z") == ["--token", "<redacted>", "z"]
    assert run("Bearer abc") == ["<redacted>"]
    assert run("plain", "x=1") == ["plain", "x=1"]
    assert run("--api-key:", "v") == ["--api-key:", "<redacted>"]
    assert run() == []


def test_label_bounds(spark):
    labels = F.create_map(*[F.lit(x) for k in ("b", "a", "", "c") for x in (k, k * 3)])
    assert one(spark, bounds.bound_labels(labels, 2)) == {"a": "aaa", "b": "bbb"}


@settings(max_examples=20, deadline=None)
@given(st.text("ab*?.", max_size=6), st.text("ab.", max_size=6))
def test_glob_model(spark, pattern, value):
    model = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    assert one(spark, text.glob(pattern, F.lit(value))) == bool(re.fullmatch(model, value))


def test_capture_order(spark):
    rule = policy.CapturePolicy(default_capture=True, exclude_namespaces=("kube-*",), include_namespaces=("a", "kube-system"))
    for namespace, want in (("a", True), ("b", False), ("kube-system", False), (None, False)):
        assert one(spark, rule.column(F.lit(namespace).cast("string"), F.lit(None).cast("map<string,string>"), F.lit("p"), F.lit("c"))) is want
    assert one(spark, policy.CapturePolicy(default_capture=False).column(F.lit("a"), F.lit(None).cast("map<string,string>"), F.lit("p"), F.lit("c"))) is False


def test_traceparent(spark):
    good = "00-" + "a" * 32 + "-" + "b" * 16 + "-01"
    assert one(spark, text.parse_traceparent(F.lit(good)))["trace_id"] == "a" * 32
    for value, reason in ((good + "-x", "malformed"), (good.replace("a", "A"), "invalid_hex"), ("ff" + good[2:], "reserved_version"), (good.replace("a" * 32, "0" * 32), "all_zero_trace_id"), (good.replace("b" * 16, "0" * 16), "all_zero_span_id"), (None, "malformed")):
        assert one(spark, text.parse_traceparent(F.lit(value).cast("string")))["reason"] == reason


def test_hashes_are_read_where_arrow_holds_the_bytes(spark):
    import pyarrow as pa

    from signalloom.functions.hashing import fnv1a64_array, fnv1a64_many

    words = ["lost", "", None, "a", "é" * 3000, "foobar"]
    want = [None if w is None else f"{h:016x}" for w, h in zip(words, fnv1a64_many([(w or "").encode() for w in words]).tolist(), strict=True)]
    for kind in (pa.string(), pa.large_string()):
        assert fnv1a64_array(pa.array(words, kind).slice(1)).to_pylist() == want[1:]
    assert fnv1a64_array(pa.array([b"a", b"\xff"], pa.binary())).to_pylist()[0] == "af63dc4c8601ec8c"
    assert fnv1a64_array(pa.array([None, None], pa.string())).to_pylist() == [None, None]
    assert fnv1a64_array(pa.array([], pa.string())).to_pylist() == []
