"""The functions of the catalog give what the library's columns give."""

import pytest
from pyspark.sql import functions as F

from signalloom.functions import catalog, hashing, text

ADDRESSES = ["8.8.8.8", "10.1.2.3", "127.0.0.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "192.169.1.1", "169.254.3.4", "224.0.0.1", "240.0.0.1", "255.255.255.255", "0.0.0.0", "1.2.3", "256.1.1.1", "01.2.3.4", "", None, "::", "::1", "2001:db8::1", "fe80::1", "febf::", "fec0::1", "fc00::1", "fd12::", "ff02::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::FFFF:8.8.4.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", "12345::", "g::1", "::1.2.3.4", "64:ff9b::192.0.2.33", "1::256.1.1.1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "x:1"]
NAMES = ["Example.COM.", "  a.b  ", "-bad.com", "a..b", "", None, "a" * 64 + ".com", ".".join(["a" * 60] * 5), "xn--a.b", "..."]
PATHS = ["/kubepods/pod1/cri-containerd-" + "a1" * 32 + ".scope", "/docker/" + "b2" * 32, "/user/" + "b2" * 32, "/docker/" + "c" * 65, "/docker/short", "", None]
HEADERS = ["00-" + "a" * 32 + "-" + "b" * 16 + "-01", "ff-" + "a" * 32 + "-" + "b" * 16 + "-01", "00-" + "0" * 32 + "-" + "b" * 16 + "-01", "00-" + "a" * 32 + "-" + "0" * 16 + "-01", "00-" + "A" * 32 + "-" + "b" * 16 + "-01", "00", "", None, "00-a-b-c-d", "00-" + "a" * 32 + "-" + "b" * 16 + "-01-x"]
TEXTS = ["", "abc", "äöü", "漢字かな", "🙂🙂", "a🙂", None, "a.b*c?", "x\ny"]
PATTERNS = ["*", "a*", "?b?", "a.b", "*.b*", "[a]*", "x?y", "abc", "a\\E*", ""]


@pytest.fixture(scope="module")
def names(spark):
    return catalog.register(spark)


def same(spark, values, kind, column, call):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    rows = df.select("v", column(F.col("v")).alias("a"), F.expr(call).alias("b")).collect()
    assert [(r.v, r.b) for r in rows] == [(r.v, r.a) for r in rows]


@pytest.mark.parametrize(("values", "column", "call"), [(ADDRESSES, text.is_external, "is_external_address(v)"), (NAMES, text.normalize_domain, "normalize_domain(v)"), (PATHS, text.container_of_path, "container_of_path(v)"), (TEXTS + PATHS, hashing.fnv1a64, "fnv1a64(v)")])
def test_scalar_functions(spark, names, values, column, call):
    same(spark, values, "string", column, call)


@pytest.mark.parametrize("limit", range(8))
def test_truncation(spark, names, limit):
    same(spark, TEXTS, "string", lambda v: text.truncate_utf8(v, limit), f"truncate_utf8(v, {limit})")


@pytest.mark.parametrize("pattern", PATTERNS)
def test_globs(spark, names, pattern):
    df = spark.createDataFrame([(pattern, v) for v in [*TEXTS, "[a]x", "a\\E1", "axb"]], "p string, v string")
    rows = df.select("v", text.glob(pattern, F.col("v")).alias("a"), F.expr("glob_match(p, v)").alias("b")).collect()
    assert [(r.v, r.b) for r in rows] == [(r.v, r.a) for r in rows]


def test_the_table_function(spark, names):
    spark.createDataFrame([(k, v) for k, v in enumerate(HEADERS)], "k int, v string").createOrReplaceTempView("headers")
    got = spark.sql("SELECT h.k, t.* FROM headers h, LATERAL traceparent(h.v) t ORDER BY k").collect()
    want = spark.table("headers").select("k", text.parse_traceparent(F.col("v")).alias("c")).select("k", "c.*").orderBy("k").collect()
    assert got == want and len(got) == len(HEADERS)


def test_sql_functions_are_compiled(spark, names):
    plan = spark.range(3).selectExpr("normalize_domain(string(id))", "is_external_address(string(id))")._jdf.queryExecution().executedPlan().toString()
    assert "ython" not in plan and "ArrowEval" not in plan
