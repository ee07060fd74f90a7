"""What only larger tables show: sums above 64 bits, high keys, busy keys."""

import os

import duckdb
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalloom import plans
from signalloom.functions.bounds import TOP
from signalloom.operators import common, network, profiling, records, topology
from test_operators import conn


def test_durations_above_64_bits_stay_at_the_top(spark):
    long = 4 * 10**18
    rows = conn(spark, *[(k * long // 2 if kind == "open" else k * long // 2 + long, kind, fd, "n", 0) for k in range(2) for fd in range(3) for kind in ("open", "close")][:6])
    got = network.durations(rows).first()
    assert (got["count"], got["sum"], got["max"]) == (3, TOP, long)


def test_pods_with_high_keys_are_watched(spark, tmp_path):
    for t in ("customer", "nation", "region"):
        rows = spark.read.parquet(f"{SMALL}/{t}.parquet")
        (rows.withColumn("c_custkey", F.col("c_custkey") + 700_000) if t == "customer" else rows).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    con = duckdb.connect()
    for t in ("customer", "nation", "region"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = plans.QUERIES["s6_pod_watch_stream"](spark, str(tmp_path)).select("pod_name", "node_name").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT pod_name, node_name FROM ({plans.ORACLES['s6_pod_watch_stream']})").fetchall())


def test_ranges_of_one_key_are_read_slice_by_slice(spark):
    ranges = spark.createDataFrame([("m", 10 * k, None if k == 3 else f"f{k}", k) for k in range(50)] + [("m", 30, "first", 99)], "module string, start long, name string, n int")
    points = spark.range(500).select(F.lit("m").alias("module"), F.col("id").alias("at"))
    out = profiling.as_of(points, ranges, ("module",), "at", "start", ("name", "n"), ("name",))
    assert "_slice" in out._jdf.queryExecution().toString()
    got = {r["at"]: (r["range_start"], r["n"]) for r in out.collect()}
    assert got == {k: (k // 10 * 10, k // 10) for k in range(500)}


def test_rows_without_a_key_are_spread(spark):
    dims = spark.createDataFrame([(k, k * 2) for k in range(5)], "d long, twice long")
    rows = spark.range(400).select("id", F.when(F.col("id") % 4 == 0, F.col("id") % 10).alias("k"))
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = common.look_up(rows, "k", dims, "d").withColumn("place", F.spark_partition_id()).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert {r["id"]: r["twice"] for r in out} == {k: k % 10 * 2 if k % 4 == 0 and k % 10 < 5 else None for k in range(400)}
    assert len({r["place"] for r in out if r["k"] is None}) > 1


def test_only_the_wanted_profile_tables_are_made(spark):
    frame = "struct<domain:string,symbol:string,module:string,file:string,line:int,module_offset:long>"
    rows = spark.createDataFrame([("s", 1, "cpu", 2, 10, [("user", "b", "m", None, None, 1), ("user", "a", "m", None, None, 1)])], f"source string, seq long, kind string, sample_count long, period long, frames array<{frame}>")
    made = profiling.pprof_tables(rows, ["source"], ["strings"])
    assert list(made) == ["strings"]
    assert [(r["string"], r["string_id"]) for r in made["strings"].orderBy("string_id").collect()] == [("", 1), ("a", 2), ("b", 3), ("m", 4)]


def test_metric_kinds_with_durations_above_64_bits(spark, tmp_path):
    for t in os.listdir(SMALL):
        if t != "events.parquet":
            os.symlink(f"{SMALL}/{t}", tmp_path / t)
    rows = [(8 * k + end, f"{'2261' if end else '1971'}-01-01", 20 * k, "purchase" if end else "signup") for k in range(3) for end in (0, 1)]
    duckdb.sql(f"COPY (SELECT e AS event_id, CAST(t AS TIMESTAMP) AS ts, u AS user_id, w AS event_type, 1.0 AS value, '{{\"k\": 1}}' AS props FROM (VALUES {', '.join(map(str, rows))}) v(e, t, u, w)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = plans.QUERIES["s11_metric_kinds"](spark, str(tmp_path)).where("record = 'network_duration_metric'").collect()
    assert [(r["count"], r["value"]) for r in got] == [(3, float(TOP))]


def test_own_attributes_are_worked_out_once_a_row(spark):
    rows = spark.range(3).select(F.lit("system.disk.io").alias("metric"), F.col("id").alias("value"), F.array(F.struct(F.lit("device").alias("key"), F.col("id").cast("string").alias("value")), F.struct(F.lit("state").alias("key"), F.lit("read").alias("value"))).alias("attributes"))
    out = records.to_metric_records(rows, "resource_counter_metric", F.col("metric"), F.lit("1"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("slice(") == 1
    assert out.orderBy("value").first()["attributes"] == {"system.device": "0", "disk.io.direction": "read"}


def test_a_lookup_works_out_only_what_is_read(spark):
    upto = Window.partitionBy("k").orderBy("ts", "seq")
    rows = spark.range(60).select(F.col("id").alias("seq"), F.col("id").alias("ts"), F.when(F.col("id") % 3 == 0, F.col("id") % 6).alias("k")).withColumn("total", F.sum("ts").over(upto))
    out = common.look_up(rows, "k", spark.createDataFrame([(k, k * 2) for k in range(5)], "d long, twice long"), "d").select("seq", "twice")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["seq"]: r["twice"] for r in out.collect()} == {k: k % 6 * 2 if k % 3 == 0 else None for k in range(60)}


def test_observed_paths_read_their_tables_once(spark):
    who = "'h' AS host, 'n' AS namespace, 'u' AS pod_uid, 'p' AS pod_name, 'c' AS container_name, md5(string(id)) AS container_id, id AS ts, id AS seq"
    opens = spark.range(5).selectExpr(*who.split(", "), "'10.0.0.1' AS remote_address", "80 AS remote_port", "'tcp' AS protocol")
    answers = spark.range(5).selectExpr(*who.split(", "), "'x' AS domain", "'no_error' AS response_code")
    out = topology.observed_paths(opens, answers)
    assert "md5(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.path_label, r.observations) for r in out.collect()} == {("n/u/c->10.0.0.1:80", 1), ("n/u/c->x", 5)}


def test_spans_without_attributes_of_their_own_merge_no_maps(spark):
    rows = spark.createDataFrame([("s", 1, 4, 80, "net")], "name string, start long, end long, remote_port int, error_type string")
    out = records.to_trace_records(rows, "service_interaction_span_observation")
    assert "map_concat" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert (out.first().status, out.first().attributes) == ("error", {"server.port": "80", "error.type": "net"})
