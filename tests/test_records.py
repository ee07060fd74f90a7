"""Records of literal rows."""

from pyspark.sql import functions as F

from signalloom.operators import records

OWN = "attributes array<struct<key:string,value:string>>"


def test_metric_attributes(spark):
    rows = spark.createDataFrame([("n1", 7, 5, "x" * 300, [("state", "user"), ("auth_key", "s"), ("state", "idle"), (None, "z")]), ("n2", None, 6, None, None)], "host string, pid int, value long, command string, " + OWN)
    one, two = records.to_metric_records(rows, "resource_counter_metric", F.lit("system.cpu.time"), F.lit("ns")).collect()
    assert one.attributes == {"cpu.mode": "idle", "process.pid": "7", "process.command": "x" * 256, "host.name": "n1"}
    assert (one.kind, one.value, one["count"], one.resource) == ("sum", 5.0, None, {"host.name": "n1"})
    assert two.attributes == {"host.name": "n2"}


def test_summaries(spark):
    rows = spark.createDataFrame([("h", "a.b", "NX_Domain", 3, 30, 5, 20)], "host string, domain string, response_code string, count long, sum long, min long, max long")
    got = records.to_metric_records(rows, "dns_latency_metric", F.lit("d"), F.lit("ns")).first()
    assert (got.value, got["count"], got.min, got.max) == (30.0, 3, 5, 20)
    assert got.attributes == {"dns.question.name": "a.b", "dns.response_code": "nxdomain", "host.name": "h"}


def test_span_ids_and_status(spark):
    good = ("ab" * 16, "CD" * 8, "zz")
    rows = spark.createDataFrame([("s", 1, 4, *good, "net", [("k", "v")]), ("t", 1, None, "0" * 32, "cd" * 8, None, None, None)], "name string, start long, end long, trace_id string, span_id string, parent_span_id string, error_type string, " + OWN)
    one, two = records.to_trace_records(rows, "service_interaction_span_observation").orderBy("name").collect()
    assert (one.trace_id, one.span_id, one.parent_span_id, one.status, one.status_message, one.duration) == ("ab" * 16, "cd" * 8, None, "error", "net", 3)
    assert one.attributes == {"k": "v", "error.type": "net"}
    assert (two.trace_id, two.span_id, two.status, two.duration) == (None, None, None, None)
    assert records.to_trace_records(rows, "trace_span_observation").where("status is not null").count() == 0


def test_request_peers(spark):
    columns = "name string, start long, end long, protocol string, status_code int, role string, peer_address string, peer_port int, " + OWN
    rows = spark.createDataFrame([("a", 1, 2, "http", 200, "server", "10.0.0.1", 80, []), ("b", 1, 2, "grpc", 0, "client", "10.0.0.1", 80, [])], columns)
    one, two = records.to_trace_records(rows, "request_span_observation").orderBy("name").collect()
    assert one.attributes == {"network.protocol.name": "http", "http.response.status_code": "200", "client.address": "10.0.0.1", "client.port": "80", "network.peer.address": "10.0.0.1", "network.peer.port": "80"}
    assert two.attributes == {"network.protocol.name": "grpc", "rpc.grpc.status_code": "0", "server.address": "10.0.0.1", "server.port": "80"}
