"""Metric and trace records of all kinds over the provided tables: each from the query that makes its rows."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records, requests
from . import analysis, network, spans
from .registry import ORACLES, query


def _rendered(df: DataFrame) -> DataFrame:
    """``df`` with its attributes as one text, by key."""
    return df.withColumn("attributes", F.array_join(F.sort_array(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"))


def _rendered_sql(names: dict[str, str]) -> str:
    return f"array_to_string(list_sort([x FOR x IN [{', '.join(f"'{k}=' || CAST({c} AS STRING)" for k, c in names.items())}] IF x IS NOT NULL]), ';')"


#: Query of the rows, its name, the column of the value and the metric's name, by kind.
_METRICS = {
    "network_counter_metric": (network.a4, "a4_failure_counters", "value", "'network.connection.failure.count'"),
    "network_peer_flow_metric": (network.a9, "a9_peer_flow_bytes", "value", "'network.peer.flow.bytes'"),
    "network_duration_metric": (network.a6, "a6_connection_durations", "sum", "'network.connection.duration'"),
    "network_gauge_metric": (network.a7, "a7_active_connections", "value", "'network.connection.active'"),
    "dns_counter_metric": (network.a11, "a11_dns_codes", "value", "'dns.response.code.count'"),
    "dns_latency_metric": (network.a12, "a12_dns_lookup_duration", "sum", "'dns.lookup.duration'"),
    "resource_gauge_metric": (analysis.a18, "a18_resource_gauges", "value", "metric"),
    "resource_counter_metric": (analysis.a17, "a17_resource_counters", "delta", "metric"),
}


def _metric_sql(kind: str) -> str:
    _, source, value, name = _METRICS[kind]
    form, names = records.METRICS[kind]
    who = records.HOST if kind == "network_peer_flow_metric" else {"host.name": "host", "container.id": "container_id"}
    if kind == "resource_counter_metric":
        text = "'disk.io.direction=' || state || ';system.device=' || device"
    elif kind == "resource_gauge_metric":
        text = "'system.filesystem.mountpoint=' || device"
    elif kind.startswith("dns"):
        text = _rendered_sql({"dns.question.name": "domain", "dns.response_code": "replace(response_code, '_', '')"} | who)
    else:
        known = {k: c for k, c in names.items() if kind in ("network_counter_metric", "network_peer_flow_metric") or c in ("protocol", "address_family")}
        text = _rendered_sql(known | who)
    return f"SELECT '{kind}' AS record, {name} AS name, '{form}' AS kind, CAST({value} AS DOUBLE) AS value, {'count' if value == 'sum' else 'CAST(NULL AS BIGINT)'} AS count, {text} AS attributes FROM ({ORACLES[source]})"


@query("s11_metric_kinds", " UNION ALL ".join(map(_metric_sql, _METRICS)))
def s11_kinds(spark, d):
    def of(kind: str) -> DataFrame:
        make, _, value, name = _METRICS[kind]
        rows = make(spark, d)
        if kind.startswith("resource"):
            device = F.struct(F.lit("device" if value == "delta" else "mountpoint").alias("key"), F.col("device").cast("string").alias("value"))
            state = F.struct(F.lit("state").alias("key"), F.col("state").alias("value")) if value == "delta" else F.struct(F.lit("token").alias("key"), F.lit("x").alias("value"))
            rows = rows.withColumn("attributes", F.array(device, state)).withColumn("value", F.col(value))
        return records.to_metric_records(rows, kind, F.expr(name), F.lit("1")).select("record", "name", "kind", "value", "count", "attributes")

    return _rendered(reduce(DataFrame.unionByName, map(of, _METRICS)))


#: Query of the rows, its name, the record's name, times and status, and attributes, by kind.
_WARNED = {"warning.type": "warning", "process.pid": "pid"}
_TRACES = {
    "service_interaction_span_observation": (network.d3, "d3_interaction_spans", "name", "start, \"end\", duration, error_type IS NOT NULL AS failed", {"server.address": "remote_address", "server.port": "remote_port", "process.pid": "pid", "error.type": "error_type"}),
    "trace_service_path_observation": (network.a15, "a15_service_paths", "'trace.service.path'", "first_seen AS start, last_seen AS \"end\", last_seen - first_seen AS duration, false AS failed", {"trace.service.path.key": "path_label", "trace.service.path.observations": "observations"}),
    "trace_correlation_warning": (network.d3w, "d3_interaction_warnings", "'trace.correlation.warning'", "ts AS start, ts AS \"end\", 0 AS duration, false AS failed", {"warning.type": "warning", "trace.source.signal.kind": "source_kind", "server.address": "remote_address", "server.port": "remote_port"}),
    "request_correlation_warning": (spans.d5, "d5_request_warnings", "'request.correlation.warning'", "ts AS start, ts AS \"end\", 0 AS duration, false AS failed", _WARNED | {"network.protocol.name": "protocol"}),
    "network_flow_warning": (network.d2, "d2_flow_warnings", "'network.flow.warning'", "ts AS start, ts AS \"end\", 0 AS duration, false AS failed", _WARNED | {"server.address": "remote_address", "server.port": "remote_port"}),
    "profiling_warning_observation": (spans.d6, "d6_profile_warnings", "'profiling.warning'", "ts AS start, ts AS \"end\", 0 AS duration, false AS failed", _WARNED),
}

def _trace_sql(kind: str) -> str:
    _, source, name, rest, names = _TRACES[kind]
    sql = ORACLES[source].replace(" AS reason FROM iv", " AS warning FROM iv") if kind == "network_flow_warning" else ORACLES[source]
    return f"SELECT '{kind}' AS record, {name} AS name, {rest}, {_rendered_sql(names)} AS attributes FROM ({sql})"


@query("s12_trace_kinds", " UNION ALL ".join(map(_trace_sql, _TRACES)))
def s12_kinds(spark, d):
    def of(kind: str) -> DataFrame:
        rows = _TRACES[kind][0](spark, d).withColumnsRenamed({"reason": "warning", "path_label": "path_key"})
        return records.to_trace_records(rows, kind).select("record", "name", "start", "end", F.col("duration").cast("long").alias("duration"), F.col("status").isNotNull().alias("failed"), "attributes")

    return _rendered(reduce(DataFrame.unionByName, map(of, _TRACES)))


@query("s12_request_records", spans.oracle(["convs"], f"WITH {spans._REQ} SELECT seq, error_message, ids FROM (SELECT seq, CASE WHEN turn % 2 = 0 AND n % 600 >= 400 THEN 'HTTP status code ' || n % 600 WHEN turn % 2 = 1 AND n % 600 <> 0 THEN 'gRPC status code ' || n % 600 || ' (' || {spans._GRPC.format('n % 600')} || ')' ELSE 'timeout' END AS error_message, true AS ids FROM rq WHERE NOT (side = 'client' AND seen))"))
def s12_requests(spark, d):
    rows = requests.request_spans(spans.request_table(spark, d))
    out = records.to_trace_records(rows.withColumn("service_name", F.col("seq").cast("string")), "request_span_observation")
    return out.select(F.col("resource")["service.name"].cast("long").alias("seq"), F.col("status_message").alias("error_message"), F.col("trace_id").isNotNull().alias("ids"))


@query("s12_span_records", spans.oracle(["convs"], f"WITH {spans._REQ} SELECT seq, role AS name, CASE WHEN k = 1 THEN m END AS trace_id, CASE WHEN k = 1 THEN substr(m, 1, 16) END AS span_id, ts AS start, ts + n AS \"end\", n AS duration FROM rq"))
def s12_spans(spark, d):
    """Requests seen as plain spans: ids of both kinds or none."""
    rows = spans.request_table(spark, d).withColumns({"name": F.col("method"), "service_name": F.col("seq").cast("string"), "span_id": F.coalesce("span_id", F.lit("not an id"))})
    out = records.to_trace_records(rows, "trace_span_observation")
    return out.select(F.col("resource")["service.name"].cast("long").alias("seq"), "name", "trace_id", "span_id", "start", "end", F.col("duration").cast("long").alias("duration"))
