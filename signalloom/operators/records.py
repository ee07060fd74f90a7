"""Metric and trace records of every kind, from flat rows.

A column that a table doesn't have counts as null, and null columns give no attribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncate_utf8, valid_span_id, valid_trace_id
from .export import allowed_attributes, mirror
from .requests import status_message

#: Bytes of a text, of an attribute's key, and attributes taken of a row.
TEXT, KEY, ATTRIBUTES = 256, 128, 16
#: Attribute names, and the columns they come from.
HOST = {"host.name": "host"}
RESOURCE = HOST | {
    "container.id": "container_id", "container.runtime": "container_runtime", "k8s.namespace.name": "namespace", "k8s.pod.name": "pod_name",
    "k8s.pod.uid": "pod_uid", "k8s.container.name": "container_name", "k8s.node.name": "node_name",
}
NETWORK = {"net.transport": "protocol", "network.type": "address_family", "server.address": "remote_address", "server.port": "remote_port"}
PEER = {
    "network.transport": "protocol", "network.flow.direction": "direction", "network.type": "address_family",
    "source.k8s.namespace.name": "source_namespace", "source.k8s.workload.name": "source_owner_name", "source.k8s.workload.kind": "source_owner_type",
    "destination.k8s.namespace.name": "destination_namespace", "destination.k8s.workload.name": "destination_owner_name", "destination.k8s.workload.kind": "destination_owner_type",
    "otel.metric.overflow": "overflow",
}
DNS = {"dns.question.name": "domain", "dns.response_code": "response_code"}
PROCESS = {"process.pid": "pid", "process.parent_pid": "ppid", "process.command": "command"}
USAGE = PROCESS | {"linux.cgroup.path": "cgroup_path"}
#: Form and attributes of a metric, by kind.
METRICS = {
    "network_counter_metric": ("sum", NETWORK | {"error.type": "errno"}), "network_peer_flow_metric": ("sum", PEER), "network_duration_metric": ("summary", NETWORK), "network_gauge_metric": ("gauge", NETWORK),
    "dns_counter_metric": ("sum", DNS), "dns_latency_metric": ("summary", DNS), "resource_gauge_metric": ("gauge", USAGE), "resource_counter_metric": ("sum", USAGE),
}
OWNER = PROCESS | {"process.owner.id": "uid"}
CORRELATION = {"trace.correlation.kind": "correlation_kind", "trace.correlation.confidence": "confidence"}
WARNING = {"warning.type": "warning", "warning.message": "message", "trace.source.signal.kind": "source_kind", "trace.source.module": "source_module"}
SERVER = {"server.address": "remote_address", "server.port": "remote_port", "dns.question.name": "domain"}
ENDS = {"net.transport": "protocol", "client.k8s.workload.name": "source_owner_name", "client.k8s.workload.type": "source_owner_type", "server.k8s.workload.name": "destination_owner_name", "server.k8s.workload.type": "destination_owner_type"} | SERVER
#: Name (None: the row's own) and attributes of a trace record, by kind.
TRACES = {
    "trace_span_observation": (None, CORRELATION | OWNER | SERVER),
    "service_interaction_span_observation": (None, CORRELATION | OWNER | ENDS | {"error.type": "error_type"}),
    "trace_service_path_observation": ("trace.service.path", CORRELATION | ENDS | {"trace.service.path.key": "path_key", "trace.service.path.observations": "observations"}),
    "trace_correlation_warning": ("trace.correlation.warning", {"trace.correlation.kind": "correlation_kind"} | WARNING | OWNER | SERVER),
    "request_span_observation": (None, CORRELATION | OWNER | {"network.protocol.name": "protocol", "http.request.method": "method"}),
    "request_correlation_warning": ("request.correlation.warning", {"trace.correlation.kind": "correlation_kind", "network.protocol.name": "protocol"} | WARNING | OWNER | SERVER),
    "network_flow_warning": ("network.flow.warning", WARNING | OWNER | {"network.protocol.name": "protocol", "network.address.family": "address_family", "server.address": "remote_address", "server.port": "remote_port"}),
    "profiling_warning_observation": ("profiling.warning", WARNING | OWNER | {"profile.kind": "kind", "profile.correlation.kind": "correlation_kind", "profile.confidence": "confidence"}),
}
SPANS = ("trace_span_observation", "service_interaction_span_observation", "request_span_observation")


def _text(v: Column) -> Column:
    return truncate_utf8(v.cast("string"), TEXT)


def _map(df: DataFrame, names: dict[str, str]) -> Column:
    """A map from attribute names to the values of the columns that ``df`` has."""
    pairs = [x for key, c in names.items() if c in df.columns for x in (F.lit(key), _text(F.col(c)))]
    return F.map_filter(F.create_map(*pairs).cast("map<string,string>"), lambda k, v: v.isNotNull())


def _with_own(df: DataFrame) -> DataFrame:
    """``df`` with ``_own``, the map of the row's own attributes (an array of key, value), bounded; of equal keys the last.

    Each step is a column, so that it is worked out once a row and not again for each key.
    """
    empty = F.create_map().cast("map<string,string>")
    if "attributes" not in df.columns:
        return df.withColumn("_own", empty)
    cut = F.transform(F.slice("attributes", 1, ATTRIBUTES), lambda a: F.struct(truncate_utf8(a["key"], KEY).alias("key"), _text(a["value"]).alias("value")))
    keyed = df.withColumn("_cut", cut).withColumn("_keys", F.array_distinct(F.transform(F.filter("_cut", lambda a: a["key"].isNotNull()), lambda a: a["key"])))
    values = F.transform("_keys", lambda k: F.element_at(F.filter("_cut", lambda a: a["key"] == k), -1)["value"])
    return keyed.withColumn("_own", F.coalesce(F.map_from_arrays("_keys", values), empty)).drop("_cut", "_keys")


def _over(under: Column, top: Column) -> Column:
    """Both maps; ``top`` wins."""
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(top, k)), top)


def _have(df: DataFrame, c: str, kind: str) -> Column:
    return F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)


def to_metric_records(df: DataFrame, kind: str, name: Column, unit: Column) -> DataFrame:
    """record, name, unit, kind (sum, gauge or summary), value, count, min, max, window, resource, attributes.

    ``value`` is a summary's sum; count, min and max are null for others. Resource metrics keep their row's own attributes, without
    secrets and renamed by metric. Identity keys of the resource are repeated in the attributes.
    """
    form, names = METRICS[kind]
    if "response_code" in df.columns:
        df = df.withColumn("response_code", F.replace(F.lower("response_code"), F.lit("_"), F.lit("")))
    df = _with_own(df) if names is USAGE else df.withColumn("_own", F.create_map().cast("map<string,string>"))
    own = allowed_attributes(name, F.col("_own")) if names is USAGE else F.col("_own")
    summary = form == "summary"
    df = df.withColumns({"_resource": _map(df, HOST if names is PEER else RESOURCE), "_own": own, "_named": _map(df, names)})
    df = df.withColumn("_attributes", _over(F.col("_own"), F.col("_named")))
    return df.select(
        F.lit(kind).alias("record"), _text(name).alias("name"), _text(unit).alias("unit"), F.lit(form).alias("kind"), F.col("sum" if summary else "value").cast("double").alias("value"),
        *[(F.col(c) if summary else F.lit(None)).cast("long").alias(c) for c in ("count", "min", "max")], _have(df, "window_start", "long").alias("window_start"), _have(df, "window_end", "long").alias("window_end"),
        F.col("_resource").alias("resource"), mirror(F.col("_resource"), F.col("_attributes")).alias("attributes"),
    )


def to_trace_records(df: DataFrame, kind: str) -> DataFrame:
    """record, name, status, ids, start, end, duration, resource, attributes.

    Spans have ``name``, ``start``, ``end`` and perhaps ids, which stay only if trace and span id are valid; paths have ``first_seen`` and
    ``last_seen``, whose distance is their duration; warnings have ``ts`` and last no time. A status is an error with a message, or null.
    """
    name, names = TRACES[kind]
    span, path = kind in SPANS, kind == "trace_service_path_observation"
    start, end = ("start", "end") if span else ("first_seen", "last_seen") if path else ("ts", "ts")
    ids = {c: F.lower(_have(df, c, "string")) if span else F.lit(None).cast("string") for c in ("trace_id", "span_id", "parent_span_id")}
    good = valid_trace_id(ids["trace_id"]) & valid_span_id(ids["span_id"])
    lasted = _have(df, "duration", "long") if "duration" in df.columns else F.when(F.col(end).isNotNull(), F.greatest(F.col(end) - F.col(start), F.lit(0)))
    status = F.lit(None).cast("string")
    own = "attributes" in df.columns
    df = _with_own(df).withColumn("_named", _map(df, names))
    attributes = _over(F.col("_named"), F.col("_own")) if own else F.col("_named")
    if kind == "service_interaction_span_observation":
        status = _have(df, "error_type", "string")
        # only the row's own attributes can hide the error that is named already
        df = df.withColumn("_error", _map(df, {"error.type": "error_type"}))
        attributes = _over(attributes, F.col("_error")) if own else attributes
    if kind == "request_span_observation":
        status = status_message(F.col("protocol"), F.col("status_code"), F.col("attributes"))
        code = F.map_filter(
            F.create_map(F.lit("http.response.status_code"), F.when(F.col("protocol") == "http", F.col("status_code").cast("string")), F.lit("rpc.grpc.status_code"), F.when(F.col("protocol") == "grpc", F.col("status_code").cast("string"))),
            lambda k, v: v.isNotNull(),
        )
        there = {"address": "peer_address", "port": "peer_port"}
        asked = _map(df, {f"server.{k}": c for k, c in there.items()})
        served = _map(df, {f"{side}.{k}": c for side in ("client", "network.peer") for k, c in there.items()})
        peer = _over(F.when(_have(df, "role", "string").eqNullSafe(F.lit("server")), served).otherwise(asked), _map(df, {"dns.question.name": "peer_domain"}))
        attributes = _over(_over(_over(F.col("_named"), code), peer), F.col("_own"))
    return df.select(
        F.lit(kind).alias("record"), (_text(F.col("name")) if name is None else F.lit(name)).alias("name"), F.when(status.isNotNull(), "error").alias("status"), _text(status).alias("status_message"),
        *[F.when(good & (valid_span_id(v) if c == "parent_span_id" else F.lit(True)), v).alias(c) for c, v in ids.items()],
        F.col(start).alias("start"), F.col(end).alias("end"), lasted.alias("duration"), _map(df, RESOURCE | {"service.name": "service_name"}).alias("resource"), attributes.alias("attributes"),
    )
