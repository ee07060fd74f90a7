"""Export-ready metric, trace and profile records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import label_hash
from ..functions.text import SENSITIVE, is_sensitive, prom_identifier, valid_span_id, valid_trace_id
from .running import running

#: Resource keys that are copied to the data point, labels whose value is hashed, words that keep a label out.
MIRROR = ("host.name", "container.id", "container.runtime", "k8s.namespace.name", "k8s.pod.name", "k8s.pod.uid", "k8s.container.name", "k8s.node.name")
HASHED = ("server_address", "server_port", "process_pid", "process_parent_pid", "process_command", "linux_cgroup_path", "container_id", "k8s_pod_uid", "dns_question_name")
UNWANTED = ("authorization", "auth", "token", "password", "passwd", "secret", "credential", "api_key", "apikey", "api-token", "argv", "argument", "command_line")
#: Attribute names by metric and key.
RENAMED = {
    ("system.cpu.time", "state"): "cpu.mode", ("container.cpu.time", "state"): "cpu.mode", ("process.cpu.time", "state"): "process.cpu.state",
    ("system.disk.io", "state"): "disk.io.direction", ("system.disk.operations", "state"): "disk.io.direction", ("system.disk.io", "device"): "system.device", ("system.disk.operations", "device"): "system.device",
    ("system.filesystem.usage", "mountpoint"): "system.filesystem.mountpoint", ("system.filesystem.available", "mountpoint"): "system.filesystem.mountpoint", ("system.filesystem.limit", "mountpoint"): "system.filesystem.mountpoint",
}
FAMILIES = {
    "metric": ("network_counter_metric", "network_peer_flow_metric", "network_duration_metric", "network_gauge_metric", "dns_counter_metric", "dns_latency_metric", "resource_gauge_metric", "resource_counter_metric"),
    "trace": ("trace_span_observation", "service_interaction_span_observation", "trace_service_path_observation", "trace_correlation_warning", "request_span_observation", "request_correlation_warning", "dependency_edge", "network_flow_warning"),
    "profile": ("profile_sample_observation", "profiling_session_observation", "profiling_warning_observation"),
}


def attribute_map(**columns: Column) -> Column:
    """A map of the named columns (dots for double underscores) without nulls."""
    entries = F.create_map(*[x for n, c in columns.items() for x in (F.lit(n.replace("__", ".")), c.cast("string"))])
    return F.map_filter(entries, lambda k, v: v.isNotNull())


def metric_records(df: DataFrame, name: Column, kind: str, unit: str, value: Column, resource: Column, attributes: Column) -> DataFrame:
    """name, unit, kind (sum, gauge or summary), value, window, resource, attributes."""
    return df.select(name.alias("name"), F.lit(unit).alias("unit"), F.lit(kind).alias("kind"), value.cast("double").alias("value"), F.col("window_start"), F.col("window_end"), resource.alias("resource"), mirror(resource, attributes).alias("attributes"))


def allowed_attributes(metric: Column, attributes: Column) -> Column:
    """Attributes of a metric (a map) without secrets, renamed by metric."""
    kept = F.map_filter(attributes, lambda k, v: ~is_sensitive(k, ("auth", "api-token")))
    return F.transform_keys(kept, lambda k, v: F.coalesce(*[F.when((metric == m) & (k == key), name) for (m, key), name in RENAMED.items()], k))


def mirror(resource: Column, attributes: Column) -> Column:
    """Identity keys of the resource copied into the attributes unless they are there."""
    missing = F.map_filter(resource, lambda k, v: k.isin(*MIRROR) & ~F.map_contains_key(attributes, k))
    return F.map_concat(attributes, missing)


def prometheus_labels(attributes: Column) -> Column:
    """Labels (P17): names cleaned, identities left out (see ``hashed_labels``), secrets and oversize dropped."""
    clean = F.transform(F.map_entries(attributes), lambda e: F.struct(prom_identifier(e["key"]).alias("key"), e["value"].alias("value")))
    words = "|".join((*SENSITIVE, *UNWANTED, *HASHED))
    ok = F.filter(clean, lambda e: (F.octet_length(e["key"]) <= 128) & (F.octet_length(e["value"]) <= 256) & ~F.lower(e["key"]).rlike(words))
    keys = F.array_sort(F.array_distinct(F.transform(ok, lambda e: e["key"])))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(ok, lambda e: e["key"] == k), -1)["value"]))


def hashed_labels(attributes: Column) -> Column:
    """``<key>_hash`` for each identity label that is present."""
    clean = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(attributes), lambda e: F.struct(prom_identifier(e["key"]).alias("key"), e["value"].alias("value")))))
    pairs = F.map_from_arrays(F.array(*[F.lit(f"{k}_hash") for k in HASHED]), F.array(*[label_hash(k, clean[k]) for k in HASHED]))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def render_prometheus(df: DataFrame) -> DataFrame:
    """line: ``name{k="v",...} value`` with labels by key, escaped (S9). ``df``: name, labels, value."""

    def escape(v: Column) -> Column:
        return F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))

    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')))
    body = F.when(F.size(pairs) > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return df.select(F.concat(F.col("name"), body, F.lit(" "), F.col("value").cast("string")).alias("line"))


def coalesce_series(records: DataFrame) -> DataFrame:
    """The row of each series with the greatest window end, the later row on ties (A22). A series is name, unit, resource and attributes."""
    canon = {c: F.to_json(F.array_sort(F.map_entries(c))) for c in ("resource", "attributes")}
    keyed = records.withColumns({f"_{c}": v for c, v in canon.items()})
    rest = [c for c in records.columns if c not in ("name", "unit")]
    return keyed.groupBy("name", "unit", *[f"_{c}" for c in canon]).agg(F.max_by(F.struct(*rest), F.struct("window_end", "seq")).alias("_s")).select("name", "unit", "_s.*")


def timestamp_guard(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``records`` with ``kept``: the last row of each series and millisecond, unless an earlier row was newer (A23). ``ts`` in nanoseconds, ``seq`` arrival."""
    ms = F.floor(F.col("ts") / 1_000_000)
    seen = running(records.withColumn("_ms", ms), keys, ("seq",), {"_newest": ("max", "_ms")}, inclusive=False)
    fresh = seen.withColumn("_fresh", F.col("_newest").isNull() | (F.col("_ms") >= F.col("_newest")))
    last = F.row_number().over(Window.partitionBy(*keys, "_ms", "_fresh").orderBy(F.col("seq").desc()))
    return fresh.withColumn("kept", F.col("_fresh") & (last == 1)).drop("_ms", "_newest", "_fresh")


def latest_series(lines: DataFrame, most: int) -> DataFrame:
    """The last value of each series; of more than ``most`` the ones first seen latest stay (K3)."""
    one = lines.groupBy("name", "labels_key").agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("first_seq"))
    return one.orderBy(F.col("first_seq").desc()).limit(most)


def trace_records(spans: DataFrame, status: Column) -> DataFrame:
    """Span rows with status; ids only if both are valid."""
    both = valid_trace_id(F.lower("trace_id")) & valid_span_id(F.lower("span_id"))
    parent = F.lower("parent_span_id")
    return spans.withColumns({"_ok": both, "status_message": status}).select(
        "host", "seq", "name", F.when(F.col("_ok"), F.lower("trace_id")).alias("trace_id"), F.when(F.col("_ok"), F.lower("span_id")).alias("span_id"), F.when(F.col("_ok") & valid_span_id(parent), parent).alias("parent_span_id"),
        "start", F.coalesce("end", "start").alias("end"), F.coalesce(F.col("role"), F.lit("internal")).alias("span_kind"), F.when(F.col("status_message").isNotNull(), "error").otherwise("unset").alias("status"), "status_message",
    )


def group_for_export(records: DataFrame, resource: Sequence[str], most: int = 4096) -> DataFrame:
    """Spans with ids grouped by equal resource (S13), in chunks of about ``most`` spans, as many as a resource's count needs."""
    traced = records.where("trace_id is not null")
    chunks = traced.groupBy(*[F.col(c).alias(f"_{c}") for c in resource]).agg(F.ceil(F.count(F.lit(1)) / most).alias("_chunks"))
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in resource])
    dealt = traced.join(chunks, on).withColumn("chunk", F.pmod(F.xxhash64("trace_id", "span_id"), F.col("_chunks")))
    return dealt.groupBy(*resource, "chunk").agg(F.array_sort(F.collect_list(F.struct("trace_id", "span_id", "name", "start", "end"))).alias("spans"))


def route_family(df: DataFrame) -> DataFrame:
    """``df`` (kind, trace_id, span_id) with family and accepted: traces need ids, and valid ones."""
    family = F.coalesce(*[F.when(F.col("kind").isin(*kinds), name) for name, kinds in FAMILIES.items()])
    traced = F.col("family") == "trace"
    have = F.col("trace_id").isNotNull() & F.col("span_id").isNotNull()
    valid = valid_trace_id(F.lower("trace_id")) & valid_span_id(F.lower("span_id"))
    out = df.withColumn("family", family).where("family is not null")
    return out.withColumn("outcome", F.when(~traced, "accepted").when(~have, "without_ids").when(~valid, "invalid_ids").otherwise("accepted"))


def profile_records(samples: DataFrame) -> DataFrame:
    """Flat profile rows (S14): the event's weight instead of the period where there is one; the service from labels, else the pod."""
    attributes = F.map_from_entries("attributes")
    weight = F.when(attributes["profiling.sample.weight"].rlike("^[0-9]+$"), attributes["profiling.sample.weight"].cast("long"))
    return samples.select("host", "seq", "ts", "kind", "stack_id", "sample_count", F.coalesce(weight, F.col("sample_count") * F.coalesce("period", F.lit(1))).alias("value"), F.coalesce(F.col("service_label"), F.col("pod_name")).alias("service_name"))
