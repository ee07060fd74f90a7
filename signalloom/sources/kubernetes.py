"""Cluster objects from the API's JSON, and the dimension tables built of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import AttributionScope
from ..operators.attribution import resolve_owner

_META = "metadata STRUCT<name: STRING, namespace: STRING, uid: STRING, labels: MAP<STRING, STRING>, ownerReferences: ARRAY<STRUCT<kind: STRING, name: STRING, controller: BOOLEAN>>>"
_STATUS = "ARRAY<STRUCT<name: STRING, containerID: STRING>>"
PODS = f"items ARRAY<STRUCT<{_META.replace(' STRUCT', ': STRUCT', 1)}, spec: STRUCT<nodeName: STRING>, status: STRUCT<podIP: STRING, containerStatuses: {_STATUS}, initContainerStatuses: {_STATUS}>>>"
SERVICES = f"items ARRAY<STRUCT<{_META.replace(' STRUCT', ': STRUCT', 1)}, spec: STRUCT<clusterIP: STRING, clusterIPs: ARRAY<STRING>>>>"
SLICES = f"items ARRAY<STRUCT<{_META.replace(' STRUCT', ': STRUCT', 1)}, endpoints: ARRAY<STRUCT<addresses: ARRAY<STRING>, conditions: STRUCT<ready: BOOLEAN>>>>>"


def _items(json: DataFrame, column: str, schema: str) -> DataFrame:
    return json.select(F.explode(F.from_json(column, schema)["items"]).alias("i")).select("i.*")


def read_pods(json: DataFrame, column: str = "value") -> DataFrame:
    """One row for each pod (S3): namespace, pod_name, pod_uid, node_name, pod_ip, labels, owners, containers (id, name)."""
    bare = F.concat(F.coalesce("status.containerStatuses", F.array()), F.coalesce("status.initContainerStatuses", F.array()))
    containers = F.transform(F.filter(bare, lambda c: F.coalesce(c["containerID"], F.lit("")) != ""), lambda c: F.struct(F.regexp_replace(c["containerID"], "^.*://", "").alias("id"), c["name"].alias("name")))
    pods = _items(json, column, PODS)
    return pods.select("metadata.namespace", F.col("metadata.name").alias("pod_name"), F.col("metadata.uid").alias("pod_uid"), F.col("spec.nodeName").alias("node_name"), F.col("status.podIP").alias("pod_ip"), "metadata.labels", F.col("metadata.ownerReferences").alias("owners"), containers.alias("containers"))


def read_services(json: DataFrame, column: str = "value") -> DataFrame:
    """namespace, service_name, service_uid, cluster_ips (S4); empty names are dropped, addresses sorted and distinct."""
    both = F.concat(F.coalesce("spec.clusterIPs", F.array().cast("array<string>")), F.array("spec.clusterIP"))
    ips = F.array_sort(F.array_distinct(F.filter(both, lambda x: x.isNotNull() & (x != "") & (x != "None"))))
    return _items(json, column, SERVICES).where("metadata.name <> ''").select("metadata.namespace", F.col("metadata.name").alias("service_name"), F.col("metadata.uid").alias("service_uid"), ips.alias("cluster_ips"))


def read_endpoint_slices(json: DataFrame, column: str = "value") -> DataFrame:
    """namespace, service_name, addresses of endpoints that aren't unready, 256 of each at most."""
    ready = F.filter("endpoints", lambda e: F.coalesce(e["conditions"]["ready"], F.lit(True)))
    addresses = F.flatten(F.transform(ready, lambda e: F.slice(F.coalesce(e["addresses"], F.array().cast("array<string>")), 1, 256)))
    name = F.col("metadata.labels")["kubernetes.io/service-name"]
    return _items(json, column, SLICES).where(name.isNotNull()).select("metadata.namespace", name.alias("service_name"), addresses.alias("addresses"))


def pod_key() -> Column:
    """What tells pods apart."""
    return F.coalesce("pod_uid", F.concat_ws("/", "namespace", "pod_name"))


def apply_pod_watch(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """The pods after a watch log (seq, type, then the snapshot's columns).

    ADDED and MODIFIED put a pod by uid, or namespace and name; DELETED removes it; BOOKMARK changes nothing. An ERROR means
    the list must be read again: what the log had before the last one doesn't count, and the snapshot stands for it.
    """
    last = log.agg(F.coalesce(F.max(F.when(F.col("type") == "ERROR", F.col("seq"))), F.lit(-1)).alias("_from"))
    live = log.join(F.broadcast(last)).where("seq > _from and type in ('ADDED', 'MODIFIED', 'DELETED')").drop("_from")
    both = snapshot.withColumns({"seq": F.lit(-1).cast("long"), "type": F.lit("ADDED")}).unionByName(live.select("seq", "type", *snapshot.columns))
    rows = both.groupBy(pod_key().alias("_key")).agg(F.max_by(F.struct("type", *snapshot.columns), "seq").alias("s"))
    return rows.where("s.type <> 'DELETED'").select(*[F.col(f"s.{c}").alias(c) for c in snapshot.columns])


def build_pod_dims(pods: DataFrame, scope: AttributionScope | None = None, max_pods: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(by container, by pod): pods in scope with their owners (S7). ``max_pods`` counts pods after the scope, by namespace and name; the first of those wins an IP.

    The two tables have at most ``max_pods`` pods, so they may be broadcast.
    """
    ok = scope.column(F.col("namespace"), F.col("node_name"), F.col("labels")) if scope else F.lit(True)
    live = resolve_owner(pods.where(ok)).orderBy("namespace", "pod_name").limit(max_pods)
    first = Window.partitionBy("pod_ip").orderBy("namespace", "pod_name")
    by_pod = live.withColumn("pod_ip", F.when(F.row_number().over(first) == 1, F.col("pod_ip")))
    by_container = by_pod.select("*", F.explode("containers").alias("c")).select(F.col("c.id").alias("container_id"), F.col("c.name").alias("container_name"), "namespace", "pod_name", "pod_uid", "node_name", "pod_ip", "owner_name", "owner_type", "labels")
    return by_container, by_pod.drop("containers")


def container_names(containers: Column) -> Column:
    return F.map_from_entries(F.transform(containers, lambda c: F.struct(c["id"], c["name"])))
