"""Who owns a container, an address, a process."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import container_of_path
from .common import dimension, look_up

CONTEXT = ("namespace", "pod_name", "pod_uid", "container_name", "node_name")


def _fill(df: DataFrame, dims: DataFrame, on: tuple[str, str], columns: dict[str, str], bound: int | None) -> DataFrame:
    """``df`` with its null ``columns`` filled from ``dims`` (its columns by target name), which are found by a column of each."""
    joined = look_up(df, on[0], dimension(dims, bound), on[1])
    kept = [F.coalesce(F.col(c), F.col(columns[c])).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*kept, *[F.col(v).alias(k) for k, v in columns.items() if k not in df.columns])


def enrich_context(df: DataFrame, by_container: DataFrame, bound: int | None = None) -> DataFrame:
    """Container id -> pod context; what a row has already stays (J1). ``by_container`` has one row for each container."""
    have = [c for c in CONTEXT if c in by_container.columns]
    dims = by_container.select(F.col("container_id").alias("_cid"), *[F.col(c).alias(f"_d_{c}") for c in have])
    return _fill(df, dims, ("container_id", "_cid"), {c: f"_d_{c}" for c in have}, bound)


def enrich_cgroup(df: DataFrame, by_container: DataFrame, path: str = "cgroup_path") -> DataFrame:
    """Container id from the cgroup path, then the context."""
    found = container_of_path(F.col(path))
    return enrich_context(df.withColumn("container_id", F.coalesce(F.col("container_id"), found) if "container_id" in df.columns else found), by_container)


def enrich_endpoint(df: DataFrame, side: str, pods: DataFrame, owners: DataFrame) -> DataFrame:
    """``side``_namespace, _pod, _owner_name, _owner_type of an endpoint.

    The context comes from the container, else from the pod that has the address; the owner from the pod, else from
    the address. ``pods``: one row for each container (container_id, pod_ip, namespace, pod_name, owner_name,
    owner_type); ``owners``: one row for each address (address, owner_namespace, owner_name, owner_type), see ``owner_by_address``.
    """
    pod = ("namespace", "pod_name", "owner_name", "owner_type")
    by_id = pods.select(F.col("container_id").alias("_cid"), F.struct(*pod).alias("_by_id")).where("_cid is not null")
    first = pods.where("pod_ip is not null").groupBy(F.col("pod_ip").alias("_ip")).agg(F.min_by(F.struct(*pod), F.struct("namespace", "pod_name")).alias("_by_ip"))
    owner = owners.select(F.col("address").alias("_address"), F.struct("owner_namespace", "owner_name", "owner_type").alias("_owner"))
    found = look_up(look_up(df, f"{side}_container", dimension(by_id), "_cid"), f"{side}_address", dimension(first), "_ip")
    out = look_up(found, f"{side}_address", dimension(owner), "_address")
    context = F.coalesce("_by_id", "_by_ip")
    return out.select(
        *df.columns,
        F.coalesce(context["namespace"], F.col("_owner.owner_namespace")).alias(f"{side}_namespace"),
        context["pod_name"].alias(f"{side}_pod"),
        F.coalesce(context["owner_name"], F.col("_owner.owner_name")).alias(f"{side}_owner_name"),
        F.coalesce(context["owner_type"], F.col("_owner.owner_type")).alias(f"{side}_owner_type"),
    )


def resolve_owner(pods: DataFrame) -> DataFrame:
    """owner_name and owner_type of each pod.

    From ``owners`` (array of kind, name, controller) the controller, else the first; a ReplicaSet without its template hash
    is a deployment. Else a label that names the app, else the pod itself.
    """
    chosen = F.coalesce(F.get(F.filter("owners", lambda o: o["controller"]), 0), F.get("owners", 0))
    hashed = F.regexp_extract(chosen["name"], r"^(.+)-[a-z0-9]{1,10}$", 1)
    is_set = (chosen["kind"] == "ReplicaSet") & (hashed != "")
    app = F.coalesce(*[F.col("labels")[k] for k in ("app.kubernetes.io/name", "app", "k8s-app")])
    name = F.when(is_set, hashed).when(chosen["name"].isNotNull(), chosen["name"]).otherwise(F.coalesce(app, F.col("pod_name")))
    kind = F.when(is_set, "deployment").when(chosen["name"].isNotNull(), F.lower(chosen["kind"])).when(app.isNotNull(), "app").otherwise("pod")
    return pods.withColumns({"owner_name": name, "owner_type": kind})


def owner_by_address(pods: DataFrame, services: DataFrame, slices: DataFrame) -> DataFrame:
    """One owner for each address: of a pod, else of a service's cluster IP, else of an endpoint slice."""

    def service(df: DataFrame, addresses: str, rank: int) -> DataFrame:
        return df.select(F.explode(addresses).alias("address"), F.col("namespace").alias("owner_namespace"), F.concat_ws("/", "namespace", "service_name").alias("owner_name"), F.lit("service").alias("owner_type"), F.lit(rank).alias("rank"))

    found = (
        pods.where("pod_ip is not null").select(F.col("pod_ip").alias("address"), F.col("namespace").alias("owner_namespace"), "owner_name", "owner_type", F.lit(0).alias("rank"))
        .unionByName(service(services, "cluster_ips", 1)).unionByName(service(slices, "addresses", 2))
    )
    return found.groupBy("address").agg(F.min_by(F.struct("owner_namespace", "owner_name", "owner_type"), F.struct("rank", "owner_namespace", "owner_name")).alias("o")).select("address", "o.*")


def capture_verdicts(cgroups: DataFrame, pods: DataFrame, policy) -> DataFrame:
    """cgroup_id and captured (J5): the pod by uid, else by container; unresolved cgroups are absent; every process name must pass."""
    by_uid = pods.where("pod_uid is not null").groupBy(F.col("pod_uid").alias("_uid")).agg(F.min_by(F.struct("namespace", "labels", "container_name"), "pod_name").alias("_by_uid"))
    by_id = pods.where("container_id is not null").groupBy(F.col("container_id").alias("_cid")).agg(F.min_by(F.struct("namespace", "labels", "container_name"), "pod_name").alias("_by_id"))
    found = look_up(look_up(cgroups, "pod_uid", dimension(by_uid), "_uid"), "container_id", dimension(by_id), "_cid")
    pod = found.withColumn("_pod", F.coalesce("_by_uid", "_by_id")).where("_pod is not null")
    context = (F.col("_pod.namespace"), F.col("_pod.labels"))
    one = policy.column(*context, F.lit(None).cast("string"), F.col("_pod.container_name"))
    each = F.forall("process_names", lambda p: policy.column(*context, p, F.col("_pod.container_name")))
    return pod.select("cgroup_id", F.when(F.size("process_names") > 0, each).otherwise(one).alias("captured"))


def verdict_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """cgroup_id, action ('upsert' or 'remove') and captured: what turns ``current`` into ``desired``."""
    a, b = current.select("cgroup_id", F.col("captured").alias("was")), desired.select("cgroup_id", "captured")
    both = a.join(b, "cgroup_id", "full_outer")
    action = F.when(F.col("captured").isNull(), "remove").when(~F.col("was").eqNullSafe(F.col("captured")), "upsert")
    return both.withColumn("action", action).where("action is not null").select("cgroup_id", "action", "captured")


def container_by_pid(events: DataFrame, starts: DataFrame, exits: DataFrame) -> DataFrame:
    """``events`` with the container of their pid: the first known since the pid's last exit.

    An as-of join: the three tables in one order by time, the last value carried on within a life of the pid.
    """
    cols = [c for c in events.columns if c != "container_id"]
    all_ = (
        events.withColumn("_k", F.lit(2)).withColumn("_c", F.lit(None).cast("string"))
        .unionByName(starts.select("host", "pid", "ts", F.col("container_id").alias("_c"), F.lit(1).alias("_k")), allowMissingColumns=True)
        .unionByName(exits.select("host", "pid", "ts", F.lit(None).cast("string").alias("_c"), F.lit(0).alias("_k")), allowMissingColumns=True)
    )
    order = Window.partitionBy("host", "pid").orderBy("ts", "_k").rowsBetween(Window.unboundedPreceding, 0)
    life = F.sum(F.when(F.col("_k") == 0, 1).otherwise(0)).over(order)
    within = Window.partitionBy("host", "pid", "_life").orderBy("ts", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = all_.withColumn("_life", life).withColumn("_found", F.first("_c", ignorenulls=True).over(within)).where("_k = 2")
    own = F.col("container_id") if "container_id" in events.columns else F.lit(None).cast("string")
    return found.select(*cols, F.coalesce(own, F.col("_found")).alias("container_id"))


def cgroup_fallback(df: DataFrame, cgroups: DataFrame) -> DataFrame:
    """``df`` with container_id from its cgroup where the pid gave none."""
    dims = cgroups.select(F.col("cgroup_id").alias("_gid"), F.col("container_id").alias("_gc"))
    return _fill(df, dims, ("cgroup_id", "_gid"), {"container_id": "_gc"}, None)


def complete_exec(attempts: DataFrame, successes: DataFrame, most_age: int = 5_000_000_000) -> DataFrame:
    """Each success with the latest attempt of its pid, at most ``most_age`` old; an attempt is used once."""
    both = successes.select("host", "pid", "ts", "seq", F.lit(1).alias("_k"), F.lit(None).cast("string").alias("executable")).unionByName(attempts.select("host", "pid", "ts", "seq", F.lit(0).alias("_k"), "executable"))
    w = Window.partitionBy("host", "pid").orderBy("ts", "seq")
    before = both.withColumns({"_bk": F.lag("_k").over(w), "_be": F.lag("executable").over(w), "_bt": F.lag("ts").over(w)}).where("_k = 1")
    ok = (F.col("_bk") == 0) & (F.col("ts") - F.col("_bt") <= most_age)
    return before.select("host", "pid", "ts", "seq", F.when(ok, F.col("_be")).alias("executable"), F.when(ok, F.col("_bt")).alias("attempted_at"))
