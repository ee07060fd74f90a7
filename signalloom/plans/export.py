"""Export records, scrapes, cluster objects and host files over the provided tables."""

from pyspark.sql import functions as F

from ..functions.hashing import hash_sql
from ..functions.policy import AttributionScope, CapturePolicy
from ..operators import attribution, common, export, network, requests
from ..sources import host, kubernetes, prometheus, signals
from .adapters import adapt, oracle
from .network import connections
from .registry import query
from .spans import request_table


def _records(spark, d):
    rows = network.failure_counters(connections(spark, d).where("kind = 'failure'"))
    resource = export.attribute_map(host__name=F.col("host"), container__id=F.col("container_id"))
    attributes = export.attribute_map(errno=F.col("errno"), server__address=F.col("remote_address"), auth__key=F.lit("x"))
    return export.metric_records(rows, F.lit("network.connection.failure.count"), "sum", "{connection}", F.col("value"), resource, export.allowed_attributes(F.lit("network.connection.failure.count"), attributes))


_F = "f AS (SELECT host, container_id, errno, remote_address, remote_port, count(*) AS value, min(ts) AS window_start, max(ts) AS window_end FROM conn WHERE kind = 'failure' GROUP BY host, wl, container_id, remote_address, remote_port, errno)"


@query("s11_metric_records", oracle(["conn"], f"WITH {_F} SELECT 'network.connection.failure.count' AS name, '{{connection}}' AS unit, 'sum' AS kind, CAST(value AS DOUBLE) AS value, window_start, window_end, host, container_id, CAST(errno AS STRING) AS errno, remote_address AS server, CASE WHEN container_id IS NULL THEN 3 ELSE 4 END AS attributes FROM f"))
def s11(spark, d):
    r = _records(spark, d)
    return r.select("name", "unit", "kind", "value", "window_start", "window_end", F.col("resource")["host.name"].alias("host"), F.col("resource")["container.id"].alias("container_id"), F.col("attributes")["errno"].alias("errno"), F.col("attributes")["server.address"].alias("server"), F.size("attributes").cast("long").alias("attributes"))


@query("a22_coalesce_series", oracle(["conn"], f"WITH {_F}, r AS (SELECT *, row_number() OVER (PARTITION BY host, errno ORDER BY window_end DESC) AS n FROM f) SELECT host, CAST(errno AS STRING) AS errno, window_end FROM r WHERE n = 1"))
def a22(spark, d):
    rows = network.failure_counters(connections(spark, d).where("kind = 'failure'"))
    out = export.metric_records(rows, F.lit("f"), "sum", "1", F.col("value"), export.attribute_map(host=F.col("host")), export.attribute_map(errno=F.col("errno"))).withColumn("seq", F.col("window_start"))
    return export.coalesce_series(out).select(F.col("resource")["host"].alias("host"), F.col("attributes")["errno"].alias("errno"), "window_end")


@query("a23_timestamp_guard", oracle(["ev"], """WITH m AS (SELECT seq, user_id, CAST(floor((ts + (k % 7) * 1000000000000) / 1000000) AS BIGINT) AS ms FROM ev), f AS (SELECT *, max(ms) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM m),
  g AS (SELECT *, top IS NULL OR ms >= top AS fresh FROM f) SELECT seq, fresh AND row_number() OVER (PARTITION BY user_id, ms, fresh ORDER BY seq DESC) = 1 AS kept FROM g"""))  # fmt: skip
def a23(spark, d):
    rows = adapt(spark, d, "ev").withColumn("ts", F.col("ts") + (F.col("k") % 7) * 1_000_000_000_000)
    return export.timestamp_guard(rows, ["user_id"]).select("seq", "kept")


@query("k3_latest_series", oracle(["ev"], "WITH s AS (SELECT event_type AS name, CAST(user_id AS STRING) AS labels_key, arg_max(cents, seq) AS value, min(seq) AS first_seq FROM ev GROUP BY 1, 2) SELECT * FROM s ORDER BY first_seq DESC LIMIT 30"))
def k3(spark, d):
    rows = adapt(spark, d, "ev").select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("labels_key"), F.col("cents").alias("value"), "seq")
    return export.latest_series(rows, 30)


_LINES = "SELECT p_partkey, 'part_total{{brand=\"' || p_brand || '\",type=\"a\\\"' || p_type || '\"}} ' || CAST(p_size AS STRING) AS line FROM part"


@query("s9_render_prometheus", _LINES.replace("{{", "{").replace("}}", "}"))
def s9(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    labels = F.create_map(F.lit("type"), F.concat(F.lit('a"'), F.col("p_type")), F.lit("brand"), F.col("p_brand"))
    lines = export.render_prometheus(rows.select(F.lit("part_total").alias("name"), labels.alias("labels"), F.concat_ws("|", "p_size", "p_partkey").alias("value")))
    both = F.split("line", r"\|")
    return lines.select(both[1].cast("long").alias("p_partkey"), both[0].alias("line"))


@query("s8_parse_prometheus", "SELECT p_brand AS brand, p_type AS type, CAST(arg_max(p_size, p_partkey) AS DOUBLE) AS value FROM part GROUP BY p_brand, p_type")
def s8(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    text = F.concat(F.lit('m{brand="'), F.col("p_brand"), F.lit('",note="a, \\"b\\"",type="'), F.col("p_type"), F.lit('"} '), F.col("p_size").cast("string"))
    out = prometheus.parse_prometheus(rows.select(text.alias("line"), F.col("p_partkey").alias("line_no")))
    return out.where("labels['note'] = 'a, \"b\"'").select(F.col("labels")["brand"].alias("brand"), F.col("labels")["type"].alias("type"), "value")


@query("p16_metric_attributes", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['cpu.mode', 'other'] ELSE ['disk.io.direction', 'other'] END AS keys FROM part")
def p16(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet")
    metric = F.when(F.col("p_size") % 2 == 0, "system.cpu.time").otherwise("system.disk.io")
    attributes = F.create_map(F.lit("state"), F.col("p_type"), F.lit("my_token"), F.lit("x"), F.lit("other"), F.col("p_brand"), F.lit("oauth"), F.lit("y"))
    return rows.select("p_partkey", F.array_sort(F.map_keys(export.allowed_attributes(metric, attributes))).alias("keys"))


@query("p17_prometheus_labels", "SELECT p_partkey, ['p_brand', 'p_type'] AS keys FROM part")
def p17(spark, d):
    attributes = F.create_map(F.lit("p.type"), F.col("p_type"), F.lit("p.brand"), F.col("p_brand"), F.lit("container.id"), F.lit("c"), F.lit("db.password"), F.lit("x"), F.lit("long"), F.repeat(F.lit("x"), 300))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.map_keys(export.prometheus_labels(attributes)).alias("keys"))


@query("p17_hashed_labels", f"SELECT p_partkey, {hash_sql('p_name').replace('hex(p_name)', "hex('container_id') || 'FF' || hex(p_name)")} AS hash FROM part")
def p17h(spark, d):
    attributes = F.create_map(F.lit("container.id"), F.col("p_name"), F.lit("other"), F.col("p_type"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", export.hashed_labels(attributes)["container_id_hash"].alias("hash"))


@query("p19_identity_mirror", oracle(["pods"], "SELECT container_id, 3 AS n, pod_name AS pod, 'own' AS namespace FROM pods"))
def p19(spark, d):
    rows = adapt(spark, d, "pods")
    out = export.mirror(F.create_map(F.lit("k8s.pod.name"), F.col("pod_name"), F.lit("k8s.namespace.name"), F.col("namespace"), F.lit("service"), F.lit("s")), F.create_map(F.lit("k8s.namespace.name"), F.lit("own"), F.lit("x"), F.lit("y")))
    return rows.select("container_id", F.size(out).cast("long").alias("n"), out["k8s.pod.name"].alias("pod"), out["k8s.namespace.name"].alias("namespace"))


def _spans(spark, d):
    spans = requests.request_spans(request_table(spark, d))
    return export.trace_records(spans, requests.status_message(F.col("protocol"), F.col("status_code"), F.col("attributes")))


@query("s12_trace_records", oracle(["convs"], "WITH r AS (SELECT *, conv_id % 2 = 0 AS server, seq % 3 = 1 OR (seq % 3 = 2 AND turn <> 2) AS seen FROM convs WHERE role IN ('user', 'assistant')) SELECT seq, CASE WHEN turn % 2 = 0 THEN 'http request' ELSE 'grpc request' END AS name, CASE WHEN server THEN 'server' ELSE 'client' END AS span_kind, ts AS start, ts + n AS \"end\", true AS has_ids FROM r WHERE server OR NOT seen"))
def s12(spark, d):
    return _spans(spark, d).select("seq", "name", "span_kind", "start", "end", F.col("trace_id").isNotNull().alias("has_ids"))


@query("s13_group_for_export", oracle(["convs"], "WITH r AS (SELECT *, conv_id % 2 = 0 AS server, seq % 3 = 1 OR (seq % 3 = 2 AND turn <> 2) AS seen FROM convs WHERE role IN ('user', 'assistant')) SELECT host, CASE WHEN server THEN 'server' ELSE 'client' END AS span_kind, count(*) AS spans FROM r WHERE server OR NOT seen GROUP BY 1, 2"))
def s13(spark, d):
    return export.group_for_export(_spans(spark, d), ["host", "span_kind"]).groupBy("host", "span_kind").agg(F.sum(F.size("spans")).alias("spans"))


_KINDS = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'network_counter_metric' WHEN 1 THEN 'request_span_observation' WHEN 2 THEN 'profile_sample_observation' ELSE 'dns_query' END AS kind, CASE WHEN o_custkey % 3 > 0 THEN CASE WHEN o_custkey % 3 = 1 THEN md5(CAST(o_orderkey AS STRING)) ELSE 'bad' END END AS trace_id, '00000000000000aa' AS span_id FROM {orders}"


@query("s17_route_family", f"WITH k AS ({_KINDS.replace('{orders}', 'orders')}) SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'metric' WHEN 1 THEN 'trace' ELSE 'profile' END AS family, CASE WHEN o_orderkey % 4 <> 1 THEN 'accepted' WHEN trace_id IS NULL THEN 'without_ids' WHEN trace_id = 'bad' THEN 'invalid_ids' ELSE 'accepted' END AS outcome FROM k WHERE o_orderkey % 4 < 3")
def s17(spark, d):
    return export.route_family(spark.sql(_KINDS, orders=spark.read.parquet(f"{d}/orders.parquet"))).select("o_orderkey", "family", "outcome")


@query("s14_profile_records", oracle(["stacks"], "SELECT seq, CASE WHEN seq % 5 = 0 THEN 77 ELSE sample_count * 10 END AS value, source AS service_name FROM stacks"))
def s14(spark, d):
    rows = adapt(spark, d, "stacks").withColumns({"host": F.lit("h"), "period": F.lit(10), "service_label": F.lit(None).cast("string"), "pod_name": F.col("source"), "attributes": F.array(F.struct(F.lit("profiling.sample.weight").alias("key"), F.when(F.col("seq") % 5 == 0, "77").otherwise("x").alias("value")))})
    return export.profile_records(rows).select("seq", F.col("value").cast("long"), "service_name")


# --- cluster objects --------------------------------------------------------------------------------------------------


def _pod_json(spark, d):
    pods = adapt(spark, d, "pods")
    meta = F.struct(F.col("pod_name").alias("name"), "namespace", F.col("pod_uid").alias("uid"), F.create_map(F.lit("app"), F.col("owner_name")).alias("labels"), F.when(F.col("container_id").cast("long") % 2 == 0, F.array(F.struct(F.lit("ReplicaSet").alias("kind"), F.concat("owner_name", F.lit("-5d8f")).alias("name"), F.lit(True).alias("controller")))).alias("ownerReferences"))
    item = F.struct(meta.alias("metadata"), F.struct(F.col("node_name").alias("nodeName")).alias("spec"), F.struct(F.col("pod_ip").alias("podIP"), F.array(F.struct(F.lit("main").alias("name"), F.concat(F.lit("containerd://"), F.col("container_id")).alias("containerID"))).alias("containerStatuses")).alias("status"))
    return pods.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))


@query("s3_read_pods", oracle(["pods"], "SELECT namespace, pod_name, pod_uid, node_name, pod_ip, [container_id] AS containers, CASE WHEN CAST(container_id AS BIGINT) % 2 = 0 THEN 1 ELSE NULL END AS owners FROM pods"))
def s3(spark, d):
    out = kubernetes.read_pods(_pod_json(spark, d))
    return out.select("namespace", "pod_name", "pod_uid", "node_name", "pod_ip", F.transform("containers", lambda c: c["id"]).alias("containers"), F.when(F.col("owners").isNotNull(), F.size("owners")).alias("owners"))


@query("j4_resolve_owner", oracle(["pods"], "SELECT pod_name, owner_name, CASE WHEN CAST(container_id AS BIGINT) % 2 = 0 THEN 'deployment' ELSE 'app' END AS owner_type FROM pods"))
def j4(spark, d):
    return attribution.resolve_owner(kubernetes.read_pods(_pod_json(spark, d))).select("pod_name", "owner_name", "owner_type")


@query("s7_pod_dims", oracle(["pods"], "SELECT container_id, pod_name, owner_name, pod_ip FROM (SELECT *, row_number() OVER (ORDER BY namespace, pod_name) AS n FROM pods WHERE namespace <> 'asia') WHERE n <= 100"))
def s7(spark, d):
    by_container, _ = kubernetes.build_pod_dims(kubernetes.read_pods(_pod_json(spark, d)), AttributionScope(deny_namespaces=("asia",)), 100)
    return by_container.select("container_id", "pod_name", "owner_name", "pod_ip")


@query("s6_pod_watch", oracle(["pods"], "SELECT pod_name, CASE WHEN CAST(container_id AS BIGINT) % 4 = 1 THEN 'moved' ELSE node_name END AS node_name FROM pods WHERE CAST(container_id AS BIGINT) % 4 <> 2"))
def s6(spark, d):
    pods = adapt(spark, d, "pods").select("namespace", "pod_name", "pod_uid", "node_name")
    k = F.substring_index("pod_name", "-", -1).cast("long")
    log = pods.where(k % 4 < 3).select((k * 10).alias("seq"), F.when(k % 4 == 2, "DELETED").when(k % 4 == 1, "MODIFIED").otherwise("BOOKMARK").alias("type"), "namespace", "pod_name", "pod_uid", F.lit("moved").alias("node_name"))
    return kubernetes.apply_pod_watch(pods, log).select("pod_name", "node_name")


@query("s4_read_services", "SELECT 'ns' AS namespace, s_name AS service_name, CASE WHEN s_suppkey % 3 = 0 THEN [] ELSE ['10.1.0.' || CAST(s_suppkey % 9 AS STRING)] END AS cluster_ips FROM supplier")
def s4(spark, d):
    ip = F.when(F.col("s_suppkey") % 3 == 0, "None").otherwise(F.concat(F.lit("10.1.0."), (F.col("s_suppkey") % 9).cast("string")))
    item = F.struct(F.struct(F.col("s_name").alias("name"), F.lit("ns").alias("namespace")).alias("metadata"), F.struct(ip.alias("clusterIP"), F.array(ip).alias("clusterIPs")).alias("spec"))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
    return kubernetes.read_services(rows).select("namespace", "service_name", "cluster_ips")


@query("s5_endpoint_slices", "SELECT 'ns' AS namespace, s_name AS service_name, CASE WHEN s_suppkey % 2 = 0 THEN ['10.2.0.1', '10.2.0.2'] ELSE ['10.2.0.2'] END AS addresses FROM supplier")
def s5(spark, d):
    def end(ip, ready):
        return F.struct(F.array(F.lit(ip)).alias("addresses"), F.struct(ready.alias("ready")).alias("conditions"))

    item = F.struct(F.struct(F.lit("x").alias("name"), F.lit("ns").alias("namespace"), F.create_map(F.lit("kubernetes.io/service-name"), F.col("s_name")).alias("labels")).alias("metadata"), F.array(end("10.2.0.1", F.col("s_suppkey") % 2 == 0), end("10.2.0.2", F.lit(None).cast("boolean"))).alias("endpoints"))
    rows = spark.read.parquet(f"{d}/supplier.parquet").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
    return kubernetes.read_endpoint_slices(rows)


@query("j4_owner_by_address", oracle(["pods"], """WITH s AS (SELECT s_suppkey, s_name, '10.0.' || CAST(s_suppkey % 8 AS STRING) || '.' || CAST(s_suppkey % 40 AS STRING) AS a FROM supplier), u AS (SELECT pod_ip AS address, namespace AS ns, owner_name AS o, owner_type AS t, 0 AS r FROM pods WHERE pod_ip IS NOT NULL
  UNION ALL SELECT a, 'ns', 'ns/' || s_name, 'service', 1 FROM s UNION ALL SELECT '10.9.9.' || CAST(s_suppkey % 5 AS STRING), 'ns', 'ns/' || s_name, 'service', 2 FROM s)
  SELECT address, arg_min(ns, k) AS owner_namespace, arg_min(o, k) AS owner_name, arg_min(t, k) AS owner_type FROM (SELECT *, CAST(r AS STRING) || '|' || ns || '|' || o AS k FROM u) GROUP BY address"""))  # fmt: skip
def j4_address(spark, d):
    sup = spark.read.parquet(f"{d}/supplier.parquet")
    key = F.col("s_suppkey")
    services = sup.select(F.lit("ns").alias("namespace"), F.col("s_name").alias("service_name"), F.array(F.concat(F.lit("10.0."), (key % 8).cast("string"), F.lit("."), (key % 40).cast("string"))).alias("cluster_ips"))
    slices = sup.select(F.lit("ns").alias("namespace"), F.col("s_name").alias("service_name"), F.array(F.concat(F.lit("10.9.9."), (key % 5).cast("string"))).alias("addresses"))
    return attribution.owner_by_address(adapt(spark, d, "pods"), services, slices)


def _cgroups(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("cgroup_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("uid-"), F.col("o_custkey").cast("string"))).alias("pod_uid"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).alias("container_id"), F.array(F.lit("app"), F.when(F.col("o_orderkey") % 5 == 0, "sidecar").otherwise("web")).alias("process_names"))


_VERDICTS = "v AS (SELECT o_orderkey AS cgroup_id, p.namespace <> 'asia' AND o_orderkey % 5 <> 0 AS captured FROM orders JOIN pods p ON p.container_id = CAST(o_custkey AS STRING) WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)"


@query("j5_capture_verdicts", oracle(["pods"], f"WITH {_VERDICTS} SELECT * FROM v"))
def j5(spark, d):
    pods = adapt(spark, d, "pods").withColumn("labels", F.create_map(F.lit("a"), F.lit("b")))
    return attribution.capture_verdicts(_cgroups(spark, d), pods, CapturePolicy(exclude_namespaces=("asia",), exclude_processes=("side*",)))


@query("j6_verdict_diff", oracle(["pods"], f"WITH {_VERDICTS}, c AS (SELECT o_orderkey AS cgroup_id, true AS was FROM orders WHERE o_orderkey % 4 = 0) SELECT coalesce(v.cgroup_id, c.cgroup_id) AS cgroup_id, CASE WHEN v.cgroup_id IS NULL THEN 'remove' ELSE 'upsert' END AS action, captured FROM c FULL JOIN v ON c.cgroup_id = v.cgroup_id WHERE v.cgroup_id IS NULL OR was IS DISTINCT FROM captured"))
def j6(spark, d):
    current = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("cgroup_id"), F.lit(True).alias("captured"))
    return attribution.verdict_diff(current, j5(spark, d))


@query("j3_enrich_cgroup", oracle(["pods"], "SELECT CAST(p.container_id AS BIGINT) AS seq, md5('c' || container_id) || md5('d' || container_id) AS container_id, p.pod_name FROM pods p"))
def j3(spark, d):
    pods = adapt(spark, d, "pods")
    both = F.concat(F.md5(F.concat(F.lit("c"), "container_id")), F.md5(F.concat(F.lit("d"), "container_id")))
    rows = pods.select(F.col("container_id").cast("long").alias("seq"), F.concat(F.lit("/kubepods/cri-containerd-"), both, F.lit(".scope")).alias("cgroup_path"))
    return attribution.enrich_cgroup(rows, pods.withColumn("container_id", both)).select("seq", "container_id", "pod_name")


@query("j9_container_by_pid", oracle(["conn_raw"], """WITH u AS (SELECT seq, pid, ts, 2 AS k, CAST(NULL AS STRING) AS c FROM conn_raw WHERE kind = 'snapshot' UNION ALL SELECT seq, pid, ts, 1, container_id || '-' || CAST(seq AS STRING) FROM conn_raw WHERE kind = 'open' AND container_id IS NOT NULL UNION ALL SELECT seq, pid, ts, 0, NULL FROM conn_raw WHERE kind = 'close'),
  l AS (SELECT *, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY ts, k ROWS UNBOUNDED PRECEDING) AS life FROM u) SELECT seq, f AS container_id FROM (SELECT *, first_value(c IGNORE NULLS) OVER (PARTITION BY pid, life ORDER BY ts, k ROWS UNBOUNDED PRECEDING) AS f FROM l) WHERE k = 2"""))  # fmt: skip
def j9(spark, d):
    rows = adapt(spark, d, "conn_raw")
    starts = rows.where("kind = 'open' and container_id is not null").withColumn("container_id", F.concat_ws("-", "container_id", "seq"))
    out = attribution.container_by_pid(rows.where("kind = 'snapshot'").drop("container_id"), starts, rows.where("kind = 'close'"))
    return out.select("seq", "container_id")


@query("j10_cgroup_fallback", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'own' ELSE s_name END AS container_id FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey")
def j10(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("cgroup_id"), F.when(F.col("o_orderkey") % 2 == 0, "own").alias("container_id"))
    dims = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("cgroup_id"), F.col("s_name").alias("container_id"))
    return attribution.cgroup_fallback(rows, dims).select("o_orderkey", "container_id")


@query("j15_complete_exec", oracle(["conn_raw"], """SELECT seq, CASE WHEN bk = 0 AND ts - bt <= 100000000000000 THEN be END AS executable FROM (SELECT *, lag(k) OVER w AS bk, lag(e) OVER w AS be, lag(ts) OVER w AS bt FROM (SELECT seq, pid, ts, 0 AS k, remote_address AS e FROM conn_raw WHERE kind = 'open' UNION ALL SELECT seq, pid, ts, 1, NULL FROM conn_raw WHERE kind = 'close') WINDOW w AS (PARTITION BY pid ORDER BY ts, seq)) WHERE k = 1"""))
def j15(spark, d):
    rows = adapt(spark, d, "conn_raw")
    attempts = rows.where("kind = 'open'").withColumn("executable", F.col("remote_address"))
    return attribution.complete_exec(attempts, rows.where("kind = 'close'"), 100_000_000_000_000).select("seq", "executable")


# --- host files -------------------------------------------------------------------------------------------------------


@query("s10_host_files", "SELECT 'node-' || CAST(o_custkey % 4 AS STRING) AS host, o_orderkey AS ts, (o_custkey + 3) * 10000000 AS \"user\", o_orderkey * 10000000 AS system, 50000000 AS idle, 0 AS iowait, 10000000 AS steal FROM orders")
def s10(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = F.format_string("cpu  %d 3 %d 5 0 0 0 1 0 0\ncpu0 1 1 1 1\nintr 5", "o_custkey", "o_orderkey")
    files = orders.select(F.concat(F.lit("node-"), (F.col("o_custkey") % 4).cast("string")).alias("host"), F.lit("/proc/stat").alias("path"), text.alias("contents"), F.col("o_orderkey").alias("ts"))
    return host.node_cpu(files)


@query("s10_process_stat", "SELECT o_orderkey AS ts, o_custkey AS pid, 'my (app) x' AS command, (o_custkey + 2) * 10000000 AS cpu_time, 4 AS threads, 4096 * 9 AS rss FROM orders")
def s10p(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = F.format_string("%d (my (app) x) S 1 1 1 0 -1 0 0 0 0 0 %d 2 0 0 20 0 4 0 100 12345 9 0", "o_custkey", "o_custkey")
    files = orders.select(F.lit("h").alias("host"), F.concat(F.lit("/proc/"), F.col("o_custkey").cast("string"), F.lit("/stat")).alias("path"), text.alias("contents"), F.col("o_orderkey").alias("ts"))
    return host.process_stat(files).select("ts", "pid", "command", "cpu_time", "threads", "rss")


# --- signal lines -----------------------------------------------------------------------------------------------------


@query("s2_signal_lines", "SELECT doc_id, 'exec' AS kind, CASE WHEN doc_id % 2 = 0 THEN '--token=<redacted>' ELSE lang END AS argument FROM documents")
def s2(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.lit("h").alias("host"), F.col("doc_id").alias("pid"), F.lit("run").alias("command"), F.array(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("--token="), F.col("source"))).otherwise(F.col("lang"))).alias("arguments"))
    lines = signals.signal_lines(rows, "exec", "plans")
    return lines.select(F.get_json_object("line", "$.payload.pid").cast("long").alias("doc_id"), "kind", F.get_json_object("line", "$.payload.arguments[0]").alias("argument"))


@query("u1_union_outputs", oracle(["conn"], "SELECT kind, count(*) AS n FROM (SELECT 'flow_warning' AS kind FROM conn WHERE kind IN ('snapshot', 'close') AND namespace IS NULL UNION ALL SELECT 'failure' FROM conn WHERE kind = 'failure') GROUP BY kind"))
def u1(spark, d):
    rows = connections(spark, d)
    warnings = rows.where("kind in ('snapshot', 'close') and namespace is null").select(F.lit("flow_warning").alias("kind"), "seq", "ts")
    failures = rows.where("kind = 'failure'").select(F.lit("failure").alias("kind"), "seq", "errno")
    return warnings.unionByName(failures, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("a20_warning_dedup", oracle(["conn"], "SELECT DISTINCT kind AS warning, host, pid FROM conn"))
def a20(spark, d):
    return common.dedup(connections(spark, d).select(F.col("kind").alias("warning"), "host", "pid"), ("warning", "host", "pid"))


@query("k5_first_by_order", "SELECT p_partkey, list_sort([p_type, p_brand, p_name])[1:2] AS kept FROM part")
def k5(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.slice(F.array_sort(F.array("p_type", "p_brand", "p_name")), 1, 2).alias("kept"))


@query("k6_last_samples", oracle(["stacks"], "SELECT seq, stack_id FROM stacks ORDER BY ts DESC, seq DESC LIMIT 100"))
def k6(spark, d):
    return adapt(spark, d, "stacks").orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(100).select("seq", "stack_id")
