"""Scalar functions, bounds and policies over the provided tables."""

from pyspark.sql import functions as F

from ..functions import bounds, catalog, hashing, policy, text
from ..operators import sanitize
from ..sources import host
from .adapters import adapt, oracle
from .registry import query


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("p1_truncate_utf8", """SELECT doc_id, CASE WHEN strlen(text) <= 50 THEN text ELSE (SELECT max(p) FROM (SELECT substr(text, 1, k) AS p FROM range(0, 51) t(k)) WHERE strlen(p) <= 50) END AS cut FROM documents""")
def p1(spark, d):
    return table(spark, d, "documents").select("doc_id", text.truncate_utf8(F.col("text"), 50).alias("cut"))


@query("p2_sanitize_argv", """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')[:32]) AS x, unnest(range(1, 1 + least(32, len(string_split(text, ' '))))) AS i FROM documents),
  c AS (SELECT doc_id, i, CASE WHEN strlen(x) <= 8 THEN x ELSE (SELECT max(p) FROM (SELECT substr(x, 1, k) AS p FROM range(0, 9) t(k)) WHERE strlen(p) <= 8) END AS cut FROM w)
  SELECT d.doc_id, list(c.cut ORDER BY c.i) AS arguments, len(string_split(any_value(d.text), ' ')) AS n FROM documents d JOIN c USING (doc_id) GROUP BY d.doc_id""")
def p2(spark, d):
    args = F.slice(F.split("text", " "), 1, 32)
    return table(spark, d, "documents").select("doc_id", F.transform(args, lambda a: text.truncate_utf8(a, 8)).alias("arguments"), F.size(F.split("text", " ")).cast("long").alias("n"))


_KEYS = "SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '.Api-Key' WHEN 1 THEN '_token' ELSE '' END AS key, p_brand AS value FROM {part}"


@query("p3_drop_sensitive", f"WITH k AS ({_KEYS.replace('{part}', 'part')}) SELECT p_partkey, key FROM k WHERE NOT regexp_matches(lower(key), 'password|passwd|secret|token|authorization|cookie|api_key|api-key|apikey|credential|private_key|jwt')")
def p3(spark, d):
    rows = spark.sql(_KEYS, part=table(spark, d, "part")).withColumn("a", bounds.drop_sensitive(F.array(F.struct("key", "value"))))
    return rows.where("size(a) > 0").select("p_partkey", F.col("a")[0]["key"].alias("key"))


@query("p4_bound_labels", "SELECT p_partkey, [substr('brand', 1, 3), 'typ'] AS keys, [substr(p_brand, 1, 4), substr(p_type, 1, 4)] AS values FROM part")
def p4(spark, d):
    labels = F.create_map(F.lit("type"), F.col("p_type"), F.lit(""), F.lit("x"), F.lit("brand"), F.col("p_brand"), F.lit("zone"), F.col("p_name"))
    out = bounds.bound_labels(labels, 2, 3, 4)
    return table(spark, d, "part").select("p_partkey", F.map_keys(out).alias("keys"), F.map_values(out).alias("values"))


@query("p5_request_attributes", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ['a', 'error.type'] ELSE ['a', 'b'] END AS keys FROM part")
def p5(spark, d):
    def kv(k):
        return F.struct(k.alias("key"), F.lit("v").alias("value"))

    extra = F.when(F.col("p_size") % 2 == 0, F.lit("error.type")).otherwise(F.lit("c"))
    out = bounds.bound_request_attributes(F.array(kv(F.lit("a")), kv(F.lit("b")), kv(extra)), 2)
    return table(spark, d, "part").select("p_partkey", F.transform(out, lambda a: a["key"]).alias("keys"))


_ATTRS = "SELECT p_partkey, p_size, p_brand, p_type, repeat('x', p_size * 8) AS long FROM {part}"


def _family(spark, d, rule):
    """Each part's attributes by a family's rule, as key=value."""
    rows = spark.sql(_ATTRS, part=table(spark, d, "part"))
    pairs = [("brand", F.col("p_brand")), ("profile_id", F.col("p_type")), ("my.auth", F.col("p_brand")), ("long", F.col("long")), ("my_token", F.col("p_brand")), ("type", F.col("p_type"))]
    out = rule(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]))
    return rows.select("p_partkey", F.transform(out, lambda a: F.concat_ws("=", a["key"], a["value"])).alias("attributes"))


_PART_ATTRS = f"WITH t AS ({_ATTRS.replace('{part}', 'part')}) SELECT p_partkey, "


@query("p5_trace_attributes", _PART_ATTRS + "list_filter(['brand=' || p_brand, 'profile_id=' || p_type, 'my.auth=' || p_brand, CASE WHEN p_size * 8 <= 256 THEN 'long=' || long END, 'type=' || p_type], lambda x: x IS NOT NULL)[:4] AS attributes FROM t")
def p5_trace(spark, d):
    return _family(spark, d, lambda a: bounds.bound_trace_attributes(a, 4))


@query("p5_resource_attributes", _PART_ATTRS + "['brand=' || p_brand, 'profile_id=' || p_type, 'long=' || left(long, 256)] AS attributes FROM t")
def p5_resource(spark, d):
    return _family(spark, d, lambda a: bounds.bound_resource_attributes(a, 3))


@query("p5_profile_attributes", _PART_ATTRS + "['brand=' || p_brand, 'my.auth=' || p_brand, 'long=' || left(long, 256), 'type=' || p_type] AS attributes FROM t")
def p5_profile(spark, d):
    return _family(spark, d, lambda a: bounds.bound_profile_attributes(a, 4))


@query("f15_saturating", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 9223372036854775807 ELSE o_orderkey + o_custkey END AS added, CAST(greatest(o_orderkey - o_custkey * 10, 0) AS BIGINT) AS left_over FROM orders")
def f15(spark, d):
    big = F.when(F.col("o_orderkey") % 2 == 0, F.lit(bounds.TOP - 1)).otherwise(F.col("o_orderkey"))
    second = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + 2).otherwise(F.col("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", bounds.saturating_add(big, second).alias("added"), bounds.saturating_sub(F.col("o_orderkey"), F.col("o_custkey") * 10).alias("left_over"))


@query("f16_units", "SELECT o_orderkey, o_orderkey * 10000000 AS ticks, o_orderkey * 4000000 AS fine_ticks, o_orderkey * 1024 AS kib, o_orderkey * 1000 AS usec, o_orderkey * 512 AS sectors FROM orders")
def f16(spark, d):
    n = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", host.ticks_to_nanos(n).alias("ticks"), host.ticks_to_nanos(n, 250).alias("fine_ticks"), host.kib_to_bytes(n).alias("kib"), host.usec_to_nanos(n).alias("usec"), host.sectors_to_bytes(n).alias("sectors"))


@query("u2_map_difference", "SELECT p_partkey, ['brand'] AS gone, ['size'] AS fresh, CASE WHEN p_size % 2 = 0 THEN ['type'] ELSE [] END AS changed FROM part")
def u2(spark, d):
    before = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("name"), F.col("p_name"))
    after = F.create_map(F.lit("type"), F.when(F.col("p_size") % 2 == 0, F.lit("other")).otherwise(F.col("p_type")), F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    diff = bounds.map_difference(before, after)
    return table(spark, d, "part").select("p_partkey", diff.alias("x")).select("p_partkey", "x.gone", "x.fresh", "x.changed")


@query("p6_redact_argv", "SELECT doc_id, ['--' || CASE doc_id % 3 WHEN 0 THEN 'password=<redacted>' WHEN 1 THEN 'user=' || source ELSE 'token' END, CASE WHEN doc_id % 3 = 2 THEN '<redacted>' ELSE lang END, '<redacted>'] AS argv FROM documents")
def p6(spark, d):
    first = F.concat(F.lit("--"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("password="), F.col("source"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("user="), F.col("source"))).otherwise("token"))
    return table(spark, d, "documents").select("doc_id", bounds.redact_argv(F.array(first, F.col("lang"), F.concat(F.lit("Bearer "), F.col("source")))).alias("argv"))


@query("p7_select_labels", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, '\\s') THEN ['brand'] ELSE ['brand', 'type'] END AS keys FROM part")
def p7(spark, d):
    labels = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("other"), F.lit("x"))
    return table(spark, d, "part").select("p_partkey", F.map_keys(bounds.select_labels(labels, ("brand", "type", "zone"), 2)).alias("keys"))


@query("p8_label_selectors", "SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11')")
def p8(spark, d):
    labels = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    rules = [("type", "ne", "ECONOMY"), ("brand", "in", ("Brand#1", "Brand#2", "Brand#3", "Brand#11")), ("zone", "notin", ("a",)), ("zone", "missing"), ("type", "exists")]
    return table(spark, d, "part").where(policy.selector(labels, rules)).select("p_partkey")


@query("p9_glob", "SELECT p_partkey, p_name LIKE '%ri_g%' AS starred, p_name = 'small ring' AS exact FROM part")
def p9(spark, d):
    return table(spark, d, "part").select("p_partkey", text.glob("*ri?g*", F.col("p_name")).alias("starred"), text.glob("small ring", F.col("p_name")).alias("exact"))


@query("p10_capture_policy", oracle(["pods"], "SELECT container_id, CASE WHEN namespace LIKE 'a%a' OR owner_name = 'nation_3' THEN false ELSE owner_name LIKE 'nation_1%' OR namespace = 'europe' END AS captured FROM pods"))
def p10(spark, d):
    rule = policy.CapturePolicy(exclude_namespaces=("a*a",), exclude_labels={"owner": "nation_3"}, include_any=([("owner", "in", tuple(f"nation_{k}" for k in (1, *range(10, 20))))], [("ns", "eq", "europe")]))
    labels = F.create_map(F.lit("owner"), F.col("owner_name"), F.lit("ns"), F.col("namespace"))
    return adapt(spark, d, "pods").select("container_id", rule.column(F.col("namespace"), labels, F.lit("p"), F.col("container_name")).alias("captured"))


@query("p11_attribution_scope", oracle(["pods"], "SELECT container_id FROM pods WHERE namespace IN ('asia', 'africa') AND node_name <> 'node-2' AND owner_name <> 'nation_4'"))
def p11(spark, d):
    scope = policy.AttributionScope(allow_namespaces=("asia", "africa"), deny_nodes=("node-2",), exclude=([("owner", "eq", "nation_4")],))
    labels = F.create_map(F.lit("owner"), F.col("owner_name"))
    return adapt(spark, d, "pods").where(scope.column(F.col("namespace"), F.col("node_name"), labels)).select("container_id")


@query("p21_workload_filter", oracle(["conn"], "SELECT seq FROM conn WHERE CASE WHEN namespace IS NULL THEN false ELSE namespace <> 'asia' END"))
def p21(spark, d):
    rule = policy.CapturePolicy(exclude_namespaces=("asia",))
    rows = adapt(spark, d, "conn")
    verdict = rule.column(F.col("namespace"), F.lit(None).cast("map<string,string>"), F.lit("p"), F.col("container_name"))
    return rows.where(F.when(F.col("namespace").isNull(), False).otherwise(verdict)).select("seq")


_TP = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '00-' || m || '-' || substr(m, 1, 16) || '-01' WHEN 1 THEN 'ff-' || m || '-' || substr(m, 1, 16) || '-01' WHEN 2 THEN '00-' || upper(m) || '-' || substr(m, 1, 16) || '-01' WHEN 3 THEN '00-' || repeat('0', 32) || '-' || substr(m, 1, 16) || '-01' ELSE '00-' || m END AS tp FROM (SELECT doc_id, md5('a' || CAST(doc_id AS STRING)) AS m FROM {documents})"


@query("p12_parse_traceparent", f"WITH t AS ({_TP.replace('{documents}', 'documents')}) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(tp, 4, 32) END AS trace_id, CASE WHEN doc_id % 5 = 0 THEN substr(tp, 37, 16) END AS span_id, CASE doc_id % 5 WHEN 1 THEN 'reserved_version' WHEN 2 THEN 'invalid_hex' WHEN 3 THEN 'all_zero_trace_id' WHEN 4 THEN 'malformed' END AS reason FROM t")
def p12(spark, d):
    rows = spark.sql(_TP, documents=table(spark, d, "documents")).withColumn("c", text.parse_traceparent(F.col("tp")))
    return rows.select("doc_id", "c.trace_id", "c.span_id", "c.reason")


@query("p13_tracestate", "SELECT doc_id, doc_id % 4 IN (0, 3) AS ok FROM documents")
def p13(spark, d):
    state = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("v1="), F.col("source"), F.lit(", t@sys=x"))).when(F.col("doc_id") % 4 == 1, "v1=a,v1=b").when(F.col("doc_id") % 4 == 2, "V1=a").otherwise(F.concat(F.lit("rojo="), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", text.valid_tracestate(state).alias("ok"))


@query("p18_prom_identifier", "SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^[0-9]') THEN '_' ELSE '' END || regexp_replace(p_brand || '.' || p_name, '[^A-Za-z0-9_]', '_', 'g') AS name FROM part")
def p18(spark, d):
    return table(spark, d, "part").select("p_partkey", text.prom_identifier(F.concat_ws(".", "p_brand", "p_name")).alias("name"))


@query("f1_normalize_domain", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS domain, CAST(NULL AS STRING) AS bad FROM pages")
def f1(spark, d):
    name = F.parse_url("url", F.lit("HOST"))
    return table(spark, d, "pages").select("page_id", text.normalize_domain(F.concat(F.lit(" "), F.upper(name), F.lit(".. "))).alias("domain"), text.normalize_domain(F.concat(F.lit("-"), name)).alias("bad"))


_IP = "SELECT o_orderkey, CAST(o_orderkey % 256 AS STRING) || '.' || CAST(o_custkey % 256 AS STRING) || '.7.9' AS ip FROM {orders}"


@query(
    "f2_external_address",
    f"WITH t AS ({_IP.replace('{orders}', 'orders')}), p AS (SELECT *, CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b FROM t) SELECT o_orderkey, NOT (a = 10 OR a = 127 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR a BETWEEN 224 AND 239) AS external FROM p",
)
def f2(spark, d):
    return spark.sql(_IP, orders=table(spark, d, "orders")).select("o_orderkey", text.is_external(F.col("ip")).alias("external"))


_IP6 = "SELECT o_orderkey, lpad(lower(hex(o_custkey * 7919 % 65536)), 4, '0') AS h, CASE o_orderkey % 5 WHEN 0 THEN '::' WHEN 1 THEN ':0:0:0:0:0:0:' WHEN 2 THEN ':1:2:3:4:5:6:' WHEN 3 THEN '::a:' ELSE ':::' END AS mid FROM {orders}"


@query(
    "f2_external_address6",
    f"WITH t AS ({_IP6.replace('{orders}', 'orders')}), p AS (SELECT *, CAST('0x' || h AS INT) AS n FROM t) SELECT o_orderkey, h || mid || '1' AS ip, mid <> ':::' AND NOT (n >= 65280 OR n BETWEEN 64512 AND 65023 OR n BETWEEN 65152 AND 65215 OR (n = 0 AND mid IN ('::', ':0:0:0:0:0:0:'))) AS external FROM p",
)
def f2_6(spark, d):
    rows = spark.sql(_IP6, orders=table(spark, d, "orders")).withColumn("ip", F.concat("h", "mid", F.lit("1")))
    return rows.select("o_orderkey", "ip", text.is_external(F.col("ip")).alias("external"))


_CG = "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '/kubepods.slice/pod' || '12345678_1234_1234_1234_1234567890ab' || '/cri-containerd-' || h || '.scope' WHEN 1 THEN '/docker/' || h ELSE '/user.slice/' || h END AS path, h FROM (SELECT o_orderkey, md5('c' || CAST(o_orderkey AS STRING)) || md5('d' || CAST(o_orderkey AS STRING)) AS h FROM {orders})"


@query("f3_cgroup_path", f"WITH t AS ({_CG.replace('{orders}', 'orders')}) SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN h END AS container_id, CASE o_orderkey % 3 WHEN 0 THEN 'containerd' WHEN 1 THEN 'docker' END AS runtime, CASE WHEN o_orderkey % 3 = 0 THEN '12345678-1234-1234-1234-1234567890ab' END AS pod_uid FROM t")
def f3(spark, d):
    return spark.sql(_CG, orders=table(spark, d, "orders")).select("o_orderkey", text.container_of_path(F.col("path")).alias("container_id"), text.runtime_of_path(F.col("path")).alias("runtime"), text.pod_uid_of_path(F.col("path")).alias("pod_uid"))


@query("f4_fnv1a64", f"WITH h AS MATERIALIZED (SELECT doc_id, text, {hashing.hash_sql('text')} AS hash FROM documents) SELECT doc_id, hash, CASE WHEN strlen(text) <= 64 THEN text ELSE 'hash:' || hash END AS bounded FROM h")
def f4(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.fnv1a64(F.col("text")).alias("hash"), hashing.bounded_or_hash(F.col("text"), 64).alias("bounded"))


@query(
    "f_sql_functions",
    f"WITH t AS ({_IP.replace('{orders}', 'orders')}), p AS (SELECT *, CAST(split_part(ip, '.', 1) AS INT) AS a, CAST(split_part(ip, '.', 2) AS INT) AS b FROM t), c AS ({_CG.replace('{orders}', 'orders')}) SELECT o_orderkey, NOT (a = 10 OR a = 127 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR a BETWEEN 224 AND 239) AS external, CASE WHEN o_orderkey % 3 < 2 THEN h END AS container_id, path LIKE '/d_cker/%' AS docker, substr(path, 1, 9) AS cut, lower(substr(h, 1, 8)) || '.example' AS domain FROM p JOIN c USING (o_orderkey)",
)
def sql_functions(spark, d):
    """The catalog's functions, named in SQL."""
    catalog.register(spark)
    orders = table(spark, d, "orders")
    return spark.sql("SELECT o_orderkey, is_external_address(ip) AS external, container_of_path(path) AS container_id, glob_match('/d?cker/*', path) AS docker, truncate_utf8(path, 9) AS cut, normalize_domain(concat(' ', upper(substr(h, 1, 8)), '.Example. ')) AS domain FROM {ips} JOIN {paths} USING (o_orderkey)", ips=spark.sql(_IP, orders=orders), paths=spark.sql(_CG, orders=orders))


@query("f_sql_traceparent", f"WITH t AS ({_TP.replace('{documents}', 'documents')}) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(tp, 4, 32) END AS trace_id, CASE doc_id % 5 WHEN 1 THEN 'reserved_version' WHEN 2 THEN 'invalid_hex' WHEN 3 THEN 'all_zero_trace_id' WHEN 4 THEN 'malformed' END AS reason, {hashing.hash_sql('tp')} AS hash FROM t")
def sql_traceparent(spark, d):
    """The catalog's table function, and its hash."""
    catalog.register(spark)
    return spark.sql("SELECT r.doc_id, t.trace_id, t.reason, fnv1a64(r.tp) AS hash FROM {rows} r, LATERAL traceparent(r.tp) t", rows=spark.sql(_TP, documents=table(spark, d, "documents")))


@query("f5_generated_ids", f"WITH t AS (SELECT doc_id, source || '|' || lang || '|' || doc_id AS t FROM documents) SELECT doc_id, {hashing.hash_sql('t', hashing.SEEDS[0])} || {hashing.hash_sql('t', hashing.SEEDS[1])} AS trace_id, {hashing.hash_sql('t', hashing.SEEDS[2])} AS span_id FROM t")
def f5(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.generated_ids(F.concat_ws("|", "source", "lang", F.col("doc_id").cast("string"))).alias("i")).select("doc_id", "i.*")


@query("f7_workload_key", oracle(["conn"], "SELECT seq, wl AS workload FROM conn"))
def f7(spark, d):
    c = F.col
    return adapt(spark, d, "conn").select("seq", text.workload_key(c("namespace"), c("pod_uid"), c("pod_name"), c("container_name")).alias("workload"))


@query("f9_basename", oracle(["execs"], "SELECT seq, CASE seq % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'curl' WHEN 2 THEN 'python3' WHEN 3 THEN 'sh' WHEN 4 THEN 'nc' ELSE command END AS name, seq % 6 IN (0, 3) AS shell, seq % 6 IN (1, 4) AS tool FROM execs"))
def f9(spark, d):
    rows = adapt(spark, d, "execs").withColumn("name", text.basename(F.col("executable"), F.array().cast("array<string>"), F.col("command")))
    return rows.select("seq", "name", text.is_shell(F.col("name")).alias("shell"), text.is_network_tool(F.col("name")).alias("tool"))


@query("f10_tcp_state", "SELECT o_orderkey, CASE o_orderkey % 14 WHEN 1 THEN 'established' WHEN 2 THEN 'syn_sent' WHEN 3 THEN 'syn_recv' WHEN 4 THEN 'fin_wait1' WHEN 5 THEN 'fin_wait2' WHEN 6 THEN 'time_wait' WHEN 7 THEN 'close' WHEN 8 THEN 'close_wait' WHEN 9 THEN 'last_ack' WHEN 10 THEN 'listen' WHEN 11 THEN 'closing' WHEN 12 THEN 'new_syn_recv' END AS state FROM orders")
def f10(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.tcp_state(F.col("o_orderkey") % 14).alias("state"))


@query("f12_grpc_status", f"SELECT o_orderkey, coalesce(list_extract({list(text.GRPC_STATUS)}, CAST(o_orderkey % 20 + 1 AS BIGINT)), 'unknown') AS status FROM orders")
def f12(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.grpc_status(F.col("o_orderkey") % 20).alias("status"))


@query("f14_valid_ids", "SELECT doc_id, doc_id % 3 = 0 AS trace_ok, doc_id % 3 < 2 AS span_ok FROM documents")
def f14(spark, d):
    m = F.md5(F.col("doc_id").cast("string"))
    trace = F.when(F.col("doc_id") % 3 == 0, m).when(F.col("doc_id") % 3 == 1, F.lit("0" * 32)).otherwise(F.concat(F.lit("G"), F.substring(m, 2, 31)))
    span = F.when(F.col("doc_id") % 3 < 2, F.substring(m, 1, 16)).otherwise("short")
    return table(spark, d, "documents").select("doc_id", text.valid_trace_id(trace).alias("trace_ok"), text.valid_span_id(span).alias("span_ok"))


@query("f17_window_bucket", oracle(["ev"], "SELECT seq, ts - ts % 30000000000 AS bucket FROM ev"))
def f17(spark, d):
    return adapt(spark, d, "ev").select("seq", text.bucket(F.col("ts"), 30_000_000_000).alias("bucket"))


@query("f19_quantity", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey / 1000000.0 WHEN 1 THEN CAST(o_custkey AS DOUBLE) WHEN 2 THEN o_custkey / 1024.0 ELSE o_custkey * 1024.0 END AS amount FROM orders")
def f19(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("n", "m", "Ki", "Gi"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", text.quantity(F.concat(F.col("o_custkey").cast("string"), unit)).alias("amount"))


@query("u3_merge_attributes", "SELECT p_partkey, list_sort(list_distinct([p_brand, p_type, p_brand, 'x']))[1:3] AS merged FROM part")
def u3(spark, d):
    return table(spark, d, "part").select("p_partkey", bounds.merge_attributes(F.array("p_brand", "p_type"), F.array(F.col("p_brand"), F.lit("x")), 3).alias("merged"))


_CUT = "CASE WHEN strlen({0}) <= {1} THEN {0} ELSE (SELECT max(p) FROM (SELECT substr({0}, 1, k) AS p FROM range(0, {1} + 1) t(k)) WHERE strlen(p) <= {1}) END"


@query("p2_sanitize", f"SELECT doc_id, {_CUT.format('text', 256)} AS text, {_CUT.format('text', 64)} AS text_id, least(len(string_split(text, ' ')), 32) AS n FROM documents")
def p2_kinds(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("text").alias("text_id"), F.split("text", " ").alias("arguments"))
    return sanitize.sanitize(docs).select("doc_id", "text", "text_id", F.size("arguments").cast("long").alias("n"))


@query("f18_bounded_values", f"SELECT doc_id, CASE WHEN strlen(text) <= 40 THEN text ELSE 'hash:' || {hashing.hash_sql('text')} END AS value FROM documents")
def f18(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.bounded_or_hash(F.col("text"), 40).alias("value"))


@query("f11_tcp_metric", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'network.tcp.retransmits' WHEN 1 THEN 'network.tcp.resets' WHEN 2 THEN 'network.tcp.transitions.closed' END AS metric FROM orders")
def f11(spark, d):
    k = F.col("o_orderkey") % 4
    stat = F.when(k == 0, "retransmit").when(k == 1, "reset").otherwise("state_transition")
    return table(spark, d, "orders").select("o_orderkey", text.tcp_metric(stat, F.lit(None).cast("string"), F.when(k == 2, "close").otherwise("listen")).alias("metric"))
