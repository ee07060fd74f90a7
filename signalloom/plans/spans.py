"""Requests, profiles, symbols and findings over the provided tables."""

from pyspark.sql import functions as F

from ..functions.hashing import SEEDS, hash_sql, label_hash
from ..functions.text import GRPC_STATUS
from ..operators import analysis, common, profiling, requests, security
from .adapters import adapt, oracle
from .registry import query
from .network import connections


def _kv(*pairs):
    return F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs])


def _sides(spark, d):
    rows = adapt(spark, d, "convs")
    ask = rows.where("role = 'user'").withColumn("attributes", _kv(("a", F.col("n"))))
    answer = rows.where("role = 'assistant'").withColumns({"attributes": _kv(("a", F.lit("no")), ("b", F.col("n")))})
    return ask, answer


#: Turns as requests (0), responses (1) and responses that complete all (2), so that both limits are met.
_TURN = "CASE (turn + conv_id) % 8 WHEN 3 THEN 1 WHEN 7 THEN 1 WHEN 5 THEN 2 ELSE 0 END"
_MOST, _WAIT = 2, 3_000_000


@query("j8_match_fifo", oracle(["convs"], f"""WITH e AS (SELECT *, {_TURN} AS k, row_number() OVER (PARTITION BY connection ORDER BY ts, {_TURN}, seq) AS i FROM convs),
  m AS (SELECT DISTINCT connection, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(seq BIGINT, ts BIGINT, why VARCHAR)[]) AS q, CAST([] AS STRUCT(seq BIGINT, e BIGINT, r BIGINT, why VARCHAR)[]) AS done FROM e
    UNION ALL SELECT n.connection, n.i,
      CASE n.k WHEN 0 THEN list_append(n.live[greatest(len(n.live) - {_MOST - 2}, 1) :], struct_pack(seq := n.seq, ts := n.ts, why := 'pending')) WHEN 1 THEN n.q[2:] ELSE [] END,
      CASE n.k WHEN 0 THEN list_transform(n.q[: len(n.q) - len(n.live)], lambda x: struct_pack(seq := x.seq, e := CAST(NULL AS BIGINT), r := CAST(NULL AS BIGINT), why := 'expired')) || list_transform(n.live[: greatest(len(n.live) - {_MOST - 1}, 0)], lambda x: struct_pack(seq := x.seq, e := CAST(NULL AS BIGINT), r := CAST(NULL AS BIGINT), why := 'overflow'))
        WHEN 1 THEN list_transform(n.q[:1], lambda x: struct_pack(seq := x.seq, e := n.ts, r := n.seq, why := 'matched')) ELSE list_transform(n.q, lambda x: struct_pack(seq := x.seq, e := n.ts, r := n.seq, why := 'matched')) END
    FROM (SELECT e.*, m.q, list_filter(m.q, lambda x: e.ts - x.ts < {_WAIT}) AS live FROM m JOIN e ON m.connection = e.connection AND e.i = m.i + 1) n),
  d AS (SELECT connection, unnest(done) AS u FROM m)
  SELECT a.host, a.connection, a.seq, a.ts AS start, d.u.e AS "end", d.u.r AS response_seq, coalesce(d.u.why, 'pending') AS outcome FROM e a LEFT JOIN d ON a.connection = d.connection AND a.seq = d.u.seq WHERE a.k = 0""").replace("WITH ", "WITH RECURSIVE ", 1))  # fmt: skip
def j8(spark, d):
    rows = adapt(spark, d, "convs").withColumn("k", F.expr(_TURN))
    return requests.match_fifo(rows.where("k = 0"), rows.where("k > 0").withColumn("all", F.col("k") == 2), _WAIT, _MOST, "all")


@query("j8_match_by_id", oracle(["convs"], """SELECT q.host, q.connection, q.correlation_id, q.seq, q.ts AS start, CASE WHEN count(r.ts) = 1 THEN min(r.ts) END AS "end", CASE WHEN count(r.ts) = 1 THEN ['a', 'b'] ELSE ['a'] END AS keys
  FROM (SELECT *, correlation_id + 1 AS c FROM convs WHERE role = 'user') q LEFT JOIN (SELECT * FROM convs WHERE role = 'assistant') r ON q.connection = r.connection AND q.c = r.correlation_id AND r.ts >= q.ts AND r.ts <= q.ts + 30000000000 GROUP BY q.host, q.connection, q.correlation_id, q.seq, q.ts"""))  # fmt: skip
def j8_id(spark, d):
    ask, answer = _sides(spark, d)
    out = requests.match_by_id(ask, answer.withColumn("correlation_id", F.col("correlation_id") - 1))
    return out.select("host", "connection", "correlation_id", "seq", "start", "end", F.transform("attributes", lambda a: a["key"]).alias("keys"))


def request_table(spark, d):
    """User turns as requests: a third without context, a third with ids, a third with a traceparent (some broken)."""
    rows = adapt(spark, d, "convs").where("role in ('user', 'assistant')")
    m, n = F.md5(F.col("seq").cast("string")), F.col("seq") % 3
    null = F.lit(None).cast("string")
    parent = F.when(F.col("turn") == 2, "broken").otherwise(F.concat(F.lit("00-"), m, F.lit("-"), F.substring(m, 1, 16), F.lit("-01")))
    return rows.select(
        "host", "seq", F.when(F.col("turn") % 2 == 0, "http").otherwise("grpc").alias("protocol"), F.when(F.col("conv_id") % 2 == 0, "server").otherwise("client").alias("role"),
        F.col("ts").alias("start"), (F.col("ts") + F.col("n")).alias("end"), F.when(n == 1, m).alias("trace_id"), F.when(n == 1, F.substring(m, 1, 16)).alias("span_id"), null.alias("parent_span_id"),
        F.when(n == 2, parent).alias("traceparent"), F.lit("observed").alias("correlation_kind"), F.lit("medium").alias("confidence"), F.lit("svc").alias("service_name"), F.col("role").alias("method"),
        (F.col("n") % 600).cast("int").alias("status_code"), (F.col("conv_id") % 50).alias("pid"), F.when(F.col("conv_id") % 7 != 0, F.col("connection")).alias("container_id"), null.alias("namespace"),
        _kv(("error.type", F.lit("timeout")), ("url.path", F.col("n"))).alias("attributes"), F.col("conv_id").alias("cgroup_id"), F.when(F.col("conv_id") % 3 == 0, F.col("host")).alias("peer_domain"), F.when(F.col("conv_id") % 3 == 1, "10.0.0.1").alias("peer_address"), F.when(F.col("conv_id") % 2 == 0, 80).alias("peer_port"), F.create_map(F.lit("owner"), F.when(F.col("conv_id") % 11 == 0, "agent").otherwise("none")).alias("labels"),
    )


_REQ = """rq AS (SELECT *, CASE WHEN turn % 2 = 0 THEN 'http' ELSE 'grpc' END AS protocol, CASE WHEN conv_id % 2 = 0 THEN 'server' ELSE 'client' END AS side, md5(CAST(seq AS STRING)) AS m, seq % 3 AS k, seq % 3 = 1 OR (seq % 3 = 2 AND turn <> 2) AS seen, conv_id % 11 = 0 AS owned FROM convs WHERE role IN ('user', 'assistant'))"""


_UNSIGNED = "CAST(CAST('0x' || {} AS UBIGINT) AS STRING)"
_ID = f"""CASE WHEN turn % 2 = 0 THEN 'Http' ELSE 'Grpc' END || '|Some(' || CASE WHEN side = 'server' THEN 'Server' ELSE 'Client' END || ')|' || ts || '|' || ts + n || '|' || conv_id % 50 || '|' || conv_id || '|' || {_UNSIGNED.format(hash_sql('role'))} || '|' || {_UNSIGNED.format(hash_sql('CAST(n AS STRING)'))}
  || '|' || n % 600 || '|' || CASE conv_id % 3 WHEN 0 THEN 'domain:' || {hash_sql('host')} || ':' || CASE WHEN conv_id % 2 = 0 THEN '80' ELSE 'unknown' END WHEN 1 THEN 'address:' || {hash_sql("'10.0.0.1'")} || ':' || CASE WHEN conv_id % 2 = 0 THEN '80' ELSE 'unknown' END ELSE 'unknown-peer' END"""


@query("d4_request_spans", oracle(["convs"], f"""WITH {_REQ}, ids AS (SELECT *, {_ID} AS identity FROM rq WHERE NOT owned AND NOT (side = 'client' AND seen))
  SELECT seq, protocol || ' request' AS name, seen, CASE WHEN seen THEN m ELSE {hash_sql('identity', SEEDS[0])} || {hash_sql('identity', SEEDS[1])} END AS trace_id, CASE WHEN seen AND side <> 'server' THEN substr(m, 1, 16) ELSE {hash_sql('identity', SEEDS[2])} END AS span_id, CASE WHEN seen AND side = 'server' THEN substr(m, 1, 16) END AS parent_span_id,
  CASE WHEN seen THEN 'observed_trace_context' ELSE 'generated_trace_context' END AS correlation_kind, CASE WHEN seen THEN CASE WHEN side = 'server' THEN 4 ELSE 3 END ELSE 4 END AS attributes FROM ids"""))  # fmt: skip
def d4(spark, d):
    spans = requests.request_spans(request_table(spark, d), None, [("owner", "eq", "agent")])
    seen = F.col("correlation_kind") == "observed_trace_context"
    return spans.select("seq", "name", seen.alias("seen"), "trace_id", "span_id", "parent_span_id", "correlation_kind", F.size("attributes").cast("long").alias("attributes"))


@query("d5_request_warnings", oracle(["convs"], f"""WITH {_REQ} SELECT DISTINCT warning, host, protocol, conv_id % 50 AS pid, ts FROM (
  SELECT 'suppressed_owned_by_label' AS warning, * FROM rq WHERE owned UNION ALL SELECT 'malformed_trace_context', * FROM rq WHERE NOT owned AND k = 2 AND turn = 2 UNION ALL SELECT 'missing_trace_context', * FROM rq WHERE NOT owned AND k = 0
  UNION ALL SELECT 'missing_attribution', * FROM rq WHERE NOT owned AND conv_id % 7 = 0)"""))  # fmt: skip
def d5(spark, d):
    return requests.request_warnings(request_table(spark, d), None, [("owner", "eq", "agent")])


@query("p15_client_pass_through", oracle(["convs"], f"WITH {_REQ} SELECT seq FROM rq WHERE NOT (side = 'client' AND seen)"))
def p15(spark, d):
    return requests.passes_through(requests.with_context(request_table(spark, d))).select("seq")


@query("p14_span_suppression", oracle(["convs"], f"WITH {_REQ} SELECT seq, CASE WHEN owned THEN 'owned_by_label' WHEN conv_id % 50 % 5 = 1 THEN 'tracing_agent' END AS suppressed FROM rq"))
def p14(spark, d):
    rows = request_table(spark, d)
    kind = F.col("pid") % 5
    env = F.when(kind == 0, F.create_map(F.lit("OTEL_TRACES_EXPORTER"), F.lit("none"), F.lit("NODE_OPTIONS"), F.lit("--require @opentelemetry/auto-instrumentations-node/register"))).otherwise(F.create_map(F.lit("PATH"), F.lit("/bin")))
    argv = F.when(kind == 1, F.array(F.lit("java"), F.lit("-javaagent:/opt/opentelemetry-javaagent.jar"))).otherwise(F.array(F.lit("java")))
    processes = rows.select("host", "pid").distinct().select("host", "pid", env.alias("environ"), argv.alias("argv"))
    return requests.suppression(rows, processes, [("owner", "eq", "agent")]).select("seq", "suppressed")


_GRPC = f"coalesce(list_extract({list(GRPC_STATUS)}, CAST({{}} + 1 AS BIGINT)), 'unknown')"


@query("f13_status_message", oracle(["convs"], f"WITH {_REQ} SELECT seq, CASE WHEN protocol = 'http' AND n % 600 >= 400 THEN 'HTTP status code ' || CAST(n % 600 AS STRING) WHEN protocol = 'grpc' AND n % 600 <> 0 THEN 'gRPC status code ' || CAST(n % 600 AS STRING) || ' (' || {_GRPC.format('n % 600')} || ')' ELSE 'timeout' END AS message FROM rq"))
def f13(spark, d):
    return request_table(spark, d).select("seq", requests.status_message(F.col("protocol"), F.col("status_code"), F.col("attributes")).alias("message"))


def samples(spark, d):
    rows = adapt(spark, d, "stacks")
    null = F.lit(None).cast("string")
    even = F.col("seq") % 2 == 0
    weight = F.when(even, F.array(F.struct(F.lit("profiling.sample.weight_nanos").alias("key"), F.col("seq").cast("string").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    made = {"host": F.col("source"), "uid": F.when(even, F.col("pid") % 2), "period": F.col("seq") % 4, "container_name": F.when(F.col("seq") % 5 == 0, "main"), "attributes": F.concat(weight, _kv(("mode", F.col("kind")), ("n", F.col("stack_id"))))}
    return rows.withColumns(made | {"correlation_kind": F.lit("process"), "container_id": F.when(F.col("pid") > 0, F.col("pid").cast("string")), "namespace": null, "pod_uid": null, "pod_name": null, "sample_count": F.col("sample_count").cast("long")})


@query("a19_dedup_samples", oracle(["stacks"], "SELECT min(seq) AS seq, source, kind, pid, stack_id, n, weight FROM (SELECT *, sample_count % 2 AS n, ts % 3000000000 AS t, CASE WHEN seq % 2 = 0 THEN seq % 6 END AS weight FROM stacks) GROUP BY source, kind, pid, stack_id, n, weight, t"))
def a19_samples(spark, d):
    rows = samples(spark, d)
    weight = F.when(F.col("seq") % 2 == 0, F.array(F.struct(F.lit(profiling.WEIGHT).alias("key"), (F.col("seq") % 6).cast("string").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    null = F.lit(None).cast("long")
    coarse = rows.withColumns({"ts": F.col("ts") % 3_000_000_000, "sample_count": F.col("sample_count") % 2, "attributes": weight, "uid": null, "period": null})
    kept = profiling.dedup_samples(coarse.withColumn("container_id", F.when(F.col("pid") > 0, F.col("pid").cast("string"))))
    return kept.select("seq", "source", "kind", "pid", "stack_id", F.col("sample_count").alias("n"), profiling.sample_weight(F.col("attributes")).alias("weight"))


_S = "st AS (SELECT *, ts - ts % 300000000000 AS bucket, CASE WHEN pid > 0 THEN CAST(pid AS STRING) END AS container_id, CASE WHEN seq % 2 = 0 THEN pid % 2 END AS uid, seq % 4 AS period, CASE WHEN seq % 5 = 0 THEN 'main' END AS container_name, CASE WHEN seq % 2 = 0 THEN seq ELSE 0 END AS weight FROM stacks)"
_KEYS = "source, kind, pid, uid, container_id, container_name, period, bucket"
_SESSIONS = f"""s AS (SELECT {_KEYS}, CAST(least(sum(sample_count), 64) AS BIGINT) AS observed, CAST(greatest(sum(sample_count) - 64, 0) AS BIGINT) AS dropped, least(count(DISTINCT stack_id), 64) AS distinct_stacks, CASE min(CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS confidence,
  min(ts) AS first_seen, max(ts) AS last_seen, CAST(sum(weight) AS BIGINT) AS total_weight, list_sort(list_distinct(list('mode=' || kind) || list('n=' || stack_id) || coalesce(list('profiling.sample.weight_nanos=' || seq) FILTER (WHERE weight > 0), [])))[:16] AS kept FROM st GROUP BY ALL)"""


@query("a16_profile_sessions", oracle(["stacks"], f"WITH {_S}, {_SESSIONS.replace('FROM st GROUP BY ALL', 'FROM st GROUP BY ' + _KEYS)}, k AS (SELECT *, list_filter(kept, lambda x: NOT starts_with(x, 'profiling.sample.weight_nanos=')) AS own FROM s) SELECT source, kind, pid, uid, container_id, container_name, period, bucket, observed, dropped, distinct_stacks, confidence, first_seen, last_seen, total_weight, CASE WHEN total_weight > 0 THEN list_sort(own[:15] || ['profiling.session.total_weight_nanos=' || total_weight]) ELSE own END AS attributes FROM k"))
def a16(spark, d):
    out = profiling.profile_sessions(samples(spark, d), 300_000_000_000)
    return out.select("source", "kind", "pid", "uid", "container_id", "container_name", "period", "bucket", "observed", "dropped", "distinct_stacks", "confidence", "first_seen", "last_seen", "total_weight", F.transform("attributes", lambda a: F.concat_ws("=", a["key"], a["value"])).alias("attributes"))


@query("s16_profile_metric_lines", oracle(["stacks"], f"WITH {_S}, {_SESSIONS.replace('FROM st GROUP BY ALL', 'FROM st GROUP BY ' + _KEYS)} SELECT source AS host, kind, bucket, 'profile_session_samples_observed' AS name, observed AS value FROM s UNION ALL SELECT source, kind, bucket, 'profile_session_samples_dropped', dropped FROM s UNION ALL SELECT source, kind, bucket, 'profile_session_stacks_distinct', distinct_stacks FROM s"))
def s16(spark, d):
    return profiling.session_metric_lines(profiling.profile_sessions(samples(spark, d), 300_000_000_000)).select("host", "kind", "bucket", "name", "value")


@query("k4_bounded_windows", oracle(["stacks"], f"WITH {_S}, w AS (SELECT source, bucket, row_number() OVER (ORDER BY bucket DESC, source DESC) AS n FROM (SELECT DISTINCT source, bucket FROM st)) SELECT source, bucket, n > 20 AS evicted FROM w"))
def k4(spark, d):
    sessions = profiling.profile_sessions(samples(spark, d), 300_000_000_000)
    return common.bounded_windows(sessions, ("source", "bucket"), "bucket", 20).select("source", "bucket", "evicted").distinct()


@query("d6_profile_warnings", oracle(["stacks"], f"WITH {_S}, r AS (SELECT *, sum(sample_count) OVER (PARTITION BY source, kind, pid, uid, container_id, container_name, period, b ORDER BY ts, seq) AS upto FROM (SELECT *, ts - ts % 3000000000000000 AS b FROM st)) SELECT 'samples_dropped' AS warning, source AS host, pid, stack_id, ts, CAST(least(sample_count, upto - 64) AS BIGINT) AS dropped FROM r WHERE upto > 64 UNION ALL SELECT 'missing_attribution', source, pid, stack_id, ts, 0 FROM r WHERE container_id IS NULL"))
def d6(spark, d):
    return profiling.profile_warnings(samples(spark, d), 3_000_000_000_000_000)


def _frames(spark, d):
    frames = F.transform(F.split("text", " "), lambda w: F.struct(F.lit("user").alias("domain"), w.alias("symbol"), F.lit("m").alias("module"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), F.length(w).cast("long").alias("module_offset")))
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("frames", frames)
    return docs.select("source", F.col("doc_id").alias("seq"), F.lit("cpu").alias("kind"), (F.col("doc_id") % 3).cast("long").alias("sample_count"), F.lit(10).cast("long").alias("period"), "frames", _kv(("mode", F.col("lang")), ("token", F.lit("x")), ("mode", F.lit("again"))).alias("attributes"))


@query("p20_normalize_samples", "SELECT doc_id AS seq, CASE WHEN len(string_split(text, ' ')) > 64 THEN ['mode', 'profiling.stack.truncated'] ELSE ['mode'] END AS keys, least(64, len(string_split(text, ' '))) AS frames FROM documents WHERE doc_id % 3 > 0")
def p20(spark, d):
    good, _ = profiling.normalize_samples(_frames(spark, d))
    return good.select("seq", F.transform("attributes", lambda a: a["key"]).alias("keys"), F.size("frames").cast("long").alias("frames"))


_STACK = "string_agg('domain:user' || chr(31) || 'some:' || w || chr(31) || 'some:m' || chr(31) || 'none' || chr(31) || chr(31) || length(w) || chr(30), '' ORDER BY i)"


@query("f6_stack_ids", f"WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')[:64]) AS w, unnest(range(1, 1 + least(64, len(string_split(text, ' '))))) AS i FROM documents WHERE doc_id % 3 > 0), t AS (SELECT doc_id AS seq, {_STACK} AS stack FROM w GROUP BY doc_id) SELECT seq, 'stack:' || {hash_sql('stack')} AS stack_id FROM t")
def f6(spark, d):
    return profiling.normalize_samples(_frames(spark, d))[0].select("seq", "stack_id")


_PROFILE = "'source:' || source || '|host:some:' || source || '|pid:some:' || pid || '|uid:' || coalesce('some:' || uid, 'none') || '|container:' || coalesce('some:' || container_id, 'none') || '|namespace:none|pod:none|k8s_container:' || coalesce('some:' || container_name, 'none') || '|kind:' || kind || '|correlation:process|period:some:' || period || '|start:' || bucket || '|end:' || bucket + 300000000000"


@query("f8_session_ids", oracle(["stacks"], f"WITH {_S}, c AS (SELECT DISTINCT {_KEYS}, {_PROFILE} AS t FROM st) SELECT source, kind, pid, uid, container_id, container_name, period, bucket, 'profile:' || {hash_sql('t')} AS profile_id FROM c"))
def f8(spark, d):
    return profiling.session_ids(profiling.profile_sessions(samples(spark, d), 300_000_000_000)).select("source", "kind", "pid", "uid", "container_id", "container_name", "period", "bucket", "profile_id")


@query("f8_sample_ids", oracle(["stacks"], f"WITH {_S}, t AS (SELECT seq, source || '|' || ts || '|' || source || '|' || pid || '|' || coalesce(CAST(uid AS STRING), '') || '|' || coalesce(container_id, '') || '||' || coalesce(container_name, '') || '|' || stack_id AS t FROM st) SELECT seq, 'profile-sample:' || {hash_sql('t')} AS sample_id FROM t"))
def f8_samples(spark, d):
    return profiling.sample_ids(samples(spark, d)).select("seq", "sample_id")


@query("f8_label_hash", f"WITH t AS (SELECT p_partkey, p_brand FROM part) SELECT p_partkey, {hash_sql("p_brand").replace("hex(p_brand)", "hex('brand') || 'FF' || hex(p_brand)")} AS hash FROM t")
def f8_labels(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", label_hash("brand", F.col("p_brand")).alias("hash"))


@query("s15_pprof_functions", "WITH f AS (SELECT DISTINCT source, w AS symbol FROM (SELECT source, unnest(string_split(text, ' ')) AS w FROM documents)) SELECT source, symbol, dense_rank() OVER (PARTITION BY source ORDER BY symbol) AS function_id FROM f")
def s15(spark, d):
    return profiling.pprof_tables(_frames(spark, d), ["source"], ["functions"])["functions"].select("source", "symbol", F.col("function_id").cast("long").alias("function_id"))


@query("s15_pprof_strings", "WITH f AS (SELECT DISTINCT source, s AS string FROM (SELECT source, unnest(string_split(text, ' ')) AS s FROM documents UNION ALL SELECT source, unnest(['', 'm']) FROM documents)) SELECT source, string, dense_rank() OVER (PARTITION BY source ORDER BY string) AS string_id FROM f")
def s15_strings(spark, d):
    return profiling.pprof_tables(_frames(spark, d), ["source"], ["strings"])["strings"].select("source", "string", F.col("string_id").cast("long").alias("string_id"))


@query("s15_pprof_locations", "WITH f AS (SELECT DISTINCT source, w AS symbol FROM (SELECT source, unnest(string_split(text, ' ')) AS w FROM documents)) SELECT source, symbol, length(symbol) AS module_offset, dense_rank() OVER (PARTITION BY source ORDER BY length(symbol), symbol) AS location_id, dense_rank() OVER (PARTITION BY source ORDER BY symbol) AS function_id FROM f")
def s15_locations(spark, d):
    places = profiling.pprof_tables(_frames(spark, d), ["source"], ["locations"])["locations"]
    return places.select("source", "symbol", F.col("module_offset").cast("long").alias("module_offset"), F.col("location_id").cast("long").alias("location_id"), F.col("function_id").cast("long").alias("function_id"))


@query("s15_pprof_samples", "SELECT doc_id AS seq, (doc_id % 3) * 10 AS value, least(256, len(string_split(text, ' '))) AS depth FROM documents")
def s15s(spark, d):
    return profiling.pprof_tables(_frames(spark, d), ["source"], ["samples"])["samples"].select("seq", "value", F.size("locations").cast("long").alias("depth"))


_MAPS = "SELECT 'node-' || CAST(s_suppkey % 4 AS STRING) AS host, 1 AS pid, s_suppkey * 1000 AS start, s_suppkey * 1000 + 600 AS {e}, 50 AS file_offset, '/lib/' || s_name AS path, true AS executable FROM {supplier}"
_IPS = "SELECT 'node-' || CAST(l_suppkey % 4 AS STRING) AS host, 1 AS pid, l_orderkey, l_linenumber, l_suppkey * 1000 + l_partkey % 1000 AS ip FROM {lineitem}"


@query("j11_resolve_module", "SELECT l_orderkey, l_linenumber, l_suppkey * 1000 + l_partkey % 1000 AS ip, CASE WHEN l_partkey % 1000 < 600 THEN '/lib/' || s_name END AS module, CASE WHEN l_partkey % 1000 < 600 THEN 50 + l_partkey % 1000 END AS module_offset FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def j11(spark, d):
    maps = spark.sql(_MAPS.replace("{e}", "end"), supplier=spark.read.parquet(f"{d}/supplier.parquet"))
    ips = spark.sql(_IPS, lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    return profiling.resolve_module(ips, maps).select("l_orderkey", "l_linenumber", "ip", "module", F.col("module_offset").cast("long"))


@query("j12_resolve_function", "SELECT l_orderkey, l_linenumber, l_suppkey * 1000 + l_partkey % 1000 AS module_offset, CASE WHEN l_suppkey % 3 = 0 OR l_partkey % 1000 < 300 THEN s_name END AS function FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def j12(spark, d):
    symbols = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("m").alias("module"), (F.col("s_suppkey") * 1000).alias("start"), F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(300).alias("size"), F.col("s_name").alias("name"))
    frames = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.lit("m").alias("module"), (F.col("l_suppkey") * 1000 + F.col("l_partkey") % 1000).alias("module_offset"))
    return profiling.resolve_function(frames, symbols).select("l_orderkey", "l_linenumber", "module_offset", "function")


@query("j13_resolve_kernel", "WITH k AS (SELECT s_suppkey * 1000 AS a, s_name, max(s_suppkey) OVER () AS top, s_suppkey FROM supplier WHERE s_suppkey > 0) SELECT l_orderkey, l_linenumber, l_suppkey * 1000 + l_partkey % 1000 AS ip, CASE WHEN s_suppkey < top OR l_partkey % 1000 = 0 THEN s_name END AS function FROM lineitem LEFT JOIN k ON s_suppkey = l_suppkey")
def j13(spark, d):
    kallsyms = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("h").alias("host"), (F.col("s_suppkey") * 1000).alias("address"), F.col("s_name").alias("name"))
    frames = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.lit("h").alias("host"), (F.col("l_suppkey") * 1000 + F.col("l_partkey") % 1000).alias("ip"))
    return profiling.resolve_kernel(frames, kallsyms).select("l_orderkey", "l_linenumber", "ip", "function")


@query("j14_resolve_jit", "SELECT o_orderkey AS seq, o_custkey * 40 AS ip, arg_max(s_name, struct_pack(a := s_suppkey * 1000, l := s_suppkey)) AS function FROM orders LEFT JOIN supplier ON o_custkey * 40 >= s_suppkey * 1000 AND o_custkey * 40 < s_suppkey * 1000 + 2500 GROUP BY o_orderkey, o_custkey")
def j14(spark, d):
    perf = spark.read.parquet(f"{d}/supplier.parquet").select(F.lit("h").alias("host"), F.lit(1).alias("pid"), (F.col("s_suppkey") * 1000).alias("start"), F.lit(2500).alias("size"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("line_no"))
    frames = spark.read.parquet(f"{d}/orders.parquet").select(F.lit("h").alias("host"), F.lit(1).alias("pid"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 40).alias("ip"))
    return profiling.resolve_jit(frames, perf).select("seq", "ip", "function")


@query("d7_exec_findings", oracle(["execs"], "SELECT seq, CASE WHEN seq % 6 IN (0, 3) THEN 'runtime.shell_in_container' ELSE 'runtime.network_tool_exec' END AS rule_id, 'medium' AS severity FROM execs WHERE (seq % 6 IN (0, 3) AND container_id IS NOT NULL) OR seq % 6 IN (1, 4)"))
def d7(spark, d):
    rows = adapt(spark, d, "execs").withColumn("arguments", F.array().cast("array<string>"))
    return security.exec_findings(rows).select("seq", "rule_id", "severity")


_PUBLIC = "CASE WHEN pid % 3 = 0 THEN '8.8.' || CAST(pid % 8 AS STRING) || '.4' ELSE remote_address END"


@query("d7_network_findings", oracle(["conn"], f"WITH o AS (SELECT *, {_PUBLIC} AS a FROM conn WHERE kind = 'open') SELECT seq, CASE WHEN a = '10.0.1.1' AND remote_port = 8001 THEN 'network.kubernetes_api_from_workload' ELSE 'network.unexpected_external_connection' END AS rule_id, CASE WHEN a = '10.0.1.1' AND remote_port = 8001 THEN 'high' ELSE 'medium' END AS severity FROM o WHERE (a = '10.0.1.1' AND remote_port = 8001) OR (container_id IS NOT NULL AND pid % 3 = 0)"))
def d7n(spark, d):
    opens = connections(spark, d).where("kind = 'open'").withColumn("remote_address", F.expr(_PUBLIC))
    api = spark.createDataFrame([("10.0.1.1", 8001)], "address string, port int")
    return security.network_findings(opens, api).select("seq", "rule_id", "severity")


@query("a30_profile_modes", "SELECT lang AS mode, CAST(sum(doc_id % 3) AS BIGINT) AS samples, CAST(sum(CASE WHEN doc_id % 5 > 0 THEN n_chars ELSE 0 END) AS BIGINT) AS weight, count(*) FILTER (WHERE doc_id % 5 = 0) AS malformed FROM documents GROUP BY lang")
def a30(spark, d):


    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select((F.col("doc_id") % 3).alias("sample_count"), _kv(("profiling.sample.mode", F.col("lang")), ("profiling.sample.weight", F.when(F.col("doc_id") % 5 > 0, F.col("n_chars").cast("string")).otherwise("bad"))).alias("attributes"))
    return analysis.profile_mode_rollup(rows)
