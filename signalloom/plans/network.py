"""Connections, peers, DNS and topology over the provided tables."""

from pyspark.sql import functions as F

from ..functions.hashing import hash_sql
from ..operators import attribution, common, dns, network, peer, topology
from .adapters import adapt, oracle
from .registry import ORACLES, query


def connections(spark, d):
    return attribution.enrich_context(adapt(spark, d, "conn_raw"), adapt(spark, d, "pods"))


def intervals(spark, d):
    return network.flow_intervals(connections(spark, d))


def resolver(spark, d):
    return dns.labelled(attribution.enrich_context(adapt(spark, d, "dns_raw"), adapt(spark, d, "pods")))


OWNER = "host, wl AS workload, container_id, protocol, address_family"
BY_OWNER = "host, wl, container_id, protocol, address_family"
ACTIVE = """act AS (SELECT * FROM (SELECT *, lag(kind) OVER (PARTITION BY host, pid, fd, remote_address, remote_port ORDER BY ts, seq) AS was FROM conn WHERE kind IN ('open', 'close'))
  WHERE CASE WHEN kind = 'open' THEN was IS DISTINCT FROM 'open' ELSE was = 'open' END)"""
INTERVALS = """iv AS (SELECT *, CASE WHEN fresh OR bytes_sent < ps THEN bytes_sent ELSE bytes_sent - ps END AS sent, CASE WHEN fresh OR bytes_received < pr THEN bytes_received ELSE bytes_received - pr END AS received,
  NOT fresh AS continues, CASE WHEN fresh THEN ts ELSE pt END AS interval_start FROM (
  SELECT *, (pk IS NULL OR pk = 'close') AS fresh FROM (SELECT *, lag(kind) OVER w AS pk, lag(bytes_sent) OVER w AS ps, lag(bytes_received) OVER w AS pr, lag(ts) OVER w AS pt
  FROM conn WHERE kind IN ('snapshot', 'close') WINDOW w AS (PARTITION BY host, pid, fd, remote_address, remote_port ORDER BY ts, seq))))"""
SUMMARIES = """fs AS (SELECT seq, host, pid, fd, protocol, address_family, remote_address, remote_port, interval_start, ts, continues, container_id, 'egress' AS direction, sent AS bytes FROM iv WHERE namespace IS NOT NULL
  UNION ALL SELECT seq, host, pid, fd, protocol, address_family, remote_address, remote_port, interval_start, ts, continues, container_id, 'ingress', received FROM iv WHERE namespace IS NOT NULL),
  fsum AS (SELECT seq, host, pid, fd, protocol, address_family, remote_address, remote_port, interval_start, ts, direction, CASE WHEN direction = 'ingress' THEN remote_address END AS source_address,
    CASE WHEN direction = 'egress' THEN container_id END AS source_container, CASE WHEN direction = 'egress' THEN remote_address END AS destination_address, CASE WHEN direction = 'ingress' THEN container_id END AS destination_container, bytes
    FROM fs WHERE bytes > 0 OR continues)"""
PEERS = """byip AS (SELECT pod_ip, arg_min(struct_pack(n := namespace, p := pod_name, o := owner_name, t := owner_type), namespace || '|' || pod_name) AS s FROM pods WHERE pod_ip IS NOT NULL GROUP BY pod_ip),
  ends AS (SELECT f.*, coalesce(a.namespace, i.s.n) AS source_namespace, coalesce(a.pod_name, i.s.p) AS source_pod, coalesce(a.owner_name, i.s.o) AS source_owner_name, coalesce(a.owner_type, i.s.t) AS source_owner_type,
    coalesce(b.namespace, j.s.n) AS destination_namespace, coalesce(b.pod_name, j.s.p) AS destination_pod, coalesce(b.owner_name, j.s.o) AS destination_owner_name, coalesce(b.owner_type, j.s.t) AS destination_owner_type
    FROM fsum f LEFT JOIN pods a ON f.source_container = a.container_id LEFT JOIN byip i ON f.source_address = i.pod_ip
    LEFT JOIN pods b ON f.destination_container = b.container_id LEFT JOIN byip j ON f.destination_address = j.pod_ip)"""
SERIES = ", ".join(peer.SERIES)
KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in peer.SERIES[4:])


@query("j1_enrich_context", oracle(["conn"], "SELECT seq, container_id, namespace, pod_name, pod_uid, container_name, node_name FROM conn"))
def j1(spark, d):
    return connections(spark, d).select("seq", "container_id", "namespace", "pod_name", "pod_uid", "container_name", "node_name")


@query(
    "a1_a3_open_counters",
    oracle(["conn"], f"""SELECT m AS metric, {OWNER}, CASE WHEN t THEN remote_address END AS remote_address, CASE WHEN t THEN remote_port END AS remote_port, count(*) AS value, min(ts) AS window_start, max(ts) AS window_end
    FROM conn, (VALUES ('network.connection.open.count', true), ('network.protocol.connection.open.count', false), ('network.traffic.destination.count', true)) v(m, t) WHERE kind = 'open' GROUP BY m, {BY_OWNER}, CASE WHEN t THEN remote_address END, CASE WHEN t THEN remote_port END"""),
)
def a1(spark, d):
    return network.open_counters(connections(spark, d).where("kind = 'open'"))


@query("a4_failure_counters", oracle(["conn"], f"SELECT {OWNER}, remote_address, remote_port, errno, count(*) AS value, min(ts) AS window_start, max(ts) AS window_end FROM conn WHERE kind = 'failure' GROUP BY {BY_OWNER}, remote_address, remote_port, errno"))
def a4(spark, d):
    return network.failure_counters(connections(spark, d).where("kind = 'failure'"))


@query(
    "a5_tcp_counters",
    oracle(["tcp"], """WITH m AS (SELECT *, CASE WHEN stat = 'retransmit' THEN 'network.tcp.retransmits' WHEN stat = 'reset' THEN CASE reset_direction WHEN 'send' THEN 'network.tcp.resets.sent' WHEN 'receive' THEN 'network.tcp.resets.received' ELSE 'network.tcp.resets' END
      WHEN new_state = 'established' THEN 'network.tcp.transitions.established' WHEN new_state = 'close' THEN 'network.tcp.transitions.closed' END AS metric FROM tcp)
    SELECT metric, host, wl AS workload, container_id, address_family, count(*) AS value, CASE WHEN metric LIKE '%retransmits' THEN '{segment}' WHEN metric LIKE '%transitions%' THEN '{transition}' ELSE '{connection}' END AS unit
    FROM m WHERE metric IS NOT NULL GROUP BY metric, host, wl, container_id, address_family"""),
)
def a5(spark, d):
    return network.tcp_counters(adapt(spark, d, "tcp"))


@query(
    "a6_connection_durations",
    oracle(["conn"], f"""WITH {ACTIVE}, o AS (SELECT *, lag(ts) OVER (PARTITION BY host, pid, fd, remote_address, remote_port ORDER BY ts, seq) AS opened FROM act)
    SELECT {OWNER}, count(*) AS count, CAST(sum(ts - opened) AS BIGINT) AS sum, min(ts - opened) AS min, max(ts - opened) AS max, min(opened) AS window_start, max(ts) AS window_end FROM o WHERE kind = 'close' GROUP BY {BY_OWNER}"""),
)
def a6(spark, d):
    return network.durations(connections(spark, d))


@query("a7_active_connections", oracle(["conn"], f"WITH {ACTIVE} SELECT {OWNER}, CAST(greatest(sum(CASE WHEN kind = 'open' THEN 1 ELSE -1 END), 0) AS BIGINT) AS value, max(ts) AS ts FROM act GROUP BY {BY_OWNER}"))
def a7(spark, d):
    return network.active_gauge(connections(spark, d))


@query("j7_active_changes", oracle(["conn"], f"WITH {ACTIVE} SELECT seq, host, pid, fd, kind, CASE WHEN kind = 'open' THEN 1 ELSE -1 END AS delta FROM act"))
def j7(spark, d):
    return network.active(connections(spark, d)).select("seq", "host", "pid", "fd", "kind", "delta")


@query("w1_flow_intervals", oracle(["conn"], f"WITH {INTERVALS} SELECT seq, sent, received, continues, interval_start, ts FROM iv"))
def w1(spark, d):
    return intervals(spark, d).select("seq", "sent", "received", "continues", "interval_start", "ts")


@query("a8_flow_bytes", oracle(["conn"], f"WITH {INTERVALS} SELECT {OWNER}, CAST(sum(sent + received) AS BIGINT) AS value, min(interval_start) AS window_start, max(ts) AS window_end FROM iv WHERE wl IS NOT NULL AND sent + received > 0 GROUP BY {BY_OWNER}"))
def a8(spark, d):
    return network.flow_bytes(intervals(spark, d))


@query("d1_flow_summaries", oracle(["conn"], f"WITH {INTERVALS}, {SUMMARIES} SELECT * FROM fsum"))
def d1(spark, d):
    return network.flow_summaries(intervals(spark, d))


@query("d2_flow_warnings", oracle(["conn"], f"WITH {INTERVALS} SELECT host, pid, fd, remote_address, remote_port, ts, sent + received AS bytes, CASE WHEN container_id IS NULL THEN 'missing_container' ELSE 'missing_pod' END AS reason FROM iv WHERE sent + received > 0 AND (container_id IS NULL OR namespace IS NULL)"))
def d2(spark, d):
    return network.flow_warnings(intervals(spark, d))


def flows(spark, d):
    pods = adapt(spark, d, "pods")
    none = spark.createDataFrame([], "address string, owner_namespace string, owner_name string, owner_type string")
    rows = network.flow_summaries(intervals(spark, d))
    return attribution.enrich_endpoint(attribution.enrich_endpoint(rows, "source", pods, none), "destination", pods, none)


@query("j2_enrich_endpoints", oracle(["conn"], f"WITH {INTERVALS}, {SUMMARIES}, {PEERS} SELECT seq, direction, {', '.join(s + c for s in ('source_', 'destination_') for c in ('namespace', 'pod', 'owner_name', 'owner_type'))} FROM ends"))
def j2(spark, d):
    return flows(spark, d).select("seq", "direction", *[s + c for s in ("source_", "destination_") for c in ("namespace", "pod", "owner_name", "owner_type")])


@query("a9_peer_flow_bytes", oracle(["conn"], f"WITH {INTERVALS}, {SUMMARIES}, {PEERS} SELECT {SERIES}, false AS overflow, CAST(sum(bytes) AS BIGINT) AS value, min(interval_start) AS window_start, max(ts) AS window_end FROM ends WHERE bytes > 0 AND {KNOWN} GROUP BY {SERIES}"))
def a9(spark, d):
    return peer.peer_flow_bytes(flows(spark, d), most=common.BROADCAST_ROWS)


_TAIL = ", ".join(f"CASE WHEN over THEN '__other__' ELSE {c} END AS {c}" for c in peer.SERIES[4:])


@query(
    "a9_peer_overflow",
    oracle(["conn"], f"""WITH {INTERVALS}, {SUMMARIES}, {PEERS}, s AS (SELECT {SERIES}, sum(bytes) AS value, min(interval_start) AS ws, max(ts) AS we, min(struct_pack(t := ts, q := seq)) AS f FROM ends WHERE bytes > 0 AND {KNOWN} GROUP BY {SERIES}),
    r AS (SELECT *, row_number() OVER (ORDER BY f, {SERIES}) > 50 AS over FROM s), n AS (SELECT CASE WHEN over THEN NULL ELSE host END AS host, protocol, address_family, direction, {_TAIL}, over AS overflow, value, ws, we FROM r)
    SELECT {SERIES}, overflow, CAST(sum(value) AS BIGINT) AS value, min(ws) AS window_start, max(we) AS window_end FROM n GROUP BY {SERIES}, overflow"""),
)
def a9_overflow(spark, d):
    return peer.peer_flow_bytes(flows(spark, d), most=50)


@query(
    "w5_peer_sessions",
    oracle(["conn"], f"""WITH {INTERVALS}, {SUMMARIES}, {PEERS}, g AS (SELECT *, max(ts) OVER (PARTITION BY {SERIES} ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ends WHERE {KNOWN}),
    s AS (SELECT *, sum(CASE WHEN last IS NULL OR ts - last >= {peer.IDLE} THEN 1 ELSE 0 END) OVER (PARTITION BY {SERIES} ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS session FROM g),
    b AS (SELECT *, max(CASE WHEN bytes > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {SERIES}, session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS born FROM s)
    SELECT seq, direction, CAST(session AS BIGINT) AS session, bytes FROM b WHERE born = 1"""),
)
def w5(spark, d):
    return peer.peer_sessions(flows(spark, d)).select("seq", "direction", "session", "bytes")


@query("w4_changelog", oracle(["conn"], "SELECT seq, host, pid, CAST(sum(1) OVER w AS BIGINT) AS cumulative, min(ts) OVER w AS window_start, max(ts) OVER w AS window_end FROM conn WHERE kind = 'open' WINDOW w AS (PARTITION BY host, pid ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)"))
def w4(spark, d):
    rows = connections(spark, d).where("kind = 'open'").withColumn("one", F.lit(1))
    return common.changelog(rows, ["host", "pid"], ["ts", "seq"], "one", "ts", "ts").select("seq", "host", "pid", "cumulative", "window_start", "window_end")


@query("a19_dedup_network", oracle(["conn"], "SELECT kind, host, pid, fd, remote_address, remote_port, min(seq) AS seq FROM conn GROUP BY kind, host, pid, fd, remote_address, remote_port"))
def a19(spark, d):
    keys = ["kind", "host", "pid", "fd", "remote_address", "remote_port"]
    return common.dedup(connections(spark, d).select(*keys, "seq"), keys, ["seq"])


@query("a19_dedup_interactions", oracle(["conn"], "SELECT min(seq) AS seq, host, kind, pid, fd, remote_address, remote_port, hour FROM (SELECT *, CAST(floor(ts / 3600000000000) AS BIGINT) AS hour, CASE WHEN seq % 2 = 0 THEN seq % 3 END AS opened FROM conn WHERE kind IN ('close', 'failure')) GROUP BY host, kind, pid, fd, remote_address, remote_port, hour, CASE WHEN kind = 'close' THEN coalesce(opened, hour) ELSE errno END"))
def a19_interactions(spark, d):
    rows = connections(spark, d).withColumns({"ts": F.floor(F.col("ts") / 3_600_000_000_000), "opened_at": F.when(F.col("seq") % 2 == 0, F.col("seq") % 3)})
    return topology.dedup_interactions(rows).select("seq", "host", "kind", "pid", "fd", "remote_address", "remote_port", F.col("ts").alias("hour"))


@query("k1_cap_keys", oracle(["conn"], "WITH f AS (SELECT remote_address, remote_port, min(ts) AS t FROM conn GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY t, remote_address, remote_port) <= 20 AS within_cap FROM f) SELECT c.seq, r.within_cap FROM conn c JOIN r USING (remote_address, remote_port)"))
def k1(spark, d):
    return common.cap_keys(connections(spark, d), ["remote_address", "remote_port"], "ts", 20).select("seq", "within_cap")


@query("a21_suppressed", oracle(["conn"], "WITH f AS (SELECT remote_address, remote_port, min(ts) AS t FROM conn GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY t, remote_address, remote_port) <= 20 AS ok FROM f) SELECT c.kind, count(*) FILTER (WHERE NOT ok) AS suppressed FROM conn c JOIN r USING (remote_address, remote_port) GROUP BY c.kind"))
def a21(spark, d):
    return common.suppressed(common.cap_keys(connections(spark, d), ["remote_address", "remote_port"], "ts", 20), ["kind"])


DNS_OWNER = "host, workload, container_id, domain, query_type"


@query("a10_dns_queries", oracle(["dns"], f"SELECT {DNS_OWNER}, server_address, server_port, count(*) AS value, min(ts) AS window_start, max(ts) AS window_end FROM dns GROUP BY {DNS_OWNER}, server_address, server_port"))
def a10(spark, d):
    return dns.query_counts(resolver(spark, d))


@query("a11_dns_codes", oracle(["dns"], f"SELECT {DNS_OWNER}, server_address, server_port, response_code, count(*) AS value, min(ts) AS window_start, max(ts) AS window_end FROM dns GROUP BY {DNS_OWNER}, server_address, server_port, response_code"))
def a11(spark, d):
    return dns.response_counts(resolver(spark, d))


@query("a12_dns_lookup_duration", oracle(["dns"], f"SELECT {DNS_OWNER}, response_code, count(*) AS count, CAST(sum(latency) AS BIGINT) AS sum, min(latency) AS min, max(latency) AS max, arg_min(ts, seq) AS window_start, max(ts) AS window_end FROM dns GROUP BY {DNS_OWNER}, response_code"))
def a12(spark, d):
    return dns.lookup_durations(resolver(spark, d))


DNS_EDGES = """de AS (SELECT host, workload, container_id, domain, CAST(sum(CASE WHEN l IS NULL OR ts <> l THEN 1 ELSE 0 END) AS BIGINT) AS observations, min(ts) AS first_seen, max(ts) AS last_seen FROM (
  SELECT *, max(ts) OVER (PARTITION BY host, workload, container_id, domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM dns WHERE response_code = 'no_error' AND domain IS NOT NULL) GROUP BY host, workload, container_id, domain)"""


@query("a13_dns_edges", oracle(["dns"], f"WITH {DNS_EDGES} SELECT * FROM de"))
def a13(spark, d):
    return dns.domain_edges(resolver(spark, d))


@query("k2_cap_domains", oracle(["dns"], "WITH f AS (SELECT domain, min(ts) AS t FROM dns GROUP BY domain), r AS (SELECT *, row_number() OVER (ORDER BY t, domain NULLS FIRST) <= 10 AS ok FROM f) SELECT d.seq, CASE WHEN r.ok THEN d.domain END AS domain FROM dns d JOIN r ON d.domain IS NOT DISTINCT FROM r.domain"))
def k2(spark, d):
    return dns.labelled(attribution.enrich_context(adapt(spark, d, "dns_raw"), adapt(spark, d, "pods")), 10).select("seq", "domain")


EDGES = """ed AS (SELECT host, wl AS workload, container_id, remote_address, remote_port, protocol, CAST(sum(CASE WHEN lo IS NULL OR ts < lo OR ts > hi THEN 1 ELSE 0 END) AS BIGINT) AS observations, min(ts) AS first_seen, max(ts) AS last_seen FROM (
  SELECT *, min(ts) OVER w AS lo, max(ts) OVER w AS hi FROM conn WHERE kind = 'open' WINDOW w AS (PARTITION BY host, wl, container_id, remote_address, remote_port, protocol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY host, wl, container_id, remote_address, remote_port, protocol)"""


@query("a14_dependency_edges", oracle(["conn"], f"WITH {EDGES} SELECT * FROM ed"))
def a14(spark, d):
    return topology.dependency_edges(connections(spark, d).where("kind = 'open'"))


@query("w3_bounds_extensions", oracle(["conn"], "SELECT seq, CASE WHEN lo IS NULL OR ts < lo OR ts > hi THEN 1 ELSE 0 END AS extends FROM (SELECT *, min(ts) OVER w AS lo, max(ts) OVER w AS hi FROM conn WINDOW w AS (PARTITION BY remote_address ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"))
def w3(spark, d):
    return common.bounds_extensions(connections(spark, d), ["remote_address"], ["seq"], "ts").select("seq", "extends")


LABELS = "coalesce(workload, 'container:' || container_id, 'unknown')"


@query(
    "a15_service_paths",
    oracle(["conn", "dns"], f"""WITH {EDGES}, {DNS_EDGES}, u AS (SELECT host, {LABELS} AS source_label, remote_address || ':' || CAST(remote_port AS STRING) AS destination_label, observations, first_seen, last_seen FROM ed
      UNION ALL SELECT host, {LABELS}, domain, observations, first_seen, last_seen FROM de)
    SELECT host, source_label || '->' || destination_label AS path_label, source_label, destination_label, max(observations) AS observations, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM u GROUP BY host, source_label, destination_label"""),
)
def a15(spark, d):
    return topology.observed_paths(connections(spark, d).where("kind = 'open'"), resolver(spark, d))


@query("a15_path_ids", f"SELECT host, path_label, {hash_sql('path_label')} AS path_id FROM ({ORACLES['a15_service_paths']})")
def a15_ids(spark, d):
    return topology.path_ids(a15(spark, d)).select("host", "path_label", "path_id")


def _closable(spark, d):
    return connections(spark, d).withColumns({"workload": network.workload(), "opened_at": F.when(F.col("seq") % 2 == 0, F.col("ts") - 1000)})


@query(
    "d3_interaction_spans",
    oracle(["conn"], """SELECT host, pid, kind, wl AS workload, container_id, remote_address, remote_port, CASE WHEN kind = 'failure' THEN 'network.connect.failure' ELSE 'network.connect' END AS name,
      CASE WHEN kind = 'close' AND seq % 2 = 0 THEN ts - 1000 ELSE ts END AS start, ts AS "end", CASE WHEN kind = 'close' AND seq % 2 = 0 THEN 1000 ELSE 0 END AS duration, 'errno_' || CAST(errno AS STRING) AS error_type, 'client' AS role FROM conn WHERE kind IN ('close', 'failure')"""),
)
def d3(spark, d):
    return topology.interaction_spans(_closable(spark, d))


@query("d3_interaction_warnings", oracle(["conn"], "SELECT DISTINCT 'missing_attribution' AS warning, kind AS source_kind, host, ts, remote_address, remote_port FROM conn WHERE kind IN ('close', 'failure') AND container_id IS NULL AND wl IS NULL"))
def d3w(spark, d):
    return topology.interaction_warnings(_closable(spark, d))
