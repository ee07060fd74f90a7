"""The provided tables as signal tables: one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What the two engines call differently.
DIALECT = {
    "spark": {"@US(ts)": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", "@K": "CAST(get_json_object(props, '$.k') AS BIGINT)", "@DAY(": "datediff(", "@EPOCH": "DATE'1970-01-01'", "@HOST(url)": "parse_url(url, 'HOST')"},
    "duckdb": {"@US(ts)": "epoch_us(ts)", "@K": "CAST(json_extract_string(props, '$.k') AS BIGINT)", "@DAY(": "date_diff('day', @EPOCH, ", "@EPOCH": "DATE '1970-01-01'", "@HOST(url)": "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"},
}

CTES = {
    "ev": """SELECT event_id AS seq, @US(ts) * 1000 AS ts, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents, @K AS k FROM events""",
    "conn_raw": """SELECT seq, 'node-' || CAST(user_id % 4 AS STRING) AS host, user_id AS pid, CAST(k % 8 AS INT) AS fd, 'tcp' AS protocol, 'ipv4' AS address_family,
      '10.0.' || CAST(user_id % 8 AS STRING) || '.' || CAST(k % 16 AS STRING) AS remote_address, CAST(8000 + k % 4 AS INT) AS remote_port,
      CASE WHEN user_id % 5 <> 0 THEN CAST(user_id AS STRING) END AS container_id, ts,
      CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' WHEN 'error' THEN 'failure' ELSE 'snapshot' END AS kind,
      CAST(CASE WHEN event_type = 'error' THEN 100 + k % 5 END AS INT) AS errno,
      CAST(SUM(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN cents ELSE 0 END) OVER (PARTITION BY user_id, k % 16 ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_sent,
      CAST(SUM(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN cents % 97 ELSE 0 END) OVER (PARTITION BY user_id, k % 16 ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_received
      FROM ev""",
    "pods": """SELECT CAST(c_custkey AS STRING) AS container_id, lower(r_name) AS namespace, 'pod-' || CAST(c_custkey AS STRING) AS pod_name, 'uid-' || CAST(c_custkey AS STRING) AS pod_uid,
      'main' AS container_name, 'node-' || CAST(c_custkey % 4 AS STRING) AS node_name, lower(n_name) AS owner_name, 'deployment' AS owner_type,
      CASE WHEN c_custkey < 128 THEN '10.0.' || CAST(c_custkey % 8 AS STRING) || '.' || CAST(CAST(floor(c_custkey / 8) AS BIGINT) % 16 AS STRING) END AS pod_ip
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "conn": """SELECT c.*, p.namespace, p.pod_name, p.pod_uid, p.container_name, p.node_name, p.namespace || '/' || p.pod_uid || '/' || p.container_name AS wl FROM conn_raw c LEFT JOIN pods p ON c.container_id = p.container_id""",
    "tcp": """SELECT host, container_id, namespace, pod_name, pod_uid, container_name, address_family, wl, CASE seq % 3 WHEN 0 THEN 'retransmit' WHEN 1 THEN 'reset' ELSE 'state_transition' END AS stat,
      CASE WHEN seq % 3 = 1 THEN CASE pid % 3 WHEN 0 THEN 'send' WHEN 1 THEN 'receive' END END AS reset_direction,
      CASE WHEN seq % 3 = 2 THEN CASE pid % 3 WHEN 0 THEN 'established' WHEN 1 THEN 'close' ELSE 'listen' END END AS new_state FROM conn""",
    "dns_raw": """SELECT page_id AS seq, 'node-' || CAST(page_id % 4 AS STRING) AS host, page_id % 150 AS pid, @HOST(url) AS query_name, CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'aaaa' ELSE 'cname' END AS query_type,
      CASE page_id % 5 WHEN 0 THEN 'nx_domain' WHEN 1 THEN 'server_failure' ELSE 'no_error' END AS response_code, '10.96.0.10' AS server_address, 53 AS server_port,
      CAST(floor(page_id / 2) AS BIGINT) * 1000000 AS ts, page_id * 1000 AS latency, CASE WHEN page_id % 5 <> 0 THEN CAST(page_id % 150 AS STRING) END AS container_id FROM pages""",
    "dns": """SELECT d.*, p.namespace, p.pod_name, p.pod_uid, p.container_name, p.namespace || '/' || p.pod_uid || '/' || p.container_name AS workload, lower(d.query_name) AS domain
      FROM dns_raw d LEFT JOIN pods p ON d.container_id = p.container_id""",
    "counters": """SELECT l_suppkey AS device, l_orderkey, l_linenumber, CAST(@DAY(l_shipdate, @EPOCH) AS BIGINT) AS day, CAST(SUM(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS value,
      ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq FROM lineitem""",
    "gauges": """SELECT o_custkey AS series, o_orderkey AS seq, CAST(@DAY(o_orderdate, @EPOCH) AS BIGINT) AS day, CAST(floor(o_totalprice / 50000) AS BIGINT) AS value FROM orders""",
    "arms": """SELECT o_orderpriority AS arm, o_orderkey % 3 AS run, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders""",
}
CTES["counters"] = CTES["counters"].replace("@DAY(l_shipdate, @EPOCH)", "@DAYS(l_shipdate)")
CTES["gauges"] = CTES["gauges"].replace("@DAY(o_orderdate, @EPOCH)", "@DAYS(o_orderdate)")
for _name, _form in (("spark", "datediff(CAST({0} AS DATE), DATE'1970-01-01')"), ("duckdb", "date_diff('day', DATE '1970-01-01', CAST({0} AS DATE))")):
    DIALECT[_name] = {k: v for k, v in DIALECT[_name].items() if not k.startswith(("@DAY(", "@EPOCH"))} | {f"@DAYS({c})": _form.format(c) for c in ("l_shipdate", "o_orderdate")}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
NEEDS = {"conn_raw": ["ev"], "conn": ["conn_raw", "pods"], "tcp": ["conn"], "dns": ["dns_raw", "pods"]}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_closure(NEEDS.get(n, [])), n]:
            if x not in out:
                out.append(x)
    return out


def with_clause(names: list[str], engine: str) -> str:
    """``WITH`` and the adapters that ``names`` need, in an engine's words."""
    text = "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in _closure(names))
    for k, v in DIALECT[engine].items():
        text = text.replace(k, v)
    return text


def oracle(names: list[str], select: str) -> str:
    """DuckDB SQL: the adapters, then ``select``, which may have further CTEs: a leading ``WITH`` is merged."""
    head, body = with_clause(names, "duckdb"), select.strip()
    if body[:5].upper() == "WITH ":
        return f"{head},\n{body[5:]}"
    return f"{head}\n{body}"


def adapt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter as a DataFrame."""
    text = with_clause([name], "spark")
    frames = {}
    for t in TABLES:
        for word in (f"FROM {t}", f"JOIN {t}"):
            if word in text:
                frames[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
                text = text.replace(word, word.split()[0] + " {" + t + "}")
    return spark.sql(f"{text}\nSELECT * FROM {name}", **frames)

CTES |= {
    "convs": """SELECT conv_id, turn, role, 'node-' || CAST(conv_id % 4 AS STRING) AS host, CAST(conv_id AS STRING) AS connection, turn AS correlation_id, conv_id * 1000 + turn AS seq, (conv_id * 100 + turn) * 1000000 AS ts, length(text) AS n FROM conversations""",
    "stacks": """SELECT doc_id AS seq, source, doc_id * 1000000000 AS ts, CASE WHEN doc_id % 3 = 0 THEN 'cpu' ELSE 'wall' END AS kind, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, 1 + doc_id % 9 AS sample_count, CAST(n_chars % 50 AS STRING) AS stack_id, doc_id % 7 AS pid FROM documents""",
    "execs": """SELECT doc_id AS seq, CASE doc_id % 6 WHEN 0 THEN '/bin/bash' WHEN 1 THEN '/usr/bin/curl' WHEN 2 THEN '/usr/bin/python3' WHEN 3 THEN 'sh' WHEN 4 THEN 'nc' END AS executable, 'run' || CAST(doc_id % 5 AS STRING) AS command, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS STRING) END AS container_id, lang FROM documents""",
}
