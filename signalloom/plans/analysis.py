"""Resources and run comparison over the provided tables."""

from pyspark.sql import functions as F

from ..operators import analysis, resources
from .adapters import adapt, oracle
from .registry import query


@query("w1b_counter_deltas", oracle(["counters"], "SELECT device, seq, delta, window_start, day AS window_end FROM (SELECT *, value - lag(value) OVER w AS delta, lag(day) OVER w AS window_start FROM counters WINDOW w AS (PARTITION BY device ORDER BY day, seq)) WHERE delta > 0"))
def w1b(spark, d):
    return resources.counter_deltas(adapt(spark, d, "counters"), ["device"], ts="day", order=["seq"]).select("device", "seq", "delta", "window_start", "window_end")


_USED = "SELECT o_orderkey AS seq, 'h' AS host, o_custkey % 5 AS day, 'm' || CAST(o_custkey % 7 AS STRING) AS mount_point, CAST(floor(o_totalprice / 50000) AS BIGINT) AS total, CASE WHEN o_orderstatus = 'F' THEN 1 END AS available, o_orderpriority AS filesystem_type FROM {orders}"


@query("a19_dedup_resources", f"WITH o AS ({_USED.replace('{orders}', 'orders')}) SELECT min(seq) AS seq, host, day, mount_point, total, available, filesystem_type FROM o GROUP BY ALL")
def a19_resources(spark, d):
    obs = spark.sql(_USED, orders=spark.read.parquet(f"{d}/orders.parquet")).withColumnRenamed("day", "ts")
    return resources.dedup_observations(obs, "node_filesystem", ("seq",)).withColumnRenamed("ts", "day")


@query("w2_gauge_changes", oracle(["gauges"], "SELECT series, seq, day, value FROM (SELECT *, lag(value) OVER w AS was, row_number() OVER w AS n FROM gauges WINDOW w AS (PARTITION BY series ORDER BY day, seq)) WHERE n = 1 OR was IS DISTINCT FROM value"))
def w2(spark, d):
    return resources.gauge_changes(adapt(spark, d, "gauges"), ["series"], ts="day", order=["seq"])


_CPU = "SELECT l_suppkey AS device, l_orderkey AS ts, CAST(max(floor(l_quantity)) AS BIGINT) AS read_bytes, CAST(max(floor(l_extendedprice)) AS BIGINT) AS written_bytes, CASE WHEN min(l_tax) > 0.02 THEN CAST(max(l_linenumber) AS BIGINT) END AS reads, CAST(count(*) AS BIGINT) AS writes FROM {lineitem} GROUP BY l_suppkey, l_orderkey"


@query(
    "a17_resource_counters",
    f"""WITH o AS ({_CPU.replace('{lineitem}', 'lineitem')}), u AS (SELECT device, ts, 'system.disk.io' AS metric, 'read' AS state, read_bytes AS value FROM o UNION ALL SELECT device, ts, 'system.disk.io', 'write', written_bytes FROM o
    UNION ALL SELECT device, ts, 'system.disk.operations', 'read', reads FROM o UNION ALL SELECT device, ts, 'system.disk.operations', 'write', writes FROM o)
    SELECT device, metric, state, ts, delta, window_start FROM (SELECT *, value - lag(value) OVER w AS delta, lag(ts) OVER w AS window_start FROM u WHERE value IS NOT NULL WINDOW w AS (PARTITION BY device, metric, state ORDER BY ts)) WHERE delta > 0""",
)
def a17(spark, d):
    obs = spark.sql(_CPU, lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))
    return resources.resource_counters(obs, "node_disk", ["device"]).select("device", "metric", "state", "ts", "delta", "window_start")


_FS = "SELECT o_custkey AS device, o_orderkey AS ts, CAST(floor(o_totalprice / 100000) AS BIGINT) AS used, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS available, 7 AS total FROM {orders}"


@query(
    "a18_resource_gauges",
    f"""WITH o AS ({_FS.replace('{orders}', 'orders')}), u AS (SELECT device, ts, 'system.filesystem.usage' AS metric, used AS value FROM o UNION ALL SELECT device, ts, 'system.filesystem.available', available FROM o UNION ALL SELECT device, ts, 'system.filesystem.limit', total FROM o)
    SELECT device, ts, metric, value FROM (SELECT *, lag(value) OVER w AS was, row_number() OVER w AS n FROM u WINDOW w AS (PARTITION BY device, metric ORDER BY ts)) WHERE n = 1 OR was IS DISTINCT FROM value""",
)
def a18(spark, d):
    obs = spark.sql(_FS, orders=spark.read.parquet(f"{d}/orders.parquet"))
    return resources.resource_gauges(obs, "node_filesystem", ["device"]).select("device", "ts", "metric", "value")




@query(
    "a24_summary_stats",
    oracle(["arms"], """WITH r AS (SELECT *, row_number() OVER (PARTITION BY arm, run ORDER BY value) AS rn, count(*) OVER (PARTITION BY arm, run) AS c FROM arms)
    SELECT arm, run, count(*) AS n, min(value) AS min, round(avg(value), 6) AS mean, median(value) AS median, min(CASE WHEN rn >= ceil(c * 0.95) THEN value END) AS p95, max(value) AS max, round(stddev_samp(value), 4) AS stdev, round(stddev_samp(value) / avg(value) * 100, 6) AS cv_percent FROM r GROUP BY arm, run"""),
)
def a24(spark, d):
    out = analysis.summary_stats(adapt(spark, d, "arms"), ["arm", "run"], "value")
    return out.withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 4), "cv_percent": F.round("cv_percent", 6)})


@query("a26_compare_arms", oracle(["arms"], "WITH s AS (SELECT arm, sum(value) AS v FROM arms GROUP BY arm), b AS (SELECT v FROM s WHERE arm = '1-URGENT') SELECT s.arm, CAST(s.v AS BIGINT) AS candidate, CAST(b.v AS BIGINT) AS baseline, round((s.v - b.v) / b.v * 100, 6) AS percent_change FROM s, b WHERE s.arm <> '1-URGENT'"))
def a26(spark, d):
    totals = adapt(spark, d, "arms").groupBy("arm").agg(F.sum("value").alias("v"))
    return analysis.compare_arms(totals, "arm", "v", "1-URGENT").withColumn("percent_change", F.round("percent_change", 6))


@query(
    "a27_counter_rate",
    oracle(["counters"], """WITH p AS (SELECT device, day, max(value) AS value FROM counters GROUP BY device, day), g AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL THEN 0 WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS gain FROM p WINDOW w AS (PARTITION BY device ORDER BY day)),
    r AS (SELECT device, day, (sum(gain) OVER w - first_value(gain) OVER w) / 60.0 AS rate FROM g WINDOW w AS (PARTITION BY device ORDER BY day RANGE BETWEEN 60 PRECEDING AND CURRENT ROW))
    SELECT device % 4 AS node, day, round(sum(rate), 6) AS rate FROM r GROUP BY device % 4, day"""),
)
def a27(spark, d):
    points = adapt(spark, d, "counters").groupBy("device", "day").agg(F.max("value").alias("value")).withColumn("node", F.col("device") % 4)
    return analysis.counter_rate(points, ["node", "device"], ["node"], 60, ts="day").withColumn("rate", F.round("rate", 6))


@query(
    "a28_first_signal_latency",
    oracle(["ev"], "WITH s AS (SELECT user_id, min(ts) + 1000000000000 AS start FROM ev GROUP BY user_id) SELECT s.user_id, s.start, (min(e.ts) - s.start) / 1000000.0 AS latency_ms, count(e.ts) AS matches FROM s LEFT JOIN ev e ON e.user_id = s.user_id AND e.ts >= s.start GROUP BY s.user_id, s.start"),
)
def a28(spark, d):
    ev = adapt(spark, d, "ev")
    starts = ev.groupBy("user_id").agg((F.min("ts") + 1000000000000).alias("start"))
    return analysis.first_signal_latency(ev, starts, "user_id")


@query(
    "a31_histogram_percentile",
    """WITH b AS (SELECT l_returnflag, CAST(ceil(l_extendedprice / 10000) AS BIGINT) * 10000 AS bound, count(*) AS c FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY l_returnflag ORDER BY bound) AS upto, sum(c) OVER (PARTITION BY l_returnflag) AS total FROM b)
    SELECT l_returnflag, coalesce(min(CASE WHEN upto >= ceil(total * 0.95) THEN bound END), max(bound)) AS percentile FROM r GROUP BY l_returnflag""",
)
def a31(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", (F.ceil(F.col("l_extendedprice") / 10000).cast("long") * 10000).alias("bound"), F.lit(1).alias("count"))
    return analysis.histogram_percentile(rows, ["l_returnflag"], 0.95)


@query(
    "a32_pod_totals",
    oracle(["arms"], """WITH t AS (SELECT arm, run, sum(value) AS total FROM arms GROUP BY arm, run), r AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY total) AS rn, count(*) OVER (PARTITION BY arm) AS c FROM t)
    SELECT arm, count(*) AS n, CAST(min(total) AS BIGINT) AS min, round(avg(total), 3) AS mean, CAST(max(total) AS BIGINT) AS max, CAST(min(CASE WHEN rn >= ceil(c * 0.95) THEN total END) AS BIGINT) AS p95 FROM r GROUP BY arm"""),
)
def a32(spark, d):
    return analysis.pod_totals(adapt(spark, d, "arms"), ["arm"], "run", "value").select("arm", "n", "min", F.round("mean", 3).alias("mean"), "max", "p95")


@query("a33_contract_drift", "SELECT o_custkey % 10 AS grp, count(DISTINCT o_orderstatus || '|' || o_orderpriority) AS contracts, count(DISTINCT o_orderstatus || '|' || o_orderpriority) > 1 AS drifted FROM orders GROUP BY o_custkey % 10")
def a33(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").withColumn("grp", F.col("o_custkey") % 10)
    return analysis.contract_drift(rows, ["grp"], ["o_orderstatus", "o_orderpriority"])


@query(
    "a29_signal_accounting",
    oracle(["ev"], "WITH w AS (SELECT event_type AS family, CAST(sum(k) AS BIGINT) AS expected FROM ev GROUP BY event_type), g AS (SELECT event_type AS family, CAST(sum(cents % 60) AS BIGINT) AS emitted FROM ev WHERE event_type <> 'error' GROUP BY event_type) SELECT family, expected, coalesce(emitted, 0) AS emitted, greatest(expected - coalesce(emitted, 0), 0) AS missing FROM w LEFT JOIN g USING (family)"),
)
def a29(spark, d):
    ev = adapt(spark, d, "ev").withColumnRenamed("event_type", "family")
    return analysis.signal_accounting(ev.select("family", F.col("k").alias("successes")), ev.where("family <> 'error'").select("family", (F.col("cents") % 60).alias("delta")))


@query(
    "a25_scrape_delta",
    oracle(["ev"], """WITH b AS (SELECT user_id, event_type || '_total' AS name, sum(cents) AS v FROM ev WHERE seq % 2 = 0 GROUP BY 1, 2), a AS (SELECT user_id, event_type || '_total' AS name, sum(cents % 300) AS v FROM ev GROUP BY 1, 2)
    SELECT name, CAST(sum(greatest(0, a.v - coalesce(b.v, 0))) AS DOUBLE) AS delta FROM a LEFT JOIN b USING (user_id, name) GROUP BY name"""),
)
def a25(spark, d):
    ev = adapt(spark, d, "ev")

    def scrape(rows, value):
        sums = rows.groupBy("user_id", "event_type").agg(F.sum(value).cast("double").alias("value"))
        return sums.select(F.concat("event_type", F.lit("_total")).alias("name"), F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("labels"), "value")

    return analysis.scrape_delta(scrape(ev.where("seq % 2 = 0"), F.col("cents")), scrape(ev, F.col("cents") % 300))
