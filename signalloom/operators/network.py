"""Connections: life cycles, flow intervals, counters.

Tables are flat: host, pid, fd, protocol, address_family, remote_address, remote_port,
container_id, namespace, pod_name, pod_uid, container_name, ts (nanoseconds), seq (arrival).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounds import saturating_sum
from ..functions.text import tcp_metric, workload_key

CONNECTION = ("host", "pid", "fd", "remote_address", "remote_port")
OWNER = ("host", "workload", "container_id", "protocol", "address_family")
#: Fingerprints of network events.
FINGERPRINT = ("kind", "host", "pid", "fd", "protocol", "address_family", "local_address", "local_port", "remote_address", "remote_port", "opened_at", "ts", "errno")


def workload() -> Column:
    return workload_key(F.col("namespace"), F.col("pod_uid"), F.col("pod_name"), F.col("container_name"))


def open_counters(opens: DataFrame) -> DataFrame:
    """Connections opened by destination and by protocol, and traffic destinations (A1-A3), in one pass."""
    names = F.array(
        F.struct(F.lit("network.connection.open.count").alias("name"), F.lit(True).alias("to")),
        F.struct(F.lit("network.protocol.connection.open.count").alias("name"), F.lit(False).alias("to")),
        F.struct(F.lit("network.traffic.destination.count").alias("name"), F.lit(True).alias("to")),
    )
    # counted by destination first: the three metrics are sums of those
    base = opens.withColumn("workload", workload()).groupBy(*OWNER, "remote_address", "remote_port").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high"))
    each = base.select("*", F.inline(names))
    to = F.col("to")
    return each.groupBy(F.col("name").alias("metric"), *OWNER, F.when(to, F.col("remote_address")).alias("remote_address"), F.when(to, F.col("remote_port")).alias("remote_port")).agg(
        F.sum("n").alias("value"), F.min("low").alias("window_start"), F.max("high").alias("window_end")
    )


def failure_counters(failures: DataFrame) -> DataFrame:
    """Failed connections by destination and errno (A4)."""
    return failures.withColumn("workload", workload()).groupBy(*OWNER, "remote_address", "remote_port", "errno").agg(F.count(F.lit(1)).alias("value"), F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))


def tcp_counters(stats: DataFrame) -> DataFrame:
    """Retransmits, resets and transitions by workload (A5); observations aren't deduplicated."""
    named = stats.withColumn("metric", tcp_metric(F.col("stat"), F.col("reset_direction"), F.col("new_state"))).where("metric is not null")
    unit = F.when(F.col("metric").startswith("network.tcp.retransmits"), "{segment}").when(F.col("metric").startswith("network.tcp.transitions"), "{transition}").otherwise("{connection}")
    return named.withColumn("workload", workload()).groupBy("metric", "host", "workload", "container_id", "address_family").agg(F.count(F.lit(1)).alias("value")).withColumn("unit", unit)


def active(events: DataFrame) -> DataFrame:
    """Opens and closes that change the number of active connections, with ``delta``.

    An open counts unless its connection is open, a close only if it is; without fd nothing is tracked.
    The kinds of a connection alternate, so a look at the event before is enough.
    """
    w = Window.partitionBy(*CONNECTION).orderBy("ts", "seq")
    both = events.where("kind in ('open', 'close') and fd is not null").withColumn("_before", F.lag("kind").over(w))
    keep = F.when(F.col("kind") == "open", ~F.col("_before").eqNullSafe(F.lit("open"))).otherwise(F.col("_before") == "open")
    return both.where(keep).drop("_before").withColumn("delta", F.when(F.col("kind") == "open", 1).otherwise(-1))


def active_gauge(events: DataFrame) -> DataFrame:
    """Active connections by workload."""
    return active(events).withColumn("workload", workload()).groupBy(*OWNER).agg(F.greatest(F.sum("delta"), F.lit(0)).alias("value"), F.max("ts").alias("ts"))


def durations(events: DataFrame) -> DataFrame:
    """Count, sum, minimum and maximum of connection durations by workload (A6): from the matching open, or as the close reports it. A sum above 64 bits stays at the top."""
    w = Window.partitionBy(*CONNECTION).orderBy("ts", "seq")
    kept = active(events).withColumn("opened", F.lag("ts").over(w)).where("kind = 'close'").withColumn("duration", F.col("ts") - F.col("opened"))
    return kept.withColumn("workload", workload()).groupBy(*OWNER).agg(
        F.count(F.lit(1)).alias("count"), saturating_sum(F.col("duration")).alias("sum"), F.min("duration").alias("min"), F.max("duration").alias("max"), F.min("opened").alias("window_start"), F.max("ts").alias("window_end")
    )


def flow_intervals(events: DataFrame) -> DataFrame:
    """Bytes since the event before on the same connection.

    Snapshots and closes carry cumulative bytes. A decrease is a reset: the value itself counts. After a close, or
    where both life cycles are known and differ, a new one begins. Without fd snapshots are ignored and closes count whole.
    """
    w = Window.partitionBy(*CONNECTION).orderBy("ts", "seq")
    both = events.where("kind = 'close' or (kind = 'snapshot' and fd is not null)")
    before = {c: F.lag(c).over(w) for c in ("kind", "bytes_sent", "bytes_received", "ts")}
    opened = F.lag("opened_at").over(w) if "opened_at" in events.columns else F.lit(None)
    other = (F.col("opened_at") != opened) if "opened_at" in events.columns else F.lit(False)
    fresh = F.col("fd").isNull() | before["kind"].isNull() | (before["kind"] == "close") | F.coalesce(other, F.lit(False))
    cols = {"_fresh": fresh, "_sent": before["bytes_sent"], "_received": before["bytes_received"], "_ts": before["ts"]}
    out = both.withColumns(cols)

    def delta(now: str, was: str) -> Column:
        return F.when(F.col("_fresh") | (F.col(now) < F.col(was)), F.col(now)).otherwise(F.col(now) - F.col(was))

    return out.withColumns({"sent": delta("bytes_sent", "_sent"), "received": delta("bytes_received", "_received"), "continues": ~F.col("_fresh"), "interval_start": F.when(F.col("_fresh"), F.col("ts")).otherwise(F.col("_ts"))}).drop("_fresh", "_sent", "_received", "_ts")


def flow_bytes(intervals: DataFrame) -> DataFrame:
    """Bytes by workload, of attributed intervals with bytes."""
    named = intervals.withColumn("workload", workload()).where("workload is not null and sent + received > 0")
    return named.groupBy(*OWNER).agg(F.sum(F.col("sent") + F.col("received")).alias("value"), F.min("interval_start").alias("window_start"), F.max("ts").alias("window_end"))


def flow_summaries(intervals: DataFrame) -> DataFrame:
    """An egress and an ingress row for each attributed interval (D1); rows of zero bytes only where the interval goes on with a series."""
    local = {"container_id": "container_id", "namespace": "namespace", "address": "local_address"}
    have = intervals if "local_address" in intervals.columns else intervals.withColumn("local_address", F.lit(None).cast("string"))

    def row(direction: str, value: str) -> Column:
        here = [F.col(c) for c in (local["address"], local["container_id"])]
        there = [F.col("remote_address"), F.lit(None).cast("string")]
        a, b = (here, there) if direction == "egress" else (there, here)
        return F.struct(F.lit(direction).alias("direction"), a[0].alias("source_address"), a[1].alias("source_container"), b[0].alias("destination_address"), b[1].alias("destination_container"), F.col(value).alias("bytes"))

    both = have.where("namespace is not null").select("*", F.inline(F.array(row("egress", "sent"), row("ingress", "received"))))
    keep = [c for c in ("seq", "host", "pid", "fd", "protocol", "address_family", "remote_address", "remote_port", "interval_start", "ts") if c in both.columns]
    return both.where("bytes > 0 or continues").select(*keep, "direction", "source_address", "source_container", "destination_address", "destination_container", "bytes")


def flow_warnings(intervals: DataFrame) -> DataFrame:
    """Intervals with bytes that lack a container or a pod."""
    reason = F.when(F.col("container_id").isNull(), "missing_container").otherwise("missing_pod")
    return intervals.where("sent + received > 0 and (container_id is null or namespace is null)").select("host", "pid", "fd", "remote_address", "remote_port", "ts", (F.col("sent") + F.col("received")).alias("bytes"), reason.alias("reason"))
