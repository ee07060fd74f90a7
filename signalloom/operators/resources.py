"""Resource counters and gauges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dedup


#: What tells observations of a kind apart beside host and time: the scope's columns, those of the values, and those of which a missing one counts as 0.
FINGERPRINTS = {
    "node_cpu": ((), ("user", "system", "idle", "iowait", "steal"), ("runnable", "blocked")),
    "node_load": ((), ("load1", "load5", "load15"), ()),
    "node_memory": ((), ("total", "available", "free", "swap_total", "swap_free"), ()),
    "node_filesystem": (("mount_point",), ("total", "available", "filesystem_type"), ()),
    "node_disk": (("device",), ("reads", "writes", "read_bytes", "written_bytes"), ()),
    "process": (("pid",), ("cpu_time", "rss", "virtual", "fds", "sockets", "threads"), ()),
    "cgroup_cpu": (("cgroup_path",), ("usage", "user", "system", "throttle_periods", "throttled"), ()),
    "cgroup_memory": (("cgroup_path",), ("current", "peak", "limit"), ()),
    "cgroup_pids": (("cgroup_path",), ("pids", "threads", "pids_limit"), ()),
    "cgroup_fds": (("cgroup_path",), ("open", "sockets"), ()),
}


def dedup_observations(obs: DataFrame, kind: str, order: Sequence[str] = ()) -> DataFrame:
    """One row for each observation of a kind (A19): equal host, time, scope and values; the first by ``order``."""
    scope, values, zeros = FINGERPRINTS[kind]
    marked = obs.withColumns({f"_z_{c}": F.coalesce(F.col(c), F.lit(0)) for c in zeros})
    return dedup(marked, ("host", "ts", *scope, *values, *[f"_z_{c}" for c in zeros]), order).drop(*[f"_z_{c}" for c in zeros])


def counter_deltas(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """What a cumulative counter gained since its row before.

    The first row gives nothing; an equal one gives nothing but moves the time; a decrease gives nothing and rebases.
    """
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    out = df.withColumns({"delta": F.col(value) - F.lag(value).over(w), "window_start": F.lag(ts).over(w)})
    return out.where("delta > 0").withColumn("window_end", F.col(ts))


def gauge_changes(df: DataFrame, keys: Sequence[str], value: str = "value", ts: str = "ts", order: Sequence[str] = ()) -> DataFrame:
    """The first row of a series and each that differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(ts, *order)
    marked = df.withColumns({"_was": F.lag(value).over(w), "_n": F.row_number().over(w)})
    return marked.where((F.col("_n") == 1) | ~F.col("_was").eqNullSafe(F.col(value))).drop("_was", "_n")


def unpivot(df: DataFrame, columns: dict[str, tuple[str, str | None]], keep: Sequence[str]) -> DataFrame:
    """One row for each named column that isn't null: metric, state, value. ``columns``: source -> (metric, state)."""
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(s).cast("string").alias("state"), F.col(c).cast("long").alias("value")) for c, (m, s) in columns.items()]
    return df.select(*keep, F.inline(F.array(*rows))).where("value is not null")


#: Columns of observations, by kind, with the metric and state they feed.
COUNTERS = {
    "node_cpu": {"user": ("system.cpu.time", "user"), "system": ("system.cpu.time", "system"), "idle": ("system.cpu.time", "idle"), "iowait": ("system.cpu.time", "iowait"), "steal": ("system.cpu.time", "steal")},
    "node_disk": {"read_bytes": ("system.disk.io", "read"), "written_bytes": ("system.disk.io", "write"), "reads": ("system.disk.operations", "read"), "writes": ("system.disk.operations", "write")},
    "process": {"cpu_time": ("process.cpu.time", None)},
    "cgroup_cpu": {"usage": ("container.cpu.time", None), "user": ("container.cpu.time", "user"), "system": ("container.cpu.time", "system"), "throttled": ("container.cpu.throttled.time", None), "throttle_periods": ("container.cpu.throttled.periods", None)},
}
GAUGES = {
    "node_load": {"load1": ("system.load.1m", None), "load5": ("system.load.5m", None), "load15": ("system.load.15m", None), "runnable": ("system.processes.runnable", None), "blocked": ("system.processes.blocked", None)},
    "node_memory": {"total": ("system.memory.limit", None), "free": ("system.memory.usage", "free"), "available": ("system.memory.available", None), "swap_total": ("system.swap.limit", None), "swap_free": ("system.swap.usage", "free")},
    "node_filesystem": {"used": ("system.filesystem.usage", None), "available": ("system.filesystem.available", None), "total": ("system.filesystem.limit", None)},
    "process": {"rss": ("process.memory.usage", None), "virtual": ("process.memory.virtual", None), "fds": ("process.open_file_descriptors", None), "sockets": ("process.open_sockets", None), "threads": ("process.threads", None)},
    "cgroup_memory": {"current": ("container.memory.usage", None), "limit": ("container.memory.limit", None), "working_set": ("container.memory.working_set", None)},
    "cgroup_pids": {"pids": ("container.pids", None), "pids_limit": ("container.pids.limit", None), "threads": ("container.threads", None)},
    "cgroup_fds": {"open": ("container.open_file_descriptors", None), "sockets": ("container.open_sockets", None)},
}


def resource_counters(obs: DataFrame, kind: str, keys: Sequence[str]) -> DataFrame:
    """Counters of one kind of observation: unpivoted, then their gains."""
    return counter_deltas(unpivot(obs, COUNTERS[kind], [*keys, "ts"]), [*keys, "metric", "state"])


def resource_gauges(obs: DataFrame, kind: str, keys: Sequence[str]) -> DataFrame:
    """Gauges of one kind of observation: unpivoted, changes only (A18). Load averages are in thousandths."""
    if kind == "node_load":
        obs = obs.withColumns({c: F.round(F.col(c) * 1000).cast("long") for c in ("load1", "load5", "load15")})
    return gauge_changes(unpivot(obs, GAUGES[kind], [*keys, "ts"]), [*keys, "metric", "state"])
