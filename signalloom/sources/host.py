"""Host counters from the contents of kernel files: a table (host, path, contents, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import TOP

#: Nanoseconds of a clock tick (100 a second), bytes of a sector, of a KiB and of a page.
TICK, SECTOR, KIB, PAGE = 10_000_000, 512, 1024, 4096


def _times(n: Column, unit: int) -> Column:
    return F.coalesce(F.try_multiply(n.cast("long"), F.lit(unit).cast("long")), F.when(n.isNotNull(), F.lit(TOP)))


def ticks_to_nanos(ticks: Column, per_second: int = 100) -> Column:
    """Clock ticks in nanoseconds (F16); like the others it stops at the greatest number."""
    return F.call_function("div", _times(ticks, 1_000_000_000), F.lit(max(1, per_second)))


def kib_to_bytes(n: Column) -> Column:
    return _times(n, KIB)


def usec_to_nanos(n: Column) -> Column:
    return _times(n, 1000)


def sectors_to_bytes(n: Column) -> Column:
    return _times(n, SECTOR)


def _lines(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path").rlike(path)).select("host", "path", "ts", F.explode(F.split("contents", "\n")).alias("line"))


def _field(k: int) -> Column:
    return F.get(F.split(F.trim("line"), r"\s+"), k).try_cast("long")


def node_cpu(files: DataFrame) -> DataFrame:
    """user (with nice), system, idle, iowait, steal in nanoseconds."""
    rows = _lines(files, "^/proc/stat$").where("line like 'cpu %'")
    return rows.select("host", "ts", ((_field(1) + _field(2)) * TICK).alias("user"), (_field(3) * TICK).alias("system"), (_field(4) * TICK).alias("idle"), (_field(5) * TICK).alias("iowait"), (_field(8) * TICK).alias("steal"))


def node_load(files: DataFrame) -> DataFrame:
    """load1, load5, load15, runnable."""
    p = F.split(F.trim("contents"), r"\s+")
    return files.where("path = '/proc/loadavg'").select("host", "ts", *[F.get(p, k).try_cast("double").alias(n) for k, n in enumerate(("load1", "load5", "load15"))], F.substring_index(F.get(p, 3), "/", 1).try_cast("long").alias("runnable"), F.lit(None).cast("long").alias("blocked"))


def node_memory(files: DataFrame) -> DataFrame:
    """total, free, available, swap_total, swap_free in bytes."""
    names = {"total": "MemTotal", "free": "MemFree", "available": "MemAvailable", "swap_total": "SwapTotal", "swap_free": "SwapFree"}
    return files.where("path = '/proc/meminfo'").select("host", "ts", *[(F.regexp_extract("contents", rf"(?m)^{v}:\s+(\d+) kB", 1).try_cast("long") * KIB).alias(k) for k, v in names.items()])


def node_disk(files: DataFrame) -> DataFrame:
    """device, reads, read_bytes, writes, written_bytes."""
    rows = _lines(files, "^/proc/diskstats$").where("trim(line) <> ''")
    return rows.select("host", "ts", F.get(F.split(F.trim("line"), r"\s+"), 2).alias("device"), _field(3).alias("reads"), (_field(5) * SECTOR).alias("read_bytes"), _field(7).alias("writes"), (_field(9) * SECTOR).alias("written_bytes"))


def process_stat(files: DataFrame) -> DataFrame:
    """pid, command, cpu_time (user and system), rss, virtual (S10). The command may hold blanks and parentheses."""
    rest = F.split(F.regexp_extract("contents", r"(?s)^\d+ \(.*\) (.*)$", 1), r"\s+")

    def at(k: int) -> Column:  # the k-th field of the file, from 1; the third comes first here
        return F.get(rest, k - 3).try_cast("long")

    return files.where(F.col("path").rlike(r"^/proc/\d+/stat$")).select("host", "ts", F.regexp_extract("contents", r"^(\d+)", 1).cast("long").alias("pid"), F.regexp_extract("contents", r"(?s)^\d+ \((.*)\) ", 1).alias("command"), ((at(14) + at(15)) * TICK).alias("cpu_time"), at(20).alias("threads"), at(23).alias("virtual"), (at(24) * PAGE).alias("rss"))


def cgroup_cpu(files: DataFrame) -> DataFrame:
    """usage, user, system, throttled in nanoseconds, throttle_periods."""

    def value(name: str) -> Column:
        return F.regexp_extract("contents", rf"(?m)^{name} (\d+)", 1).try_cast("long")

    return files.where("path like '%/cpu.stat'").select("host", "ts", F.regexp_replace("path", "/cpu.stat$", "").alias("cgroup_path"), (value("usage_usec") * 1000).alias("usage"), (value("user_usec") * 1000).alias("user"), (value("system_usec") * 1000).alias("system"), (value("throttled_usec") * 1000).alias("throttled"), value("nr_throttled").alias("throttle_periods"))


def cgroup_limit(files: DataFrame, name: str) -> DataFrame:
    """The value of a limit file; ``max`` is null."""
    return files.where(F.col("path").endswith("/" + name)).select("host", "ts", F.regexp_replace("path", f"/{name}$", "").alias("cgroup_path"), F.trim("contents").try_cast("long").alias("value"))
