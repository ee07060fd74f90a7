"""Profiles: samples, sessions, warnings, symbols.

A sample row has source, host, seq, ts, kind, correlation_kind, confidence, sample_count, period, stack_id, frames, pid, uid, container_id,
namespace, pod_uid, pod_name, container_name, attributes (array of key, value).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bounds import drop_sensitive
from ..functions.hashing import bounded_or_hash, fnv1a64, stack_id
from ..functions.text import bucket
from .common import dedup, stored
from .running import dense_ids, dense_ranks, running, split_points

#: Nanoseconds of a session; samples and stacks it keeps; frames, attributes and samples of one row; reserved attribute keys.
WINDOW, SAMPLES, STACKS, FRAMES, ATTRIBUTES, MAX_COUNT = 30_000_000_000, 64, 64, 64, 16, 65_536
RESERVED = ("schema", "profile_id", "profile_kind", "correlation_kind", "confidence", "sample_count", "stack_id", "frame_count")
CONFIDENCE = ("low", "medium", "high")
#: What tells sessions apart; the window's end follows from its start.
SESSION = ("source", "host", "pid", "uid", "container_id", "namespace", "pod_uid", "container_name", "kind", "correlation_kind", "period", "bucket")
WEIGHT, TOTAL_WEIGHT = "profiling.sample.weight_nanos", "profiling.session.total_weight_nanos"
STACK_BYTES = 128
#: Frames that a sample of a profile lists.
PPROF_FRAMES = 256


def normalize_samples(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, rejected): bounded frames and attributes, capped counts, stack ids (P20). A count of 0 or below is rejected."""
    good = F.coalesce(F.col("sample_count") > 0, F.lit(False))
    cut = F.size("frames") > FRAMES
    clean = F.filter(drop_sensitive(F.col("attributes")), lambda a: ~F.lower(a["key"]).isin(*RESERVED))
    keys = F.array_sort(F.array_distinct(F.transform(clean, lambda a: a["key"])))
    one = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(clean, lambda a: a["key"] == k), 1)["value"].alias("value")))
    marked = F.when(cut, F.array_append(F.slice(one, 1, ATTRIBUTES - 1), F.struct(F.lit("profiling.stack.truncated").alias("key"), F.lit("true").alias("value")))).otherwise(F.slice(one, 1, ATTRIBUTES))
    out = df.where(good).withColumns({"frames": F.slice("frames", 1, FRAMES), "attributes": marked, "sample_count": F.least("sample_count", F.lit(MAX_COUNT))})
    return out.withColumn("stack_id", stack_id(F.col("frames"))), df.where(~good).withColumn("reason", F.lit("empty_sample"))


#: What tells samples apart beside their bounded stack id and weight.
SAMPLE = ("source", "host", "ts", "pid", "kind", "correlation_kind", "thread_id", "sample_count", "period", "container_id", "pod_uid")


def sample_weight(attributes: Column) -> Column:
    """The weight that a sample's attributes name, if it is a number."""
    return F.get(F.filter(attributes, lambda a: a["key"] == WEIGHT), 0)["value"].try_cast("long")


def dedup_samples(samples: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """One row for each sample (A19); the first by ``order``."""
    known = [c for c in SAMPLE if c in samples.columns]
    marked = samples.withColumns({"_stack": bounded_or_hash(F.col("stack_id"), STACK_BYTES, "stack-hash:"), "_weight": sample_weight(F.col("attributes"))})
    return dedup(marked, (*known, "_stack", "_weight"), order).drop("_stack", "_weight")


def _on(left: DataFrame, right: DataFrame) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in SESSION])


def profile_sessions(samples: DataFrame, window: int = WINDOW) -> DataFrame:
    """Tumbling sessions by identity (A16): observed and dropped samples, distinct stacks up to a cap, least confidence, summed weight, merged attributes.

    Stacks and attributes are counted by value first, so that no set of them is gathered for a busy session; of the attributes
    the first ``ATTRIBUTES`` in order stay.
    """
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    weight = F.coalesce(sample_weight(F.col("attributes")), F.lit(0))
    rows = samples.withColumns({"bucket": bucket(F.col("ts"), window), "stack_id": bounded_or_hash(F.col("stack_id"), STACK_BYTES, "stack-hash:"), "_w": F.greatest(weight, F.lit(0))})
    stacks = rows.groupBy(*SESSION, "stack_id").agg(F.sum("sample_count").alias("n"), F.min(rank).alias("c"), F.min("ts").alias("low"), F.max("ts").alias("high"), F.sum("_w").alias("w"))
    out = stacks.groupBy(*SESSION).agg(
        F.least(F.sum("n"), F.lit(SAMPLES)).alias("observed"), F.greatest(F.sum("n") - SAMPLES, F.lit(0)).alias("dropped"),
        F.least(F.count("stack_id"), F.lit(STACKS)).alias("distinct_stacks"), F.min("c").alias("c"), F.min("low").alias("first_seen"), F.max("high").alias("last_seen"), F.sum("w").alias("total_weight"),
    )
    pairs = rows.select(*SESSION, F.inline("attributes")).distinct()
    first = Window.partitionBy(*SESSION).orderBy("key", "value")
    kept = pairs.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= ATTRIBUTES).groupBy(*SESSION).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("_kept"))
    joined = out.join(kept, _on(out, kept), "left").select(*[out[c] for c in out.columns], F.filter(F.coalesce("_kept", F.array().cast("array<struct<key:string,value:string>>")), lambda a: a["key"] != WEIGHT).alias("_kept"))
    total = F.array(F.struct(F.lit(TOTAL_WEIGHT).alias("key"), F.col("total_weight").cast("string").alias("value")))
    merged = F.when(F.col("total_weight") > 0, F.array_sort(F.concat(F.slice("_kept", 1, ATTRIBUTES - 1), total))).otherwise(F.col("_kept"))
    return joined.withColumn("attributes", merged).withColumn("confidence", F.get(F.array(*map(F.lit, CONFIDENCE)), (F.col("c") - 1).cast("int"))).drop("c", "_kept").withColumn("window_end", F.col("bucket") + window)


def session_ids(sessions: DataFrame) -> DataFrame:
    """``sessions`` with profile_id, the hash of their identity (F8)."""

    def some(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("some:"), F.col(c).cast("string")), F.lit("none"))

    fields = {"source": F.col("source"), "host": some("host"), "pid": some("pid"), "uid": some("uid"), "container": some("container_id"), "namespace": some("namespace"), "pod": some("pod_uid"), "k8s_container": some("container_name"),
              "kind": F.col("kind"), "correlation": F.col("correlation_kind"), "period": some("period"), "start": F.col("bucket").cast("string"), "end": F.col("window_end").cast("string")}
    return sessions.withColumn("profile_id", F.concat(F.lit("profile:"), fnv1a64(F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), v) for k, v in fields.items()]))))


def sample_ids(samples: DataFrame) -> DataFrame:
    """``samples`` with sample_id, the hash of what a sample is (F8); missing fields are empty."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "ts", "host", "pid", "uid", "container_id", "pod_uid", "container_name", "stack_id")]
    return samples.withColumn("sample_id", F.concat(F.lit("profile-sample:"), fnv1a64(F.concat_ws("|", *fields))))


def profile_warnings(samples: DataFrame, window: int = WINDOW) -> DataFrame:
    """Samples without attribution, and those beyond a session's cap with how many were dropped."""
    rows = samples.withColumn("bucket", bucket(F.col("ts"), window))
    so_far = running(rows, SESSION, ("ts", "seq"), {"_upto": ("sum", "sample_count")})
    lost = so_far.withColumn("dropped", F.least(F.col("sample_count"), F.col("_upto") - SAMPLES)).where("dropped > 0")
    bare = rows.where("container_id is null and namespace is null")
    both = lost.select(F.lit("samples_dropped").alias("warning"), "host", "pid", "stack_id", "ts", "dropped").unionByName(bare.select(F.lit("missing_attribution").alias("warning"), "host", "pid", "stack_id", "ts", F.lit(0).cast("long").alias("dropped")))
    return dedup(both, ("warning", "host", "pid", "stack_id", "ts"), ("dropped",))


def session_metric_lines(sessions: DataFrame) -> DataFrame:
    """Observed, dropped and distinct counts of each session as metric rows."""
    names = {"observed": "profile_session_samples_observed", "dropped": "profile_session_samples_dropped", "distinct_stacks": "profile_session_stacks_distinct"}
    rows = [F.struct(F.lit(n).alias("name"), F.col(c).cast("long").alias("value")) for c, n in names.items()]
    return sessions.select("host", "kind", "namespace", "pod_uid", "bucket", F.inline(F.array(*rows)))


def pprof_tables(samples: DataFrame, batch: Sequence[str], only: Sequence[str] = ("strings", "functions", "locations", "samples")) -> dict[str, DataFrame]:
    """strings, functions, locations and samples of one profile for each ``batch`` (S15), or ``only`` some of these.

    Ids are dense ranks within the batch (functions by symbol, domain and file), numbered slice by slice, so they don't depend on the order of rows. Samples with empty stacks are skipped.
    Distinct places of frames are found in one pass and stored; functions and strings are numbered from those. They are of all frames; a sample lists the first ``PPROF_FRAMES`` of its stack.
    """
    keys, function, place = list(batch), ("symbol", "domain", "file"), ("module", "module_offset", "domain", "symbol", "file", "line")

    def exploded(stack: Column) -> DataFrame:
        given = samples.where("size(frames) > 0").select(*keys, "seq", "kind", "sample_count", "period", F.posexplode(stack).alias("depth", "f"))
        text = [F.coalesce(F.col("f")[c], F.lit("")).alias(c) for c in ("module", "domain", "symbol", "file")]
        return given.select(*keys, "seq", "kind", "sample_count", "period", "depth", *text, F.coalesce("f.line", F.lit(0)).alias("line"), F.coalesce("f.module_offset", F.lit(0)).alias("module_offset"))

    places, out = stored(exploded(F.col("frames")).select(*keys, *place).distinct()), {}
    if "strings" in only:
        out["strings"] = dense_ids(places.select(*keys, F.explode(F.array("symbol", "file", "module")).alias("string")), keys, ("string",), "string_id")
    if "functions" in only:
        out["functions"] = dense_ids(places, keys, function, "function_id")
    if "locations" in only or "samples" in only:
        locations = dense_ranks(places, keys, place, "location_id", places)
    if "locations" in only:
        out["locations"] = dense_ranks(locations, keys, function, "function_id", places)
    if "samples" in only:
        stacks = exploded(F.slice("frames", 1, PPROF_FRAMES)).join(stored(locations), [*keys, *place]).groupBy(*keys, "seq", "kind", "sample_count", "period").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "location_id"))), lambda x: x["location_id"]).alias("locations"))
        out["samples"] = stacks.withColumn("value", F.col("sample_count") * F.coalesce("period", F.lit(1)))
    return {n: out[n] for n in only}


# --- symbols ----------------------------------------------------------------------------------------------------------


def as_of(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, carry: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``points`` with ``carry`` of the range of the same keys whose ``start`` is the greatest at or below ``at``; of equal starts the last by ``order``.

    Union and a running last value, slice by slice of ``at``, instead of a join by inequality: ranges of one key that all points have are no single task.
    """
    body = [F.col(c).alias(f"_r_{c}") for c in (start, *carry)]
    last = [x for c in order for x in (F.col(c).isNull().alias(f"_n_{c}"), F.col(c).alias(f"_o_{c}"))]  # nulls last
    r = ranges.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_k"), *last, F.struct(*body).alias("_range"))
    p = points.withColumns({"_at": F.col(at), "_k": F.lit(1), "_range": F.lit(None).cast(r.schema["_range"].dataType)})
    splits = split_points(p, ("_at", *[c for c in points.columns if c != at]))
    both = p.unionByName(r, allowMissingColumns=True)
    rank = ("_at", "_k", *[f"{x}_{c}" for c in order for x in ("_n", "_o")])
    out = running(both, keys, rank, {"_hit": ("last", "_range")}, splits=splits).where("_k = 1")
    return out.select(*points.columns, F.col(f"_hit._r_{start}").alias("range_start"), *[F.col(f"_hit._r_{c}").alias(c) for c in carry])


def resolve_module(samples: DataFrame, maps: DataFrame) -> DataFrame:
    """``samples`` (host, pid, ip) with module and module_offset (J11): the executable mapping that holds the address."""
    live = maps.where("path like '/%' and executable")
    found = as_of(samples, live, ("host", "pid"), "ip", "start", ("end", "file_offset", "path"))
    inside = F.col("ip") < F.col("end")
    return found.select(*samples.columns, F.when(inside, F.col("path")).alias("module"), F.when(inside, F.col("file_offset") + F.col("ip") - F.col("range_start")).alias("module_offset"))


def _by_address(frames: DataFrame, keys: Sequence[str], found: DataFrame, column: str) -> DataFrame:
    """``frames`` with ``column`` of ``found``, which has a row for each of their distinct ``keys``."""
    named = found.select(*[F.col(k).alias(f"_{k}") for k in keys], column)
    return frames.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left").select(*frames.columns, column)


def resolve_function(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """``frames`` (module, module_offset) with function (J12): the symbol of the greatest start; a size of 0 has no end.

    Distinct addresses are resolved and joined back, so a library that the whole fleet uses costs its size, not its samples.
    """
    keys = ("module", "module_offset")
    found = as_of(stored(frames.select(*keys).distinct()), symbols, keys[:1], "module_offset", "start", ("size", "name"), ("name",))
    inside = (F.col("size") == 0) | (F.col("module_offset") < F.col("range_start") + F.col("size"))
    return _by_address(frames, keys, found.withColumn("function", F.when(inside, F.col("name"))), "function")


def resolve_kernel(frames: DataFrame, kallsyms: DataFrame) -> DataFrame:
    """``frames`` (host, ip) with function (J13): a symbol ends where the next begins; the last matches only exactly; zero addresses are dropped."""
    known = kallsyms.where("address > 0").groupBy("host", "address").agg(F.max("name").alias("name"))
    ends = known.withColumn("next", F.lead("address").over(Window.partitionBy("host").orderBy("address")))
    found = as_of(stored(frames.select("host", "ip").distinct()), ends, ("host",), "ip", "address", ("next", "name"))
    inside = F.col("next").isNotNull() | (F.col("ip") == F.col("range_start"))
    return _by_address(frames, ("host", "ip"), found.withColumn("function", F.when(inside, F.col("name"))), "function")


#: Bits of an address within a page, by level: a range lies on the first level where it covers at most 2 ** 8 pages (and one more).
PAGE_BITS = (12, 20, 28, 36, 44, 52)


def resolve_jit(frames: DataFrame, perfmap: DataFrame) -> DataFrame:
    """``frames`` (host, pid, ip, ...) with function (J14). Ranges may overlap: the greatest start that holds the address, of equal starts the last line.

    Ranges are cut into pages and joined by page, so only ranges near an address are tried; large ranges have larger pages. Each distinct address looks on all levels.
    """
    bits = F.coalesce(*[F.when(F.shiftright("size", b) <= 256, F.lit(b)) for b in PAGE_BITS], F.lit(PAGE_BITS[-1]))
    levels = perfmap.where("size > 0").select("host", "pid", "start", "size", "name", "line_no", bits.alias("_bits"))
    first, last = F.expr("shiftright(start, _bits)"), F.expr("shiftright(start + size - 1, _bits)")
    r = levels.withColumn("_page", F.explode(F.sequence(first, last)))
    keys = ("host", "pid", "ip")
    f = frames.select(*keys).distinct().withColumn("_bits", F.explode(F.array(*map(F.lit, PAGE_BITS)))).withColumn("_page", F.expr("shiftright(ip, _bits)"))
    on = reduce(and_, [f[c] == r[c] for c in ("host", "pid", "_bits", "_page")]) & (f["ip"] >= r["start"]) & (f["ip"] < r["start"] + r["size"])
    hit = f.join(r, on).groupBy(*[f[c] for c in keys]).agg(F.max_by(r["name"], F.struct(r["start"], r["line_no"])).alias("function"))
    return _by_address(frames, keys, hit, "function")


def parse_maps(lines: DataFrame) -> DataFrame:
    """host, pid, start, end, executable, file_offset, path from lines of process maps."""
    pattern = r"^([0-9a-f]+)-([0-9a-f]+) (\S{4}) ([0-9a-f]+) \S+ \d+\s*(.*)$"

    def part(k: int) -> Column:
        return F.regexp_extract("line", pattern, k)

    return lines.where(F.col("line").rlike(pattern)).select("host", "pid", F.conv(part(1), 16, 10).cast("long").alias("start"), F.conv(part(2), 16, 10).cast("long").alias("end"), part(3).contains("x").alias("executable"), F.conv(part(4), 16, 10).cast("long").alias("file_offset"), part(5).alias("path"))
