"""Dependency edges, service paths and interaction spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a64
from .common import bounds_extensions, dedup, stored
from .network import workload
from .running import running

EDGE = ("host", "workload", "container_id", "remote_address", "remote_port", "protocol")


def dependency_edges(opens: DataFrame) -> DataFrame:
    """Edges with first and last seen, and how many events extended them."""
    named = opens.withColumn("workload", workload())
    counted = bounds_extensions(named, EDGE, ("seq",), "ts")
    return counted.groupBy(*EDGE).agg(F.sum("extends").alias("observations"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def path_labels(edges: DataFrame) -> DataFrame:
    """``edges`` with source_label, destination_label and path_label.

    A source is its owner or workload, else its container, else unknown; a destination its owner, else its domain, else address:port.
    """
    source = F.coalesce("source_owner", "workload", F.concat(F.lit("container:"), F.col("container_id")), F.lit("unknown"))
    destination = F.coalesce("destination_owner", "domain", F.concat_ws(":", "remote_address", F.col("remote_port").cast("string")))
    return edges.withColumns({"source_label": source, "destination_label": destination, "path_label": F.concat(source, F.lit("->"), destination)})


PATH = ("host", "path_label", "source_label", "destination_label")


def service_paths(edges: DataFrame) -> DataFrame:
    """Paths between labels of aggregated edges (A15): the greatest cumulative count of their edges."""
    return _greatest(path_labels(edges))


def _greatest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*PATH).agg(F.max("observations").alias("observations"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def observed_paths(opens: DataFrame, answers: DataFrame) -> DataFrame:
    """Paths of connections and of DNS answers (A15). ``opens`` and ``answers`` have the columns that name a path, ``ts`` and ``seq``.

    A connection gives its edge's cumulative count, of which the greatest counts; an answer adds one unless its time is the path's last.
    Paths that only one of them feeds are aggregated. Where both do, the order counts: a connection lifts the path's count to its own, an answer adds one. What comes out is the
    greatest of the connections' counts, each with the answers behind it; so running counts of answers are enough, and a busy path is read in slices. Both tables and the paths they share are read several times, so they are stored.
    """
    named = ("source_owner", "destination_owner", "domain", "remote_address", "remote_port")

    def labelled(df: DataFrame) -> DataFrame:
        kind = {"remote_port": "int"}
        full = df.withColumns({c: F.lit(None).cast(kind.get(c, "string")) for c in named if c not in df.columns})
        kept = dict.fromkeys((*EDGE, *PATH, "ts", "seq"))
        return stored(path_labels(full.withColumn("workload", workload())).select(*[c for c in kept if c in (*full.columns, "workload", *PATH)]))

    def of(df: DataFrame, paths: DataFrame, how: str) -> DataFrame:
        return df.join(paths, df["host"].eqNullSafe(paths["_host"]) & (df["path_label"] == paths["_path"]), how)

    e, a = labelled(opens), labelled(answers.where("response_code = 'no_error' and domain is not null"))
    both = stored(e.select("host", "path_label").intersect(a.select("host", "path_label")).toDF("_host", "_path"))

    def edges(rows: DataFrame) -> DataFrame:
        return bounds_extensions(rows, (*EDGE, *PATH[1:]), ("seq",), "ts")

    spans = F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    by_edge = edges(of(e, both, "left_anti")).groupBy(*EDGE, *PATH[1:]).agg(F.sum("extends").alias("observations"), *spans)
    counted = running(of(a, both, "left_anti"), PATH, ("seq",), {"_last": ("max", "ts")}, inclusive=False)
    only_answers = counted.groupBy(*PATH).agg(F.sum(F.when(F.col("_last").isNull() | (F.col("ts") != F.col("_last")), 1).otherwise(0)).alias("observations"), *spans)
    so_far = Window.partitionBy(*EDGE, *PATH[1:]).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    updates = edges(of(e, both, "left_semi")).where("extends = 1").select("host", "path_label", "seq", F.lit(0).alias("_answer"), F.count(F.lit(1)).over(so_far).alias("_count"), F.min("ts").over(so_far).alias("_low"), F.max("ts").over(so_far).alias("_high"), *PATH[2:])
    each = of(a, both, "left_semi").select("host", "path_label", "seq", F.lit(1), F.lit(1).cast("long"), "ts", F.col("ts"), *PATH[2:])
    return _greatest(by_edge).unionByName(only_answers).unionByName(_mixed(updates.union(each)))


def _mixed(rows: DataFrame) -> DataFrame:
    """Paths of edges' cumulative counts and of answers: host, path_label, seq, _answer, _count, _low, _high and the labels, of which the first stay."""
    keys, order = ("host", "path_label"), ("seq", "_answer")
    seen = running(stored(rows), keys, order, {"_last": ("max", "_high")}, inclusive=False)
    first = F.col("_last").isNull()
    adds = F.when((F.col("_answer") == 1) & ~first & (F.col("_high") != F.col("_last")), 1).otherwise(0)
    sets = F.when((F.col("_answer") == 0) | first, F.col("_count"))
    upto = running(seen.withColumns({"_adds": adds, "_sets": sets}), keys, order, {"_upto": ("sum", "_adds")})
    labels = F.min_by(F.struct(*PATH[2:]), F.struct(*order))
    return upto.groupBy(*keys).agg(labels.alias("l"), (F.max(F.col("_sets") - F.col("_upto")) + F.sum("_adds")).alias("observations"), F.min("_low").alias("first_seen"), F.max("_high").alias("last_seen")).select("host", "path_label", "l.*", "observations", "first_seen", "last_seen")


def path_ids(paths: DataFrame) -> DataFrame:
    """``paths`` with path_id, the hash of the label."""
    return paths.withColumn("path_id", fnv1a64(F.col("path_label")))


#: What tells the ends of connections apart.
INTERACTION = ("host", "kind", "pid", "fd", "remote_address", "remote_port", "_start", "ts", "errno")


def dedup_interactions(events: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """One row for each close and failure (A19); a close without a known start begins where it ends, and its errno doesn't count."""
    failed = F.col("kind") == "failure"
    marked = events.where("kind in ('close', 'failure')").withColumns({"_start": F.when(failed, F.col("ts")).otherwise(F.coalesce("opened_at", "ts")), "_errno": F.when(failed, F.col("errno"))})
    return dedup(marked, (*INTERACTION[:-1], "_errno"), order).drop("_start", "_errno")


def interaction_spans(events: DataFrame) -> DataFrame:
    """A client span for each close and failure (D3); a failure has no duration and an error type."""
    failed = F.col("kind") == "failure"
    kept = events.where("kind in ('close', 'failure')")
    return kept.select(
        "host", "pid", "kind", "workload", "container_id", "remote_address", "remote_port",
        F.when(failed, "network.connect.failure").otherwise("network.connect").alias("name"),
        F.when(failed, F.col("ts")).otherwise(F.coalesce("opened_at", "ts")).alias("start"), F.col("ts").alias("end"),
        F.when(failed, F.lit(0).cast("long")).otherwise(F.col("ts") - F.coalesce("opened_at", "ts")).alias("duration"),
        F.when(failed, F.concat(F.lit("errno_"), F.col("errno").cast("string"))).alias("error_type"), F.lit("client").alias("role"),
    )


def interaction_warnings(events: DataFrame) -> DataFrame:
    """Spans whose container and workload are both missing, once for each peer and time."""
    missing = events.where("kind in ('close', 'failure') and container_id is null and workload is null")
    return dedup(missing.select(F.lit("missing_attribution").alias("warning"), F.col("kind").alias("source_kind"), "host", "ts", "remote_address", "remote_port"), ("warning", "source_kind", "host", "ts", "remote_address", "remote_port"))
