"""Stream forms that built-in operators express."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.peer import IDLE, admitted


def event_time(ts: Column) -> Column:
    """Nanoseconds as a timestamp, for watermarks only."""
    return F.timestamp_micros(F.floor(ts / 1000).cast("long"))


def dedup_stream(df: DataFrame, fingerprint: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """One row for each fingerprint within the watermark."""
    return df.withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(list(fingerprint))


def profile_windows(samples: DataFrame, keys: Sequence[str], width: str = "30 seconds", delay: str = "1 minute", most: int = 64, stacks: int = 64) -> DataFrame:
    """Tumbling profile sessions, appended when the watermark passes them (T3); distinct stacks are counted exactly, up to ``stacks``.

    Stacks are counted by value in a first windowed aggregation, so that a busy session's state is spread over its stacks.
    """
    rows = samples.withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", delay)
    by_stack = rows.groupBy(F.window("event_time", width), *keys, "stack_id").agg(F.sum("sample_count").alias("n"))
    return by_stack.groupBy(F.window(F.window_time("window"), width).alias("window"), *keys).agg(F.least(F.sum("n"), F.lit(most)).alias("observed"), F.greatest(F.sum("n") - most, F.lit(0)).alias("dropped"), F.least(F.count(F.lit(1)), F.lit(stacks)).alias("distinct_stacks"))


def peer_stream(flows: DataFrame, keys: Sequence[str], idle: str = "15 minutes", delay: str = "1 minute") -> DataFrame:
    """Bytes of each series between idle gaps (T6), appended when it has been idle. A flow without bytes keeps a series alive, but makes none. ``peer_cap`` bounds the series alive."""
    rows = flows.withColumn("event_time", event_time(F.col("ts"))).withWatermark("event_time", delay)
    return rows.groupBy(F.session_window("event_time", idle).alias("session"), *keys).agg(F.sum("bytes").alias("value")).where("value > 0")


def peer_cap(root: str, keys: Sequence[str], scope: Sequence[str], most: int, idle: int = IDLE) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that counts bytes of flows (keys, ts, seq, bytes) by series, at most ``most`` of a scope alive at a time (T6; see ``peer.admitted``).

    The series alive are a table for each batch (``root/live/<epoch>``), from the one before; what is added (keys, born, overflow, value) goes to ``root/bytes/epoch=<epoch>``. Both
    are overwritten when a batch is repeated, so it counts once. Batches come in order of time.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        before = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/live/{epoch - 1}") if epoch else None
        rows, alive = admitted(batch, keys, scope, most, idle, before)
        rows.groupBy(*keys, "born", "overflow").agg(F.sum("bytes").alias("value")).write.mode("overwrite").parquet(f"{root}/bytes/epoch={epoch}")
        alive.write.mode("overwrite").parquet(f"{root}/live/{epoch}")

    return run


def match_requests_stream(requests: DataFrame, responses: DataFrame, timeout: str = "30 seconds", delay: str = "1 minute") -> DataFrame:
    """Requests with their response by id, or without one once the timeout has passed.

    The join looks only at rows whose host, connection and correlation id are known, and the slower side's watermark counts: as long as one side has no such rows, nothing goes out unanswered.
    """
    a = requests.select("host", "connection", "correlation_id", "seq", event_time(F.col("ts")).alias("asked_at")).withWatermark("asked_at", delay).alias("a")
    b = responses.select("host", "connection", "correlation_id", event_time(F.col("ts")).alias("answered_at")).withWatermark("answered_at", delay).alias("b")
    on = F.expr(f"a.host = b.host and a.connection = b.connection and a.correlation_id = b.correlation_id and answered_at >= asked_at and answered_at <= asked_at + interval {timeout}")
    return a.join(b, on, "left_outer").select("a.host", "a.connection", "a.correlation_id", "a.seq", "asked_at", "answered_at")


def fan_out(sinks: dict[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives each batch to all sinks (T9): one that fails is logged and doesn't stop the others; only if all fail does the batch, so that it is tried again."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        failed = []
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, epoch)
                except Exception as e:  # noqa: BLE001
                    logging.getLogger(__name__).warning("sink %s failed on batch %s: %s", name, epoch, e)
                    failed.append(name)
        finally:
            batch.unpersist()
        if failed and len(failed) == len(sinks):
            raise RuntimeError(f"all sinks failed: {failed}")

    return run
