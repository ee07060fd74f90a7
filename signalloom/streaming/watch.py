"""A watch log applied to a table of objects, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kubernetes import pod_key


def _latest(spark: SparkSession, root: str, below: int | None = None) -> tuple[int, DataFrame] | None:
    """The last epoch that is done, below another one, and its table."""
    try:
        done = spark.read.option("recursiveFileLookup", "true").schema("epoch long").parquet(f"{root}/_done")
        last = (done if below is None else done.where(F.col("epoch") < below)).agg(F.max("epoch")).first()[0]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    return None if last is None else (last, spark.read.parquet(f"{root}/pods/epoch={last}"))


def pod_watch(root: str, relist: Callable[[], DataFrame], keep: int = 1_000_000) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that applies a watch log (seq, type, then the pods' columns) to a table of pods under ``root``.

    Each pod, by uid, or namespace and name, has the version (``seq``) of its last change, and a change with a lower one does nothing, so events may come late or twice. A deleted pod is
    remembered for ``keep`` versions, so that a late event doesn't bring it back. BOOKMARK changes nothing. At first, and where the log has an ERROR, the table is listed anew by
    ``relist``; what the log had before counts no more. Each batch writes a whole table for its epoch, from the one before it, and then marks it as done: a repeated batch gives the same.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark, log = batch.sparkSession, batch.persist()
        try:
            failed = log.where("type = 'ERROR'").agg(F.max("seq")).first()[0]
            before = _latest(spark, root, epoch)
            columns = [c for c in log.columns if c not in ("seq", "type")]
            if before is None or failed is not None:
                since = F.lit(-1 if failed is None else failed).cast("long")
                base = relist().select(since.alias("seq"), F.lit("ADDED").alias("type"), *columns)
                if before is not None:  # what came behind the error in an earlier batch
                    base = base.unionByName(before[1].where(F.col("seq") > since).select("seq", "type", *columns))
            else:
                base = before[1].select("seq", "type", *columns)
            changes = log.where(F.col("type").isin("ADDED", "MODIFIED", "DELETED") & (F.col("seq") > F.lit(-1 if failed is None else failed))).select("seq", "type", *columns)
            # of equal versions a change stands before the list
            both = base.withColumn("_n", F.lit(0)).unionByName(changes.withColumn("_n", F.lit(1)))
            newest = both.groupBy(pod_key().alias("_key")).agg(F.max_by(F.struct("seq", "type", *columns), F.struct("seq", "_n")).alias("p")).select("p.*")
            top = changes.agg(F.max("seq")).first()[0] or 0
            newest.where((F.col("type") != "DELETED") | (F.col("seq") > top - keep)).write.mode("overwrite").parquet(f"{root}/pods/epoch={epoch}")
            spark.createDataFrame([(epoch,)], "epoch long").write.mode("overwrite").parquet(f"{root}/_done/epoch={epoch}")
        finally:
            log.unpersist()

    return run


def watched_pods(spark: SparkSession, root: str) -> DataFrame:
    """The pods after the last batch that is done."""
    found = _latest(spark, root)
    if found is None:
        raise ValueError(f"no batch is done under {root}")
    return found[1].where("type <> 'DELETED'").drop("seq", "type")
