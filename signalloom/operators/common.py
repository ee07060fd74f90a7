"""What several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .running import running

#: Bytes up to which a dimension table is marked for broadcasting, and the rows that are weighed to know; beyond, Spark plans the join by itself.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 500_000


def dimension(df: DataFrame, bound: int | None = None) -> DataFrame:
    """``df`` marked for broadcasting if it is known to be small.

    With ``bound``, rows by contract, the width of its columns decides, without a job. Otherwise at most ``BROADCAST_ROWS`` rows are weighed
    in one job; a table with more rows or bytes is left to the planner, which sees real sizes while it runs.
    """
    if bound is not None:
        wide = sum({"string": 64}.get(f.dataType.typeName(), 16) for f in df.schema.fields)
        return F.broadcast(df) if bound * wide <= BROADCAST_BYTES else df
    weight = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(weight), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where the session has none, on one machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="signalloom-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for what is read several times: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def look_up(df: DataFrame, key: str, dims: DataFrame, dim_key: str) -> DataFrame:
    """``df`` left joined with ``dims`` where ``key`` is ``dim_key``; rows without a key find nothing, and are spread by a hash instead of meeting in one task.

    The hash is of the row's place (host, ts, seq) if it has a ``seq``: a hash of every column would have all of them worked out, windows too, whoever reads them.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema if (f.name in ("host", "ts", "seq") if "seq" in df.columns else f.dataType.typeName() not in ("array", "map", "struct", "variant"))]
    # a hash on both sides and not a constant, which the optimizer would take out of the join's keys
    spread = F.when(F.col(key).isNull(), F.xxhash64(*plain)).otherwise(F.xxhash64(F.col(key).cast("string")))
    home = dims.withColumn("_home", F.xxhash64(F.col(dim_key).cast("string")))
    return df.withColumn("_spread", spread).join(home, (F.col(key) == F.col(dim_key)) & (F.col("_spread") == F.col("_home")), "left").drop("_spread", "_home")


def dedup(df: DataFrame, fingerprint: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row for each fingerprint (A19): the first by ``order`` where rows may differ in other columns."""
    if not order:
        return df.dropDuplicates(list(fingerprint))
    first = Window.partitionBy(*fingerprint).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def cap_keys(df: DataFrame, keys: Sequence[str], order: str, most: int, flag: str = "within_cap") -> DataFrame:
    """``df`` with ``flag``: whether its key is among the first ``most`` by first ``order`` (K1).

    Keys are ranked, not rows, and only ``most`` of them are joined back.
    """
    first = df.groupBy(*keys).agg(F.min(order).alias("_first")).orderBy("_first", *keys).limit(most)
    live = first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(True).alias(flag))
    on = [df[k].eqNullSafe(live[f"_k_{k}"]) for k in keys]
    return df.join(dimension(live, most), on, "left").drop(*[f"_k_{k}" for k in keys]).withColumn(flag, F.coalesce(flag, F.lit(False)))


def bounded_windows(df: DataFrame, keys: Sequence[str], end: str, most: int = 4096) -> DataFrame:
    """``df`` with ``evicted``: whether its window isn't among the latest ``most`` by ``end``, then by key (K4).

    Windows are ranked, not rows, and only ``most`` of them are joined back.
    """
    last = df.groupBy(*keys).agg(F.max(end).alias("_last")).orderBy(F.desc("_last"), *[F.desc(k) for k in keys]).limit(most)
    live = last.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.lit(True).alias("_live"))
    on = [df[k].eqNullSafe(live[f"_k_{k}"]) for k in keys]
    return df.join(dimension(live, most), on, "left").withColumn("evicted", F.col("_live").isNull()).drop("_live", *[f"_k_{k}" for k in keys])


def suppressed(flagged: DataFrame, by: Sequence[str] = (), flag: str = "within_cap") -> DataFrame:
    """How many rows a full cap refused."""
    return flagged.groupBy(*by).agg(F.count(F.when(~F.col(flag), 1)).alias("suppressed"))


def changelog(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, start: str, end: str) -> DataFrame:
    """One row for each input: the cumulative value, earliest start and latest end so far."""
    return running(df, keys, order, {"cumulative": ("sum", value), "window_start": ("min", start), "window_end": ("max", end)})


def bounds_extensions(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``extends``: 1 where ``at`` is before the first or after the last of its key so far.

    Two levels, so that a busy key isn't one task: the extremes of each slice of ``width`` arrivals (the first column of ``order``, a whole
    number) are carried into the slices behind it; rows are then read slice by slice. A slice without rows costs nothing.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(order[0]) / width))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = sliced.groupBy(*keys, "_slice").agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.min(order[0]).alias(order[0]))
    carried = ends.withColumns({"_low": F.min("_low").over(earlier), "_high": F.max("_high").over(earlier), "_row": F.lit(0)})
    both = sliced.withColumns({"_row": F.lit(1), "_low": F.col(at), "_high": F.col(at)}).unionByName(carried, allowMissingColumns=True)
    before = Window.partitionBy(*keys, "_slice").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.min("_low").over(before), F.max("_high").over(before)
    out = both.withColumn("extends", F.when(low.isNull() | (F.col(at) < low) | (F.col(at) > high), 1).otherwise(0))
    return out.where("_row = 1").select(*df.columns, "extends")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(*keys, "_s.*")


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], begin: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """The rows of each key, one after the other by ``order``, through a small state machine.

    ``begin()`` gives (feed, end) for a key: ``feed`` takes the row's columns behind the keys, in their order, and ``end`` nothing; both
    return rows of the result without the keys. Rows pass by in sorted batches, so a key costs the memory of its state, not of its rows.
    """
    rest = [c for c in df.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, feed, end = None, None, None
        for b in batches:
            out = []
            for key, row in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), zip(*(b.column(c).to_pylist() for c in rest), strict=True), strict=True):
                if key != now:
                    if end:
                        out += [(*now, *r) for r in end()]
                    now, (feed, end) = key, begin()
                out += [(*now, *r) for r in feed(*row)]
            if out:
                yield record(out)
        if end and (out := [(*now, *r) for r in end()]):
            yield record(out)

    target = df.sparkSession.createDataFrame([], schema).schema
    names, kinds = target.names, to_arrow_schema(target)

    def record(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.field(n).type) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, target)
