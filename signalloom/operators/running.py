"""Running values, sessions and ranks in two levels, so that a busy key isn't one task.

Rows are cut into slices by their order; split points come from a bounded sample of the order itself. What each slice of a key adds up to is carried into
the slices behind it, a row for each key and slice; the rows are then read slice by slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most slices, and rows sampled for each split point.
SLICES, PER_SLICE = 256, 64

_TOTAL = {"sum": F.sum, "min": F.min, "max": F.max}


def split_points(df: DataFrame, order: Sequence[str], slices: int | None = None) -> list:
    """Values of the first column of ``order`` that cut ``df`` into about equal slices (as many as shuffle partitions): those of the rows with the smallest hashes."""
    n = min(SLICES, slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = order[0]
    some = df.where(F.col(first).isNotNull()).select(F.col(first).alias("v"), F.xxhash64(*order).alias("h")).orderBy("h", "v").limit(PER_SLICE * n).collect()
    values = sorted(r["v"] for r in some)
    return sorted({values[len(values) * k // n] for k in range(1, n)}) if values else []


def slice_of(value: Column, splits: Sequence) -> Column:
    """The number of split points at or below ``value``, as a tree of comparisons; 0 for null, which sorts first."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(splits[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(value.isNull(), 0).otherwise(tree(0, len(splits)))


def _sliced(df: DataFrame, order: Sequence[str], splits: Sequence | None) -> DataFrame:
    return df.withColumn("_slice", slice_of(F.col(order[0]), split_points(df, order) if splits is None else splits))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, str | Column]], inclusive: bool = True, splits: Sequence | None = None) -> DataFrame:
    """``df`` with columns of the rows of the same key so far, the row itself included or not.

    ``values``: name -> (``sum``, ``min``, ``max`` or ``last``, column). Nulls don't count; without any value the result is null. Null keys are a key. Rows of one
    value of ``order[0]`` lie in one slice.
    """
    source = {n: F.col(c) if isinstance(c, str) else c for n, (_, c) in values.items()}
    rows = _sliced(df.withColumns({f"_v_{n}": c for n, c in source.items()}), order, splits)

    def total(name: str, kind: str) -> Column:
        v = F.col(f"_v_{name}")
        return F.max_by(v, F.when(v.isNotNull(), F.struct(*order))) if kind == "last" else _TOTAL[kind](v)

    def over(name: str, kind: str, w) -> Column:
        v = F.col(f"_v_{name}")
        return F.last(v, ignorenulls=True).over(w) if kind == "last" else _TOTAL[kind](v).over(w)

    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_slice").agg(*[total(n, k).alias(f"_v_{n}") for n, (k, _) in values.items()])
    carried = ends.select(*keys, "_slice", F.lit(0).alias("_row"), *[over(n, k, earlier).alias(f"_v_{n}") for n, (k, _) in values.items()])
    both = rows.withColumn("_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_row", *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = both.withColumns({f"_o_{n}": over(n, k, w) for n, (k, _) in values.items()}).where("_row = 1")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in values]
    return out.select(*kept, *[F.col(f"_o_{n}").alias(n) for n in values])


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], at: str, gap: int, name: str = "session", total: str | None = None, splits: Sequence | None = None) -> DataFrame:
    """``df`` with ``name``, from 1: it rises where ``at`` is at least ``gap`` above the greatest ``at`` of the key so far, and at the first one.

    Rows without ``at`` belong to the session they fall into (0 before the first). ``total`` names a column for the last number of the key.
    """
    rows = _sliced(df.withColumn("_at", F.col(at)), order, splits)
    here = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_new", F.when(F.col("_at") - F.max("_at").over(here) >= gap, 1).otherwise(0))
    ends = marked.groupBy(*keys, "_slice").agg(F.min_by("_at", F.when(F.col("_at").isNotNull(), F.struct(*order))).alias("_low"), F.max("_at").alias("_high"), F.sum("_new").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.withColumn("_was", F.max("_high").over(earlier))
    fresh = F.when(F.col("_low").isNull(), 0).when(F.col("_was").isNull() | (F.col("_low") - F.col("_was") >= gap), 1).otherwise(0)
    all_of = F.sum("_n").over(Window.partitionBy(*keys))
    carried = before.withColumn("_n", F.col("_n") + fresh).select(*keys, "_slice", F.lit(0).alias("_row"), F.col("_was").alias("_at"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_new"), all_of.alias("_all"))
    both = rows.withColumn("_row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_row", *order)
    last = F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("_row") == 0, F.col("_new")).when(F.col("_at").isNull(), 0).when(last.isNull() | (F.col("_at") - last >= gap), 1).otherwise(0)
    out = both.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if total:
        out = out.withColumn(total, F.first("_all", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    new_names = [name, total] if total else [name]
    return out.where("_row = 1").select(*[c for c in df.columns if c not in new_names], *new_names)


def dense_ids(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """The distinct (keys, columns) of ``df`` with ``name``, from 1 in each key by ``columns``."""
    distinct = df.select(*keys, *columns).distinct()
    sliced = distinct.withColumn("_slice", slice_of(F.col(columns[0]), split_points(distinct, columns)))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    carried = sizes.select(*keys, "_slice", F.lit(0).alias("_row"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    both = sliced.withColumns({"_row": F.lit(1), "_n": F.lit(1).cast("long")}).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_row", *columns).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum("_n").over(w)).where("_row = 1").select(*keys, *columns, name)


def dense_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str, of: DataFrame) -> DataFrame:
    """``df`` with ``name``, the dense rank of its ``columns`` from 1 in each key. ``of`` has the distinct rows whose columns ``df`` carries, and is cheap to read.

    Slices are cut by all ``columns``, so a first column of one value is no single task.
    """
    n = min(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    some = of.select(F.struct(*columns).alias("v"), F.xxhash64(*of.columns).alias("h")).orderBy("h", "v").limit(PER_SLICE * n).collect()
    values = sorted((r["v"] for r in some), key=lambda v: [(x is not None, x) for x in v])
    types = {c: of.schema[c].dataType for c in columns}
    splits = [F.struct(*[F.lit(x).cast(types[c]).alias(c) for c, x in zip(columns, v)]) for v in dict.fromkeys(values[len(values) * k // n] for k in range(1, n) if values)]
    place = slice_of(F.struct(*columns), splits)
    distinct = of if set(of.columns) == {*keys, *columns} else of.select(*keys, *columns).distinct()
    sizes = distinct.withColumn("_slice", place).groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sizes.select(*keys, "_slice", F.lit(0).alias("_row"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n"))
    both = df.withColumns({"_slice": place, "_row": F.lit(1)}).unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_row", *columns)
    rank = F.first("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.dense_rank().over(w) - 1  # the carried row has rank 1
    return both.withColumn(name, rank).where("_row = 1").select(*df.columns, name)
