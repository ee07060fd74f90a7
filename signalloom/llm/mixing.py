"""Mixing sources to target weights by entropy balancing.

Each document is taken 0, 1 or 2 times. Among all distributions of copies, the one
closest (in relative entropy) to the uniform one that meets a source's token
target is an exponential tilt: P(c copies) ~ exp(c * lambda * size). Its parameter
solves the convex dual of the source, by Newton steps whose gradient and
curvature are sums over the source: one aggregation for all sources a step. Rates
depend on source and size alone, so the steps run over counts of (source, size).

Rates become copies by the fractional part and a hash of the row, shifted by one
offset a source. The words taken grow with the offset one document at a time, so
three histograms of 1,024 bins each find the offset where they meet the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import documents, numbered_columns, written

#: Fixed values of the mix.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BINS, STEPS, TOLERANCE = 1024, 200, 1e-9


def _words(text: Column) -> Column:
    """Runs without white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: one row for each source.

    Weights repeat over the sources in order of code points, null last. A target is the smaller of CAP times the
    source's size and level * weight; the level shares out SHARE times all words. The
    windows below run over one row per source, not over documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, map(float, WEIGHTS))), (k + 1).cast("int"))
    full = CAP * F.col("source_size")
    # Sources by the level at which they are full: below a level, the full ones give their cap and the rest level * weight.
    by = Window.orderBy("at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    return (
        sums.withColumn("weight", weight)
        .withColumn("at", full / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum(full).over(by), F.lit(0)))
        .withColumn("open", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
        .withColumn("level", (SHARE * F.sum("source_size").over(all_) - F.col("before")) / F.col("open"))
        .withColumn("level", F.coalesce(F.max(F.when(F.col("level") <= F.col("at"), F.col("level"))).over(all_), F.lit(0.0)))
        .select("source", "source_size", F.least(full.cast("double"), F.col("level") * F.col("weight")).alias("target"))
    )


def _tilt(lam: Column, z: Column) -> tuple[Column, Column]:
    """Mean and variance of the copies at tilt ``lam * z``, without overflow."""
    t = lam * z
    top = F.greatest(F.lit(0.0), 2 * t)
    a, b, c = F.exp(-top), F.exp(t - top), F.exp(2 * t - top)
    mean = (b + 2 * c) / (a + b + c)
    return mean, (b + 4 * c) / (a + b + c) - mean * mean


def solve(sized: DataFrame) -> DataFrame:
    """One row for each source: source_size, target, mean_size, lam; ``full`` where each document is taken CAP times."""
    table = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).where("size > 0"), "mix-sizes")
    targets = source_targets(sized)
    mean = table.groupBy(F.col("source").alias("src")).agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean_size"))
    state = targets.join(mean, targets["source"].eqNullSafe(mean["src"]), "left").drop("src")
    inf = float("inf")
    state = written(
        state.withColumn("full", F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)).select("*", F.lit(0.0).alias("lam"), F.lit(-inf).alias("low"), F.lit(inf).alias("high"), F.lit(inf).alias("miss")),
        "mix-state",
    )
    table = table.withColumnRenamed("source", "src")
    for _ in range(STEPS):
        # Newton steps of all sources at once; a step that leaves the bracket is replaced by its middle.
        joined = table.join(state, F.col("src").eqNullSafe(F.col("source"))).where("not full")
        z = F.col("size") / F.col("mean_size")
        copies, spread = _tilt(F.col("lam"), z)
        words = F.col("n") * F.col("size")
        sums = joined.groupBy("src").agg(F.sum(words * copies).alias("got"), F.sum(words * z * spread).alias("slope"))
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
        stepped = F.when(F.col("slope") > 0, F.col("lam") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap / F.col("slope")))).otherwise(F.col("lam") - 2 * F.signum(gap))
        middle = F.when(F.col("low") == -inf, F.col("high") - 2).when(F.col("high") == inf, F.col("low") + 2).otherwise((F.col("low") + F.col("high")) / 2)
        moved = (
            state.join(sums, F.col("src").eqNullSafe(F.col("source")), "left")
            .withColumns({"low": low, "high": high, "stepped": stepped, "miss": F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0))})
            .withColumn("lam", F.when(F.col("got").isNull() | (F.col("miss") < TOLERANCE), F.col("lam")).when((F.col("stepped") > F.col("low")) & (F.col("stepped") < F.col("high")), F.col("stepped")).otherwise(middle))
        )
        state = written(moved.select(*state.columns), "mix-state")
        miss = state.agg(F.max("miss")).first()[0] or 0
        if miss < TOLERANCE:
            break
    else:
        raise RuntimeError(f"the tilts still miss a target by {miss} of it after {STEPS} steps")
    return state.select("source", "source_size", "target", "mean_size", "lam", "full")


def with_rate(sized: DataFrame, state: DataFrame) -> DataFrame:
    """``sized`` (source, size, key) with source_size, target, rate, full, shift and ``u``, a hash of the row in [0, 1)."""
    state = state.withColumnRenamed("source", "src")
    mean, _ = _tilt(F.col("lam"), F.col("size") / F.col("mean_size"))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(CAP)).otherwise(mean)
    u = F.shiftrightunsigned("key", 12) / float(1 << 52)
    return sized.withColumn("u", u).join(state, F.col("source").eqNullSafe(F.col("src"))).withColumn("rate", rate)


def offsets(rated: DataFrame) -> DataFrame:
    """source, shift: the shift of the hash at which a source's words meet its target best.

    At shift d a row is taken floor(rate + u + d) times, within 0 and CAP. Each round counts the words that
    enter in BINS bins of the range that is left and keeps the bin in which the target is passed.
    """
    step = written(
        rated.where("size > 0 and not full")
        .select("source", "target", "size", F.explode(F.array(*[F.lit(float(k)) - F.col("rate") - F.col("u") for k in range(1, CAP + 1)])).alias("d"))
        .groupBy("source", "target", "d").agg(F.sum("size").alias("w")),
        "mix-steps",
    )
    span = float(CAP + 2)
    state = step.groupBy(F.col("source").alias("src")).agg(F.max("target").alias("goal")).select("src", "goal", F.lit(-span / 2).alias("base"), F.lit(0.0).alias("below"))
    for k in range(3):
        width = span / BINS ** (k + 1)
        inside = step.join(state, F.col("source").eqNullSafe(F.col("src"))).where((F.col("d") > F.col("base")) & (F.col("d") <= F.col("base") + width * BINS))
        bins = inside.groupBy("src", "goal", "base", "below", F.least(F.greatest(F.ceil((F.col("d") - F.col("base")) / width), F.lit(1)), F.lit(BINS)).alias("bin")).agg(F.sum("w").alias("w"))
        upto = F.col("below") + F.sum("w").over(Window.partitionBy("src").orderBy("bin"))
        # The last bin that starts at or below the target: the target is passed inside it, or met at its end.
        state = written(
            bins.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("w")).where("from <= goal")
            .groupBy("src", "goal").agg(F.max_by(F.struct((F.col("base") + (F.col("bin") - 1) * width).alias("base"), F.col("from").cast("double").alias("below"), (F.col("base") + F.col("bin") * width).alias("end"), F.col("upto").cast("double").alias("upto")), "bin").alias("s"))
            .select("src", "goal", "s.*"),
            "mix-bins",
        )
    shift = F.when(F.abs(F.col("upto") - F.col("goal")) < F.abs(F.col("below") - F.col("goal")), F.col("end")).otherwise(F.col("base"))
    return state.select("src", shift.alias("shift"))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` and ``key``, a hash of the row."""
    key = F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1)), F.coalesce(F.col(text), F.lit("")))
    return docs.withColumns({"size": _words(F.col(text)), "key": key})


def plan(meta: DataFrame) -> DataFrame:
    """The state of each source, from source, size and key of all rows (read several times: a table)."""
    state = solve(meta)
    shifts = offsets(with_rate(meta, state))
    return written(state.join(shifts, F.col("source").eqNullSafe(F.col("src")), "left").drop("src"), "mix-plan")


def taken(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows`` (with source, size and key) with source_size, target, rate, copies and taken."""
    copies = F.least(F.greatest(F.floor(F.col("rate") + F.col("u") + F.coalesce("shift", F.lit(0.0))), F.lit(0)), F.lit(CAP))
    copies = F.when(F.col("size") == 0, 1).when(F.col("full"), CAP).otherwise(copies).cast("int")
    return with_rate(rows, state).withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))


NEW = ("size", "source_size", "target", "rate", "copies", "taken")


def _mixed(docs: DataFrame, drop: tuple[str, ...]) -> tuple[DataFrame, list]:
    """The rows of the mix with NEW, the columns of ``docs`` under names of their own, and how to call them back."""
    work, names, now = numbered_columns(docs, drop)
    rows = keyed(work, now["doc_id"], now["text"]).withColumn("source", F.col(now["source"]))
    state = plan(written(rows.select("source", "key", "size"), "mix-rows"))
    return taken(rows, state), [F.col(n).alias(c) for n, c in zip(now.values(), names, strict=True)]


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken.

    Rows without words are taken once and count nothing. A source whose target is CAP
    times its size is taken CAP times. Rows equal in doc_id and text share their copies;
    null ids and texts are hashed like values, and null sources are one source. A table without words has targets of 0. An empty table gives an
    empty one. Columns of ``docs`` with the names of the result are replaced, all others kept as they are.
    """
    rows, back = _mixed(docs, NEW)
    return rows.select(*back, *NEW)


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix (see ``mix``), each as often as it is taken, with the columns of ``docs``, whatever these are called."""
    rows, back = _mixed(docs, ())
    return rows.withColumn("copy", F.explode(F.expr("array_repeat(0, copies)"))).select(*back)


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = written(keyed(documents(spark, sf_dir)).select("doc_id", "source", "key", "size"), "mix-rows")
    return taken(meta, plan(meta)).select("doc_id", *NEW)
