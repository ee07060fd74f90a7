"""Comparing runs: summaries, scrape deltas, rates, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, min, mean, median, p95 by nearest rank, max, sample deviation (0 for one value) and its percentage of the mean."""
    ranked = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    # ranks of distinct values: groups of equal ones are counted before they are ordered
    upto = ranked.withColumn("_upto", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*by)))
    p95 = F.min(F.when(F.col("_upto") >= F.ceil(F.col("_n") * 0.95), F.col(value)))
    low, high = F.min(F.when(F.col("_upto") * 2 >= F.col("_n"), F.col(value))), F.min(F.when(F.col("_upto") * 2 > F.col("_n"), F.col(value)))
    order = upto.groupBy(*by).agg(p95.alias("p95"), ((low + high) / 2).alias("median"))
    plain = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"))
    on = [plain[k].eqNullSafe(order[k]) for k in by]
    out = plain.join(order, on, "left").select(*[plain[k] for k in by], "n", "min", "mean", "median", "p95", "max", "stdev")
    return out.withColumn("cv_percent", F.when(F.col("mean") != 0, F.col("stdev") / F.col("mean") * 100))


def scrape_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """name and delta of counters between two scrapes (name, labels, value) (A25): missing before is 0, a decrease gives 0, summed by name."""
    ends = after.where("name like '%\\_total' or name like '%\\_count'")
    was = before.select(F.col("name").alias("_name"), F.to_json(F.array_sort(F.map_entries("labels"))).alias("_l"), F.col("value").alias("_value"))
    both = ends.withColumn("_k", F.to_json(F.array_sort(F.map_entries("labels")))).join(was, (F.col("name") == F.col("_name")) & (F.col("_k") == F.col("_l")), "left")
    return both.groupBy("name").agg(F.sum(F.greatest(F.lit(0.0), F.col("value") - F.coalesce("_value", F.lit(0.0)))).alias("delta"))


def compare_arms(stats: DataFrame, arm: str, value: str, baseline: str) -> DataFrame:
    """Each other arm against the baseline: percent change, null where the baseline is zero."""
    base = stats.where(F.col(arm) == baseline).select(F.col(value).alias("baseline"))
    others = stats.where(F.col(arm) != baseline).select(F.col(arm), F.col(value).alias("candidate"))
    joined = others.join(F.broadcast(base.limit(1)))  # one row
    return joined.withColumn("percent_change", F.when(F.col("baseline") != 0, (F.col("candidate") - F.col("baseline")) / F.col("baseline") * 100))


def adoption_gate(throughput_percent, latency_percent, correct):
    """Whether a change is adopted: throughput up 5 % at least, latency up 2 % at most, results right."""
    return (throughput_percent >= 5) & (latency_percent <= 2) & correct


def counter_rate(df: DataFrame, keys: Sequence[str], by: Sequence[str], seconds: int, value: str = "value", ts: str = "ts") -> DataFrame:
    """Sum by ``by`` of the rate of each counter over the last ``seconds`` at each sample (A27); a reset counts the value itself. ``ts`` in seconds."""
    w = Window.partitionBy(*keys).orderBy(ts)
    was = F.lag(value).over(w)
    gain = F.when(was.isNull(), 0).when(F.col(value) < was, F.col(value)).otherwise(F.col(value) - was)
    over = Window.partitionBy(*keys).orderBy(ts).rangeBetween(-seconds, 0)
    rates = df.withColumn("_gain", gain).withColumn("_first", F.min_by("_gain", ts).over(over)).withColumn("rate", (F.sum("_gain").over(over) - F.col("_first")) / seconds)
    return rates.groupBy(*by, ts).agg(F.sum("rate").alias("rate"))


def first_signal_latency(signals: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """For each start the first matching signal at or after it, in milliseconds, and how many match."""
    s = starts.select(F.col(key).alias("_key"), F.col("start").alias("start"))
    hit = s.join(signals.select(F.col(key).alias("_k2"), "ts"), (F.col("_key") == F.col("_k2")) & (F.col("ts") >= F.col("start")), "left")
    return hit.groupBy(F.col("_key").alias(key), "start").agg(((F.min("ts") - F.col("start")) / 1e6).alias("latency_ms"), F.count("ts").alias("matches"))


def signal_accounting(workload: DataFrame, deltas: DataFrame) -> DataFrame:
    """Operations a workload made against signals that came out (A29): family, expected, emitted, missing."""
    want = workload.groupBy("family").agg(F.sum("successes").alias("expected"))
    got = deltas.groupBy("family").agg(F.sum("delta").alias("emitted"))
    return want.join(got, "family", "left").withColumn("emitted", F.coalesce("emitted", F.lit(0))).withColumn("missing", F.greatest(F.col("expected") - F.col("emitted"), F.lit(0)))


def profile_mode_rollup(samples: DataFrame) -> DataFrame:
    """By sampling mode: samples, summed weights and weights that aren't numbers."""
    attributes = F.map_from_entries(F.array_distinct("attributes"))
    weight = attributes["profiling.sample.weight"]
    number = F.when(weight.rlike("^[0-9]+$"), weight.cast("long"))
    named = samples.select(F.coalesce(attributes["profiling.sample.mode"], F.lit("unknown")).alias("mode"), "sample_count", weight.alias("_w"), number.alias("_n"))
    return named.groupBy("mode").agg(F.sum("sample_count").alias("samples"), F.coalesce(F.sum("_n"), F.lit(0)).alias("weight"), F.count(F.when(F.col("_w").isNotNull() & F.col("_n").isNull(), 1)).alias("malformed"))


def histogram_percentile(buckets: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """The smallest bound whose cumulative count reaches the rank, else the greatest (A31); not interpolated."""
    sums = buckets.groupBy(*by, "bound").agg(F.sum("count").alias("count"))
    w = Window.partitionBy(*by).orderBy("bound").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.withColumns({"_upto": F.sum("count").over(w), "_all": F.sum("count").over(Window.partitionBy(*by))})
    return run.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * q), F.col("bound"))), F.max("bound")).alias("percentile"))


def pod_totals(samples: DataFrame, by: Sequence[str], sample: str, value: str) -> DataFrame:
    """Totals of the pods within each sample, summarised over samples."""
    return summary_stats(samples.groupBy(*by, sample).agg(F.sum(value).alias("total")), by, "total")


def contract_drift(runs: DataFrame, by: Sequence[str], contract: Sequence[str]) -> DataFrame:
    """How many contracts the runs of a group have (A33): one unless they drifted."""
    return runs.groupBy(*by).agg(F.count_distinct(F.to_json(F.struct(*contract))).alias("contracts")).withColumn("drifted", F.col("contracts") > 1)
