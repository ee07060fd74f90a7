"""DNS: queries, answers, latencies, domain edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import saturating_sum
from ..functions.text import normalize_domain
from .common import cap_keys
from .network import workload
from .running import running

OWNER = ("host", "workload", "container_id", "domain", "query_type")
#: Fingerprints of DNS events, and the domains kept as labels.
FINGERPRINT = ("kind", "host", "pid", "query_name", "query_type", "transaction_id", "response_code", "ts")
MAX_DOMAINS = 1024


def labelled(df: DataFrame, most: int = MAX_DOMAINS) -> DataFrame:
    """``df`` with workload and domain: valid names, null beyond the first ``most`` domains; rows still count (K2)."""
    named = df.withColumns({"workload": workload(), "domain": normalize_domain(F.col("query_name"))})
    return cap_keys(named, ["domain"], "ts", most).withColumn("domain", F.when(F.col("within_cap"), F.col("domain"))).drop("within_cap")


def query_counts(queries: DataFrame) -> DataFrame:
    """Queries by domain, type and server (A10)."""
    return queries.groupBy(*OWNER, "server_address", "server_port").agg(F.count(F.lit(1)).alias("value"), F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))


def response_counts(responses: DataFrame) -> DataFrame:
    """Answers by domain, type, server and code."""
    return responses.groupBy(*OWNER, "server_address", "server_port", "response_code").agg(F.count(F.lit(1)).alias("value"), F.min("ts").alias("window_start"), F.max("ts").alias("window_end"))


def lookup_durations(responses: DataFrame) -> DataFrame:
    """Latency summary by domain, type and code (A12); the window starts at the first arrival."""
    timed = responses.where("latency is not null")
    return timed.groupBy(*OWNER, "response_code").agg(
        F.count(F.lit(1)).alias("count"), saturating_sum(F.col("latency")).alias("sum"), F.min("latency").alias("min"), F.max("latency").alias("max"), F.min_by("ts", "seq").alias("window_start"), F.max("ts").alias("window_end")
    )


def domain_edges(responses: DataFrame) -> DataFrame:
    """Workload -> domain edges of successful answers (A13); an answer with the time of the last one isn't counted again."""
    keys = ("host", "workload", "container_id", "domain")
    good = responses.where("response_code = 'no_error' and domain is not null")
    counted = running(good, keys, ("seq",), {"_last": ("max", "ts")}, inclusive=False).withColumn("_n", F.when(F.col("_last").isNull() | (F.col("ts") != F.col("_last")), 1).otherwise(0))
    return counted.groupBy(*keys).agg(F.sum("_n").alias("observations"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
