"""Runtime findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, is_external, is_network_tool, is_shell
from .common import dimension

#: Labels that mark workloads of the control plane.
CONTROL_KEYS, CONTROL_VALUES = ("component", "k8s-app", "app.kubernetes.io/component"), ("kube-apiserver", "kube-controller-manager", "kube-scheduler", "control-plane")


def exec_findings(execs: DataFrame) -> DataFrame:
    """A shell in a container, else a network tool."""
    name = basename(F.col("executable"), F.col("arguments"), F.col("command"))
    rule = F.when(F.col("container_id").isNotNull() & is_shell(name), "runtime.shell_in_container").when(is_network_tool(name), "runtime.network_tool_exec")
    return execs.withColumn("rule_id", rule).where("rule_id is not null").withColumn("severity", F.lit("medium"))


def network_findings(opens: DataFrame, api_endpoints: DataFrame) -> DataFrame:
    """The cluster's API reached from a workload, else an external address from a container."""
    labels = F.coalesce(F.col("labels"), F.create_map().cast("map<string,string>")) if "labels" in opens.columns else F.create_map().cast("map<string,string>")
    control = F.coalesce(F.col("namespace") == "kube-system", F.lit(False))
    for key in CONTROL_KEYS:
        control = control | F.coalesce(labels[key].isin(*CONTROL_VALUES), F.lit(False))
    ends = api_endpoints.select(F.col("address").alias("_a"), F.col("port").alias("_p"), F.lit(True).alias("_api")).distinct()
    both = opens.join(dimension(ends), (F.col("remote_address") == F.col("_a")) & (F.col("remote_port") == F.col("_p")), "left")
    rule = F.when(F.col("_api") & ~control, "network.kubernetes_api_from_workload").when(F.col("container_id").isNotNull() & is_external(F.col("remote_address")), "network.unexpected_external_connection")
    found = both.withColumn("rule_id", rule).where("rule_id is not null").drop("_a", "_p", "_api")
    return found.withColumn("severity", F.when(F.col("rule_id") == "network.kubernetes_api_from_workload", "high").otherwise("medium"))
