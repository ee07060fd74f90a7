"""Signal envelopes as JSON lines: schema_version, kind, source, host, payload."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.bounds import redact_argv
from .kinds import KINDS, PARTS, WORDS, Field, fields_of, schema, sql_type

VERSION = 1
#: Tables of a batch that are written at the same time.
WRITERS = 8
#: Kinds that the topology form keeps.
TOPOLOGY = ("network_flow_summary", "network_flow_warning", "dependency_edge", "service_interaction_span_observation", "trace_service_path_observation", "trace_correlation_warning")
#: What a value's own type begins with, by the type of its field.
_FORMS = {"long": "BIGINT|DECIMAL", "int": "BIGINT|DECIMAL", "double": "BIGINT|DECIMAL|DOUBLE", "boolean": "BOOLEAN", "strings": "ARRAY", "map": "OBJECT", "attributes": "ARRAY", "frames": "ARRAY"}


def _fits(path: str, typed: Column, field: Field) -> Column:
    """Whether the payload's value at a path is of its field's type, and the fields within too."""
    own = F.coalesce(F.schema_of_variant(F.try_variant_get("payload", path, "variant")), F.lit("VOID"))
    if field.kind in PARTS:
        good = own.startswith("OBJECT")
        for f in fields_of(PARTS[field.kind]):
            good = good & _fits(f"{path}.{f.name}", typed[f.name], f)
    else:
        good = own.rlike(f"^({_FORMS.get(field.kind, 'STRING')})") & typed.isNotNull()
        if field.kind in WORDS:
            good = good & typed.isin(*WORDS[field.kind].split())
        if field.kind in ("attributes", "frames"):
            needed = [f.name for f in fields_of(PARTS[field.kind[:-1]]) if f.needed]
            good = good & F.forall(typed, lambda x: x.isNotNull() & ~F.greatest(F.lit(False), *[x[n].isNull() for n in needed], F.lit(False)))
    return F.when(own == "VOID", F.lit(not field.needed)).otherwise(F.coalesce(good, F.lit(False)))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (``value``) with the envelope's fields, the payload as a variant, and ``reason`` for what is no envelope of this version and a known kind (S1). The JSON is parsed once."""
    v = lines.withColumn("v", F.try_parse_json("value"))
    text = {n: F.try_variant_get("v", f"$.{n}", "string") for n in ("kind", "source", "host")}
    out = v.select("value", F.try_variant_get("v", "$.schema_version", "int").alias("schema_version"), *[c.alias(n) for n, c in text.items()], F.try_variant_get("v", "$.payload", "variant").alias("payload"))
    reason = (
        F.when(F.col("kind").isNull() | F.col("source").isNull() | F.col("payload").isNull(), "not_an_envelope")
        .when(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "schema_version")
        .when(~F.col("kind").isin(*KINDS), "unknown_kind")
    )
    return out.withColumn("reason", reason)


def _typed(mine: DataFrame, kind: str) -> DataFrame:
    """Parsed lines of one kind with ``p``, the typed payload, and ``ok``, whether it fits."""
    fields = fields_of(KINDS[kind])
    typed = F.try_variant_get("payload", "$", f"STRUCT<{', '.join(f'{f.name}: {sql_type(f.kind)}' for f in fields)}>")
    rows = mine.withColumn("p", typed)
    ok = F.col("p").isNotNull()
    for f in fields:
        ok = ok & _fits(f"$.{f.name}", F.col(f"p.{f.name}"), f)
    return rows.withColumn("ok", ok)


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return (spark.readStream if streaming else spark.read).text(path).select("value")


def _envelope(kind: str) -> list[str]:
    """What a kind's table has beside its payload; a payload's own ``source`` is kept instead of the envelope's."""
    return [c for c in ("source", "host") if c not in (f.name for f in fields_of(KINDS[kind]))]


def _of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return _typed(rows.where("reason is null").where(F.col("kind") == kind), kind)


def _misfits(typed: DataFrame) -> DataFrame:
    return typed.where("not ok").select(F.col("value").alias("line"), F.lit("payload").alias("reason"))


def read_signals(spark: SparkSession, path: str, kinds: Sequence[str] | None = None, streaming: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """One DataFrame for each kind (all by default), and a quarantine of lines that don't fit.

    A line is quarantined with its reason if it isn't an envelope, has another version or an unknown kind, or its payload isn't of its kind: a field that must be there is missing, or one has
    another type or a word that isn't known. Other fields are ignored. Where a payload has a field ``source``, this one is kept.
    """
    rows = parsed(read_lines(spark, path, streaming))
    tables, bad = {}, rows.where("reason is not null").select(F.col("value").alias("line"), "reason")
    for kind in kinds or KINDS:
        typed = _of_kind(rows, kind)
        tables[kind] = typed.where("ok").select(*_envelope(kind), "p.*")
        bad = bad.unionByName(_misfits(typed))
    return tables, bad


def dispatch(root: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that deals lines (``value``) to a table for each kind and a quarantine under ``root``.

    Each batch is parsed once and its kinds are written to ``<kind>/epoch=<epoch>``, WRITERS at a time, replacing what an attempt before has left there; then the epoch is marked as done.
    ``dispatched`` reads what is done only, so a batch that fails half-way or is repeated counts once. Misfits of a kind are counted while it is written, and looked for only where there are some.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = parsed(batch).persist()

        def write(kind: str) -> DataFrame | None:
            seen, typed = Observation(), _of_kind(rows, kind)
            typed.observe(seen, F.count_if(~F.col("ok")).alias("misfits")).where("ok").select(*_envelope(kind), "p.*").write.mode("overwrite").parquet(f"{root}/{kind}/epoch={epoch}")
            return _misfits(typed) if seen.get["misfits"] else None

        try:
            present = sorted(r[0] for r in rows.where("reason is null").select("kind").distinct().collect())  # at most the known kinds
            bad = rows.where("reason is not null").select(F.col("value").alias("line"), "reason")
            with ThreadPoolExecutor(WRITERS) as pool:
                for misfits in pool.map(write, present):
                    bad = bad.unionByName(misfits) if misfits else bad
            bad.write.mode("overwrite").parquet(f"{root}/_quarantine/epoch={epoch}")
            spark.createDataFrame([(epoch, [*present, "_quarantine"])], "epoch long, tables array<string>").write.mode("overwrite").parquet(f"{root}/_done/epoch={epoch}")
        finally:
            rows.unpersist()

    return run


def dispatched(spark: SparkSession, root: str, table: str) -> DataFrame:
    """What ``dispatch`` has written to the table of a kind, or ``_quarantine``, in the batches that are done."""
    done = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/_done").where(F.array_contains("tables", table)).select("epoch").distinct().collect()
    shape = "line string, reason string" if table == "_quarantine" else schema(table)
    if table != "_quarantine":
        shape = ", ".join([*[f"{c} string" for c in _envelope(table)], shape])
    paths = [f"{root}/{table}/epoch={r[0]}" for r in done]
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)


def signal_lines(df: DataFrame, kind: str, source: str) -> DataFrame:
    """kind and line: one JSON envelope for each row of a payload table (columns host and the payload's) (S2). Arguments are redacted."""
    body = df.withColumn("arguments", redact_argv(F.col("arguments"))) if "arguments" in df.columns else df
    own = {f.name for f in fields_of(KINDS[kind])} if kind in KINDS else set()
    payload = F.struct(*[c for c in body.columns if c != "host" and (c != "source" or c in own)])
    host = F.col("host") if "host" in df.columns else F.lit(None).cast("string")
    return body.select(F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit(VERSION).alias("schema_version"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), host.alias("host"), payload.alias("payload"))).alias("line"))


def write_signals(lines: DataFrame, path: str, mode: str = "all") -> None:
    """Writes ``signal_lines`` partitioned by kind; ``topology`` keeps six kinds."""
    kept = lines.where(F.col("kind").isin(*TOPOLOGY)) if mode == "topology" else lines
    kept.write.partitionBy("kind").text(path)
