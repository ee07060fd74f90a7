"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (tests on one machine) a temporary one is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="signalloom-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession, text_bytes: int = 0) -> int:
    """The session's shuffle partitions, or more where ``text_bytes`` would put over 64 MB of text into one."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // (1 << 26)))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def fresh(columns: Sequence[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered_columns(df: DataFrame, drop: Sequence[str] = ()) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``df`` with its columns called c0, c1, ..., so that an operator's own names can't clash; their old names in order; new name by old name in lower case."""
    names = [c for c in df.columns if c.lower() not in drop]
    new = [f"c{k}" for k in range(len(names))]
    return df.select(*[df[f"`{c}`"].alias(n) for c, n in zip(names, new, strict=True)]), names, {c.lower(): n for c, n in zip(names, new, strict=True)}


class Step(NamedTuple):
    """Columns ``fields`` from the columns ``inputs``; ``start()`` runs once in each task and returns a function from input arrays to output arrays."""

    inputs: Sequence[str]
    fields: Sequence[T.StructField]
    start: Callable[[], Callable[..., list]]


def append_columns(df: DataFrame, *steps: Step, drop: Sequence[str] = (), rows: int = 1024) -> DataFrame:
    """``df`` with the columns of ``steps``, in one pass over Arrow batches of at most ``rows`` rows.

    A step may read the columns of those before it. Columns of ``df`` named like an output
    are replaced; those in ``drop``, of either kind, are left out.
    """
    fields = {f.name: f for f in df.schema.fields}
    for step in steps:
        for f in step.fields:
            fields = {n: old for n, old in fields.items() if n.lower() != f.name.lower()} | {f.name: f}
    names = [n for n in fields if n not in drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [s.start() for s in steps]
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                columns = dict(zip(b.schema.names, b.columns, strict=True))
                for s, f in zip(steps, made, strict=True):
                    columns |= zip((x.name for x in s.fields), f(*(columns[c] for c in s.inputs)), strict=True)
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return df.mapInArrow(run, T.StructType([fields[n] for n in names]))
