"""The text form of metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_prometheus(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """name, labels, value from lines (line, line_no and ``keys``) (S8): values that aren't finite are dropped; of a repeated series the last line stays."""
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\d+)?\s*$"
    name, body, value = (F.regexp_extract("line", pattern, k) for k in (1, 2, 3))
    # pairs are found whole, so that commas and escaped quotes inside a value don't split it
    pairs = F.regexp_extract_all(body, F.lit(r'([A-Za-z_][A-Za-z0-9_]*="(?:[^"\\]|\\.)*")'), F.lit(1))

    def unescape(v):
        return F.replace(F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\x00"), F.lit("\\"))

    entries = F.array_sort(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), unescape(F.regexp_extract(p, r'(?s)^[^=]*="(.*)"$', 1)).alias("value"))))
    number = value.try_cast("double")
    rows = lines.where(~F.col("line").startswith("#") & F.col("line").rlike(pattern)).select(*keys, "line_no", name.alias("name"), entries.alias("e"), number.alias("value"))
    finite = rows.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    last = finite.groupBy(*keys, "name", "e").agg(F.max_by("value", "line_no").alias("value"))
    return last.select(*keys, "name", F.map_from_entries("e").alias("labels"), "value")


def read_prometheus_text(spark: SparkSession, path: str) -> DataFrame:
    """The series of each file of a path (S8). Lines are numbered in the order in which a file is read."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("line_no"), F.input_file_name().alias("file"))
    return parse_prometheus(lines, ("file",))
