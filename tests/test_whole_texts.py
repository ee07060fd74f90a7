"""Queries read texts to their ends."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalloom import plans
from signalloom.operators import profiling
from signalloom.operators.running import dense_ranks
from signalloom.plans import spans


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """Two documents of a source, of 300 and 20 words, and one of another; some words come only behind the first 256."""
    folder = tmp_path_factory.mktemp("long")
    rows = [(1, "a", " ".join([f"w{k}" for k in range(299)] + ["behind"])), (2, "a", " ".join([f"w{k}" for k in range(280, 300)])), (3, "b", "x  y " + "z " * 300 + "é")]
    duckdb.sql(f"COPY (SELECT d AS doc_id, t AS text, 'en' AS lang, s AS source, CAST(length(t) AS BIGINT) AS n_chars FROM (VALUES {', '.join(map(str, rows))}) v(d, s, t)) TO '{folder}/documents.parquet' (FORMAT parquet)")
    return str(folder)


def both(spark, folder, name):
    """Sorted rows of the query and of its SQL."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return sorted(map(tuple, plans.QUERIES[name](spark, folder).collect())), sorted(con.sql(plans.ORACLES[name]).fetchall())


def test_functions_of_whole_texts(spark, long_texts):
    got, sql = both(spark, long_texts, "s15_pprof_functions")
    assert got == sql
    assert {(s, w) for s, w, _ in got} == {("a", f"w{k}") for k in range(300)} | {("a", "behind")} | {("b", w) for w in ("", "x", "y", "z", "é")}


def test_locations_of_whole_texts(spark, long_texts):
    got, sql = both(spark, long_texts, "s15_pprof_locations")
    assert got == sql
    assert {(s, w) for s, w, *_ in got} == {("a", f"w{k}") for k in range(300)} | {("a", "behind")} | {("b", w) for w in ("", "x", "y", "z", "é")}
    functions, _ = both(spark, long_texts, "s15_pprof_functions")
    assert {(s, w, f) for s, w, _, _, f in got} == set(functions)


def test_ranks_under_a_first_column_of_one_value(spark):
    of = spark.range(3000).select((F.col("id") % 3).alias("k"), F.lit("m").alias("a"), F.concat(F.lit("é"), F.col("id") % 500).alias("b"), F.col("id").alias("c"))
    out = dense_ranks(of.withColumn("more", F.col("c") + 1), ["k"], ("a", "b"), "r", of).withColumn("d", F.dense_rank().over(Window.partitionBy("k").orderBy("a", "b")))
    assert out.where("r <> d or more <> c + 1").count() == 0 and out.count() == 3000
    out = dense_ranks(of, ["k"], ("a", "b", "c"), "r", of).withColumn("place", F.spark_partition_id())
    assert out.where("k = 0").select("place").distinct().count() > 1


def test_strings_of_whole_texts(spark, long_texts):
    got, sql = both(spark, long_texts, "s15_pprof_strings")
    assert got == sql
    assert {(s, w) for s, w, _ in got} == {("a", f"w{k}") for k in range(300)} | {("a", "behind")} | {("b", w) for w in ("x", "y", "z", "é")} | {(s, w) for s in "ab" for w in ("", "m")}


def test_samples_list_a_bounded_stack_of_the_same_locations(spark, long_texts):
    got, sql = both(spark, long_texts, "s15_pprof_samples")
    assert got == sql and [n for *_, n in got] == [256, 20, 256]
    rows = spans._frames(spark, long_texts)
    ids = {(r.source, r.location_id): r.symbol for r in profiling.pprof_tables(rows, ["source"], ["locations"])["locations"].collect()}
    for r in profiling.pprof_tables(rows, ["source"], ["samples"])["samples"].collect():
        words = rows.where(F.col("seq") == r.seq).first().frames
        assert [ids[r.source, k] for k in r.locations] == [f.symbol for f in words[:256]]
