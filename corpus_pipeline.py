"""The corpus pipeline: language ID, exact dedup, near duplicates, mixing, tokens.

Each stage reads what its predecessor has written. All but the last return the columns of ``documents``. An empty table gives an empty one.
"""

from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import bpe, language_id, mixing, msd_dedup, ngram_join
from signalloom.llm._util import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts too) and those that no language model recognises; repeated rows go or stay alike."""
    return language_id.trusted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one stays: the longest, then the smallest doc_id (null last). Null texts count as empty."""
    return msd_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id stays; texts without words all stay."""
    return ngram_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (not at all, once or twice); those without words once."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each text, one row for each document; null texts have no tokens."""
    return bpe.digests(docs, **SIZES)


#: Pre-tokens and states that a worker keeps: less than by default, as the executors' memory has been used by the stages before.
SIZES = {"cache": 150_000, "states": 80_000}

STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("ngram_jaccard", near),
    ("entropy_mixing", mixture),
    ("byte_bpe", tokens),
]

#: Language models, components and tilted rates aren't expressed in SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
