"""The corpus pipeline: stages that each read what the one before has kept.

quality drops what the classifier rejects, simhash keeps the first document of each group of near
duplicates, decontaminate drops documents that hold benchmark items, mix repeats or drops
documents towards the target weights, and tokens writes what is left as Simple-8b token ids and
reads their digest back.

Every stage takes null ids, null and empty texts, repeated rows, empty tables and columns of any
further names: of repeated rows one stays, null texts score, count and encode as
empty ones, and columns that a stage has no use for stay as they are until the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waveloom.llm import decontam, mixing, quality, simhash, tokens
from waveloom.llm.common import written

#: Words such as XXH64 shingles and a fitted classifier have no SQL.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_groups(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emitted(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), special=True)


STAGES = [
    ("quality", quality_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
