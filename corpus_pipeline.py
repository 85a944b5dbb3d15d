"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

language_id    rows whose language is not recognised go
near_dedup     one document of each group of near copies stays (5-word shingles, similarity 0.8)
decontaminate  documents that hold a benchmark item go
mix            documents are left out or repeated so that the sources come to their target weights
shard          the mix is dealt to eight shards of near equal bytes
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinkwell.llm import decontam, langid, mixing, neardup, sharding
from sinkwell.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(docs.select("doc_id", "text", "lang", "source"), n_shards=8)
    return rows.select("doc_id", "lang", "source", "size", F.crc32("text").cast("long").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Nearest centroids and MinHash components are not expressible in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
