"""Structured Streaming over event files (an extension: the report layer itself has request state only).

A stream of event files is counted in tumbling windows.  Every micro-batch publishes the whole result as a new generation
(``generations.py``), so a reader in any session sees the last complete one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .generations import Generations


def windowed_counts(events: DataFrame, width: str, late: str) -> DataFrame:
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))


def run_windows(spark: SparkSession, sf_dir: str, width: str = "1 hour", late: str = "10 minutes") -> Generations:
    """Read all event files as a stream, to the end, and return the generations it published."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = Generations(spark, f"windows-{uuid.uuid4().hex}")
    query = (
        windowed_counts(stream, width, late)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{out.root}-state")
        .foreachBatch(lambda df, n: out.publish(df, n))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return out
