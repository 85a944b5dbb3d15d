"""Relations laid out by the file that produces them, read only as far as the asked elements need.

    <path>/file_group=<n>/...   relations of the files whose hash falls into the group, sorted by file

An element's relations come from few files, which its facts name (`relation_files`).  Their groups become a partition filter, so other groups are never
listed; inside a group rows are sorted by file, so the statistics of the Parquet row groups skip the other files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of elements at a request boundary: each may be linked from any file that holds one of them.  Fixed values.
HTTP_KINDS = ("fetch-input", "resource-input", "resource-result", "http-response")


def relation_files(elements: DataFrame, asked: DataFrame) -> DataFrame:
    """GRF-23: id and file, for every asked id the files that can emit relations of it.

    These are the files of the element, of its owner and of its definition, all files that hold the symbol of one of the three, and for an element at a
    request boundary all files with such elements.  ``elements`` has id, file, kind, symbol, owner_id and definition_id; asked ids that are no
    element have no file.
    """
    facts = elements.select("id", "file", "kind", "symbol", "owner_id", "definition_id")
    own = asked.select("id").filter("id is not null").distinct().join(facts, "id")
    named = [own.select("id", F.col("file"), F.col("symbol"))]
    for other in ("owner_id", "definition_id"):
        there = facts.select(F.col("id").alias("_there"), "file", "symbol")
        named.append(own.select("id", other).join(there, F.col(other) == F.col("_there")).select("id", "file", "symbol"))
    named = reduce(DataFrame.union, named)
    holders = elements.select(F.col("symbol").alias("_symbol"), F.col("file").alias("_file")).filter("_symbol is not null").distinct()
    by_symbol = named.select("id", "symbol").filter("symbol is not null").distinct().join(holders, F.col("symbol") == F.col("_symbol")).select("id", F.col("_file").alias("file"))
    edge = facts.filter(F.col("kind").isin(*HTTP_KINDS)).select(F.col("kind").alias("_kind"), F.col("file").alias("_file")).distinct()
    met = own.filter(F.col("kind").isin(*HTTP_KINDS)).select("id", F.explode(F.array(*map(F.lit, HTTP_KINDS))).alias("kind"))
    at_edge = met.join(edge, F.col("kind") == F.col("_kind")).select("id", F.col("_file").alias("file"))
    return named.select("id", "file").union(by_symbol).union(at_edge).filter("file is not null").distinct()


class RelationStore:
    """UDF-3: the relations under ``path``; written once, asked by element."""

    def __init__(self, spark: SparkSession, path: str, groups: int = 64):
        self.spark, self.path, self.groups = spark, path.rstrip("/"), groups

    def _group(self, file: str):
        return F.pmod(F.xxhash64(file), F.lit(self.groups)).cast("int")

    def write(self, relations: DataFrame) -> None:
        """``relations`` has id, src, dst, kind, status and producer_file."""
        rows = relations.withColumn("file_group", self._group("producer_file"))
        rows.repartition(self.groups, "file_group").sortWithinPartitions("file_group", "producer_file").write.mode("overwrite").partitionBy("file_group").parquet(self.path)

    def read(self, groups: list[int] | None = None) -> DataFrame:
        """All relations, or those of some groups, as a filter on the partition."""
        rows = self.spark.read.parquet(self.path)
        return rows if groups is None else rows.filter(F.col("file_group").isin(*groups)) if groups else rows.filter(F.lit(False))

    def relations_of(self, elements: DataFrame, asked: DataFrame, direction: str = "both") -> DataFrame:
        """id of the asked element and the columns of its relations, from the files that can emit them.

        The groups of these files are all that the driver sees, at most ``groups`` numbers.
        """
        files = relation_files(elements, asked)
        groups = [r[0] for r in files.select(self._group("file")).distinct().collect()]
        rows = self.read(groups).drop("file_group").withColumnRenamed("id", "relation")
        near = rows.join(files.select(F.col("id").alias("_asked"), F.col("file").alias("_file")), F.col("producer_file") == F.col("_file"))
        touches = {"forward": F.col("src") == F.col("_asked"), "backward": F.col("dst") == F.col("_asked")}
        touches["both"] = touches["forward"] | touches["backward"]
        return near.filter(touches[direction]).drop("_file").withColumnRenamed("_asked", "id")
