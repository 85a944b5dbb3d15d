"""Helpers shared by the operators of this package."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.stored import release, stored  # noqa: F401  (the operators take these from here)
from ..sources.tables import table  # noqa: F401

#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
#: Java regular expression of one word under that white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of one Arrow batch; with texts of 100 kB such a batch stays near 25 MB.
BATCH_ROWS = 256
LONG_MIN = -(2**63)
LONG_MAX = 2**63 - 1


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def unit(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1; keeps the order of the hashes."""
    return h.cast("double") / F.lit(2.0**64) + F.lit(0.5)


def array_of(values: list, kind: str) -> Column:
    """An array literal that costs one call to the JVM, whatever its length; Catalyst folds it."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def search(bounds: list, key: Column, kind: str = "double") -> Column:
    """How many of the ascending ``bounds`` are <= key, by binary search over an array literal."""
    at = array_of(bounds, kind)
    return search_by(len(bounds), lambda i: F.element_at(at, i) <= key)


def search_by(n: int, reached) -> Column:
    """Binary search in an expression: the number of leading positions 1..n for which ``reached(position)`` holds."""
    if n == 0:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(n.bit_length()))]
    return F.aggregate(
        array_of(steps, "int"),
        F.lit(0),
        lambda found, step: F.when((found + step <= n) & reached(F.least(found + step, F.lit(n))), found + step).otherwise(found),
    )


#: Buckets that one window task of a running total adds up.
FANOUT = 1000


def running_total(df: DataFrame, group: str, bucket: str, order: list, weight: Column, name: str) -> DataFrame:
    """Add the sum of ``weight`` over the rows of the group that come before, in three levels.

    ``bucket`` must rise with ``order`` within a group.  Sums per (group, bucket) are added up over bundles of ``FANOUT``
    buckets, then over the buckets of a bundle, then rows within their bucket: a task holds a bucket, a bundle, or one row
    for each bundle of a group.
    """
    before, total, bundle, own = (f"_{x}_of_{name}" for x in ("before", "total", "bundle", "weight"))
    rows = df.withColumn(own, weight)
    past = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(group, bucket).agg(F.sum(own).alias(total)).withColumn(bundle, F.floor(F.col(bucket) / FANOUT))
    tops = sums.groupBy(group, bundle).agg(F.sum(total).alias(total))
    tops = tops.select(group, bundle, F.coalesce(F.sum(total).over(past(W.partitionBy(group).orderBy(bundle))), F.lit(0)).alias(before))
    inner = F.coalesce(F.sum(total).over(past(W.partitionBy(group, bundle).orderBy(bucket))), F.lit(0))
    offsets = sums.join(tops, [group, bundle]).select(group, bucket, (F.col(before) + inner).alias(before))
    within = F.coalesce(F.sum(own).over(past(W.partitionBy(group, bucket).orderBy(*order))), F.lit(0))
    return rows.join(offsets, [group, bucket]).withColumn(name, F.col(before) + within).drop(own, before)
