"""Cut a lineage through the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_TABLES: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sinkwell-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The subfolder of this application; ``clear`` removes it."""
    return f"{shared_dir(spark)}/sinkwell-{spark.sparkContext.applicationId}"


#: Whether Spark removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run here is never run again, so its shuffle files go when it ends, not when the driver collects garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that a lost executor cannot undo.

    The table stays until it is released or the application's folder is cleared; the shuffle files of the write are removed at its end.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    with _own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _PATHS[out] = path
    return out


def _own(spark: SparkSession) -> str:
    """How the names of this application's tables begin."""
    return "sinkwell_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)


def stored_by(df: DataFrame, keys: list[str], label: str, distinct: bool = False, dealt: bool = False) -> DataFrame:
    """As ``stored``, in buckets of ``keys``: an equi join on just these keys reads this side where it lies, however often it runs.

    With ``distinct`` repeated rows are dropped where they meet in their bucket, without an exchange of their own; with
    ``dealt`` the rows lie in their buckets already (``repartition`` by the keys into the session's number of partitions).  Null keys must not occur in numbers that matter: they share a bucket.
    """
    spark = df.sparkSession
    name = f"{_own(spark)}_{label}_{uuid.uuid4().hex}"
    path = f"{run_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df if dealt else df.repartition(n, *keys)  # one file a bucket
    if distinct:
        rows = rows.distinct()
    with _own_shuffles(spark):
        rows.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
    out = spark.table(name)
    _PATHS[out], _TABLES[out] = path, name
    return out


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read any more; other DataFrames are left alone."""
    for df in tables:
        path, name = _PATHS.pop(df, None), _TABLES.pop(df, None)
        if name:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            _remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Remove all that this application stored; results that still read it must have been written before."""
    _PATHS.clear()
    _TABLES.clear()
    for t in spark.catalog.listTables(pattern=f"{_own(spark)}_*"):
        spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    _remove(spark, run_dir(spark))
