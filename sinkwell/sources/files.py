"""Source files, baselines and policies as DataFrames (SRC-1, SRC-2, SRC-5, SRC-9, SRC-11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a source file may end with, and folders that hold no sources.  Fixed values.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".js", ".cjs")
IGNORED = ("node_modules", "dist", "build", ".solid", ".vinxi", ".output", "coverage", "styled-system")

BASELINE = """analysisVersion int, generatedAt string, view string,
    sinks array<struct<id:string,file:string,line:int,label:string,signature:string,scores:struct<burden:double>>>"""
POLICY = "version int, exclude array<string>, include array<string>"


def is_source(path: Column, tests: bool = False) -> Column:
    """SRC-2: right extension, no declaration file, outside ignored folders, no test unless asked for."""
    def one_of(names: tuple[str, ...]) -> str:
        return "(" + "|".join(n.replace(".", r"\.") for n in dict.fromkeys(names)) + ")"

    keep = path.rlike(one_of(EXTENSIONS) + "$") & ~path.rlike(r"\.d\.ts$")
    keep = keep & ~path.rlike("(^|/)" + one_of(IGNORED) + "(/|$)")
    return keep if tests else keep & ~path.rlike(r"\.(test|spec)\.[cm]?[jt]sx?$")


def read_sources(spark: SparkSession, root: str, tests: bool = False) -> DataFrame:
    """path (below root) and text of every source file; one row per file, so the work is split by file."""
    rows = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/")
    below = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.char_length(path))
    return rows.select(below.alias("path"), F.col("value").alias("text")).filter(is_source(F.col("path"), tests))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """SRC-9: the sinks of a JSON report, in their order; a file that is no report fails."""
    rows = spark.read.schema(BASELINE).option("mode", "FAILFAST").json(path, multiLine=True)
    return rows.select(F.posexplode("sinks").alias("seq", "s")).select("seq", "s.file", "s.line", "s.label", "s.signature", F.col("s.scores.burden").alias("burden"))


def regressed(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row: the worst burdens and whether the current one is larger (missing ones count as 0)."""
    now = current.agg(F.coalesce(F.max("burden"), F.lit(0.0)).alias("current_worst"))
    before = baseline.filter("seq = 0").agg(F.coalesce(F.max("burden"), F.lit(0.0))).scalar()
    return now.withColumn("baseline_worst", before).withColumn("regressed", F.col("current_worst") > F.col("baseline_worst"))


def read_policy(spark: SparkSession, text: str) -> tuple[list[str], list[str]]:
    """SRC-11: exclusions and inclusions of a policy; anything but the known fields in the known types fails."""
    known = {"version", "exclude", "include"}
    row = spark.range(1).select(F.from_json(F.lit(text), POLICY, {"mode": "FAILFAST"}).alias("p"), F.json_object_keys(F.lit(text)).alias("k")).first()
    if row.p is None or set(row.k or ()) - known or row.p.version != 1:
        raise ValueError("a policy has version 1, exclude and include, and nothing else")
    return row.p.exclude or [], row.p["include"] or []
