"""``python -m sinkwell --data DIR --view NAME [--out DIR] [--baseline FILE]``: print or write report views.

Exits with 1 where a baseline is given and the worst finding has become worse.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators.metrics import Report
from .plans.views import VIEWS, write_views
from .sources.files import read_baseline, regressed
from .sources.stored import clear


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sinkwell", description="Report views over the tables of a folder.")
    p.add_argument("--data", required=True, help="folder with the Parquet tables")
    p.add_argument("--view", default="findings", choices=[*VIEWS, "all"])
    p.add_argument("--max-items", type=int, default=12)
    p.add_argument("--out", help="write JSON lines here, one folder per view, instead of printing")
    p.add_argument("--baseline", help="an earlier JSON report")
    a = p.parse_args(argv)
    if a.max_items < 1:
        p.error("--max-items must be at least 1")
    return a


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        return report(spark, a)
    finally:
        spark.catalog.clearCache()
        clear(spark)


def report(spark: SparkSession, a: argparse.Namespace) -> int:
    names = list(VIEWS) if a.view == "all" else [a.view]
    if a.out:
        write_views(spark, a.data, a.out, names)
    else:
        for name in names:
            print(f"# {name}")
            VIEWS[name](spark, a.data).show(a.max_items, truncate=False)
    if a.baseline:
        row = regressed(Report(spark, a.data).ranked(), read_baseline(spark, a.baseline)).first()
        print(f"worst burden {row.current_worst:.3f}, before {row.baseline_worst:.3f}")
        return int(row.regressed)
    return 0


if __name__ == "__main__":
    sys.exit(main())
