"""All registered queries of the library against their SQL on the smallest tables."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from sinkwell.plans import core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

NAMES = sorted(core.ORACLES)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.fixture(scope="module")
def results(spark, small):
    """Columns and rows of every query; several run at a time."""

    def run(name):
        df = core.QUERIES[name](spark, small)
        columns = sorted(df.columns)
        return columns, sorted(repr([r[c] for c in columns]) for r in df.collect())

    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(run, name) for name in NAMES}


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(results, duck, name):
    columns, got = results[name].result()
    result = duck.execute(core.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([row[i] for i in at]) for row in result.fetchall())


def test_every_query_has_an_oracle_or_is_procedural():
    assert set(core.QUERIES) - set(core.ORACLES) <= {"win6_diverse", "win9_work_units", "win12_nested_sites", "grf2_bounded_slices"}
