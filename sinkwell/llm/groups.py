"""Streaming over sorted groups inside ``mapInArrow``."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle


def ship(name: str) -> None:
    """Pickle the functions of a module by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of rows that agree in the first ``n_keys`` columns; the rows must arrive sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
        start = 0
        for i, key in enumerate(keys):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


ship(__name__)
