"""Sharding by sampled splitters, on DataFrame functions only.

Records are ordered by (hash of the text, hash of the id), so equal texts lie together.  A size-weighted sample of these keys
gives quantile boundaries of many fine ranges; the exact bytes of each range are counted, overfull ranges are sampled
again and subdivided, and neighbouring ranges are put together to shards of near equal bytes.  A group of equal texts larger than a
range has ranges of its own, cut by the hash of the id, so that slots are numbered in parts of bounded size; a shard ends
inside a group only if the group holds more than ``TOLERANCE`` of a shard's bytes, else at the nearest edge of a group.  The range of a
record is a binary search over the boundaries, so it depends on the record alone, and slots are numbered range by range: no
task holds a shard.

What reaches the driver is bounded by the parameters: the sample (about ``n_shards * ranges_per_shard * per_range`` keys) and
one row per range.

Defined cases: a null text has size 1 and a null text_crc32; rows with equal doc_id and text take neighbouring slots; an empty
table gives no rows; extra columns pass through, but for those named size, shard or slot, which it replaces.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LONG_MAX, LONG_MIN, array_of, search_by, stored, unit


#: Groups of equal texts up to this share of a shard are never cut by a shard's end.
TOLERANCE = 1 / 8
#: Columns between ``assign`` and ``number``.
HASH, ID_HASH, RANGE = "_shard_h", "_shard_d", "_shard_range"


@dataclass
class Splitters:
    """Boundaries of the fine ranges (each begins one), and for each range its shard and the rows before it in the shard."""

    bounds: list[tuple[int, int]] = field(default_factory=list)
    shard: list[int] = field(default_factory=lambda: [0])
    offset: list[int] = field(default_factory=lambda: [0])
    bytes: list[int] = field(default_factory=lambda: [0])


def record_size() -> Column:
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumns({HASH: F.xxhash64("text"), ID_HASH: F.xxhash64("doc_id")})


def range_of(bounds: list[tuple[int, int]]) -> Column:
    hs, ds = array_of([b[0] for b in bounds], "bigint"), array_of([b[1] for b in bounds], "bigint")

    def reached(i: Column) -> Column:
        h = F.element_at(hs, i)
        return (F.col(HASH) > h) | ((F.col(HASH) == h) & (F.col(ID_HASH) >= F.element_at(ds, i)))

    return search_by(len(bounds), reached)


def _quantiles(sample: list, ranges: int) -> set[tuple[int, int]]:
    """Boundaries that cut the sampled weight into ``ranges`` equal parts; a group of equal texts is cut only between its own edges."""
    sample = sorted(sample)
    total = sum(w for _, _, w in sample)
    group: dict[int, float] = {}
    for h, _, w in sample:
        group[h] = group.get(h, 0) + w
    out, seen = set(), 0.0
    for h, d, w in sample:
        if int(seen * ranges / total) != int((seen + w) * ranges / total):
            out.add((h, LONG_MIN))
            if group[h] > total / ranges:
                out |= {(h, d), (h + 1, LONG_MIN)} if h < LONG_MAX else {(h, d)}
        seen += w
    return out


def fit_splitters(docs: DataFrame, n_shards: int = 8, ranges_per_shard: int = 256, per_range: int = 32, rounds: int = 4) -> Splitters:
    keys = stored(_keys(docs.select("doc_id", "text")).select(HASH, ID_HASH, record_size().alias("size")), "shardkeys")
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return Splitters()
    ranges = n_shards * ranges_per_shard
    goal = total / ranges
    bounds: list[tuple[int, int]] = []
    within, parts = keys, ranges
    for again in range(rounds):
        weight = goal / per_range
        chosen = unit(F.xxhash64(HASH, ID_HASH, F.lit(again))) < F.col("size") / F.lit(weight)
        sample = [(r[HASH], r[ID_HASH], max(r.size, weight)) for r in within.filter(chosen).collect()]
        if again == 0:
            bounds = sorted(_quantiles(sample, parts))
        else:
            at: dict[int, list] = {}
            for x in sample:
                at.setdefault(bisect_right(bounds, x[:2]), []).append(x)
            more = set().union(*(_quantiles(x, max(2, round(sum(w for *_, w in x) / goal))) for x in at.values()), set())
            if more <= set(bounds):
                break
            bounds = sorted(more | set(bounds))
        stats = {r.part: r for r in keys.groupBy(range_of(bounds).alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        overfull = [p for p, r in stats.items() if r.bytes > 2 * goal and r.n > 1]
        if not overfull:
            break
        within = keys.filter(range_of(bounds).isin(overfull))
    sizes = [stats[p].bytes if p in stats else 0 for p in range(len(bounds) + 1)]
    counts = [stats[p].n if p in stats else 0 for p in range(len(bounds) + 1)]
    shard = shard_ends(bounds, sizes, n_shards)
    offset, rows = [], 0
    for p, s in enumerate(shard):
        rows = rows if p and s == shard[p - 1] else 0
        offset.append(rows)
        rows += counts[p]
    return Splitters(bounds, shard, offset, sizes)


def shard_ends(bounds: list[tuple[int, int]], sizes: list[int], n_shards: int) -> list[int]:
    """The shard of each range: every shard ends at the allowed boundary that is nearest to its part of the bytes."""
    total = sum(sizes)
    before = [0]
    for size in sizes:
        before.append(before[-1] + size)
    group: dict[int, int] = {}
    for (h, _), size in zip(bounds, sizes[1:], strict=True):
        group[h] = group.get(h, 0) + size
    inner = {h for h, d in bounds if d != LONG_MIN}
    free = [p for p, (h, d) in enumerate(bounds, 1) if d == LONG_MIN or h in inner and group[h] > TOLERANCE * total / n_shards]
    out, last = [0] * len(sizes), 0
    for s in range(1, n_shards):
        goal = s * total / n_shards
        last = min((p for p in free if p >= last), key=lambda p: abs(before[p] - goal), default=len(sizes))
        out[last:] = [s] * (len(sizes) - last)
    return out


def assign(docs: DataFrame, cut: Splitters) -> DataFrame:
    """``docs`` with size, shard and what ``number`` needs: a function of each row alone, no shuffle."""
    keyed = _keys(docs.drop("size", "shard", "slot")).withColumns({"size": record_size(), RANGE: range_of(cut.bounds)})
    return keyed.withColumn("shard", F.element_at(array_of(cut.shard, "int"), F.col(RANGE) + 1))


def number(assigned: DataFrame, cut: Splitters) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard; rows meet by fine range."""
    inside = W.partitionBy(RANGE).orderBy(HASH, ID_HASH, "doc_id")
    slot = F.element_at(array_of(cut.offset, "bigint"), F.col(RANGE) + 1) + F.row_number().over(inside) - 1
    return assigned.withColumn("slot", slot).drop(HASH, ID_HASH, RANGE)


def shard_documents(docs: DataFrame, n_shards: int = 8, **how) -> DataFrame:
    """``docs`` with size, shard and slot."""
    cut = fit_splitters(docs, n_shards, **how)
    return number(assign(docs, cut), cut)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, **how) -> None:
    """Write one folder per shard, rows in slot order within each file."""
    cut = fit_splitters(docs, n_shards, **how)
    rows = number(assign(docs, cut), cut)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
