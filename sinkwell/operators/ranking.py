"""Rankings and selections."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.stored import release, stored

BUCKETS = 4096
#: Input positions that are numbered together where scores are equal.
CHUNK = 65_536
#: Positions of a file whose sites are compared in one task.
SITE_BIN = 65_536
#: Areas and trajectories that a map shows.  A fixed value.
CHOSEN = 400


def burden_order() -> list[Column]:
    """Worst first, ties in input order; nine digits, so that the order does not hang on the last bit of a sum."""
    return [F.desc(F.round("burden", 9)), F.asc("seq")]


def global_rank(rows: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """WIN-1: the place of every row by ``score`` (0 to 1) descending, then seq, without one task for all rows.

    Rows are counted by score bucket and, inside it, by score and chunk of seq, so that equal scores are split too.  Counts are added up
    over the few buckets, then within a bucket; rows are numbered within their score and chunk.
    """
    past = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_s", F.round(F.col(score), 9)).withColumn("_chunk", F.floor(F.col("seq") / CHUNK))
    rows = rows.withColumn("_bucket", F.floor((1 - F.col("_s")) * BUCKETS).cast("int"))
    fine = rows.groupBy("_bucket", "_s", "_chunk").agg(F.count("*").alias("_n"))
    tops = fine.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    tops = tops.select("_bucket", F.coalesce(F.sum("_n").over(past(W.orderBy("_bucket"))), F.lit(0)).alias("_above"))
    inner = F.coalesce(F.sum("_n").over(past(W.partitionBy("_bucket").orderBy(F.desc("_s"), "_chunk"))), F.lit(0))
    offsets = fine.withColumn("_inner", inner).join(tops, "_bucket").select("_s", "_chunk", (F.col("_above") + F.col("_inner")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_s", "_chunk").orderBy("seq"))
    return rows.join(offsets, ["_s", "_chunk"]).withColumn(name, F.col("_before") + place).drop("_bucket", "_before", "_s", "_chunk")


def head(rows: DataFrame, n: int) -> DataFrame:
    """WIN-3: the first n rows in burden order."""
    return rows.orderBy(*burden_order()).limit(n)


def queue_ranking(rows: DataFrame, n: int) -> DataFrame:
    """WIN-2: each queue by its own score, the first n."""
    own = F.round(
        F.when(F.col("queue") == "peripheral-quick-win", F.col("quick_win")).when(F.col("queue") == "central-leverage", F.col("central_leverage")).otherwise(F.col("investigation_priority")),
        9,
    )
    rows = rows.withColumn("score", own)
    place = F.row_number().over(W.partitionBy("queue").orderBy(F.desc("score"), "seq"))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def spread(rows: DataFrame, n: int, per_file: int = 2, per_feature: int = 4) -> DataFrame:
    """WIN-4: at most so many per file and per feature, worst first.  A feature is a function of the file, so two windows are exact."""
    by_file = F.row_number().over(W.partitionBy("file").orderBy(*burden_order()))
    by_feature = F.row_number().over(W.partitionBy("feature").orderBy(*burden_order()))
    kept = rows.withColumn("_f", by_file).filter(F.col("_f") <= per_file).withColumn("_g", by_feature).filter(F.col("_g") <= per_feature)
    return kept.orderBy(*burden_order()).limit(n).drop("_f", "_g")


def staged_choice(rows: DataFrame, last: DataFrame, route: str, stage: str, identity: str, order: list[Column], caps: dict[int, int], total: int) -> DataFrame:
    """WIN-16: the candidates of every route, stage by stage, with their ``place``.

    In a stage, candidates go by ``order``; of equal ``identity`` the first counts, and ``caps`` says how many a stage may give (stages
    without a cap give none).  Stages fill up to ``total`` rows.  ``last`` holds at most one row a route, of columns of ``rows``: it comes
    last, and takes the place of the tail row where the choice is full.  Every window ends in a constant limit, so only few rows of a
    route are shuffled on.
    """
    allowed = F.create_map(*[F.lit(x) for k, n in caps.items() for x in (k, n)])[F.col(stage)]
    first = F.row_number().over(W.partitionBy(route, stage, identity).orderBy(*order))
    once = rows.withColumn("_k", first).filter("_k = 1")
    within = once.withColumn("_k", F.row_number().over(W.partitionBy(route, stage).orderBy(*order))).filter(F.col("_k") <= max(caps.values()))
    filled = within.filter(F.col("_k") <= allowed).withColumn("_place", F.row_number().over(W.partitionBy(route).orderBy(stage, "_k"))).filter(F.col("_place") <= total)
    filled = filled.drop("_k").withColumn("_last", F.lit(False))
    both = filled.unionByName(last.withColumn("_last", F.lit(True)), allowMissingColumns=True)
    has_last = F.max("_last").over(W.partitionBy(route))
    kept = both.withColumn("_end", has_last).filter(F.col("_last") | (F.col("_place") < total) | ~F.col("_end"))
    place = F.row_number().over(W.partitionBy(route).orderBy("_last", "_place"))
    return kept.withColumn("place", place).drop("_place", "_last", "_end")


def firsts_first(rows: DataFrame, n: int) -> DataFrame:
    """WIN-14: n rows, the worst of every file first (tier 0), then the worst of the rest (tier 1).

    The worst of a file comes from an aggregate, not from a window over all its rows.
    """
    worst = rows.groupBy("file").agg(F.max(F.struct(F.round("burden", 9).alias("b"), (-F.col("seq")).alias("s"))).alias("w")).select((-F.col("w.s")).alias("seq"))
    first = rows.join(worst, "seq", "left_semi").withColumn("tier", F.lit(0)).orderBy(*burden_order()).limit(n)
    rest = rows.join(worst, "seq", "left_anti").withColumn("tier", F.lit(1)).orderBy(*burden_order()).limit(n)
    return first.union(rest).orderBy("tier", *burden_order()).limit(n)


def coverage(rows: DataFrame, n: int) -> DataFrame:
    """WIN-5: the worst of every file first, then the rest."""
    return firsts_first(rows, n).drop("tier")


def diverse(rows: DataFrame, n: int, weight: float) -> DataFrame:
    """WIN-6: greedy choice of n rows by burden less a penalty for files, shapes and pivots chosen before.

    Fewer than n rows are chosen before any choice, so a row is out of the question while enough better ones of its shape are
    left that cannot all be penalised more: n that agree in file and pivot, in file with n pivots, or in pivot with n files.  After
    these cuts a file and a pivot occur n times at most within a shape, so among n * (2n - 1) better combinations there are
    2n - 1 with different files and different pivots, of which one has neither been chosen.  Windows make these cuts exactly;
    n * n * (2n - 1) rows of a shape are left at most, however many files there are, and the greedy loop over them is one pandas group.
    """
    order = burden_order()
    alike = F.row_number().over(W.partitionBy("file", "shape", "pivot").orderBy(*order))
    pool = rows.select("seq", "file", "shape", "pivot", "burden").withColumn("_k", alike).filter(F.col("_k") <= n)
    best = pool.filter(F.col("_k") == 1)
    for group, most in ((("file", "shape"), n), (("shape", "pivot"), n), (("shape",), n * (2 * n - 1))):
        best = best.withColumn("_b", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_b") <= most)
    best = best.select(F.col("file").alias("_file"), F.col("shape").alias("_shape"), F.col("pivot").alias("_pivot"))
    pool = pool.join(best, F.col("file").eqNullSafe(F.col("_file")) & F.col("shape").eqNullSafe(F.col("_shape")) & F.col("pivot").eqNullSafe(F.col("_pivot")))

    def choose(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.assign(burden=pool["burden"].round(9)).sort_values(["burden", "seq"], ascending=[False, True], kind="stable").reset_index(drop=True)
        top = max(0.0001, pool["burden"].max()) if len(pool) else 1.0
        left, chosen = list(range(len(pool))), []
        seen: dict[tuple, int] = {}
        rows = list(pool.itertuples(index=False))
        while left and len(chosen) < n:
            k = len(chosen)

            def value(i: int) -> float:
                r = rows[i]
                if not k:
                    return r.burden
                pivot = seen.get(("p", r.pivot), 0) if r.pivot is not None else 0
                again = 0.5 * seen.get(("f", r.file), 0) / k + 0.25 * seen.get(("s", r.shape), 0) / k + 0.25 * pivot / k
                return r.burden - weight * top * again

            best = max(left, key=lambda i: (value(i), -i))
            left.remove(best)
            chosen.append(best)
            for key in (("f", rows[best].file), ("s", rows[best].shape), ("p", rows[best].pivot)):
                seen[key] = seen.get(key, 0) + 1
        return pool.loc[chosen, ["seq"]].assign(place=range(1, len(chosen) + 1))

    return pool.select("seq", "file", "shape", "pivot", "burden", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda g: choose(g), "seq long, place int")


def suppressed(rows: DataFrame, chosen: DataFrame, n: int = 6) -> DataFrame:
    """WIN-8: for files that are shown, how many rows are hidden; the n largest."""
    shown = chosen.groupBy("file").agg(F.count("*").alias("shown"))
    total = rows.groupBy("file").agg(F.count("*").alias("total"))
    return total.join(shown, "file").withColumn("hidden", F.col("total") - F.col("shown")).filter("hidden > 0").orderBy(F.desc("hidden"), "file").limit(n)


def actionable_pool(rows: DataFrame) -> DataFrame:
    """FLT-12: drop background rows unless nothing else is left."""
    any_real = rows.agg(F.max((~F.col("background")).cast("int")).alias("m")).scalar()
    return rows.filter(~F.col("background") | (F.coalesce(any_real, F.lit(0)) == 0))


#: Ranks of a bin, within which one task looks for a key's earlier rows; a key with no more rows is one bin.
RANK_BIN = 65_536


def work_units(rows: DataFrame, packs: DataFrame) -> DataFrame:
    """WIN-9 and WIN-10: within a file, in burden order, a row joins the first unit that shares a pack or agrees in pivot and shape.

    A unit is named by its head, the row that opened it, and units stand in the order of their heads.  So a row's unit is the least of the units of
    earlier rows that share a pack, and of the earlier heads with its pivot and shape; a row without either is a head.  This depends on earlier rows only, so
    it has one solution, and a round that computes it for all rows from the last round's answers settles the first rows first and changes
    nothing once all are settled.  A round is a prefix minimum over the rows of each key, in two levels of rank bins where a key has many, and a minimum over
    the keys of each row: no task holds a file or a hot pack, and a pack passes a unit on to all its rows in one round.

    Rows go by their rank and keys by a number.  A key with one row binds nothing and is left out; a row whose earlier rows are all settled is
    settled too: the next round adds it to the ``low`` of the rows behind it and drops it, so rounds shrink.  Of a round only the units of its
    settled rows stay when the next one is there.
    """
    none = F.lit(None).cast("string")

    def key(kind: str, x, y):
        return F.to_json(F.struct(F.col("file"), F.lit(kind).alias("kind"), x.alias("x"), y.alias("y")))

    data = rows.select("file", "sink_id", "pivot", "shape", "burden", "seq")
    data = stored(global_rank(data, "burden", "at").withColumn("burden", F.round("burden", 9)), "ranked")
    sets = packs.groupBy(F.col("sink_id").alias("_sink")).agg(F.collect_set("pack_key").alias("_packs"))
    shared = data.join(sets, F.col("sink_id") == F.col("_sink")).select("at", "file", F.explode("_packs").alias("_pack")).select("at", key("pack", F.col("_pack"), none).alias("key"), F.lit(False).alias("heads"))
    pivots = data.filter("pivot is not null").select("at", key("pivot", F.col("pivot"), F.col("shape")).alias("key"), F.lit(True).alias("heads"))
    entries = stored(shared.union(pivots), "entries")
    keys = entries.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_key", F.monotonically_increasing_id().alias("k"), (F.col("_n") > RANK_BIN).alias("hot"))
    keys = stored(keys, "keys")
    hot = not keys.filter("hot").isEmpty()
    at = F.col("at")
    bin_ = F.when(F.col("hot"), F.floor(at / RANK_BIN)).alias("bin")
    now = entries.join(keys, F.col("key") == F.col("_key")).select("at", "k", bin_, "heads", at.alias("low"), at.alias("unit"), F.lit(False).alias("settled"))
    best, done = None, []
    while True:
        given = F.when(~F.col("heads") | (F.col("unit") == at), F.col("unit"))
        sums = {"any": given, "final": F.when(F.col("settled"), given), "open": (~F.col("settled")).cast("int")}
        first = lambda n, v: F.max(v) if n == "open" else F.min(v)
        inner = W.partitionBy("k", "bin").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        met = now.select("*", *[first(n, v).over(inner).alias(f"_own_{n}") for n, v in sums.items()]).filter("not settled")
        parts = ["own"]
        if hot:
            outer = W.partitionBy("k").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
            tops = now.filter("bin is not null").groupBy("k", "bin").agg(*[first(n, v).alias(n) for n, v in sums.items()])
            tops = tops.select(F.col("k").alias("_k"), F.col("bin").alias("_at"), *[first(n, F.col(n)).over(outer).alias(f"_top_{n}") for n in sums])
            met = met.join(tops, (F.col("k") == F.col("_k")) & (F.col("bin") == F.col("_at")), "left")
            parts.append("top")
        low = F.least("low", *[f"_{p}_final" for p in parts])
        waits = F.greatest(F.lit(0), *[f"_{p}_open" for p in parts])
        met = met.select("at", "unit", F.least(low, *[f"_{p}_any" for p in parts]).alias("option"), waits.alias("waits"), F.struct("k", "bin", "heads", low.alias("low")).alias("e"))
        before, best = best, met.groupBy("at").agg(F.min("option").alias("unit"), F.first("unit").alias("old"), (F.max("waits") == 0).alias("settled"), F.collect_list("e").alias("e"))
        best = stored(best.withColumn("moved", F.col("unit") != F.col("old")).drop("old"), "units")
        if before is not None:
            release(before)
        last = best.filter("not settled").isEmpty() or best.filter("moved").isEmpty()
        done.append(stored((best if last else best.filter("settled")).select("at", "unit"), "settled"))
        if last:
            break
        now = best.select("at", F.explode("e").alias("e"), "unit", "settled").select("at", "e.k", "e.bin", "e.heads", "e.low", "unit", "settled")
    release(entries, keys, best)
    found = reduce(DataFrame.union, done).select(at.alias("_row"), "unit")
    units = data.join(found, at == F.col("_row"), "left").groupBy(F.coalesce("unit", at).alias("unit")).agg(F.count("*").alias("sinks"))
    return units.join(data, F.col("unit") == at).select("file", "seq", "burden", "sinks", "shape")


def _top_before(sites: DataFrame, value: Column, inner: W, name: str) -> DataFrame:
    """Add the greatest ``value`` of the file's earlier bins and, by the window ``inner``, of the own one; no task needs a whole file."""
    tops = sites.groupBy("file", "_bin").agg(F.max(value).alias("_top"))
    earlier = W.partitionBy("file").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(F.col("file").alias("_file"), F.col("_bin").alias("_at"), F.max("_top").over(earlier).alias("_top"))
    same = F.col("file").eqNullSafe(F.col("_file")) & (F.col("_bin") == F.col("_at"))
    return sites.withColumn("_own", F.max(value).over(inner)).join(tops, same).withColumn(name, F.greatest("_own", "_top")).drop("_file", "_at", "_own", "_top")


def nested_removed(sites: DataFrame) -> DataFrame:
    """WIN-12: per file drop a site whose start lies inside an earlier kept site (file, start, end).

    A site that starts beyond the ends of all before it is kept in any case and opens a part of its own; what starts inside of an
    opener is dropped in any case.  Only the rest of a part, sites that overlap in chains, goes through the ordered loop; parts are small and many, so
    those that open in one bin of a file go through it together.
    """
    bins = W.partitionBy("file", "_bin")
    rows = sites.withColumn("_bin", F.floor(F.col("start") / SITE_BIN))
    rows = _top_before(rows, F.col("end"), bins.orderBy(F.asc("start"), F.desc("end")).rowsBetween(W.unboundedPreceding, -1), "_reach")
    rows = rows.withColumn("_opens", F.col("start") > F.greatest(F.lit(-1), "_reach"))
    opener = F.when(F.col("_opens"), F.struct("start", "end"))
    rows = _top_before(rows, opener, bins.orderBy("start").rangeBetween(W.unboundedPreceding, W.currentRow), "_part")
    rows = rows.filter(F.col("_opens") | (F.col("start") > F.col("_part.end"))).select(*sites.columns, F.col("_part.start").alias("_part"))

    columns = sites.columns

    def keep(g: pa.Table) -> pa.Table:
        g = g.sort_by([("start", "ascending"), ("end", "descending")])
        kept, part, reach = [], None, -1
        for i, (here, start, end) in enumerate(zip(*(g[c].to_pylist() for c in ("_part", "start", "end")), strict=True)):
            if here != part:
                part, reach = here, -1
            if start > reach:
                kept.append(i)
                reach = float("inf") if end is None else end
        return g.select(columns).take(kept)

    return rows.groupBy("file", F.floor(F.col("_part") / SITE_BIN).alias("_home")).applyInArrow(keep, sites.schema)
