"""Mixing sources to target weights, on DataFrame functions only.

The documents of a source, in hashed order, form a stream of words that is cut into blocks of ``block`` words and may be read
up to ``max_repeat`` times.  Slot i of the schedule gets the golden-ratio point frac(i * phi); the points run through the
cumulative target shares, which names the slot's source, and the slot's rank among the slots of its source names the block of
that source's stream.  Joining slots and blocks gives the words that the mix takes of each document.

The block follows the whole corpus, so a source with a target of few blocks comes out by whole blocks, or with none.  With
``settle`` a source whose target is below ``SMALL_BLOCKS`` blocks takes its target of words from the start of its stream instead,
to the word.

Sources are a configuration of bounded size (``MAX_SOURCES``, checked: more are an error); sums per source are all that the driver
sees.  Places in a stream and ranks of slots are three-level running totals, so no task needs a whole source.

Defined cases: a null text has size 0; documents without words are never taken; the null source comes last; repeated rows are
documents of their own, placed one after the other and counted before they are placed; an empty table, or one without words, gives targets and
taken of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, array_of, running_total, search, stored

#: 2**32 / phi, odd: multiples of it modulo 2**32 are golden-ratio points.  A fixed value.
GOLDEN = 2654435769
MAX_SOURCES = 100_000
MAX_BLOCK = 4096
#: The schedule has at least so many slots where there are as many words, and at most 2**31.
MIN_SLOTS = 65_536
ROWS_PER_BUCKET = 1000


def fill(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above cap * size; the excess goes to the others by weight."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        per = left / sum(weights[i] for i in free)
        over = [i for i in free if per * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        free -= set(over)
    return out


def _digest(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))


def identified(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    """doc_id, source, ``more`` and the names of each row.

    _h: 60 bits that put the documents of a source in their order; _g: 60 further bits of the same digest of id and text, so that
    (doc_id, source, _h, _g) names a document with 120 bits besides its id; _r: a hash of all other columns.
    """
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text", "source")]
    rows = docs.select("doc_id", "source", *more, F.xxhash64(F.lit(0), *others).alias("_r"), _digest(seed).alias("_md5"))
    for name, at in (("_h", 1), ("_g", 16)):
        rows = rows.withColumn(name, F.conv(F.substring("_md5", at, 15), 16, 10).cast("bigint"))
    return rows.drop("_md5")


def sized(docs: DataFrame, seed: int = 17) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return identified(docs, seed, words.alias("size"))


def source_plan(rows: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> dict:
    """Sizes and targets by source, sources in code point order with null last."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: weights of a mix are a configuration, not a table")
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in sums]
    targets = fill(sizes, [cycle[i % len(cycle)] for i in range(len(sums))], cap)
    total = sum(sizes)
    block = max(1, min(MAX_BLOCK, total // MIN_SLOTS), -(-total // 2**31))
    return {"names": [r.source for r in sums], "sizes": sizes, "targets": targets, "total": total, "block": block, "n": sum(r.n for r in sums)}


def _plan_rows(spark, plan: dict) -> DataFrame:
    """The plan as a table: source, _s, source_size, target, quota; at most MAX_SOURCES rows."""
    arrays = {"source": array_of(plan["names"], "string"), "source_size": array_of(plan["sizes"], "bigint"), "target": array_of(plan["targets"], "double")}
    zipped = spark.range(1).select(*[a.alias(k) for k, a in arrays.items()]).select(F.posexplode(F.arrays_zip(*arrays)).alias("_s", "p"))
    quota = F.when(F.col("p.target") > 0, F.greatest(F.round("p.target"), F.lit(1))).otherwise(0).cast("long")
    return zipped.select("_s", "p.source", "p.source_size", "p.target", quota.alias("quota"))


def schedule(spark, plan: dict) -> DataFrame:
    """slot, _s (the source), block (its rank among the slots of the source) and the words of the source's stream, from ``_first`` up to ``_last``."""
    n, b = -(-plan["total"] // plan["block"]), plan["block"]
    cumulative, seen = [], 0.0
    for t in plan["targets"]:
        seen += t
        cumulative.append(seen / max(plan["total"], 1))
    last = max((i for i, t in enumerate(plan["targets"]) if t > 0), default=0)
    point = ((F.col("id") * F.lit(GOLDEN)) % F.lit(2**32) + F.lit(0.5)) / F.lit(2.0**32)
    slots = spark.range(n).withColumn("_s", F.least(search(cumulative, point), F.lit(last)))
    slots = slots.withColumn("_chunk", F.shiftright("id", 16))
    ranked = running_total(slots, "_s", "_chunk", ["id"], F.lit(1).cast("long"), "block").select(F.col("id").alias("slot"), "_s", "block")
    quotas = _plan_rows(spark, plan).select(F.col("_s").alias("_of"), "quota", F.expr(f"(quota + {b - 1}) div {b}").alias("_blocks"))
    named = slots.groupBy("_s").agg(F.count("*").alias("_n"))
    short = quotas.join(named, F.col("_of") == F.col("_s"), "left").withColumn("_n", F.coalesce("_n", F.lit(0))).filter(F.col("_n") < F.col("_blocks"))
    tail = short.select(F.col("_of").alias("_s"), F.explode(F.sequence(F.col("_n"), F.col("_blocks") - 1)).alias("block"))
    tail = tail.select((F.lit(n) + F.col("block") * len(plan["names"]) + F.col("_s")).alias("slot"), "_s", "block")
    whole = ranked.unionByName(tail).join(F.broadcast(quotas), F.col("_s") == F.col("_of"))
    whole = whole.withColumn("_first", F.col("block") * b).withColumn("_last", F.least(F.col("_first") + b, F.col("quota")))
    return whole.filter("_first < _last").select("slot", "_s", "block", "_first", "_last")


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target and taken: the words that the mix takes of each document."""
    spark = docs.sparkSession
    rows = stored(sized(docs, seed), "mixing")
    plan = source_plan(rows, cycle, float(max_repeat))
    buckets = max(1, -(-plan["n"] // ROWS_PER_BUCKET))
    known = rows.groupBy(*rows.columns).agg(F.count("*").alias("_same"))  # equal rows are one until they are placed
    known = known.join(F.broadcast(_plan_rows(spark, plan)).withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    known = known.withColumn("_bucket", F.least(F.floor(F.col("_h") / F.lit(2.0**60) * buckets), F.lit(buckets - 1)))
    placed = running_total(known, "_s", "_bucket", ["_h", "doc_id", "_g", "_r"], F.col("size") * F.col("_same"), "_before")
    placed = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_same") - 1))).withColumn("_start", F.col("_before") + F.col("_copy") * F.col("size"))
    placed = placed.withColumn("_id", F.struct("_h", "doc_id", "_start"))
    b = plan["block"]
    spans = placed.filter("size > 0").select("_id", "_s", "size", "source_size", "_start", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))).alias("_turn"))
    spans = spans.withColumn("_from", F.col("_turn") * F.col("source_size") + F.col("_start")).withColumn("_to", F.col("_from") + F.col("size"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.expr(f"_from div {b}"), F.expr(f"(_to - 1) div {b}"))))
    words = F.greatest(F.least("_to", "_last") - F.greatest("_from", "_first"), F.lit(0))
    taken = spans.join(schedule(spark, plan), ["_s", "block"]).groupBy("_id").agg(F.sum(words).alias("taken"))
    out = placed.join(taken, "_id", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "_h", "_g", "_r")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs``, all columns, each as often as the mix takes it (a part counts as once); what it leaves out is gone.

    Rows that agree in all columns share their copies; rows that differ in any column are told apart.
    """
    seed = how.get("seed", 17)
    key = ["doc_id", "source", "_h", "_g", "_r"]
    named = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("_i"), F.col("doc_id").isNull().alias("_i0"), F.coalesce("source", F.lit("")).alias("_n"), F.col("source").isNull().alias("_n0"), "_h", "_g", "_r"]
    keys = ["_i", "_i0", "_n", "_n0", "_h", "_g", "_r"]
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    often = mix(docs, **how).filter("taken > 0").withColumn("_copies", copies).select(*key, "_copies")
    often = often.select(*named, "_copies").groupBy(*keys).agg(F.sum("_copies").cast("int").alias("_copies"))
    rows = identified(docs, seed, F.struct(*docs.columns).alias("_row")).select(*named, "_row")
    rows = rows.join(often, keys).groupBy(*keys).agg(F.first("_row").alias("_row"), F.first("_copies").alias("_copies"))
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
