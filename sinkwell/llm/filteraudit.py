"""Interaction audit of a chain of filters by the Hart-Mas-Colell potential.

The removal game of a set of filters S is v(S), the number of documents that fail at least one filter of S.  Its potential is
P(empty) = 0, P(S) = (v(S) + sum of P(S - i) over i in S) / |S|; the Shapley value of filter i is P(all) - P(all - i).  Coalitions are
numbers (bit i: filter i) and are taken in rising order, so every smaller one is ready; the potential is kept times the number of
orders, which makes it an integer.  What a filter removes behind the filters S is v(S + i) - v(S), so the 32 values of a game
give every step of all 120 orders; the same game over marked documents gives the marked ones that are lost.

A document's own conditions are bits of a mask from one pass over the text.  The condition "identical to the text of a smaller
doc_id" is about the table: rows are first counted by (doc_id, digest of the text, part), joined with the marks by doc_id, counted by
(digest, part, mask, marks) with the least doc_id of each and how many rows hold it, and the least of a digest is a window
over these counts.  Only digests (sha-256) are shuffled, and thousands of equal texts arrive as one row of counts for each part, so neither a
hot text nor a hot doc_id is a large group.  The games are sums over masks, so at most 2**n x 4 counts of a part are ever held.

Defined cases: a null text is an empty one; a null part is ''; rows are counted one by one, rows that share a doc_id do not make one
another a copy; a row without a doc_id is no copy, no original and has no marks; a mark holds if any row of the marks with the doc_id
bears it (repeated and null rows of marks are harmless, null marks do not hold); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, array_of, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The letter of the condition that needs the whole table.
COPY = "E"
MOST_FILTERS = 7


def text_conditions(text: Column) -> dict[str, Column]:
    """The conditions under which a text fails, by letter, in the order of their bits."""
    words = F.filter(F.split(F.translate(text, SPACE, " " * len(SPACE)), " "), lambda w: w != "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    points = F.char_length(text)
    upper = points - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": n_words < 200,
        "B": F.lit(100) * distinct.cast("long") < F.lit(50) * n_words.cast("long"),
        "C": F.lit(100) * upper.cast("long") > F.lit(3) * points.cast("long"),
        "D": F.char_length(F.translate(text, "#$%&*|", "")) < points,
    }


def counted_masks(docs: DataFrame, marks: DataFrame, flags: dict[str, Column], part: Column, conditions=text_conditions) -> DataFrame:
    """part, mask (bits of the failed conditions; the last one is that of copies), one boolean for each flag, and n rows.

    ``marks`` has a doc_id and the columns from which ``flags`` derive booleans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions(F.col("_text")).values())]
    copy_bit = 1 << len(bits)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), F.coalesce(part, F.lit("")).alias("part"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("key"), sum(bits[1:], bits[0]).alias("mask"))
    rows = rows.groupBy("doc_id", "key", "part", "mask").agg(F.count("*").alias("n"))

    # stored: then both sides of the join are plain exchanges, and a hot doc_id can be split
    marked = marks.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id"))
    marked = stored(marked.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(f"_{f}") for f, c in flags.items())), "marks")
    # rows without a doc_id match nothing; the second key spreads them
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(0)
    met = rows.withColumn("_spread", spread).join(marked.withColumn("_spread_of", F.lit(0).cast("long")), (F.col("doc_id") == F.col("_id")) & (F.col("_spread") == F.col("_spread_of")), "left")
    met = met.select("doc_id", "key", "part", "mask", "n", *(F.coalesce(f"_{f}", F.lit(False)).alias(f) for f in flags))

    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    held = met.groupBy("key", "part", "mask", *flags).agg(F.sum("n").alias("n"), least.alias("least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null"))
    first = F.min("least.doc_id").over(W.partitionBy("key"))
    fresh = F.col("n_null") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    held = held.withColumn("first", first).withColumn("fresh", fresh)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")),
    )
    out = held.select("part", *flags, F.explode(both).alias("c")).select("part", *flags, "c.mask", "c.n")
    return out.groupBy("part", "mask", *flags).agg(F.sum("n").alias("n"))


def potentials(game: Column, n_filters: int) -> Column:
    """The potential of every coalition, times the number of orders, from the array of the game's values."""
    scale = F.lit(factorial(n_filters)).cast("long")
    members = array_of([[i for i in range(n_filters) if s >> i & 1] for s in range(1, 1 << n_filters)], "array<int>")

    def grow(known: Column, inside: Column) -> Column:
        at = F.size(known)  # the coalition's number
        smaller = F.transform(inside, lambda i: F.element_at(known, (at - F.call_function("shiftleft", F.lit(1), i) + 1).cast("int")))
        total = F.aggregate(smaller, F.lit(0).cast("long"), lambda a, b: a + b)
        # the whole is a multiple of the coalition's size; a division of longs keeps it exact
        value = scale * F.element_at(game, at + 1) + total
        return F.array_append(known, F.call_function("div", value, F.size(inside).cast("long")))

    return F.aggregate(members, F.array(F.lit(0).cast("long")), grow)


def steps_of(letters: str) -> Column:
    """Every step of every order: filter_order, step, the filter's bit number, the coalition before."""
    out = []
    for order in permutations(range(len(letters))):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": name, "step": step, "filter": i, "before": before})
            before |= 1 << i
    return F.from_json(F.lit(json.dumps(out)), "array<struct<filter_order:string,step:int,filter:int,before:int>>")


def audit(counts: DataFrame, letters: str, lost: dict[str, str]) -> DataFrame:
    """One row per part, order and step, from counts by (part, mask, flags).

    kept, removed, redundant, unique_fails, shapley (times the number of orders) and, for every result name of ``lost``, the removed
    documents that bear the flag.
    """
    n = len(letters)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters; orders grow as a factorial")
    own = {"_all": F.lit(True)} | {f"_{name}": F.col(flag) for name, flag in lost.items()}
    hit = lambda s: F.col("mask").bitwiseAND(F.lit(s)) != 0
    values = [F.coalesce(F.sum(F.when(hit(s) & flag, F.col("n"))), F.lit(0)).alias(f"{g}_{s}") for g, flag in own.items() for s in range(1, 1 << n)]
    wide = counts.groupBy("part").agg(F.sum("n").alias("_n"), *values)
    zero = F.lit(0).cast("long")
    games = wide.select("part", "_n", *(F.array(zero, *(F.col(f"{g}_{s}") for s in range(1, 1 << n))).alias(g) for g in own))
    games = games.withColumn("_potential", potentials(F.col("_all"), n))
    at = lambda a, s: F.element_at(F.col(a), (s + 1).cast("int"))
    rows = games.withColumn("s", F.explode(steps_of(letters)))
    bit = F.call_function("shiftleft", F.lit(1), F.col("s.filter"))
    before, after = F.col("s.before"), F.col("s.before") + bit
    whole = F.lit((1 << n) - 1)
    removed = at("_all", after) - at("_all", before)
    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        (F.col("_n") - at("_all", after)).alias("kept"),
        removed.alias("removed"),
        (at("_all", bit) - removed).alias("redundant"),
        (at("_all", whole) - at("_all", whole - bit)).alias("unique_fails"),
        *((at(f"_{name}", after) - at(f"_{name}", before)).alias(name) for name in lost),
        (at("_potential", whole) - at("_potential", whole - bit)).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole texts, by lang, with the good and the toxic documents that each step loses."""
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    counts = counted_masks(docs, labels, flags, F.col("lang"))
    return audit(counts, "ABCD" + COPY, {"good_lost": "good", "toxic_lost": "toxic"})
