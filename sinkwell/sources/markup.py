"""Elements and attributes of markup, one row per tag, by SQL functions only.

Tags of ``NESTED`` open and close a level; every other tag is a leaf (pages leave them unclosed).  Nothing is parsed in
Python, and a page is one row, so the work is split by page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NESTED = ("html", "head", "body", "nav", "ul", "li", "article", "footer", "div")
TAG = r"<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>"
ATTRIBUTE = r"""\s([a-zA-Z-]+)="[^"]*\""""


def tags(pages: DataFrame) -> DataFrame:
    """page_id, pos, tag, closing, and level: how many nested tags are open before this one."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(TAG), F.lit(1))).alias("pos", "name"))
    rows = found.select("page_id", "pos", F.lower(F.ltrim("name", F.lit("/"))).alias("tag"), F.col("name").startswith("/").alias("closing"))
    step = F.when(F.col("tag").isin(*NESTED), F.when(F.col("closing"), -1).otherwise(1)).otherwise(0)
    before = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("level", F.coalesce(F.sum(step).over(before), F.lit(0)))


def elements(pages: DataFrame) -> DataFrame:
    """EXT-1/EXT-36: opened elements with their level and the position of the element that holds them."""
    rows = tags(pages).filter("not closing")
    # the parent is the last nested element before, one level up: each level of a page is one window over the openers that
    # lead to it and the elements on it, which keeps one position in memory
    openers = rows.filter(F.col("tag").isin(*NESTED)).select("page_id", "pos", "tag", "level", (F.col("level") + 1).alias("_on"), F.col("pos").alias("_opener"))
    held = rows.select("page_id", "pos", "tag", "level", F.col("level").alias("_on"), F.lit(None).cast("int").alias("_opener"))
    before = W.partitionBy("page_id", "_on").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    both = held.withColumn("_own", F.lit(True)).union(openers.withColumn("_own", F.lit(False)))
    return both.withColumn("parent", F.last("_opener", ignorenulls=True).over(before)).filter("_own").drop("_on", "_opener", "_own")


def intervals(pages: DataFrame, counted: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """GRF-18/GRF-20/GRF-21: elements as intervals: pos, end (null: open to the end of the page), level, ``inside`` (how many elements it holds).

    An element of ``NESTED`` ends at the first closing tag that brings the level back to its own, which is a window over the openers and closers of a
    level; any other element ends at once.  Element a holds element b where a.pos < b.pos < a.end, so ancestry is a range predicate, and what an element
    holds is a difference of two running counts.  ``counted`` adds, by name, how many of the given tags it holds.
    """
    groups = {"inside": None} | {name: tags_ for name, tags_ in (counted or {}).items()}
    before = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = tags(pages)
    for name, which in groups.items():
        one = ~F.col("closing") if which is None else ~F.col("closing") & F.col("tag").isin(*which)
        rows = rows.withColumn(f"_{name}", F.coalesce(F.sum(F.when(one, 1).otherwise(0)).over(before), F.lit(0)))
    total = rows.groupBy(F.col("page_id").alias("_page")).agg(*(F.max(F.col(f"_{n}") + F.when(~F.col("closing") & (F.lit(True) if w is None else F.col("tag").isin(*w)), 1).otherwise(0)).alias(f"_all_{n}") for n, w in groups.items()))
    nested = F.col("tag").isin(*NESTED)
    on = F.when(F.col("closing"), F.col("level")).otherwise(F.col("level") + 1)
    after = W.partitionBy("page_id", "_on").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    closer = F.when(F.col("closing"), F.struct("pos", *(f"_{n}" for n in groups)))
    open_ = rows.filter(nested).withColumn("_on", on).withColumn("_end", F.first(closer, ignorenulls=True).over(after)).filter("not closing").drop("_on")
    open_ = open_.join(total, F.col("page_id") == F.col("_page"))
    held = [(F.coalesce(F.col(f"_end._{n}"), F.col(f"_all_{n}")) - F.col(f"_{n}") - (F.lit(1) if w is None else F.when(F.col("tag").isin(*w), 1).otherwise(0))).cast("long").alias(n) for n, w in groups.items()]
    open_ = open_.select("page_id", "pos", F.col("_end.pos").alias("end"), "tag", "level", *held)
    leaves = rows.filter(~nested & ~F.col("closing")).select("page_id", "pos", F.col("pos").alias("end"), "tag", "level", *(F.lit(0).cast("long").alias(n) for n in groups))
    return open_.union(leaves)


def ancestors(elements: DataFrame, of: DataFrame, width: int = 64) -> DataFrame:
    """The elements of ``elements`` that hold those of ``of``: page_id, pos, and ``by``, a struct of the holder's pos, tag and level.

    Intervals are dealt into bins of ``width`` positions, so this is an equi join that no deep or wide page turns into all pairs.
    """
    last = F.coalesce(F.col("end"), F.lit(2**31 - 1)) - 1
    most = of.groupBy(F.col("page_id").alias("_page")).agg(F.max("pos").alias("_most"))
    holders = elements.filter(F.col("end").isNull() | (F.col("end") > F.col("pos") + 1)).join(most, F.col("page_id") == F.col("_page"))
    holders = holders.select("page_id", (F.col("pos") + 1).alias("low"), F.least(last, F.col("_most")).alias("high"), F.struct("pos", "tag", "level").alias("by")).filter("low <= high")
    dealt = holders.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    points = of.select("page_id", "pos").withColumn("_bin", F.floor(F.col("pos") / width))
    return points.join(dealt, ["page_id", "_bin"]).filter(F.col("pos").between(F.col("low"), F.col("high"))).select("page_id", "pos", "by")


def attributes(pages: DataFrame) -> DataFrame:
    """page_id, name and sink category of every attribute."""
    names = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(ATTRIBUTE), F.lit(1))).alias("name"))
    category = F.when(F.col("name").rlike("^on[A-Z]"), "event-handler").when(F.col("name").isin("style", "class"), "style").when(F.col("name").isin("when", "each", "fallback"), "render-control").otherwise("attribute")
    return names.withColumn("category", category)
