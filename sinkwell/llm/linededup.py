"""Line dedup over whole documents, on DataFrame functions only.

Every line of at least ``min_chars`` code points (after stripping and lower-casing A-Z) is reduced to 128 bits of hash.  The
hashes are range-partitioned together with a block of the document id and sorted by document and position inside the
partitions; a window streams over them and marks the first occurrence in each document.  Marks are summed per hash.  A hash
found in at least ``min_docs`` documents loses its lines everywhere but in the largest document id.  The outcome is a
compressed keep bitmap per document, which ``dedup_lines`` returns: 64 lines a word, a set bit for each line that goes, words
without one left out.  ``kept_text`` applies it.

Defined cases: a null or empty text is one empty line; a null doc_id is one document below every other (the same as the doc_id -2^63);
rows that share a doc_id count as one document, and each text among them gets a bitmap of its own; an empty table gives
no rows; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LONG_MIN, SPACE, stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A hash's documents are dealt into blocks, so that one hot line does not sit in one range: at least so many, and one for so many lines.
BLOCKS, LINES_PER_BLOCK = 64, 100_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _ascii_lower(s: Column) -> Column:
    plain = F.octet_length(s) == F.char_length(s)
    return F.when(plain, F.lower(s)).otherwise(F.translate(s, UPPER, UPPER.lower()))


def _document(df: DataFrame) -> DataFrame:
    return df.withColumns({"_doc": F.coalesce(F.col("doc_id"), F.lit(LONG_MIN)), "_tid": F.xxhash64("text")})


def line_hashes(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """One row for each line that is long enough: h1, h2, document, text id, position."""
    rows = _document(docs.select("doc_id", "text")).select("_doc", "_tid", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(SPACE))).filter(F.char_length("line") >= min_chars)
    rows = rows.withColumn("key", _ascii_lower(F.col("line")))
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "_doc", "_tid", "pos")


def repeated_lines(hashes: DataFrame, min_docs: int = 3) -> DataFrame:
    """h1, h2, n_docs and keep_doc (the largest document) of the hashes found in enough documents."""
    blocks = max(BLOCKS, hashes.count() // LINES_PER_BLOCK)
    spread = hashes.withColumn("block", F.pmod(F.xxhash64("_doc"), F.lit(blocks)))
    ranged = spread.repartitionByRange("h1", "h2", "block")
    stream = W.partitionBy("h1", "h2", "block").orderBy(F.desc("_doc"), "_tid", "pos")
    before = F.lag("_doc").over(stream)
    first = ranged.withColumn("first", (before.isNull() | (before != F.col("_doc"))).cast("long"))
    return first.groupBy("h1", "h2").agg(F.sum("first").alias("n_docs"), F.max("_doc").alias("keep_doc")).filter(F.col("n_docs") >= min_docs)


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document that loses lines: ``words``, the 64-line words (index, mask of dropped lines) of its bitmap."""
    hashes = stored(line_hashes(docs, min_chars), "lines")
    # stored, so that both sides of the join are plain exchanges and a hot line can be split
    repeated = stored(repeated_lines(hashes, min_docs), "repeated")
    lost = hashes.join(repeated, ["h1", "h2"]).filter(F.col("_doc") != F.col("keep_doc"))
    words = lost.groupBy("_doc", "_tid", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos").bitwiseAND(63))).alias("mask")
    )
    return words.groupBy("_doc", "_tid").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words"), F.sum(F.bit_count("mask")).cast("long").alias("n_dropped")
    )


def kept_text() -> Column:
    """The lines of ``text`` that the bitmap in ``words`` leaves, joined."""
    kept = F.filter(
        _lines(F.col("text")),
        lambda line, i: F.coalesce(F.getbit(F.try_element_at("words", F.shiftright(i, 6)), i.bitwiseAND(63)), F.lit(0)) == 0,
    )
    return F.when(F.col("words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))


def written_bitmap() -> Column:
    """The bitmap in ``words`` as text: ``word:mask`` with signed 64-bit masks, ascending, apart by commas; empty if no line goes."""
    words = F.array_sort(F.map_entries("words"))
    return F.coalesce(F.array_join(F.transform(words, lambda w: F.concat_ws(":", w["key"].cast("string"), w["value"].cast("string"))), ","), F.lit(""))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text, n_lines, n_dropped and words (the bitmap: word number to mask; null if no line goes) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        _document(docs.select("doc_id", "text"))
        .join(drop_bitmaps(docs, min_chars, min_docs), ["_doc", "_tid"], "left")
        .select(
            "doc_id",
            "text",
            (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
            F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
            "words",
        )
    )
