r"""Chat formatting with typed content parts, on DataFrame functions only.

A turn holds an array of parts (text, image, audio, document).  A visitor over the parts of each turn flattens them into
ordered content: texts are escaped, every other part becomes one placeholder, its reference and expanded token count go to
the list of attachments.  A conversation is then written with one template:

    <|turn|>role<|body|>content<|end|>

Every control string begins with ``<`` or ``[``.  Inside roles and texts each ``<``, ``[`` and ``\`` is followed by an added
``\``, so no control string can come from a text, and the added characters can be taken out again from left to right.

The loss mask covers the contents of assistant turns, as (start, length) in code points and in UTF-8 bytes.  ``expanded_tokens``
counts what the placeholders stand for (patches, seconds, pages); texts are counted by a tokenizer, elsewhere.

Defined cases: null roles and texts are empty; a row without a conv_id is a conversation of its own, so that such rows never
meet; turns are ordered by turn (null first), role and text, so repeated rows are turns of their own; a null or empty array of parts is an empty content; extra columns of
turns are dropped; an empty table gives no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Expanded tokens: one for each patch of pixels, so many for a second of sound, for a page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 256


def escape(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), r"([\\<\[])", r"$1\\")


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"([\\<\[])\\", "$1")


def text_part(text: Column) -> Column:
    """An array of one text part."""
    fields = [F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref")]
    fields += [F.lit(None).cast(k).alias(n) for n, k in (("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(*fields))


def _tokens(p: Column) -> Column:
    def patches(x: Column) -> Column:
        return F.greatest(F.ceil(F.coalesce(x, F.lit(0)) / PATCH), F.lit(1).cast("long"))

    return (
        F.when(p["type"] == "image", patches(p["width"]) * patches(p["height"]))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * PER_SECOND))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(1)).cast("long") * PER_PAGE)
        .otherwise(F.lit(0).cast("long"))
    )


def _visit(p: Column) -> Column:
    out = F.when(p["type"] == "text", escape(p["text"]))
    for kind, mark in PLACEHOLDER.items():
        out = out.when(p["type"] == kind, F.lit(mark))
    return out.otherwise(F.lit(""))


def flatten_parts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, attachments and expanded_tokens of each turn."""
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    attached = F.transform(
        F.filter(parts, lambda p: p["type"].isin(*PLACEHOLDER)),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
    )
    return turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, _visit), "").alias("content"),
        attached.alias("attachments"),
        F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + F.coalesce(_tokens(p), F.lit(0).cast("long"))).alias("expanded_tokens"),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss spans, attachments in order, expanded_tokens."""
    flat = flatten_parts(turns).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)))
    flat = flat.withColumn("piece", F.concat("head", "content", F.lit(END)))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "content", F.to_json("attachments"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    chars, size = (F.coalesce(F.sum(n("piece")).over(before), F.lit(0)).cast("long") for n in (F.char_length, F.octet_length))
    known = flat.filter(F.col("conv_id").isNotNull()).withColumns({"at": F.row_number().over(order), "chars": chars, "bytes": size})
    together = known.groupBy("conv_id").agg(F.array_sort(F.collect_list(_turn())).alias("t"))
    zero = F.lit(0).cast("long")
    alone = flat.filter(F.col("conv_id").isNull()).withColumns({"at": F.lit(1), "chars": zero, "bytes": zero}).select("conv_id", F.array(_turn()).alias("t"))
    return together.union(alone).select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join("t.piece", "").alias("formatted"),
        F.filter(F.col("t.span"), lambda s: s.isNotNull()).alias("loss"),
        F.flatten("t.attachments").alias("attachments"),
        F.aggregate("t.expanded_tokens", zero, lambda a, x: a + x).alias("expanded_tokens"),
    )


def _turn() -> Column:
    """What a conversation keeps of a turn; only assistant turns have a span."""
    span = F.struct(
        (F.col("chars") + F.char_length("head")).cast("long").alias("start"),
        F.char_length("content").cast("long").alias("length"),
        (F.col("bytes") + F.octet_length("head")).cast("long").alias("start_byte"),
        F.octet_length("content").cast("long").alias("n_bytes"),
    )
    return F.struct("at", "piece", F.when(F.col("role") == "assistant", span).alias("span"), "attachments", "expanded_tokens")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda _, i: i > 0)

    def read(p: Column) -> Column:
        at = F.instr(p, BODY)
        return F.struct(
            unescape(F.substring(p, F.lit(1), at - 1)).alias("role"),
            unescape(F.substring(p, at + len(BODY), F.char_length(p) - at - len(BODY) - len(END) + 1)).alias("text"),
        )

    return F.transform(pieces, read)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    raw = formatted.cast("binary")
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(raw, (s["start_byte"] + 1).cast("int"), s["n_bytes"].cast("int")).cast("string"))), "")
