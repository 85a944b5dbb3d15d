"""The registered queries of the numbered operators: each reads whole tables and derives digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, filteraudit, hardneg, langid, linededup, mixing, neardup, pieces, sharding, tokencount, topk, toxicity
from .common import LONG_MAX, LONG_MIN, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.fit(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", linededup.written_bitmap().alias("drop_bitmap"), F.sha2(linededup.kept_text(), 256).alias("kept_sha256"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return out.withColumn("score", F.greatest(F.lit(LONG_MIN), F.least(F.lit(LONG_MAX), F.col("score"))).cast("long"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = sharding.fit_splitters(docs, n_shards=8)
    rows = sharding.assign(docs, cut).withColumn("text_crc32", F.crc32("text").cast("long")).drop("text")
    out = sharding.number(rows, cut)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, redact=tokencount.PERSONAL)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    rows = turns.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    out = chat.format_conversations(rows)
    back = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.withColumn("_loss", chat.read_loss(F.col("formatted"), F.col("loss")))
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(back, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # grades: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in a text of bad quality
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1))
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), grade))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filteraudit.audit_filters(docs, table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_decontamination,
        op3_line_dedup,
        op4_topk_search,
        op5_sharding,
        op6_token_counts,
        op7_chat_formatting,
        op8_toxicity,
        op9_minhash_near_dedup,
        op10_mixing,
        op11_sentencepiece,
        op12_hard_negatives,
        op13_filter_audit,
    )
}

ORACLES = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, line, pos,
                   translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
        ), dup AS (
            SELECT k, max(doc_id) AS keep_doc FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT l.*, (d.k IS NOT NULL AND l.doc_id <> d.keep_doc) AS lost FROM lines l LEFT JOIN dup d ON l.k = d.k
        ), masks AS (
            SELECT doc_id, (pos - 1) // 64 AS word, bit_or(CASE (pos - 1) % 64 WHEN 63 THEN -9223372036854775808 ELSE 1::BIGINT << ((pos - 1) % 64) END) AS mask
            FROM marked WHERE lost GROUP BY ALL
        ), bitmaps AS (
            SELECT doc_id, string_agg(word || ':' || mask, ',' ORDER BY word) AS drop_bitmap FROM masks GROUP BY doc_id
        ), texts AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
            FROM marked GROUP BY doc_id
        )
        SELECT t.*, coalesce(drop_bitmap, '') AS drop_bitmap FROM texts t LEFT JOIN bitmaps USING (doc_id)""",
    "op4_topk_search": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op7_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(length('<|turn|>') + length('<|body|>') + length('<|end|>') + length(regexp_replace(role || text, '([\\<\[])', '\1x', 'g')))::BIGINT AS formatted_chars
        FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM turns) GROUP BY conv_id, alone""",
    "op10_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
            FROM documents
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS i FROM d GROUP BY source
        ), w AS (
            SELECT *, (i - 1) % 3 + 1 AS weight, sum(source_size) OVER ()::BIGINT AS total FROM s
        ), c AS (  -- by the least cap per weight first: a source is capped if what its predecessors leave would give it more
            SELECT *, 3 * source_size < (total - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) * weight AS capped
            FROM w WINDOW o AS (ORDER BY 3 * source_size::DOUBLE / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), t AS (
            SELECT *, CASE WHEN capped THEN (3 * source_size)::DOUBLE
                           ELSE (total - coalesce(sum(3 * source_size) FILTER (WHERE capped) OVER (), 0))::DOUBLE / sum(weight) FILTER (WHERE NOT capped) OVER () * weight END AS target
            FROM c
        ), k AS (  -- a source's blocks end with its target in whole words
            SELECT *, CASE WHEN target > 0 THEN greatest(round(target), 1) ELSE 0 END::BIGINT AS quota FROM t
        ), placed AS (
            SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
        )
        SELECT p.doc_id, p.source, p.size, k.source_size, k.target,
               (greatest(0, least(start + size, quota) - start)
                + greatest(0, least(source_size + start + size, quota) - source_size - start)
                + greatest(0, least(2 * source_size + start + size, quota) - 2 * source_size - start))::BIGINT AS taken
        FROM placed p JOIN k ON p.source IS NOT DISTINCT FROM k.source""",
    "op12_hard_negatives": r"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
        ), p AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
               other_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY rank <= 3""",
    "op13_filter_audit": r"""
        WITH t AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS upper
            FROM documents
        ), marks AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
        ), f AS (
            SELECT t.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                   CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * upper > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
            FROM t LEFT JOIN marks ON marks.doc_id = t.doc_id
        ), c AS (
            SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
        ), letters AS (
            SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (
            SELECT filter_order, unnest(range(1, 6)) AS step FROM orders
        ), met AS (  -- one row per step and class of documents: is it there still, and does it fail here
            SELECT part, filter_order, step, good, toxic, n, filter_order[step] AS x,
                   len(list_intersect(string_split(fails, ''), string_split(filter_order[1:step - 1], ''))) = 0 OR fails = '' OR step = 1 AS there,
                   contains(fails, filter_order[step]) AS here, fails = filter_order[step] AS only_here
            FROM c, steps
        ), s AS (
            SELECT part, filter_order, step, x,
                   coalesce(sum(n) FILTER (WHERE there AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE there AND here), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (WHERE NOT there AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE only_here), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n) FILTER (WHERE there AND here AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (WHERE there AND here AND toxic), 0)::BIGINT AS toxic_lost
            FROM met GROUP BY ALL
        )
        SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
        FROM s""",
    "op9_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), i AS (
            SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM i
        ), n AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
        ), walk(id, root) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM walk JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) ON a = id
        ), c AS (
            SELECT id, min(root) AS root FROM walk GROUP BY id
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
}
