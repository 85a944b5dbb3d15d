"""Filter audit, piece encoding and hard negatives, against brute force, the library and messy rows."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sinkwell.llm import filteraudit, hardneg, pieces, queries

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, label int"

# ---------------------------------------------------------------- filter audit


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else ""
    return out + ("D" if set("#$%&*|") & set(text) else "")


def brute_audit(rows, labels):
    """Every document walks through every order."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    cells = {}
    for i, text, lang in rows:
        own = fails(text or "") + ("E" if i is not None and i > least[text or ""] else "")
        for order in permutations("ABCDE"):
            gone = False
            for step, x in enumerate(order, 1):
                c = cells.setdefault((lang or "", "".join(order), step), Counter())
                here = x in own
                c["kept"] += not gone and not here
                c["removed"] += not gone and here
                c["redundant"] += gone and here
                c["unique_fails"] += own == x
                c["good_lost"] += not gone and here and i in good
                c["toxic_lost"] += not gone and here and i in toxic
                gone |= here
    shapley = Counter()
    for (part, order, step), c in cells.items():
        shapley[part, order[step - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(*k, *(c[n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k, c in cells.items()}


def audit_rows(rng):
    stock = [f"word{i}" for i in range(300)]
    texts = [None, "", " \n\t ", "A" * 9, "éÉ ü", "x # y", "one two\x1cthree", " ".join(stock), " ".join(stock[:20] * 20), " ".join(["Same"] * 250) + " $", "LOUD " * 300]
    texts += [" ".join(rng.choice(stock) for _ in range(rng.choice([5, 150, 199, 200, 201, 5000]))) for _ in range(20)]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "de", "fr"])) for _ in range(150)]
    rows += [(i, "hot text", "en") for i in range(100, 180)] + [(500, "hot text", "de")] * 5 + [(7, texts[7], "en")] * 3
    labels = [(rng.choice([None, *range(200)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(150)] + [(500, 1, 1)] * 3
    return rows, labels


def test_audit_brute_force_on_messy_rows(spark):
    rows, labels = audit_rows(random.Random(1))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    for name in ("part", "mask", "key", "n", "quality", "_text", "filter_order", "good"):
        docs = docs.withColumn(name, F.lit("x"))
    out = filteraudit.audit_filters(docs, spark.createDataFrame(labels, LABELS).withColumn("key", F.lit(1)))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, labels)


def test_audit_without_documents_labels_or_ids(spark):
    none = spark.createDataFrame([], LABELS)
    assert filteraudit.audit_filters(spark.createDataFrame([], DOCS), none).collect() == []
    rows = [(None, "same", None), (None, "same", None), (3, "same", None)]
    got = {tuple(r) for r in filteraudit.audit_filters(spark.createDataFrame(rows, DOCS), none).collect()}
    assert got == brute_audit(rows, [])


def test_potential_gives_shapley_values_of_any_game(spark):
    rng = random.Random(2)
    for n in (1, 3, 5):
        game = [0, *(rng.randrange(1000) for _ in range((1 << n) - 1))]
        row = spark.range(1).select(filteraudit.potentials(F.array(*(F.lit(v).cast("long") for v in game)), n).alias("p")).first()
        whole = (1 << n) - 1
        for i in range(n):
            direct = 0
            for order in permutations(range(n)):
                before = sum(1 << j for j in order[: order.index(i)])
                direct += game[before | 1 << i] - game[before]
            assert row.p[whole] - row.p[whole ^ 1 << i] == direct
    with pytest.raises(ValueError):
        filteraudit.audit(spark.range(1), "ABCDEFGH", {})


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def coders():
    v = pieces.read_model(pieces.MODEL)
    return pieces.Encoder(v), pieces.Decoder(v)


PARTS = ["ab", "  ", "a", "b", "▁", "aa", "\n", "é", "the", "ing", "中国", "人", "\0", "👍", " t", "er", "//", "-----", "ÀÁ", "\t", "     ", "==", "ő", "퟿", "0", "</s>", "<0x41>", "�"]


def random_text(rng, vocabulary):
    kind = rng.randrange(4)
    if kind == 0:
        return rng.choice(PARTS) * rng.randrange(60)
    if kind == 1:
        return "".join(rng.choice([rng.choice(vocabulary).replace("▁", " "), chr(rng.randrange(0x20, 0x3000))]) for _ in range(rng.randrange(9)))
    return "".join(rng.choice(PARTS if kind == 2 else "ab cin") for _ in range(rng.randrange(40)))


def test_ids_and_decoded_texts_are_the_library_s(library, coders):
    encoder, decoder = coders
    rng = random.Random(3)
    for _ in range(4000):
        text = random_text(rng, encoder.vocabulary.pieces)
        ids = encoder.encode(text)
        assert ids == library.encode(text), text
        assert decoder.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(library, coders):
    rng = random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.choice([28705, 264, 0, 1, 2])]) for _ in range(rng.randrange(9))]
        assert coders[1].decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        coders[1].decode([32000])
    assert coders[1].decode([3 + 0xFF] * 200_000) == "�" * 200_000


def test_table_holds_the_last_token_of_every_prefix(coders):
    text = "▁internationalisation//====ing"
    last = coders[0].table(text)
    for n in range(1, len(text) + 1):
        assert last[n] == pieces.History(text[:n], coders[0].score).last[-1]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    monkeypatch.setattr(pieces, "LONG_TEXT", 50)
    encoder = pieces.Encoder(pieces.read_model(pieces.MODEL))
    rng = random.Random(5)
    for _ in range(300):
        text = random_text(rng, encoder.vocabulary.pieces)
        assert encoder.encode(text) == library.encode(text)


def test_pieces_on_spark_with_messy_rows(spark, library):
    long = "no spaces at all ".replace(" ", "") * 20_000 + " tail"
    rows = [(1, "plain text"), (1, "plain text"), (2, None), (3, ""), (None, " \n  x"), (4, long), (5, "中国人" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    got = pieces.decode(pieces.encode(docs)).collect()
    want = [(i, ids := library.encode(t or "", add_eos=True), library.decode(ids)) for i, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert [r.ids for r in pieces.encode(docs.filter("doc_id = 3"), end=False).collect()] == [[]]
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded == ""
    assert pieces.encode(docs.limit(0)).collect() == []


def test_piece_query_gives_the_library_s_digests(spark, small, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert {tuple(r) for r in queries.op11_sentencepiece(spark, small).collect()} == want


def test_other_models_are_refused(tmp_path):
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    at = data.rindex(b"\x18\x01 \x002\x00")  # space before the text, extra spaces kept
    (tmp_path / "m").write_bytes(data[:at] + b"\x18\x01 \x012\x00" + data[at + 6 :])
    with pytest.raises(ValueError):
        pieces.read_model(str(tmp_path / "m"))


# ---------------------------------------------------------------- hard negatives


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def brute_negatives(rows, every, n_pos=5, n_neg=3, low=50, high=95):
    ok = [(i, lab, whole(v)) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in ok if i % every == 0}:
        best = sorted((-dot(v, w), j) for j, other, w in ok if other == lab and j != i)[:n_pos]
        for p, j in best:
            found = sorted((-s, m) for m, other, w in ok if other != lab and low * -p <= 100 * (s := dot(v, w)) <= high * -p)[:n_neg]
            out += [(i, j, r, m, -p, -s) for r, (s, m) in enumerate(found, 1)]
    return sorted(out)


def vectors(rng, n, d=12):
    return [(i, [rng.gauss(0.2, 0.4) for _ in range(d)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("leaf", [2, 32])
def test_negatives_brute_force_with_ties_and_bad_rows(spark, monkeypatch, leaf):
    monkeypatch.setattr(hardneg, "LEAF", leaf)
    monkeypatch.setattr(hardneg, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(hardneg, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(hardneg, "ANCHOR_STEP", 3)
    rng = random.Random(6)
    rows = vectors(rng, 200)
    rows += [(i, [0.5] * 12, i % 3) for i in range(200, 230)] + [(240, [0.25] * 12, 1)] * 4 + [(240, [0.25] * 12, 2)]
    rows += [(400, None, 1), (402, [None] * 12, 1), (404, [float("nan")] * 12, 1), (406, [float("inf")] + [0.0] * 11, 1), (None, [1.0] * 12, 1), (408, [1.0] * 12, None)]
    rows += [(410, [], 1), (411, [0.25, -0.5], 2), (420, [0.0] * 12, 0), (430, [-1.0] * 12, 7)]
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    for name in ("a_key", "score", "rank", "width", "qb", "positives", "v"):
        df = df.withColumn(name, F.lit("x"))
    got = hardneg.hard_negatives(df, F.col("vec_id") % 10 == 0, F.col("label")).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows, 10)


def test_negatives_with_sums_beyond_64_bits(spark):
    rng = random.Random(7)
    rows = vectors(rng, 30, 4) + [(i, [rng.choice([1e9, -3e12, 2.5e12]) for _ in range(4)], i % 2) for i in range(30, 60)]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, F.col("label")).collect()
    most, least = 2**63 - 1, -(2**63)
    want = sorted((*r[:4], *(max(least, min(most, s)) for s in r[4:])) for r in brute_negatives(rows, 5))
    assert sorted(map(tuple, got)) == want and any(r[4] == most for r in want)


def test_negatives_empty_or_alone(spark):
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], VECTORS)
    assert hardneg.hard_negatives(one, F.col("vec_id") == 0, F.col("label")).collect() == []
    assert hardneg.hard_negatives(one.limit(0), F.lit(True), F.col("label")).collect() == []


@pytest.mark.parametrize("kind", [np.int64, object])
def test_product_is_exact_for_any_shape(monkeypatch, kind):
    monkeypatch.setattr(hardneg, "LEAF", 2)
    rng = np.random.default_rng(8)
    for m, n, k in [(1, 1, 1), (5, 9, 3), (16, 16, 16), (17, 31, 9), (40, 3, 21)]:
        a, b = rng.integers(-(2**29), 2**29, (m, k)).astype(kind), rng.integers(-(2**29), 2**29, (n, k)).astype(kind)
        assert (hardneg.product(a, b) == a.astype(object) @ b.astype(object).T).all()


def test_product_wraps_only_in_between():
    a = np.array([[2**61, 2**61]] * 64, np.int64).repeat(32, axis=1)
    b = np.array([[1, -1]] * 64, np.int64).repeat(32, axis=1)
    assert (hardneg.product(a, b) == 0).all()  # single sums of the halves go beyond 2**63


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_filter_audit"])
def test_query_matches_its_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
