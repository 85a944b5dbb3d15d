"""Top-k search and chat formatting, against brute force and on messy rows."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinkwell.llm import chat, queries, topk

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k, every):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in ok:
        if i % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in ok if j != i)[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(found, 1)}
    return sorted(out)


def test_top_k_brute_force_with_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(300)]
    rows += [(i, [0.5] * 12) for i in range(300, 340)] + [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (None, [1.0] * 12)]
    rows += [(410, []), (411, [0.25, -0.5]), (420, [0.0] * 12)]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS).withColumn("score", F.lit(1)).withColumn("rank", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5, 10)


def test_top_k_few_candidates_and_empty(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0], 0), (7, [0.5, 0.5], 0)], VECTORS)
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") == 0).collect()] == [(0, 1, 7, 256 * 128 + 512 * 128)]
    assert topk.top_k(two.limit(0), F.lit(True)).collect() == []
    twice = two.union(two)
    assert [r.vec_id for r in topk.top_k(twice, F.col("vec_id") == 0).orderBy("rank").collect()] == [7, 7]


def answers(lists, own, queries, k):
    return {i: (ids.tolist(), [int(s) for s in score], read) for i, ids, score, read in lists.best(own, queries, k)}


def by_products(x, q, own, k):
    """The plain way: all scores."""
    out = {}
    for i, row in enumerate(q):
        s = [sum(int(a) * int(b) for a, b in zip(row, v, strict=True)) for v in x]
        order = sorted((j for j in range(len(x)) if j != own[i]), key=lambda j: (-s[j], j))[:k]
        out[i] = (order, [s[j] for j in order])
    return out


def test_lists_stop_early_on_skewed_data():
    rng = np.random.default_rng(0)
    x = rng.integers(-20, 20, (2000, 8)).astype(float)
    x[[7, 90, 400, 1500, 1999]] = 255
    q = np.full((2, 8), 100.0)
    got = answers(topk.Lists(np.arange(2000), x), np.array([-1, 7]), q, 1)
    assert {i: r[:2] for i, r in got.items()} == by_products(x, q, [-1, 7], 1)
    assert all(r[2] <= 2000 * 8 / 8 for r in got.values())  # at most an eighth of the entries
    x = rng.normal(0, 100, (2000, 8)) * np.array([50.0, 1, 1, 1, 1, 1, 1, 1])  # one list tells
    x = np.floor(x)
    got = answers(topk.Lists(np.arange(2000), x), np.arange(6), x[:6], 5)
    assert {i: r[:2] for i, r in got.items()} == by_products(x, x[:6], range(6), 5)
    assert max(r[2] for r in got.values()) < 0.6 * 2000 * 8


@pytest.mark.parametrize("dims", [8, 64])
def test_lists_on_even_data(dims):
    """Evenly spread vectors are read far, but the rule stops before the ends, and no answer is lost."""
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 30, (1500, dims)))
    x[100:110] = x[50]
    q = x[:60]
    got = answers(topk.Lists(np.arange(1500), x), np.arange(60), q, 5)
    assert {i: r[:2] for i, r in got.items()} == by_products(x, q, range(60), 5)
    assert max(r[2] for r in got.values()) <= 1500 * dims
    assert np.mean([r[2] for r in got.values()]) < 0.97 * 1500 * dims


def test_queries_without_components_read_nothing():
    x = np.floor(np.random.default_rng(1).normal(0, 30, (300, 4)))
    got = answers(topk.Lists(np.arange(300), x), np.array([5]), np.zeros((1, 4)), 3)
    assert got[0] == ([0, 1, 2], [0, 0, 0], 0)


def test_lists_are_exact_for_any_magnitude():
    rng = np.random.default_rng(2)
    for scale in (3, 3000, 10**7, 10**8, 10**12):
        x = rng.integers(-scale, scale, (120, 6)).astype(float)
        q = rng.integers(-scale, scale, (9, 6)).astype(float)
        got = answers(topk.Lists(np.arange(120), x), np.arange(9), q, 5)
        assert {i: r[:2] for i, r in got.items()} == by_products(x, q, range(9), 5)


def test_very_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(4)]) for i in range(60)]
    rows += [(100, [1e18, 0.0, -1e18, 2.0]), (101, [-1e18, 1.0, 3e4, 0.5]), (110, [1e14] * 4), (120, [1e18, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], VECTORS)
    got = sorted((r.query_id, r["rank"], r.vec_id, max(-topk.MOST, min(topk.MOST, int(r.score)))) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect())
    assert got == [(i, r, j, max(-topk.MOST, min(topk.MOST, s))) for i, r, j, s in brute_top(rows, 5, 10)]


def test_reads_are_counted(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.gauss(0, 0.3) for _ in range(12)], 0) for i in range(300)], VECTORS)
    rows = topk.top_k(df, F.col("vec_id") % 50 == 0, reads=True).collect()
    assert {r.entries for r in rows} == {300 * 12} and all(12 * 100 < r.entries_read <= r.entries for r in rows)
    assert len({(r.query_id, r.entries_read) for r in rows}) == 6


def turns_of(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    if extra:
        for c in ("head", "piece", "at", "loss", "formatted", "t"):
            df = df.withColumn(c, F.lit("x"))
    return df.withColumn("parts", chat.text_part(F.col("text")))


def test_chat_round_trip_on_messy_turns(spark):
    rng = random.Random(9)
    bits = [chat.TURN, chat.BODY, chat.END, "\\", "<", "[", "\\<", "<\\", "[INST]", "</s>", "é", "日本", "\n", " plain ", "<|image|>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|end|>"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(100, 0, None, None), (100, 1, "assistant", None), (101, None, "user", "a"), (101, 0, "assistant", "b"), (102, 0, "user", "same"), (102, 0, "user", "same"), (None, 0, "assistant", "lost")]
    rows += [(103, t, "assistant", "x" * 50) for t in range(1500)]
    rng.shuffle(rows)
    out = chat.format_conversations(turns_of(spark, rows, extra=True))
    out = out.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("under", chat.read_loss(F.col("formatted"), F.col("loss")))
    got = {r.conv_id: r for r in out.collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", (chat_escape(r[3] or "")))):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        r = got[c]
        assert [tuple(x) for x in r.back] == turns and r.n_turns == len(turns)
        assert r.under == "".join(x for role, x in turns if role == "assistant")
        assert "".join(r.formatted[s.start : s.start + s.length] for s in r.loss) == "".join(chat_escape(x) for role, x in turns if role == "assistant")
        assert r.formatted.count(chat.TURN) == len(turns) == r.formatted.count(chat.END)


def test_rows_without_a_conversation_stay_alone(spark):
    rows = [(None, t % 2, "assistant", "same") for t in range(40)] + [(1, 0, "user", "x")]
    out = chat.format_conversations(turns_of(spark, rows)).collect()
    assert len(out) == 41 and all(r.n_turns == 1 for r in out)
    assert {r.formatted for r in out if r.conv_id is None} == {f"{chat.TURN}assistant{chat.BODY}same{chat.END}"}


def chat_escape(s):
    return "".join(c + "\\" if c in "\\<[" else c for c in s)


def test_chat_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see ", None, None, None, None, None), ("image", None, "a.png", 56, 30, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3)]),
            (1, 1, "assistant", [("text", "two words", None, None, None, None, None)]), (1, 2, "user", None), (1, 3, "user", [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|turn|>user<|body|>see <|image|><|audio|><|document|><|end|><|turn|>assistant<|body|>two words<|end|>" + "<|turn|>user<|body|><|end|>" * 2
    assert [tuple(a) for a in r.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 63), ("document", "c.pdf", 768)]
    assert r.expanded_tokens == 4 + 63 + 768


def test_chat_empty_and_query(spark, small):
    assert chat.format_conversations(turns_of(spark, [])).collect() == []
    rows = {r.conv_id: r for r in queries.op7_chat_formatting(spark, small).collect()}
    said = "</s>[INST] ok [/INST]"
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and rows[-7].loss_chars == len(said)
