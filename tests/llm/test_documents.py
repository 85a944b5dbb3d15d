"""Operators over documents, against brute force and on messy rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinkwell.llm import decontam, langid, linededup, mixing, neardup, sharding, tokencount, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(*r, *([None] * (5 - len(r)))) for r in rows], DOCS)
    if extra:  # columns that are named like internal or result columns
        for name in ("words", "size", "shard", "slot", "_h", "_doc", "_tid", "id", "key", "label", "component_id", "kept", "row"):
            df = df.withColumn(name, F.lit("x"))
    return df


def prose(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


def messy(rng):
    long = "\n".join(prose(rng, 40) for _ in range(400))
    rows = [(None, "some text here to read", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \n\t\n ", "fr", "b"), (4, long, "en", None)]
    rows += [(5, "same row twice\nwith two lines that are long enough", "en", "a")] * 2
    rows += [(6, "12345 67890 !!! ???", "de", "b"), (7, "É" * 30 + "\nabc", "fr", "b")]
    return rows


EMPTY = []


# ---------------------------------------------------------------- line dedup


def brute_lines(rows, min_chars=20, min_docs=3):
    space = " \t\n\x0b\f\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    seen = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            k = line.strip(space).translate(low)
            if len(k) >= min_chars:
                seen[k].add(-(2**63) if i is None else i)
    lost = {k: max(v) for k, v in seen.items() if len(v) >= min_docs}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        own = -(2**63) if i is None else i
        kept = [x for x in lines if not ((k := x.strip(space).translate(low)) in lost and lost[k] != own)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    stock = [prose(rng, 8) for _ in range(12)]
    rows = messy(rng)
    for i in range(10, 120):
        lines = [rng.choice(stock) for _ in range(rng.randrange(1, 90))]
        lines = [rng.choice(["", "  ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", " \r"]) for x in lines]
        lines += [prose(rng, 5) for _ in range(rng.randrange(3))] + ["short"] * rng.randrange(2)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), "en", "a"))
    out = linededup.dedup_lines(docs_of(spark, rows, extra=True))
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2(linededup.kept_text(), 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)
    marked = out.select("n_dropped", "words", linededup.written_bitmap().alias("text")).collect()
    for r in marked:
        assert r.n_dropped == sum(bin(m % 2**64).count("1") for m in (r.words or {}).values())
        assert r.text == ",".join(f"{w}:{m}" for w, m in sorted((r.words or {}).items()))
    assert any(r.n_dropped > 64 for r in marked)
    monkeypatch.setattr(linededup, "LINES_PER_BLOCK", 5)
    more = linededup.dedup_lines(docs_of(spark, rows)).select("doc_id", "n_lines", "n_dropped", F.sha2(linededup.kept_text(), 256)).collect()
    assert sorted(map(tuple, more), key=repr) == brute_lines(rows)


def test_line_bitmap_has_only_words_with_drops(spark):
    rows = [(i, "\n".join(["x" * 30] + [f"{i} {j} only here and long enough" for j in range(200)])) for i in range(3)]
    words = linededup.drop_bitmaps(docs_of(spark, rows)).collect()
    assert [(r["_doc"], r["words"]) for r in sorted(words)] == [(0, {0: 1}), (1, {0: 1})]


def test_line_dedup_empty(spark):
    assert linededup.dedup_lines(docs_of(spark, EMPTY)).collect() == []


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("hot", [False, True])
def test_sharding_balance_slots_and_groups(spark, hot):
    rng = random.Random(5)
    rows = messy(rng)[:4] + [(i, "hot text " * 30 if hot and i % 3 == 0 else prose(rng, rng.randrange(5, 200))) for i in range(10, 3000)]
    out = sharding.shard_documents(docs_of(spark, rows, extra=True), n_shards=8, ranges_per_shard=32).select("doc_id", "text", "size", "shard", "slot").collect()
    assert len(out) == len(rows)
    for r in out:
        assert r["size"] == len((r.text or "").encode()) + 1
    sizes, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[r.text].add(r.shard)
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) < 1.08 * min(sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for t, v in groups.items() if t != "hot text " * 30)


@pytest.mark.parametrize("groups", [100, 67])
def test_equal_texts_stay_together_below_the_tolerance(spark, groups):
    """Groups of 1 % of the bytes are larger than a fine range, and smaller than an eighth of a shard."""
    rows = [(i, f"group {i % groups:04} " * 20) for i in range(4000)] if groups == 100 else [(i, ("hot text " if i % 2 else f"group {i % groups:04} ") * 20) for i in range(4000)]
    docs = docs_of(spark, rows)
    out = sharding.shard_documents(docs).select("text", "shard", "slot", "size").collect()
    shards, sizes, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in out:
        shards[r.text].add(r.shard)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    large = {t for t, n in Counter(t for _, t in rows).items() if n * (len(t) + 1) * 8 * 8 > sum(sizes.values())}
    assert all(len(v) == 1 for t, v in shards.items() if t not in large)
    assert len(sizes) == 8 and max(sizes.values()) < 1.3 * min(sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_splitters_against_plain_ones(spark):
    """Every range holds exactly the rows between its boundaries, and shards are runs of ranges."""
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(1500)]
    docs = docs_of(spark, rows)
    cut = sharding.fit_splitters(docs, 8, ranges_per_shard=16)
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64("doc_id").alias("d"), sharding.record_size().alias("n")).collect()
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_documents(docs, 8, ranges_per_shard=16).collect()}
    import bisect

    size, count = Counter(), defaultdict(list)
    for r in sorted(keyed, key=lambda r: (r.h, r.d, r.doc_id)):
        p = bisect.bisect_right(cut.bounds, (r.h, r.d))
        size[p] += r.n
        count[cut.shard[p]].append(r.doc_id)
    assert cut.bytes == [size[p] for p in range(len(cut.bounds) + 1)] and cut.shard == sorted(cut.shard)
    assert got == {i: (s, slot) for s, ids in count.items() for slot, i in enumerate(ids)}


def test_columns_pass_through_sharding(spark):
    out = sharding.shard_documents(docs_of(spark, [(i, f"t{i}") for i in range(50)], extra=True).withColumn("_range", F.lit("y")).withColumn("_d", F.lit("z")))
    assert {(r["_h"], r["_range"], r["_d"]) for r in out.collect()} == {("x", "y", "z")}


def test_sharding_is_repeatable_and_handles_empty(spark):
    rows = [(i, f"text {i}" * (i % 7)) for i in range(200)] * 2
    a, b = (sorted(map(tuple, sharding.shard_documents(docs_of(spark, rows)).select("doc_id", "shard", "slot").collect())) for _ in range(2))
    assert a == b
    assert sharding.shard_documents(docs_of(spark, EMPTY)).collect() == []


# ---------------------------------------------------------------- mixing


def brute_mix(rows, cap=3):
    """Targets and the number of slots of each source, by plain arithmetic."""
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len((text or "").encode().split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total = sum(sizes.values())
    target, free, left = {}, set(names), total
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = cap * sizes[s]
            free.discard(s)
        left = total - sum(target[s] for s in target)
    return names, sizes, target, total


def test_mix_targets_and_taken(spark):
    rng = random.Random(7)
    rows = messy(rng) + [(i, prose(rng, rng.randrange(0, 60)), "en", rng.choice(["a", "a", "a", "a", "b", "c", "é", None, "tiny"] if i % 50 == 0 else ["a", "a", "a", "b", "c"])) for i in range(10, 900)]
    got = mixing.mix(docs_of(spark, rows, extra=True)).collect()
    names, sizes, target, total = brute_mix(rows)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    block = max(1, min(4096, total // 65536))
    bounds = np.cumsum([target[s] / total for s in names])
    points = ((np.arange(-(-total // block), dtype=np.uint64) * np.uint64(2654435769) % np.uint64(2**32)) + 0.5) / 2**32
    slots = Counter(np.minimum(np.searchsorted(bounds, points, "right"), max(i for i, s in enumerate(names) if target[s] > 0)).tolist())
    for i, s in enumerate(names):
        assert abs(slots[i] * block - target[s]) <= 12 * block
        assert taken[s] == max(1, math.floor(target[s] + 0.5)) if target[s] else taken[s] == 0
    again = mixing.mix(docs_of(spark, rows)).collect()
    assert sorted([tuple(r)[:6] for r in again], key=repr) == sorted([tuple(r)[:6] for r in got], key=repr)


def test_schedule_holds_every_block_of_every_source_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MIN_SLOTS", 16)
    sizes = {"a": 4000, "b": 900, "c": 3, "d": 1, "e": 0}
    rows = [(i, " ".join(["w"] * n), "en", s) for i, (s, n) in enumerate(sizes.items())]
    plan = mixing.source_plan(mixing.sized(docs_of(spark, rows)))
    b, got = plan["block"], defaultdict(list)
    slots = mixing.schedule(spark, plan).orderBy("slot").collect()
    assert b > 3 and len({r.slot for r in slots}) == len(slots)
    for r in slots:
        got[r["_s"]].append((r["block"], r["_first"], r["_last"]))
    for i, target in enumerate(plan["targets"]):
        quota = max(1, math.floor(target + 0.5)) if target else 0
        assert got[i] == [(k, k * b, min(k * b + b, quota)) for k in range(-(-quota // b))]
    golden = [r for r in slots if r.slot < -(-plan["total"] // b)]
    bounds = np.cumsum(plan["targets"]) / plan["total"]
    assert all(r["_s"] == min(int(np.searchsorted(bounds, ((r.slot * 2654435769) % 2**32 + 0.5) / 2**32, "right")), 3) for r in golden)


def test_mix_places_many_equal_rows(spark):
    rows = [(1, "one two three", "en", "a")] * 300 + [(None, "four five", "en", "a")] * 100 + [(i, "six", "en", "b") for i in range(50)]
    got = mixing.mix(docs_of(spark, rows)).collect()
    _, sizes, target, _ = brute_mix(rows)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(taken[s] == round(target[s]) for s in sizes)
    n = Counter(r.source for r in mixing.mixed_documents(docs_of(spark, rows)).collect())
    assert n["b"] == 150 and n["a"] >= 300


def test_mixed_documents_repeat_and_leave_out(spark):
    rows = [(i, "one two three", "en", "a" if i < 90 else "b") for i in range(100)]
    out = mixing.mixed_documents(docs_of(spark, rows, extra=True))
    assert out.columns == docs_of(spark, rows, extra=True).columns
    n = Counter(r.source for r in out.collect())
    assert n["b"] == 30 and n["a"] == 70  # 90 of 300 words is the cap of b, 210 are left for a
    assert mixing.mix(docs_of(spark, EMPTY)).collect() == []
    assert mixing.mix(docs_of(spark, [(1, "", "en", "a"), (2, None, "en", None)])).select("taken").distinct().collect()[0].taken == 0


def test_mixed_documents_tell_rows_apart(spark):
    same = [(1, "one two three", "en", "a"), (1, "one two three", "de", "a"), (1, "one two three", "en", "b"), (1, "one two three", "en", None), (None, "one two three", "en", "a")]
    rows = same * 2 + [(i, "four five", "en", s) for i in range(10, 60) for s in ("a", "b", None)]
    docs = docs_of(spark, rows)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.source] += -(-r.taken // r["size"])
    got = [tuple(r)[:4] for r in mixing.mixed_documents(docs).collect()]
    assert Counter((i, s) for i, _, _, s in got) == +want
    assert set(got) <= set(rows)
    again = mixing.mixed_documents(docs_of(spark, rows[::-1])).collect()
    assert Counter(tuple(r)[:4] for r in again) == Counter(got)


def test_running_totals_in_bundles(spark, monkeypatch):
    from sinkwell.llm import common

    monkeypatch.setattr(common, "FANOUT", 3)
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, w long").withColumn("b", F.floor(F.col("i") / 7))
    got = {r.i: r.t for r in common.running_total(df, "g", "b", ["i"], F.col("w"), "t").collect()}
    seen = Counter()
    for g, i, w in rows:
        assert got[i] == seen[g]
        seen[g] += w


def test_mixed_documents_keep_a_very_small_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MIN_SLOTS", 16)  # blocks as large as those of a large corpus
    rng = random.Random(8)
    rows = [(i, prose(rng, 50), "en", "large") for i in range(400)]
    small = {f"small{s:02}": 1 + 7 * s for s in range(20)}
    rows += [(1000 + s, prose(rng, n), "en", name) for s, (name, n) in enumerate(small.items())]
    docs = docs_of(spark, rows)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    _, _, target, _ = brute_mix(rows)
    assert all(abs(taken[s] - target[s]) <= 1 for s in small)
    n = Counter(r.source for r in mixing.mixed_documents(docs).collect())
    assert all(n[s] >= 1 for s in small)


# ---------------------------------------------------------------- near duplicates


def word_set(text, k):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent):
    sets = [word_set(t, k) for _, t, *_ in rows]
    parent = {i: i for i, *_ in rows if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            i, j = rows[a][0], rows[b][0]
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted([(i, len(s), None if i is None else find(i)) for (i, *_), s in zip(rows, sets, strict=True)], key=repr)


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 1024), (3, 85, 16), (5, 80, 16)])
def test_near_duplicates_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)  # groups of several blocks
    rng = random.Random(11 + k + block)
    rows = messy(rng)
    i = 10
    for size in (60, 25, 8, 2):
        base = prose(rng, 90, 3000).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((i, " ".join(w).title() if rng.random() < 0.2 else "\n".join(w)))
            i += 1
    chain = prose(rng, 120, 3000).split()
    for step in range(10):  # each near the one before, the ends far apart
        chain[step * 9 : step * 9 + 2] = [f"c{step}", f"d{step}"]
        rows.append((1000 - step, " ".join(chain)))
    rows += [(2000 + j, "two words") for j in range(5)] + [(2010, "two"), (2011, "TWO")]
    rng.shuffle(rows)
    got = neardup.near_duplicates(docs_of(spark, rows, extra=True), k, percent).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute_components(rows, k, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_shared_ids(spark):
    a, b, c = (prose(random.Random(s), 60, 10**6) for s in (1, 2, 3))
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (9, ""), (9, c), (8, c), (None, c), (20, ""), (20, None)]
    got = neardup.near_duplicates(docs_of(spark, rows), 3, 85).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=repr) == brute_components(rows, 3, 85)
    assert {r.component_id for r in got if r.doc_id in (1, 5, 7)} == {1} and sum(r.kept for r in got) == 5
    rows = [(1, a, "en", "x"), (5, a, "en", "x"), (5, b, "en", "x"), (5, b, "de", "x"), (5, b, "de", "x"), (None, c, "en", "y"), (4, "", "en", "x"), (4, "", "en", "x"), (6, None)]
    kept = sorted([tuple(r)[:4] for r in neardup.keep_one(docs_of(spark, rows, extra=True)).collect()], key=repr)
    assert [r for r in kept if r[1] not in (b,)] == sorted([rows[0], rows[5], rows[6], rows[7], (6, None, None, None)], key=repr)
    assert len([r for r in kept if r[1] == b]) == 1  # and the same one each time
    again = sorted([tuple(r)[:4] for r in neardup.keep_one(docs_of(spark, rows[::-1], extra=True)).collect()], key=repr)
    assert again == kept


@pytest.mark.parametrize("original", ["first", "middle"])
def test_a_family_sends_about_one_row_per_copy(spark, monkeypatch, original):
    """Copies of one text; with the original in the middle, no copy is near enough to the first one."""
    sent = []
    real = neardup.confirmed

    def counting(rows, sets, percent):
        sent.append((rows.count(), sets.count()))
        return real(rows, sets, percent)

    monkeypatch.setattr(neardup, "confirmed", counting)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 64)
    rng = random.Random(4)
    base = prose(rng, 300, 10**6).split()
    shares = {}
    for n in (400, 800):
        rows = []
        for i in range(n):
            w = list(base)
            if original == "middle" and i != n // 2:
                at = rng.randrange(13)
                w[at::13] = [f"e{rng.randrange(10**9)}" for _ in w[at::13]]
            elif i != n // 2:
                w[rng.randrange(300)] = f"e{i}"
            rows.append((i, " ".join(w)))
        sent.clear()
        got = neardup.near_duplicates(docs_of(spark, rows), 1, 80 if original == "first" else 85).collect()
        assert {r.component_id for r in got} == {0}
        shares[n] = (sum(r for r, _ in sent) / n, sent[0][1] / n)
    assert all(r < 3 and t <= 1 for r, t in shares.values()), shares


def test_pages_of_one_template_are_not_all_compared(spark, monkeypatch):
    """70 words of a template and 30 of their own: similarity 0.54, no link, but for two planted copies."""
    sent = []
    real = neardup.confirmed

    def counting(rows, sets, percent):
        sent.append(rows.count())
        return real(rows, sets, percent)

    monkeypatch.setattr(neardup, "confirmed", counting)
    rng = random.Random(5)
    shared = [f"t{i}" for i in range(70)]
    shares = {}
    for n in (1500, 3000):
        rows = [(i, " ".join(shared + [f"o{i}x{j}" for j in range(30)])) for i in range(n)]
        rows[n // 2] = (n // 2, rows[7][1].replace(f"o7x{rng.randrange(30)}", "changed"))
        rows[n - 1] = (n - 1, rows[9][1] + " more")
        sent.clear()
        got = neardup.near_duplicates(docs_of(spark, rows), 1, 80).collect()
        assert {r.doc_id: r.component_id for r in got if not r.kept} == {n // 2: 7, n - 1: 9}
        shares[n] = sum(sent) / n
    assert all(r < 4 for r in shares.values()), shares


def test_signatures_within_the_distance_always_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**14, (300, neardup.VALUES), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(neardup.VALUES, neardup.DISTANCE, replace=False)
        row[at] ^= rng.integers(1, 2**14, len(at), dtype=np.uint16)
    ka, kb = neardup.keys_of(a), neardup.keys_of(b)
    assert all((x == y).any() for x, y in zip(ka, kb, strict=True))
    assert ka.min() >= 0


def test_near_duplicates_with_far_signatures_that_share_a_key(spark):
    rng = random.Random(5)
    rows, pairs = [], []
    while len(pairs) < 4:
        w = prose(rng, 50, 10**6).split()
        v = [*w[:25], "edit", *w[26:]]  # 41 of 51 shingles in common
        a, b = (neardup.signature(neardup.shingles(" ".join(t).encode(), 5)) for t in (w, v))
        if (a != b).sum() > neardup.DISTANCE and (neardup.keys_of(a[None]) == neardup.keys_of(b[None])).any():
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    got = neardup.near_duplicates(docs_of(spark, rows), 5, 80).collect()
    assert sorted((r.component_id, r.doc_id) for r in got if not r.kept) == pairs


def test_near_duplicates_empty(spark):
    assert neardup.near_duplicates(docs_of(spark, EMPTY)).collect() == []


# ---------------------------------------------------------------- decontamination


def substring_distance(p, t):
    """Least edit distance of p to a substring of t: the whole table, a row for each character of p."""
    c = np.array([ord(x) for x in t], np.int64)
    place = np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, x in enumerate(p, 1):
        new = np.empty(len(t) + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (c != ord(x)), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def test_decontamination_brute_force(spark):
    rng = random.Random(13)
    items = [(i, prose(rng, 14)) for i in range(8)] + [(8, None), (9, ""), (10, "short one"), (11, prose(rng, 14).upper())]
    items.append((12, items[0][1]))
    rows = messy(rng)
    for i in range(20, 90):
        text = list(prose(rng, 12))
        hit = items[rng.choice([0, 1, 2, 3, 11])][1]
        edited = list(hit)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randrange(2)] = rng.choice(["", "z", "qq"])
        at = rng.randrange(len(text))
        text[at:at] = [" ", "\n".join("".join(edited).split(" ")), " "] if i % 4 else []
        rows.append((i, "".join(text)))
    rows += [(95, "Short \n one"), (96, "a short one here")]
    for i, n in ((97, 30_000), (98, 60_000)):  # very long texts, with an edited item far inside and another at the end
        far = items[1][1][:20] + "zz" + items[1][1][21:]
        rows.append((i, prose(rng, n // 10) + " " + far + " " + prose(rng, n // 5) + " " + items[2][1][1:]))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(docs_of(spark, rows, extra=True), bench).collect()}
    want = {}
    for d, text, *_ in rows:
        t = decontam.normal(text)
        for i, item in items:
            p = decontam.normal(item)
            if not p or not t:
                continue
            if len(p) < decontam.MIN_CHARS:
                if p == t:
                    want[d, i] = 0
            elif (best := substring_distance(p, t)) <= int(len(p) * decontam.BUDGET):
                want[d, i] = best
    assert got == want and 10 < len(want)
    left = {r.doc_id for r in decontam.clean(docs_of(spark, rows), bench).collect()}
    assert left == {r[0] for r in rows} - {d for d, _ in want}


def test_decontamination_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    rng = random.Random(2)
    items = [(i, prose(rng, 14)) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs_of(spark, [(i, "x " + t + " y") for i, t in items]), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(i, i, 0) for i in range(6)]
    blocks = list(decontam.item_blocks(bench))
    longest = max(len(t) for _, t in items)
    assert len(blocks) == 3 and all(sum(len(t) for _, t in b) < 100 + longest for b in blocks) and sum(map(len, blocks)) == 6
    assert decontam.leaks(docs_of(spark, EMPTY), bench).collect() == []
    assert decontam.leaks(docs_of(spark, [(1, "abc")]), bench.limit(0)).collect() == []


# ---------------------------------------------------------------- language ID


def test_language_id_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = langid.predict(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(held) > 30 and np.mean(held) > 0.95
    assert np.mean([r.rejected for r in got]) < 0.02
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_never_sees_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    spoiled = docs.withColumn("lang", F.when(langid.held_out(), "zz").otherwise(F.col("lang")))
    assert "zz" not in langid.fit(spoiled).langs


def test_language_fit_leaves_vectors_of_texts_to_the_executors(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    here, cluster = [], langid._cluster
    monkeypatch.setattr(langid, "_cluster", lambda x, k: here.append(len(x)) or cluster(x, k))
    model = langid.fit(docs)
    assert not here  # of the driver; tasks have a copy of the module
    assert model.langs == ["de", "en", "es", "fr"] and len(model.centroids) == len(model.owner) == 4 * langid.CENTROIDS
    assert np.allclose((model.centroids**2).sum(axis=1), 1, atol=1e-4) and (np.diff(model.floor) >= 0).all()


def test_language_id_messy_and_rejection(spark, small):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs)
    rows = messy(rng) + [(50, "漢字仮名交じり文の例です。" * 30, "ja")]
    got = sorted(langid.predict(docs_of(spark, rows, extra=True), model).collect(), key=repr)
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i in (1, 2, 3, 6):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[50].rejected and by[50].lang_pred in model.langs
    kept = langid.keep_known(docs_of(spark, rows, extra=True), model)
    assert kept.columns == docs_of(spark, rows, extra=True).columns
    assert kept.count() == sum(not r.rejected for r in got)
    nothing = docs_of(spark, EMPTY)
    assert langid.fit(nothing) is None and langid.predict(nothing, None).collect() == []
    assert {r.lang_pred for r in langid.predict(docs_of(spark, rows), None).collect()} == {"und"}


UNKNOWN = {
    "sw": "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. Kila mtu anastahili kuwa na haki zote na uhuru wote ambao umeelezwa katika taarifa hii bila ya ubaguzi.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek posiada wszystkie prawa i wolności.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Jokainen on oikeutettu kaikkiin oikeuksiin.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Herkes bu hak ve hürriyetlerden istifade edebilir.",
    "code": "def total(rows):\n    for key, value in rows.items():\n        if value is None:\n            continue\n        yield key, max(value)\nclass Store:\n    def __init__(self, path, mode):\n        self.path = path\n        self.open(mode, buffer=True)\n",
}


def test_language_id_rejects_unknown_languages_code_and_random_letters(spark, small):
    """Whole texts of 128 letters and more are rejected without exception, pieces of 40 letters at a rate of 3 in 5."""
    rng = random.Random(2)
    docs = spark.read.parquet(f"{small.replace('sf0.001', 'sf0.1')}/documents.parquet")
    nearest = langid.Nearest(langid.fit(docs))
    letters = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(n)) for n in (40, 200, 200)]
    unknown = [*UNKNOWN.values(), *letters]
    assert all(nearest(t)[2] for t in unknown), [nearest(t) for t in unknown]
    pieces = [t[at : at + 50] for t in unknown for at in range(0, len(t) - 50, 50)]
    assert np.mean([nearest(t)[2] for t in pieces]) > 0.6
    rows = docs.filter("lang is not null and text is not null").filter("doc_id % 4 = 0").select("text", langid.held_out().alias("held")).collect()
    assert np.mean([nearest(r.text)[2] for r in rows if r.held]) < 0.001
    texts = [r.text for r in rows if len(r.text) > 200]
    for n in (3, 6, 12, 25, 50, 100, 200):  # clean short texts
        assert np.mean([nearest(t[:n])[2] for t in texts]) < 0.02, n


def test_language_id_floor_of_few_texts_is_not_moved_by_one_odd_row():
    size, cosine = np.full(100, 300), np.linspace(0.5, 0.9, 100)
    clean = langid.floors(size, cosine)
    cosine[50] = 0.01
    assert np.abs(langid.floors(size, cosine) - clean).max() < 0.01
    assert langid.floors(np.full(3, 300), np.array([0.5, 0.6, 0.7]))[-1] == pytest.approx(0.3)


def test_language_id_floor_is_not_moved_by_one_odd_row():
    size, cosine = np.full(1000, 300), np.linspace(0.5, 0.9, 1000)
    clean = langid.floors(size, cosine)
    cosine[500] = 0.01
    assert np.allclose(langid.floors(size, cosine), clean, atol=0.01) and clean[-1] > 0.2 and (np.diff(clean) >= 0).all()
    assert np.allclose(langid.floors(np.zeros(50, int), np.full(50, 0.4)), 0.4 * langid.MARGIN)  # longer texts than any that was fitted on


def plain_grams(text):
    """Codes of the n-grams of a text, one at a time."""
    word, out = 2**64, Counter()
    only = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(only.split()) + (" " if only[-1] == " " else "") + " "
    cp = [ord(c) for c in t]
    one = [c * 0x9E3779B97F4A7C15 % word for c in cp]
    two = [(c * 0xC2B2AE3D27D4EB4F % word) ^ (one[i + 1] >> 7) for i, c in enumerate(cp[:-1])]
    three = [(c * 0x165667B19E3779F9 % word) ^ (one[i + 2] >> 3) for i, c in enumerate(two[:-1])]
    for g in (*one, *two, *three):
        out[(g * 0xD6E8FEB86659FD93 % word) >> 50] += 1
    return out


def test_language_id_against_dictionaries(spark, small):
    """Prediction, idf and centroids with plain dictionaries: every text gets the language of the nearest centroid by cosine."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.fit(docs, sample=10**6)
    rows = docs.select("doc_id", "text", "lang", langid.held_out().alias("held")).collect()
    fitted = [(r.lang, plain_grams(r.text)) for r in rows if not r.held and r.lang and r.text and any(c.isalpha() for c in r.text)]
    df = Counter(g for _, c in fitted for g in c)
    idf = {g: math.log((1 + len(fitted)) / (1 + n)) + 1 for g, n in df.items()}
    other = math.log(1 + len(fitted)) + 1

    def vector(c):
        v = {g: (1 + math.log(n)) * idf.get(g, other) for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()}

    # a centroid is the normalised sum of the fitted texts that are nearest to it
    for lang in model.langs:
        mine = [vector(c) for name, c in fitted if name == lang]
        own = [model.centroids[i] for i, n in enumerate(model.owner) if model.langs[n] == lang]
        near = [int(np.argmax([sum(x * c[g] for g, x in v.items()) for c in own])) for v in mine]
        for j, c in enumerate(own):
            total = Counter()
            for v, n in zip(mine, near, strict=True):
                if n == j:
                    total.update(v)
            size = math.sqrt(sum(x * x for x in total.values()))
            if size:
                assert sum(c[g] * x / size for g, x in total.items()) > 0.98  # the rounds are few
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in rows:
        if r.text and any(c.isalpha() for c in r.text):
            v = vector(plain_grams(r.text))
            cos = [sum(x * float(c[g]) for g, x in v.items()) for c in model.centroids]
            assert math.isclose(got[r.doc_id].score, min(1.0, max(cos)), abs_tol=1e-4)
            assert got[r.doc_id].lang_pred == model.langs[model.owner[int(np.argmax(cos))]] or max(cos) - sorted(cos)[-2] < 1e-4


# ---------------------------------------------------------------- toxicity


def test_toxicity_grades_and_messy_rows(spark):
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3
        words = prose(rng, 60, 300).replace("w", "wo").translate(str.maketrans("0123456789", "abcdefghij")).split()
        words[5:5] = [["", "nasty", "vile"][bad]] * (bad > 0)
        rows.append((i, " ".join(words)))
        labels.append((i, bad))
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, g int").withColumn("text", F.lit("x"))
    model = toxicity.fit(docs_of(spark, rows), table, F.col("g"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = {r.doc_id: r for r in toxicity.score(docs_of(spark, rows), model).collect()}
    assert np.mean([got[i].grade == g for i, g in labels]) > 0.97
    assert np.mean([got[i].toxic == (g > 0) for i, g in labels]) > 0.99
    odd = toxicity.score(docs_of(spark, messy(rng), extra=True), model).collect()
    assert len(odd) == len(messy(rng)) and all(0 <= r.severity <= 2 for r in odd)
    crowded = table.filter("doc_id < 9")
    crowded = table.union(crowded.crossJoin(spark.range(50)).drop("id"))
    again = toxicity.fit(docs_of(spark, [*rows, *rows[:9]]), crowded, F.col("g"))  # repeated labels and rows count once
    assert (again.at == model.at).all() and np.allclose(again.weight, model.weight) and np.allclose(again.thresholds, model.thresholds)
    none = toxicity.fit(docs_of(spark, rows), table.limit(0), F.col("g"))
    assert {r.severity for r in toxicity.score(docs_of(spark, rows[:5]), none).collect()} == {0.0}
    assert toxicity.score(docs_of(spark, EMPTY), model).collect() == []


def likelihood(rows, grade, weight, thresholds):
    """Mean negative log-likelihood of the cumulative-link model, with plain floats."""
    total = 0.0
    for (at, x), g in zip(rows, grade, strict=True):
        z = sum(weight.get(int(a), 0.0) * float(v) for a, v in zip(at, x, strict=True))
        above = [1.0, *(1 / (1 + math.exp(t - z)) for t in thresholds), 0.0]
        total -= math.log(above[g] - above[g + 1])
    return total / len(rows)


def test_ordinal_fit_is_a_minimum_of_the_penalised_likelihood():
    rng = random.Random(31)
    texts = [" ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(rng.randrange(1, 8))) for _ in range(400)]
    grade = np.array([min(2, max(0, t.count("alpha") - t.count("beta") + rng.randrange(-1, 2))) for t in texts])
    rows = [toxicity.features(t) for t in texts]
    penalty = 2e-3
    model = toxicity.fit_ordinal(rows, grade, penalty, 3000)
    weight = dict(zip(model.at.tolist(), model.weight.tolist(), strict=True))

    def cost(w, t):
        return likelihood(rows, grade, w, t) + penalty * sum(map(abs, w.values()))

    best = cost(weight, model.thresholds)
    for code in {int(a) for at, _ in rows for a in at}:
        for step in (-1e-2, 1e-2):
            assert cost(weight | {code: weight.get(code, 0.0) + step}, model.thresholds) >= best - 1e-7
    for j in range(2):
        for step in (-1e-2, 1e-2):
            t = model.thresholds.copy()
            t[j] += step
            assert cost(weight, t) >= best - 1e-7
    # predictions are those of the same model, taken apart
    for t in texts[:40]:
        at, x = toxicity.features(t)
        z = sum(weight.get(int(a), 0.0) * float(v) for a, v in zip(at, x, strict=True))
        assert np.allclose(model.exceed(t), [1 / (1 + math.exp(b - z)) for b in model.thresholds])
    assert list(model.thresholds) == sorted(model.thresholds) and len({np.round(w, 6) for w in weight.values()}) > 1


def test_toxicity_on_held_out_labels(spark, small):
    big = small.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    fitted = labels.filter("doc_id % 3 <> 0")
    model = toxicity.fit(docs, fitted, F.col("toxic"))
    got = {r.doc_id: r.toxic for r in toxicity.score(docs.filter("doc_id % 3 = 0"), model).collect()}
    held = [(r.toxic, got[r.doc_id]) for r in labels.filter("doc_id % 3 = 0").collect()]
    assert np.mean([g for t, g in held if t]) > 0.7 and np.mean([g for t, g in held if not t]) < 0.01


# ---------------------------------------------------------------- token counts


def test_token_counts_against_recount(spark):
    import regex
    import tiktoken

    ranks = tokencount.read_ranks(tokencount.VOCABULARY)
    whole = tiktoken.Encoding("t", pat_str=tokencount.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter, pattern = tokencount.Counter(ranks), regex.compile(tokencount.PATTERN)
    rng = random.Random(19)
    bits = ["word", " ", "  ", "\n", "'s", "'", "don't", "123", "!?", "é", "日本", "\t", "x", "<|endoftext|>", " the"]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(2 * rng.randrange(4)))
        edits = [(a, b, "".join(rng.choice(bits) for _ in range(rng.randrange(4)))) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        doc = tokencount.Document(text, counter, pattern)
        assert doc.total == len(whole.encode_ordinary(text))
        doc.edit(edits)
        out, at = [], 0
        for a, b, new in edits:
            out += [text[at:a], new]
            at = b
        edited = "".join([*out, text[at:]])
        assert doc.text == edited and doc.total == len(whole.encode_ordinary(edited)), (text, edits)
    long = "a lot of text " * 5000
    doc = tokencount.Document(long, counter, pattern)
    doc.edit([(100, 104, "MANY"), (50000, 50001, "")])
    assert doc.encoded < 40
    with pytest.raises(ValueError, match="sorted"):
        tokencount.Document("abc", counter, pattern).edit([(2, 3, ""), (0, 1, "")])


def test_token_counts_on_rows(spark):
    rng = random.Random(23)
    rows = [*messy(rng), (60, "mail a.b@c.org or 10.0.0.1 now, 12345678 and 12345678")]
    got = {r.doc_id: r for r in tokencount.count_tokens(docs_of(spark, rows, extra=True), redact=tokencount.PERSONAL).collect()}
    assert (got[1].n_tokens, got[2].n_tokens, got[1].n_edits) == (0, 0, 0)
    assert got[60].n_edits == 4 and got[60].n_tokens_edited != got[60].n_tokens
    ranks = tokencount.read_ranks(tokencount.VOCABULARY)
    n = len(tokencount.Counter(ranks).encoding.encode_ordinary("mail [redacted] or [redacted] now, [redacted] and [redacted]"))
    assert got[60].n_tokens_edited == n
    assert tokencount.count_tokens(docs_of(spark, EMPTY)).collect() == []


def test_redactions_cost_in_proportion():
    import time

    import regex

    counter, pattern = tokencount.Counter(tokencount.read_ranks(tokencount.VOCABULARY)), regex.compile(tokencount.PATTERN)
    found = regex.compile(tokencount.PERSONAL, regex.ASCII)
    cost = {}
    for n in (8_000, 80_000):
        text = " ".join(f"user{i}.name@host{i % 97}.org" for i in range(n))
        began = time.process_time()
        doc = tokencount.Document(text, counter, pattern)
        edits = tokencount.matches(text, found)
        assert len(edits) == n
        doc.edit(edits)
        cost[n] = time.process_time() - began
        assert doc.text == " ".join([tokencount.REDACTED] * n) and doc.encoded < 12 * n
    assert cost[80_000] < 40 * cost[8_000] and cost[80_000] < 60
    for odd in ("a" * 200_000, "a.b-" * 50_000, "a@" * 100_000, "1." * 100_000, "1" * 200_000):
        began = time.process_time()
        tokencount.matches(odd, found)
        assert time.process_time() - began < 5


def test_given_edits_and_no_pattern(spark):
    docs = docs_of(spark, [(1, "one two three"), (2, "one")])
    edits = F.when(F.col("doc_id") == 1, F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("1").alias("replacement"))))
    got = {r.doc_id: r for r in tokencount.count_tokens(docs, edits.cast(tokencount.EDITS)).collect()}
    assert (got[1].n_edits, got[2].n_edits) == (1, 0) and got[1].n_tokens_edited == 3
    with pytest.raises(ValueError, match="either"):
        tokencount.count_tokens(docs, edits, redact="x")
