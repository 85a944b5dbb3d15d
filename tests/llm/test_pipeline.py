"""The pipeline against a brute-force version of its stages."""

import math
from collections import Counter, defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F

from sinkwell.llm import decontam, langid

from .test_documents import UNKNOWN, brute_components, brute_mix, docs_of, messy, plain_grams, substring_distance

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def known(text, model):
    """Whether the cosine to the nearest centroid reaches the floor of the text's length, with plain dictionaries."""
    letters = sum(c.isalpha() for c in (text or "").lower())
    if not letters:
        return False
    v = {g: (1 + math.log(n)) * model.idf[g] for g, n in plain_grams(text).items()}
    size = math.sqrt(sum(x * x for x in v.values()))
    cosine = max(sum(x * float(c[g]) for g, x in v.items()) / size for c in model.centroids)
    return cosine >= model.floor[sum(letters >= n for n in langid.LENGTHS)]


def holds_an_item(text, items):
    t = " ".join(text.lower().split())
    return any(substring_distance(p, t) <= int(len(p) * decontam.BUDGET) if len(p) >= decontam.MIN_CHARS else p == t for p in items)


def test_texts_that_share_an_id_are_not_lost(spark, small):
    one, two = ("A text that stays, with words enough for shingles of five.", "Another one, which nothing else in the corpus is near to at all.")
    rows = [(1, one, "en", "a"), (5, one, "en", "a"), (5, two, "en", "a"), (5, two, "en", "b")]
    kept = [r.text for r in P.near_dedup(spark, docs_of(spark, rows), small).collect()]
    assert sorted(kept) == sorted([one, two])


def test_stages_are_the_ordered_five():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"] and P.ORACLE_SQL is None


def test_each_stage_on_its_own_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("component_id", F.lit("x"))
    odd = [(10**6 + i, t, None, "src0", len(t)) for i, t in enumerate(UNKNOWN.values())]
    docs = docs.unionByName(docs_of(spark, odd).withColumn("component_id", F.lit("x")))
    model = langid.fit(docs)
    stage = {}
    for name, f in P.STAGES:
        before, docs = docs, f(spark, docs, small)
        if name != "shard":
            assert docs.columns == before.columns
        stage[name] = (before, docs)

    before, after = stage["language_id"]
    assert sorted(rows_of(after), key=repr) == sorted((r for r in rows_of(before) if known(r[1], model)), key=repr)
    assert not {r[0] for r in rows_of(after)} & {r[0] for r in odd}

    before, after = stage["near_dedup"]
    rows = rows_of(before)
    assert sorted(r[0] for r in rows_of(after)) == sorted(i for i, _, c in brute_components(rows, 5, 80) if i == c)

    before, after = stage["decontaminate"]
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert sorted(rows_of(after)) == sorted(r for r in rows_of(before) if not holds_an_item(r[1], items))
    assert len(rows_of(after)) < len(rows_of(before))

    before, after = stage["mix"]
    mixed, had = Counter(rows_of(after)), set(rows_of(before))
    assert set(mixed) <= had and max(mixed.values()) <= 3
    names, sizes, target, total = brute_mix(rows_of(before))
    words = Counter()
    for r, n in mixed.items():
        words[r[3]] += n * len(r[1].encode().split())
    longest = max(len(r[1].split()) for r in had)
    assert all(target[s] - 12 <= words[s] <= target[s] + longest + 12 for s in names)

    before, after = stage["shard"]
    sizes, slots = Counter(), defaultdict(list)
    for r in after.collect():
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == before.count()
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_run_on_messy_rows(spark, small, tmp_path):
    import random

    from pyspark.sql import SparkSession  # noqa: F401

    rows = messy(random.Random(3))
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(P.run(spark, str(tmp_path)).collect()) > 0
    empty = tmp_path / "empty"
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(str(empty / f"{t}.parquet"))
    assert P.run(spark, str(empty)).collect() == []
