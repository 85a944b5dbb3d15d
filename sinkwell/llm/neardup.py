r"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct shingles of ``k`` words.  Equal sets form a class, of which one document goes on.  A class
has a signature of 40 MinHash values of 14 bits.  The distance of two signatures is the number of values that differ; it
grows with 1 - similarity.  The signature is cut into 8 chunks of 5 values.  Two signatures at a distance of at most
``DISTANCE`` = 15 must have a chunk with at most one differing value (pigeonhole: 8 chunks with two each make 16), so a row is
indexed under every chunk with every single value left out, 40 keys.  A farther pair often shares a key too; whoever shares one
is compared on the full sets, whatever the distance.  So a pair is missed only if it shares none of these keys: at a similarity
of 0.85 with a probability of 6e-7, at 0.8 with 2e-5.

Rows under a key are not paired with one another.  The least class of a key is its leader; the distinct (leader, class) rows say
who meets whom.  All classes of a leader's group must be compared, but no pair that is known to be connected:

1. Every class meets its least leader only, in blocks of bounded size, each with the leader: one row a class.
2. A large group in which not all are connected then compares the rest with the classes that had most links in their
   blocks: the original of a family of copies, say.  One row for each class of the rest.
3. What is still open may be pages of one template that no link joins.  There, pairs are looked for anew by rare shingles: of two linked sets each has a
   shingle of the other among its first n - ceil(n * percent / 100) + 1, whatever the order of all shingles, and with the rarest first these are not
   those of the template.  The groups of a shared rare shingle start with their least leader again, and where that leaves them open, the classes outside
   of a group's largest component meet all blocks.

Comparisons are made on the full sets (shingles hashed to 64 bits), which are made once per class and sent in place of
texts.  Only a spanning forest of the confirmed links is kept: a family of n near copies sends about n rows and gives n rows, and no
link between different texts is lost for the components.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; in
``near_duplicates`` rows with a null doc_id are linked with nothing and have a null component, and rows sharing a doc_id are one document
with several texts, which has one component; ``keep_one`` decides by row, so texts that share a doc_id are kept or dropped apart, and
rows with an empty set all stay; extra columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, small_batches, stored
from .components import components
from .groups import ship, sorted_groups

CHUNKS, WIDTH, BITS = 8, 5, 14
VALUES = CHUNKS * WIDTH
#: Two signatures this near always share a key; farther ones may.
DISTANCE = 2 * CHUNKS - 1
#: Rows and shingles of one block of a group.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 400_000
#: Classes with most links that the rest of a large group is compared with.
HUBS = 8

MULTIPLIERS = np.random.Generator(np.random.PCG64(9)).integers(2**63, size=VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.random.Generator(np.random.PCG64(10)).integers(2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, k: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(k, n)
    out = np.full(n - width + 1, 0 if n >= k else width, np.uint64)
    for i in range(width):
        out += h[i : n - width + 1 + i] * MIX[i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(least, (MULTIPLIERS[:, None] * s[None, at : at + 4096]).min(axis=1), out=least)
    return ((least >> np.uint64(8)) & np.uint64(2**BITS - 1)).astype(np.uint16)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(b.num_columns - 1).to_pylist():
                s = shingles(text, k)
                fp = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((len(s), (fp >> 64) - 2**63, (fp & (2**64 - 1)) - 2**63, signature(s).tobytes() if len(s) else None))
            n, f1, f2, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
            made = [pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "n_shingles", "f1", "f2", "sig"])

    return run


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit name (h1, h2) of doc_id and text, a hash ``rest`` of all other columns, and the text as bytes."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    names = F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(7), "doc_id", "text")
    return docs.select("doc_id", names[0].alias("h1"), names[1].alias("h2"), F.xxhash64(F.lit(0), *others).alias("rest"), F.col("text").cast("binary").alias("text"))


def sketches(rows: DataFrame, k: int = 3) -> DataFrame:
    """``rows``, whose last column is the text, with n_shingles, fingerprint (f1, f2) of the set and signature in its place."""
    fields = [*rows.schema.fields[:-1], *(T.StructField(n, T.LongType()) for n in ("n_shingles", "f1", "f2")), T.StructField("sig", T.BinaryType())]
    return rows.mapInArrow(_sketch(k), T.StructType(fields))


def classes_of(sketched: DataFrame, first: Column) -> DataFrame:
    """One row for each set that is not empty: cid (a number of its own), f1, f2, n_shingles, sig and the least ``first`` of its rows."""
    rows = sketched.filter("n_shingles > 0").groupBy("f1", "f2")
    rows = rows.agg(F.min(first).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    return stored(rows.withColumn("cid", F.monotonically_increasing_id()), "classes")


def keys_of(sig: np.ndarray) -> np.ndarray:
    """All 40 keys of each row of signatures: which chunk, which value is left out, the other four."""
    parts = sig.astype(np.int64).reshape(-1, CHUNKS, WIDTH)
    out = np.empty((len(sig), CHUNKS, WIDTH), np.int64)
    for gap in range(WIDTH):
        key = np.zeros(parts.shape[:2], np.int64)
        for i in range(WIDTH):
            if i != gap:
                key = (key << BITS) | parts[:, :, i]
        out[:, :, gap] = key | ((np.arange(CHUNKS) * WIDTH + gap) << (BITS * (WIDTH - 1)))
    return out.reshape(len(sig), -1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, VALUES)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        k = keys_of(_matrix(b.column(1)))
        ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), k.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(ids, pa.int64())], ["key", "id"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays."""
    n = len(sets)
    out = np.zeros((n, n))
    if n <= 6:
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = np.intersect1d(sets[i], sets[j], assume_unique=True).size
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = max(64, 8_000_000 // n)
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [low, low + width])
        x = np.zeros((n, min(width, int(code[-1]) + 1 - low)), np.float32)
        x[owner[a:b], code[a:b] - low] = 1
        out += x @ x.T
    return out


def forest(linked: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(least id of its tree, id) for every linked row of a symmetric matrix."""
    label = np.arange(len(ids))
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    label = rank.copy()
    reach = linked | np.eye(len(ids), dtype=bool)
    while True:
        new = np.where(reach, label[None, :], len(ids)).min(axis=1)
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    return [(int(ids[order[t]]), int(ids[i])) for i, t in enumerate(label) if order[t] != i and ids[order[t]] != ids[i]]


def _shingle_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "n_shingles", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 2):
            ids = g.column("id").to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in g.column("shingles").to_pylist()]
            both = intersections(sets)
            size = np.array([len(s) for s in sets], np.float64)
            joint = size[:, None] + size[None, :] - both
            linked = (100 * both >= percent * joint) & (both > 0)
            rows = [(a, b, None) for a, b in forest(linked, ids)]
            if rows and g.column("hub")[0].as_py():
                n = linked.sum(axis=1)
                rows.append((int(ids[n.argmax()]), None, int(n.max())))
            if rows:
                a, b, n = zip(*rows, strict=True)
                lead = pa.array([g.column("lead")[0].as_py()] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([lead, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["lead", "a", "b", "n"])

    return run


def confirmed(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Compare all ``rows`` (lead, part, id, hub) that meet: links (lead, a, b), and with ``hub`` the row of most links, with their number n."""
    met = rows.join(sets.select("id", "shingles").hint("merge"), "id").select("lead", "part", "id", "hub", "shingles")
    met = met.repartition("lead", "part").sortWithinPartitions("lead", "part")
    return stored(met.mapInArrow(_confirm(percent), "lead long, a long, b long, n long"), "links")


def blocks_of(rows: DataFrame) -> DataFrame:
    """lead, rows and the number of blocks of bounded size for each group of ``rows`` (lead, id, n_shingles)."""
    sizes = rows.groupBy("lead").agg(F.count("*").alias("rows"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES), F.lit(1))
    return stored(sizes.select("lead", "rows", blocks.cast("int").alias("blocks")), "blocks")


def _own(blocks: Column | str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(blocks).cast("long")).cast("int")


def candidate_members(classes: DataFrame) -> DataFrame:
    """The distinct (lead, id) of all classes that share a key with another one; nothing is dropped before the full sets."""
    keys = classes.select("cid", "sig").mapInArrow(_keys, "key long, id long")
    # stored, so that both sides of the join below are plain exchanges and a hot key can be split
    leaders = stored(keys.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n"), "leaders")
    # both sides grow with the corpus: the same shuffled join at every size
    return stored(keys.join(leaders.hint("merge"), "key").select("lead", "id").distinct(), "members")


def candidate_sets(members: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id, n_shingles and shingles of every candidate class, from the text of one of its rows."""
    wanted = members.select("id").distinct().join(classes.select(F.col("cid").alias("id"), "rep.h1", "rep.h2"), "id")
    texts = wanted.hint("merge").join(docs.select("h1", "h2", "text"), ["h1", "h2"]).select("id", "text")
    one = texts.groupBy("id").agg(F.first("text").alias("text"))  # equal rows have equal texts
    return stored(one.mapInArrow(_shingle_sets(k), "id long, n_shingles long, shingles binary"), "sets")


def first_meetings(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every class with its least leader, in blocks that each hold the leader: (lead, part, id, hub), and the groups' blocks."""
    rows = members.groupBy("id", "n_shingles").agg(F.min("lead").alias("lead"))
    groups = blocks_of(rows.filter("id <> lead"))
    own = rows.filter("id <> lead").join(groups, "lead").select("lead", _own("blocks").alias("part"), "id", (F.col("blocks") > 1).alias("hub"))
    heads = groups.select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("lead").alias("id"), (F.col("blocks") > 1).alias("hub"))
    return own.union(heads), groups


def still_open(members: DataFrame, labels: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The members, with their label, of the groups that are not connected; groups that ``done`` (lead, rows, blocks) compared in full are not open."""
    named = members.join(labels, "id", "left").select("lead", "id", "n_shingles", F.coalesce("component", "id").alias("label"))
    groups = named.groupBy("lead").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).filter("low <> high")
    if done is not None:
        full = done.filter("blocks = 1").select("lead", (F.col("rows") + 1).alias("n"))
        groups = groups.join(full, ["lead", "n"], "left_anti")
    return stored(named.join(stored(groups.select("lead"), "leads"), "lead"), "open")


def hub_meetings(rest: DataFrame, found: DataFrame, labels: DataFrame) -> DataFrame:
    """The open classes of large groups with the hubs of their group, but for those connected with the first hub."""
    rank = F.row_number().over(W.partitionBy("lead").orderBy(F.desc("n"), "a"))
    hubs = found.filter("n is not null").select("lead", "a", rank.alias("rank")).filter(F.col("rank") <= HUBS)
    hubs = stored(hubs.join(labels, hubs["a"] == labels["id"], "left").select("lead", "a", "rank", F.coalesce("component", "a").alias("main")), "hubs")
    first = hubs.filter("rank = 1").select("lead", "main")
    outer = rest.join(first, "lead").filter("label <> main").select("lead", "id", "n_shingles")
    groups = blocks_of(outer)
    own = outer.join(groups, "lead").select("lead", _own("blocks").alias("part"), "id", F.lit(False).alias("hub"))
    heads = groups.join(hubs, "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("a").alias("id"), F.lit(False).alias("hub"))
    return own.union(heads).distinct()


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(s, np.int64) for s in b.column(3).to_pylist()]
        size = [len(s) for s in sets]
        columns = [np.repeat(b.column(i).to_numpy(zero_copy_only=False), size) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))], ["id", "n_shingles", "outer", "shingle"])


def sides_of(rest: DataFrame) -> DataFrame:
    """``rest`` with ``outer``: whether a class is outside of the largest component of its group."""
    counts = rest.groupBy("lead", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("lead").agg(F.max(F.struct("n", "label")).alias("top")).select("lead", F.col("top.label").alias("main"))
    return rest.join(stored(main, "main"), "lead").withColumn("outer", F.col("label") != F.col("main"))


def rare_members(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(lead, id, n_shingles) of the open classes that share a rare shingle with an outer one, the least of a shingle leading.

    Shingles are ordered by the number of outer classes that hold them.  Every pair that is still to be compared has an outer class; linked, both
    hold one of the same shingles among their first ones, so they are in one group.
    """
    ids = stored(sides_of(rest).groupBy("id").agg(F.bool_or("outer").alias("outer")), "open_ids")
    rows = ids.join(sets.hint("merge"), "id").select("id", "n_shingles", "outer", "shingles").mapInArrow(_exploded, "id long, n_shingles long, outer boolean, shingle long")
    often = stored(rows.filter("outer").groupBy("shingle").agg(F.count("*").alias("often")), "often")
    own = rows.join(often.hint("merge"), "shingle").groupBy("id", "n_shingles", "outer").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("s"))
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    left = F.greatest(first - (F.col("n_shingles") - F.size("s")), F.lit(0)).cast("int")  # shingles that no outer class holds come before all others
    keys = own.select("id", "n_shingles", "outer", F.explode(F.slice("s", F.lit(1), left)).alias("k")).select("id", "n_shingles", "outer", "k.shingle")
    keys = stored(keys, "rare")
    leaders = keys.groupBy("shingle").agg(F.min("id").alias("lead"), F.count("*").alias("n"), F.bool_or("outer").alias("any")).filter("n > 1 and any").select("shingle", "lead")
    return stored(keys.join(stored(leaders, "leaders").hint("merge"), "shingle").select("lead", "id", "n_shingles").distinct(), "members")


def last_meetings(rest: DataFrame) -> DataFrame:
    """All pairs of blocks of the open groups, but for two blocks of the group's largest component."""
    sides = sides_of(rest)
    size = [F.greatest(F.ceil(F.sum(F.when(c, 1)) / BLOCK_ROWS), F.ceil(F.sum(F.when(c, F.col("n_shingles"))) / BLOCK_SHINGLES)).cast("int") for c in (~F.col("outer"), F.col("outer"))]
    one = (F.count("*") <= BLOCK_ROWS) & (F.sum("n_shingles") <= BLOCK_SHINGLES)
    groups = stored(sides.groupBy("lead").agg(size[0].alias("inner_blocks"), size[1].alias("outer_blocks"), one.alias("one")), "sides")
    rows = sides.join(groups, "lead").withColumn("all", F.col("inner_blocks") + F.col("outer_blocks"))
    own = F.when(F.col("outer"), F.col("inner_blocks") + _own("outer_blocks")).otherwise(_own("inner_blocks"))
    rows = rows.withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), lambda j: (j != F.col("own")) & (F.col("outer") | (j >= F.col("inner_blocks"))))
    parts = F.transform(others, lambda j: F.least(j, F.col("own")) * F.col("all") + F.greatest(j, F.col("own")))
    parts = F.when(F.col("one"), F.array(F.lit(0))).otherwise(parts)
    return rows.select("lead", F.explode(parts).alias("part"), "id", F.lit(False).alias("hub"))


def connected(classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component) of the classes that are linked, but for the least of each component; ``docs`` are identified rows."""
    members = candidate_members(classes)
    sets = candidate_sets(members, classes, docs, k)
    members = stored(members.join(sets.select("id", "n_shingles"), "id"), "sized")
    meetings, groups = first_meetings(members)
    found = confirmed(meetings, sets, percent)
    labels = components(found.filter("b is not null").select("a", "b"))
    rest = still_open(members, labels, groups)
    large = groups.filter("blocks > 1").select("lead")
    many = stored(rest.join(large, "lead", "left_semi"), "many")
    if not many.isEmpty():
        more = confirmed(hub_meetings(many, found, labels), sets, percent)
        labels = components(more.filter("b is not null").select("a", "b").union(labels.select("component", "id")))
        rest = still_open(rest.drop("label"), labels)
    if not rest.isEmpty():
        near = rare_members(rest, sets, percent)
        meetings, groups = first_meetings(near)
        more = confirmed(meetings, sets, percent)
        labels = components(more.filter("b is not null").select("a", "b").union(labels.select("component", "id")))
        rest = still_open(near, labels, groups)
        if not rest.isEmpty():
            more = confirmed(last_meetings(rest), sets, percent)
            labels = components(more.select("a", "b").union(labels.select("component", "id")))
    release(members, sets, found)
    return labels


def least_of(labels: DataFrame, classes: DataFrame, value: Column) -> DataFrame:
    """cid and the least ``value`` of its component (``least``), for the classes that are linked."""
    linked = labels.select(F.col("id").alias("cid"), "component").union(labels.select("component", "component").distinct())
    best = linked.join(classes.select("cid", value.alias("value")), "cid").groupBy("component").agg(F.min("value").alias("least"))
    return linked.join(stored(best, "best"), "component").select("cid", "least")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``.

    Documents are linked where 100 * intersection >= percent * union of their sets of ``k``-word shingles.
    """
    small_batches(docs.sparkSession)
    named = identified(docs.select("doc_id", "text"))
    sketched = stored(sketches(named.drop("rest"), k), "sketches")
    known = sketched.filter(F.col("doc_id").isNotNull())
    classes = classes_of(known, F.struct("doc_id", "h1", "h2"))
    labels = connected(classes, named.filter(F.col("doc_id").isNotNull()), k, percent)
    # every row with its class; rows that share a doc_id connect their classes
    rows = known.select("doc_id", "n_shingles", "f1", "f2").join(classes.select("f1", "f2", "cid", F.col("rep.doc_id").alias("low")), ["f1", "f2"], "left")
    rows = stored(rows.select("doc_id", "n_shingles", "cid", "low"), "rows")
    shared = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("cid").alias("first"), F.max("cid").alias("last"), F.count("cid").alias("sets"))
    shared = stored(shared.filter("n > 1 and sets > 0 and (first <> last or sets < n)").select("doc_id", "first"), "shared")
    if not shared.isEmpty():
        rows = rows.join(shared, "doc_id", "left")
        ties = rows.filter("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))
        labels = components(ties.union(labels.select("component", "id")))
        low = classes.select(F.col("cid").alias("first"), F.col("rep.doc_id").alias("first_low"))
        rows = rows.join(low, "first", "left").select("doc_id", "n_shingles", F.coalesce("cid", "first").alias("cid"), F.coalesce("low", "first_low").alias("low"))
    names = stored(least_of(labels, classes, F.col("rep.doc_id")), "names")
    out = rows.join(names, "cid", "left").select("doc_id", "n_shingles", F.coalesce("least", "low", "doc_id").alias("component_id"))
    loose = sketched.filter(F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(loose).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of each group of near copies: that of the least doc_id (null last), then of least hash.

    Decisions are made by row: a text without a near copy stays, whatever other rows share its doc_id.
    """
    small_batches(docs.sparkSession)
    named = identified(docs)
    sketched = stored(sketches(named, k), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "rest")
    classes = classes_of(sketched, order)
    names = stored(least_of(connected(classes, named, k, percent), classes, F.col("rep")), "names")
    best = classes.join(names, "cid", "left").filter(F.col("least").isNull() | F.col("least").eqNullSafe(F.col("rep")))
    keys = ["h1", "h2", "rest"]
    chosen = best.select("rep.h1", "rep.h2", "rep.rest").withColumn("words", F.lit(True))
    empty = sketched.filter("n_shingles = 0").select(*keys).distinct().withColumn("words", F.lit(False))
    chosen = stored(chosen.union(empty), "chosen")
    row = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(7), "doc_id", "text").alias("h2"))
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    met = row.withColumn("rest", F.xxhash64(F.lit(0), *others)).join(chosen.hint("merge"), keys)
    # of rows that agree in all columns one stays, or all of them where there are no words
    same = met.groupBy(*keys).agg(F.first("row").alias("row"), F.when(F.max("words"), 1).otherwise(F.count("*").cast("int")).alias("n"))
    return same.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


ship(__name__)
