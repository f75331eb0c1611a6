"""Near-duplicate documents by b-bit MinHash: band candidates, similarities estimated from packed low bits with a
correction for collisions, and exact confirmation on full shingle sets.

Nothing here emits the pairs of a group. Members of a band's bucket, and later of a candidate cluster, are linked by a
spanning forest: a search from one member finds its neighbours among those not yet reached, so that each member costs one
comparison with what is left. Groups of more than BLOCK members, or of more than BLOCK_SHINGLES shingles in all, are dealt into blocks; each
block meets a few representatives of its group, and only members that these leave outside the group's main part meet all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import arrow_schema, batch_of, join_facts, rows_of, small_batches, written

BANDS, ROWS = 24, 5
N_HASHES = BANDS * ROWS
#: Low bits kept of each minimum; two unrelated minima agree in them with chance 1 / 2^BITS.
BITS = 8
#: Estimates lie this many standard deviations below the threshold once in ten million times.
SIGMAS = 5.0
#: Members of a group that are compared at once, and representatives that every block of a larger group meets.
BLOCK, REPRESENTATIVES = 1000, 64
#: Shingles of the members that are compared at once, about; representatives have half as many at most. Comparing takes some 60 bytes for each.
BLOCK_SHINGLES = 1 << 21
#: Edges up to which one task joins them to components.
FEW_EDGES = 100_000
#: A node of a graph is a hub from HUB edges and 1/HEAVY_PARTS of all on, so that there are fewer than HEAVY_PARTS.
HUB, HEAVY_PARTS = 250, 1024

_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**32, N_HASHES, dtype=np.uint32)[:, None] | np.uint32(1)
_B = _rng.integers(0, 2**32, N_HASHES, dtype=np.uint32)[:, None]


class _Words(dict):
    """Hashes of words; the memory of a worker stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; all its words as one if there are fewer than width."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes, both know ASCII only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([_words[w] for w in words], dtype=np.uint64)
    take = min(width, len(h))
    n = len(h) - take + 1
    out = np.full(n, take, dtype=np.uint64)
    for i in range(take):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, mixed, so that its low bits are even."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(N_HASHES, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 1024):  # short runs stay in the cache
        out = np.minimum(out, (x[i : i + 1024] * _A + _B).min(axis=1))
    return (out.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, with the band's number in it."""
    rows = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        key = (key ^ rows[:, j]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def packed(low: np.ndarray) -> bytes:
    """The BITS low bits of each minimum."""
    return (low & np.uint64(2**BITS - 1)).astype(np.uint8).tobytes()


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature to many: the share of equal entries, corrected for chance agreement."""
    chance = 2.0**-BITS
    return ((many == one).mean(axis=1) - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - SIGMAS * float(np.sqrt(s * (1 - s) / N_HASHES))


def forest(left: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges (from, to) of a spanning forest, each tree from its root on. near(i, rest): which of the rest are neighbours of i."""
    out = []
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            hit = near(i, left)
            found, left = left[hit], left[~hit]
            out += [(i, int(j)) for j in found]
            todo += found.tolist()
    return out


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The groups of rows that come sorted by their first n_keys columns."""
    left = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([left, rows]).combine_chunks() if left is not None else rows
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows, dtype=bool)
        for k in range(n_keys):
            key = rows.column(k).to_numpy()
            new[1:] |= key[1:] != key[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield rows.slice(a, b - a)
        left = rows.slice(cuts[-1])
    if left is not None:
        yield left


_FOUND = "group long, a long, b long"
Near = Callable[[int, np.ndarray], np.ndarray]


def _streamed(rows: DataFrame, keys: list[str], found: Callable[[pa.Table], list[tuple]]) -> DataFrame:
    """What found gives for each group of rows with equal keys; a task streams its groups."""
    schema = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group in sorted_groups(batches, len(keys)):
            out += found(group)
            if len(out) > 10_000:
                yield batch_of(out, schema)
                out = []
        yield batch_of(out, schema)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _FOUND)


def linked(members: DataFrame, payload: str, near_of: Callable[[list[bytes]], Near], most: int | None = None) -> DataFrame:
    """Edges (a, b) that connect what is linked in every group. members: group, its size and the weight of all its members, node, its own weight and the
    payload that near_of compares. most: the weight that is compared at once.

    A group of up to BLOCK members and of no more weight than that is compared in one place. A larger one is dealt into blocks, and every block meets the
    same members, REPRESENTATIVES at most and of half that weight, about. What is linked to the largest tree of these is connected already; the others
    meet every block, so that no link is lost.
    """
    if most is None:
        members = members.withColumns({"weight": F.col("size"), "own": F.lit(1).cast("long")})
    parts = lambda n, weight: F.ceil(n / BLOCK) if most is None else F.greatest(F.ceil(n / BLOCK), F.least(F.ceil(weight / most), n))
    dealt = members.withColumn("blocks", parts(F.col("size"), F.col("weight")).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    large = dealt.where("blocks > 1")
    h = F.xxhash64(F.lit(7), "node")
    reps = F.lit(REPRESENTATIVES) if most is None else F.greatest(F.lit(1), F.least(F.lit(REPRESENTATIVES), F.floor(most / 2 * F.col("size") / F.col("weight"))))
    chosen = large.groupBy("group", "blocks", F.pmod(h, reps).alias("place")).agg(F.min(F.struct(h.alias("h"), "node", payload)).alias("least"))
    copies = chosen.select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "least.node", f"least.{payload}", F.lit(1).alias("part"))
    rows = dealt.select("group", "block", "node", payload, F.when(F.col("blocks") > 1, 2).otherwise(0).alias("part")).unionByName(copies)

    def first(table: pa.Table) -> list[tuple]:
        nodes, part = table.column("node").to_pylist(), table.column("part").to_numpy()
        near = near_of(table.column(payload).to_pylist())
        if not part.any():
            return [(None, nodes[i], nodes[j]) for i, j in forest(np.arange(len(nodes)), near)]
        group, out = table.column("group")[0].as_py(), []
        reps, others = np.array(sorted(np.flatnonzero(part == 1), key=nodes.__getitem__)), np.flatnonzero(part == 2)
        trees = {int(i): [int(i)] for i in reps}  # by root; the same in each block, since representatives come in the same order
        root = {i: i for i in trees}
        for i, j in forest(reps, near):
            root[j] = root[i]
            trees[root[i]] += trees.pop(j)
            out.append((None, nodes[i], nodes[j]))
        main = max(trees, key=lambda r: len(trees[r]))
        for own, tree in trees.items():
            hits = np.zeros(len(others), dtype=bool)
            for i in tree:
                left = np.flatnonzero(~hits)
                hits[left[near(i, others[left])]] = True
            out += [(None, nodes[j], nodes[own]) for j in others[hits]]
            if own == main:
                out += [(group, nodes[j], None) for j in others[~hits]]
        return out

    found = written(_streamed(rows, ["group", "block"], first), "near-found")
    edges, outside = found.where("b is not null").select("a", "b"), found.where("b is null").select("group", F.col("a").alias("node"))
    if outside.isEmpty():
        return edges

    mine = large.select("group", "node", "own").join(outside, ["group", "node"]).groupBy("group").agg(parts(F.count(F.lit(1)), F.sum("own")).cast("int").alias("own_blocks"))
    again = large.drop("own").join(mine, "group").join(outside.withColumn("apart", F.lit(True)), ["group", "node"], "left")
    every = again.select("group", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("own"), "block", "node", payload, F.when(F.col("apart"), 1).otherwise(2).alias("part"))
    asked = again.where("apart").withColumn("own", F.pmod(F.xxhash64(F.lit(9), "node"), F.col("own_blocks")).cast("int"))
    asked = asked.select("group", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", payload, F.lit(0).alias("part"))

    def second(table: pa.Table) -> list[tuple]:
        nodes, part = table.column("node").to_pylist(), table.column("part").to_numpy()
        asks, inside = np.flatnonzero(part == 0), np.flatnonzero(part == 2)
        if not len(asks):
            return []
        near = near_of(table.column(payload).to_pylist())
        out = [(None, nodes[i], nodes[j]) for i, j in forest(np.flatnonzero(part < 2), near)]
        for i in asks:  # the main part is connected: one link to it is enough
            hits = inside[near(int(i), inside)] if len(inside) else inside
            out += [(None, nodes[i], nodes[j]) for j in hits[:1]]
        return out

    more = _streamed(every.unionByName(asked), ["group", "own", "block"], second)
    return edges.unionByName(more.select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of an edge reaches, by alternating large-star and small-star steps.

    Where a node has a large share of the edges, such nodes, fewer than HEAVY_PARTS, are joined by a broadcast, so that none gathers in a task.
    """

    def star(pairs: DataFrame, large: bool, most: float | None) -> DataFrame:
        if large:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        if most is None:
            to_least = both.join(least.drop("n"), "a")
        else:
            hubs = F.broadcast(least.where(F.col("n") > most).select("a", "m"))
            to_least = both.join(hubs, "a").unionByName(both.join(hubs, "a", "left_anti").join(least.where(F.col("n") <= most).select("a", "m"), "a"))
        if large:
            to_least = to_least.where("b > a")
        out = to_least.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def told(pairs: DataFrame) -> tuple[tuple, float | None]:
        """What tells a state from another, and from how many edges on a node is a hub, if any is."""
        n, sum_, most = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("s")).agg(F.sum("n"), F.sum("s"), F.max("n")).first()
        limit = max(HUB, 2 * (n or 0) / HEAVY_PARTS)
        return (n, sum_), limit if (most or 0) > limit else None

    def at_once(pairs: DataFrame) -> DataFrame:
        """Few edges, in one task."""

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while (y := up.setdefault(x, x)) != x:
                    up[x] = x = up[y]
                return x

            for batch in batches:
                for a, b in rows_of(batch):
                    a, b = sorted((top(a), top(b)))
                    up[b] = a
            yield batch_of([(x, top(x)) for x in [*up]], arrow_schema("node long, label long"))

        return pairs.coalesce(1).mapInArrow(joined, "node long, label long")

    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state, (now, most) = None, told(edges)
    while now != state and now[0]:
        if now[0] <= FEW_EDGES:
            return written(at_once(edges), "cc-labels")
        state = now
        edges = written(star(star(edges, True, most), False, None), "cc")
        now, most = told(edges)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def _by_signature(least: float) -> Callable[[list[bytes]], Near]:
    def near_of(group: list[bytes]) -> Near:
        marks = np.frombuffer(b"".join(group), dtype=np.uint8).reshape(len(group), -1)
        return lambda i, rest: estimate(marks[i], marks[rest]) >= least

    return near_of


def _by_sets(percent: int) -> Callable[[list[bytes]], Near]:
    def near_of(group: list[bytes]) -> Near:
        sets = [np.frombuffer(b, dtype=np.uint64) for b in group]
        sizes = np.array([len(s) for s in sets])
        # an inverted index of the group: the members of each shingle, so that one search counts all intersections
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(ids, np.cumsum(sizes)[:-1])
        order = np.argsort(ids, kind="stable")
        members, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            if len(rest) < 8:
                shared = np.array([len(np.intersect1d(own[i], own[j], assume_unique=True)) for j in rest])
            else:
                lists = [members[starts[t] : starts[t + 1]] for t in own[i]]
                shared = np.bincount(np.concatenate(lists), minlength=len(sets))[rest]
            return 100 * shared >= percent * (sizes[i] + sizes[rest] - shared)

        return near

    return near_of


def _signed(text: Column, width: int) -> Column:
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for t in texts:
                found = shingles(t, width)
                if len(found):
                    whole = found.tobytes()
                    low = minima(found)
                    out.append((len(found), xxhash.xxh3_128_digest(whole), packed(low), band_keys(low).tolist()))
                else:
                    out.append((0, None, None, None))
            yield pd.DataFrame(out, columns=["n_shingles", "same", "bits", "bands"])

    return F.pandas_udf(sign, "n_shingles long, same binary, bits binary, bands array<long>")(text)


_SETS = "at long, same binary, found binary"


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """The full sets of (doc_id, text) rows. A row map, so that no filter on its input is moved behind it."""
    schema = arrow_schema(_SETS)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(node, shingles(text, width).tobytes()) for node, text in rows_of(batch)]
            yield batch_of([(node, xxhash.xxh3_128_digest(b), b) for node, b in found], schema)

    return texts.mapInArrow(whole, _SETS)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """For each row: doc_id, n_shingles long, component_id long, kept boolean, text_hash long (xxhash64, which with the id tells rows apart).

    Documents are linked where 100 * intersection >= percent * union of their sets of distinct word shingles, A-Z
    lower-cased; with fewer than width words, the whole sequence is the one shingle. component_id is the smallest id
    of those that a document reaches over links. A null or empty text, or one of white space only, has no set and is linked with
    nothing. Exact copies, and texts with equal sets, are one class from the start, and what is linked are classes, never ids. A null id is linked with
    nothing either: its component_id is null and it is kept. Rows that repeat an id are documents of their own: each belongs to the component of its own
    text, and is kept if its id is the smallest there. Very long texts are compared whole. Other columns are ignored, whatever their names; an empty table
    gives no rows.

    A link at the threshold is missed by all bands with chance (1 - s^5)^24, under one in a million for s = 0.85 and
    under one in ten thousand for s = 0.8. Confirmed links are exact.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(texts.select("doc_id", text_hash(F.col("text")).alias("text_hash"), _signed(F.col("text"), width).alias("m")).select("doc_id", "text_hash", "m.*"), "near-signed")
    with_set = signed.where("doc_id is not null AND n_shingles > 0")
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = with_set.groupBy("same").agg(first.alias("first"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.first("n_shingles").alias("own"), F.count(F.lit(1)).alias("n"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")

    bands = classes.select("node", F.explode("bands").alias("group"))
    crowded = written(bands.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-crowded")
    in_bands = bands.join(crowded, "group").join(classes.select("node", "bits"), "node")
    candidates = components(linked(in_bands, "bits", _by_signature(least_estimate(percent))))
    clusters = written(candidates.select(F.col("label").alias("group"), "node"), "near-clusters")

    # the full sets of candidates only are made again, of one row of each class
    own = classes.select("same", "node", "own", "first.*").join(clusters, "node")
    own = written(own.join(own.groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("own").alias("weight")), "group"), "near-own")
    rows = texts.withColumn("text_hash", text_hash(F.col("text"))).join(own.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi")
    found = _sets(rows.select("doc_id", "text"), width)
    members = found.join(own, "same").where(F.col("at") == F.col("doc_id")).dropDuplicates(["same"]).select("group", "size", "weight", "node", "own", "found")
    links = components(linked(members, "found", _by_sets(percent), BLOCK_SHINGLES))

    labels = classes.select("same", "node", "n", F.col("first.doc_id").alias("id")).join(links, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labels.groupBy("label").agg(F.min("id").alias("component_id"))
    named = written(labels.join(smallest, "label").select("same", "n", "component_id"), "near-named")
    # copies of one text are many rows of one class: large classes are broadcast, and rows without a class don't meet any
    in_class = join_facts(with_set.select("doc_id", "n_shingles", "text_hash", "same"), named.drop("n"), "same", named.select("same", "n"))
    alone = signed.where("doc_id is null OR n_shingles = 0").select("doc_id", "n_shingles", "text_hash", F.col("doc_id").alias("component_id"))
    out = in_class.select(*alone.columns).unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
