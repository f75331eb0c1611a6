"""Graph operators: bounded traversal, paths, impact, cycles and personalised PageRank as loops of joins.

A loop's frontier is written to the shared folder at each step, so that lineage stays short and a lost executor costs a
reread. Frontiers are joined, never collected; Spark broadcasts one only where its size is known to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.operators.storage import materialised

def reach(edges: DataFrame, seeds: DataFrame, depth: int, *, stop: Column | None = None, directed: bool = True) -> DataFrame:
    """(id, depth): nodes within `depth` edges of any seed (a column id), by shortest distance.

    stop: a condition over `id`; such nodes are reached but not left.
    """
    pairs = edges.select("source", "target")  # steps are made distinct, so that pairs needn't be
    if not directed:
        pairs = pairs.unionByName(reverse(pairs))
    seen = materialised(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        go = frontier if stop is None else frontier.where(~stop | (F.col("depth") == 0))
        step = pairs.join(go.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        frontier = materialised(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *[c for c in edges.columns if c not in ("source", "target")])


def shortest_paths(edges: DataFrame, seed: Column, depth: int) -> DataFrame:
    """(id, depth, path): a shortest path from the seed to each node within depth; of several, the first in order."""
    pairs = edges.select("source", "target").distinct()
    seen = materialised(pairs.select(seed.alias("id")).limit(1).withColumns({"depth": F.lit(0), "path": F.array("id")}))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("source"), "path").join(pairs, "source").join(seen.select(F.col("id").alias("target")), "target", "left_anti")
        found = step.groupBy(F.col("target").alias("id")).agg(F.min("path").alias("path"))
        frontier = materialised(found.select("id", F.lit(d).alias("depth"), F.concat("path", F.array("id")).alias("path")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def cycle_members(edges: DataFrame) -> DataFrame:
    """(id): nodes that lie on a cycle, of any length.

    Nodes without an edge in or out are peeled off until none is left to peel; of what stays, a node lies on a cycle if a smallest label that goes
    forward and one that goes backward meet in it. Labels of decided parts are taken out and the rest is gone through again.
    """
    pairs = materialised(edges.select("source", "target").where("source <> target").distinct(), "cycle")
    found = pairs.select(F.col("source").alias("id")).limit(0)
    while True:
        pairs = _peeled(pairs)
        if pairs.isEmpty():
            return found.distinct()
        ahead, behind = _least_reaching(pairs), _least_reaching(reverse(pairs))
        both = ahead.withColumnRenamed("label", "ahead").join(behind.withColumnRenamed("label", "behind"), "id").where("ahead = behind")
        parts = materialised(both.select("id", F.col("ahead").alias("part")), "cycle-parts")
        large = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
        found = materialised(found.unionByName(parts.join(large, "part", "left_semi").select("id")), "cycle-found")
        gone = parts.select("id")
        pairs = pairs.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti").select("source", "target")
        pairs = materialised(pairs, "cycle")


def _peeled(pairs: DataFrame) -> DataFrame:
    """Pairs between nodes that have edges both in and out, over and over."""
    n = None
    while n != (n := pairs.count()) and n:
        heads, tails = pairs.select("target").distinct(), pairs.select("source").distinct()
        kept = pairs.join(heads.withColumnRenamed("target", "source"), "source", "left_semi").join(tails.withColumnRenamed("source", "target"), "target", "left_semi")
        pairs = materialised(kept.select("source", "target"), "cycle-peeled")
    return pairs


def _least_reaching(pairs: DataFrame) -> DataFrame:
    """(id, label): the smallest node from which each node can be reached, itself included."""
    labels = materialised(pairs.select(F.col("source").alias("id")).unionByName(pairs.select(F.col("target").alias("id"))).distinct().withColumn("label", F.col("id")), "labels")
    while True:
        come = pairs.join(labels, pairs["source"] == labels["id"]).groupBy(F.col("target").alias("id")).agg(F.min("label").alias("come"))
        after = materialised(labels.join(come, "id", "left").select("id", F.least("label", "come").alias("label"), F.coalesce(F.col("come") < F.col("label"), F.lit(False)).alias("moved")), "labels")
        labels = after.select("id", "label")
        if after.where("moved").isEmpty():
            return labels


def components_of(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each connected component, by alternating large-star and small-star steps: few rounds, whatever the diameter."""
    a, z = F.col("source"), F.col("target")
    nodes = edges.select(a.alias("id")).unionByName(edges.select(z.alias("id"))).distinct()
    pairs = materialised(edges.where(a != z).select(F.greatest(a, z).alias("a"), F.least(a, z).alias("b")).distinct(), "star")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialised(large, "star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        pairs = materialised(small.where("a <> b").distinct(), "star")
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first())
        if now == before:
            break
        before = now
    return nodes.join(pairs.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, *, restart: float = 0.25, rounds: int = 25) -> DataFrame:
    """(id, rank) over the undirected multigraph; parallel edges count, a dangling node keeps its mass, and without a seed
    the restart is uniform. A round is one join and one sum: a node without edges has an edge to itself, and the restart is added as rows."""
    both = edges.select("source", "target").unionByName(reverse(edges.select("source", "target")))
    weight = both.groupBy("source", "target").agg(F.count(F.lit(1)).alias("w"))
    degree = weight.groupBy("source").agg(F.sum("w").alias("degree"))
    share = weight.join(degree, "source").select("source", "target", (F.col("w") / F.col("degree")).alias("p"))
    alone = seeds.select(F.col("id").alias("source")).distinct().join(degree, "source", "left_anti").select("source", F.col("source").alias("target"), F.lit(1.0).alias("p"))
    share = materialised(share.unionByName(alone), "rank-share")
    nodes = share.select(F.col("source").alias("id")).distinct()
    flagged = materialised(nodes.join(seeds.select("id", F.lit(1.0).alias("s")).distinct(), "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0))), "rank-seeds")
    totals = flagged.agg(F.sum("s").alias("n_seeds"), F.count(F.lit(1)).alias("n")).first()
    base = flagged.select("id", (F.col("s") / float(totals["n_seeds"]) if totals["n_seeds"] else F.lit(1.0 / max(1, totals["n"]))).alias("rank"))
    ranks, again = base, base.select("id", (F.lit(restart) * F.col("rank")).alias("rank"))
    for i in range(rounds):
        flow = ranks.join(share, F.col("id") == F.col("source")).select(F.col("target").alias("id"), (F.lit(1 - restart) * F.col("rank") * F.col("p")).alias("rank"))
        ranks = flow.unionByName(again).groupBy("id").agg(F.sum("rank").alias("rank"))
        if i % 5 == 4:
            ranks = materialised(ranks, "rank")
    return ranks


def impact(edges: DataFrame, seeds: DataFrame, depth: int, container_kinds: Sequence[str] = ("class", "struct", "module", "namespace")) -> DataFrame:
    """(id, depth): what depends on the seeds within depth; a container takes its members in at the same depth."""
    kinds = F.split_part(F.col("id"), F.lit(":"), F.lit(1)).isin(*container_kinds)
    contains, rest = edges.where("kind = 'contains'"), edges.where("kind <> 'contains'")
    back = reverse(rest.select("source", "target"))
    seen = materialised(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(depth + 1):
        inner = frontier
        while True:  # members of containers, at no cost
            member = contains.join(inner.where(kinds).select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
            inner = materialised(member.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
            if inner.isEmpty():
                break
            seen, frontier = seen.unionByName(inner), frontier.unionByName(inner)
        if d == depth:
            break
        step = back.join(frontier.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        frontier = materialised(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d + 1)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def named_flow(edges: DataFrame, named: DataFrame, hops: int = 7) -> DataFrame:
    """(start, id, depth, streak): chains from named symbols that never pass two unnamed ones in a row."""
    pairs = edges.select("source", "target").distinct()
    names = named.select("id").distinct()
    state = materialised(names.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.lit(0).alias("streak")))
    frontier = state
    flags = names.withColumn("is_named", F.lit(True))
    for d in range(1, hops + 1):
        step = frontier.join(pairs, F.col("id") == F.col("source")).select("start", F.col("target").alias("id"), "streak")
        step = step.join(flags, "id", "left").withColumn("streak", F.when(F.col("is_named"), 0).otherwise(F.col("streak") + 1)).where("streak <= 1")
        best = step.groupBy("start", "id").agg(F.min("streak").alias("streak")).withColumn("depth", F.lit(d))
        frontier = materialised(best.join(state.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", "depth", "streak"))
        if frontier.isEmpty():
            break
        state = state.unionByName(frontier)
    return state


def longest_flow(edges: DataFrame, named: DataFrame, hops: int = 6, seeds: int = 8) -> DataFrame:
    """(place, id): the longest chain between two named symbols of three or more in all, from the first `seeds` named ones, that never passes two unnamed in a row.

    A symbol is reached once from each seed, by the fewest unnamed before it, then the least path. Of chains of one length, that of the least start and end counts. Nothing where
    there is none; a path holds hops + 1 symbols at most, and links of a symbol with itself don't matter.
    """
    pairs = materialised(edges.where("source is not null AND target is not null").select("source", "target").distinct())
    names = named.select("id").where("id is not null").distinct()
    flags = materialised(names.withColumn("is_named", F.lit(True)))
    frontier = materialised(names.orderBy("id").limit(seeds).select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"), F.lit(0).alias("streak"), F.array("id").alias("path"), F.lit(True).alias("is_named")))
    seen = state = frontier
    for d in range(1, hops + 1):
        step = frontier.join(pairs, F.col("id") == F.col("source")).select("start", F.col("target").alias("id"), "streak", "path")
        step = step.join(flags, "id", "left").withColumn("streak", F.when(F.col("is_named"), 0).otherwise(F.col("streak") + 1)).where("streak <= 1")
        step = step.join(seen.select("start", "id"), ["start", "id"], "left_anti")
        best = step.groupBy("start", "id").agg(F.min(F.struct("streak", F.array_append("path", F.col("id")).alias("path"), "is_named")).alias("m"))
        frontier = materialised(best.select("start", "id", F.lit(d).alias("depth"), "m.streak", "m.path", "m.is_named"))
        if frontier.isEmpty():
            break
        seen = state = state.unionByName(frontier)
    deep = state.where("is_named AND depth >= 2").orderBy(F.desc("depth"), "start", "id").limit(1)
    return deep.select(F.posexplode("path").alias("place", "id")).withColumn("place", F.col("place") + 1)


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between members of a node set, duplicates kept."""
    keys = ids.select("id").distinct()
    inner = edges.join(keys.select(F.col("id").alias("source")), "source", "left_semi")
    return inner.join(keys.select(F.col("id").alias("target")), "target", "left_semi")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def call_chain(edges: DataFrame, traced: DataFrame, hops: int = 2, most_parents: int = 32) -> DataFrame:
    """(side, source, target): edges into traced ids (a column id) as upstream, out of them as downstream, and from two hops on those into
    their parents that aren't traced themselves. Of many parents the first most_parents by id count, as this operator promises."""
    seeds = traced.select("id").distinct()
    pairs = edges.select("source", "target")
    up = materialised(pairs.join(seeds.withColumnRenamed("id", "target"), "target").select("source", "target").distinct(), "up")
    down = pairs.join(seeds.withColumnRenamed("id", "source"), "source").select(F.lit("down").alias("side"), "source", "target")
    out = up.select(F.lit("up").alias("side"), "source", "target").unionByName(down)
    if hops >= 2:
        parents = up.select(F.col("source").alias("target")).distinct().join(seeds.withColumnRenamed("id", "target"), "target", "left_anti").orderBy("target").limit(most_parents)
        out = out.unionByName(pairs.join(parents, "target").select(F.lit("up").alias("side"), "source", "target"))
    return out.distinct()
