"""Query-local graphs: a bounded snapshot around seeds, filtering by plan terms, glue nodes and lost edges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.graph import first_by, induced, reverse
from glyphmill.operators.storage import materialised

#: Bounds of a snapshot. They are what the operator promises, as a top-k does, not limits of its input.
MAX_SEEDS, MAX_DEPTH, MAX_FRONTIER, MAX_NODES, MAX_EDGES = 8, 5, 40, 500, 1000
#: The order of roles in a snapshot.
ROLES = ("seed", "caller", "callee", "importer", "extends", "method")


def _walk(edges: DataFrame, seeds: DataFrame, depth: int, frontier: int) -> DataFrame:
    """(id, depth): nodes by shortest distance, each level cut to its first `frontier` ids before it is left."""
    pairs = edges.select("source", "target").distinct()
    seen, state = seeds, seeds.select(F.col("id").alias("source"))
    levels = []
    for d in range(1, depth + 1):
        step = pairs.join(F.broadcast(state), "source").select(F.col("target").alias("id")).distinct()  # at most `frontier` rows, or the seeds
        level = materialised(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        levels.append(level)
        if level.isEmpty():
            break
        seen = seen.select("id").unionByName(level.select("id"))
        state = materialised(level.orderBy("id").limit(frontier).select(F.col("id").alias("source")))
    return reduce(DataFrame.unionByName, levels)


def snapshot(
    edges: DataFrame, seeds: DataFrame, *, call_kinds: Sequence[str] = ("calls",), auxiliary: Sequence[tuple[str, str, bool]] = (("imports", "importer", True), ("extends", "extends", True), ("contains", "method", False)),
    depth: int = MAX_DEPTH, frontier: int = MAX_FRONTIER, most: int = MAX_NODES,
) -> DataFrame:
    """(id, role, depth): the call neighbourhood of at most MAX_SEEDS seeds (a column id), callers at negative depth.

    auxiliary: (edge kind, role, inward) relations, one hop. A node has the role in which it comes first: seed, then callee,
    caller and the auxiliary roles. At most `most` nodes stay: by role, then distance, then id.
    """
    start = materialised(seeds.select("id").distinct().orderBy("id").limit(MAX_SEEDS))
    calls = edges.where(F.col("kind").isin(*call_kinds))
    parts = [
        start.select("id", F.lit("seed").alias("role"), F.lit(0).alias("depth"), F.lit(0).alias("turn")),
        _walk(calls, start, depth, frontier).select("id", F.lit("callee").alias("role"), "depth", F.lit(1).alias("turn")),
        _walk(reverse(calls), start, depth, frontier).select("id", F.lit("caller").alias("role"), (-F.col("depth")).alias("depth"), F.lit(2).alias("turn")),
    ]
    for i, (kind, role, inward) in enumerate(auxiliary):
        near = edges.where(F.col("kind") == kind)
        near = (reverse(near) if inward else near).join(F.broadcast(start.select(F.col("id").alias("source"))), "source")
        parts.append(near.select(F.col("target").alias("id")).distinct().select("id", F.lit(role).alias("role"), F.lit(1).alias("depth"), F.lit(3 + i).alias("turn")))
    found = first_by(reduce(DataFrame.unionByName, parts), ["id"], [F.col("turn")]).drop("turn")
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    return found.orderBy(rank, F.abs("depth"), "id").limit(most)


def snapshot_edges(edges: DataFrame, nodes: DataFrame, most: int = MAX_EDGES) -> DataFrame:
    """Distinct (source, target, kind) between the nodes of a snapshot, at most `most` in order."""
    return induced(edges, nodes).select("source", "target", "kind").distinct().orderBy("source", "target", "kind").limit(most)


def plan_filtered(nodes: DataFrame, edges: DataFrame, must: Column, exclude: Column) -> DataFrame:
    """Nodes (id, role, depth, …) of a snapshot that a plan keeps. must, exclude: conditions over the nodes' columns.

    Seeds always stay. Excluded nodes go; of the others those stay that fit `must`, and neighbours of a seed, or of a node
    that fits, at depth 1. What then has no edge to a node that stays goes too, unless it is a seed.
    """
    seed = F.col("role") == "seed"
    open_ = materialised(nodes.where(seed | ~exclude).withColumn("fits", seed | F.coalesce(must, F.lit(False))))
    both = edges.select("source", "target").unionByName(reverse(edges.select("source", "target"))).distinct()
    near = both.join(open_.where("fits").select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    kept = open_.join(near.withColumn("near", F.lit(True)), "id", "left").where("fits OR (near AND abs(depth) = 1)").drop("near")
    linked = induced(both, kept).where("source <> target").select(F.col("source").alias("id")).distinct().withColumn("linked", F.lit(True))
    return kept.join(linked, "id", "left").where(seed | F.col("linked")).drop("linked", "fits")


def collapsed_to_files(nodes: DataFrame) -> DataFrame:
    """(file_path, role, depth, symbols): each file with its best role, and the least distance in it."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role"))
    g = nodes.groupBy("file_path").agg(F.min(F.struct(rank.alias("rank"), F.abs("depth").alias("far"), "role", "depth")).alias("m"), F.count(F.lit(1)).alias("symbols"))
    return g.select("file_path", F.col("m.role").alias("role"), F.col("m.depth").alias("depth"), "symbols")


def glue_nodes(nodes: DataFrame, edges: DataFrame, roots: DataFrame, most: int = 60) -> DataFrame:
    """(id): neighbours of the roots that lie in a file of a root and are no roots, the best linked first, at most `most`."""
    both = edges.select("source", "target").unionByName(reverse(edges.select("source", "target")))
    links = both.join(roots.select(F.col("id").alias("source")), "source", "left_semi").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    files = nodes.join(roots.select("id"), "id", "left_semi").select("file_path").distinct()
    here = nodes.select("id", "file_path").join(files, "file_path", "left_semi").join(roots.select("id"), "id", "left_anti")
    return here.join(links, "id").orderBy(F.desc("links"), "id").limit(most).select("id", "links")


def recovered_edges(edges: DataFrame, nodes: DataFrame, have: DataFrame) -> DataFrame:
    """Edges between final nodes that an earlier step has lost."""
    return induced(edges, nodes).select("source", "target", "kind").distinct().join(have.select("source", "target", "kind"), ["source", "target", "kind"], "left_anti")
