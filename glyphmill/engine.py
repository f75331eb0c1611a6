"""The library's front: one object over a graph, its files and its memories, with a method for each thing that a user asks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text, vector
from glyphmill.operators import graph, subgraph
from glyphmill.plans import bindings, context

CALLS = ("calls", "references", "imports")


@dataclass
class Engine:
    """nodes and edges as the views in plans.bindings have them; memories: key, mem_type, repo, source, embedding. All lazily read."""

    nodes: DataFrame
    edges: DataFrame
    memories: DataFrame | None = None

    @staticmethod
    def over(spark: SparkSession, sf_dir: str) -> Engine:
        """The views over the given tables."""
        return Engine(bindings.nodes(spark, sf_dir), bindings.edges(spark, sf_dir), bindings.memories(spark, sf_dir))

    def _seeds(self, names: Sequence[str]) -> DataFrame:
        return self.nodes.where(F.col("name").isin(*names) | F.col("id").isin(*names) | F.col("qualified_name").isin(*names)).select("id")

    def search(self, question: str, limit: int = 20) -> DataFrame:
        """Symbols by field filters and hybrid ranking, best first."""
        found = context.hybrid_context(self.nodes, question, limit=limit)
        return found.join(self.nodes.select("id", "kind", "name", "file_path", "start_line"), "id").orderBy(F.desc("score"), "id")

    def callers(self, *names: str, depth: int = 1) -> DataFrame:
        return graph.reach(graph.reverse(self.edges.where(F.col("kind").isin(*CALLS))), self._seeds(names), depth).where("depth > 0")

    def callees(self, *names: str, depth: int = 1) -> DataFrame:
        return graph.reach(self.edges.where(F.col("kind").isin(*CALLS)), self._seeds(names), depth).where("depth > 0")

    def impact(self, *names: str, depth: int = 2) -> DataFrame:
        return graph.impact(self.edges, self._seeds(names), depth)

    def node(self, name: str, file: str = "", line: int | None = None) -> DataFrame:
        """Definitions of a name; of a file whose path ends so, and there the nearest to a line, where these are given."""
        n = self.nodes.where((F.col("name") == name) | (F.col("qualified_name") == name))
        n = n.where(F.endswith("file_path", F.lit(file))) if file else n
        return n.orderBy(F.abs(F.col("start_line") - line), "id").limit(1) if line is not None else n

    def explore(self, question: str, limit: int = 12) -> DataFrame:
        """Files that the answers lie in, by the sum of their scores."""
        found = context.hybrid_context(self.nodes, question, limit=100).join(self.nodes.select("id", "file_path"), "id")
        return found.groupBy("file_path").agg(F.round(F.sum("score"), 6).alias("score"), F.count(F.lit(1)).alias("symbols")).orderBy(F.desc("score"), "file_path").limit(limit)

    def status(self) -> DataFrame:
        """Counts by kind of node and of edge, and by language."""
        by = lambda df, what, c: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("of"), "name", "n")
        return by(self.nodes, "node", "kind").unionByName(by(self.edges, "edge", "kind")).unionByName(by(self.nodes, "language", "language"))

    def files(self, prefix: str = "") -> DataFrame:
        return self.nodes.where(F.startswith("file_path", F.lit(prefix))).groupBy("file_path", "language").agg(F.count(F.lit(1)).alias("symbols"))

    def recall(self, asked: Sequence[float], *, mem_types: Sequence[str] = bindings.MEM_TYPES, repo: str | None = None, k: int = 5, floor: float = 0.60) -> DataFrame:
        """The k nearest memories of each type, within a distance."""
        if self.memories is None:
            raise ValueError("this engine has no memories")
        m = self.memories.where(F.col("mem_type").isin(*mem_types))
        m = m.where(F.col("repo") == repo) if repo else m
        q = F.array(*[F.lit(float(x)) for x in asked])
        near = m.select("key", "mem_type", "source", (F.lit(1.0) - vector.cosine(F.transform("embedding", lambda x: x.cast("double")), q)).alias("distance"))
        return graph.top_per(near.where(F.col("distance") <= floor), ["mem_type"], [F.col("distance"), F.col("key")], k)

    def dev_context(self, question: str, asked: Sequence[float] | None = None, *, seeds: int = 3, depth: int = 2) -> dict[str, DataFrame | str]:
        """What a developer needs for a question: its intent, symbols, the call graph around the best of them with its files, and memories."""
        hits = graph.materialised(context.hybrid_context(self.nodes, question))
        around = subgraph.snapshot(self.edges, hits.orderBy(F.desc("score"), "id").limit(seeds).select("id"), depth=depth)
        placed = graph.materialised(self.nodes.select("id", "name", "file_path").join(F.broadcast(around), "id"))
        intent = hits.sparkSession.range(1).select(text.intent(F.lit(question))).first()[0]
        out = {"intent": intent, "symbols": hits, "graph": placed, "edges": subgraph.snapshot_edges(self.edges, placed), "files": subgraph.collapsed_to_files(placed)}
        return out | ({"memories": self.recall(asked)} if asked is not None and self.memories is not None else {})
