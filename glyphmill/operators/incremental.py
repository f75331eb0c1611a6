"""A graph of files that follows its sources: versioned tables in parts, of which an update rewrites only those that it changes.

A table's rows lie in parts by a hash of their file. A version writes the parts that differ and a manifest that tells which version each part is to be
read from; the manifest comes last, so that a version that failed halfway was never there. Links are found again only for changed files and for
names that lead elsewhere than before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators.storage import materialised

PARTS = 64
Extractor = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Versioned:
    """One table below a shared folder. schema: DDL of its columns, of which `path` tells the part."""

    def __init__(self, spark: SparkSession, base: str, name: str, schema: str, parts: int):
        self.spark, self.at, self.manifests, self.schema, self.parts = spark, f"{base}/{name}", f"{base}/{name}-manifests", schema, parts

    def part(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int")

    def manifest(self, version: int) -> dict[int, int]:
        """part -> the version that it is read from; PARTS rows at most."""
        if version < 0:
            return {}
        return {r["part"]: r["at"] for r in self.spark.read.schema("part int, at int").parquet(f"{self.manifests}/v={version}").collect()}

    def read(self, version: int, parts: set[int] | None = None) -> DataFrame:
        """The table as of a version, or some of its parts: only their folders are read."""
        columns = [F.col(c.split()[0]) for c in self.schema.split(", ")]
        by_version: dict[int, list[int]] = {}
        for part, at in self.manifest(version).items():
            if parts is None or part in parts:
                by_version.setdefault(at, []).append(part)
        if not by_version:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, v int, part int").parquet(self.at)
        wanted = reduce(Column.__or__, [(F.col("v") == at) & F.col("part").isin(own) for at, own in by_version.items()])
        return rows.where(wanted).select(*columns)

    def put(self, version: int, rows: DataFrame, parts: set[int]) -> int:
        """The rows of these parts as of a version; other parts stay where they are. How many parts were written."""
        if parts:
            rows.withColumn("part", self.part()).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.at}/v={version}")
        known = self.manifest(version - 1) | dict.fromkeys(parts, version)
        self.spark.createDataFrame([*known.items()], "part int, at int").coalesce(1).write.mode("overwrite").parquet(f"{self.manifests}/v={version}")
        return len(parts)


class FileGraph:
    """Files, the names that they define and use, and links from files to the file that defines a used name: the smallest path that does.

    extract: from files (path, content) to symbols (path, name) and references (path, name). Paths are unique; rows with a null path or name are dropped, a null content counts as
    empty. update() tells what it did; run again for the same version it writes the same.
    """

    def __init__(self, spark: SparkSession, base: str, extract: Extractor, parts: int = PARTS):
        self.extract, self.version, self.parts = extract, -1, parts
        table = lambda name, schema: Versioned(spark, base, name, schema, parts)
        self.files, self.symbols, self.refs, self.links = table("files", "path string, hash string"), table("symbols", "path string, name string"), table("refs", "path string, name string"), table("links", "path string, name string, target string")

    def _parts(self, rows: DataFrame) -> set[int]:
        """The parts that hold rows: `parts` numbers at most."""
        return {r[0] for r in rows.select(self.files.part()).distinct().collect()}

    def update(self, files: DataFrame) -> dict[str, int]:
        old, new = self.version, self.version + 1
        now = files.where("path is not null").select("path", F.coalesce("content", F.lit("")).alias("content")).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
        before = self.files.read(old).select("path", F.col("hash").alias("had"))
        kind = F.when(F.col("had").isNull(), "added").when(F.col("hash").isNull(), "removed").otherwise("modified")
        changed = now.select("path", "hash").join(before, "path", "full").where(~F.col("hash").eqNullSafe(F.col("had"))).select("path", kind.alias("change"))
        changed = materialised(changed, "changed")
        counts = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
        dirty = self._parts(changed)
        in_dirty = self.files.part().isin(*dirty) if dirty else F.lit(False)

        fresh = now.join(changed.where("change <> 'removed'").select("path"), "path", "left_semi").select("path", "content")
        symbols, refs = (materialised(x.where("path is not null AND name is not null").select("path", "name").distinct(), "fresh") for x in self.extract(fresh))
        gone = changed.select("path")
        kept = lambda t: t.read(old, dirty).join(gone, "path", "left_anti")
        had = self.symbols.read(old, dirty).join(gone, "path", "left_semi")  # what changed files defined

        written = {"files": self.files.put(new, now.where(in_dirty).select("path", "hash"), dirty)}
        written["symbols"] = self.symbols.put(new, kept(self.symbols).unionByName(symbols), dirty)
        written["refs"] = self.refs.put(new, kept(self.refs).unionByName(refs), dirty)

        # a name that changed files define or defined leads elsewhere if its smallest path is another one now
        names = had.select("name").unionByName(symbols.select("name")).distinct()
        first = lambda version, name: self.symbols.read(version).join(names, "name", "left_semi").groupBy("name").agg(F.min("path").alias(name))
        moved = first(new, "target").join(first(old, "was"), "name", "full").where(~F.col("target").eqNullSafe(F.col("was")))
        moved = materialised(moved.select("name", "target"), "moved")
        hit = self.refs.read(new).join(moved.select("name"), "name", "left_semi")
        link_parts = self._parts(hit.select("path").unionByName(changed.select("path")))
        again = hit.unionByName(refs).distinct()
        wanted = self.symbols.read(new).join(again.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min("path").alias("target"))
        left = self.links.read(old, link_parts).join(gone, "path", "left_anti").join(moved.select("name"), "name", "left_anti")
        rows = left.select("path", "name", "target").unionByName(again.join(wanted, "name").select("path", "name", "target"))
        written["links"] = self.links.put(new, rows, link_parts)
        self.version = new
        return written | {k: counts.get(k, 0) for k in ("added", "modified", "removed")} | {"moved": moved.count()}
