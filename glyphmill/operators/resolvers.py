"""Resolvers of one's own: table functions that say what a reference may mean, each with the languages that it is for and its confidence."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Resolvers:
    """A registry. A resolver is a Python table function of (name, path) whose rows are (target string, confidence double); it may give none or several.

    Under a name that is taken already the new one takes the old one's place. Without languages a resolver is for all.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def register(self, name: str, function, languages: tuple[str, ...] | None = None) -> None:
        if not re.fullmatch("[A-Za-z]\\w*", name):
            raise ValueError(f"{name} is no name of a function")
        self.spark.udtf.register(f"resolver_{name}", function)
        self.known[name] = languages

    def unregister(self, name: str) -> None:
        self.known.pop(name, None)

    def candidates(self, refs: DataFrame) -> DataFrame:
        """refs (language, name, path and others) with resolver, target and confidence: a row for each answer. Null targets and confidences don't count."""
        found = []
        for name, languages in sorted(self.known.items()):
            scope = refs if languages is None else refs.where(F.col("language").isin(*languages))
            answered = self.spark.sql(f"SELECT r.*, '{name}' AS resolver, t.target, t.confidence FROM {{refs}} r, LATERAL resolver_{name}(r.name, r.path) t", refs=scope)
            found.append(answered.where("target is not null AND confidence is not null"))
        none = refs.withColumns({"resolver": F.lit(""), "target": F.lit(""), "confidence": F.lit(0.0)}).where("false")
        return reduce(DataFrame.unionByName, found, none)

    def resolve(self, refs: DataFrame, key: str) -> DataFrame:
        """(key, resolver, target, confidence): of each reference's answers the one with the highest confidence, then the least resolver and target. A reference without one has no row."""
        rows = self.candidates(refs)
        top = rows.groupBy(key).agg(F.max("confidence").alias("confidence"))
        least = rows.join(top, [key, "confidence"]).groupBy(key, "confidence").agg(F.min(F.struct("resolver", "target")).alias("m"))
        return least.select(key, "m.resolver", "m.target", "confidence")
