"""Two resolvers that a user registers, over the links of pages: one for plain words, one for the language of the page's address."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from glyphmill.operators.resolvers import Resolvers
from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query


@udtf(returnType="target string, confidence double")
class Word:
    """A link of one short plain word leads to that word's page; with a capital, less surely."""

    def eval(self, name: str, path: str):
        word = (name or "").removeprefix("/")
        if word.isascii() and word.isalpha() and len(word) <= 6:
            yield "word:" + word.lower(), 0.8 if word[0].islower() else 0.5


@udtf(returnType="target string, confidence double")
class Local:
    """A link may be meant within the page's own host, and less surely at the top."""

    def eval(self, name: str, path: str):
        if name:
            yield (path or "") + name, 0.6
            yield name, 0.3


@query("resolve_registered", """
WITH r AS (SELECT page_id || ':' || pos AS ref, coalesce(nullif(regexp_extract(url, '^[^:]*://[^/]+/([a-z]+)/', 1), ''), 'none') AS language, href AS name, regexp_extract(url, '://([^/?#]+)', 1) AS path, substr(href, 2) AS word FROM v_routes),
c AS (SELECT ref, 'word' AS resolver, 'word:' || lower(word) AS target, CASE WHEN regexp_matches(word, '^[a-z]') THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM r WHERE regexp_full_match(name, '/[A-Za-z]{1,6}')
  UNION ALL SELECT ref, 'local', path || name, 0.6::DOUBLE FROM r WHERE language IN ('en', 'de') AND name <> '' UNION ALL SELECT ref, 'local', name, 0.3::DOUBLE FROM r WHERE language IN ('en', 'de') AND name <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY confidence DESC, resolver, target) AS rn FROM c)
SELECT ref, resolver, target, confidence FROM n WHERE rn = 1""")  # fmt: skip
def resolve_registered(s, d):
    registry = Resolvers(s)
    registry.register("word", Word)
    registry.register("local", Local, ("en", "de"))
    own = F.nullif(F.regexp_extract("url", "^[^:]*://[^/]+/([a-z]+)/", 1), F.lit(""))
    refs = b.routes(s, d).select(F.concat_ws(":", "page_id", "pos").alias("ref"), F.coalesce(own, F.lit("none")).alias("language"), F.col("href").alias("name"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("path"))
    return registry.resolve(refs, "ref")
