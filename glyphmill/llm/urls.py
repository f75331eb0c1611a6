"""URL filter: rules by host and path first, then a weighted vocabulary matched with an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import url_terms

#: Vocabulary: (term, kind, weight), see url_terms. One strict term that stands as a whole word rejects a URL, whatever its weight; distinct soft terms add up, each
#: counting its weight, at most 1, and reject from MIN_SOFT on.
WEIGHTS = tuple(sorted({(term, kind, weight) for term, kind, weight, _, _ in url_terms.entries()}))
MIN_SOFT = 1.0
#: A vocabulary given as a table is read by the driver up to so many terms; more are an error.
MAX_TERMS = 100_000
_UPPER = {c: c + 32 for c in range(65, 91)}


def vocabulary(terms: DataFrame) -> tuple[tuple[str, str, float], ...]:
    """A vocabulary from a table with the columns term, kind (strict or soft) and weight. Null and empty terms don't count."""
    rows = terms.where("term <> '' AND kind IN ('strict', 'soft')").select("term", "kind", F.col("weight").cast("double")).limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"over {MAX_TERMS} terms")
    return tuple(sorted((r["term"], r["kind"], 1.0 if r["weight"] is None else r["weight"]) for r in rows))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(_UPPER), slash + path


class UrlFilter:
    """Rules and vocabulary, compiled. Both are parameters written in a program, so their size doesn't follow the data."""

    def __init__(self, rules, terms=WEIGHTS, min_soft: float = MIN_SOFT):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(_UPPER), []).append((slash + path, verdict))
        for own in self.by_host.values():
            own.sort(key=lambda x: (-len(x[0]), x))
        self.words = ahocorasick.Automaton()
        known: dict[str, tuple[str, float]] = {}
        for term, kind, weight in terms:
            low = term.translate(_UPPER)
            known[low] = min(known.get(low, (kind, 0.0)), (kind, min(1.0, weight)), key=lambda x: (x[0] != "strict", -x[1]))
        for low, (kind, weight) in known.items():
            self.words.add_word(low, (low, kind, weight))
        self.words.make_automaton()
        self.any, self.least = bool(known), min_soft

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest that fits: most host, then most path."""
        best, labels = None, host.split(".") if host else []
        for i in range(len(labels)):
            own = ".".join(labels[i:])
            for start, verdict in self.by_host.get(own, ()):
                if path.startswith(start):
                    if best is None or len(own) + len(start) > len(best[0]):
                        best = (own + start, verdict)
                    break
        return best or (None, None)

    def hits(self, url: str) -> tuple[int, int, float]:
        """Distinct strict and soft terms that stand as whole words, and the weight of the soft ones."""
        if not self.any:
            return 0, 0, 0.0
        low, found = url.translate(_UPPER), set()
        for end, hit in self.words.iter(low):
            start = end - len(hit[0]) + 1
            if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                found.add(hit)
        soft = sorted(w for _, kind, w in found if kind == "soft")
        return len(found) - len(soft), len(soft), sum(soft)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = split_url(url)
        rule, verdict = self.rule(host, path)
        strict, soft, weight = self.hits(url or "")
        return host, path, rule, verdict or ("block" if strict or weight >= self.least else "allow"), strict, soft


def filter_urls(pages: DataFrame, rules, *, id_col: str = "page_id", url_col: str = "url", terms=WEIGHTS, min_soft: float = MIN_SOFT) -> DataFrame:
    """A verdict for each row of pages, one pass without a shuffle.

    rules: (verdict, "host/path") pairs. A rule fits its host, all subdomains, and paths that start with its path; the
    longest wins. Where none fits, one strict term of the vocabulary blocks, or distinct soft terms whose weights reach min_soft. Terms
    stand between characters other than letters and digits of any script; an empty vocabulary blocks nothing, and of a term given twice the strict or
    heavier one counts. A null url, or one without `://`, has an empty host and path and fits no rule; its text still meets the vocabulary. Rows with
    a null id and repeated rows are judged like any other, very long urls as a whole. An empty table gives no rows; other columns are
    ignored, whatever their names.
    Returns id, host, path, rule, verdict, strict_hits int, soft_hits int.
    """
    args = (tuple(rules), tuple(terms), min_soft)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = UrlFilter(*args)
        for urls in batches:
            yield pd.DataFrame([own.judge(u) for u in urls], columns=["host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    verdict = F.pandas_udf(judged, "host string, path string, rule string, verdict string, strict_hits int, soft_hits int")
    judged_rows = pages.select(F.col(id_col).alias("id"), verdict(F.col(url_col)).alias("v"))
    return judged_rows.select(F.col("id").alias(id_col), "v.*")
