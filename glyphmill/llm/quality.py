"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk of a linear model is minimised
over trusted positives and unlabelled web text, with a class prior estimated from these two alone."""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import small_batches

#: Bounds of the samples that the model is fitted on; scoring covers every row.
MAX_POSITIVES, MAX_UNLABELLED = 3000, 6000
HELD_OUT = 2

_KIND = np.full(256, 5, dtype=np.uint8)  # other symbols
for _chars, _kind in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), (range(128, 256), 3), (b".,;:'\"()-?", 4), (b"!", 6), (b"|", 7), (b" \t\r\x0b\x0c", 8), (b"\n", 9)):
    for _c in _chars:
        _KIND[_c] = _kind
N_FEATURES = 17


def text_features(text: str | None) -> np.ndarray:
    """Shares of kinds of characters and words, and repetition; all from the whole text."""
    out = np.zeros(N_FEATURES)
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    words = (text or "").split()
    if not words:
        out[-1] = 1.0
        return out
    kinds = np.bincount(_KIND[raw], minlength=10)
    n, solid = len(words), max(1, int(kinds[:8].sum()))
    out[:8] = kinds[:8] / solid
    lines = text.split("\n")
    distinct = len(set(words))
    out[8] = sum(map(operator.eq, words, words[1:])) / n
    out[9] = 1 - distinct / n
    out[10] = (n - distinct) / (n + 50)
    out[11] = sum(map(str.isupper, words)) / n
    out[12] = 1 - sum(map(str.isalpha, words)) / n
    out[13] = 1 - len(set(lines)) / len(lines)
    out[14] = min(solid / n, 40) / 40
    out[15] = np.log1p(n) / 12
    return out


def _expand(x: np.ndarray) -> np.ndarray:
    """Square roots tell small shares apart."""
    return np.hstack([x, np.sqrt(np.abs(x))])


@dataclass
class LinearModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (_expand(features) - self.mean) / self.scale @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> LinearModel:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) for the logistic loss by full-batch Adam.

    Where the estimate of the negative risk falls below zero, its gradient is reversed, as the non-negative estimator asks.
    """
    p, u = _expand(positive), _expand(unlabelled)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    p, u = (p - mean) / scale, (u - mean) / scale
    w, m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    p, u = np.hstack([p, np.ones((len(p), 1))]), np.hstack([u, np.ones((len(u), 1))])
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        negative_risk = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        g_positive = prior * (p.T @ (sp - 1)) / len(p)
        g_negative = (u.T @ su) / len(u) - prior * (p.T @ sp) / len(p)
        g = g_positive + g_negative if negative_risk >= 0 else -g_negative
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return LinearModel(mean, scale, w[:-1], float(w[-1]))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _sample(texts: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of up to `most` ids, chosen by a hash of the id; of rows that repeat an id, the one with the least hash of the text counts."""

    @F.pandas_udf("array<double>")
    def featured(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: text_features(t).tolist())

    chosen = ids.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = texts.join(F.broadcast(chosen), "id").select("id", F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), featured("text").alias("f")).alias("r"))
    found = [r[0] for r in rows.groupBy("id").agg(F.min("r").alias("r")).select("r.f").collect()]
    return np.array(sorted(found)).reshape(len(found), N_FEATURES)  # the order of a collected sample must not change a sum


def _separated(positive: np.ndarray, unlabelled: np.ndarray, asked: np.ndarray, *, steps: int = 300, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Scores of the asked rows by a linear model that tells trusted positives from unlabelled rows, whatever the share of positives among these: only their order matters."""
    p, u, x = _expand(positive), _expand(unlabelled), _expand(asked)
    mean, scale = u.mean(axis=0), u.std(axis=0) + 1e-3
    p, u, x = (np.hstack([(v - mean) / scale, np.ones((len(v), 1))]) for v in (p, u, x))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        g = p.T @ (sp - 1) / len(p) + u.T @ su / len(u) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x @ w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, *, sure: float = 0.1) -> float:
    """The share of positives in unlabelled text, from features of trusted positives and unlabelled rows alone.

    Among the rows that score highest, unlabelled ones are positives too, so that the share of unlabelled rows there, over the share of trusted positives there,
    is the prior. How far down the top reaches is where that ratio plus its chance error, at confidence 1 - sure, is least. Each half is
    scored by a model fitted on the other; the two estimates are averaged and kept within 0.02 to 0.98.
    """
    side = lambda rows: np.array([zlib.crc32(r.tobytes()) & 1 for r in np.ascontiguousarray(rows)], dtype=np.int64)  # noqa: E731  a row's own content tells its half
    p_side, u_side, found = side(positive), side(unlabelled), []
    for own in (0, 1):
        p, u, p_fit, u_fit = positive[p_side == own], unlabelled[u_side == own], positive[p_side != own], unlabelled[u_side != own]
        if not (len(p) and len(u) and len(p_fit) and len(u_fit)):
            continue
        zp, zu = np.sort(_separated(p_fit, u_fit, p))[::-1], np.sort(_separated(p_fit, u_fit, u))
        top = np.arange(1, len(zp) + 1) / len(zp)
        ratio = (1 - np.searchsorted(zu, zp, side="left") / len(zu)) / top
        error = (np.sqrt(np.log(4 / sure) / (2 * len(u))) + np.sqrt(np.log(4 / sure) / (2 * len(p)))) / top
        found.append(ratio[np.argmin(ratio + error)])
    return float(np.clip(np.mean(found), 0.02, 0.98)) if found else 0.5


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LinearModel:
    """Fit on the rows that held_out leaves: trusted positives (label 1) and unlabelled text.

    Both samples are bounded by MAX_POSITIVES and MAX_UNLABELLED ids, chosen by a hash of the id; only their few
    features reach the driver. The class prior is estimated from these two alone: labels 0 are never read for it.
    Without any positive every score is 0.5.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    learn = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~held_out(F.col("id")) & F.col("label").isin(0, 1))
    per_id = learn.groupBy("id").agg(F.min("label").alias("label")).where("id is not null")
    positive = _sample(texts, per_id.where("label = 1").select("id"), MAX_POSITIVES)
    unlabelled = _sample(texts, texts.select("id").distinct(), MAX_UNLABELLED)
    if not len(positive) or not len(unlabelled):
        return LinearModel(np.zeros(2 * N_FEATURES), np.ones(2 * N_FEATURES), np.zeros(2 * N_FEATURES), 0.0)
    return fit_nnpu(positive, unlabelled, class_prior(positive, unlabelled))


def with_score(docs: DataFrame, model: LinearModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([text_features(t) for t in texts]).reshape(len(texts), N_FEATURES)))

    return docs.withColumn(score_col, F.pandas_udf(scored, "double")(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """Every row of docs with held_out boolean, score double in 0..1 and predicted int (1 if score >= threshold).

    Labels of held-out ids are never read; other labels than 0 and 1 don't count, and of several for an id the
    smallest does. A null or empty text has a score like any other, a very long one is read whole; a null id is not held out. Repeated rows are each
    scored. Columns of docs named held_out, score or predicted are replaced, others stay as they are. An empty table gives no rows.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    out = with_score(docs.drop("held_out", "score", "predicted"), model, text_col=text_col)
    return out.withColumns({"held_out": held_out(F.col(id_col)), "predicted": (F.col("score") >= threshold).cast("int")})
