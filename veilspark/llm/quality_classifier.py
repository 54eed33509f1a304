"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Behaviour: null and empty texts get the score of their (zero) statistics; rows with null ids are scored and never
train; repeated ids are scored row by row; with no labelled rows of both classes every score is 0.5; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod
from .text_stats import RATIOS, labelled_sample, with_ratios

#: Bound of the labelled rows that the model is fitted on.
MAX_LABELLED = 20_000
#: Ratios that are rates near zero are spread by log(x + SMALL).
SMALL = 0.01
SPREAD = ["symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "stop_rate", "non_ascii_rate"]


@dataclass
class Discriminant:
    """Scale of the features, and per class the mean, the inverse Cholesky factor and the log weight."""

    mid: np.ndarray
    width: np.ndarray
    means: list[np.ndarray]
    inverse: list[np.ndarray]
    bias: list[float]
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mid) / self.width
        d = [((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.inverse, strict=True)]
        return (self.bias[1] - 0.5 * d[1].sum(1)) - (self.bias[0] - 0.5 * d[0].sum(1))


def transformed(frame: DataFrame) -> DataFrame:
    return frame.withColumns({k: F.log(F.col(k) + SMALL) for k in SPREAD})


def _fit(x: np.ndarray, y: np.ndarray, shrink: float) -> Discriminant:
    mid, width = x.mean(0), x.std(0) + 1e-6
    z = (x - mid) / width
    means, inverse, bias = [], [], []
    pooled = sum(np.cov(z[y == k], rowvar=False) * (y == k).sum() for k in (0, 1)) / len(y)
    for k in (0, 1):
        own = z[y == k]
        # A class with few rows leans on the pooled covariance whatever `shrink` says.
        own_shrink = max(shrink, z.shape[1] / (z.shape[1] + len(own)))
        c = (1 - own_shrink) * np.cov(own, rowvar=False) + own_shrink * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 0.05 * np.eye(z.shape[1])
        factor = np.linalg.cholesky(c)
        means.append(own.mean(0))
        inverse.append(np.linalg.inv(factor))
        bias.append(float(np.log(len(own) / len(z)) - np.log(np.diag(factor)).sum()))
    return Discriminant(mid, width, means, inverse, bias)


def _calibrate(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with a weak pull to a small slope."""
    scale = np.abs(raw).mean() + 1e-9
    r, w = raw / scale, np.array([1.0, 0.0])
    a = np.c_[r, np.ones_like(r)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-3]) * 1.0
        w = w - np.clip(np.linalg.solve(h, a.T @ (p - y) + np.array([1e-2, 1e-3]) * w), -2, 2)
    return float(max(w[0], 1e-3) / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Discriminant | None:
    """Fit on statistics of at most `max_labelled` labelled documents outside the held-out fifth."""
    train = labels.where(crc_mod("doc_id", 5) != 0)
    rows = transformed(with_ratios(labelled_sample(docs, train, "quality", max_labelled))).select("y", F.pmod(F.xxhash64("doc_id", F.lit("tune")), F.lit(4)).alias("part"), *RATIOS).collect()
    y = np.array([r["y"] for r in rows], int)
    if min((y == 0).sum(), (y == 1).sum()) < 3:
        return None
    x = np.array([[r[k] for k in RATIOS] for r in rows], float)
    tune = np.array([r["part"] == 0 for r in rows])
    if min(((y == k) & m).sum() for k in (0, 1) for m in (tune, ~tune)) < 3:
        tune = np.zeros(len(y), bool)
    best = None
    for shrink in (0.02, 0.1, 0.3, 0.6, 0.9):
        model = _fit(x[~tune], y[~tune], shrink)
        held = tune if tune.any() else ~tune
        a, b = _calibrate(model.raw(x[held]), y[held])
        p = np.clip(1 / (1 + np.exp(-np.clip(a * model.raw(x[held]) + b, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(y[held] == 1, np.log(p), np.log(1 - p)))
        if best is None or loss < best[0] - 1e-4:
            best = (loss, shrink, a, b)
    model = _fit(x, y, best[1])
    model.slope, model.offset = best[2], best[3]
    return model


def _distance(z: list[Column], mean: np.ndarray, inverse: np.ndarray) -> Column:
    out = F.lit(0.0)
    for i in range(len(z)):
        part = F.lit(0.0)
        for j in range(i + 1):
            part = part + (z[j] - float(mean[j])) * float(inverse[i, j])
        out = out + part * part
    return out


def score(docs: DataFrame, model: Discriminant | None) -> DataFrame:
    """doc_id and score of every row."""
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    scaled = {f"_z{j}": (F.col(k) - float(model.mid[j])) / float(model.width[j]) for j, k in enumerate(RATIOS)}
    frame = transformed(with_ratios(docs.select("doc_id", "text"))).select("doc_id", *[c.alias(k) for k, c in scaled.items()])
    z = [F.col(k) for k in scaled]
    raw = (model.bias[1] - 0.5 * _distance(z, model.means[1], model.inverse[1])) - (model.bias[0] - 0.5 * _distance(z, model.means[0], model.inverse[0]))
    logit = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), raw * model.slope + model.offset))
    return frame.select("doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
