"""Quality rules: decision lists learned by sequential covering, run as ordered Spark conditional expressions.

The list is learned from all labelled rows. Each step counts them, good and bad, in narrow bins of every feature, so
only counts come to the driver. Bins follow the logarithm of the value, `BINS` for each doubling. A threshold lies between the greatest
value of a bin and the least of the next, so the counts on its sides are exact.

Behaviour: null and empty texts have no words and fail the base rule; ties between equal thresholds go to the first
feature in `RATIOS`; repeated ids stay repeated rows; an empty table gives an empty result; extra columns pass through
whatever their names, and none is replaced but those named like a result (the base counts, base_failed, rule, kept).
Without labels of both classes the list is empty and only the base rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept
from .text_stats import BASE, RATIOS, with_base, with_ratios

#: Bins of a feature for each doubling of its value.
BINS = 256


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass(frozen=True)
class Bins:
    """The bins of one feature that hold rows, ascending: least and greatest value, bad and good rows."""

    low: np.ndarray
    high: np.ndarray
    bad: np.ndarray
    good: np.ndarray


def counted(rows: DataFrame) -> list[Bins]:
    """The bins of each of `RATIOS` over `rows`. The features are never negative."""
    each = rows.select("y", F.posexplode(F.array(*RATIOS)).alias("feature", "v"))
    place = F.when(F.col("v") > 0, F.floor(F.log2("v") * BINS))
    found = each.groupBy("feature", place.alias("place")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") != 0).alias("good")).toArrow()
    feature, low, high, bad, good = (found.column(c).to_numpy() for c in ("feature", "low", "high", "bad", "good"))
    order = [(at := np.flatnonzero(feature == k))[np.argsort(low[at])] for k in range(len(RATIOS))]
    return [Bins(low[o], high[o], bad[o], good[o]) for o in order]


def _cuts(bins: Bins, most: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds, and the bin below each."""
    n = len(bins.low) - 1
    at = np.arange(n) if n <= most else np.unique(np.round(np.linspace(0, n - 1, most)).astype(int))
    mid = (bins.high[at] + bins.low[at + 1]) / 2
    return np.where(mid < bins.low[at + 1], mid, bins.high[at]), at


def _grow(rows: DataFrame, most: int, least_bad: int) -> Rule | None:
    """Add the condition with the highest gain until no good row is covered; none for fewer than `least_bad` bad rows."""
    chosen: list[Condition] = []
    while len(chosen) < most:
        bins = counted(rows)
        p0, n0 = int(bins[0].bad.sum()), int(bins[0].good.sum())
        if not n0 or p0 < (1 if chosen else least_bad):
            break
        base, best, pick = np.log2(p0 / (p0 + n0)), 1e-9, None
        for name, b in zip(RATIOS, bins, strict=True):
            cuts, at = _cuts(b)
            if not len(cuts):
                continue
            below = np.cumsum(b.bad)[at], np.cumsum(b.good)[at]
            # For each threshold the rows above it, then those below.
            p, n = np.stack([p0 - below[0], below[0]], 1).ravel(), np.stack([n0 - below[1], below[1]], 1).ravel()
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -np.inf)
            if gain[k := int(np.argmax(gain))] > best:
                best, pick = gain[k], Condition(name, k % 2 == 0, float(cuts[k // 2]))
        if pick is None:
            break
        chosen.append(pick)
        rows = rows.where(pick.column())
    return Rule(tuple(chosen)) if chosen else None


def _pruned(rule: Rule, rows: DataFrame) -> tuple[Rule, int, int]:
    """The beginning of `rule` that is worth most on `rows`, the shortest of equals, with the bad and good rows it covers."""
    options = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    n = rows.agg(*[F.count_if(r.column() & y) for r in options for y in (F.col("y") == 0, F.col("y") != 0)]).first()
    worth = [((n[2 * k] - n[2 * k + 1]) / (n[2 * k] + n[2 * k + 1]) if n[2 * k] + n[2 * k + 1] else -1.0, -k) for k in range(len(options))]
    k = -max(worth)[1]
    return options[k], n[2 * k], n[2 * k + 1]


def learn(rows: DataFrame, min_precision: float = 0.9, max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    """Sequential covering: grow a rule on one part of `rows` (y, to_prune and the features), prune it on the other, take it while it is precise there."""
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule = _grow(rows.where("not to_prune"), max_conditions, 3)
        if rule is None:
            break
        rule, p, n = _pruned(rule, rows.where("to_prune"))
        if p == 0 or p / (p + n) < min_precision:
            break
        rules.append(rule)
        rows = rows.where(~rule.column())
    return rules


def _learned(stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn from `stats` (doc_id and the features) of all labelled rows (label 0: bad)."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    to_prune = F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0
    return learn(kept(stats.join(known, "doc_id").select("y", to_prune.alias("to_prune"), *RATIOS), "labelled"))


def learned_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    return _learned(with_ratios(docs.select("doc_id", "text")).select("doc_id", *RATIOS), labels)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


RESULTS = [*BASE, "base_failed", "rule", "kept"]


def _packed(docs: DataFrame) -> DataFrame:
    """All but the text travels as one value, so that no column meets the statistics."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in RESULTS]).alias("row"), "text")


def _judged(stats: DataFrame, rules: list[Rule], columns: list[str]) -> DataFrame:
    fired = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        fired = F.when(rules[k - 1].column(), F.lit(k)).otherwise(fired)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", fired).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns if c not in RESULTS], *RESULTS)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`docs` with the base counts, base_failed, rule (first rule of the list that rejects, else null) and kept."""
    packed = _packed(docs)
    return _judged(with_ratios(packed) if rules else with_base(packed), rules, docs.columns)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows and statistics are written once; the list is learned from them, and they are judged."""
    stats = kept(with_ratios(_packed(docs)), "statistics")
    return _judged(stats, _learned(stats.select("row.doc_id", *RATIOS), labels), docs.columns)
