"""Learned decision lists: ordered threshold rules that reject documents.

Sequential covering: a rule is a conjunction of thresholds on shares of a text.
It is grown on two thirds of the labelled rows, one threshold after the other,
by information gain, until it covers no good document; then it is pruned on
the other third.  What it covers is taken out, and the next rule is learned,
until a rule is no longer precise enough on the pruning rows.  The list
becomes one ordered conditional expression that Spark compiles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga.llm.common import drawn
from cantiga.llm.text_stats import COUNTS, SHARES, shares, with_counts


@dataclass(frozen=True)
class Threshold:
    share: str
    #: Holds for values of at least ``value`` (``above``) or at most it.
    above: bool
    value: float

    def of(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.share] >= self.value if self.above else values[self.share] <= self.value

    def column(self) -> Column:
        return share_column(self.share) >= self.value if self.above else share_column(self.share) <= self.value

    def __str__(self) -> str:
        return f"{self.share} {'>=' if self.above else '<='} {self.value:g}"


@dataclass(frozen=True)
class ListSettings:
    #: Labelled rows that are fitted on, at most about; taken by the hash of id and text, copies once.
    fit_rows: int = 60_000
    #: A rule is accepted when so large a share of what it covers of the pruning rows is bad.
    precision: float = 0.98
    #: Bad rows of the growing and pruning parts that a rule covers at least.
    least: int = 4
    longest: int = 4
    rules: int = 24


Rule = tuple[Threshold, ...]


def share_column(name: str) -> Column:
    """A share from the count columns, with the same value as in the fit."""
    for share, a, b in SHARES:
        if share == name:
            return F.col(a) / F.greatest(F.col(b), F.lit(1))
    return F.col(name).cast("double")


def _gain(bad: np.ndarray, good: np.ndarray, before: tuple[float, float]) -> np.ndarray:
    """FOIL's gain of covering so many bad and good rows instead of those before."""
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = bad * (np.log2(bad / (bad + good)) - np.log2(before[0] / sum(before)))
    return np.where(bad > 0, gain, -np.inf)


def _best(values: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, Threshold | None]:
    is_bad = bad[inside]
    before = (float(is_bad.sum()), float((~is_bad).sum()))
    best: tuple[float, Threshold | None] = (0.0, None)
    for share, of_all in values.items():
        x = of_all[inside]
        order = np.argsort(x, kind="stable")
        x, y = x[order], is_bad[order]
        edges = np.flatnonzero(x[1:] > x[:-1])
        if not len(edges):
            continue
        low_bad, low_all = np.cumsum(y)[edges].astype(float), edges + 1.0
        middle = (x[edges] + x[edges + 1]) / 2
        for above, b, n in ((False, low_bad, low_all), (True, before[0] - low_bad, len(x) - low_all)):
            gains = _gain(b, n - b, before)
            k = int(np.argmax(gains))
            if gains[k] > best[0] + 1e-9:
                best = (float(gains[k]), Threshold(share, above, float(middle[k])))
    return best


def _covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(values.values()))), bool)
    for threshold in rule:
        out &= threshold.of(values)
    return out


def learn(values: dict[str, np.ndarray], bad: np.ndarray, prunes: np.ndarray, settings: ListSettings = ListSettings()) -> list[Rule]:
    """Rules for bad rows; ``prunes`` marks the rows that rules are pruned on."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < settings.rules:
        grows = left & ~prunes
        if (bad & grows).sum() < settings.least:
            break
        rule: Rule = ()
        inside = grows.copy()
        while len(rule) < settings.longest and (~bad & inside).any():
            _, threshold = _best(values, bad, inside)
            if threshold is None:
                break
            rule += (threshold,)
            inside &= threshold.of(values)

        def worth(r: Rule) -> tuple[float, int]:
            hit = _covers(r, values) & left & prunes
            b, g = int((bad & hit).sum()), int((~bad & hit).sum())
            return ((b - g) / max(1, b + g), b)

        # The shortest of the best by what they cover of the pruning rows.
        cut = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (*worth(r), -len(r)), default=())
        if not cut:
            break
        hit = _covers(cut, values) & left
        b, g = int((bad & hit & prunes).sum()), int((~bad & hit & prunes).sum())
        if b < settings.least or b < settings.precision * (b + g):
            break
        rules.append(cut)
        left &= ~hit
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list fires: rules in order, then keep."""
    out = F.lit(True)
    for rule in reversed(rules):
        fires = F.lit(True)
        for threshold in rule:
            fires = fires & threshold.column()
        out = F.when(fires, F.lit(False)).otherwise(out)
    return out


def fit(documents: DataFrame, labels: DataFrame, settings: ListSettings = ListSettings()) -> list[Rule]:
    """Learn from ``documents`` (``doc_id``, ``text``) that have ``labels`` (``doc_id``, ``quality``; 0 is bad).

    An id labelled more than once counts with its lowest label; null ids and
    labels do not count.  Without labels of both kinds the list is empty.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = documents.select("doc_id", "text")
    n = texts.select("doc_id").join(known, "doc_id").count()
    if not n:
        return []
    # The labels of the drawn rows are fetched by their ids.  That side has a row for each drawn labelled row at most,
    # about fit_rows, so it is sent to the texts, and no text is shuffled.
    picked = texts.where(drawn("fit", settings.fit_rows, n))
    ids = picked.select("doc_id").join(known, "doc_id").distinct()
    prunes = F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0
    counted = with_counts(picked.join(F.broadcast(ids), "doc_id").withColumn("prunes", prunes), ["doc_id", "quality", "prunes"])
    # Copies of a row count once: they are drawn together, and may be any number.
    # The order of the rows decides nothing but ties of sums; it is fixed all the same.
    rows = counted.distinct().toPandas().sort_values([*COUNTS, "quality", "prunes"], kind="stable")
    values = shares({c: rows[c].to_numpy() for c in COUNTS})
    return learn(values, rows["quality"].to_numpy() == 0, rows["prunes"].to_numpy(bool), settings)


def judge(documents: DataFrame, labels: DataFrame, settings: ListSettings = ListSettings(), keep: list[str] | None = None) -> tuple[DataFrame, list[Rule]]:
    """Counts, ``base_failed`` and ``kept`` for every row of ``documents`` (``doc_id``, ``text``), and the list.

    Base rules come first: fewer than 10 words, or more than a fifth of the words
    in repeated windows.  A null or empty text has no words and fails them.
    Repeated rows each get their row; an empty table gives no rows.  ``keep``
    names further columns to return; one named like a count or a verdict gives
    way to it.
    """
    keep = ["doc_id", *[c for c in keep or [] if c.lower() not in (*COUNTS, "base_failed", "kept", "doc_id")]]
    rules = fit(documents, labels, settings)
    counted = with_counts(documents, keep)
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select("*", base_failed.alias("base_failed"), (~base_failed & verdict(rules)).alias("kept")), rules
