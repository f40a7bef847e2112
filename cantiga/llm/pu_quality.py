"""Positive-unlabelled learning of a quality score.

Trusted positives and unlabelled text are told apart with an additive model
over binned shares of a text.  Its loss is the non-negative unbiased risk: the
positives' loss weighted by the class prior, plus the unlabelled rows' loss as
negatives less the positives' part of it, which is never let below 0.  The
class prior is estimated over all rows: it is the smallest ratio of the
unlabelled to the positive rows above a score, with a margin for chance, where
each row is scored by a model that has not seen it.  No negative label is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga.llm.common import drawn, per_text
from cantiga.llm.text_stats import COUNTS, counts, shares, with_counts


@dataclass(frozen=True)
class PuSettings:
    #: Positives and unlabelled rows that are fitted on, at most about; taken by the hash of id and text, copies once.
    positive_rows: int = 20_000
    unlabelled_rows: int = 40_000
    bins: int = 12
    steps: int = 400
    rate: float = 0.05
    decay: float = 3e-3
    #: Parts of the rows, each scored for the prior by a model fitted without it.
    folds: int = 3
    #: Scores above which rows are counted for the prior.
    cuts: int = 91


@dataclass(frozen=True)
class Model:
    #: Upper edges of the bins of each share, and the weight of each bin.
    edges: dict[str, np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, values: dict[str, np.ndarray]) -> np.ndarray:
        """The chance that a row is positive."""
        return 1 / (1 + np.exp(-np.clip(self.bias + _sum(self.weights, _binned(values, self.edges)), -30, 30)))


def _binned(values: dict[str, np.ndarray], edges: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, values[name], side="left") for name, e in edges.items()], axis=1)


def _sum(weights: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return weights[np.arange(weights.shape[0]), bins].sum(axis=1)


def _descend(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, s: PuSettings) -> tuple[np.ndarray, float]:
    """Weights that minimise the non-negative risk; without a prior, of telling the two samples apart."""
    k, width = positive.shape[1], s.bins + 1
    flat = [x + np.arange(k) * width for x in (positive, unlabelled)]
    w, bias = np.zeros(k * width), 0.0
    m, v = np.zeros(k * width + 1), np.zeros(k * width + 1)

    def gradient(slopes: np.ndarray, places: np.ndarray) -> np.ndarray:
        out = np.bincount(places.ravel(), np.repeat(slopes, k), k * width) / len(slopes)
        return np.append(out, slopes.mean())

    def chance(places: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(w[places].sum(axis=1) + bias, -30, 30)))

    for step in range(1, s.steps + 1):
        p, u = chance(flat[0]), chance(flat[1])
        if prior is None:
            slope = gradient(p - 1, flat[0]) + gradient(u, flat[1])
        else:
            negative = -np.log1p(-np.minimum(u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-12)).mean()
            as_negative = gradient(u, flat[1]) - prior * gradient(p, flat[0])
            # Below 0 the sample is overfitted: the step goes the other way.
            slope = prior * gradient(p - 1, flat[0]) + as_negative if negative >= 0 else -as_negative
        slope[:-1] += s.decay * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w.reshape(k, width), float(bias)


def prior_from_tails(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int) -> float:
    """The share of positives among the unlabelled, from the shares of both above the same scores."""
    margin = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n_positive) + 1 / np.sqrt(n_unlabelled))
    some = positive > 0
    if not some.any():
        return 0.5
    best = int(np.argmin(np.where(some, (unlabelled + margin) / np.where(some, positive, 1), np.inf)))
    # The ratio can only be too high, so half the margin comes off.
    return float(np.clip(unlabelled[best] / positive[best] - margin / 2, 0.02, 0.98))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, cuts: int = 91) -> float:
    """The share of positives among the unlabelled, from scores of both."""
    at = np.unique(np.quantile(positive, np.linspace(0, 0.9, cuts)))
    tails = [1 - np.searchsorted(np.sort(x), at, side="left") / len(x) for x in (positive, unlabelled)]
    return prior_from_tails(*tails, len(positive), len(unlabelled))


@dataclass(frozen=True)
class Unseen:
    """Models that tell positives from unlabelled rows, one for each part of the rows, fitted without it."""

    edges: dict[str, np.ndarray]
    weights: list[np.ndarray]
    #: Scores above which rows are counted.
    cuts: np.ndarray

    def bins(self, values: dict[str, np.ndarray], fold: np.ndarray) -> np.ndarray:
        """How many of the cuts each row's score reaches."""
        rows = _binned(values, self.edges)
        scores = np.zeros(len(rows))
        for k, weights in enumerate(self.weights):
            scores[fold == k] = _sum(weights, rows[fold == k])
        return np.searchsorted(self.cuts, scores, side="right")


def edges_of(positive: dict[str, np.ndarray], unlabelled: dict[str, np.ndarray], s: PuSettings) -> dict[str, np.ndarray]:
    quantiles = np.linspace(0, 1, s.bins + 1)[1:-1]
    return {name: np.unique(np.quantile(np.concatenate([positive[name], unlabelled[name]]), quantiles)) for name in positive}


def learn_unseen(positive: dict[str, np.ndarray], unlabelled: dict[str, np.ndarray], folds: tuple[np.ndarray, np.ndarray], s: PuSettings) -> Unseen:
    edges = edges_of(positive, unlabelled, s)
    rows = _binned(positive, edges), _binned(unlabelled, edges)
    weights, scores = [], np.zeros(len(rows[0]))
    for k in range(s.folds):
        some = [r[f != k] if (f != k).any() else r for r, f in zip(rows, folds)]
        weights.append(_descend(*some, None, s)[0])
        scores[folds[0] == k] = _sum(weights[k], rows[0][folds[0] == k])
    return Unseen(edges, weights, np.unique(np.quantile(scores, np.linspace(0, 0.9, s.cuts))))


def learn(positive: dict[str, np.ndarray], unlabelled: dict[str, np.ndarray], prior: float, settings: PuSettings = PuSettings()) -> Model:
    edges = edges_of(positive, unlabelled, settings)
    weights, bias = _descend(_binned(positive, edges), _binned(unlabelled, edges), prior, settings)
    return Model(edges, weights, bias, prior)


def _fold(folds: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit("fold")), F.lit(folds)).cast("int")


def count_tails(texts: DataFrame, ids: DataFrame, unseen: Unseen, s: PuSettings) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Shares of the positive and of all rows above each cut, and their numbers: one pass over all texts, which moves only counts by id and bin."""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(x.as_py()) for x in batch.column(2)], np.int64).reshape(-1, len(COUNTS))
            of = unseen.bins(shares({c: found[:, i] for i, c in enumerate(COUNTS)}), batch.column(1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(of, pa.int32())], names=["doc_id", "bin"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    by_id = texts.select("doc_id", _fold(s.folds), "text").mapInArrow(bins, f"doc_id {kind}, bin int").groupBy("doc_id", "bin").agg(F.count("*").alias("n"))
    flagged = by_id.join(ids.withColumn("trusted", F.lit(1)), "doc_id", "left")
    rows = flagged.groupBy("bin").agg(F.sum("n").alias("every"), F.sum(F.col("n") * F.coalesce("trusted", F.lit(0))).alias("trusted")).collect()
    totals = np.zeros((2, len(unseen.cuts) + 1))
    for r in rows:
        totals[:, r.bin] = r.trusted, r.every
    above = totals[:, ::-1].cumsum(axis=1)[:, ::-1]
    n = np.maximum(above[:, :1], 1)
    return above[0, 1:] / n[0], above[1, 1:] / n[1], int(n[0, 0]), int(n[1, 0])


def fit(documents: DataFrame, trusted: DataFrame, settings: PuSettings = PuSettings()) -> Model | None:
    """Fit on ``documents`` (``doc_id``, ``text``); ``trusted`` has the ids of positives.  None without any."""
    s = settings
    ids = trusted.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    texts = documents.select("doc_id", "text")

    def sample(n: int, most: int, salt: str, of: DataFrame | None) -> tuple[dict[str, np.ndarray], np.ndarray] | None:
        rows = texts.where(drawn(salt, most, n))
        if of is not None:
            # A row for each drawn positive at most, about ``most``: sent to the texts, so that none is shuffled.
            rows = rows.join(F.broadcast(rows.select("doc_id").join(of, "doc_id").distinct()), "doc_id")
        # Copies of a row count once: they are drawn together, and may be any number.
        counted = with_counts(rows.withColumn("fold", _fold(s.folds)), ["doc_id", "fold"]).distinct()
        found = counted.toPandas().sort_values([*COUNTS, "fold"], kind="stable")
        return (shares({c: found[c].to_numpy() for c in COUNTS}), found["fold"].to_numpy()) if len(found) else None

    positive = sample(texts.select("doc_id").join(ids, "doc_id").count(), s.positive_rows, "positive", ids)
    unlabelled = sample(texts.count(), s.unlabelled_rows, "unlabelled", None) if positive else None
    if not positive or not unlabelled:
        return None
    unseen = learn_unseen(positive[0], unlabelled[0], (positive[1], unlabelled[1]), s)
    return learn(positive[0], unlabelled[0], prior_from_tails(*count_tails(texts, ids, unseen, s)), s)


def scored(documents: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` and the score of every row's ``text``; 0.5 without a model.  Counts and scores are one pass."""
    if model is None:
        return documents.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.5).alias("score"))

    def score(texts: pa.Array) -> pa.Array:
        found = np.array([counts(x.as_py()) for x in texts], np.int64).reshape(-1, len(COUNTS))
        return pa.array(model.score(shares({c: found[:, i] for i, c in enumerate(COUNTS)})))

    return per_text(documents, keep, {"score": "double"}, lambda texts: [score(texts)])


def score_quality(documents: DataFrame, labels: DataFrame, learns: Column, settings: PuSettings = PuSettings(), keep: list[str] | None = None) -> tuple[DataFrame, Model | None]:
    """A score from 0 to 1 for every row of ``documents`` (``doc_id``, ``text``), and the model.

    ``labels`` (``doc_id``, ``quality``) gives the trusted positives, quality 1; ids
    whose labels disagree are not trusted.  Rows where ``learns`` is false take
    no part in the fit.  Null and empty texts are scored as texts without
    words; without positives every score is 0.5; repeated rows each get their
    score; an empty table gives no rows.  ``keep`` names further columns; one
    named like a count or the score gives way.
    """
    keep = ["doc_id", *[c for c in keep or [] if c.lower() not in (*COUNTS, "score", "doc_id")]]
    positive = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where(F.col("quality") == 1)
    model = fit(documents.where(learns), positive, settings)
    return scored(documents, model, keep), model
