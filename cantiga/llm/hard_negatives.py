"""Hard negatives for anchors, found with Fagin's threshold algorithm.

Vectors are scaled to whole numbers, so scores are exact.  Rows of a label are
dealt into shards of bounded size; a shard keeps, for each dimension, its rows
sorted by that component.  An anchor reads these lists from the end that its
own component's sign points to.  Each row met is scored by looking its vector
up.  What the anchor's components would give with the values just read is the
threshold: no row not yet met scores more.  The anchor is done with the shard
when the threshold lies strictly below the k-th score of each of its windows,
or below a window that has not so many, so that ties are never cut.

The first pass asks the shards of the anchor's label for its positives; the
second asks those of the other labels, with a window of scores for each
positive.  The best of all shards are ranked in a window of Spark's.  A shard's
lists are made once, and the anchors stream by it: a task holds one shard and
a batch of anchors, however many of either there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cantiga.llm.common import Stored

#: Scores are held inside a long.
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class MiningSettings:
    #: Components are multiplied by this and rounded down.
    scale: float = 256.0
    positives: int = 5
    negatives: int = 3
    #: A negative scores from ``low`` to ``high`` hundredths of the positive.
    low: int = 50
    high: int = 95
    #: Rows of a shard, at most about.
    shard_rows: int = 4096
    #: Rows that are first read of each list; every look at the lists goes twice as deep as the one before.
    first_depth: int = 8


def _exact(x: np.ndarray, largest: float) -> np.ndarray:
    """Whole numbers as floats while sums of products of them are exact, else as Python's integers."""
    return x if largest < 2.0**53 else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _kth(scores: np.ndarray, k: int):
    return np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[-k]


class Shard:
    """Rows with a sorted list for each dimension."""

    def __init__(self, rows: np.ndarray, x: np.ndarray):
        self.rows, self.x = rows, x
        self.up = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.up, axis=0)
        self.most = float(np.abs(x).max(initial=0.0))
        self.as_int: np.ndarray | None = None

    def top(self, q: np.ndarray, own: int, windows: list[tuple[float, float]], k: int, first: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window the places and scores of its ``k`` best rows, ties of the last included, and how many rows were scored."""
        n, dimensions = self.x.shape
        largest = self.most * float(np.abs(q).max(initial=0.0)) * max(1, dimensions)
        x, values, q = self.x, self.values, _exact(q[None, :], largest)[0]
        if q.dtype == object:
            self.as_int = _exact(x, np.inf) if self.as_int is None else self.as_int
            x, values = self.as_int, np.take_along_axis(self.as_int, self.up, axis=0)
        # Lists of components that are 0 in the anchor say nothing.
        falling, rising = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = self.rows == own
        places, scores = [np.zeros(0, np.int64)], [np.zeros(0, q.dtype)]
        start, depth, done = 0, min(first, n), False
        while not done:
            met = np.zeros(n, bool)
            met[self.up[n - depth : n - start, falling].ravel()] = True
            met[self.up[start:depth, rising].ravel()] = True
            if depth == n:
                met[:] = True
            met &= ~seen
            seen |= met
            new = np.flatnonzero(met)
            places.append(new)
            scores.append(x[new] @ q)
            at, found = np.concatenate(places), np.concatenate(scores)
            threshold = values[n - depth, falling] @ q[falling] + values[depth - 1, rising] @ q[rising]
            inside = [(found >= low) & (found <= high) for low, high in windows]
            kth = [_kth(found[i], k) if i.sum() >= k else None for i in inside]
            done = depth == n or all(threshold < (low if best is None else best) for best, (low, _) in zip(kth, windows))
            start, depth = depth, min(2 * depth, n)
        out = []
        for i, best in zip(inside, kth):
            keep = i if best is None else i & (found >= best)
            out.append((at[keep], found[keep]))
        return out, len(at)


_FOUND = "anchor long, window int, row long, score long"


def _search(candidates: DataFrame, anchors: DataFrame, k: int, s: MiningSettings) -> DataFrame:
    """The best rows of each shard for each window of the anchors sent to it.

    ``candidates``: shard, row, vector.  ``anchors``: shard, row, vector, positives (the
    positives' scores; null asks for the best rows whatever their score).
    """
    none = F.lit(None).cast("array<long>")
    both = candidates.select("shard", F.lit(False).alias("asks"), "row", "vector", none.alias("positives")).union(anchors.select("shard", F.lit(True), "row", "vector", "positives"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        name, shard = None, None
        rows: list[int] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for at, asks, row, vector, positives in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3).to_numpy(zero_copy_only=False), batch.column(4).to_pylist()):
                if at != name:
                    name, shard, rows, vectors = at, None, [], []
                x = np.floor(s.scale * np.asarray(vector, np.float64))
                if not asks:
                    rows.append(row)
                    vectors.append(x)
                    continue
                if not rows:
                    continue
                if shard is None:
                    shard = Shard(np.array(rows), np.stack(vectors))
                windows = [(-np.inf, np.inf)] if positives is None else [(-(-s.low * p // 100), s.high * p // 100) for p in positives]
                found, _ = shard.top(x, row, windows, k, s.first_depth)
                for window, (places, scores) in enumerate(found):
                    out += [(row, window, r, max(-_LONG, min(_LONG, int(score)))) for r, score in zip(shard.rows[places].tolist(), scores)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["anchor", "window", "row", "score"])

    return both.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(walk, _FOUND)


def mine(vectors: DataFrame, is_anchor: Column, settings: MiningSettings = MiningSettings()) -> DataFrame:
    """Hard negatives among ``vectors`` (``vec_id``, ``embedding``, ``label``) for the rows where ``is_anchor`` holds.

    An anchor's positives are the first rows of its label but itself, its
    negatives for a positive the first rows of other labels with a score inside
    the window; higher scores come first, ties by smaller vec_id (null last),
    then in the order of the rows.  Returns anchor_id, positive_id, rank (from
    1), negative_id, positive_score, negative_score.

    Rows with a null label or vector, or a null or non-finite component, take no
    part; vectors meet those of their own length only.  Rows with a null vec_id
    can be found; a null ``is_anchor`` is false.  Repeated rows are rows of their
    own: the copy of an anchor is another row.  A positive at or below 0 leaves no window
    but a score of 0 for 0.  An empty table gives no rows; other columns are
    ignored.  Scores beyond a long are held at its ends.
    """
    s = settings
    stored = Stored(vectors.sparkSession, "negatives")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    usable = vectors.select("vec_id", "label", F.col("embedding").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks")).where(F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = stored.keep(usable.withColumn("row", F.monotonically_increasing_id()).withColumn("length", F.size("vector")))
    sizes = stored.keep(rows.groupBy("length", "label").agg(F.ceil(F.count("*") / s.shard_rows).cast("long").alias("parts")))
    shards = stored.keep(sizes.select("length", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    name = F.concat_ws("/", "length", "label", "part")
    dealt = rows.join(sizes, ["length", "label"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts"))
    candidates = dealt.select(name.alias("shard"), "row", "vector")
    # Anchors of one length are spread over several keys, each with a copy of the list of shards.
    askers = rows.where("asks")
    spread = max(1, -(-askers.count() // 512))
    copies = shards.select("length", F.col("label").alias("its"), name.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("copy"))
    asking = askers.withColumn("copy", F.pmod(F.xxhash64("row"), F.lit(spread)).cast("int")).select("length", "copy", "label", "row", "vector")
    near = asking.join(copies, ["length", "copy"]).where("label = its").select("shard", "row", "vector", F.lit(None).cast("array<long>").alias("positives"))
    ids = rows.select("row", F.col("vec_id").alias("found_id"))

    def ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("found_id"), "row")
        return found.join(ids, "row").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    positives = stored.keep(ranked(_search(candidates, near, s.positives, s), ["anchor"], s.positives).select("anchor", "rank", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")))
    scores = positives.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "positive_score")))["positive_score"].alias("positives"))
    far = asking.join(scores, "row").join(copies, ["length", "copy"]).where("label != its").select("shard", "row", "vector", "positives")
    negatives = ranked(_search(candidates, far, s.negatives, s), ["anchor", "window"], s.negatives)
    of_window = negatives.select("anchor", "window", F.col("rank").alias("place"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    joined = of_window.join(positives.withColumn("window", F.col("rank") - 1), ["anchor", "window"]).join(rows.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return joined.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


#: The same result for the registered query, with every score.
NEGATIVES_SQL = """
WITH rows AS (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.row <> b.row AND len(a.v) = len(b.v)
), positives AS (
    SELECT anchor, anchor_id, vec_id AS positive_id, row AS positive, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5
), placed AS (
    SELECT p.anchor_id, positive_id, n.vec_id AS negative_id, positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.vec_id, n.row) AS rank
    FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM placed WHERE rank <= 3
"""
