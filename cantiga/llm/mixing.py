"""Cube-method balanced sampling: mixing sources to target weights.

A document of a source whose target is r times its size goes in floor(r)
times, and once more with the fraction of r as its inclusion probability.  The
flight phase of the cube method moves the fractions of a few documents at a
time through the null space of the balancing constraints (number of documents,
number of words), so that both totals stay exactly as expected, until each but
a few is 0 or 1.  It runs in blocks; what blocks leave open meets in blocks of
the next round, until one small block per source is left, whose few open
documents are landed on the whole numbers nearest to the totals.
"""

from __future__ import annotations

import itertools
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cantiga.llm.common import Stored

#: Fractions as near to 0 or 1 as this count as such.
_NEAR = 1e-9
#: Documents of a source's last block that the landing decides, beside those the flight leaves open.
LANDING = 64


def _flight(fractions: list[float], sizes: list[float], draw: random.Random) -> list[float]:
    """Move fractions to 0 or 1 while sums of them and of sizes * them hold; up to two stay open.

    Three open documents have one direction in which both sums stand still.  The
    move goes along it, to the end where one of the three is decided; which of
    the two ends is drawn so that each fraction stays the chance of a 1.
    """
    out, pool = list(fractions), []
    for i, fraction in enumerate(fractions):
        if fraction <= _NEAR or fraction >= 1 - _NEAR:
            out[i] = float(round(fraction))
            continue
        pool.append(i)
        if len(pool) < 3:
            continue
        a, b, c = (sizes[j] for j in pool)
        way = (b - c, c - a, a - b)
        if way == (0, 0, 0):
            way = (1.0, -1.0, 0.0)
        ends = []
        for sign in (1, -1):
            ends.append(min((((1 - out[j]) if sign * v > 0 else out[j]) / abs(v) for j, v in zip(pool, way) if v), default=0.0))
        step = ends[0] if draw.random() * (ends[0] + ends[1]) < ends[1] else -ends[1]
        for j, v in zip(pool, way):
            out[j] += step * v
        left = []
        for j in pool:
            if out[j] <= _NEAR or out[j] >= 1 - _NEAR:
                out[j] = float(round(out[j]))
            else:
                left.append(j)
        pool = left
    return out


def _land(fractions: list[float], sizes: list[float]) -> list[float]:
    """Whole numbers for what is open, by descending size, each the one that keeps the words so far nearest to the expected."""
    out, error = list(fractions), 0.0
    for i in sorted((i for i, f in enumerate(fractions) if 0 < f < 1), key=lambda i: -sizes[i]):
        once = error + (1 - fractions[i]) * sizes[i]
        never = error - fractions[i] * sizes[i]
        out[i], error = (1.0, once) if abs(once) < abs(never) else (0.0, never)
    return out


def _fly_block(block: pd.DataFrame) -> pd.DataFrame:
    # Long documents are decided first, so that those left open are short.
    block = block.sort_values(["size", "order", "id"], ascending=[False, True, True], na_position="first", kind="stable")
    fractions, sizes = block["fraction"].tolist(), [float(x) for x in block["size"]]
    # A source's last block keeps documents of all sizes for the landing, which a long one could not even out alone.
    step = max(4, -(-len(fractions) // LANDING)) if block["last"].iloc[0] else 0
    flying = [i for i in range(len(fractions)) if not step or i % step]
    moved = _flight([fractions[i] for i in flying], [sizes[i] for i in flying], random.Random(int(block["order"].iloc[0])))
    for i, fraction in zip(flying, moved):
        fractions[i] = fraction
    return block.assign(fraction=_land(fractions, sizes) if step else fractions)


def ranked(stored: Stored, values: DataFrame, order: list[Column]) -> DataFrame:
    """Number the rows in order from 0, without one task for all of them: ``rank``."""
    spread = stored.keep(values.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in spread.groupBy("__part").count().collect())  # a row per partition
    starts = dict(zip((p for p, _ in counts), itertools.accumulate([0, *[n for _, n in counts]])))
    start = F.lit(0)
    for part, first in starts.items():
        start = F.when(F.col("__part") == part, first).otherwise(start)
    local = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return spread.withColumn("rank", (local + start).cast("long")).drop("__part")


def source_targets(stored: Stored, sources: DataFrame, weights: list[float], most: float) -> DataFrame:
    """Targets of ``sources`` (source, source_size): shares of all words by weight, none over ``most`` times its size."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored.keep(ranked(stored, sources, [F.col("source").asc_nulls_last()]).withColumn("weight", weight))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    limit, level, full = F.col("source_size") * F.lit(float(most)), 0.0, -1
    while True:
        # The level only rises, so a source at its limit stays there.
        free = (limit > F.lit(level) * F.col("weight")) if full >= 0 else F.col("source_size") > 0
        free_weight, taken, at_limit = table.agg(
            F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~free, limit)), F.lit(0.0)), F.count(F.when(~free, 1))
        ).first()
        if at_limit == full or not free_weight:
            break
        level, full = (total - taken) / free_weight, at_limit
    return table.select("source", "source_size", F.least(limit, F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(documents: DataFrame, size: Column, weights: list[float], most: float = 3.0, block: int = 4096, seed: int = 7) -> DataFrame:
    """How many words of each document a mix of ``documents`` (``doc_id``, ``source``) takes.

    Returns doc_id, source, size, source_size, target and ``copies``.  The same rows
    give the same mix on every run.  Null sources form a source of their own,
    the last; a source without words gets the target 0; documents of size 0 are
    never repeated.  Repeated rows are documents of their own; other columns
    are ignored; an empty table gives no rows.
    """
    stored = Stored(documents.sparkSession, "mixing")
    # The place among equal ids tells repeated rows apart; it is 0 for almost all.
    base = stored.keep(documents.select("doc_id", "source", size.cast("long").alias("size"), F.monotonically_increasing_id().alias("row")))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored.keep(source_targets(stored, sources, weights, most))
    rate = F.col("target") / F.col("source_size")
    joined = base.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    sized = joined.withColumn("rate", F.when(F.col("size") > 0, F.least(rate, F.lit(float(most)))).otherwise(0.0))
    whole = F.floor(F.col("rate") + _NEAR)
    order = F.xxhash64("doc_id", "size", F.lit(seed))
    rows = stored.keep(sized.withColumns({"whole": whole, "fraction": F.greatest(F.lit(0.0), F.col("rate") - whole), "order": order}))

    columns = "source string, id long, row long, size long, order long, fraction double, last boolean"
    open_rows = rows.where(F.col("fraction") > _NEAR).select("source", F.col("doc_id").alias("id"), "row", "size", "order", "fraction")
    decided: list[DataFrame] = []
    while True:
        per_source = open_rows.groupBy("source").agg(F.ceil(F.count("*") / block).alias("blocks"))
        n = stored.keep(per_source.withColumnRenamed("source", "of"))
        most_blocks = n.agg(F.max("blocks")).first()[0]
        if most_blocks is None:
            break
        dealt = open_rows.join(n, F.col("source").eqNullSafe(F.col("of"))).withColumns({"block": F.pmod("order", "blocks"), "last": F.col("blocks") == 1})
        flown = stored.keep(dealt.select("source", "id", "row", "size", "order", "fraction", "last", "block").groupBy("source", "block").applyInPandas(lambda b: _fly_block(b.drop(columns="block")), columns))
        decided.append(flown.where(F.col("fraction").isin(0.0, 1.0)))
        open_rows = flown.where(~F.col("fraction").isin(0.0, 1.0)).drop("last")
        if most_blocks == 1:
            break
    if not decided:
        return rows.select("doc_id", "source", "size", "source_size", "target", F.col("whole").cast("long").alias("copies"))
    drawn = decided[0]
    for more in decided[1:]:
        drawn = drawn.unionByName(more)
    # Joined by the number of the row, which the written table holds.
    drawn = drawn.where(F.col("fraction") == 1.0).select("row", F.lit(1).alias("once"))
    return rows.join(drawn, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("once", F.lit(0))).cast("long").alias("copies")
    )
