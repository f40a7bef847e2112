"""Latest row per key, and what changed from row to row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` columns of each key, all columns kept.

    ``row_number() = 1`` is also applied before the shuffle (window group
    limit), so a key with very many rows sends one row per task.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return frame.withColumn("__rank", F.row_number().over(newest)).where("__rank = 1").drop("__rank")


def status_changes(frame: DataFrame, keys: Sequence[str], status: str, order: Sequence[str]) -> DataFrame:
    """One row per change of ``status`` between neighbouring rows of a key.

    Gives the keys, ``order[0]`` of the later row, ``de_status`` and
    ``para_status``.  The rows are dealt in ranges of key and order, so that the
    rows of one key, however many, lie in as many tasks as they fill.
    Neighbours are found inside a range first; then only the first and last rows
    of ranges are put in order per key, to find those between ranges.
    """
    rising = [F.col(c).asc_nulls_first() for c in order]
    inside = Window.partitionBy(*keys, "__range").orderBy(*rising)
    ranges = frame.select(*dict.fromkeys([*keys, *order, status])).repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *rising)
    marked = (
        ranges.withColumn("__range", F.spark_partition_id())
        .withColumn("__n", F.row_number().over(inside))
        .withColumn("__before", F.lag(status).over(inside))
        .withColumn("__edge", (F.col("__n") == 1) | ~F.lead(F.lit(True), 1, False).over(inside))
        .where(F.col("__edge") | ~F.col("__before").eqNullSafe(F.col(status)))
    )
    # Rows that are no edge know the row before them; they stay where they are.
    along = Window.partitionBy(*keys, "__edge", F.when(~F.col("__edge"), F.col("__range"))).orderBy("__range", "__n")
    first = F.col("__n") == 1
    return (
        marked.withColumn("__known", ~first | F.lag(F.lit(True), 1, False).over(along))
        .withColumn("de_status", F.when(first, F.lag(status).over(along)).otherwise(F.col("__before")))
        .where(F.col("__known") & ~F.col("de_status").eqNullSafe(F.col(status)))
        .select(*keys, order[0], "de_status", F.col(status).alias("para_status"))
    )


def change_counts(changes: DataFrame) -> DataFrame:
    """Number of changes per (from, to)."""
    return changes.groupBy("de_status", "para_status").agg(F.count("*").alias("mudancas"))
