"""Ranked preview, totals and leader of a result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantiga.functions.money import brazilian_number

# Fixed values.
NO_LABEL = "(sem valor)"
RANKED_ROWS = 20
PREVIEW_ROWS = 10
TOP_ROWS = 3


@dataclass(frozen=True)
class Digest:
    preview: DataFrame
    totals: DataFrame
    leader: DataFrame


def _is_number(frame: DataFrame, name: str) -> bool:
    return name in frame.columns and isinstance(frame.schema[name].dataType, T.NumericType)


def _descending(frame: DataFrame, metric: str) -> Column:
    value = F.col(metric) if _is_number(frame, metric) else F.col(metric).try_cast("double")
    return value.desc_nulls_last()


def top_k(frame: DataFrame, metric: str, dimensions: Sequence[str], k: int = TOP_ROWS) -> DataFrame:
    """The ``k`` rows with the greatest metric; null and non-numeric values come last."""
    ties = [F.col(d).asc_nulls_last() for d in dimensions]
    if metric not in frame.columns:
        return frame.orderBy(*ties).limit(k) if ties else frame.limit(k)
    return frame.orderBy(_descending(frame, metric), *ties).limit(k)


def preview(frame: DataFrame, metrics: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """The best rows that have a metric other than zero; all of them if none has.

    The windows below see the ranked rows only, never more than RANKED_ROWS.
    """
    if not metrics:
        return top_k(frame, "", dimensions, PREVIEW_ROWS)
    ranked = top_k(frame, metrics[0], dimensions, RANKED_ROWS)
    order = [_descending(frame, metrics[0]), *[F.col(d).asc_nulls_last() for d in dimensions]]
    meaningful = F.lit(False)
    for m in metrics:
        meaningful = meaningful | (F.coalesce(F.col(m).try_cast("double"), F.lit(0.0)) != 0)
    return (
        ranked.withColumn("posicao", F.row_number().over(Window.orderBy(*order)))
        .withColumn("__meaningful", meaningful)
        .withColumn("__any", F.max("__meaningful").over(Window.partitionBy()))
        .where(F.col("__meaningful") | ~F.col("__any"))
        .orderBy("posicao")
        .limit(PREVIEW_ROWS)
        .drop("__meaningful", "__any")
    )


def totals(frame: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Sum of each metric over the rows of ``frame``, 0.0 where there is nothing to add, and the row count."""
    sums = [
        (F.coalesce(F.sum(m).cast("double"), F.lit(0.0)) if _is_number(frame, m) else F.lit(0.0)).alias(m)
        for m in metrics
    ]
    return frame.agg(*sums, F.count("*").alias("linhas"))


def leader(frame: DataFrame, metrics: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """Label and formatted value of the best row; no row for an empty result."""
    metric = metrics[0]
    first = top_k(frame, metric, dimensions, 1)
    label = F.coalesce(F.col(dimensions[0]).cast("string"), F.lit(NO_LABEL)) if dimensions else F.lit(NO_LABEL)
    return first.select(
        label.alias("rotulo"),
        F.lit(metric).alias("metrica"),
        brazilian_number(F.col(metric), _printed_type(frame, metric)).alias("valor"),
    )


def _printed_type(frame: DataFrame, metric: str) -> T.DataType:
    return frame.schema[metric].dataType


def formatted(frame: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``frame`` with its metrics as Brazilian number text."""
    return frame.withColumns({m: brazilian_number(F.col(m), _printed_type(frame, m)) for m in metrics})


def result_digest(frame: DataFrame, metrics: Sequence[str], dimensions: Sequence[str]) -> Digest:
    """All three parts.  They describe the rows of ``frame``, after its limit."""
    return Digest(preview(frame, metrics, dimensions), totals(frame, metrics), leader(frame, metrics, dimensions))
