"""Metrics by dimensions over one approved source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cantiga.catalog import Dimension, Metric, Source, approved_source, check_keys
from cantiga.functions.months import days_between_months, months_between
from cantiga.sources.registry import Registry
from cantiga.sources.relation import Lookup, Relation, fewest_joins

DEFAULT_LIMIT = 100


@dataclass(frozen=True)
class MetricResult:
    """A lazy result with what it was made from."""

    frame: DataFrame
    source: str
    source_tables: tuple[str, ...]
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...]
    ignored_filters: tuple[str, ...] = ()


def _month_filter(relation: Relation, period: Dimension, start: str | None, end: str | None) -> list[Column]:
    """The month range; on the date a month comes from where there is one."""
    day = period.day or dict(relation.days).get(period.inputs[0])
    if day is not None and day in relation.base_columns:
        bounds = days_between_months(F.col(day), start, end)
        if bounds is not None:
            return bounds
    return months_between(period.value(), start, end)


def _equal_ignoring_case(dimension: Dimension, value: object) -> Column:
    return F.lower(dimension.value().cast("string")) == F.lower(F.lit(str(value)))


def spellings(frame: DataFrame, column: str, value: object, most: int = 256) -> list[str] | None:
    """The values of a text column that equal ``value`` but for case; None where there are more than ``most``.

    Reads that column only.
    """
    if not isinstance(frame.schema[column].dataType, StringType):
        return None
    same = frame.select(F.col(column).alias("v")).where(F.lower("v") == F.lower(F.lit(str(value)))).distinct()
    found = [r.v for r in same.limit(most + 1).collect()]
    return found if len(found) <= most else None


def _asked_rows(
    relation: Relation, spec: Source, conditions: Sequence[tuple[Dimension, object]], date_range: tuple[str | None, str | None] | None, find_spellings: bool = False
) -> DataFrame:
    """The base rows that the filters on its own columns and the range of months leave."""
    frame = relation.base
    for dimension, value in conditions:
        if set(dimension.inputs) <= relation.base_columns:
            # A dimension made from a date has no spellings.
            found = spellings(relation.base, dimension.inputs[0], value) if find_spellings and dimension.day is None else None
            frame = frame.where(_equal_ignoring_case(dimension, value) if found is None else F.col(dimension.inputs[0]).isin(found))
    period = spec.dimensions.get("period")
    if period is not None and date_range is not None:
        for bound in _month_filter(relation, period, *date_range):
            frame = frame.where(bound)
    return frame


def files_behind(
    registry: Registry, source: str | None = None, date_range: tuple[str | None, str | None] | None = None, filters: Mapping[str, object] | None = None
) -> DataFrame:
    """The files that a query with these arguments takes rows from: fonte, tabela, arquivo, bytes (of the whole file), linhas.

    Files that the scan skips, or whose rows the filters all refuse, are not
    listed.  Filters on looked-up columns act after the scan and leave the list
    as it is.  The source must be a table of files, not a frame made from some.
    """
    spec = approved_source(source)
    relation = registry.relation(spec.name)
    conditions = [(spec.dimensions[key], value) for key, value in dict(filters or {}).items() if key in spec.dimensions]
    rows = _asked_rows(relation, spec, conditions, date_range)
    return (
        rows.groupBy(F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_size").alias("bytes"))
        .agg(F.count("*").alias("linhas"))
        .select(F.lit(spec.name).alias("fonte"), F.lit(relation.tables[0]).alias("tabela"), "arquivo", "bytes", "linhas")
    )


def _zero_for_counts(metric: Metric, total: Column) -> Column:
    return F.coalesce(total, F.lit(0)) if metric.counts_rows else total


def metric_query(
    registry: Registry,
    source: str | None = None,
    metrics: Sequence[str] = (),
    dimensions: Sequence[str] = (),
    date_range: tuple[str | None, str | None] | None = None,
    filters: Mapping[str, object] | None = None,
    limit: int | None = DEFAULT_LIMIT,
    find_spellings: bool = False,
) -> MetricResult:
    """Sum ``metrics`` by ``dimensions``, ordered by the dimensions, first ``limit`` rows.

    ``date_range`` holds ISO days and is cut to months.  A filter on a key the
    source does not have is ignored and reported.  ``limit=None`` keeps all rows.
    ``find_spellings`` first reads the column of a text filter for the ways its
    value is written; the query then asks for these, which a scan can skip row
    groups by, where ``lower()`` of a column reads them all.  It pays on wide
    tables that are clustered by the column.

    Rows are summed by the lookup keys before anything is looked up: a key that
    holds a third of the table is one row per task by the time it is joined.
    """
    spec = approved_source(source)
    metrics, dimensions = list(dict.fromkeys(metrics)), list(dict.fromkeys(dimensions))
    check_keys(spec, metrics, dimensions)
    if not metrics and not dimensions:
        raise ValueError("A query needs a metric or a dimension")

    relation = registry.relation(spec.name)
    chosen = [spec.dimensions[key] for key in dimensions]
    measured = [spec.metrics[key] for key in metrics]
    filters = dict(filters or {})
    ignored = tuple(key for key in filters if key not in spec.dimensions)
    conditions = [(spec.dimensions[key], value) for key, value in filters.items() if key in spec.dimensions]

    def in_base(dimension: Dimension) -> bool:
        return set(dimension.inputs) <= relation.base_columns

    frame = _asked_rows(relation, spec, conditions, date_range, find_spellings)
    late_filters = [(d, v) for d, v in conditions if not in_base(d)]
    looked_up = [d for d in chosen if not in_base(d)]
    chain = relation.needed_lookups(
        column for d in [*looked_up, *[d for d, _ in late_filters]] for column in d.inputs
    )
    if chain:
        result = _sum_then_look_up(frame, relation, chain, chosen, measured, late_filters)
    else:
        result = _sum_directly(frame, chosen, measured)

    if chosen:
        result = result.orderBy(*[F.col(d.key).asc_nulls_last() for d in chosen])
    if limit is not None:
        result = result.limit(max(limit, 1))
    return MetricResult(result, spec.name, relation.tables, tuple(metrics), tuple(dimensions), ignored)


def _sum_directly(frame: DataFrame, chosen: list[Dimension], measured: list[Metric]) -> DataFrame:
    keys = [d.value().alias(d.key) for d in chosen]
    if not measured:
        return frame.select(*keys).distinct()
    sums = [_zero_for_counts(m, m.first_sum()).alias(m.key) for m in measured]
    return frame.groupBy(*keys).agg(*sums) if keys else frame.agg(*sums)


def _sum_then_look_up(
    frame: DataFrame,
    relation: Relation,
    chain: list[Lookup],
    chosen: list[Dimension],
    measured: list[Metric],
    late_filters: list[tuple[Dimension, object]],
) -> DataFrame:
    provided = {column for entry in chain for column in entry.provides}
    base_keys = {k for entry in chain for k in entry.keys if k not in provided}
    base_keys |= {
        c for d in [*chosen, *[d for d, _ in late_filters]] for c in d.inputs
        if c not in provided and not set(d.inputs) <= relation.base_columns
    }
    # What is made of keys alone is made at the end: it need not travel beside them.
    early = [d for d in chosen if set(d.inputs) <= relation.base_columns - base_keys]

    first_keys = [F.col(k) for k in sorted(base_keys)] + [d.value().alias(f"dim__{d.key}") for d in early]
    if measured:
        widened = frame.groupBy(*first_keys).agg(*[m.first_sum().alias(f"sum__{m.key}") for m in measured])
    else:
        widened = frame.select(*first_keys).distinct()
    for entry in fewest_joins(chain):
        widened = entry.attach(widened)
    for dimension, value in late_filters:
        widened = widened.where(_equal_ignoring_case(dimension, value))

    keys = [(F.col(f"dim__{d.key}") if d in early else d.value()).alias(d.key) for d in chosen]
    if not measured:
        return widened.select(*keys).distinct()
    sums = [_zero_for_counts(m, F.sum(f"sum__{m.key}")).alias(m.key) for m in measured]
    return widened.groupBy(*keys).agg(*sums) if keys else widened.agg(*sums)
