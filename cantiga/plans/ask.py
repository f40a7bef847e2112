"""One question answered: routed, run, and summed up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import SparkSession

from cantiga.plans.digest import Digest, result_digest
from cantiga.plans.metrics import DEFAULT_LIMIT, MetricResult, metric_query
from cantiga.plans.routing import route_questions
from cantiga.sources.registry import Registry


@dataclass(frozen=True)
class Request:
    """What a question stands for."""

    question: str
    source: str
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...]
    date_range: tuple[str | None, str | None] | None
    filters: dict[str, str] = field(default_factory=dict)
    limit: int = DEFAULT_LIMIT
    notes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Answer:
    request: Request
    result: MetricResult

    def digest(self) -> Digest:
        return result_digest(self.result.frame, self.request.metrics, self.request.dimensions)


_STATED = (
    "texto string, source string, metrics array<string>, dimensions array<string>, start_date string, end_date string, "
    "filters map<string,string>"
)


def request_for(
    spark: SparkSession,
    question: str,
    as_of: date | str | None = None,
    source: str | None = None,
    metrics: Sequence[str] | None = None,
    dimensions: Sequence[str] | None = None,
    date_range: tuple[str | None, str | None] | None = None,
    filters: Mapping[str, str] | None = None,
    limit: int = DEFAULT_LIMIT,
) -> Request:
    """Route one question.  Only its one routed row comes to the driver."""
    start, end = date_range or (None, None)
    stated = (
        question, source, list(metrics) if metrics else None, list(dimensions) if dimensions else None, start, end,
        {k: str(v) for k, v in (filters or {}).items()} or None,
    )
    names = [column.split()[0] for column in _STATED.split(", ")[1:]]
    row = route_questions(spark.createDataFrame([stated], _STATED), "texto", as_of, *names).first()
    dates = (row.rota_start_date, row.rota_end_date)
    return Request(
        question,
        row.rota_source,
        tuple(row.rota_metrics),
        tuple(row.rota_dimensions),
        None if dates == (None, None) else dates,
        dict(row.rota_filters),
        limit,
        tuple(row.rota_notes),
    )


def ask(spark: SparkSession, registry: Registry, question: str, as_of: date | str | None = None, **stated) -> Answer:
    """Route a question and build its query; the result stays lazy."""
    request = request_for(spark, question, as_of, **stated)
    result = metric_query(
        registry, request.source, request.metrics, request.dimensions, request.date_range, request.filters, request.limit
    )
    return Answer(request, result)
