"""Months kept as text ``yyyy-MM``, which sorts like the calendar."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = re.compile(r"\d{4}-(0[1-9]|1[0-2])")


def month_of(day: Column) -> Column:
    """``yyyy-MM`` of a date or timestamp."""
    return F.date_format(day, "yyyy-MM")


def first_day(month: Column) -> Column:
    """The date a ``yyyy-MM`` text begins with; null for text that is no month."""
    return F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")


def add_months_text(month: Column, n: int) -> Column:
    """Shift a ``yyyy-MM`` text by ``n`` months; text that is no month gives null."""
    return month_of(F.add_months(first_day(month), n))


def receipt_month(month: Column, origin: Column) -> Column:
    """Month the money is expected: three months later, same month for shows."""
    return F.when(origin == "DSU", month).otherwise(add_months_text(month, 3))


def month_prefix(day: str | date | None) -> str | None:
    """The ``yyyy-MM`` of an ISO day."""
    return None if day is None else str(day)[:7]


def months_between(column: Column, start: str | None, end: str | None) -> list[Column]:
    """Text comparison with each given bound, both ends included."""
    bounds = []
    if start:
        bounds.append(column >= F.lit(month_prefix(start)))
    if end:
        bounds.append(column <= F.lit(month_prefix(end)))
    return bounds


def days_between_months(day: Column, start: str | None, end: str | None) -> list[Column] | None:
    """The same range as a bare comparison on a date column, which a scan can skip row groups with.

    None when a bound is no real month: the caller then compares text.
    """
    first, last = month_prefix(start) or None, month_prefix(end) or None
    if any(m is not None and not _MONTH.fullmatch(m) for m in (first, last)):
        return None
    bounds = []
    if first:
        bounds.append(day >= F.lit(f"{first}-01").cast("date"))
    if last:
        bounds.append(day < F.add_months(F.lit(f"{last}-01").cast("date"), 1))
    return bounds
