"""Contracts from the rows that hold every status they had."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga.functions.money import money
from cantiga.operators.calendar import with_calendar
from cantiga.operators.latest import latest_per_key


def net_value(value: Column, open_value: Column) -> Column:
    """What is left of a contract's value without what is still open; null if either is."""
    return money(money(value) - money(open_value))


def latest_contracts(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The latest row of each contract; ``order`` tells rows of one time apart."""
    return latest_per_key(rows, ["contrato"], order)


def build_contracts(rows: DataFrame, calendar: DataFrame, order: Sequence[str] = ("inserted_at", "id")) -> DataFrame:
    """One row per contract with its net value and the calendar of its show date.

    ``rows`` are the raw contract rows (contrato, inserted_at, dt_show, valor,
    falta_receber and others).  The latest row is taken before anything is joined.
    """
    latest = latest_contracts(rows, order)
    return with_calendar(latest.withColumn("valor_liquido", net_value(F.col("valor"), F.col("falta_receber"))), calendar)
