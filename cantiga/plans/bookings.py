"""How well shows are placed on critical days, and which such days are free."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga.functions.money import percent
from cantiga.operators.unify import CONFIRMED


def booking_quality(contracts: DataFrame, artist: str | None = None) -> DataFrame:
    """Share of each artist's confirmed shows that fall on a critical day.

    ``contracts``: one row per contract with artista, status, dia_critico.
    Shows outside the calendar are left out, not counted as uncritical.
    """
    known = contracts.where((F.col("status") == CONFIRMED) & F.col("dia_critico").isNotNull())
    if artist is not None:
        known = known.where(F.col("artista") == F.lit(artist))
    critical = F.count_if("dia_critico")
    return (
        known.groupBy("artista")
        .agg(
            F.count("*").alias("total_shows"),
            critical.alias("shows_dia_critico"),
            percent(critical, F.count("*")).alias("pct_dia_critico"),
        )
        .orderBy(F.col("pct_dia_critico").desc_nulls_last(), F.col("artista").asc_nulls_last())
    )


def missed_opportunities(
    contracts: DataFrame,
    calendar: DataFrame,
    artist: str | None = None,
    lookahead_days: int = 90,
    as_of: date | str | None = None,
) -> DataFrame:
    """Critical days from ``as_of`` on, both ends included, without a confirmed show of the artist.

    Every artist of ``contracts`` counts, whatever the status of the contract; a
    day held only by an unconfirmed contract is free.

    One shuffle by artist: the booked days of the window are a set of at most
    ``lookahead_days + 1`` dates, taken from the days of the window.
    """
    first: Column = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")
    last = F.date_add(first, lookahead_days)
    days = calendar.where(F.col("dia_critico") & F.col("data").between(first, last))
    window = days.agg(F.array_sort(F.collect_set("data"))).scalar()

    asked = contracts if artist is None else contracts.where(F.col("artista") == F.lit(artist))
    # A null artist equals no booking, so all of its days stay free.
    is_booked = (F.col("status") == CONFIRMED) & F.col("dt_show").between(first, last) & F.col("artista").isNotNull()
    booked = F.collect_set(F.when(is_booked, F.col("dt_show")))
    return (
        asked.groupBy("artista")
        .agg(booked.alias("__booked"))
        .select("artista", F.explode(F.array_except(window, "__booked")).alias("data_livre"))
        .orderBy(F.col("artista").asc_nulls_last(), "data_livre")
    )
