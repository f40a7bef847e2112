from __future__ import annotations

from datetime import date
from decimal import Decimal

from cantiga.plans.bookings import booking_quality, missed_opportunities

SHOWS = "artista string, status string, dt_show date, dia_critico boolean"
OK, WAIT, OFF = "CONFIRMADO", "FINANCEIRO/AGUARDAR", "CANCELADO/REMARCAR"
D = [date(2026, 3, d) for d in (6, 7, 13, 14)]


def calendar(spark):
    days = [(d, True) for d in D] + [(date(2026, 3, 9), False), (date(2026, 3, 10), None), (date(2026, 5, 1), True)]
    return spark.createDataFrame(days, "data date, dia_critico boolean")


def test_quality_counts_confirmed_shows_inside_the_calendar(spark):
    shows = spark.createDataFrame(
        [("Ana", OK, D[0], True), ("Ana", OK, D[1], False), ("Ana", OK, D[2], False), ("Ana", OK, None, None),
         ("Ana", WAIT, D[3], True), ("Bia", OK, D[0], True), ("Cid", OFF, D[0], True), ("Ada", OK, D[0], True)],
        SHOWS,
    )
    assert [tuple(r) for r in booking_quality(shows).collect()] == [
        ("Ada", 1, 1, Decimal("100.0")),
        ("Bia", 1, 1, Decimal("100.0")),
        ("Ana", 3, 1, Decimal("33.3")),
    ]
    assert [r.artista for r in booking_quality(shows, "Ana").collect()] == ["Ana"]
    assert booking_quality(shows, "ana").count() == 0


def test_free_days(spark):
    shows = spark.createDataFrame(
        [("Ana", OK, D[0], True), ("Ana", OK, D[0], True), ("Ana", WAIT, D[1], True), ("Ana", OFF, D[2], True),
         ("Bia", OFF, date(2020, 1, 1), None), (None, OK, D[3], True)]
        + [("Full", OK, d, True) for d in D],
        SHOWS,
    )
    got = [tuple(r) for r in missed_opportunities(shows, calendar(spark), None, 8, "2026-03-06").collect()]
    assert got == (
        [("Ana", d) for d in D[1:]] + [("Bia", d) for d in D] + [(None, d) for d in D]
    )
    one = missed_opportunities(shows, calendar(spark), "Ana", 7, "2026-03-06").collect()
    assert [r.data_livre for r in one] == D[1:3]


def test_no_critical_day_ahead(spark):
    shows = spark.createDataFrame([("Ana", OK, D[0], True)], SHOWS)
    assert missed_opportunities(shows, calendar(spark), None, 5, "2030-01-01").count() == 0


def test_today_is_the_default(spark):
    shows = spark.createDataFrame([("Ana", OK, D[0], True)], SHOWS)
    every_day = spark.sql("select date_add(current_date(), cast(id as int)) data, true dia_critico from range(-5, 400)")
    assert missed_opportunities(shows, every_day).count() == 91
