"""The calendar dimension and contracts seen through it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga.functions.months import month_of
from cantiga.sources.relation import Lookup, left_lookup

CALENDAR_COLUMNS = ("dia_semana", "fim_de_semana", "feriado", "nome_feriado", "uf_feriado", "dia_critico")

# National holidays with a fixed day, and weekday names.
FIXED_HOLIDAYS = [
    (1, 1, "Confraternizacao Universal"),
    (4, 21, "Tiradentes"),
    (5, 1, "Dia do Trabalho"),
    (9, 7, "Independencia do Brasil"),
    (10, 12, "Nossa Senhora Aparecida"),
    (11, 2, "Finados"),
    (11, 15, "Proclamacao da Republica"),
    (12, 25, "Natal"),
]
# National holidays by their days from Easter Sunday.
MOVABLE_HOLIDAYS = [
    (-48, "Carnaval"),
    (-47, "Carnaval"),
    (-2, "Sexta-feira Santa"),
    (60, "Corpus Christi"),
]
WEEKDAYS = ["domingo", "segunda", "terca", "quarta", "quinta", "sexta", "sabado"]


def easter_sunday(year: Column) -> Column:
    """Easter Sunday of a Gregorian year, by whole-number arithmetic on the column."""

    def over(x: Column, n: int) -> Column:
        return F.floor(x / n).cast("int")

    golden, century, rest = year % 19, over(year, 100), year % 100
    leap_centuries, moon = over(century, 4), over(century - over(century + 8, 25) + 1, 3)
    # Days from 21 March to the full moon, then to the Sunday after it.
    to_moon = (19 * golden + century - leap_centuries - moon + 15) % 30
    to_sunday = (32 + 2 * (century % 4) + 2 * over(rest, 4) - to_moon - rest % 4) % 7
    late = over(golden + 11 * to_moon + 22 * to_sunday, 451)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), to_moon + to_sunday - 7 * late)


def holiday_name(day: Column) -> Column:
    """The name of the national holiday on a day of any year, else null; a fixed one goes before one that moves."""

    def named(names: list[tuple[str | int, str]], key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in names for x in pair]), key)

    fixed = [(f"{month:02}-{number:02}", name) for month, number, name in FIXED_HOLIDAYS]
    return F.coalesce(named(fixed, F.date_format(day, "MM-dd")), named(MOVABLE_HOLIDAYS, F.date_diff(day, easter_sunday(F.year(day)))))


def build_calendar(span: DataFrame, holidays: DataFrame | None = None, bridge_days: DataFrame | None = None) -> DataFrame:
    """One row per day of ``span`` (one row: ``inicio``, ``fim``).

    ``holidays`` (data, nome_feriado, uf_feriado) replaces the national holidays,
    fixed and by Easter, which hold in every year.  ``dia_critico`` is Friday,
    Saturday, the eve of a holiday, or a listed bridge day.  A day after the end of the span
    still counts as a holiday for its eve.
    """
    days = span.select(F.explode(F.sequence("inicio", "fim")).alias("data"))
    if holidays is None:
        calendar = days.withColumns(
            {
                "nome_feriado": holiday_name(F.col("data")),
                "uf_feriado": F.lit(None).cast("string"),
                "__holiday": holiday_name(F.col("data")).isNotNull(),
                "__eve": holiday_name(F.date_add("data", 1)).isNotNull(),
            }
        )
    else:
        named = holidays.groupBy("data").agg(
            F.min("nome_feriado").alias("nome_feriado"), F.min("uf_feriado").alias("uf_feriado")
        )
        eves = holidays.select(F.date_sub("data", 1).alias("data")).distinct().withColumn("__eve", F.lit(True))
        calendar = days.join(named.withColumn("__holiday", F.lit(True)), "data", "left").join(eves, "data", "left")
    if bridge_days is None:
        calendar = calendar.withColumn("__bridge", F.lit(None).cast("boolean"))
    else:
        bridges = bridge_days.select("data").distinct().withColumn("__bridge", F.lit(True))
        calendar = calendar.join(bridges, "data", "left")
    weekday = F.dayofweek("data")
    false = F.lit(False)
    return calendar.select(
        month_of(F.col("data")).alias("ano_mes"),
        "data",
        F.element_at(F.array(*[F.lit(name) for name in WEEKDAYS]), weekday).alias("dia_semana"),
        F.dayofmonth("data").alias("dia_numero"),
        weekday.isin(1, 7).alias("fim_de_semana"),
        F.coalesce("__holiday", false).alias("feriado"),
        "nome_feriado",
        "uf_feriado",
        (weekday.isin(6, 7) | F.coalesce("__eve", false) | F.coalesce("__bridge", false)).alias("dia_critico"),
    )


def calendar_lookup(calendar: Callable[[], DataFrame]) -> Lookup:
    """The calendar columns by show date; a date with a third of the shows is split."""
    return left_lookup(["dt_show"], CALENDAR_COLUMNS, lambda: calendar().withColumnRenamed("data", "dt_show"))


def with_calendar(contracts: DataFrame, calendar: DataFrame) -> DataFrame:
    """Contracts with the calendar columns of their show date; null outside its span."""
    return calendar_lookup(lambda: calendar).attach(contracts)
