"""Money and number formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)


def money(column: Column) -> Column:
    """Exact decimal, so that a sum does not depend on the order of tasks."""
    return column.cast(MONEY)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` with one decimal; null when ``whole`` is zero."""
    exact = F.lit(100).cast("decimal(3,0)") * part.cast("decimal(18,0)") / F.nullif(whole, F.lit(0)).cast("decimal(18,0)")
    return F.round(exact, 1)


def brazilian_number(column: Column, data_type: T.DataType) -> Column:
    """``1.234`` for whole numbers, ``1.234,56`` for fractions, ``-`` for null, text as it is."""
    if isinstance(data_type, T.IntegralType):
        text = F.format_number(column, 0)
    elif isinstance(data_type, T.NumericType):
        text = F.format_number(column.cast("double"), 2)
    else:
        text = column.cast("string")
        return F.coalesce(text, F.lit("-"))
    return F.coalesce(F.translate(text, ",.", ".,"), F.lit("-"))


def plain_values(frame: DataFrame) -> DataFrame:
    """Values as callers outside Spark get them: decimals as double, dates as ISO text."""

    def plain(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            zone = "xxx" if isinstance(field.dataType, T.TimestampType) else ""
            whole = F.date_format(column, f"yyyy-MM-dd'T'HH:mm:ss{zone}")
            fraction = F.date_format(column, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}")
            has_fraction = F.date_format(column, "SSSSSS") != "000000"
            column = F.when(has_fraction, fraction).otherwise(whole)
        return column.alias(field.name)

    return frame.select(*[plain(field) for field in frame.schema.fields])
