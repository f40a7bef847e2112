"""What tables look like, and what they should look like."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COLUMNS = "esquema string, tabela string, posicao int, coluna string, tipo string, aceita_nulo boolean"


def _column_rows(schema_name: str, table: str, schema: T.StructType) -> list[tuple]:
    return [
        (schema_name, table, i + 1, f.name, f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(schema.fields)
    ]


def describe_frames(spark: SparkSession, frames: Mapping[str, DataFrame], schema_name: str = "default") -> DataFrame:
    """Schema, table, position, column, type, nullable; from metadata only."""
    rows = [row for table, frame in frames.items() for row in _column_rows(schema_name, table, frame.schema)]
    return spark.createDataFrame(rows, _COLUMNS)


def describe_catalog(spark: SparkSession, schemas: Sequence[str] | None = None) -> DataFrame:
    """The same for the session's catalog; all schemas when none are named."""
    names = list(schemas) if schemas else [d.name for d in spark.catalog.listDatabases()]
    rows = []
    for schema_name in names:
        for table in spark.catalog.listTables(schema_name):
            qualified = table.name if table.isTemporary else f"`{schema_name}`.`{table.name}`"
            rows += _column_rows(schema_name, table.name, spark.table(qualified).schema)
    return spark.createDataFrame(rows, _COLUMNS)


def missing_schemas(spark: SparkSession, enabled: Sequence[str]) -> DataFrame:
    """Enabled schemas the session cannot see."""
    wanted = spark.createDataFrame([(name,) for name in enabled], "esquema string")
    seen = spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "esquema string")
    return wanted.join(seen, "esquema", "left_anti")


def contract_violations(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (tabela, coluna, tipo) that are not there, with the type found instead, if any."""
    found = actual.select("tabela", "coluna", F.col("tipo").alias("tipo_encontrado"))
    return (
        expected.select("tabela", "coluna", "tipo")
        .join(actual.select("tabela", "coluna", "tipo"), ["tabela", "coluna", "tipo"], "left_anti")
        .join(found, ["tabela", "coluna"], "left")
    )
