"""The catalogue as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cantiga.catalog import APPROVED_SOURCES, DEFAULT_SOURCE, SOURCES, VERSION


def catalogue_table(spark: SparkSession) -> DataFrame:
    """One row per source, metric and dimension."""
    rows = []
    for source in SOURCES.values():
        base = (VERSION, source.name, source.name == DEFAULT_SOURCE, source.name in APPROVED_SOURCES)
        rows.append((*base, "source", source.name, None, source.description))
        rows += [(*base, "metric", m.key, m.label, m.description) for m in source.metrics.values()]
        rows += [(*base, "dimension", d.key, d.label, d.description) for d in source.dimensions.values()]
    return spark.createDataFrame(
        rows,
        "versao string, fonte string, padrao boolean, aprovada boolean, tipo string, chave string, "
        "rotulo string, descricao string",
    )


def catalogue_usage(spark: SparkSession, mix: DataFrame) -> DataFrame:
    """Every catalogue entry with the number of routed questions that ask for it."""
    table = catalogue_table(spark)
    return table.join(mix, ["fonte", "tipo", "chave"], "left").fillna({"perguntas": 0})
