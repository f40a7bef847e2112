"""Logical table names resolved to relations."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from cantiga.catalog import LOOKUP_TABLES, SOURCES
from cantiga.sources.relation import Relation, any_row_lookup, single_row_lookup

# Logical names of everything that can be read.
PHYSICAL_TABLES = {**{name: source.table for name, source in SOURCES.items()}, **LOOKUP_TABLES}

CHANNEL_TABLE = "warner_chappell.dim_exploitation_source"


class Registry:
    """Builds each relation once, when it is first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], Relation]]):
        self._builders = dict(builders)
        self._built: dict[str, Relation] = {}

    def names(self) -> list[str]:
        return list(self._builders)

    def relation(self, name: str) -> Relation:
        if name not in self._builders:
            raise ValueError(f"Unknown table: {name}")
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]


def gravadora_lookup(artists: Callable[[], DataFrame]):
    return single_row_lookup("id", "gravadora", artists, alias="matched_artista_id")


def channel_lookup(channels: Callable[[], DataFrame]):
    return any_row_lookup(("income_provider_name", "exploitation_source"), "descricao_canal", channels)


def table_registry(read: Callable[[str], DataFrame]) -> Registry:
    """A registry over finished tables; ``read`` turns ``schema.table`` into a frame.

    The two catalogue dimensions that live in another table become lookups.
    """
    lookups = {
        "royalty_performance": lambda: (gravadora_lookup(lambda: read(LOOKUP_TABLES["dim_artistas"])),),
        "warner_chappell_detail": lambda: (channel_lookup(lambda: read(CHANNEL_TABLE)),),
    }

    def builder(name: str, table: str) -> Callable[[], Relation]:
        return lambda: Relation(read(table), (table,), lookups.get(name, tuple)())

    return Registry({name: builder(name, table) for name, table in PHYSICAL_TABLES.items()})


def parquet_reader(spark: SparkSession, root: str) -> Callable[[str], DataFrame]:
    """Tables as parquet folders ``root/schema/table``."""
    return lambda table: spark.read.parquet(f"{root.rstrip('/')}/{table.replace('.', '/')}")


def jdbc_options(url: str, table: str, column: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    """Options of a read split into ranges of ``column``, so that it is no single-task read."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }


def jdbc_reader(spark: SparkSession, url: str, ranges: Mapping[str, tuple[str, int, int, int]]):
    """Tables of a database; ``ranges`` gives (column, lower, upper, partitions) for each."""
    return lambda table: spark.read.format("jdbc").options(**jdbc_options(url, table, *ranges[table])).load()
