"""A table together with the lookups that can widen it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Found:
    """A lookup that is one join.

    ``rows`` has one row per key: ``key_0``, ``key_1``.. and columns of its own.
    ``settle`` turns these, once joined to a frame, into what the lookup
    provides.  ``known`` are the columns that can be read from ``rows`` alone.
    """

    keys: tuple[str, ...]
    rows: Callable[[], DataFrame]
    settle: Callable[[DataFrame], DataFrame]
    known: Mapping[str, str] = field(default_factory=dict)

    def attach(self, frame: DataFrame) -> DataFrame:
        return self.settle(join_to_sums(frame, self.rows(), self.keys))


@dataclass(frozen=True)
class Lookup:
    """Columns found by key in another table.

    ``attach`` adds ``provides`` to any frame that has ``keys`` and keeps every
    row exactly once, so it may run on single rows or on rows already summed
    by the keys.  ``found`` says how, where it is one join.
    """

    keys: tuple[str, ...]
    provides: tuple[str, ...]
    attach: Callable[[DataFrame], DataFrame]
    found: Found | None = None


def joined_lookup(found: Found, provides: Sequence[str], keys: Sequence[str] | None = None) -> Lookup:
    return Lookup(tuple(keys or found.keys), tuple(provides), found.attach, found)


def joined_before(first: Found, then: Found) -> Found:
    """Both lookups as one join, where the keys of the second are ``known`` to the first.

    The second is looked up for the rows of the first's table, which are as many
    as there are keys, and not for those of the frame.  Only rows of the frame
    are settled, so what nobody asked for still fails nobody.
    """

    def rows() -> DataFrame:
        table = first.rows().withColumnsRenamed({f"key_{i}": f"__own_{i}" for i in range(len(first.keys))})
        keyed = table.withColumns({f"__of_{k}": F.col(first.known[k]) for k in then.keys})
        both = join_to_sums(keyed, then.rows(), [f"__of_{k}" for k in then.keys]).drop(*[f"__of_{k}" for k in then.keys])
        return both.withColumnsRenamed({f"__own_{i}": f"key_{i}" for i in range(len(first.keys))})

    return Found(first.keys, rows, lambda frame: then.settle(first.settle(frame)), {**first.known, **then.known})


def fewest_joins(chain: Sequence[Lookup]) -> list[Lookup]:
    """The chain with every lookup that takes its keys from the one before joined to that one's table first."""
    done: list[Lookup] = []
    for entry in chain:
        last = done[-1] if done else None
        if last and last.found and entry.found and set(entry.found.keys) <= set(last.found.known):
            done[-1] = joined_lookup(joined_before(last.found, entry.found), (*last.provides, *entry.provides), last.keys)
        else:
            done.append(entry)
    return done


def constant_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small table of literals, whose size Spark knows when it plans joins."""
    fields = T.StructType.fromDDL(schema).fields
    return spark.range(1).select(
        F.inline(F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]))
    )


def left_lookup(keys: Iterable[str], provides: Iterable[str], table: Callable[[], DataFrame]) -> Lookup:
    """Left join to a table of one row per ``keys``; of a key listed more than once the least row counts."""
    keys, provides = tuple(keys), tuple(provides)
    kept = f"__row_{'_'.join(keys)}"

    def rows() -> DataFrame:
        row = F.struct(*[F.col(c).alias(f"value_{i}") for i, c in enumerate(provides)])
        return table().groupBy(*_numbered(keys)).agg(F.min(row).alias(kept))

    known = {c: f"{kept}.value_{i}" for i, c in enumerate(provides)}

    def settle(frame: DataFrame) -> DataFrame:
        return frame.withColumns({c: F.col(value) for c, value in known.items()}).drop(kept)

    return joined_lookup(Found(keys, rows, settle, known), provides)


def _numbered(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]


def join_to_sums(frame: DataFrame, sums: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join of ``frame`` to a grouped table, whose columns ``key_0``, ``key_1``.. pair with ``keys``.

    A null key matches nothing, yet all rows that have one would meet in one
    task.  A second key, the number of the task they come from, keeps them
    apart; for all other rows, and in the table, it is zero.  As the table is
    not grouped by the second key it is shuffled for the join, which is what
    adaptive skew splitting needs to see.
    """
    is_null = reduce(or_, [F.col(k).isNull() for k in keys])
    # Zero otherwise, but not a constant: a constant would drop out of the join keys.
    zero = lambda key: F.pmod(F.hash(key), F.lit(1))
    left = frame.withColumn("__apart", F.when(is_null, F.spark_partition_id()).otherwise(zero(keys[0])))
    right = sums.withColumn("__zero", zero("key_0"))
    same = [F.col(k) == F.col(f"key_{i}") for i, k in enumerate(keys)]
    joined = left.join(right, reduce(and_, [*same, F.col("__apart") == F.col("__zero")]), how)
    return joined.drop("__apart", "__zero", *[f"key_{i}" for i in range(len(keys))])


def single_row_lookup(key: str, column: str, table: Callable[[], DataFrame], alias: str) -> Lookup:
    """Left join that fails when a probed key has more than one row.

    This is what a scalar subquery does.  Keys nobody asks for may repeat.
    """

    def rows() -> DataFrame:
        return (
            table()
            .where(F.col(key).isNotNull())
            .groupBy(*_numbered([key]))
            .agg(F.max(column).alias("__value"), F.count("*").alias("__rows"))
        )

    def settle(joined: DataFrame) -> DataFrame:
        # A row number is never negative; being bound to its task, it keeps a filter on the column,
        # and with it the failure, from being moved to the rows of the table nobody asked for.
        repeated = (F.col("__rows") > 1) & (F.monotonically_increasing_id() >= 0)
        message = F.concat(F.lit(f"more than one {column} for {key} "), F.col(alias).cast("string"))
        failure = F.raise_error(message).cast(table().schema[column].dataType)
        value = F.when(repeated, failure).otherwise(F.col("__value"))
        return joined.withColumn(column, value).drop("__value", "__rows")

    return joined_lookup(Found((alias,), rows, settle), (column,))


def any_row_lookup(keys: Iterable[str], column: str, table: Callable[[], DataFrame]) -> Lookup:
    """Left join that takes one row per key: the smallest value, so that runs repeat."""
    keys = tuple(keys)

    def attach(frame: DataFrame) -> DataFrame:
        return join_to_sums(frame, table().groupBy(*_numbered(keys)).agg(F.min(column).alias(column)), keys)

    return Lookup(keys, (column,), attach)


@dataclass(frozen=True)
class Relation:
    """A base frame, its lookups and the names of the tables it reads."""

    base: DataFrame
    tables: tuple[str, ...]
    lookups: tuple[Lookup, ...] = ()
    days: tuple[tuple[str, str], ...] = ()
    """(month column, date column it was derived from) pairs of the base."""

    @cached_property
    def base_columns(self) -> frozenset[str]:
        return frozenset(self.base.columns)

    def needed_lookups(self, columns: Iterable[str]) -> list[Lookup]:
        """The lookups that provide ``columns``, each after those it takes its keys from."""
        chain: list[Lookup] = []

        def require(column: str) -> None:
            if column in self.base_columns or any(column in done.provides for done in chain):
                return
            provider = next((entry for entry in self.lookups if column in entry.provides), None)
            if provider is None:
                raise ValueError(f"{self.tables[0]} has no column {column}")
            for key in provider.keys:
                require(key)
            chain.append(provider)

        for column in columns:
            require(column)
        return chain

    def columns(self, *names: str) -> DataFrame:
        """Row-level frame with exactly these columns, joining only what they need."""
        frame = self.base
        for entry in fewest_joins(self.needed_lookups(names)):
            frame = entry.attach(frame)
        return frame.select(*names)
