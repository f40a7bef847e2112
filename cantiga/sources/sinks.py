"""Where results go."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiga.functions.money import plain_values
from cantiga.session import path_exists, remove_folder
from cantiga.sources.relation import join_to_sums

#: Folder of the fingerprints, inside the dataset; readers skip names that begin like this.
_MANIFEST = "_fingerprints"


#: Bits of a clustering column's place in the order of its values.
_ORDER_BITS = 8

#: Bits of each but the highest of the three parts that a hash is summed in.
_HASH_BITS = 21


def z_order(frame: DataFrame, columns: Sequence[str], name: str = "__z") -> DataFrame:
    """``frame`` with a number that rows near in all of ``columns`` share the high bits of; nulls come first in each.

    A column's different values are dealt in ranges; the number of a value's
    range is its place in the order.  The bits of all places are interleaved, so
    that no column decides the order alone.
    """
    out, places = frame, []
    for i, column in enumerate(columns):
        place = f"__place{i}"
        values = frame.select(F.col(column).alias("key_0")).where(F.col("key_0").isNotNull()).distinct()
        ranges = values.repartitionByRange(1 << _ORDER_BITS, "key_0").select("key_0", F.spark_partition_id().alias(place))
        out = join_to_sums(out, ranges, [column])
        places.append(F.coalesce(place, F.lit(-1)) + 1)
    # One bit more than the ranges take, for the nulls.
    bits = [F.shiftleft(F.shiftright(p, bit).bitwiseAND(F.lit(1)).cast("long"), bit * len(places) + i) for bit in range(_ORDER_BITS + 1) for i, p in enumerate(places)]
    return out.withColumn(name, reduce(Column.bitwiseOR, bits)).drop(*[f"__place{i}" for i in range(len(columns))])


def write_clustered_months(frame: DataFrame, path: str, cluster: Sequence[str], month: str = "periodo", others_stay: bool = True) -> None:
    """``write_months`` with the rows of a month in Z-order of the ``cluster`` columns.

    Rows near in all of them lie in the same files and row groups, so that a
    filter on any one of them skips most.  A month too big for one task is cut
    along the order.
    """
    ordered = z_order(frame, cluster)
    (
        ordered.repartitionByRange(month, "__z")
        .sortWithinPartitions(month, "__z", *cluster)
        .drop("__z")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if others_stay else "static")
        .partitionBy(month)
        .parquet(path)
    )


def write_months(frame: DataFrame, path: str, month: str = "periodo", others_stay: bool = True) -> None:
    """Parquet with one folder per month; months not in ``frame`` stay as they are, or go with all else at ``path``.

    The rebalance hint gathers a month into few files, and splits a month too
    big for one task.
    """
    (
        frame.hint("rebalance", month)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if others_stay else "static")
        .partitionBy(month)
        .parquet(path)
    )


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """The folders written by ``write_months``; filters on the month skip folders."""
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Refresh:
    """What ``refresh_months`` did; null stands for rows without a month."""

    changed: tuple[str | None, ...]
    vanished: tuple[str | None, ...]
    unchanged: int


def fingerprints(frame: DataFrame, month: str) -> DataFrame:
    """month, n, h1, h2: the rows of each month and two sums of hashes of whole rows, the same in any order of rows.

    Nulls have a hash of their own place, so that values do not pass for their neighbours.
    """
    values = [part for c in frame.columns for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    rows = frame.select(F.col(f"`{month}`").cast("string").alias("month"), *[F.xxhash64(F.lit(salt), *values).alias(f"h{salt}") for salt in (1, 2)])

    def total(name: str) -> Column:
        """The exact sum: of the hash's low, middle and high bits apart as longs, which 2^42 rows cannot overflow, put together at the end."""
        low = F.lit((1 << _HASH_BITS) - 1).cast("long")
        parts = (F.shiftright(name, 2 * _HASH_BITS), F.shiftright(name, _HASH_BITS).bitwiseAND(low), F.col(name).bitwiseAND(low))
        scaled = [F.sum(part).cast("decimal(20,0)") * F.lit(1 << (2 - i) * _HASH_BITS).cast("decimal(14,0)") for i, part in enumerate(parts)]
        return reduce(add, scaled).cast("decimal(38,0)")

    return rows.groupBy("month").agg(F.count("*").alias("n"), *[total(name).alias(name) for name in ("h1", "h2")])


def _month_folder(spark: SparkSession, path: str, month: str, value: str | None) -> str:
    part = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(month, value)
    return f"{path}/{part}"


def refresh_months(
    source: DataFrame, path: str, build: Callable[[DataFrame], DataFrame] = lambda rows: rows, month: str = "periodo", depends_on: Sequence[DataFrame] = ()
) -> Refresh:
    """Bring the month folders at ``path`` up to ``build(source)``, computing only what changed.

    A month's fingerprint is taken of its source rows and compared with the one
    kept beside the data.  Only months that differ are built and overwritten,
    all their old rows going; folders of months that vanished are removed; the
    files of all others stay.  ``build`` must keep each row's month, and
    leave each month a row at least.  A change
    in one of ``depends_on``, tables that ``build`` looks things up in, refreshes
    every month.  Columns of map type cannot be hashed; give them as JSON.

    Where there are no fingerprints yet, whatever lies at ``path`` is replaced.
    The new fingerprints are written last, under a new name: a refresh that
    breaks off leaves the old ones, and the next does its work again.
    """
    spark = source.sparkSession
    shared = F.lit(0)
    for table in depends_on:
        row = fingerprints(table.withColumn("__all", F.lit("")), "__all").drop("month").first()
        shared = F.xxhash64(shared, *[F.lit(str(v)) for v in row or ()])
    now = fingerprints(source, month).withColumn("shared", shared.cast("long"))
    manifest = f"{path}/{_MANIFEST}"
    versions = sorted(int(v) for v in _children(spark, manifest) if v.isdigit() and path_exists(spark, f"{manifest}/{v}/_SUCCESS"))
    kept = f"{manifest}/{versions[-1]}" if versions else None
    # A row for each month: few, however many rows the months have.
    after = {r.month: tuple(r)[1:] for r in now.collect()}
    before = {r.month: tuple(r)[1:] for r in spark.read.parquet(kept).select(*now.columns).collect()} if kept else {}
    changed = tuple(sorted((m for m, mark in after.items() if before.get(m) != mark), key=lambda m: (m is None, m)))
    vanished = tuple(sorted((m for m in before if m not in after), key=lambda m: (m is None, m)))
    if changed:
        some = F.col(month).cast("string").isin([m for m in changed if m is not None])
        rows = source.where(F.coalesce(some, F.lit(False)) | F.col(month).isNull() if None in changed else some)
        write_months(build(rows), path, month, others_stay=kept is not None)
    for value in vanished:
        remove_folder(spark, _month_folder(spark, path, month, value))
    if changed or vanished or not kept:
        version = f"{manifest}/{versions[-1] + 1 if versions else 0}"
        remove_folder(spark, version)
        spark.createDataFrame([(m, *mark) for m, mark in after.items()], now.schema).coalesce(1).write.parquet(version)
        for old in versions:
            remove_folder(spark, f"{manifest}/{old}")
    return Refresh(changed, vanished, len(after) - len(changed))


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none where there is no folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []


def json_rows(frame: DataFrame) -> DataFrame:
    """Each row as one JSON object, nulls included."""
    return plain_values(frame).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("linha"))


def write_json(frame: DataFrame, path: str) -> None:
    """JSON lines with the values callers outside Spark get."""
    plain_values(frame).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
