"""What the operators share: words, stored intermediates, Arrow passes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cantiga.session import remove_folder, shared_folder

#: A word, for every operator of this package.
WORD = r"[^\x20\x09-\x0D]+"


class Stored:
    """Tables written below the shared folder, to cut lineage.

    A written table survives the loss of an executor, is computed once however
    often it is read, and gives the same rows each time.  ``drop`` removes one
    that no later result reads; the rest go when the application ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark, self._base, self._at = spark, shared_folder(spark, name), {}

    def keep(self, frame: DataFrame) -> DataFrame:
        path = f"{self._base}/{uuid.uuid4().hex[:8]}"
        frame.write.option("compression", "zstd").parquet(path)
        read = self._spark.read.schema(frame.schema).parquet(path)
        self._at[id(read)] = (read, path)
        return read

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            _, path = self._at.pop(id(frame))
            remove_folder(self._spark, path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; ids that are null give 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of, F.lit(0))


def drawn(salt: str, rows: int, of: int) -> Column:
    """True for about ``rows`` of ``of`` rows, told apart by id and text, so that null and repeated ids are drawn row by row."""
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(1, of)))


def per_text(documents: DataFrame, keep: list[str], adds: dict[str, str], each: Callable[[pa.Array], list[pa.Array]], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the columns ``adds`` (name: type) that ``each`` makes of the texts of a batch."""
    kept = documents.select(*[F.col(f"`{c}`") for c in keep]).schema
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields], *[f"{name} {kind}" for name, kind in adds.items()]])
    # The text goes over once, also where it is kept.
    others = [c for c in keep if c != text]
    places = [0 if c == text else 1 + others.index(c) for c in keep]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in places], *each(batch.column(0))], names=[*keep, *adds])

    return documents.select(F.col(f"`{text}`"), *[F.col(f"`{c}`") for c in others]).mapInArrow(walk, schema)


def grouped_pass(frame: DataFrame, group: str, each: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``each`` on the rows of each group, for very many small groups.

    The rows are dealt by the group and sorted, and one task goes from group to
    group in a single pass; the caller sees to it that no group is large.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            names = batch.column(0).to_pylist()
            start = 0
            for i, name in enumerate(names):
                if name != last:
                    if i > start:
                        parts.append(batch.slice(start, i - start))
                    if parts:
                        yield from each(pa.Table.from_batches(parts))
                    parts, start, last = [], i, name
            if len(names) > start:
                parts.append(batch.slice(start))
        if parts:
            yield from each(pa.Table.from_batches(parts))

    ordered = frame.select(group, *[c for c in frame.columns if c != group]).repartition(F.col(group)).sortWithinPartitions(group)
    return ordered.mapInArrow(walk, schema)


def components(stored: Stored, edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node of the edges (``a``, ``b``): the least node of its component.

    Large-star and small-star steps in turn: neighbours are hung below the least
    node known, until every component is a star; the number of rounds grows with
    the logarithm of a component's length.  Each step is a sum and a join on one
    key, which adaptive execution splits where a node has very many edges.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        # Each node with its neighbours; small stars look at lesser neighbours only.
        near = links if not large else links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
        hung = near.join(least, F.col("a") == F.col("of"))
        if large:
            return hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        below = hung.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return below.union(hung.select("a", F.col("m").alias("b"))).where("a != b").distinct()

    def all_stars(links: DataFrame) -> bool:
        # No node hangs below two others, and none that others hang below hangs itself: the nodes above are the least.
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(links.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where("hangs > 1 or hangs + holds > 1").isEmpty()

    links = stored.keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not all_stars(links):
        new = stored.keep(star(star(links, True), False))
        stored.drop(links)
        links = new
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct().toDF("node", "root"))
