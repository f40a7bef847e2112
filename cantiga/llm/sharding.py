"""Extendible hashing: shards that fit a byte limit.

A row's key is hashed to a string of bits.  A bucket is a prefix of those bits;
only a bucket over the limit is split, on its next bit, until each fits.  The
directory holds one entry per bucket: its prefix and the number of bits (local
depth) that it uses.

Sizes are summed per *cell*, a prefix somewhat longer than needed, in one
shuffle of numbers, and the buckets are found from the cells.  Where a cell is
itself over the limit, only the rows of such cells are looked at with more
bits.  Rows that share one key share all bits of the key's hash; past those,
bits of the row's own place split them, so a key of any weight is spread too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga.llm.common import Stored

#: Bits of the key's hash; as many bits of the row's own follow.
KEY_BITS = 60
#: A cell has so many bits more than shards of just the limit would need.
SPARE_BITS = 3
#: Bits added for cells that are still over the limit.
MORE_BITS = 8

_PLACE = ["__depth", "__high", "__low"]


@dataclass
class Shards:
    #: The rows, with ``shard`` (the bits of the prefix), ``depth`` and ``bytes``.
    rows: DataFrame
    #: One entry per bucket that holds rows: ``shard``, ``depth``, ``bytes``, ``rows``.
    directory: DataFrame


def _first_bits(depth: Column) -> list[Column]:
    """The first ``depth`` bits of a row or cell, as two numbers."""
    in_key = depth <= KEY_BITS
    high = F.call_function("shiftright", F.col("__high"), F.greatest(F.lit(0), KEY_BITS - depth))
    low = F.call_function("shiftright", F.col("__low"), 2 * KEY_BITS - depth)
    return [depth.alias("__depth"), F.when(in_key, high).otherwise(F.col("__high")).alias("__high"), F.when(in_key, F.lit(0)).otherwise(low).cast("long").alias("__low")]


def _name() -> Column:
    depth, high, low = (F.col(c) for c in _PLACE)
    first = F.lpad(F.bin(high), F.least(depth, F.lit(KEY_BITS)), F.lit("0"))
    more = F.lpad(F.bin(low), depth - KEY_BITS, F.lit("0"))
    return F.when(depth == 0, "").when(depth <= KEY_BITS, first).otherwise(F.concat(first, more))


def extendible_shards(frame: DataFrame, key: Column, size: Column, limit: int, keep: list[str] | None = None) -> Shards:
    """Deal the rows of ``frame`` into shards of at most ``limit`` bytes.

    ``keep`` names the columns to return (all by default).  A null key hashes as
    empty text; a null size counts 0.  A row larger than the limit is alone with
    rows of no size, or alone.  An empty frame gives no shards.  Columns named
    shard, depth or bytes give way to the operator's own.
    """
    stored = Stored(frame.sparkSession, "shards")
    keep = [c for c in (keep or frame.columns) if c.lower() not in ("shard", "depth", "bytes")]
    hashed = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    left = stored.keep(frame.select(*columns, F.coalesce(size, F.lit(0)).cast("long").alias("__bytes"), hashed.alias("__high"), F.monotonically_increasing_id().alias("__low")))
    left = left.withColumn("__low", F.xxhash64("__low").bitwiseAND((1 << KEY_BITS) - 1))

    total = left.agg(F.coalesce(F.sum("__bytes"), F.lit(0))).first()[0]
    least, bits = 0, min(KEY_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS))
    out, entries = [], []
    while True:
        cells = stored.keep(
            left.groupBy(*_first_bits(F.lit(bits))).agg(F.sum("__bytes").alias("__bytes"), F.count("*").alias("__rows"), F.min("__high").alias("__from"), F.max("__high").alias("__to"))
        )
        above = cells.select(F.explode(F.sequence(F.lit(least), F.lit(bits))).alias("__d"), "__high", "__low", "__bytes", "__rows", "__depth")
        nodes = stored.keep(above.groupBy(*_up()).agg(F.sum("__bytes").alias("__bytes"), F.sum("__rows").alias("__rows")))
        split = nodes.where((F.col("__bytes") > limit) & (F.col("__rows") > 1))
        buckets = _children(split, nodes) if least else _children(split, nodes).unionByName(nodes.where((F.col("__depth") == 0) & ((F.col("__bytes") <= limit) | (F.col("__rows") == 1))))
        buckets = stored.keep(buckets.where((F.col("__bytes") <= limit) | (F.col("__rows") == 1)))
        shallow = buckets.agg(F.min("__depth")).first()[0]
        over = stored.keep(split.where(F.col("__depth") == bits).select(*_PLACE).join(cells.drop("__bytes", "__rows"), _PLACE))
        at = [c.alias(f"__cell{i}") for i, c in enumerate(_first_bits(F.lit(bits))[1:])]
        if shallow is not None:
            reach = cells.select(F.col("__high").alias("__cell0"), F.col("__low").alias("__cell1"), F.explode(F.sequence(F.lit(shallow), F.lit(bits))).alias("__d"), "__high", "__low", "__depth")
            way = reach.select("__cell0", "__cell1", *_up()).join(buckets.select(*_PLACE), _PLACE)
            placed = left.select(*[f"k{i}" for i in range(len(keep))], "__bytes", *at).join(way, ["__cell0", "__cell1"])
            out.append(placed.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], _name().alias("shard"), F.col("__depth").cast("int").alias("depth"), F.col("__bytes").alias("bytes")))
            entries.append(buckets.select(_name().alias("shard"), F.col("__depth").cast("int").alias("depth"), F.col("__bytes").alias("bytes"), F.col("__rows").alias("rows")))
        n_over, one_key = over.agg(F.count("*"), F.min(F.col("__from") == F.col("__to"))).first()
        if not n_over:
            break
        if bits >= 2 * KEY_BITS:
            raise ValueError("rows of one key cannot be told apart any more")
        here = left.select("*", *at)
        left = stored.keep(here.join(over.select(F.col("__high").alias("__cell0"), F.col("__low").alias("__cell1")), ["__cell0", "__cell1"], "left_semi").drop("__cell0", "__cell1"))
        # Where only rows of one key are left, the other bits of the key are of no use.
        least, bits = bits, min(2 * KEY_BITS, (max(bits, KEY_BITS) if one_key else bits) + MORE_BITS)
    if not out:
        empty = frame.select(*[F.col(f"`{c}`") for c in keep]).limit(0)
        return Shards(empty.select("*", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bytes")), nodes.select(F.lit("").alias("shard"), F.lit(0).alias("depth"), "__bytes", "__rows").toDF("shard", "depth", "bytes", "rows").limit(0))
    rows, directory = out[0], entries[0]
    for more, entry in zip(out[1:], entries[1:]):
        rows, directory = rows.unionByName(more), directory.unionByName(entry)
    return Shards(rows, directory)


def _up() -> list[Column]:
    """The ancestor of a cell at depth ``__d``: bits of a cell are counted from its own depth."""
    depth, d, high, low = F.col("__depth"), F.col("__d"), F.col("__high"), F.col("__low")
    key_bits = F.least(depth, F.lit(KEY_BITS))
    up_high = F.call_function("shiftright", high, F.greatest(F.lit(0), key_bits - d))
    up_low = F.call_function("shiftright", low, F.when(d <= KEY_BITS, F.greatest(F.lit(0), depth - KEY_BITS)).otherwise(depth - d))
    return [d.alias("__depth"), up_high.alias("__high"), F.when(d <= KEY_BITS, F.lit(0)).otherwise(up_low).cast("long").alias("__low")]


def _children(split: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes one bit below those that are split."""
    bit = F.explode(F.array(F.lit(0), F.lit(1)))
    below = split.select(*_PLACE, bit.alias("__bit")).select(
        (F.col("__depth") + 1).alias("__depth"),
        F.when(F.col("__depth") < KEY_BITS, F.col("__high") * 2 + F.col("__bit")).otherwise(F.col("__high")).alias("__high"),
        F.when(F.col("__depth") < KEY_BITS, F.lit(0)).otherwise(F.col("__low") * 2 + F.col("__bit")).cast("long").alias("__low"),
    )
    return nodes.join(below, _PLACE, "left_semi")


def write_shards(shards: Shards, path: str) -> None:
    """One folder per shard; the limit keeps each within one task."""
    shards.rows.repartition("shard").write.partitionBy("shard").parquet(path)
