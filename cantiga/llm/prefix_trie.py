"""The prefix trie of conversations, by collapsing whole sequences.

A prefix of a conversation is known by a running digest of its turns, computed
in one pass over the turns in order; texts are not moved after that.
Conversations with the same last digest are one *sequence*, with their number
as its weight and a list of their ids, of which only the hash is kept.  A
sequence that is a proper prefix of another is no leaf: an anti-join against
all proper prefixes finds these.  Only the different sequences are then taken
apart into prefixes, and each node of the trie is a sum over the sequences that
pass through it.

A node is *owned* by the sequence of its smallest member.  The nodes that a
sequence owns are its last ones, so each node of the trie has one owner and the
distinct parts below a node add up from the owners alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cantiga.llm.common import Stored

#: Conversations are rebuilt from the head of the first of so many, of fewer turns than so many.
HEAD_OF, HEAD_TURNS = 5, 9
#: Bytes of a digest of a prefix.
_DIGEST = 16


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1) and the digest and bytes of each turn."""
    filled = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    # The length of the role keeps role and text apart.
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    return filled.select("conv_id", F.row_number().over(order).alias("place"), digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))


def head_turns(conv_id: Column) -> Column:
    """The number of turns that a conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD_TURNS).cast("int")


def rebuilt_from_heads(turns: DataFrame) -> DataFrame:
    """Conversations that begin like the first of their group of five ids, then go on with turns of their own.

    ``turns`` has conv_id, turn, role and text.  Returns conv_id, part, place, digest and
    bytes, in which the rows of part 0 only say that the conversation exists.
    Null turns come first; turns of one number go by role and text; null role
    and text are empty; rows without a conv_id take no part.
    """
    stored = Stored(turns.sparkSession, "turns")
    placed = stored.keep(_placed(turns))
    heads = placed.where((F.col("conv_id") % HEAD_OF == 0) & (F.col("place") < HEAD_TURNS)).withColumnRenamed("conv_id", "first")
    # A head is copied to the few conversations of its group, never more than five.
    members = placed.where("place = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % HEAD_OF).alias("first"), head_turns(F.col("conv_id")).alias("h"))
    taken = members.join(heads, "first").where("place <= h").select("conv_id", F.lit(1).alias("part"), "place", "digest", "bytes")
    own = placed.where(F.col("place") > head_turns(F.col("conv_id"))).select("conv_id", F.lit(2), "place", "digest", "bytes")
    start = members.select("conv_id", F.lit(0), F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("long"))
    return start.union(taken).union(own).toDF("conv_id", "part", "place", "digest", "bytes")


def sequences_of(turns: DataFrame) -> DataFrame:
    """Conversations as they are, in the shape of ``rebuilt_from_heads``."""
    placed = Stored(turns.sparkSession, "turns").keep(_placed(turns))
    start = placed.where("place = 1").select("conv_id", F.lit(0), F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("long"))
    return start.union(placed.select("conv_id", F.lit(1), "place", "digest", "bytes")).toDF("conv_id", "part", "place", "digest", "bytes")


_PREFIXES = "conv_id long, depth int, prefix binary, above binary, bytes long, upto long, last boolean"


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation: its digest, that of the one above, its last turn's bytes and all bytes.

    One pass over the sorted turns; only the digest of the current conversation is held.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: tuple | None = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names=["conv_id", "depth", "prefix", "above", "bytes", "upto", "last"])

        for batch in batches:
            out = []
            for conv, part, digest, size in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                if held is not None:
                    out.append((*held, part == 0))
                if part == 0:
                    held = (conv, 0, b"", None, 0, 0)
                else:
                    _, depth, prefix, _, _, upto = held
                    held = (conv, depth + 1, hashlib.sha256(prefix + digest).digest()[:_DIGEST], prefix, size, upto + size)
            yield made(out)
        if held is not None:
            yield made([(*held, True)])

    return rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(walk, _PREFIXES)


def _ends(last: DataFrame, chunk: int = 4096) -> DataFrame:
    """For each sequence (``prefix``) the SHA-256 of the ids that end there, ascending and joined by commas.

    Ids are sorted over all tasks, whatever a sequence's share of them, and put
    together in chunks; one pass over the chunks of a sequence hashes them.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        prefix, ids = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([prefix], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["prefix", "first", "ids"])

        for batch in batches:
            for at, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (at != prefix or len(ids) == chunk):
                    yield made()
                    ids = []
                prefix = at
                ids.append(conv)
        if ids:
            yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        prefix, state = None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1].hexdigest() for r in rows], pa.string())], names=["prefix", "ends_sha256"])

        for batch in batches:
            done = []
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and at == prefix:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    done.append((prefix, state))
                prefix, state = at, hashlib.sha256(ids.encode())
            yield made(done)
        if state is not None:
            yield made([(prefix, state)])

    ordered = last.select("prefix", "conv_id").repartitionByRange("prefix", "conv_id").sortWithinPartitions("prefix", "conv_id")
    parts = ordered.mapInArrow(chunks, "prefix binary, first long, ids string")
    return parts.repartition("prefix").sortWithinPartitions("prefix", "first").mapInArrow(hashed, "prefix binary, ends_sha256 string")


def build_trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rebuilt`` conversations (see ``rebuilt_from_heads``).

    One row per node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.  A conversation
    without turns belongs to the root; an empty table has no nodes.
    """
    stored = Stored(rebuilt.sparkSession, "trie")
    prefixes = stored.keep(_prefixes(rebuilt))
    last = prefixes.where("last")
    sequences = stored.keep(last.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("depth").alias("length"), F.first("upto").alias("total")))
    ends = _ends(last)
    of_sequences = sequences.select("conv_id", "weight", "length", "total")
    paths = stored.keep(prefixes.drop("last").join(of_sequences, "conv_id"))
    inner = paths.where("depth < length").select("prefix").distinct()
    leaves = sequences.join(inner, "prefix", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    owned = (
        paths.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"))
        .groupBy("conv_id").agg(F.count_if(F.col("depth") > 0).alias("owned"), F.sum("bytes").alias("owned_bytes"))
    )
    marked = of_sequences.select("conv_id").join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    rows = paths.join(marked.na.fill(0), "conv_id")
    # From here down: the bytes of its members, less the bytes of the different nodes.
    below = F.col("total") - F.col("upto") + F.col("bytes")
    first_owned = F.col("length") - F.col("owned") + 1
    own_below = F.when(F.col("depth") >= first_owned, below).otherwise(F.col("owned_bytes"))
    owns_next = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= first_owned)).cast("long")
    nodes = stored.keep(
        rows.groupBy("prefix").agg(
            F.min("conv_id").alias("conv_id"),
            F.first("depth").cast("long").alias("depth"),
            F.first("above").alias("above"),
            F.sum("weight").alias("n_convs"),
            F.sum(owns_next).alias("n_children"),
            F.sum("leaf").cast("long").alias("n_leaves"),
            F.sum(F.col("weight") * below - own_below).alias("saved_tokens"),
        )
    )
    parents = nodes.select(F.col("prefix").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(parents, "above", "left").join(ends, "prefix", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


#: The same result for the registered query: nodes are whole lists of turns.
TRIE_SQL = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
), originals AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY place) AS turns FROM turns GROUP BY conv_id
), hashed AS (
    SELECT conv_id, turns, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))
    ), 4294967295::BIGINT) % {HEAD_TURNS} AS h FROM originals
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns, [])[:c.h], c.turns[c.h + 1:]) AS turns
    FROM hashed c LEFT JOIN originals b ON b.conv_id = c.conv_id - c.conv_id % {HEAD_OF}
), prefixes AS (
    SELECT conv_id, d, turns[:d] AS path, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends,
        CASE WHEN d = 0 THEN 0 ELSE strlen(path[d].text) END AS bytes
    FROM prefixes GROUP BY path, d
), counted AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND c.path[:n.d] = n.path) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.path = n.path[:n.d - 1]
), sums AS (
    SELECT path[:above] AS path, sum((n - 1) * bytes) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS above FROM counted) GROUP BY path[:above]
)
SELECT conv_id, d::BIGINT AS depth, parent_conv_id, n AS n_convs, n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256 FROM counted JOIN sums USING (path)
"""
