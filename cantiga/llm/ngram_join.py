"""N-gram Jaccard join with a MinHash LSH forest.

Texts become sets of five-word shingles; texts of one set form one node.  A
node's MinHash signature is cut into trees: in each, a node lies at the end of
the path its values spell, and similar nodes share long paths.  Nodes meet by
full paths first.  The prefix they are asked to share is then shortened, until
two sets at the threshold meet in at least one tree with the target probability.
A prefix all of whose nodes are in one group by then needs no further look;
below any other, the nodes lie sorted along the tree and are compared from the
longest prefix two of them share upwards, those of one group left out.

These comparisons estimate the similarity from whole signatures, with a margin
of four standard errors; they only find which nodes *may* belong together, and
a pair below the margin in every tree is not looked at further.  Every pair of
nodes in such a group is then verified exactly on its shingles, in blocks of
bounded size, and counted without being written out.  Large buckets and groups
are split into pairs of blocks, without a cap.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga.llm.common import WORD, Stored, components, grouped_pass

_WORD = re.compile(WORD)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ForestSettings:
    words: int = 5
    threshold: float = 0.8
    trees: int = 16
    #: Values on a full path.
    depth: int = 8
    #: Chance that two sets at the threshold meet in a bucket.
    recall: float = 0.999
    #: Values by which a prefix is shortened at a time.
    step: int = 4
    #: Rows of a block of a bucket, and of a component.
    bucket_block: int = 1024
    component_block: int = 512

    @property
    def prefix(self) -> int:
        """The longest prefix that gives the target recall."""
        for depth in range(self.depth, 1, -1):
            if 1 - (1 - self.threshold**depth) ** self.trees >= self.recall:
                return depth
        return 1

    @property
    def prefixes(self) -> list[int]:
        """Lengths of the prefixes at which nodes meet, from the full path to the one that gives the target recall."""
        return [*range(self.depth, self.prefix, -self.step), self.prefix]

    @property
    def margin(self) -> float:
        """Share of equal values below which a pair at the threshold all but never falls: four standard errors."""
        return self.threshold - 4 * math.sqrt(self.threshold * (1 - self.threshold) / (self.trees * self.depth))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int, known: dict[str, int]) -> np.ndarray:
    """The sorted 64-bit hashes of a text's different shingles; a text with fewer words has one, of them all."""
    found = _WORD.findall(text or "")
    for word in set(found):
        if word not in known:
            known[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    ids = np.fromiter((known[w] for w in found), np.uint64, len(found))
    if not len(ids):
        return ids
    width = min(words, len(ids))
    n = len(ids) - width + 1
    code = np.full(n, width, np.uint64)
    for i in range(width):
        code = code * _FACTOR + ids[i : i + n]
    return np.unique(_mix(code))


def signature(codes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the permutations."""
    short = (codes >> np.uint64(32)).astype(np.uint32)
    least = np.full(seeds.shape[1], 0xFFFFFFFF, np.uint32)
    for start in range(0, len(short), 2048):
        values = (short[start : start + 2048, None] ^ seeds[0]) * seeds[1]
        np.minimum(least, values.min(axis=0), out=least)
    return least


def permutations(n: int) -> np.ndarray:
    draw = np.random.default_rng(20)
    return np.stack([draw.integers(0, 1 << 32, n, dtype=np.uint64), draw.integers(0, 1 << 31, n, dtype=np.uint64) * 2 + 1]).astype(np.uint32)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")


def _sketches(documents: DataFrame, s: ForestSettings) -> DataFrame:
    """doc_id, digest (of the text), node (of the shingle set, null without words), buckets (by prefix and tree) and signature of every document."""
    prefixes = s.prefixes

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        seeds = permutations(s.trees * s.depth)
        tree = _mix(np.arange(1, s.trees + 1, dtype=np.uint64))
        for batch in batches:
            known: dict[str, int] = {}
            nodes, keys, short = [], [], []
            for text in batch.column(2):
                codes = shingles(text.as_py(), s.words, known)
                if not len(codes):
                    nodes.append(None)
                    keys.append(None)
                    short.append(None)
                    continue
                values = signature(codes, seeds).reshape(s.trees, s.depth)
                spelt = [tree]
                for i in range(s.depth):
                    spelt.append(_mix(spelt[-1] * _FACTOR + values[:, i]))
                nodes.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest())
                keys.append([spelt[length].view(np.int64) for length in prefixes])
                short.append(values.astype(np.uint8).tobytes())
                if len(known) > 1_000_000:
                    known.clear()
            columns = [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.list_(pa.int64()))), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "node", "buckets", "signature"])

    return _texts(documents).mapInArrow(each, "doc_id long, digest long, node binary, buckets array<array<long>>, signature binary")


class _Sets:
    """Disjoint sets of small numbers."""

    def __init__(self, n: int) -> None:
        self.of = list(range(n))

    def root(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.of[max(x, y)] = min(x, y)
        return x != y


def _bucket_edges(values: np.ndarray, paths: np.ndarray, roots: list[bytes], shortest: int, margin: float) -> list[tuple[int, int]]:
    """Edges between the groups of a bucket that may be similar, found from the full path upwards to the shortest prefix.

    Two rows are compared once, at the longest prefix they share, unless they are in one group by then.
    """
    n, least = len(values), margin * values.shape[1]
    number: dict[bytes, int] = {}
    order = np.lexsort(paths.T[::-1])
    group = np.array([number.setdefault(roots[i], len(number)) for i in order])
    apart = len(number)
    values, paths = values[order], paths[order]
    shared = np.cumprod(paths[1:] == paths[:-1], axis=1).sum(axis=1)
    places = np.arange(n)
    edges: list[tuple[int, int]] = []
    deeper = places
    for length in range(paths.shape[1], shortest - 1, -1):
        # The first row that shares this much of the path with a row, and all between.
        start = np.maximum.accumulate(np.where(np.concatenate([[False], shared >= length]), 0, places))
        for i in np.flatnonzero(start < deeper):
            if apart == 1:
                return edges
            others = start[i] + np.flatnonzero(group[start[i] : deeper[i]] != group[i])
            for j in others[(values[others] == values[i]).sum(axis=1) >= least]:
                if group[i] != group[j]:
                    edges.append((int(order[i]), int(order[j])))
                    group[group == group[j]] = group[i]
                    apart -= 1
        deeper = start
    return edges


def _blocked(rows: DataFrame, size: str, block: int, by: Column, name: list[str]) -> DataFrame:
    """Rows with ``group`` and the sides ``first`` and ``second`` they are on: all of a small group, pairs of blocks of a large one."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(by), F.col("__blocks")).cast("int")
    dealt = rows.withColumn("__blocks", blocks).withColumn("__own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    low, high = F.least("__own", "__other"), F.greatest("__own", "__other")
    return dealt.withColumns({"group": F.concat_ws("_", *name, low, high), "first": F.col("__own") == low, "second": F.col("__own") == high}).drop("__blocks", "__own", "__other")


def _may_be_similar(stored: Stored, nodes: DataFrame, s: ForestSettings) -> DataFrame:
    """``node`` and ``root`` of every node: the least node of the group it may be similar to."""
    width, margin = s.trees * s.depth, s.margin
    members = nodes.select("node", F.col("node").alias("root"))
    for level, length in enumerate(s.prefixes):
        rooted = nodes.join(members, "node") if level else nodes.withColumn("root", F.col("node"))
        placed = rooted.select("node", "root", F.posexplode(F.col("buckets")[level]).alias("tree", "bucket"))
        # Prefixes that several groups share; written, so that a hot one is split in the join.
        live = stored.keep(placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("bucket", "n"))
        rows = stored.keep(placed.join(live, "bucket"))
        withs = rows.join(nodes.select("node", "signature"), "node")
        dealt = _blocked(withs, "n", s.bucket_block, F.col("node"), ["bucket"])

        def each(bucket: pa.Table, shortest: int = length) -> Iterable[pa.RecordBatch]:
            roots = bucket.column("root").to_pylist()
            values = np.frombuffer(b"".join(bucket.column("signature").to_pylist()), np.uint8).reshape(-1, width)
            path = bucket.column("tree")[0].as_py() * s.depth
            edges = _bucket_edges(values, values[:, path : path + s.depth], roots, shortest, margin)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([roots[i] for i, _ in edges], pa.binary()), pa.array([roots[j] for _, j in edges], pa.binary())], names=["a", "b"])

        edges = stored.keep(grouped_pass(dealt.select("group", "tree", "node", "root", "signature"), "group", each, "a binary, b binary").distinct())
        joined = stored.keep(components(stored, edges).toDF("root", "least"))
        before = members
        members = stored.keep(before.join(joined, "root", "left").select("node", F.coalesce("least", "root").alias("root")))
        stored.drop(live, rows, edges, joined, *([before] if level else []))
    return members


def _verify(sets: list[np.ndarray], weight: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Exact links between rows of the first and the second side: linked sets and documents of each row, and joining edges."""
    right = np.flatnonzero(second)
    values = np.concatenate([sets[j] for j in right])
    owner = np.repeat(np.arange(len(right)), [len(sets[j]) for j in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    size = np.array([len(x) for x in sets])
    linked, documents = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    joined, edges = _Sets(len(sets)), []
    for i in np.flatnonzero(first):
        low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        hit = high > low
        low, n = low[hit], (high - low)[hit]
        if not len(n):
            continue
        ends = np.cumsum(n)
        places = np.arange(ends[-1]) + np.repeat(low - (ends - n), n)
        common = np.bincount(owner[places], minlength=len(right))
        near = right[common / (size[i] + size[right] - common) >= threshold]
        # Rows on both sides meet twice; a pair counts once, for both.
        near = near[(near > i) | ~(first[near] & second[i])]
        linked[i] += len(near)
        documents[i] += weight[near].sum()
        linked[near] += 1
        documents[near] += weight[i]
        for j in near:
            if joined.join(int(i), int(j)):
                edges.append((int(i), int(j)))
    return linked, documents, edges


def similar_texts(documents: DataFrame, settings: ForestSettings = ForestSettings()) -> DataFrame:
    """Classes of similar texts among ``documents`` (``doc_id``, ``text``).

    Returns for every row doc_id; class_id, the least doc_id of its component of
    texts linked by a Jaccard similarity of the threshold or more; set_id, the
    least doc_id with the same shingles; n_links, the number of other documents
    linked to it, copies included; and n_set_links, the number of other shingle
    sets linked to its own.  A text without words, or null, is a class of its
    own without links.  Rows with one id are documents of their own; other
    columns are ignored; an empty table gives no rows.
    """
    s = settings
    stored = Stored(documents.sparkSession, "forest")
    sketches = stored.keep(_sketches(documents, s))
    nodes = stored.keep(
        sketches.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least"),
            F.count("*").alias("n_docs"),
            F.first("buckets").alias("buckets"),
            F.first("signature").alias("signature"),
        )
        .select("node", F.col("least.doc_id").alias("set_id"), "least.digest", "n_docs", "buckets", "signature")
    )
    members = _may_be_similar(stored, nodes, s)
    sizes = stored.keep(members.groupBy("root").agg(F.count("*").alias("n")).where("n > 1"))
    of_group = members.join(sizes, "root").join(nodes.select("node", "set_id", "digest", "n_docs"), "node")
    dealt = _blocked(of_group.withColumn("root", F.hex("root")), "n", s.component_block, F.col("node"), ["root"])
    texts = _texts(documents).toDF("of_id", "of_digest", "text")
    meant = F.col("set_id").eqNullSafe(F.col("of_id")) & (F.col("digest") == F.col("of_digest"))
    fetched = dealt.join(texts, meant).select("group", "node", "n_docs", "first", "second", "text")
    if not sketches.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        # Whole rows are repeated: each set is sent once.
        fetched = fetched.groupBy("group", "node").agg(*[F.first(c).alias(c) for c in ("n_docs", "first", "second", "text")])
    words, threshold = s.words, s.threshold

    def each(block: pa.Table) -> Iterable[pa.RecordBatch]:
        known: dict[str, int] = {}
        names, sets, rows, seen = [], [], [], set()
        wanted = block.column("node").to_pylist()
        for i, text in enumerate(block.column("text")):
            codes = shingles(text.as_py(), words, known)
            # Texts may agree in id and digest: the one meant has the shingles asked for.
            if wanted[i] not in seen and hashlib.blake2b(codes.tobytes(), digest_size=16).digest() == wanted[i]:
                seen.add(wanted[i])
                names.append(wanted[i])
                sets.append(codes)
                rows.append(i)
        if len(names) < 2:
            return
        pick = lambda c: np.array(block.column(c).to_pylist())[rows]
        first, second = pick("first"), pick("second")
        if not first.any() or not second.any():
            return
        linked, docs, edges = _verify(sets, pick("n_docs"), first, second, threshold)
        some = np.flatnonzero(linked)
        left = [names[i] for i in some] + [names[i] for i, _ in edges]
        right = [None] * len(some) + [names[j] for _, j in edges]
        if left:
            none = [0] * len(edges)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array([*linked[some].tolist(), *none], pa.int64()), pa.array([*docs[some].tolist(), *none], pa.int64())], names=["a", "b", "sets", "docs"])

    verified = stored.keep(grouped_pass(fetched, "group", each, "a binary, b binary, sets long, docs long"))
    links = verified.where(F.col("b").isNull()).groupBy(F.col("a").alias("node")).agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))
    roots = stored.keep(components(stored, verified.where(F.col("b").isNotNull()).select("a", "b").distinct()))
    of_root = stored.keep(roots.join(nodes.select("node", "set_id"), "node").groupBy("root").agg(F.min("set_id").alias("class_id")))
    known = nodes.select("node", "set_id", "n_docs").join(roots.join(of_root, "root").select("node", "class_id"), "node", "left").join(links, "node", "left")
    per_node = known.select(
        "node", "set_id", F.coalesce("class_id", "set_id").alias("class_id"), (F.col("n_docs") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("sets", F.lit(0)).alias("n_set_links")
    )
    out = sketches.select("doc_id", "node").join(stored.keep(per_node), "node", "left")
    own = lambda c: F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", own("class_id"), own("set_id"), zero("n_links"), zero("n_set_links"))
