"""Approximate nearest neighbours: an NN-descent graph and greedy search on it.

Vectors that are equal form one point.  A first graph comes from random
projection trees: points of a leaf are compared with each other.  NN-descent
then improves it: of a point's neighbours, and the points it is a neighbour of,
those that are new since the last round are compared with each other and with
the rest ("neighbours of neighbours"), and each keeps the nearest it has met.
It ends when a round changes hardly anything.  A query walks the graph
greedily, from its own list, with a beam of the nearest points found, until
there is none in the beam it has not walked from.

Both steps run on *cells*, leaves of the first tree: lists of near points
share most of their members, so each vector is sent once per cell and not once
per list.  A point's number begins with its cell, so a cell that needs vectors
asks the cells they lie in, and gets them packed, a row per pair of cells.
Reverse lists of points that are everybody's neighbour are dealt in parts, each
joined with the point's own list in a group of its own, and dealt anew every
round; no member is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cantiga.llm.common import Stored, grouped_pass

#: Levels of a tree that have thresholds of their own below each other.
_OWN_LEVELS = 12
#: Bits of a point's number below those of its cell, and of those of a cell's part.
_PLACE_BITS, _PART_BITS = 12, 20
#: Bytes of vectors that leave a task at a time.
_PACKED = 8 << 20
#: Parts whose offers to one cell are merged at a time.
_GATHERED = 64


@dataclass(frozen=True)
class GraphSettings:
    #: Neighbours of a point.
    k: int = 56
    trees: int = 8
    leaf: int = 1024
    #: NN-descent ends when a round changes a smaller share of the lists.
    least_change: float = 0.005
    #: Points that a query holds, and those of them it walks from, at least; for many points both grow with their logarithm.
    held: int = 64
    beam: int = 24
    #: Vectors that the trees' thresholds are fitted on, about; every vector is indexed.
    fit_rows: int = 40_000
    seed: int = 11

    def bounds(self, n: int) -> tuple[int, int, int]:
        """Rounds and steps at most, held points and beam among ``n`` points."""
        log = max(1, math.ceil(math.log2(max(2, n))))
        return 2 * log, max(self.held, 4 * log), max(self.beam, 2 * log)


@dataclass(frozen=True)
class _Trees:
    directions: np.ndarray
    thresholds: list[list[np.ndarray]]

    @staticmethod
    def fit(sample: np.ndarray, levels: int, s: GraphSettings) -> _Trees:
        draw = np.random.default_rng(s.seed)
        directions = draw.standard_normal((s.trees, levels, sample.shape[1]))
        thresholds = []
        for tree in range(s.trees):
            code, of_tree = np.zeros(len(sample), np.int64), []
            for level in range(levels):
                along = sample @ directions[tree, level]
                cells = np.full(1 << min(level, _OWN_LEVELS), np.median(along) if len(along) else 0.0)
                own = code >> max(0, level - _OWN_LEVELS)
                order = np.argsort(own, kind="stable")
                starts = np.flatnonzero(np.diff(own[order], prepend=-1))
                for cell in np.split(order, starts[1:]) if len(order) else []:
                    cells[own[cell[0]]] = np.median(along[cell])
                of_tree.append(cells)
                code = code * 2 + (along > cells[own])
            thresholds.append(of_tree)
        return _Trees(directions, thresholds)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.directions)), np.int64)
        for tree, directions in enumerate(self.directions):
            along = x @ directions.T
            for level in range(len(directions)):
                cells = self.thresholds[tree][level]
                out[:, tree] = out[:, tree] * 2 + (along[:, level] > cells[out[:, tree] >> max(0, level - _OWN_LEVELS)])
        return out


def _matrix(vectors: Iterable[bytes], kind: str) -> np.ndarray:
    rows = list(vectors)
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def _nearest(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each owner the k nearest different others, nearest first, ties to the lesser."""
    order = np.lexsort((other, owner))
    owner, other, score = owner[order], other[order], score[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])
    owner, other, score = owner[new], other[new], score[new]
    order = np.lexsort((other, -score, owner))
    owner, other, score = owner[order], other[order], score[order]
    starts = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1)) if len(owner) else np.zeros(0, int)
    place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    keep = place < k
    return owner[keep], other[keep], score[keep]


_OFFERS = "cell long, nodes array<long>, others array<long>, scores array<float>"


def _offers(node: np.ndarray, other: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    """Offers of neighbours, a row for each cell that their receivers lie in."""
    cells = node >> _PLACE_BITS
    order = np.argsort(cells, kind="stable")
    cuts = np.flatnonzero(cells[order][1:] != cells[order][:-1]) + 1
    rows = np.split(order, cuts) if len(order) else []
    return pd.DataFrame(
        {"cell": [cells[r[0]] for r in rows], "nodes": [node[r] for r in rows], "others": [other[r] for r in rows], "scores": [score[r].astype(np.float32) for r in rows]},
        columns=["cell", "nodes", "others", "scores"],
    )


_GRAPH = "cell long, node long, nodes array<long>, scores array<float>, fresh array<boolean>"


def _best(near: np.ndarray, owners: np.ndarray, others: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of the others to each owner, where nearer than what it has."""
    k = min(k, len(others))
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    score = np.take_along_axis(near, best, axis=1)
    better = score > floor[owners][:, None]
    return np.broadcast_to(owners[:, None], score.shape)[better], others[best[better]], score[better]


def _compare(new: np.ndarray, old: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """New members compared with each other and with the old ones: (owner, other, score) of the nearest to each."""
    both = np.concatenate([new, old])
    if len(both) < 2 or not len(new):
        return []
    near = x[new] @ x[both].T
    near[np.arange(len(new)), np.arange(len(new))] = -np.inf
    out = [_best(near, new, both, floor, k)]
    if len(old):
        out.append(_best(near[:, len(new) :].T, old, new, floor, k))
    return out


def _first_offers(placed: DataFrame, kind: str, s: GraphSettings) -> DataFrame:
    k = s.k

    def each(leaf: pd.DataFrame) -> pd.DataFrame:
        ids, x = leaf["node"].to_numpy(), _matrix(leaf["vector"], kind).astype(np.float32)
        found = _compare(np.arange(len(ids)), np.zeros(0, int), x, np.full(len(ids), -np.inf, np.float32), k)
        if not found:
            return _offers(ids[:0], ids[:0], np.zeros(0))
        owner, other, score = found[0]
        return _offers(ids[owner], ids[other], score)

    return placed.groupBy("leaf").applyInPandas(each, _OFFERS)


def _merged(graph: DataFrame | None, offers: DataFrame, k: int) -> DataFrame:
    """The k nearest of each point's list and what it was offered; ``fresh`` marks those it had not before."""
    rows = offers.withColumn("old", F.lit(False))
    if graph is not None:
        same = F.array_repeat("node", F.size("nodes"))
        rows = rows.unionByName(graph.select("cell", same.alias("nodes"), F.col("nodes").alias("others"), "scores", F.lit(True).alias("old")))
    pair = np.dtype([("node", "<i8"), ("other", "<i8")])

    def pairs(node: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.stack([node, other], axis=1).astype("<i8")).view(pair).ravel()

    def each(of_cell: pa.Table) -> Iterable[pa.RecordBatch]:
        columns = {c: [x.values.to_numpy(zero_copy_only=False) for x in of_cell.column(c)] for c in ("nodes", "others", "scores")}
        old = of_cell.column("old").to_pylist()
        node, other, score = _nearest(*[np.concatenate(columns[c]) for c in ("nodes", "others", "scores")], k)
        known = [pairs(n, o) for n, o, is_old in zip(columns["nodes"], columns["others"], old) if is_old]
        fresh = ~np.isin(pairs(node, other), np.concatenate(known)) if known else np.ones(len(node), bool)
        cuts = np.flatnonzero(np.diff(node)) + 1
        some = node[np.r_[0, cuts]] if len(node) else node
        split = lambda x: np.split(x, cuts) if len(some) else []
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([of_cell.column("cell")[0].as_py()] * len(some), pa.int64()),
                pa.array(some, pa.int64()),
                pa.array(split(other), pa.list_(pa.int64())),
                pa.array(split(score), pa.list_(pa.float32())),
                pa.array(split(fresh), pa.list_(pa.bool_())),
            ],
            names=["cell", "node", "nodes", "scores", "fresh"],
        )

    return grouped_pass(rows, "cell", each, _GRAPH)


def _members(graph: DataFrame, k: int, turn: int) -> DataFrame:
    """at, part, new, old: members of the lists to compare, and the group they are compared in.

    A point's list has its neighbours, the points that list it, and itself.  Of
    very many that list it each part is a list of its own, in a group of its
    cell and the part.  Lists without a new member have nothing to compare.
    """
    edges = graph.select(F.col("node").alias("from"), F.explode(F.arrays_zip(F.col("nodes").alias("node"), "fresh")).alias("e")).select("from", "e.node", "e.fresh")
    # Powers of two: points that the same ones list get them in the same parts.
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / k))).cast("long")
    crowded = edges.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > 2 * k).select("node", parts.alias("parts"))
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("from", F.lit(turn)), "parts"))

    def of(fresh: bool) -> Column:
        return F.collect_list(F.when(F.col("fresh") == fresh, F.col("from")))

    reverse = edges.join(crowded, "node", "left").groupBy("node", part.alias("part")).agg(of(True).alias("r_new"), of(False).alias("r_old"))
    joined = graph.join(reverse, "node", "left")
    none = F.array().cast("array<long>")

    def own(fresh: bool) -> Column:
        pairs = F.arrays_zip(F.col("nodes").alias("node"), "fresh")
        return F.transform(F.filter(pairs, lambda p: p["fresh"] == fresh), lambda p: p["node"])

    new = F.array_distinct(F.concat(own(True), F.coalesce("r_new", none)))
    old = F.array_except(F.concat(own(False), F.coalesce("r_old", none), F.array("node")), F.col("new"))
    lists = joined.withColumn("new", new).where(F.size("new") > 0).withColumn("old", old)
    return lists.select(F.concat_ws("/", "cell", "part").alias("at"), "part", "new", "old")


def _gathered(offers: DataFrame, k: int) -> DataFrame:
    """Offers of parts, those of some parts to one cell merged."""

    def each(of_cell: pa.Table) -> Iterable[pa.RecordBatch]:
        lists = [np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in of_cell.column(c)]) for c in ("nodes", "others", "scores")]
        node, other, score = _nearest(*lists, k)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([of_cell.column("home")[0].as_py()], pa.int64()),
                pa.array([node], pa.list_(pa.int64())),
                pa.array([other], pa.list_(pa.int64())),
                pa.array([score], pa.list_(pa.float32())),
                pa.array([of_cell.column("part")[0].as_py()], pa.int64()),
            ],
            names=["cell", "nodes", "others", "scores", "part"],
        )

    by = F.floor(F.col("part") / _GATHERED).cast("long")
    return grouped_pass(offers.select(F.concat_ws("/", "cell", by).alias("at"), F.col("cell").alias("home"), "nodes", "others", "scores", by.alias("part")), "at", each, _OFFERS + ", part long")


_VECTORS = "at string, nodes array<long>, vectors binary, floors array<float>"


def _with_vectors(lists: DataFrame, columns: list[str], points: DataFrame, kind: str) -> DataFrame:
    """The vectors of the nodes in the array ``columns`` of the lists, once per group ``at``, a packed row for each cell they lie in.

    ``points``: cell, node, vector, floor.  A group names the nodes it needs by
    the cells they lie in.  A cell's points come before what is asked of it, so
    that a task holds one cell and answers row by row.
    """

    def ask(group: pa.Table) -> Iterable[pa.RecordBatch]:
        some = [x.values.to_numpy(zero_copy_only=False) for c in columns for x in group.column(c) if x.is_valid]
        nodes = np.unique(np.concatenate([*some, np.zeros(0, np.int64)])).astype(np.int64)
        cuts = np.flatnonzero(np.diff(nodes >> _PLACE_BITS)) + 1
        rows = np.split(nodes, cuts) if len(nodes) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(r[0] >> _PLACE_BITS) for r in rows], pa.int64()), pa.array([group.column("at")[0].as_py()] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.int64()))], names=["cell", "at", "nodes"]
        )

    asked = grouped_pass(lists.select("at", *columns), "at", ask, "cell long, at string, nodes array<long>")
    absent = lambda t: F.lit(None).cast(t)
    both = points.select("cell", F.lit(False).alias("asks"), "node", "vector", "floor", absent("string").alias("at"), absent("array<long>").alias("nodes")).union(
        asked.select("cell", F.lit(True), absent("long"), absent("binary"), absent("float"), "at", "nodes")
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        cell, table = None, None
        held: list[pa.RecordBatch] = []
        out: list[tuple[str, np.ndarray, bytes, np.ndarray]] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float32())))], names=["at", "nodes", "vectors", "floors"])

        for batch in batches:
            cells, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), len(cells)]
            for start, stop in zip(cuts, cuts[1:]):
                if start == stop:
                    continue
                if cells[start] != cell:
                    cell, table, held = cells[start], None, []
                if not asks[start]:
                    held.append(batch.slice(start, stop - start))
                    continue
                if table is None:
                    of_cell = pa.Table.from_batches(held)
                    order = np.argsort(of_cell.column(2).to_numpy())
                    table = of_cell.column(2).to_numpy()[order], _matrix(of_cell.column(3).to_pylist(), kind)[order], of_cell.column(4).to_numpy()[order]
                for at, wanted in zip(batch.column(5).slice(start, stop - start).to_pylist(), batch.column(6).slice(start, stop - start)):
                    nodes = wanted.values.to_numpy()
                    places = np.searchsorted(table[0], nodes)
                    out.append((at, nodes, table[1][places].tobytes(), table[2][places]))
                    size += len(out[-1][2])
                    if size > _PACKED:
                        yield made()
                        out, size = [], 0
        if out:
            yield made()

    return both.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(answer, _VECTORS)


def _unpacked(rows: pd.DataFrame, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order, their vectors and floors, of a group's packed rows."""
    nodes = np.concatenate([np.asarray(x) for x in rows["nodes"]])
    order = np.argsort(nodes)
    x = np.frombuffer(b"".join(rows["vectors"]), kind).reshape(len(nodes), -1)
    return nodes[order], x[order], np.concatenate([np.asarray(f) for f in rows["floors"]])[order]


def _descend(stored: Stored, graph: DataFrame, points: DataFrame, kind: str, s: GraphSettings, turn: int = 0) -> DataFrame:
    """One round: in each list, what is new is compared with all of it."""
    lists = stored.keep(_members(graph, s.k, turn))
    floor = F.when(F.size("nodes") >= s.k, F.element_at("scores", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    vectors = _with_vectors(lists, ["new", "old"], points.join(graph.select("node", floor.alias("floor")), "node"), kind)
    k = s.k

    def each(of_cell: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        ids, x, floors = _unpacked(known, kind)
        x = x.astype(np.float32)
        kept = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, (new, old) in enumerate(zip(of_cell["new"], of_cell["old"])):
            waiting += _compare(np.searchsorted(ids, new), np.searchsorted(ids, old), x, floors, k)
            if len(waiting) >= 256 or i == len(of_cell) - 1:
                kept = _nearest(*[np.concatenate(parts) for parts in zip(kept, *waiting)], k)
                waiting = []
        owner, other, score = kept
        part = of_cell["part"].iloc[0]
        return _offers(ids[owner], ids[other], score).assign(part=np.nan if pd.isna(part) else int(part)).astype({"part": "Int64"})

    offers = stored.keep(lists.groupBy("at").cogroup(vectors.groupBy("at")).applyInPandas(each, _OFFERS + ", part long"))
    parts = lists.agg(F.max("part")).first()[0]
    merged = offers.where("part IS NULL").drop("part")
    if parts is not None:
        of_parts, parts = offers.where("part IS NOT NULL"), parts + 1
        while parts > _GATHERED:
            of_parts, parts = _gathered(of_parts, k), math.ceil(parts / _GATHERED)
        merged = merged.unionByName(of_parts.drop("part"))
    new = stored.keep(_merged(graph, merged, k))
    stored.drop(lists, offers)
    return new


def _placed(stored: Stored, points: DataFrame, trees: _Trees, kind: str, s: GraphSettings) -> DataFrame:
    """The leaf of each point in each tree; a leaf that came out too large is dealt in parts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            leaves = trees.leaves(_matrix(batch.column(1).to_pylist(), kind).astype(np.float64)) if len(batch) else np.zeros((0, s.trees), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(leaves), pa.list_(pa.int64()))], names=["key", "leaves"])

    codes = stored.keep(points.select("key", "vector").mapInArrow(each, "key long, leaves array<long>").select("key", F.posexplode("leaves").alias("tree", "code")))
    counts = codes.groupBy("tree", "code").agg(F.ceil(F.count("*") / (2 * s.leaf)).alias("parts"))
    return codes.join(counts, ["tree", "code"]).select("key", "tree", "code", F.pmod(F.xxhash64("key", "tree"), "parts").alias("part"))


def _numbered(placed: DataFrame) -> DataFrame:
    """The number of each point: its leaf in the first tree, the leaf's part, its place there."""
    place = F.row_number().over(W.partitionBy("code", "part").orderBy("key")) - 1
    number = (F.col("code") * (1 << _PART_BITS) + F.col("part")) * (1 << _PLACE_BITS) + place
    return placed.where("tree = 0").select("key", number.alias("node"))


@dataclass
class Index:
    """A neighbour graph over the distinct vectors of a table."""

    stored: Stored
    settings: GraphSettings
    #: cell, node, vector (bytes)
    points: DataFrame
    #: vec_id, node of every row that takes part
    rows: DataFrame
    #: cell, node, nodes, scores, fresh
    graph: DataFrame
    kind: str
    #: Number of points.
    n: int


def build_index(vectors: DataFrame, settings: GraphSettings = GraphSettings()) -> Index | None:
    """Index ``vectors`` (``vec_id``, ``embedding``); None if no row takes part.

    Null, empty and zero vectors, those with null or non-finite components, rows
    without an id, and vectors of another length than most take no part.
    """
    s = settings
    stored = Stored(vectors.sparkSession, "neighbours")
    element = vectors.schema["embedding"].dataType.elementType
    kind, limit = ("<f4", 3.5e38) if isinstance(element, T.FloatType) else ("<f8", float("inf"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)) & F.exists("embedding", lambda v: v != 0)
    usable = stored.keep(vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))))
    lengths = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return None
    usable = usable.where(F.size("embedding") == lengths[0])
    distinct = usable.groupBy("embedding").agg(F.count("*").alias("copies")).select("embedding")
    keyed = stored.keep(distinct.withColumn("key", F.monotonically_increasing_id()))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            x = [np.asarray(v, kind).tobytes() for v in batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["key", "vector"])

    bare = stored.keep(keyed.select("key", "embedding").mapInArrow(to_bytes, "key long, vector binary"))
    n = bare.count()
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 20))
    sample = bare.where(share < int((1 << 20) * min(1.0, s.fit_rows / n))).orderBy("key").toPandas()["vector"]
    fitted = _matrix(sample, kind).astype(np.float64) if len(sample) else np.zeros((0, lengths[0]))
    trees = _Trees.fit(fitted, max(0, math.ceil(math.log2(n / s.leaf))), s)
    placed = stored.keep(_placed(stored, bare, trees, kind, s))
    numbers = stored.keep(_numbered(placed))
    cell = F.shiftright("node", _PLACE_BITS).alias("cell")
    points = stored.keep(bare.join(numbers, "key").select(cell, "node", "key", "vector"))
    rows = stored.keep(usable.join(keyed, "embedding").join(numbers, "key").select("vec_id", "node"))
    leaf = F.concat_ws("_", "tree", "code", "part").alias("leaf")
    graph = stored.keep(_merged(None, _first_offers(placed.select("key", leaf).join(points, "key"), kind, s), s.k))
    # A point alone in all its leaves has an empty list.
    graph = stored.keep(points.select("cell", "node").join(graph.drop("cell"), "node", "left").select(*[F.coalesce(c, F.array().cast(t)).alias(c) if t else F.col(c) for c, t in (("cell", None), ("node", None), ("nodes", "array<long>"), ("scores", "array<float>"), ("fresh", "array<boolean>"))]))
    points = points.drop("key")
    for turn in range(s.bounds(n)[0] if n > s.leaf else 0):
        before, graph = graph, _descend(stored, graph, points, kind, s, turn)
        stored.drop(before)
        if graph.agg(F.sum(F.size(F.filter("fresh", lambda x: x)))).first()[0] <= s.least_change * n * s.k:
            break
    return Index(stored, s, points, rows, graph, kind, n)


_STATE = "at string, query long, nodes array<long>, scores array<double>, walked array<boolean>"


def _walk(index: Index, sources: DataFrame) -> DataFrame:
    """Greedy search from the points ``sources`` (node): the nearest points found, themselves included."""
    stored, kind = index.stored, index.kind
    steps, held, beam = index.settings.bounds(index.n)
    lists = index.graph.select("node", F.col("nodes").alias("members"))
    points = index.points.withColumn("floor", F.lit(0.0).cast("float"))
    cell = F.shiftright("query", _PLACE_BITS).cast("string").alias("at")
    # The first look is at the query's own list.
    starts = sources.select(F.col("node").alias("query"))
    ahead = starts.join(lists, F.col("query") == F.col("node")).select(cell, "query", F.concat("members", F.array("query")).alias("members"))
    state = None
    for _ in range(steps + 1):
        looked = ahead.select("at", "query", "members", *[F.lit(None).cast(t).alias(c) for c, t in (("nodes", "array<long>"), ("scores", "array<double>"), ("walked", "array<boolean>"))])
        if state is not None:
            looked = looked.unionByName(state.select("at", "query", F.array("query").alias("members"), "nodes", "scores", "walked"))
        looked = stored.keep(looked)

        def each(of_cell: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            ids, x, _ = _unpacked(known, kind)
            x = x.astype(np.float64)
            out = []
            for query, rows in of_cell.groupby("query"):
                have = rows[rows["nodes"].notna()]
                nodes, scores, walked = (np.concatenate([*map(np.asarray, have[c]), np.zeros(0, t)]).astype(t) for c, t in (("nodes", np.int64), ("scores", float), ("walked", bool)))
                # What was in the beam has been walked from by now.
                walked[:beam] = True
                seen = [np.asarray(m) for m in rows["members"] if m is not None]
                new = np.setdiff1d(np.concatenate([*seen, np.zeros(0, np.int64)]).astype(np.int64), nodes)
                own = x[np.searchsorted(ids, query)]
                fresh = np.array([x[i] @ own for i in np.searchsorted(ids, new)])
                nodes, scores, walked = np.r_[nodes, new], np.r_[scores, fresh], np.r_[walked, np.zeros(len(new), bool)]
                # The query's list has been looked at first.
                walked |= nodes == query
                order = np.lexsort((nodes, -scores))[:held]
                out.append((rows["at"].iloc[0], query, nodes[order], scores[order], walked[order]))
            return pd.DataFrame(out, columns=["at", "query", "nodes", "scores", "walked"])

        found = looked.groupBy("at").cogroup(_with_vectors(looked, ["members"], points, kind).groupBy("at")).applyInPandas(each, _STATE)
        before, state = state, stored.keep(found)
        stored.drop(looked, *([before] if before is not None else []))
        open_nodes = state.select("at", "query", F.explode(F.arrays_zip(F.slice("nodes", 1, beam).alias("node"), F.slice("walked", 1, beam).alias("walked"))).alias("x"))
        fringe = open_nodes.where(~F.col("x.walked")).select("at", "query", F.col("x.node").alias("node"))
        if fringe.isEmpty():
            break
        ahead = fringe.join(lists, "node").select("at", "query", "members")
    return state.select(F.col("query").alias("node"), F.explode(F.arrays_zip("nodes", "scores")).alias("x")).select("node", F.col("x.nodes").alias("near"), F.col("x.scores").alias("score"))


def search(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows found for each of ``queries`` (``vec_id``, rows of the index).

    Returns query_id, rank (from 1), vec_id and score, the inner product in double
    precision; ties go to the smaller vec_id; a query is no neighbour of its own.
    """
    asked = index.stored.keep(queries.select("vec_id").distinct().join(index.rows, "vec_id"))
    near = _walk(index, asked.select("node").distinct())
    # Of equal vectors the k + 1 least ids can be among the nearest of anything.
    first = index.rows.distinct().withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    rows = near.join(first.select(F.col("node").alias("near"), "vec_id"), "near")
    nearest = W.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    best = index.stored.keep(rows.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1).select("node", "vec_id", "score"))
    pairs = asked.withColumnRenamed("vec_id", "query_id").join(best, "node").where("query_id != vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def no_neighbours(frame: DataFrame) -> DataFrame:
    """The result of a search where no row takes part."""
    return frame.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
