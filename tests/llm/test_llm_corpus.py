"""Similar texts, neighbours, mixing, packing and the pipeline, against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cantiga.llm import mixing, neighbours, ngram_join, packing
from cantiga.llm.common import Stored, components
from cantiga.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_links(texts, threshold=0.8):
    """Links of each row, and the least row of its component, comparing all with all."""
    sets = []
    for text in texts:
        w = WORD.findall(text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    links, root = Counter(), list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common / (len(sets[i]) + len(sets[j]) - common) >= threshold:
                links[i] += 1
                links[j] += 1
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return [links[i] for i in range(len(sets))], root


def near_copies(n, seed=0):
    """Groups of near copies, with copies, overlaps below the threshold and texts of few words."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefgh", k=4))
    out, shared = [], [word() for _ in range(40)]
    for _ in range(n // 8):
        base = [word() for _ in range(draw.choice((6, 60, 120)))]
        out.append(" ".join(base))
        out.append("  ".join(base))
        for _ in range(4):
            changed = list(base)
            for _ in range(draw.choice((0, 1, 2))):
                changed[draw.randrange(len(changed))] = word()
            out.append(" ".join(changed))
        out.append(" ".join(shared + [word() for _ in range(30)]))
        out.append(draw.choice(("few words", "one", "few  words")))
    return out


@pytest.mark.parametrize("blocks", [(1024, 512), (3, 4)])
def test_similar_texts_by_brute_force(spark, blocks):
    texts = near_copies(160)
    links, root = naive_links(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = ngram_join.similar_texts(frame, ngram_join.ForestSettings(bucket_block=blocks[0], component_block=blocks[1])).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in found} == dict(enumerate(zip(links, root)))


def test_similar_texts_query_by_brute_force(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    links, root = naive_links([r.text for r in documents])
    found = {r.doc_id: (r.n_links, r.class_id) for r in QUERIES["op4_similar_texts"](spark, SF).collect()}
    assert found == {r.doc_id: (n, documents[k].doc_id) for r, n, k in zip(documents, links, root)}


def test_similar_texts_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None, 1), (1, "", 1), (2, " \n", 1), (3, long, 1), (4, long + " more", 1), (5, "same text here", 1), (5, "same text here", 1), (5, "another one", 1), (None, "same text here", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    found = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_texts(frame).collect())
    assert found == Counter({(None, None, 0): 1, (1, 1, 0): 1, (2, 2, 0): 1, (3, 3, 1): 1, (4, 3, 1): 1, (5, 5, 2): 2, (5, 5, 0): 1, (None, 5, 2): 1})
    assert ngram_join.similar_texts(frame.limit(0)).count() == 0


def test_similar_texts_of_rows_without_an_id(spark):
    texts = near_copies(40)
    links, root = naive_links(texts)
    sizes = Counter(root)
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    found = ngram_join.similar_texts(frame, ngram_join.ForestSettings(component_block=8)).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in found) == Counter((None, None, n) for n in links)
    assert len(sizes) < len(texts)


@pytest.mark.parametrize("step", [1, 3, 8])
def test_similar_texts_do_not_depend_on_the_steps(spark, step):
    texts = near_copies(60)
    links, root = naive_links(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = ngram_join.similar_texts(frame, ngram_join.ForestSettings(step=step)).collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in found} == dict(enumerate(zip(links, root)))


def test_components_of_chains_hubs_cliques_and_random_links(spark):
    draw = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    hub = [(100, x) for x in range(101, 160)] + [(99, 160), (160, 159)]
    clique = [(a, b) for a in range(200, 212) for b in range(200, a)]
    mixed = [(draw.randrange(300, 400), draw.randrange(300, 400)) for _ in range(70)]
    star = [(500, x) for x in range(501, 520)]
    edges = [pair if draw.random() < 0.5 else pair[::-1] for pair in chain + hub + clique + mixed + star + star]
    root = {x: x for pair in edges for x in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    stored = Stored(spark, "components")
    found = components(stored, spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(found) == len(root) and {r.node: r.root for r in found} == root
    assert components(stored, spark.createDataFrame([], "a long, b long")).count() == 0


def test_bucket_edges_join_what_a_search_of_all_pairs_joins():
    draw = np.random.default_rng(5)
    for _ in range(60):
        base = draw.integers(0, 4, (6, 32), dtype=np.uint8)
        values = base[draw.integers(0, 6, 40)]
        values = np.where(draw.random(values.shape) < 0.15, draw.integers(0, 4, values.shape), values).astype(np.uint8)
        values[:, 8:10] = 1
        roots = [bytes([int(x)]) for x in draw.integers(0, 30, 40)]
        edges = ngram_join._bucket_edges(values, values[:, 8:16], roots, 2, 0.7)

        def groups(pairs):
            sets = ngram_join._Sets(40)
            for i in range(40):
                sets.join(i, roots.index(roots[i]))
            for i, j in pairs:
                sets.join(i, j)
            return [sets.root(i) for i in range(40)]

        near = [(i, j) for i in range(40) for j in range(i) if (values[i] == values[j]).sum() >= 0.7 * 32]
        assert groups(edges) == groups(near)
        assert len(edges) == len(set(groups([]))) - len(set(groups(edges)))


def test_prefix_is_the_longest_with_the_target_recall():
    s = ngram_join.ForestSettings()
    chance = lambda depth: 1 - (1 - s.threshold**depth) ** s.trees
    assert chance(s.prefix) >= s.recall > chance(s.prefix + 1)


def nearest(ids, x, query, k):
    score = x @ x[query]
    order = [i for i in np.lexsort((ids, -score)) if i != query][:k]
    return [(int(ids[i]), score[i]) for i in order]


def test_neighbours_of_the_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    found = defaultdict(list)
    for r in QUERIES["op3_nearest_vectors"](spark, SF).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(found) == {ids[i] for i in asked}
    hits = [len({v for v, _ in found[ids[i]]} & {v for v, _ in nearest(ids, x, i, 20)}) for i in asked]
    assert np.mean(hits) / 20 >= 0.9


def test_neighbours_recall_over_several_cells(spark):
    draw = np.random.default_rng(3)
    x = (draw.standard_normal((12, 16))[draw.integers(0, 12, 3000)] + 0.5 * draw.standard_normal((3000, 16))).astype(np.float32)
    x[100:1100] = x[100]  # a third of the rows are one vector
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = neighbours.build_index(frame, neighbours.GraphSettings(k=30, leaf=256, trees=4))
    got = defaultdict(list)
    for r in neighbours.search(index, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    exact = x.astype(float)
    same = 0
    for query in range(0, 3000, 20):
        want = nearest(np.arange(3000), exact, query, 20)
        assert len(got[query]) == 20 and [s for _, s in got[query]] == sorted((s for _, s in got[query]), reverse=True)
        # Equal scores are equal neighbours, but for ties, where the lesser id comes first.
        same += sum(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got[query], want))
    assert same / (150 * 20) >= 0.9
    assert [v for v, _ in got[200]][:3] == [v for v, _ in nearest(np.arange(3000), exact, 200, 3)]


def hub_graph(spark, stored, s, n=4000):
    """Almost equal points that all list the same few."""
    draw = np.random.default_rng(5)
    x = (1 + 1e-3 * draw.standard_normal((n, 8))).astype("<f4")
    number = lambda i: ((i // s.leaf) << neighbours._PLACE_BITS) + i % s.leaf
    points = stored.keep(spark.createDataFrame([(number(i) >> neighbours._PLACE_BITS, number(i), v.tobytes()) for i, v in enumerate(x)], "cell long, node long, vector binary"))
    lists = [[h for h in range(5) if h != i][: s.k] for i in range(n)]
    rows = [(number(i) >> neighbours._PLACE_BITS, number(i), list(map(number, m)), [float(x[i] @ x[j]) for j in m], [True] * len(m)) for i, m in enumerate(lists)]
    return points, stored.keep(spark.createDataFrame(rows, neighbours._GRAPH)), {number(i): list(map(number, m)) for i, m in enumerate(lists)}


def test_a_point_that_all_list_fills_no_task(spark):
    s, stored = neighbours.GraphSettings(k=4, leaf=128), Stored(spark, "hubs")
    points, graph, lists = hub_graph(spark, stored, s)
    members = neighbours._members(graph, s.k, 0)
    groups = members.select("at", F.explode(F.concat("new", "old")).alias("node")).distinct().groupBy("at").count()
    assert groups.agg(F.max("count")).first()[0] <= 4 * s.leaf
    # Every point that lists a hub is in one of its parts.
    assert members.where("part IS NOT NULL").select(F.explode("new").alias("node")).distinct().count() == len(lists)
    new = {r.node: list(r.nodes) for r in neighbours._descend(stored, graph, points, "<f4", s).collect()}
    assert set(new) == set(lists) and all(len(m) == s.k for m in new.values())
    # Found by way of the parts: points that are nearer than the first four.
    assert sum(set(m) != set(lists[i]) for i, m in new.items()) > len(lists) / 2
    # The parts are other ones in the next round.
    again = neighbours._members(graph, s.k, 1).where("part IS NOT NULL").groupBy("at").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("new")))).alias("m"))
    before = members.where("part IS NOT NULL").groupBy("at").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("new")))).alias("m"))
    assert again.join(before, ["at", "m"]).count() == 0


def test_what_is_not_new_is_not_compared_again(spark):
    s, stored = neighbours.GraphSettings(k=4, leaf=128), Stored(spark, "flags")
    _, graph, lists = hub_graph(spark, stored, s)
    old = graph.withColumn("fresh", F.transform("fresh", lambda _: F.lit(False)))
    assert neighbours._members(old, s.k, 0).count() == 0
    # One new edge: only the lists of its two ends have anything to compare, and it is the only new member there.
    first = F.col("node") == 7
    one = old.withColumn("fresh", F.when(first, F.array(F.lit(True), *[F.lit(False)] * 3)).otherwise(F.col("fresh")))
    found = neighbours._members(one, s.k, 0).collect()
    assert len(found) == 2 and sorted(r.new[0] for r in found) == [0, 7] and all(len(r.new) == 1 for r in found)


def test_neighbours_of_near_equal_vectors(spark):
    """With the query's own settings: 6,000 points around a few centres, far closer to each other than to the rest."""
    draw = np.random.default_rng(12)
    x = (draw.standard_normal((6, 24))[draw.integers(0, 6, 6000)] + 0.01 * draw.standard_normal((6000, 24))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = defaultdict(set)
    for r in neighbours.search(neighbours.build_index(frame), frame.where("vec_id % 20 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hits = [len(got[q] & {v for v, _ in nearest(np.arange(6000), x.astype(float), q, 20)}) for q in range(0, 6000, 20)]
    assert np.mean(hits) / 20 >= 0.9


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (40, []), (60, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = neighbours.build_index(frame)
    found = neighbours.search(index, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 0, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.build_index(frame.where("vec_id = 3")) is None
    assert neighbours.no_neighbours(frame).columns == ["query_id", "rank", "vec_id", "score"]


def naive_targets(sizes, most=3):
    """Shares by weight, the excess reshared until no source is above its limit."""
    total, target = sum(sizes), [0.0] * len(sizes)
    weight, fixed = [i % 3 + 1 for i in range(len(sizes))], set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(most * sizes[i] for i in fixed)
        for i in free:
            target[i] = left * weight[i] / sum(weight[j] for j in free)
        over = [i for i in free if target[i] > most * sizes[i]]
        if not over:
            return target
        for i in over:
            target[i] = most * sizes[i]
        fixed |= set(over)


@pytest.mark.parametrize("sizes", [[5000, 3000, 2000], [10, 20, 9000, 40, 5000, 30], [100, 0, 300], [1, 1, 1, 1, 10_000]])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(sizes)], "source string, source_size long").repartition(3)
    found = {r.source: r.target for r in mixing.source_targets(Stored(spark, "test"), frame, [1.0, 2.0, 3.0], 3.0).collect()}
    assert [found[k] for k in sorted(found)] == pytest.approx(naive_targets(sizes))


def test_mix_query(spark):
    folder = "/root/testdata/sf0.1"
    found = QUERIES["op7_mixed_sources"](spark, folder).toPandas()
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").toPandas()
    sizes = {i: len(WORD.findall(t or "")) for i, t in zip(texts["doc_id"], texts["text"])}
    assert dict(zip(found["doc_id"], found["size"])) == sizes
    assert (found["taken"] <= 3 * found["size"]).all() and (found["taken"] % found["size"].clip(lower=1) == 0).all()
    by = found.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["told"]).all()
    assert by["target"].tolist() == pytest.approx(naive_targets(by["size"].tolist()))
    assert ((by["taken"] - by["target"]).abs() <= 0.01 * by["target"]).all()
    again = QUERIES["op7_mixed_sources"](spark, folder).toPandas()
    assert found.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_flight_keeps_both_sums():
    draw = random.Random(4)
    fractions, sizes = [draw.random() for _ in range(500)], [float(draw.choice((0, 5, 5, 80, 3000))) for _ in range(500)]
    moved = mixing._flight(fractions, sizes, draw)
    assert sum(0 < f < 1 for f in moved) <= 2 and all(0 <= f <= 1 for f in moved)
    assert sum(moved) == pytest.approx(sum(fractions)) and np.dot(moved, sizes) == pytest.approx(np.dot(fractions, sizes))


def test_blocks_meet_in_later_rounds(spark):
    rows = [(i, f"s{i % 3}", 50 + i % 90) for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, words long")
    found = mixing.mix_sources(frame, F.col("words"), [1.0, 2.0, 3.0], block=16).toPandas()
    assert len(found) == 2000
    taken = (found["copies"] * found["size"]).groupby(found["source"]).sum()
    target = found.groupby("source")["target"].first()
    assert ((taken - target).abs() <= 200).all()


def test_mix_of_odd_rows(spark):
    rows = [(None, None, None), (1, None, "a b c"), (1, None, "a b c"), (2, "z", ""), (3, "a", "x " * 50_000), (4, "a", None)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copies", F.lit("x"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    found = mixing.mix_sources(frame, words, [1.0, 2.0, 3.0]).collect()
    assert len(found) == len(rows)
    # Code points, null last: a weighs 1, z 2, null 3; the limit of z is 0 and that of null 18.
    assert {(r.source, round(r.target, 6)) for r in found} == {("a", 50_006 - 18), ("z", 0.0), (None, 18.0)}
    assert {r.copies for r in found if r.size == 0} == {0} and {r.copies for r in found if r.source is None and r.size} == {3}
    assert mixing.mix_sources(frame.limit(0), words, [1.0]).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_packing_holds_every_token_once(lengths):
    pieces = packing.pack(lengths, 64)
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for document, start, length, sequence, offset in pieces:
        assert length > 0
        by_document[document].append((start, length))
        by_sequence[sequence].append((offset, length))
    for document, length in enumerate(lengths):
        at = 0
        for start, n in sorted(by_document[document]):
            assert start == at
            at += n
        assert at == length
    for spans in by_sequence.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 64 or at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing_goes_to_the_cheapest_sequence():
    # Descending: 40, 30, 20, 10 into two sequences of 64 (100 = 64 + 32 + 4): 40 alone, 30 to the empty one, and so on.
    found = {(d, k) for d, _, n, k, _ in packing.pack([10, 40, 20, 30, 28], 64)}
    assert len({k for d, k in found if d in (1, 3)}) == 2


def test_packing_looks_at_every_sequence():
    """Against a search of all sequences for the cheapest with room; more documents than any bound on the search are cut without it."""
    draw = random.Random(2)
    lengths = [draw.randint(1, 1200) for _ in range(1500)]
    rooms = [2048] * (sum(lengths) // 2048)
    rooms += [1 << bit for bit in range(11, -1, -1) if sum(lengths) % 2048 >> bit & 1]
    left, cost, cut = list(rooms), [0.0] * len(rooms), set()
    for length, document in sorted(((n, d) for d, n in enumerate(lengths)), key=lambda x: (-x[0], x[1])):
        best = min(((cost[k], -left[k], k) for k in range(len(rooms)) if left[k] >= length), default=None)
        if best is None:
            cut.add(document)
        else:
            left[best[2]] -= length
            cost[best[2]] += length + length * length / 1024
    parts = Counter(document for document, *_ in packing.pack(lengths, 2048))
    assert {d for d, n in parts.items() if n > 1} <= cut and max(parts[d] for d in parts if d not in cut) == 1


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 500_000 + "x", "a" * 200_000, "ab" * 4000 + " " * 9000 + "!" * 9000, " " * 8191 + "y"])
def test_long_runs_have_the_ids_of_the_tokenizer_file(text):
    tokenizer = Tokenizer.from_file(RANKS[1])
    assert packing.encoder(*RANKS)(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_packed_query_by_the_tokenizer_file(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    ends, spans = Counter(), defaultdict(list)
    for r in QUERIES["op6_packed_sequences"](spark, SF).collect():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and len(piece) == r.length
        ends[r.doc_id] += r.length
        spans[r.sequence_id].append((r.offset, r.length))
    assert ends == Counter({d: len(x) for d, x in ids.items()})
    padding = 0
    for parts in spans.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing_of_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (2, "a<|endoftext|>b", 1), (2, "a<|endoftext|>b", 1), (3, "long text " * 40_000, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, length int").coalesce(1)
    found = packing.pack_documents(frame, *RANKS, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: r.start):
        assert len(r.ids) == r.length
        got[r.doc_id].extend(r.ids)
    want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in rows}
    want[2] = want[2] * 2
    assert {d: sorted(x) for d, x in got.items()} == {d: sorted(x) for d, x in want.items()}
    assert packing.pack_documents(frame.limit(0), *RANKS).count() == 0


def test_pipeline_stages(spark):
    """Each stage on its input: what quality, rules and links decide elsewhere takes effect here."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1)).withColumn("n_words", F.lit("x")).withColumn("__row", F.lit(2))
    columns, stored, sizes = docs.columns, Stored(spark, "test"), [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stored.keep(stage(spark, docs, SF))
        assert docs.columns == columns, name
        sizes.append(docs.count())
        old, new = (Counter(tuple(r) for r in f.select("doc_id", "text", "lang", "source").collect()) for f in (before, docs))
        assert set(new) <= set(old), name
        if name == "near_duplicates":
            rows = before.select("doc_id", "text").orderBy("doc_id").collect()
            _, root = naive_links([r.text for r in rows])
            assert {r.doc_id for r in docs.collect()} == {rows[k].doc_id for k in set(root)}
        if name == "source_mix":
            assert max(new.values()) <= 3
        else:
            assert max(new.values()) == 1
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_on_an_empty_table_and_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "good words " * 30, "en", None, 5), (2, "good words " * 30, "en", None, 5)]
    for frame in (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),):
        for docs in (frame, frame.limit(0)):
            stored = Stored(spark, "test")
            for _, stage in corpus_pipeline.STAGES:
                docs = stored.keep(stage(spark, docs, SF))
            assert docs.columns[0] == "doc_id"
