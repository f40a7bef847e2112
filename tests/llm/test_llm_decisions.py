"""Quality rules, quality scores and languages: counts by brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantiga.llm import language, pu_quality, rules
from cantiga.llm.queries import QUERIES
from cantiga.llm.text_stats import COUNTS, counts

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, score string, n_words int"
LABELS = "doc_id long, quality int, toxic int"
ODD = [
    (None, None, None, None, None, None),
    (1, "", "en", "a", "x", 1),
    (2, " \t\r\n\x0b\x0c", None, None, "x", 1),
    (3, "one two three four five six seven eight nine ten", "en", "a", None, 2),
    (3, "one two three four five six seven eight nine ten", "en", "a", None, 2),
    (4, "word " * 200_000, "en", "a", "y", 3),
    (5, "123 456 !!", "en", "b", "y", 3),
]


def naive_counts(text):
    """The contract's counts, the plain way."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(inside)


TEXTS = ["", None, "a", "a b c d e a b c d e", "a b c d e f a b c d e f g", "x x x x x x x", "l1\nl1\n \n\nl2\nl1", "# * a$%&|<> é\u00a0ü", "a b c d e " * 3 + "\nz", "1 2 3 4 5 6\n1 2 3 4 5"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts_by_brute_force(text):
    assert counts(text)[:5] == naive_counts(text)


def test_rules_query_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op2_quality_rules"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        n = naive_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.kept and r.base_failed)


def test_rules_keep_good_and_reject_bad(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = QUERIES["op2_quality_rules"](spark, SF).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    kept = dict(rows)
    assert kept[1] > 0.98 and kept[0] < 0.3


def test_learned_rule_is_the_planted_one():
    draw = np.random.default_rng(0)
    values = {"symbols_per_word": draw.random(3000), "upper_share": draw.random(3000)}
    bad = (values["symbols_per_word"] > 0.8) & (values["upper_share"] > 0.5)
    found = rules.learn(values, bad, draw.random(3000) < 1 / 3)
    assert len(found) == 1 and {t.share for t in found[0]} == set(values)
    hit = np.logical_and.reduce([t.of(values) for t in found[0]])
    assert (hit == bad).mean() > 0.99


def test_rules_on_odd_rows(spark):
    documents = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, None), (None, 0, 0), (5, None, 1)], LABELS)
    judged, found = rules.judge(documents, labels, keep=["lang", "source"])
    rows = judged.collect()
    assert len(rows) == len(ODD) and found == []
    assert {r.doc_id: r.kept for r in rows} == {None: False, 1: False, 2: False, 3: True, 4: False, 5: False}
    assert rules.judge(documents, labels, keep=["n_words", "score"])[0].columns == ["doc_id", "score", *COUNTS, "base_failed", "kept"]
    assert rules.judge(documents.limit(0), labels)[0].count() == 0
    assert rules.judge(documents, labels.limit(0))[1] == []


def test_verdict_is_an_ordered_expression(spark):
    rule = (rules.Threshold("upper_share", True, 0.5), rules.Threshold("n_words", False, 20.0))
    frame = spark.createDataFrame([tuple([10, *[0] * 5, n, *[0] * 9]) for n in (2, 8)], ", ".join(f"{c} long" for c in COUNTS))
    assert [r[0] for r in frame.select(rules.verdict([rule])).collect()] == [True, False]
    assert str(rule[0]) == "upper_share >= 0.5"


def test_scores_on_held_out_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scores = QUERIES["op10_quality_scores"](spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").toPandas()
    good, bad = (scores[scores["quality"] == q]["score"].to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.99
    assert (good >= 0.7).mean() > 0.97 and (bad >= 0.7).mean() < 0.1


def test_prior_is_estimated_from_positives_and_unlabelled():
    draw = np.random.default_rng(1)
    positive, unlabelled = draw.normal(2, 1, 4000), np.concatenate([draw.normal(2, 1, 4200), draw.normal(-2, 1, 1800)])
    assert 0.62 < pu_quality.estimate_prior(positive, unlabelled) < 0.75


def test_scores_on_odd_rows(spark):
    documents = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (1, 1, 0), (1, 0, 0), (None, 1, 0)], LABELS)
    scored, model = pu_quality.score_quality(documents, labels, F.lit(True), keep=["lang"])
    rows = scored.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and model is not None
    scored, model = pu_quality.score_quality(documents, labels.limit(0), F.lit(True))
    assert model is None and {r.score for r in scored.collect()} == {0.5}
    assert pu_quality.score_quality(documents.limit(0), labels, F.lit(True))[0].count() == 0
    assert pu_quality.score_quality(documents, labels, F.lit(True), keep=["score", "lang"])[0].columns == ["doc_id", "lang", "score"]


def naive_bits(seen: list[bytes], data: bytes) -> float:
    """PPM with escapes of method C, straight from counted contexts."""
    follow: dict[bytes, Counter] = {}
    for text in seen:
        text = b"\n\n\n" + text
        for i in range(3, len(text)):
            for k in range(4):
                follow.setdefault(text[i - k : i], Counter())[text[i]] += 1
    total, data = 0.0, b"\n\n\n" + data
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            have = follow.get(data[i - k : i])
            if not have:
                continue
            n, kinds = sum(have.values()), len(have)
            if data[i] in have:
                total -= np.log2(have[data[i]] / (n + kinds))
                break
            total -= np.log2(kinds / (n + kinds))
        else:
            total += 8
    return total


def test_code_lengths_by_brute_force():
    seen = {"a": [b"the cat sat on the mat", b"the rat"], "b": ["der hund läuft".encode(), b"das ist der mann"]}
    grams: Counter = Counter()
    for k, name in enumerate(seen):
        for text in seen[name]:
            text = b"\n\n\n" + text
            grams.update((int.from_bytes(text[i : i + 4], "big"), k) for i in range(len(text) - 3))
    keys = list(grams)
    trees = language.grow(list(seen), np.array([g for g, _ in keys]), np.array([k for _, k in keys]), np.array([float(grams[g]) for g in keys]))
    for text in (b"the cat", b"der mann", b"xyz \xff\x00", "läuft".encode(), b"t", b"the matte rat on der hund"):
        want = [naive_bits(seen[name], text) for name in seen]
        assert language.text_bits(trees, [b"zz", text])[1] == pytest.approx(want, rel=1e-5)


def test_a_text_scored_in_parts_is_scored_whole(monkeypatch):
    grams = np.array([int.from_bytes(b"abab", "big"), int.from_bytes(b"baba", "big")])
    trees = language.grow(["x"], grams, np.zeros(2, int), np.array([5.0, 4.0]))
    whole = language.text_bits(trees, [b"ab" * 50])
    monkeypatch.setattr(language, "_AT_ONCE", 7)
    assert language.text_bits(trees, [b"ab" * 50]) == pytest.approx(whole)


def test_languages_of_held_out_documents(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    found = QUERIES["op8_languages"](spark, SF)
    assert found.count() == documents.count()
    held = found.where("held_out").join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98 and held["score"].between(0, 1).all()


def test_languages_of_odd_rows(spark):
    documents = spark.createDataFrame(ODD, SCHEMA)
    trees = language.learn(documents)
    rows = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(documents, trees, keep=["n_words"]).collect()}
    assert rows == {(None, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0), (3, "en", 1.0), (4, "en", 1.0), (5, "und", 0.0)}
    assert language.learn(documents.limit(0)) is None
    assert {r.lang_pred for r in language.identify(documents, None).collect()} == {"und"}
    assert language.identify(documents.limit(0), trees).count() == 0
