"""Joins on a key that holds a third of the rows, with broadcasting off: no task may get them all."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from cantiga.operators.calendar import build_calendar, with_calendar
from cantiga.operators.latest import status_changes
from cantiga.operators.ledger import active_ledger
from cantiga.operators.matching import match_composer, match_keyword
from cantiga.sources.relation import left_lookup

N = 60_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def strict(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def largest(frame):
    """Rows, and the share of the task with most."""
    # The hash keeps every column in the shuffle.
    counts = [r[1] for r in frame.groupBy(F.spark_partition_id()).agg(F.count("*"), F.max(F.hash("*"))).collect()]
    return sum(counts), max(counts) / sum(counts)


def third(hot, other):
    return F.when(F.col("id") % 3 == 0, hot).otherwise(other)


def rows(spark):
    return spark.range(0, N, 1, 16)


def test_shows_on_one_date(strict):
    day = third(F.lit("2026-05-01").cast("date"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 300).cast("int")))
    span = strict.range(1).select(F.lit("2026-01-01").cast("date").alias("inicio"), F.lit("2026-12-31").cast("date").alias("fim"))
    shows = rows(strict).select("id", day.alias("dt_show"), F.md5(F.col("id").cast("string").cast("binary")).alias("artista"))
    n, share = largest(with_calendar(shows, build_calendar(span)))
    assert n == N and share < 0.2
    holidays = strict.createDataFrame([(date(2026, 5, 1), "x", None)], "data date, nome_feriado string, uf_feriado string")
    n, share = largest(with_calendar(shows, build_calendar(span, holidays)))
    assert n == N and share < 0.2


def test_entries_of_one_group(strict):
    groups = strict.range(400).select(F.concat(F.lit("g"), F.col("id") % 200).alias("grupo"), F.lit(True).alias("ativo"))
    entries = rows(strict).select("id", F.concat(F.lit("g"), third(F.lit(0), F.col("id") % 200)).alias("grupo"), F.md5(F.col("id").cast("string").cast("binary")).alias("projeto"))
    n, share = largest(active_ledger(entries, groups))
    assert n == N and share < 0.2


def test_tracks_of_one_composer(strict):
    artists = strict.range(400).select("id", F.concat(F.lit("c"), F.col("id") % 200).alias("universal_compositor"))
    tracks = rows(strict).select(F.col("id").cast("string").alias("codigo_musica"), F.concat(F.lit("c"), third(F.lit(0), F.col("id") % 200)).alias("compositor"))
    found = match_composer(tracks, artists)
    assert found.count() == N
    n, share = largest(found)
    assert share < 0.2


def test_names_with_one_keyword(strict):
    names = rows(strict).select(F.concat(third(F.lit("MC "), F.lit("dj ")), F.col("id")).alias("nome"))
    keywords = strict.createDataFrame([(1, "mc "), (2, "nobody at all")], "id int, keyword string")
    found = match_keyword(names, keywords)
    n, share = largest(found)
    assert n == N // 3 and share < 0.2


def test_one_key_of_a_lookup(strict):
    table = strict.range(400).select((F.col("id") % 200).alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    frame = rows(strict).select("id", third(F.lit(7), F.col("id") % 200).alias("k"), F.md5(F.col("id").cast("string").cast("binary")).alias("more"))
    n, share = largest(left_lookup(["k"], ["v"], lambda: table).attach(frame))
    assert n == N and share < 0.2


def test_one_contract_with_all_rows_on_one_day(strict):
    key = third(F.lit("hot"), F.col("id").cast("string"))
    frame = rows(strict).select(key.alias("contrato"), F.lit("2026-01-01").cast("date").alias("dia"), "id", (F.col("id") % 2).alias("status"))
    # Every third row is of the hot contract: 0, 3, 6.. whose status changes from row to row.
    n, share = largest(status_changes(frame, ["contrato"], "status", ["dia", "id"]))
    assert n == N // 3 - 1 and share < 0.2


def test_repeats_in_a_lookup_do_not_multiply_rows(spark):
    tracks = spark.createDataFrame([("t1", "A"), ("t1", "B"), ("t1", "A"), ("t2", None), (None, "A")], "codigo_musica string, compositor string")
    artists = spark.createDataFrame([(5, "A"), (3, "B"), (9, "A")], "id int, universal_compositor string")
    assert sorted(match_composer(tracks.where("codigo_musica is not null"), artists).collect()) == [("t1", 3)]
    names = spark.createDataFrame([("x", 2, None), ("x", 1, "b"), ("y", 3, None)], "k string, a int, b string")
    frame = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "k string")
    got = {r.k: (r.a, r.b) for r in left_lookup(["k"], ["a", "b"], lambda: names).attach(frame).collect()}
    assert got == {"x": (1, "b"), "y": (3, None), "z": (None, None), None: (None, None)}
