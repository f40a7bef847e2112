from __future__ import annotations

from decimal import Decimal

from cantiga.plans.digest import leader, preview, result_digest, top_k, totals

ROWS = "artist string, revenue double, royalties double"


def test_top_row_leads(spark):
    frame = spark.createDataFrame([("Artista A", 1000.0, 100.0), ("Artista B", 100.0, 10.0)], ROWS)
    parts = result_digest(frame, ["revenue", "royalties"], ["artist"])
    assert tuple(parts.leader.first()) == ("Artista A", "revenue", "1.000,00")
    assert tuple(parts.totals.first()) == (1100.0, 110.0, 2)
    assert [r.artist for r in parts.preview.collect()] == ["Artista A", "Artista B"]


def test_nulls_rank_last_and_ties_keep_dimension_order(spark):
    frame = spark.createDataFrame([("d", None, 1.0), ("b", 5.0, 1.0), ("a", 5.0, 1.0), ("c", -9.0, 1.0)], ROWS)
    assert [r.artist for r in top_k(frame, "revenue", ["artist"], 4).collect()] == ["a", "b", "c", "d"]
    assert [r.artist for r in top_k(frame, "revenue", ["artist"]).collect()] == ["a", "b", "c"]


def test_preview_drops_rows_of_zeros_after_ranking(spark):
    rows = [(f"a{i:02d}", float(i), 0.0) for i in range(1, 6)] + [(f"z{i:02d}", 0.0, None) for i in range(30)]
    frame = spark.createDataFrame(rows, ROWS)
    assert [r.artist for r in preview(frame, ["revenue", "royalties"], ["artist"]).collect()] == ["a05", "a04", "a03", "a02", "a01"]


def test_preview_keeps_zeros_when_there_is_nothing_else(spark):
    frame = spark.createDataFrame([(f"z{i:02d}", 0.0, None) for i in range(30)], ROWS)
    assert [r.artist for r in preview(frame, ["revenue", "royalties"], ["artist"]).collect()] == [f"z{i:02d}" for i in range(10)]


def test_preview_sees_the_first_twenty_only(spark):
    rows = [(f"p{i:02d}", 1.0, 1.0) for i in range(12)] + [(f"q{i:02d}", 0.5, None) for i in range(20)]
    got = preview(spark.createDataFrame(rows, ROWS), ["revenue"], ["artist"]).collect()
    assert len(got) == 10 and [r.posicao for r in got] == list(range(1, 11))


def test_empty_result(spark):
    frame = spark.createDataFrame([], ROWS)
    parts = result_digest(frame, ["revenue"], ["artist"])
    assert parts.leader.count() == 0 and parts.preview.count() == 0
    assert tuple(parts.totals.first()) == (0.0, 0)


def test_missing_label_and_whole_numbers(spark):
    frame = spark.createDataFrame([(None, 1234567)], "artist string, shows bigint")
    assert tuple(leader(frame, ["shows"], ["artist"]).first()) == ("(sem valor)", "shows", "1.234.567")
    assert leader(frame, ["shows"], []).first().rotulo == "(sem valor)"


def test_totals_skip_text(spark):
    frame = spark.createDataFrame([("a", "x", Decimal("1.5")), ("b", "y", None)], "artist string, note string, v decimal(18,4)")
    assert tuple(totals(frame, ["note", "v"]).first()) == (0.0, 1.5, 2)
