from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from cantiga import vocabulary as V
from cantiga.catalog import SOURCES
from cantiga.plans import routing
from cantiga.plans.routing import route_questions, routing_mix

TODAY = "2026-06-26"
COLUMNS = (
    "n int, texto string, fonte string, metricas array<string>, dimensoes array<string>, inicio string, fim string, "
    "filtros map<string,string>"
)


def route(spark, *questions, today=TODAY):
    """Rows of the routed questions; a question is a text or (text, stated values)."""
    rows = []
    for n, question in enumerate(questions):
        text, given = question if isinstance(question, tuple) else (question, {})
        rows.append(
            (n, text, given.get("source"), given.get("metrics"), given.get("dimensions"), given.get("start"),
             given.get("end"), given.get("filters"))
        )
    frame = spark.createDataFrame(rows, COLUMNS)
    routed = route_questions(frame, "texto", today, "fonte", "metricas", "dimensoes", "inicio", "fim", "filtros")
    return routed.orderBy("n").collect()


def test_known_questions(spark):
    r = route(
        spark,
        "Como foram quantidade e royalties por artista nos ultimos 7 dias?",
        "Mostre royalties da Orchard por tipo de royalty",
        "Qual foi a receita da empresa no ultimo mes?",
        "Quanto foi o custo em fevereiro?",
        "Mostre dados do Omie por projeto",
        "Quais faixas da Orchard mais tocaram por artista?",
        "Quanto os shows geraram de receita por artista?",
        ("Receita por artista", {"source": "universal_detail"}),
        "Como foi a receita no ultimo ano?",
        "Royalties por gravadora",
        ("Receita por artista", {"source": "does_not_exist"}),
    )
    assert [x.rota_source for x in r] == [
        "royalty_performance", "royalty_performance", "omie_detail", "omie_detail", "omie_detail", "orchard_detail",
        "dsu_detail", "universal_detail", "omie_detail", "royalty_performance", "royalty_performance",
    ]
    assert r[0].rota_metrics == ["quantity", "royalties"] and "artist" in r[0].rota_dimensions
    assert (r[0].rota_start_date, r[0].rota_end_date) == ("2026-06-20", "2026-06-26")
    assert r[1].rota_filters["origem"] == "Orchard" and "revenue_type" in r[1].rota_dimensions
    assert "revenue" in r[2].rota_metrics and "royalties" not in r[2].rota_metrics
    assert "cost" in r[3].rota_metrics
    assert "origem" not in r[4].rota_filters
    assert {"track", "artist"} <= set(r[5].rota_dimensions)
    assert (r[8].rota_start_date, r[8].rota_end_date) == ("2025-06-27", "2026-06-26")
    assert "gravadora" in r[9].rota_dimensions and r[9].rota_filters == {"revenue_type": "Gravadora"}


def test_words_inside_words_and_accents(spark):
    r = route(
        spark,
        "ultimos 7 dias",  # 'dia' asks for the period
        "Como o interprete recebeu",  # 'erp' sits inside
        "Arrecadação e monetização",  # accented metric words never match
        "Intérprete do mês",  # nor do accented dimension words, but 'erp' still does
        "MÚSICA da SONY",
        "Reproduções por canção",
        "plataforma",
    )
    assert "period" in r[0].rota_dimensions
    assert r[1].rota_source == "omie_detail"
    assert r[2].rota_metrics == V.DEFAULT_METRICS
    assert r[3].rota_dimensions == ["artist"] and r[3].rota_source == "omie_detail"
    assert r[4].rota_source == "somlivre_detail" and r[4].rota_dimensions == ["track"]
    assert r[5].rota_source == "royalty_performance" and r[5].rota_metrics == ["quantity"]
    assert r[6].rota_dimensions == ["origem"]


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("de 2026-01-10 a 2026-02-20 e 2026-03-01", "2026-01-10", "2026-02-20"),
        ("de 2026-02-20 a 2026-01-10", "2026-02-20", "2026-01-10"),
        ("em 2026-13-45, ontem", "2026-13-45", "2026-13-45"),
        ("x2026-01-01", None, None),
        ("nas últimas   30 dias", "2026-05-28", "2026-06-26"),
        ("ultimos 0 dias", "2026-06-26", "2026-06-26"),
        ("last 7 days", None, None),
        ("last 7 dias de hoje", "2026-06-20", "2026-06-26"),
        ("ONTEM", "2026-06-25", "2026-06-25"),
        ("today", "2026-06-26", "2026-06-26"),
        ("última semana", "2026-06-20", "2026-06-26"),
        ("ultimo mês", "2026-05-28", "2026-06-26"),
        ("last year", "2025-06-27", "2026-06-26"),
        ("ultimos 99999999999 dias", None, "2026-06-26"),
        ("ultimos 900000 dias", None, "2026-06-26"),
        ("fevereiro", None, None),
    ],
)
def test_dates(spark, text, start, end):
    row = route(spark, text)[0]
    assert (row.rota_start_date, row.rota_end_date) == (start, end)


def test_stated_values_win(spark):
    given = {
        "source": "orchard_detail",
        "metrics": ["quantity", "revenue"],
        "dimensions": ["isrc", "artist", "gravadora"],
        "start": "2020-01-01",
        "filters": {"artist": "Ana", "revenue_type": "X", "gravadora": "Y"},
    }
    row = route(spark, ("royalties por editora ontem", given))[0]
    assert row.rota_metrics == ["quantity"] and row.rota_dimensions == ["isrc", "artist"]
    assert (row.rota_start_date, row.rota_end_date) == ("2020-01-01", None)
    assert row.rota_filters == {"artist": "Ana", "revenue_type": "X"}
    assert row.rota_notes == [V.NOTE_MONTHS, V.NOTE_DETAIL.replace("{source}", "orchard_detail")]


def test_fallbacks_and_notes(spark):
    rows = route(spark, ("royalties da obra", {"source": "omie_detail"}), "", None)
    assert rows[0].rota_metrics == ["revenue", "cost"] and rows[0].rota_dimensions == ["period"]
    for row in rows[1:]:
        assert row.rota_source == "royalty_performance"
        assert row.rota_metrics == V.DEFAULT_METRICS and row.rota_dimensions == ["artist"]
        assert row.rota_notes == [
            V.NOTE_SOURCE.replace("{source}", "royalty_performance"), V.NOTE_METRICS, V.NOTE_DIMENSIONS, V.NOTE_NO_RANGE,
        ]


def test_first_filter_value_wins_and_foreign_fields_go(spark):
    r = route(spark, "publicidade da editora na Warner Music e DSU", ("editora", {"source": "warner_music_detail"}))
    assert r[0].rota_filters == {"origem": "DSU", "revenue_type": "Editora"}
    assert r[1].rota_filters == {}


def test_every_route_is_allowed_by_its_source(spark):
    words = [w for group in (V.METRIC_WORDS, V.DIMENSION_WORDS, V.SOURCE_WORDS, V.PLATFORM_WORDS) for ws in group.values() for w in ws]
    questions = [f"{a} {b} {c}" for a, b, c in zip(words, words[7:] + words[:7], words[31:] + words[:31])]
    for row in route(spark, *questions):
        source = SOURCES[row.rota_source]
        assert row.rota_metrics and set(row.rota_metrics) <= set(source.metrics)
        assert row.rota_dimensions and set(row.rota_dimensions) <= set(source.dimensions)
        assert set(row.rota_filters) <= set(source.dimensions)


def test_today_is_the_default(spark):
    frame = spark.createDataFrame([("ontem",)], "texto string")
    row = route_questions(frame, "texto").select("rota_start_date", F.date_sub(F.current_date(), 1).alias("d")).first()
    assert row.rota_start_date == row.d.isoformat()


def test_mix(spark):
    frame = spark.createDataFrame([("royalties por artista",), ("royalties por mensal",), ("custo",)], "texto string")
    mix = {(r.fonte, r.tipo, r.chave): r.perguntas for r in routing_mix(route_questions(frame, "texto", TODAY)).collect()}
    assert mix[("royalty_performance", "source", "royalty_performance")] == 2
    assert mix[("royalty_performance", "metric", "royalties")] == 2
    assert mix[("royalty_performance", "dimension", "period")] == 1
    assert mix[("omie_detail", "metric", "cost")] == 1
    assert date.fromisoformat(TODAY) - timedelta(days=6) == date(2026, 6, 20)


def test_one_question_from_text_to_digest(spark):
    from decimal import Decimal

    from cantiga.plans.ask import ask
    from cantiga.sources.registry import Registry
    from cantiga.sources.relation import Relation

    fact = spark.createDataFrame(
        [("2026-06", "Ana", "Orchard", "N/D", Decimal(1), Decimal(5)), ("2026-06", "Bia", "Orchard", "N/D", Decimal(1), Decimal(9)),
         ("2026-05", "Ana", "Orchard", "N/D", Decimal(1), Decimal(70)), ("2026-06", "Ana", "DSU", "Shows", Decimal(1), Decimal(80))],
        "periodo string, artista string, plataforma_origem string, tipo_remuneracao string, quantidade decimal(18,4), "
        "valor_royalties decimal(18,4)",
    )
    registry = Registry({"royalty_performance": lambda: Relation(fact, ("public.fact",))})
    answer = ask(spark, registry, "Royalties da Orchard por artista hoje", TODAY, metrics=["royalties"])
    assert answer.request.filters == {"origem": "Orchard"} and answer.request.date_range == (TODAY, TODAY)
    assert answer.result.source_tables == ("public.fact",)
    assert [tuple(r) for r in answer.result.frame.collect()] == [("Ana", 5), ("Bia", 9)]
    assert tuple(answer.digest().leader.first()) == ("Bia", "royalties", "9,00")


def test_dropped_words_change_nothing(spark):
    from cantiga.plans.routing import _tags_of_words

    kept = _tags_of_words()
    groups = [V.METRIC_WORDS, V.DIMENSION_WORDS, V.SOURCE_WORDS]
    for group, tag in zip(groups, ("metric", "dimension", "source"), strict=True):
        for key, words in group.items():
            for word in words:
                said = {t for k, tags in kept.items() if k in word for t in tags}
                assert f"{tag} {key}" in said or not word.isascii()


def test_equal_questions_are_routed_once(spark):
    rows = [("Royalties por artista", None, {"origem": "Sony"}), ("Royalties por artista", None, {"origem": "Sony"}), ("Royalties por artista", "omie_detail", None), (None, None, None), (None, None, None)]
    frame = spark.createDataFrame(rows, "q string, s string, f map<string,string>")
    distinct = routing.distinct_questions(frame, "q", source="s", filters="f")
    assert sorted((r.q or "", r.s or "", r.f or {}, r.perguntas) for r in distinct.collect()) == [("", "", {}, 2), ("Royalties por artista", "", {"origem": "Sony"}, 2), ("Royalties por artista", "omie_detail", {}, 1)]
    mix = routing.question_mix(frame, "q", "2026-06-26", source="s", filters="f")
    plain = routing.routing_mix(routing.route_questions(frame, "q", "2026-06-26", source="s", filters="f"))
    assert sorted(mix.collect()) == sorted(plain.collect()) and mix.columns == plain.columns
    assert {(r.fonte, r.chave): r.perguntas for r in mix.collect()}[("royalty_performance", "royalty_performance")] == 4


#: Routes of the fixed sentences, written out: source, metrics, dimensions, start and end.
PINNED = {
    "Como foram quantidade e royalties por artista nos ultimos 7 dias?": ("royalty_performance", ["quantity", "royalties"], ["artist", "period"], "2026-06-20", "2026-06-26"),
    "Mostre royalties da Orchard por tipo de royalty": ("royalty_performance", ["royalties"], ["revenue_type"], None, None),
    "Quanto foi o custo em fevereiro?": ("omie_detail", ["cost"], ["artist"], None, None),
    "Quais faixas da Orchard mais tocaram por artista?": ("orchard_detail", ["quantity", "royalties"], ["artist", "track"], None, None),
    "Como foi a receita no ultimo ano?": ("omie_detail", None, None, "2025-06-27", "2026-06-26"),
}


def test_pinned_routes(spark):
    frame = spark.createDataFrame([(q,) for q in PINNED], "q string")
    for row in routing.route_questions(frame, "q", "2026-06-26").collect():
        source, metrics, dimensions, start, end = PINNED[row.q]
        assert row.rota_source == source, row
        assert metrics is None or sorted(row.rota_metrics) == sorted(metrics), row
        assert dimensions is None or sorted(row.rota_dimensions) == sorted(dimensions), row
        assert (row.rota_start_date, row.rota_end_date) == (start, end), row
