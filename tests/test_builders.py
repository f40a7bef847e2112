"""The datasets from raw tables, one frame per branch."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cantiga.operators.calendar import build_calendar
from cantiga.operators.contracts import build_contracts
from cantiga.operators.statements import UNIVERSAL_LINES, build_universal_lines, universal_lines
from cantiga.operators.unify import FACT_COLUMNS, ORCHARD, STATEMENTS, UNIVERSAL, WARNER_CHAPPELL, WARNER_MUSIC, build_royalty_fact, statement_branch
from cantiga.operators.matching import artist_matches
from cantiga.session import size_shuffles

REGISTER = (
    "id int, nome_artistico string, gravadora string, artista_keyword string, dsu_artista string, universal_compositor string, "
    "warner_chappel_deal_scope_name array<string>, warner_music_artist_name string"
)


@pytest.fixture(scope="module")
def artists(spark):
    return spark.createDataFrame(
        [(1, "Ana", "Label", "ANA", "1 - Ana", "Comp", ["Ana Scope", "ANA"], "ANA M"), (2, "Bia", None, None, None, None, None, None), (3, "Ana dois", None, "ANA", None, "Comp", None, None)],
        REGISTER,
    )


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame([("t1", "Song", "Comp"), ("t2", "Other", None)], "codigo_musica string, titulo_da_musica string, compositor string")


@pytest.fixture(scope="module")
def contracts(spark):
    rows = [
        (1, "c1", datetime(2026, 1, 1), date(2026, 1, 2), "1 - Ana", "CANCELADO/REMARCAR", 100.0, 10.0, "X"),
        (2, "c1", datetime(2026, 1, 5), date(2026, 1, 2), "1 - Ana", "CONFIRMADO", 100.0, 25.5, "X"),
        (3, "c2", datetime(2026, 1, 5), date(2026, 1, 5), "9 - Zed", "FINANCEIRO/AGUARDAR", 50.0, 0.0, "X"),
        (4, "c3", datetime(2026, 1, 5), None, "9 - Zed", "CONFIRMADO", 50.0, None, None),
    ]
    raw = spark.createDataFrame(rows, "id int, contrato string, inserted_at timestamp, dt_show date, artista string, status string, valor double, falta_receber double, razao_social string")
    span = spark.range(1).select(F.lit("2026-01-01").cast("date").alias("inicio"), F.lit("2026-12-31").cast("date").alias("fim"))
    return build_contracts(raw, build_calendar(span))


def test_contracts_are_the_latest_rows_with_net_value_and_calendar(contracts):
    got = {r.contrato: (r.id, r.valor_liquido, r.dia_critico) for r in contracts.collect()}
    assert got == {"c1": (2, Decimal("74.5"), True), "c2": (3, Decimal("50"), False), "c3": (4, None, None)}


def frames(spark):
    return {
        ORCHARD: spark.createDataFrame([("2026-01", "mc ana live", 5, 1.5), ("2026-01", "mc ana live", 5, 1.5), ("2026-02", None, -1, -0.5)], "periodo_relatorio string, artista_produto string, quantidade int, valor_liquido_moeda_conta double"),
        UNIVERSAL: spark.createDataFrame([("2026-01", "acc", "t1", 7, 2.0, "Co"), ("bad", "acc", "t2", 1, 1.0, None)], "data_extrato string, nome_conta string, codigo_musica string, unidades int, royalties_a_pagar double, razao_social string"),
        WARNER_CHAPPELL: spark.createDataFrame([("2026-03", "ANA", 2, 3.0, "Editora")], "data_extrato string, deal_scope_name string, units int, amount_paid_less_tax double, tipo_remuneracao string"),
        WARNER_MUSIC: spark.createDataFrame([("2026-12", "ANA M", 2, 4.0), ("2026-12", "Nobody", 0, 0.0)], "recdate_month_id string, artist_name string, sale_units int, royalty_payable double"),
    }


def test_fact_of_five_platforms(spark, artists, tracks, contracts):
    fact = build_royalty_fact(contracts, frames(spark), artists, tracks)
    rows = fact.columns(*FACT_COLUMNS).collect()
    assert len(rows) == 10, "equal lines stay, unconfirmed shows do not come in"
    got = {(r.plataforma_origem, r.artista_raw, r.periodo): (r.artista, r.periodo_receita, r.tipo_remuneracao, float(r.valor_royalties) if r.valor_royalties is not None else None, r.razao_social, r.tabela_origem) for r in rows}
    assert got == {
        ("DSU", "1 - Ana", "2026-01"): ("Ana", "2026-01", "Shows", 74.5, "X", "ft_dsu_dados_analiticos"),
        ("DSU", "9 - Zed", None): ("9 - Zed", None, "Shows", None, None, "ft_dsu_dados_analiticos"),
        ("Orchard", "mc ana live", "2026-01"): ("Ana", "2026-04", "Gravadora", 1.5, None, "ft_orchard_dados_analiticos"),
        ("Orchard", None, "2026-02"): (None, "2026-05", "Gravadora", -0.5, None, "ft_orchard_dados_analiticos"),
        ("Universal", "acc", "2026-01"): ("Ana", "2026-04", "Gravadora", 2.0, "Co", "ft_universal_dados_analiticos"),
        ("Universal", "acc", "bad"): ("acc", None, "Gravadora", 1.0, None, "ft_universal_dados_analiticos"),
        ("Warner Chappell", "ANA", "2026-03"): ("Ana", "2026-06", "Editora", 3.0, None, "stg_warner_statement"),
        ("Warner Music", "ANA M", "2026-12"): ("Ana", "2027-03", "Gravadora", 4.0, None, "ft_warner_music_dados_analiticos"),
        ("Warner Music", "Nobody", "2026-12"): ("Nobody", "2027-03", "Gravadora", 0.0, None, "ft_warner_music_dados_analiticos"),
    }


def test_branch_of_each_table(spark):
    for of, frame in frames(spark).items():
        branch = statement_branch(frame, of)
        assert branch.count() == frame.count() and {r.plataforma_origem for r in branch.collect()} == {of.platform}
        assert statement_branch(frame.limit(0), of).count() == 0
    assert len(STATEMENTS) == 4


def test_universal_lines_from_raw_tables(spark, artists, tracks):
    lines = spark.createDataFrame([("2026-01", "acc", "t1", "G", "F", "P", "T", 3, 1.0), ("2026-01", "acc", "t9", None, "x", "P", "T", 3, 1.0)], "data_extrato string, nome_conta string, codigo_musica string, codigo_grupo_renda string, codigo_fonte string, plataforma string, tipo_receita string, unidades int, royalties_a_pagar double")
    media = spark.createDataFrame([("G", "Digital"), ("G", "Fisico")], "codigo_grupo_renda string, media string")
    channels = spark.createDataFrame([("F", "Radio")], "codigo_fonte string, canal string")
    matches = artist_matches(artists, artists.limit(0).select(F.col("nome_artistico").alias("nome")), tracks)
    rows = universal_lines(build_universal_lines(lines, tracks, media, channels, matches)).collect()
    assert rows[0].__fields__ == UNIVERSAL_LINES
    assert {(r.codigo_musica, r.media, r.canal, r.titulo_musica, r.compositor, r.artist) for r in rows} == {("t1", "Digital", "Radio", "Song", "Comp", "Ana"), ("t9", None, None, None, None, "acc")}


def test_shuffles_start_with_a_partition_per_share_of_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(key, None)
    try:
        assert size_shuffles(spark, spark.range(1 << 20), bytes_per_partition=1 << 10) == 8192
        assert size_shuffles(spark, spark.range(1)) == 8192, "never fewer than before"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
