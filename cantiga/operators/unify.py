"""The five-platform royalty fact."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga.functions.money import money
from cantiga.functions.months import first_day, receipt_month
from cantiga.operators.matching import artist_lookup, artist_matches
from cantiga.sources.registry import gravadora_lookup
from cantiga.sources.relation import Relation

CONFIRMED = "CONFIRMADO"

BRANCH_COLUMNS = (
    "periodo",
    "artista_raw",
    "chave_artista",
    "plataforma_origem",
    "tipo_remuneracao",
    "quantidade",
    "valor_royalties",
    "tabela_origem",
    "razao_social",
    "dia",
)

FACT_COLUMNS = (
    "periodo",
    "periodo_receita",
    "artista",
    "artista_raw",
    "plataforma_origem",
    "tipo_remuneracao",
    "quantidade",
    "valor_royalties",
    "tabela_origem",
    "matched_artista_id",
    "matched_artista_keyword",
    "razao_social",
)


@dataclass(frozen=True)
class StatementTable:
    """Where a platform's statement table keeps what the fact needs."""

    platform: str
    table: str
    period: str
    artist: str
    key: str
    units: str
    value: str


# The statement tables of the union and their columns.
ORCHARD = StatementTable("Orchard", "ft_orchard_dados_analiticos", "periodo_relatorio", "artista_produto", "artista_produto", "quantidade", "valor_liquido_moeda_conta")
UNIVERSAL = StatementTable("Universal", "ft_universal_dados_analiticos", "data_extrato", "nome_conta", "codigo_musica", "unidades", "royalties_a_pagar")
WARNER_CHAPPELL = StatementTable("Warner Chappell", "stg_warner_statement", "data_extrato", "deal_scope_name", "deal_scope_name", "units", "amount_paid_less_tax")
WARNER_MUSIC = StatementTable("Warner Music", "ft_warner_music_dados_analiticos", "recdate_month_id", "artist_name", "artist_name", "sale_units", "royalty_payable")
STATEMENTS = (ORCHARD, UNIVERSAL, WARNER_CHAPPELL, WARNER_MUSIC)
RECORDING = "Gravadora"


def show_branch(contracts: DataFrame, day: str = "dt_show") -> DataFrame:
    """Confirmed contracts, one show each.  ``contracts`` must hold one row per contract.

    ``day`` names the column that a month range is compared with.
    """
    return contracts.where(F.col("status") == CONFIRMED).select(
        F.date_format("dt_show", "yyyy-MM").alias("periodo"),
        F.col("artista").alias("artista_raw"),
        F.col("artista").alias("chave_artista"),
        F.lit("DSU").alias("plataforma_origem"),
        F.lit("Shows").alias("tipo_remuneracao"),
        money(F.lit(1)).alias("quantidade"),
        money(F.col("valor_liquido")).alias("valor_royalties"),
        F.lit("ft_dsu_dados_analiticos").alias("tabela_origem"),
        "razao_social",
        F.col(day).cast("date").alias("dia"),
    )


def branch_of(
    lines: DataFrame, *, platform: Column, table: Column, month: Column, artist: Column, key: Column, kind: Column,
    units: Column, value: Column, company: Column, day: Column,
) -> DataFrame:
    """Statement lines in the columns of the union; nothing is merged or dropped."""
    return lines.select(
        month.alias("periodo"),
        artist.alias("artista_raw"),
        key.cast("string").alias("chave_artista"),
        platform.alias("plataforma_origem"),
        kind.alias("tipo_remuneracao"),
        money(units).alias("quantidade"),
        money(value).alias("valor_royalties"),
        table.alias("tabela_origem"),
        company.alias("razao_social"),
        day.cast("date").alias("dia"),
    )


def statement_branch(lines: DataFrame, of: StatementTable, day: str | None = None) -> DataFrame:
    """The branch of one platform's table.

    ``day`` names a date column the month comes from, so that a month range can
    skip row groups; without it the first day of the month stands in.  A table
    without its own kind of revenue holds recordings; one without a company
    leaves it null.
    """
    has = set(lines.columns)
    return branch_of(
        lines,
        platform=F.lit(of.platform),
        table=F.lit(of.table),
        month=F.col(of.period),
        artist=F.col(of.artist),
        key=F.col(of.key),
        kind=F.col("tipo_remuneracao") if "tipo_remuneracao" in has else F.lit(RECORDING),
        units=F.col(of.units),
        value=F.col(of.value),
        company=F.col("razao_social") if "razao_social" in has else F.lit(None).cast("string"),
        day=F.col(day) if day else first_day(F.col(of.period)),
    )


def unify(*branches: DataFrame) -> DataFrame:
    """All branches below each other with their expected receipt month.

    Rows are neither merged nor dropped: two equal statement lines are two lines.
    In a branch without ``dia`` the first day of the month stands in.
    """
    dated = [b if "dia" in b.columns else b.withColumn("dia", first_day(F.col("periodo"))) for b in branches]
    stacked = reduce(lambda a, b: a.unionByName(b), [b.select(*BRANCH_COLUMNS) for b in dated])
    return stacked.withColumn("periodo_receita", receipt_month(F.col("periodo"), F.col("plataforma_origem")))


def royalty_relation(branches: Sequence[DataFrame], matches: Callable[[], DataFrame], artists: Callable[[], DataFrame]) -> Relation:
    """The fact over its branches, with artist and label looked up where they are asked for."""
    lookups = (artist_lookup(matches), gravadora_lookup(artists))
    return Relation(unify(*branches), ("public.vw_ft_dados_analiticos_union",), lookups, (("periodo", "dia"),))


def build_royalty_fact(contracts: DataFrame, statements: Mapping[StatementTable, DataFrame], artists: DataFrame, tracks: DataFrame) -> Relation:
    """The five-platform fact from raw tables.

    ``contracts``: one row per contract (``build_contracts``); ``statements``: the
    table of each platform there is; ``artists`` and ``tracks``: the register and
    the track list.  ``relation.columns(*FACT_COLUMNS)`` is the full table.
    """
    branches = [show_branch(contracts), *[statement_branch(lines, of) for of, lines in statements.items()]]
    names = statements[ORCHARD].select(F.col(ORCHARD.artist).alias("nome")) if ORCHARD in statements else artists.limit(0).select(F.col("nome_artistico").alias("nome"))
    return royalty_relation(branches, lambda: artist_matches(artists, names, tracks), lambda: artists)
