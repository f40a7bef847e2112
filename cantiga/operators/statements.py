"""Shapes of the statement tables other tools read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantiga.operators.matching import artist_lookup
from cantiga.sources.relation import Lookup, Relation, left_lookup

# Column lists, in order, and the width of the short creator names.
SIMPLE_STATEMENT = [
    "id", "data_extrato", "source_territory_name", "tango_income_type_name", "descricao_canal", "source_work_id",
    "tango_work_code", "tango_work_title", "creator_names", "units", "amount_paid_less_tax",
]
STATEMENT_SUBSET = [
    "id", "data_extrato", "statement_id", "source_territory_name", "source_income_type", "tango_income_type_name",
    "income_provider_name", "exploitation_source", "product_description", "source_work_id", "tango_work_code",
    "tango_work_title", "creator_names", "composer", "units", "amount_received", "rate_percentage", "amount_paid",
    "tax_rate", "withholding_tax", "amount_paid_less_tax", "row_hash", "inserted_at",
]
SHOW_VIEW = [
    "id", "dt_cadastro", "contrato", "artista", "uf", "cidade", "local", "dt_show", "status", "valor",
    "falta_receber", "valor_liquido", "periodo", "source_file",
]
CREATOR_NAMES_WIDTH = 50

UNIVERSAL_LINES = [
    "data_extrato", "media", "canal", "codigo_musica", "titulo_musica", "compositor", "plataforma", "tipo_receita",
    "unidades", "royalties_a_pagar", "matched_artista_id", "artist",
]


def simple_statement(statement: Relation) -> DataFrame:
    """The 11-column statement: channel resolved, creator names cut to their column width."""
    return statement.columns(*SIMPLE_STATEMENT).withColumn(
        "creator_names", F.substring("creator_names", 1, CREATOR_NAMES_WIDTH)
    )


def statement_subset(statement: Relation) -> DataFrame:
    """The 23 columns that older readers of the statement know."""
    return statement.columns(*STATEMENT_SUBSET)


def show_view(contracts: Relation) -> DataFrame:
    """The 14 columns of the older show view, over the contracts without repeats."""
    columns = [c for c in SHOW_VIEW if c != "periodo"]
    return (
        contracts.columns(*columns)
        .withColumn("periodo", F.date_format("dt_show", "yyyy-MM"))
        .select(*SHOW_VIEW)
    )


def universal_lookups(
    tracks: Callable[[], DataFrame], media: Callable[[], DataFrame], channels: Callable[[], DataFrame], matches: Callable[[], DataFrame]
) -> tuple[Lookup, ...]:
    """Track and composer by track code, medium by income group, channel by source, artist by the track's composer."""
    return (
        left_lookup(["codigo_musica"], ["titulo_musica", "compositor"], lambda: tracks().withColumnRenamed("titulo_da_musica", "titulo_musica")),
        left_lookup(["codigo_grupo_renda"], ["media"], media),
        left_lookup(["codigo_fonte"], ["canal"], channels),
        artist_lookup(matches, name="artist"),
    )


def build_universal_lines(
    lines: DataFrame, tracks: DataFrame, media: DataFrame, channels: DataFrame, matches: DataFrame, raw_artist: str = "nome_conta"
) -> Relation:
    """Universal statement lines from raw tables, with what other tables know of them."""
    base = lines.withColumns(
        {"artista_raw": F.col(raw_artist), "chave_artista": F.col("codigo_musica"), "plataforma_origem": F.lit("Universal")}
    )
    return Relation(base, ("public.ft_universal_dados_analiticos",), universal_lookups(lambda: tracks, lambda: media, lambda: channels, lambda: matches))


def universal_lines(lines: Relation) -> DataFrame:
    """Universal lines with track, composer, medium, channel and matched artist."""
    return lines.columns(*UNIVERSAL_LINES)
