"""The approved sources with their metrics and dimensions.

A metric is a row value plus a way to add it up, so that it can be summed
before a join and again after it.  A dimension is a column expression plus the
columns it reads, so that a query joins only the lookups it needs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cantiga.functions.money import money
from cantiga.functions.months import month_of

VERSION = "v2"


@dataclass(frozen=True)
class Metric:
    key: str
    label: str
    value: Callable[[], Column]
    inputs: tuple[str, ...] = ()
    description: str | None = None

    def first_sum(self) -> Column:
        return F.sum(self.value())

    @property
    def counts_rows(self) -> bool:
        return not self.inputs


@dataclass(frozen=True)
class Dimension:
    key: str
    label: str
    value: Callable[[], Column]
    inputs: tuple[str, ...]
    description: str | None = None
    day: str | None = None
    """Date column a month is derived from, for scans that can skip by date."""


@dataclass(frozen=True)
class Source:
    name: str
    description: str
    table: str
    metrics: dict[str, Metric] = field(default_factory=dict)
    dimensions: dict[str, Dimension] = field(default_factory=dict)
    default: bool = False


def _sum(key: str, label: str, column: str, description: str | None = None, exact: bool = True) -> Metric:
    def value() -> Column:
        return money(F.col(column)) if exact else F.col(column)

    return Metric(key, label, value, (column,), description)


def _units(key: str, label: str, column: str) -> Metric:
    return _sum(key, label, column, exact=False)


def _dim(key: str, label: str, column: str | None = None, description: str | None = None) -> Dimension:
    name = column or key
    return Dimension(key, label, lambda: F.col(name), (name,), description)


def _month_dim(key: str, label: str, day: str, description: str | None = None) -> Dimension:
    return Dimension(key, label, lambda: month_of(F.col(day)), (day,), description, day=day)


def _source(name: str, table: str, description: str, metrics: list[Metric], dimensions: list[Dimension],
            default: bool = False) -> Source:
    return Source(name, description, table, {m.key: m for m in metrics}, {d.key: d for d in dimensions}, default)


def _positive_part() -> Column:
    value = money(F.col("valor_liquido"))
    return F.when(value >= 0, value).otherwise(F.lit(0))


def _negative_part() -> Column:
    value = money(F.col("valor_liquido"))
    return F.when(value <= 0, -value).otherwise(F.lit(0))


# Keys, labels, column names and table names are what callers use.
SOURCES: dict[str, Source] = {
    s.name: s
    for s in [
        _source(
            "royalty_performance",
            "public.vw_ft_dados_analiticos_union",
            "Royalties of the five platforms by artist, month, origin and type. Without the ledger and without tracks.",
            [
                _sum("quantity", "Quantidade", "quantidade", "Streams, units or shows, depending on the origin."),
                _sum("royalties", "Royalties", "valor_royalties", "Never to be added to ledger revenue or cost."),
            ],
            [
                _dim("period", "Periodo", "periodo", "Month, yyyy-MM."),
                _dim("artist", "Artista", "artista", "Registered artist name, raw name where nothing matched."),
                _dim("origem", "Origem", "plataforma_origem", "Platform the row came from."),
                _dim("revenue_type", "Tipo de royalty", "tipo_remuneracao"),
                _dim("gravadora", "Gravadora", "gravadora", "Label of the matched artist; null where none is known."),
            ],
            default=True,
        ),
        _source(
            "dsu_detail",
            "public.vw_dsu_contratos_calendario",
            "Live-show contracts, one row per contract.",
            [
                _sum("royalties", "Royalties", "valor_liquido"),
                Metric("shows", "Shows", lambda: F.lit(1), (), "Number of contracts."),
            ],
            [
                _month_dim("period", "Periodo", "dt_show"),
                _dim("artist", "Artista", "artista", "Raw name, not matched to the register."),
                _dim("territory", "UF", "uf"),
                _dim("city", "Cidade", "cidade"),
                _dim("venue", "Local", "local"),
                _dim("status", "Status", "status"),
                _dim("contratante", "Contratante", "contratante"),
                _dim("vendedor", "Vendedor", "vendedor"),
                _dim("tipo_evento", "Tipo de evento", "tipo_evento"),
                _dim("dia_critico", "Dia critico", "dia_critico", "Best nights for a show; null outside the calendar."),
            ],
        ),
        _source(
            "omie_detail",
            "public.ft_omie_dados_analiticos",
            "Ledger entries of active groups. Finance, not royalties.",
            [
                Metric("revenue", "Receita", _positive_part, ("valor_liquido",), "Sum of the positive entries."),
                Metric("cost", "Custo", _negative_part, ("valor_liquido",), "Sum of the negative entries, sign removed."),
                _sum("resultado", "Resultado", "valor_liquido", "Revenue less cost."),
                _sum("payable", "A pagar/receber", "a_pagar_ou_receber"),
            ],
            [
                _month_dim("period", "Periodo", "data_de_vencimento", "Month of the due date."),
                _dim("artist", "Projeto (proxy de artista)", "projeto", "Project; not matched to the register."),
                _dim("category", "Categoria", "categoria"),
                _dim("type", "Tipo", "tipo"),
            ],
        ),
        _source(
            "orchard_detail",
            "public.ft_orchard_dados_analiticos",
            "Digital plays by track, code and country.",
            [
                _sum("royalties", "Royalties", "valor_liquido_moeda_conta"),
                _units("quantity", "Quantidade", "quantidade"),
            ],
            [
                _dim("period", "Periodo", "periodo_relatorio"),
                _dim("artist", "Artista"),
                _dim("track", "Faixa", "titulo_musica"),
                _dim("isrc", "ISRC"),
                _dim("territory", "Territorio", "pais"),
                _dim("platform", "Plataforma", "plataforma"),
                _dim("revenue_type", "Tipo de royalty", "tipo_receita"),
            ],
        ),
        _source(
            "somlivre_detail",
            "public.ft_somlivre_sonymusic",
            "Digital plays by track. Not part of royalty_performance.",
            [
                _sum("royalties", "Royalty liquido", "royalty_liquido"),
                _units("quantity", "Quantidade", "unidades_de_pagamento"),
            ],
            [
                _dim("period", "Periodo", "data_extrato"),
                _dim("artist", "Artista", "artista_da_faixa", "Raw name, not matched to the register."),
                _dim("track", "Faixa", "nome_da_faixa"),
                _dim("platform", "Plataforma", "plataforma"),
            ],
        ),
        _source(
            "universal_detail",
            "public.ft_universal_dados_analiticos",
            "Digital plays by track and composer.",
            [
                _sum("royalties", "Royalties a pagar", "royalties_a_pagar"),
                _units("quantity", "Unidades", "unidades"),
            ],
            [
                _dim("period", "Periodo", "data_extrato"),
                _dim("artist", "Artista"),
                _dim("track", "Faixa", "titulo_musica"),
                _dim("composer", "Compositor", "compositor"),
                _dim("platform", "Plataforma", "plataforma"),
                _dim("revenue_type", "Tipo de royalty", "tipo_receita"),
            ],
        ),
        _source(
            "warner_chappell_detail",
            "warner_chappell.stg_warner_statement",
            "Publishing statement by work, composer and territory.",
            [
                _sum("royalties", "Valor pago (liquido de impostos)", "amount_paid_less_tax"),
                _units("quantity", "Quantidade", "units"),
            ],
            [
                _dim("period", "Periodo", "data_extrato"),
                _dim("artist", "Criadores", "creator_names", "May hold several names; they are not split."),
                _dim("track", "Obra", "tango_work_title"),
                _dim("composer", "Compositor", "composer"),
                _dim("territory", "Territorio", "source_territory_name"),
                _dim("platform", "Plataforma/canal", "descricao_canal", "Channel looked up by provider and source."),
                _dim("revenue_type", "Tipo de royalty", "tango_income_type_name"),
            ],
        ),
        _source(
            "warner_music_detail",
            "public.ft_warner_music_dados_analiticos",
            "Digital plays by track, code, service and country.",
            [
                _sum("royalties", "Royalty a pagar", "royalty_payable"),
                _units("quantity", "Unidades vendidas", "sale_units"),
            ],
            [
                _dim("period", "Periodo", "recdate_month_id", "Month of receipt."),
                _dim("artist", "Artista", "artist_name", "Raw name, not matched to the register."),
                _dim("track", "Faixa", "tune_title"),
                _dim("isrc", "ISRC"),
                _dim("territory", "Territorio", "country"),
                _dim("platform", "DSP", "digital_service_provider_dsp"),
            ],
        ),
    ]
}

# Registered for lookups; no metric query may name them.
LOOKUP_TABLES = {
    "universal_musica": "universal.dim_musica",
    "universal_compositor": "universal.dim_compositor",
    "dim_artistas": "public.dim_artistas",
}

APPROVED_SOURCES = tuple(SOURCES)
DEFAULT_SOURCE = next((s.name for s in SOURCES.values() if s.default), APPROVED_SOURCES[0])


def approved_source(name: str | None) -> Source:
    """The named source, the default one for None."""
    chosen = name or DEFAULT_SOURCE
    if chosen not in SOURCES:
        raise ValueError(f"Source not approved: {chosen}")
    return SOURCES[chosen]


def check_keys(source: Source, metrics: list[str], dimensions: list[str]) -> None:
    """Refuse keys the source does not declare, naming all of them."""
    for kind, asked, known in (("Metrics", metrics, source.metrics), ("Dimensions", dimensions, source.dimensions)):
        foreign = [key for key in asked if key not in known]
        if foreign:
            raise ValueError(f"{kind} not approved for source '{source.name}': {', '.join(foreign)}")
