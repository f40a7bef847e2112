"""The domain tables derived from an order star schema plus an event table.

The engine itself knows nothing of this module: it makes every domain table,
with its own column names, out of ``region nation customer supplier part
orders lineitem events``.  See FIXTURES.md for the mapping.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiga.functions.money import money
from cantiga.functions.months import month_of
from cantiga.operators.calendar import build_calendar, calendar_lookup
from cantiga.operators.contracts import latest_contracts, net_value
from cantiga.operators.ledger import active_ledger
from cantiga.operators.matching import artist_lookup, artist_matches
from cantiga.operators.statements import universal_lookups
from cantiga.operators.unify import BRANCH_COLUMNS, STATEMENTS, branch_of, royalty_relation, show_branch
from cantiga.sources.registry import PHYSICAL_TABLES, Registry, channel_lookup
from cantiga.sources.relation import Lookup, Relation, constant_table, join_to_sums, left_lookup

CALENDAR_SPAN = ("1998-01-01", "1999-12-31")

# Platform of a region's customers.
PLATFORM_OF_REGION = {
    "AFRICA": "DSU",
    "AMERICA": "Orchard",
    "ASIA": "Universal",
    "EUROPE": "Warner Chappell",
    "MIDDLE EAST": "Warner Music",
}
REGION_OF_PLATFORM = {platform: region for region, platform in PLATFORM_OF_REGION.items()}
LINEAGE = {statement.platform: statement.table for statement in STATEMENTS}
STATUS = {"R": "CONFIRMADO", "N": "FINANCEIRO/AGUARDAR", "A": "CANCELADO/REMARCAR"}
ROYALTY_TYPE = {"A": "Editora", "N": "Gravadora", "R": "Publicidade"}

# (income_provider_name, exploitation_source, descricao_canal); two pairs are unknown, one is listed twice.
CHANNELS = [
    ("A", "F", "Radio"),
    ("A", "O", "Spotify"),
    ("N", "F", "TV"),
    ("R", "O", "Youtube"),
    ("R", "O", "Youtube Music"),
]
# (tipo, grupo, ativo); a group listed under both types lets its entries through once.
GROUPS = [
    ("Contas a receber", "purchase", True),
    ("Contas a receber", "signup", True),
    ("Contas a pagar", "error", True),
    ("Contas a receber", "error", True),
    ("Contas a pagar", "click", True),
    ("Contas a pagar", "view", False),
]
# (tipo, grupo, categoria) known to the reference list; 'error' is in use but not listed.
CATEGORIES = [
    ("Contas a receber", "purchase", "purchase"),
    ("Contas a receber", "signup", "signup"),
    ("Contas a pagar", "click", "click"),
    ("Contas a pagar", "view", "view"),
]
MEDIA = [("F", "Fisico"), ("O", "Digital")]
CHANNEL_OF_SOURCE = [("A", "Assinatura"), ("R", "Radio")]

QUOTED_TITLE = "Sol d'Ouro"

# Columns that order the status rows of a contract; together they tell any two rows apart.
STATUS_ORDER = ["inserted_at", "id", "l_partkey", "l_suppkey", "valor"]


def _choose(column: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), column)


def _digits(key: str, width: int) -> Column:
    return F.lpad(F.col(key).cast("string"), width, "0")


class StarSchema:
    """Domain tables over the parquet files of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def read(self, table: str) -> DataFrame:
        if table not in self._tables:
            self._tables[table] = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._tables[table]

    def _inline(self, rows: list[tuple], schema: str) -> DataFrame:
        return constant_table(self.spark, rows, schema)

    # ---- dimension tables -------------------------------------------------

    @cached_property
    def artists(self) -> DataFrame:
        key, name = F.col("c_custkey"), F.col("c_name")
        keyword = F.when(key % 50 == 0, F.upper(name)).when(key % 20 == 0, F.upper(F.substring(name, 1, 17)))
        return self.read("customer").select(
            key.alias("id"),
            name.alias("nome_artistico"),
            F.when(key % 20 == 0, F.col("c_mktsegment")).alias("gravadora"),
            keyword.alias("artista_keyword"),
            F.when(key % 3 != 0, self._show_artist()).alias("dsu_artista"),
            F.when(key % 40 == 0, F.concat(F.lit("Brand#"), (F.floor(key / 40) % 25 + 1).cast("string"))).alias(
                "universal_compositor"
            ),
            F.when(key % 4 == 0, F.array(name, F.upper(name))).alias("warner_chappel_deal_scope_name"),
            F.when(key % 5 == 0, F.upper(name)).alias("warner_music_artist_name"),
        )

    @staticmethod
    def _show_artist() -> Column:
        return F.concat(_digits("c_custkey", 6), F.lit(" - "), F.col("c_name"))

    @cached_property
    def tracks(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("musica_id"),
            F.col("p_partkey").cast("string").alias("codigo_musica"),
            F.col("p_name").alias("titulo_da_musica"),
            F.col("p_brand").alias("compositor"),
        )

    @cached_property
    def composers(self) -> DataFrame:
        return self.tracks.select(F.col("compositor").alias("nome_compositor")).distinct()

    @cached_property
    def channels(self) -> DataFrame:
        return self._inline(
            CHANNELS, "income_provider_name string, exploitation_source string, descricao_canal string"
        )

    @cached_property
    def groups(self) -> DataFrame:
        return self._inline(GROUPS, "tipo string, grupo string, ativo boolean")

    @cached_property
    def categories(self) -> DataFrame:
        return self._inline(CATEGORIES, "tipo string, grupo string, categoria string")

    @cached_property
    def calendar(self) -> DataFrame:
        first, last = CALENDAR_SPAN
        span = self.spark.range(1).select(
            F.lit(first).cast("date").alias("inicio"), F.lit(last).cast("date").alias("fim")
        )
        return build_calendar(span)

    @cached_property
    def matches(self) -> DataFrame:
        """Artist matches; the names to search are those of the region's customers."""
        names = self.customers.where(F.col("r_name") == REGION_OF_PLATFORM["Orchard"]).select(
            F.col("c_name").alias("nome")
        )
        return artist_matches(self.artists, names, self.tracks)

    # ---- facts ------------------------------------------------------------

    @cached_property
    def customers(self) -> DataFrame:
        return (
            self.read("customer")
            .join(self.read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
        )

    def lines(self, *regions: str) -> DataFrame:
        """Statement lines of the customers of some regions."""
        customers = self.customers.where(F.col("r_name").isin(*regions))
        orders = self.read("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
        value = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return (
            self.read("lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumns(
                {
                    "__month": month_of(F.col("l_shipdate")),
                    "__isrc": F.concat(F.lit("BR"), _digits("l_partkey", 10)),
                    "__units": F.col("l_quantity").cast("int"),
                    "__value": money(value),
                }
            )
        )

    def _part_lookup(self, title: str | None, **columns: str) -> Lookup:
        """Track attributes by part; every 170th title arrived corrupted, and every 190th track is one with a quote."""
        wanted = {alias: F.col(column) for alias, column in columns.items()}
        if title:
            corrupted = F.repeat(F.lit("?"), F.length("p_name"))
            quoted = F.when(F.col("p_partkey") % 190 == 0, QUOTED_TITLE).otherwise(F.col("p_name"))
            wanted[title] = F.when(F.col("p_partkey") % 170 == 0, corrupted).otherwise(quoted)

        def parts() -> DataFrame:
            return self.read("part").select(
                F.col("p_partkey").alias("l_partkey"), *[c.alias(a) for a, c in wanted.items()]
            )

        return left_lookup(["l_partkey"], list(wanted), parts)

    @cached_property
    def orchard(self) -> Relation:
        base = self.lines(REGION_OF_PLATFORM["Orchard"]).select(
            "l_shipdate",
            "l_partkey",
            F.col("__month").alias("periodo_relatorio"),
            F.col("c_name").alias("artista_produto"),
            F.col("c_name").alias("artista_raw"),
            F.col("c_name").alias("chave_artista"),
            F.lit("Orchard").alias("plataforma_origem"),
            F.col("__isrc").alias("isrc"),
            F.col("n_name").alias("pais"),
            F.col("l_returnflag").alias("tipo_receita"),
            F.col("__units").alias("quantidade"),
            F.col("__value").alias("valor_liquido_moeda_conta"),
        )
        lookups = (
            self._part_lookup("titulo_musica", plataforma="p_brand"),
            artist_lookup(lambda: self.matches, name="artist"),
        )
        return Relation(base, ("public.ft_orchard_dados_analiticos",), lookups, (("periodo_relatorio", "l_shipdate"),))

    @cached_property
    def universal(self) -> Relation:
        base = self.lines(REGION_OF_PLATFORM["Universal"]).select(
            "l_shipdate",
            "l_partkey",
            F.col("__month").alias("data_extrato"),
            F.col("l_partkey").cast("string").alias("codigo_musica"),
            F.col("l_partkey").cast("string").alias("chave_artista"),
            F.col("c_name").alias("artista_raw"),
            F.lit("Universal").alias("plataforma_origem"),
            F.col("l_returnflag").alias("tipo_receita"),
            F.col("l_linestatus").alias("codigo_grupo_renda"),
            F.col("l_returnflag").alias("codigo_fonte"),
            F.col("__units").alias("unidades"),
            F.col("__value").alias("royalties_a_pagar"),
        )
        lookups = (
            self._part_lookup(None, plataforma="p_type"),
            *universal_lookups(
                lambda: self.tracks,
                lambda: self._inline(MEDIA, "codigo_grupo_renda string, media string"),
                lambda: self._inline(CHANNEL_OF_SOURCE, "codigo_fonte string, canal string"),
                lambda: self.matches,
            ),
        )
        return Relation(base, ("public.ft_universal_dados_analiticos",), lookups, (("data_extrato", "l_shipdate"),))

    @cached_property
    def chappell(self) -> Relation:
        price, rate, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        base = self.lines(REGION_OF_PLATFORM["Warner Chappell"]).select(
            "l_shipdate",
            "l_partkey",
            "l_suppkey",
            F.col("l_orderkey").alias("id"),
            F.col("__month").alias("data_extrato"),
            F.col("c_custkey").cast("string").alias("deal_scope_id"),
            F.col("c_name").alias("deal_scope_name"),
            F.col("l_orderkey").cast("string").alias("statement_id"),
            F.col("l_linestatus").alias("source_income_type"),
            F.col("l_returnflag").alias("tango_income_type_name"),
            F.col("l_returnflag").alias("income_provider_name"),
            F.col("l_linestatus").alias("exploitation_source"),
            F.col("n_name").alias("source_territory_name"),
            F.col("o_orderpriority").alias("product_description"),
            F.col("l_partkey").cast("string").alias("source_work_id"),
            F.col("__isrc").alias("tango_work_code"),
            F.col("__units").alias("units"),
            money(price).alias("amount_received"),
            money(rate).alias("rate_percentage"),
            F.col("__value").alias("amount_paid"),
            money(tax).alias("tax_rate"),
            money(F.lit(0)).alias("withholding_tax"),
            F.col("__value").alias("amount_paid_less_tax"),
            F.concat(F.lit("statement_"), F.col("l_orderkey").cast("string")).alias("source_file"),
            F.col("l_linenumber").alias("line_number"),
            F.md5(
                F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").cast("binary")
            ).alias("row_hash"),
            F.col("l_shipdate").alias("inserted_at"),
        )

        def suppliers() -> DataFrame:
            return self.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("composer"))

        def creators(frame: DataFrame) -> DataFrame:
            return frame.withColumn("creator_names", F.concat("deal_scope_name", F.lit(" / "), "composer"))

        lookups = (
            self._part_lookup("tango_work_title"),
            left_lookup(["l_suppkey"], ["composer"], suppliers),
            Lookup(("deal_scope_name", "composer"), ("creator_names",), creators),
            channel_lookup(lambda: self.channels),
        )
        return Relation(base, ("warner_chappell.stg_warner_statement",), lookups, (("data_extrato", "l_shipdate"),))

    @cached_property
    def warner_music(self) -> Relation:
        base = self.lines(REGION_OF_PLATFORM["Warner Music"]).select(
            "l_shipdate",
            "l_partkey",
            F.col("__month").alias("recdate_month_id"),
            month_of(F.col("o_orderdate")).alias("repdate_month_id"),
            F.upper("c_name").alias("artist_name"),
            F.col("__isrc").alias("isrc"),
            F.col("n_name").alias("country"),
            F.col("__units").alias("sale_units"),
            F.col("__value").alias("royalty_payable"),
            F.col("l_orderkey").alias("source_file"),
            F.col("l_linenumber").alias("line_number"),
        )
        lookups = (self._part_lookup("tune_title", digital_service_provider_dsp="p_brand"),)
        return Relation(
            base, ("public.ft_warner_music_dados_analiticos",), lookups, (("recdate_month_id", "l_shipdate"),)
        )

    @cached_property
    def som_livre(self) -> Relation:
        base = self.read("events").select(
            "ts",
            month_of(F.col("ts")).alias("data_extrato"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("artista_da_faixa"),
            F.get_json_object("props", "$.k").alias("nome_da_faixa"),
            F.col("event_type").alias("plataforma"),
            (F.col("event_id") % 7 - 1).cast("int").alias("unidades_de_pagamento"),
            money(F.col("value")).alias("royalty_liquido"),
        )
        return Relation(base, ("public.ft_somlivre_sonymusic",), (), (("data_extrato", "ts"),))

    @cached_property
    def ledger_entries(self) -> DataFrame:
        kind, value, number = F.col("event_type"), money(F.col("value")), F.col("event_id")
        incoming = kind.isin("purchase", "signup")
        return self.read("events").select(
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("projeto"),
            F.when(incoming, "Contas a receber").otherwise("Contas a pagar").alias("tipo"),
            kind.alias("grupo"),
            kind.alias("categoria"),
            F.col("ts").cast("date").alias("data_de_vencimento"),
            F.when(number % 50 == 0, F.lit(None))
            .when(number % 51 == 0, F.lit(0))
            .when(incoming, value)
            .otherwise(-value)
            .cast("decimal(18,4)")
            .alias("valor_liquido"),
            F.when(kind == "click", value).alias("a_pagar_ou_receber"),
        )

    @cached_property
    def ledger(self) -> Relation:
        return Relation(active_ledger(self.ledger_entries, self.groups), ("public.ft_omie_dados_analiticos",))

    @cached_property
    def status_rows(self) -> DataFrame:
        """Contract rows with every status they had."""
        return self._status_rows(self.read("lineitem"))

    @staticmethod
    def _status_rows(lines: DataFrame) -> DataFrame:
        price = F.col("l_extendedprice")
        value, open_value = money(price), money(price * F.col("l_discount"))
        return lines.select(
            F.col("l_orderkey").alias("contrato"),
            F.col("l_linenumber").alias("id"),
            F.col("l_shipdate").alias("inserted_at"),
            _choose(F.col("l_returnflag"), STATUS).alias("status"),
            F.col("l_linestatus").alias("tag"),
            value.alias("valor"),
            open_value.alias("falta_receber"),
            net_value(price, price * F.col("l_discount")).alias("valor_liquido"),
            "l_partkey",
            "l_suppkey",
        )

    @cached_property
    def latest_rows(self) -> DataFrame:
        return latest_contracts(self.status_rows, STATUS_ORDER)

    @cached_property
    def contracts(self) -> Relation:
        """One row per contract.  The latest row is taken before anything is joined."""
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("contrato"),
            F.col("o_orderdate").cast("date").alias("dt_show"),
            F.col("o_orderdate").cast("date").alias("dt_cadastro"),
            F.col("o_orderpriority").alias("vendedor"),
            F.col("o_orderstatus").alias("tipo_evento"),
            F.concat(F.lit("contratos_"), F.col("o_orderpriority")).alias("source_file"),
            "o_custkey",
        )

        def customers() -> DataFrame:
            return self.customers.select(
                F.col("c_custkey").alias("o_custkey"),
                self._show_artist().alias("artista"),
                F.col("n_name").alias("uf"),
                F.concat(F.lit("CIDADE_"), (F.col("c_custkey") % 97).cast("string")).alias("cidade"),
                F.col("c_mktsegment").alias("local"),
                F.col("c_mktsegment").alias("razao_social"),
                F.col("r_name").alias("regiao"),
            )

        def suppliers() -> DataFrame:
            return self.read("supplier").select(
                F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("contratante")
            )

        lookups = (
            left_lookup(["o_custkey"], ["artista", "uf", "cidade", "local", "razao_social", "regiao"], customers),
            left_lookup(["l_suppkey"], ["contratante"], suppliers),
            calendar_lookup(lambda: self.calendar),
        )
        base = self.latest_rows.join(orders, "contrato")
        return Relation(base, ("public.vw_dsu_contratos_calendario",), lookups)

    @cached_property
    def statement_branch(self) -> DataFrame:
        """The four statement platforms.  They share their tables here, so one pass normalises them all."""
        origin = _choose(F.col("r_name"), PLATFORM_OF_REGION)
        raw = F.when(origin == "Warner Music", F.upper("c_name")).otherwise(F.col("c_name"))
        key = F.when(origin == "Universal", F.col("l_partkey").cast("string")).otherwise(raw)
        return branch_of(
            self.lines(*[REGION_OF_PLATFORM[p] for p in LINEAGE]),
            platform=origin,
            table=_choose(origin, LINEAGE),
            month=F.col("__month"),
            artist=raw,
            key=key,
            kind=_choose(F.col("l_returnflag"), ROYALTY_TYPE),
            units=F.col("l_quantity"),
            value=F.col("__value"),
            company=F.col("c_mktsegment"),
            day=F.col("l_shipdate"),
        )

    @cached_property
    def show_lines(self) -> DataFrame:
        """Shows of the region's customers; joined so that a range of days reaches the scan of the orders.

        Only the rows of their contracts are put in order of time.
        """
        customers = self.customers.where(F.col("r_name") == REGION_OF_PLATFORM["DSU"])
        orders = self.read("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("contrato"),
            F.col("o_orderdate").cast("date").alias("dt_show"),
            self._show_artist().alias("artista"),
            F.col("c_mktsegment").alias("razao_social"),
            "o_orderdate",
        )
        own = join_to_sums(self.read("lineitem"), orders.select(F.col("contrato").alias("key_0")), ["l_orderkey"], "left_semi")
        latest = latest_contracts(self._status_rows(own), STATUS_ORDER)
        return show_branch(latest.join(orders, "contrato"), "o_orderdate").select(*BRANCH_COLUMNS)

    @cached_property
    def royalties(self) -> Relation:
        return royalty_relation([self.show_lines, self.statement_branch], lambda: self.matches, lambda: self.artists)

    # ---- registry ---------------------------------------------------------

    @cached_property
    def registry(self) -> Registry:
        def plain(name: str, frame) -> Relation:
            return Relation(frame(), (PHYSICAL_TABLES[name],))

        return Registry(
            {
                "royalty_performance": lambda: self.royalties,
                "dsu_detail": lambda: self.contracts,
                "omie_detail": lambda: self.ledger,
                "orchard_detail": lambda: self.orchard,
                "somlivre_detail": lambda: self.som_livre,
                "universal_detail": lambda: self.universal,
                "warner_chappell_detail": lambda: self.chappell,
                "warner_music_detail": lambda: self.warner_music,
                "universal_musica": lambda: plain("universal_musica", lambda: self.tracks),
                "universal_compositor": lambda: plain("universal_compositor", lambda: self.composers),
                "dim_artistas": lambda: plain("dim_artistas", lambda: self.artists),
            }
        )
