"""The registered queries, each next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cantiga.catalog import SOURCES
from cantiga.functions.money import brazilian_number, plain_values
from cantiga.functions.months import add_months_text, month_of
from cantiga.functions.text import fold_text
from cantiga.operators import ledger, matching, quality, statements
from cantiga.operators.calendar import build_calendar, with_calendar
from cantiga.operators.latest import change_counts, latest_per_key, status_changes
from cantiga.operators.unify import FACT_COLUMNS
from cantiga.plans import bookings, digest, routing
from cantiga.plans.ask import ask
from cantiga.plans.catalogue import catalogue_usage
from cantiga.plans.metrics import files_behind, metric_query
from cantiga.session import remove_folder, shared_folder, tune
from cantiga.sources import contract, sinks
from cantiga.sources.registry import Registry
from cantiga.sources.relation import Relation
from cantiga.sources.star import STATUS_ORDER, StarSchema
from checks import oracle as O
from checks.questions import AS_OF_QUESTIONS, question_log

AS_OF = "1999-03-01"
LOOKAHEAD = 90

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a function of a StarSchema; its result leaves as plain values."""

    def add(build: Callable[[StarSchema], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain_values(build(StarSchema(tune(spark), folder)))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def metric(name, source, metrics=(), dimensions=(), where="", limit=None, **request):
    """Register a metric query and the SQL for it."""
    sql = O.metric_sql(source, metrics, dimensions, where, None if limit is None else max(limit, 1))

    @register(name, sql)
    def build(star: StarSchema) -> DataFrame:
        return metric_query(star.registry, source, metrics, dimensions, limit=limit, **request).frame


# ---- every source with every metric and dimension --------------------------------

for _source in SOURCES.values():
    metric(f"{_source.name}_all_keys", _source.name, list(_source.metrics), list(_source.dimensions))

# ---- metric queries: ranges, filters, limits, shapes -------------------------------

metric("royalties_by_artist_period", "royalty_performance", ["royalties", "quantity"], ["artist", "period"],
       "period >= '1997-03' AND period <= '1998-10'", 100, date_range=("1997-03-15", "1998-10-02"))
metric("royalties_by_origin_type", "royalty_performance", ["royalties", "quantity"], ["origem", "revenue_type"])
metric("royalties_by_period", "royalty_performance", ["royalties"], ["period"])
metric("royalties_by_label", "royalty_performance", ["royalties", "quantity"], ["gravadora"])
metric("royalties_of_one_label_any_case", "royalty_performance", ["royalties"], ["artist"],
       "lower(gravadora) = 'machinery'", filters={"gravadora": "mAcHiNeRy"})
metric("royalties_of_one_origin_any_case", "royalty_performance", ["royalties"], ["period"],
       "lower(origem) = 'warner music'", filters={"origem": "WARNER music"})
metric("lines_of_one_platform_by_its_spellings", "orchard_detail", ["royalties", "quantity"], ["period", "territory"],
       "lower(platform) = 'brand#12'", filters={"platform": "bRAND#12"}, find_spellings=True)
metric("filter_on_foreign_key_ignored", "royalty_performance", ["royalties"], ["origem"],
       filters={"track": "red gear", "no_such_key": "x"})
metric("filter_with_quote", "orchard_detail", ["royalties", "quantity"], ["track", "territory"], "lower(track) = 'sol d''ouro'",
       filters={"track": "SOL d'ouro"})
metric("limit_default", "orchard_detail", ["royalties", "quantity"], ["track", "territory"], limit=100)
metric("limit_zero_gives_one_row", "orchard_detail", ["royalties"], ["period"], limit=0)
metric("global_totals", "royalty_performance", ["quantity", "royalties"])
metric("global_totals_of_nothing", "dsu_detail", ["royalties", "shows"], (), "period > '2999'",
       date_range=("3000-01-01", None))
metric("global_totals_with_looked_up_filter", "dsu_detail", ["shows", "royalties"], (), "lower(artist) = 'nobody'",
       filters={"artist": "Nobody"})
metric("distinct_dimensions", "orchard_detail", (), ["territory", "platform"])
metric("distinct_looked_up_dimension", "royalty_performance", (), ["gravadora"])
metric("open_ended_range", "universal_detail", ["royalties"], ["period", "composer"], "period >= '2000-06'",
       date_range=("2000-06-30", None))
metric("range_end_only", "warner_music_detail", ["royalties", "quantity"], ["period"], "period <= '1995-12'",
       date_range=(None, "1995-12-01"))
metric("track_and_code", "orchard_detail", ["royalties"], ["isrc", "track"])
metric("works_by_composer", "warner_chappell_detail", ["royalties", "quantity"], ["composer", "track"])
metric("royalties_by_channel", "warner_chappell_detail", ["royalties", "quantity"], ["platform"])
metric("royalties_of_one_channel", "warner_chappell_detail", ["royalties"], ["period"], "lower(platform) = 'spotify'",
       filters={"platform": "SPOTIFY"})
metric("plays_by_service", "warner_music_detail", ["quantity"], ["platform", "territory"])
metric("reversals_are_kept", "somlivre_detail", ["quantity", "royalties"], ["platform", "period"])
metric("ledger_revenue_cost", "omie_detail", ["revenue", "cost", "resultado", "payable"], ["period", "category"])
metric("ledger_by_type", "omie_detail", ["revenue", "cost"], ["type"], "period >= '2024-01' AND period <= '2024-01'",
       date_range=("2024-01-10", "2024-01-12"))
metric("shows_by_status", "dsu_detail", ["shows", "royalties"], ["status"])
metric("shows_by_seller_and_kind", "dsu_detail", ["shows"], ["vendedor", "tipo_evento", "contratante"])
metric("shows_by_critical_day", "dsu_detail", ["shows", "royalties"], ["dia_critico"])
metric("shows_on_critical_days", "dsu_detail", ["shows"], ["territory"], "dia_critico", filters={"dia_critico": "TRUE"})
metric("shows_by_month", "dsu_detail", ["shows", "royalties"], ["period"],
       "period >= '1998-01' AND period <= '1998-06'", date_range=("1998-01-31", "1998-06-01"))


# ---- scans, schemas, sinks ----------------------------------------------------------


@register(
    "rows_per_table",
    O.with_ctes(
        "\nUNION ALL ".join(f"SELECT '{s}' AS fonte, count(*) AS linhas FROM src_{s}" for s in SOURCES)
        + "\nUNION ALL SELECT 'universal_musica', count(*) FROM part"
        + "\nUNION ALL SELECT 'universal_compositor', count(DISTINCT p_brand) FROM part"
        + "\nUNION ALL SELECT 'dim_artistas', count(*) FROM customer"
    ),
)
def _(star):
    counts = [
        star.registry.relation(name).base.agg(F.count("*").alias("linhas")).select(F.lit(name).alias("fonte"), "linhas")
        for name in star.registry.names()
    ]
    total = counts[0]
    for more in counts[1:]:
        total = total.unionByName(more)
    return total


_ARTIST_TYPES = [
    ("id", "bigint"), ("nome_artistico", "string"), ("gravadora", "string"), ("artista_keyword", "string"),
    ("dsu_artista", "string"), ("universal_compositor", "string"), ("warner_chappel_deal_scope_name", "array<string>"),
    ("warner_music_artist_name", "string"),
]


@register(
    "artist_register_fill_rates",
    O.with_ctes(
        "\nUNION ALL ".join(
            f"SELECT 'dim_artistas' AS tabela, {i} AS posicao, '{c}' AS coluna, '{t}' AS tipo, count(*) AS linhas, "
            f"count({c}) AS preenchidas, {O.percent_sql(f'count({c})', 'count(*)')} AS pct_preenchidas FROM artists"
            for i, (c, t) in enumerate(_ARTIST_TYPES, 1)
        )
    ),
)
def _(star):
    return quality.fill_rates(star.artists, "dim_artistas")


@register(
    "schema_contract_with_fill",
    """SELECT 'orders' AS tabela, 'o_totalprice' AS coluna, 'decimal(18,4)' AS tipo, 'double' AS tipo_encontrado,
              count(o_totalprice) AS preenchidas FROM orders
       UNION ALL SELECT 'orders', 'o_missing', 'string', NULL, NULL""",
)
def _(star):
    orders = star.read("orders")
    expected = star.spark.createDataFrame(
        [("orders", "o_orderkey", "bigint"), ("orders", "o_totalprice", "decimal(18,4)"), ("orders", "o_missing", "string")],
        "tabela string, coluna string, tipo string",
    )
    broken = contract.contract_violations(expected, contract.describe_frames(star.spark, {"orders": orders}))
    filled = quality.fill_rates(orders, "orders").select("tabela", "coluna", "preenchidas")
    return broken.join(filled, ["tabela", "coluna"], "left")


@register(
    "staged_months_pruned",
    O.with_ctes(
        """SELECT periodo, plataforma_origem, count(*) AS linhas, CAST(sum(valor_royalties) AS DOUBLE) AS royalties
           FROM branches WHERE periodo BETWEEN '1998-01' AND '1998-03' GROUP BY ALL"""
    ),
)
def _(star):
    columns = ["periodo", "plataforma_origem", "tipo_remuneracao", "valor_royalties"]
    path = shared_folder(star.spark, "stg_royalty")
    sinks.write_months(star.royalties.base.select(*columns), path)
    staged = sinks.read_months(star.spark, path)
    return (
        staged.where(F.col("periodo").between("1998-01", "1998-03"))
        .groupBy(F.col("periodo").cast("string").alias("periodo"), "plataforma_origem")
        .agg(F.count("*").alias("linhas"), F.sum("valor_royalties").alias("royalties"))
    )


@register(
    "files_behind_a_range",
    O.with_ctes(
        """SELECT 'royalty_performance' AS fonte, periodo AS pasta, count(*) AS linhas
           FROM branches WHERE periodo BETWEEN '1998-02' AND '1998-04' AND lower(plataforma_origem) = 'orchard' GROUP BY ALL"""
    ),
)
def _(star):
    """The files that a question about three months of one platform takes rows from, by month folder."""
    path = shared_folder(star.spark, "fact_files")
    sinks.write_months(star.royalties.base.select("periodo", "plataforma_origem", "valor_royalties"), path)
    registry = Registry({"royalty_performance": lambda: Relation(sinks.read_months(star.spark, path), ("public.fato",))})
    files = files_behind(registry, "royalty_performance", ("1998-02-10", "1998-04-20"), {"origem": "ORCHARD"})
    return files.groupBy("fonte", F.regexp_extract("arquivo", "periodo=([^/]+)/", 1).alias("pasta")).agg(F.sum("linhas").alias("linhas"))


@register(
    "staged_months_clustered",
    O.with_ctes(
        """SELECT periodo, plataforma_origem, count(*) AS linhas, CAST(sum(valor_royalties) AS DOUBLE) AS royalties
           FROM branches WHERE artista_raw BETWEEN 'Customer#000000100' AND 'Customer#000000120' GROUP BY ALL"""
    ),
)
def _(star):
    """Months in Z-order of artist and platform; the artists asked for lie in few row groups."""
    columns = ["periodo", "artista_raw", "plataforma_origem", "valor_royalties"]
    path = shared_folder(star.spark, "stg_clustered")
    sinks.write_clustered_months(star.royalties.base.select(*columns), path, ["artista_raw", "plataforma_origem"])
    staged = sinks.read_months(star.spark, path)
    return (
        staged.where(F.col("artista_raw").between("Customer#000000100", "Customer#000000120"))
        .groupBy(F.col("periodo").cast("string").alias("periodo"), "plataforma_origem")
        .agg(F.count("*").alias("linhas"), F.sum("valor_royalties").alias("royalties"))
    )


@register(
    "refreshed_by_fingerprint",
    O.with_ctes(
        """SELECT mes AS periodo, count(*) AS linhas, CAST(sum(CASE WHEN mes = '1999-01' THEN val * 2 ELSE val END) AS DOUBLE) AS royalties,
                  mes = '1999-01' AS refeito
           FROM line WHERE r_name = 'AMERICA' AND mes <> '1998-05' GROUP BY ALL"""
    ),
)
def _(star):
    """One month corrected, one gone: only the corrected one is computed again, and the other's folder is removed."""
    lines = star.orchard.base.select(
        F.col("periodo_relatorio").alias("periodo"), F.col("valor_liquido_moeda_conta").alias("valor")
    )
    fixed = F.when(F.col("periodo") == "1999-01", F.col("valor") * 2).otherwise(F.col("valor")).cast("decimal(18,4)")
    path = shared_folder(star.spark, "mv_fingerprints")
    sinks.refresh_months(lines, path)
    done = sinks.refresh_months(lines.where("periodo <> '1998-05'").withColumn("valor", fixed), path)
    staged = sinks.read_months(star.spark, path).withColumn("periodo", F.col("periodo").cast("string"))
    return staged.groupBy("periodo").agg(
        F.count("*").alias("linhas"), F.sum("valor").alias("royalties"), F.first(F.col("periodo").isin(list(done.changed))).alias("refeito")
    )


@register(
    "refreshed_months",
    O.with_ctes(
        """SELECT mes AS periodo, count(*) AS linhas,
                  CAST(sum(CASE WHEN mes >= '1999-01' THEN val * 2 ELSE val END) AS DOUBLE) AS royalties
           FROM line WHERE r_name = 'AMERICA' GROUP BY ALL"""
    ),
)
def _(star):
    lines = star.orchard.base.select(
        F.col("periodo_relatorio").alias("periodo"), F.col("valor_liquido_moeda_conta").alias("valor")
    )
    corrected = lines.where(F.col("periodo") >= "1999-01").withColumn("valor", (F.col("valor") * 2).cast("decimal(18,4)"))
    path = shared_folder(star.spark, "mv_orchard")
    sinks.write_months(lines, path)
    sinks.write_months(corrected, path)
    return (
        sinks.read_months(star.spark, path)
        .groupBy(F.col("periodo").cast("string").alias("periodo"))
        .agg(F.count("*").alias("linhas"), F.sum("valor").alias("royalties"))
    )


@register(
    "contract_rows_as_plain_values",
    O.with_ctes(
        """SELECT contrato, strftime(dt_show, '%Y-%m-%d') AS dt_show, strftime(inserted_at, '%Y-%m-%dT%H:%M:%S') AS inserted_at,
                  CAST(valor AS DOUBLE) AS valor, CAST(valor_liquido AS DOUBLE) AS valor_liquido, dia_critico FROM contracts"""
    ),
)
def _(star):
    return star.contracts.columns("contrato", "dt_show", "inserted_at", "valor", "valor_liquido", "dia_critico")


@register(
    "contract_rows_as_json",
    O.with_ctes(
        "SELECT CAST(to_json({contrato: contrato, dt_show: strftime(dt_show, '%Y-%m-%d'), status: status, dia_critico: dia_critico}) AS VARCHAR) AS linha FROM contracts"
    ),
)
def _(star):
    return sinks.json_rows(star.contracts.columns("contrato", "dt_show", "status", "dia_critico"))


# ---- joins and matching --------------------------------------------------------------


@register("artist_matches", O.with_ctes("SELECT * FROM matches"))
def _(star):
    return star.matches


@register(
    "names_matched_by_keyword",
    O.with_ctes("SELECT chave_artista AS nome, matched_artista_id AS id FROM matches WHERE plataforma_origem = 'Orchard'"),
)
def _(star):
    names = star.orchard.base.select(F.col("artista_produto").alias("nome"))
    return matching.match_keyword(names, star.artists.select("id", F.col("artista_keyword").alias("keyword")))


@register(
    "tracks_matched_by_composer",
    O.with_ctes(
        "SELECT chave_artista AS codigo_musica, matched_artista_id AS id FROM matches WHERE plataforma_origem = 'Universal'"
    ),
)
def _(star):
    return matching.match_composer(star.tracks, star.artists)


@register(
    "scopes_matched_by_array_key",
    O.with_ctes(
        "SELECT chave_artista AS chave, matched_artista_id AS id FROM matches WHERE plataforma_origem = 'Warner Chappell'"
    ),
)
def _(star):
    return matching.match_exact(matching.array_keys(star.artists, "warner_chappel_deal_scope_name"))


@register(
    "category_drift",
    O.with_ctes(
        """SELECT tipo, grupo, categoria, count(*) AS lancamentos FROM ledger_rows
           WHERE (tipo, grupo, categoria) NOT IN (('Contas a receber', 'purchase', 'purchase'),
             ('Contas a receber', 'signup', 'signup'), ('Contas a pagar', 'click', 'click'), ('Contas a pagar', 'view', 'view'))
           GROUP BY ALL"""
    ),
)
def _(star):
    return ledger.category_drift(star.ledger_entries, star.categories)


# ---- contracts and bookings -----------------------------------------------------------


@register(
    "contracts_latest_with_calendar",
    O.with_ctes(
        """SELECT contrato, id, strftime(inserted_at, '%Y-%m-%dT%H:%M:%S') AS inserted_at, status,
                  strftime(dt_show, '%Y-%m-%d') AS dt_show, CAST(valor AS DOUBLE) AS valor,
                  CAST(falta_receber AS DOUBLE) AS falta_receber, CAST(valor_liquido AS DOUBLE) AS valor_liquido,
                  artista, dia_semana, fim_de_semana, feriado, nome_feriado, dia_critico FROM contracts"""
    ),
)
def _(star):
    facts = star.contracts.columns(
        "contrato", "id", "inserted_at", "status", "dt_show", "valor", "falta_receber", "valor_liquido", "artista"
    )
    return with_calendar(facts, star.calendar).drop("uf_feriado")


@register(
    "latest_status_counts",
    O.with_ctes("SELECT status, count(*) AS contratos, CAST(sum(valor) AS DOUBLE) AS valor FROM latest GROUP BY ALL"),
)
def _(star):
    latest = latest_per_key(star.status_rows, ["contrato"], STATUS_ORDER)
    return latest.groupBy("status").agg(F.count("*").alias("contratos"), F.sum("valor").alias("valor"))


_CHANGES = """
    SELECT contrato, strftime(inserted_at, '%Y-%m-%dT%H:%M:%S') AS inserted_at, de_status, status AS para_status FROM (
      SELECT *, lag(status) OVER w AS de_status, row_number() OVER w AS n FROM status_rows
      WINDOW w AS (PARTITION BY contrato ORDER BY inserted_at, id, l_partkey, l_suppkey, valor))
    WHERE n > 1 AND de_status IS DISTINCT FROM status"""


@register("status_changes", O.with_ctes(_CHANGES))
def _(star):
    return _changes(star)


@register(
    "status_change_counts",
    O.with_ctes(f"SELECT de_status, para_status, count(*) AS mudancas FROM ({_CHANGES}) GROUP BY ALL"),
)
def _(star):
    return change_counts(_changes(star))


def _changes(star):
    return status_changes(star.status_rows, ["contrato"], "status", STATUS_ORDER)


@register(
    "calendar_of_order_dates",
    O.with_ctes(
        "SELECT * REPLACE (strftime(data, '%Y-%m-%d') AS data) FROM ("
        + O._calendar("SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders")
        + ")"
    ),
)
def _(star):
    span = star.read("orders").agg(
        F.min("o_orderdate").cast("date").alias("inicio"), F.max("o_orderdate").cast("date").alias("fim")
    )
    return build_calendar(span)


def _quality_sql(of: str = "TRUE") -> str:
    return O.with_ctes(
        f"""SELECT artista, CAST(sum(1) AS BIGINT) AS total_shows, CAST(sum(critico) AS BIGINT) AS shows_dia_critico,
                   {O.percent_sql('sum(critico)', 'sum(1)')} AS pct_dia_critico
            FROM (SELECT artista, CAST(dia_critico AS INTEGER) AS critico FROM contracts WHERE status = 'CONFIRMADO' AND {of})
            WHERE critico IN (0, 1) GROUP BY artista"""
    )


def _missed_sql(of: str = "TRUE") -> str:
    """All pairs of an artist and a critical day of the window, less the booked ones; a null artist is never booked."""
    return O.with_ctes(
        f"""SELECT artista, strftime(dia, '%Y-%m-%d') AS data_livre FROM (
              SELECT artista, unnest((SELECT list(data) FROM cal
                                      WHERE dia_critico AND datediff('day', DATE '{AS_OF}', data) BETWEEN 0 AND {LOOKAHEAD})) AS dia
              FROM contracts WHERE {of} GROUP BY artista
              EXCEPT SELECT artista, dt_show FROM contracts WHERE status = 'CONFIRMADO' AND artista IS NOT NULL)"""
    )


_ONE_ARTIST = "000007 - Customer#000000007"


@register("booking_quality", _quality_sql())
def _(star):
    return bookings.booking_quality(star.contracts.columns("artista", "status", "dia_critico"))


@register("booking_quality_of_one_artist", _quality_sql(f"artista = '{_ONE_ARTIST}'"))
def _(star):
    return bookings.booking_quality(star.contracts.columns("artista", "status", "dia_critico"), _ONE_ARTIST)


@register("missed_opportunities", _missed_sql())
def _(star):
    shows = star.contracts.columns("artista", "status", "dt_show")
    return bookings.missed_opportunities(shows, star.calendar, None, LOOKAHEAD, AS_OF)


@register("missed_opportunities_of_one_artist", _missed_sql(f"artista = '{_ONE_ARTIST}'"))
def _(star):
    shows = star.contracts.columns("artista", "status", "dt_show")
    return bookings.missed_opportunities(shows, star.calendar, _ONE_ARTIST, LOOKAHEAD, AS_OF)


@register("artists_with_contracts", O.with_ctes("SELECT DISTINCT artista FROM contracts"))
def _(star):
    return star.contracts.columns("artista").distinct()


# ---- datasets ------------------------------------------------------------------------


@register(
    "royalty_fact",
    O.with_ctes(
        """SELECT periodo, periodo_receita, artista, artista_raw, plataforma_origem, tipo_remuneracao,
                  CAST(quantidade AS DOUBLE) AS quantidade, CAST(valor_royalties AS DOUBLE) AS valor_royalties, tabela_origem,
                  matched_artista_id, matched_artista_keyword, razao_social FROM fact"""
    ),
)
def _(star):
    return star.royalties.columns(*FACT_COLUMNS)


@register(
    "royalty_fact_by_lineage",
    O.with_ctes(
        """SELECT tabela_origem, plataforma_origem, count(*) AS linhas, CAST(sum(quantidade) AS DOUBLE) AS quantidade,
                  CAST(sum(valor_royalties) AS DOUBLE) AS royalties FROM branches GROUP BY ALL"""
    ),
)
def _(star):
    return star.royalties.base.groupBy("tabela_origem", "plataforma_origem").agg(
        F.count("*").alias("linhas"), F.sum("quantidade").alias("quantidade"), F.sum("valor_royalties").alias("royalties")
    )


@register(
    "royalties_by_receipt_month",
    O.with_ctes(
        """SELECT periodo_receita, plataforma_origem, CAST(sum(valor_royalties) AS DOUBLE) AS royalties
           FROM branches GROUP BY ALL"""
    ),
)
def _(star):
    return star.royalties.base.groupBy("periodo_receita", "plataforma_origem").agg(
        F.sum("valor_royalties").alias("royalties")
    )


@register(
    "active_ledger",
    O.with_ctes(
        """SELECT projeto, tipo, grupo, categoria, strftime(data_de_vencimento, '%Y-%m-%d') AS data_de_vencimento,
                  CAST(valor_liquido AS DOUBLE) AS valor_liquido, CAST(a_pagar_ou_receber AS DOUBLE) AS a_pagar_ou_receber
           FROM ledger_rows WHERE grupo IN ('purchase', 'signup', 'error', 'click')"""
    ),
)
def _(star):
    return star.ledger.base.select(
        "projeto", "tipo", "grupo", "categoria", "data_de_vencimento", "valor_liquido", "a_pagar_ou_receber"
    )


@register(
    "universal_lines",
    O.with_ctes(
        """SELECT mes AS data_extrato, CASE l_linestatus WHEN 'F' THEN 'Fisico' WHEN 'O' THEN 'Digital' END AS media,
                  CASE l_returnflag WHEN 'A' THEN 'Assinatura' WHEN 'R' THEN 'Radio' END AS canal,
                  CAST(l_partkey AS VARCHAR) AS codigo_musica, p_name AS titulo_musica, p_brand AS compositor,
                  p_type AS plataforma, l_returnflag AS tipo_receita, qtd AS unidades, CAST(val AS DOUBLE) AS royalties_a_pagar,
                  matched_artista_id, coalesce(artista_casado, c_name) AS artist
           FROM line LEFT JOIN matches ON plataforma_origem = 'Universal' AND chave_artista = CAST(l_partkey AS VARCHAR)
           WHERE r_name = 'ASIA'"""
    ),
)
def _(star):
    return statements.universal_lines(star.universal)


@register(
    "simple_statement",
    O.with_ctes(
        """SELECT l_orderkey AS id, mes AS data_extrato, n_name AS source_territory_name,
                  l_returnflag AS tango_income_type_name, descricao_canal, CAST(l_partkey AS VARCHAR) AS source_work_id,
                  isrc AS tango_work_code, faixa AS tango_work_title, substr(c_name || ' / ' || s_name, 1, 50) AS creator_names,
                  qtd AS units, CAST(val AS DOUBLE) AS amount_paid_less_tax
           FROM line LEFT JOIN channel ON prov = l_returnflag AND src = l_linestatus WHERE r_name = 'EUROPE'"""
    ),
)
def _(star):
    return statements.simple_statement(star.chappell)


@register(
    "statement_subset",
    O.with_ctes(
        """SELECT l_orderkey AS id, mes AS data_extrato, CAST(l_orderkey AS VARCHAR) AS statement_id,
                  n_name AS source_territory_name, l_linestatus AS source_income_type, l_returnflag AS tango_income_type_name,
                  l_returnflag AS income_provider_name, l_linestatus AS exploitation_source,
                  o_orderpriority AS product_description, CAST(l_partkey AS VARCHAR) AS source_work_id,
                  isrc AS tango_work_code, faixa AS tango_work_title, c_name || ' / ' || s_name AS creator_names,
                  s_name AS composer, qtd AS units, l_extendedprice AS amount_received, l_discount AS rate_percentage,
                  CAST(val AS DOUBLE) AS amount_paid, l_tax AS tax_rate, CAST(0 AS DOUBLE) AS withholding_tax,
                  CAST(val AS DOUBLE) AS amount_paid_less_tax,
                  md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey) AS row_hash,
                  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS inserted_at
           FROM line WHERE r_name = 'EUROPE'"""
    ),
)
def _(star):
    return statements.statement_subset(star.chappell)


@register(
    "show_view",
    O.with_ctes(
        """SELECT id, strftime(dt_show, '%Y-%m-%d') AS dt_cadastro, contrato, artista, uf, cidade, "local",
                  strftime(dt_show, '%Y-%m-%d') AS dt_show, status, CAST(valor AS DOUBLE) AS valor,
                  CAST(falta_receber AS DOUBLE) AS falta_receber, CAST(valor_liquido AS DOUBLE) AS valor_liquido,
                  strftime(dt_show, '%Y-%m') AS periodo, source_file FROM contracts"""
    ),
)
def _(star):
    return statements.show_view(star.contracts)


# ---- data quality ------------------------------------------------------------------------

_P = O.percent_sql


@register(
    "match_coverage",
    O.with_ctes(
        f"""SELECT plataforma_origem, CAST(sum(n) AS BIGINT) AS linhas, CAST(sum(c) AS BIGINT) AS linhas_casadas,
                   {_P('sum(c)', 'sum(n)')} AS pct_linhas, count(*) AS artistas,
                   count(*) FILTER (WHERE c > 0) AS artistas_casados,
                   {_P('count(*) FILTER (WHERE c > 0)', 'count(*)')} AS pct_artistas
            FROM (SELECT plataforma_origem, artista_raw, CAST(count(*) AS BIGINT) AS n, count(matched_artista_id) AS c
                  FROM fact GROUP BY ALL) GROUP BY plataforma_origem"""
    ),
)
def _(star):
    return quality.match_coverage(star.royalties)


@register(
    "channel_coverage",
    O.with_ctes(
        f"""SELECT count(*) AS combinacoes, count(d) AS combinacoes_resolvidas, {_P('count(d)', 'count(*)')} AS pct_combinacoes,
                   CAST(sum(n) AS BIGINT) AS linhas, CAST(sum(CASE WHEN d IS NOT NULL THEN n END) AS BIGINT) AS linhas_resolvidas,
                   {_P('sum(CASE WHEN d IS NOT NULL THEN n END)', 'sum(n)')} AS pct_linhas
            FROM (SELECT l_returnflag, l_linestatus, descricao_canal AS d, count(*) AS n
                  FROM line LEFT JOIN channel ON prov = l_returnflag AND src = l_linestatus
                  WHERE r_name = 'EUROPE' GROUP BY ALL)"""
    ),
)
def _(star):
    return quality.key_coverage(star.chappell, ["income_provider_name", "exploitation_source"], "descricao_canal")


@register(
    "corrupted_titles",
    O.with_ctes(
        f"""SELECT n AS linhas, c AS corrompidas, {_P('c', 'n')} AS pct_corrompidas
            FROM (SELECT count(*) AS n, count(*) FILTER (WHERE regexp_full_match(faixa, '[?]+')) AS c
                  FROM line WHERE r_name = 'AMERICA')"""
    ),
)
def _(star):
    return quality.corrupted_titles(star.orchard, "titulo_musica", ["l_partkey"])


_KEYS = {
    "source_file+line_number": "l_orderkey, l_linenumber",
    "row_hash": "l_orderkey, l_linenumber, l_partkey, l_suppkey",
}


@register(
    "key_uniqueness",
    O.with_ctes(
        "\nUNION ALL ".join(
            f"""SELECT '{name}' AS chave, CAST(sum(n) AS BIGINT) AS linhas, count(*) AS chaves,
                       count(*) FILTER (WHERE n > 1) AS chaves_repetidas, CAST(sum(n - 1) AS BIGINT) AS linhas_excedentes
                FROM (SELECT count(*) AS n FROM line WHERE r_name = 'EUROPE' GROUP BY {keys})"""
            for name, keys in _KEYS.items()
        )
        + """\nUNION ALL SELECT 'contrato', CAST(sum(n) AS BIGINT), count(*), count(*) FILTER (WHERE n > 1),
             CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM status_rows GROUP BY contrato)"""
    ),
)
def _(star):
    statement = star.chappell.base
    return (
        quality.key_uniqueness(statement, ["source_file", "line_number"], "source_file+line_number")
        .unionByName(quality.key_uniqueness(statement, ["row_hash"], "row_hash"))
        .unionByName(quality.key_uniqueness(star.status_rows, ["contrato"], "contrato"))
    )


@register(
    "repeated_statement_lines",
    "SELECT l_orderkey AS source_file, l_linenumber AS line_number, count(*) AS linhas FROM lineitem "
    "GROUP BY ALL HAVING count(*) > 1",
)
def _(star):
    lines = star.read("lineitem").select(F.col("l_orderkey").alias("source_file"), F.col("l_linenumber").alias("line_number"))
    return quality.repeated_keys(lines, ["source_file", "line_number"])


@register(
    "over_count_by_status",
    O.with_ctes(
        """SELECT r.status, r.n AS linhas_brutas, CAST(r.v AS DOUBLE) AS valor_bruto,
                  coalesce(k.n, 0) AS linhas_unicas, CAST(coalesce(k.v, 0) AS DOUBLE) AS valor_unico
           FROM (SELECT status, count(*) AS n, sum(valor_liquido) AS v FROM status_rows GROUP BY 1) r
           LEFT JOIN (SELECT status, count(*) AS n, sum(valor_liquido) AS v FROM latest GROUP BY 1) k ON r.status = k.status"""
    ),
)
def _(star):
    return quality.over_count(star.status_rows, ["contrato"], STATUS_ORDER, "valor_liquido")


def _from_states(star, measure, rows, first_months, name):
    """The report from sums kept per month: some months first, then all, of which only the new ones are summed."""
    path = shared_folder(star.spark, name)
    for part in (rows.where(first_months), rows):
        sinks.refresh_months(part, path, lambda found: measure.state(found, "periodo"))
    return measure.of_states(sinks.read_months(star.spark, path))


@register("match_coverage_from_states", ORACLE["match_coverage"])
def _(star):
    rows = star.royalties.base.select("periodo", "plataforma_origem", "chave_artista", "artista_raw")
    # Both refreshes read the rows for the fingerprints and again for the sums; joins and a window make them, once.
    made = shared_folder(star.spark, "rows_match")
    rows.write.parquet(made)
    report = _from_states(star, quality.matching(star.royalties), star.spark.read.parquet(made), "periodo < '1997-01'", "states_match")
    remove_folder(star.spark, made)
    return report


@register("over_count_from_states", ORACLE["over_count_by_status"])
def _(star):
    rows = star.status_rows.select("contrato", "status", "valor_liquido", *STATUS_ORDER).withColumn("periodo", month_of(F.col("inserted_at")))
    return _from_states(star, quality.over_counting(["contrato"], STATUS_ORDER, "valor_liquido"), rows, "periodo < '1997-01'", "states_over")


_REPORT = {
    "cobertura_artista": ("match_coverage", ["plataforma_origem"]),
    "cobertura_canal": ("channel_coverage", []),
    "titulos_corrompidos": ("corrupted_titles", []),
    "chaves": ("key_uniqueness", ["chave"]),
    "deriva_categoria": ("category_drift", ["tipo", "grupo", "categoria"]),
    "contagem_dupla": ("over_count_by_status", ["status"]),
    "preenchimento": ("artist_register_fill_rates", ["tabela", "coluna"]),
}


def _report_sql() -> str:
    """The measures of the single reports, unpivoted."""
    parts = []
    for name, (query, labels) in _REPORT.items():
        item = " || '.' || ".join(labels) or "''"
        parts.append(
            f"""SELECT '{name}' AS relatorio, item, medida, valor FROM (UNPIVOT (
                  SELECT {item} AS item, CAST(COLUMNS(* EXCLUDE ({', '.join(labels) or 'nothing_'})) AS DOUBLE)
                  FROM (SELECT *{" EXCLUDE (tipo)" if query == "artist_register_fill_rates" else ""}{"" if labels else ", 0 AS nothing_"} FROM ({ORACLE[query]}))
                ) ON COLUMNS(* EXCLUDE (item)) INTO NAME medida VALUE valor)"""
        )
    return "\nUNION ALL ".join(parts)


@register("quality_report", _report_sql())
def _(star):
    keys = (
        quality.keys_uniqueness(star.chappell.base, {"source_file+line_number": ["source_file", "line_number"], "row_hash": ["row_hash"]})
        .unionByName(quality.key_uniqueness(star.status_rows, ["contrato"], "contrato"))
    )
    channels = quality.key_coverage(star.chappell, ["income_provider_name", "exploitation_source"], "descricao_canal")
    return quality.quality_report(
        cobertura_artista=(quality.match_coverage(star.royalties), ["plataforma_origem"]),
        cobertura_canal=(channels, []),
        titulos_corrompidos=(quality.corrupted_titles(star.orchard, "titulo_musica", ["l_partkey"]), []),
        chaves=(keys, ["chave"]),
        deriva_categoria=(ledger.category_drift(star.ledger_entries, star.categories), ["tipo", "grupo", "categoria"]),
        contagem_dupla=(quality.over_count(star.status_rows, ["contrato"], STATUS_ORDER, "valor_liquido"), ["status"]),
        preenchimento=(quality.fill_rates(star.artists, "dim_artistas").drop("tipo"), ["tabela", "coluna"]),
    )


# ---- digests ---------------------------------------------------------------------------

_DIGEST = ("royalty_performance", ["royalties", "quantity"], ["artist", "origem"])
_DIGEST_ROWS = O.metric_sql(*_DIGEST, limit=100)
_DIGEST_ORDER = "ORDER BY royalties DESC NULLS LAST, artist NULLS LAST, origem NULLS LAST"


def _digest_frame(star):
    return plain_values(metric_query(star.registry, *_DIGEST).frame)


@register(
    "digest_preview",
    f"""SELECT artist, origem, royalties, quantity, CAST(posicao AS INTEGER) AS posicao FROM (
          SELECT *, max(CASE WHEN good THEN 1 ELSE 0 END) OVER () AS any_good FROM (
            SELECT *, row_number() OVER ({_DIGEST_ORDER}) AS posicao,
                   coalesce(royalties, 0) <> 0 OR coalesce(quantity, 0) <> 0 AS good
            FROM ({_DIGEST_ROWS}) {_DIGEST_ORDER} LIMIT 20))
        WHERE good OR any_good = 0 ORDER BY posicao LIMIT 10""",
)
def _(star):
    return digest.preview(_digest_frame(star), _DIGEST[1], _DIGEST[2])


@register(
    "digest_totals",
    f"""SELECT CAST(sum(CAST(royalties AS DECIMAL(28, 4))) AS DOUBLE) AS royalties,
               CAST(sum(CAST(quantity AS DECIMAL(28, 4))) AS DOUBLE) AS quantity, count(*) AS linhas FROM ({_DIGEST_ROWS})""",
)
def _(star):
    return digest.totals(metric_query(star.registry, *_DIGEST).frame, _DIGEST[1])


@register(
    "digest_leader",
    f"""SELECT coalesce(artist, '(sem valor)') AS rotulo, 'royalties' AS metrica,
               translate(format('{{:,.2f}}', royalties), ',.', '.,') AS valor
        FROM ({_DIGEST_ROWS}) {_DIGEST_ORDER} LIMIT 1""",
)
def _(star):
    return digest.leader(_digest_frame(star), _DIGEST[1], _DIGEST[2])


@register(
    "top_artists_overall",
    "SELECT * FROM (" + O.metric_sql("royalty_performance", ["royalties"], ["artist"]) + ") "
    "ORDER BY royalties DESC NULLS LAST, artist LIMIT 3",
)
def _(star):
    every = metric_query(star.registry, "royalty_performance", ["royalties"], ["artist"], limit=None).frame
    return digest.top_k(every, "royalties", ["artist"])


@register(
    "numbers_as_brazilian_text",
    """SELECT o_orderkey, translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS total,
              translate(format('{:,}', o_custkey * 1000003), ',', '.') AS inteiro,
              CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE translate(format('{:,.2f}', -o_totalprice), ',.', '.,') END AS talvez
       FROM orders""",
)
def _(star):
    orders = star.read("orders").select(
        "o_orderkey",
        F.col("o_totalprice").alias("total"),
        (F.col("o_custkey") * 1000003).alias("inteiro"),
        F.when(F.col("o_orderkey") % 3 != 0, -F.col("o_totalprice")).alias("talvez"),
    )
    return digest.formatted(orders, ["total", "inteiro", "talvez"])


# ---- scalar functions over whole columns ---------------------------------------------------


@register(
    "folded_messages",
    "SELECT conv_id, turn, strip_accents(lower(text)) AS texto FROM conversations",
)
def _(star):
    return star.read("conversations").select("conv_id", "turn", fold_text(F.col("text")).alias("texto"))


@register(
    "folded_documents",
    "SELECT doc_id, md5(strip_accents(lower(text))) AS texto FROM documents",
)
def _(star):
    return star.read("documents").select("doc_id", F.md5(fold_text(F.col("text")).cast("binary")).alias("texto"))


@register(
    "months_shifted",
    """SELECT mes, strftime(CAST(mes || '-01' AS DATE) + INTERVAL 3 MONTH, '%Y-%m') AS mais_3,
              strftime(CAST(mes || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m') AS menos_1, count(*) AS linhas
       FROM (SELECT strftime(l_shipdate, '%Y-%m') AS mes FROM lineitem) GROUP BY ALL""",
)
def _(star):
    months = star.read("lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("mes")).agg(
        F.count("*").alias("linhas")
    )
    return months.select(
        "mes", add_months_text(F.col("mes"), 3).alias("mais_3"), add_months_text(F.col("mes"), -1).alias("menos_1"), "linhas"
    )


# ---- question routing --------------------------------------------------------------------


def _routed_columns(routed):
    return routed.select(
        "id",
        "rota_source",
        F.array_join("rota_metrics", ",").alias("rota_metrics"),
        F.array_join("rota_dimensions", ",").alias("rota_dimensions"),
        F.try_element_at("rota_filters", F.lit("origem")).alias("filtro_origem"),
        F.try_element_at("rota_filters", F.lit("revenue_type")).alias("filtro_revenue_type"),
        "rota_start_date",
        "rota_end_date",
        F.array_join("rota_notes", " | ").alias("rota_notes"),
    )


def _routed_log(star):
    log = question_log(star.read("orders"))
    return routing.route_questions(log, "texto", AS_OF_QUESTIONS, source="fonte_dada")


def _log_mix(star):
    return routing.question_mix(question_log(star.read("orders")), "texto", AS_OF_QUESTIONS, source="fonte_dada")


def _routed_messages(star):
    messages = star.read("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return routing.route_questions(messages, "text", AS_OF_QUESTIONS)


@register("routed_questions", O.routing_sql(O.QUESTION_LOG, f"SELECT {O.ROUTED_COLUMNS} FROM routed"))
def _(star):
    return _routed_columns(_routed_log(star))


@register("routed_messages", O.routing_sql(O.MESSAGES, f"SELECT {O.ROUTED_COLUMNS} FROM routed"))
def _(star):
    return _routed_columns(_routed_messages(star))


@register("routing_mix", O.routing_sql(O.QUESTION_LOG, O.MIX))
def _(star):
    return _log_mix(star)


@register(
    "question_answered_from_tracks",
    O.metric_sql("orchard_detail", ["quantity", "royalties"], ["artist", "track"], limit=100),
)
def _(star):
    return ask(star.spark, star.registry, "Quais faixas da Orchard mais tocaram por artista?", AS_OF_QUESTIONS).result.frame


@register(
    "question_answered_with_range_and_filter",
    O.metric_sql(
        "royalty_performance", ["royalties"], ["artist", "period"],
        "period BETWEEN '1996-01' AND '1996-06' AND lower(origem) = 'warner music'", 40,
    ),
)
def _(star):
    question = "Royalties da Warner Music por artista e periodo, de 1996-01-10 a 1996-06-02"
    return ask(star.spark, star.registry, question, AS_OF_QUESTIONS, limit=40).result.frame


@register(
    "question_answered_from_ledger",
    O.metric_sql("omie_detail", ["revenue", "cost"], ["period"], limit=100),
)
def _(star):
    return ask(star.spark, star.registry, "Receita e custos mensal do financeiro", AS_OF_QUESTIONS).result.frame


def _catalogue_values() -> str:
    def text(value):
        return "NULL" if value is None else "'" + value.replace("'", "''") + "'"

    rows = []
    for s in SOURCES.values():
        head = f"'v2', '{s.name}', {str(s.default).lower()}, true"
        rows.append(f"({head}, 'source', '{s.name}', NULL, {text(s.description)})")
        rows += [f"({head}, 'metric', '{m.key}', {text(m.label)}, {text(m.description)})" for m in s.metrics.values()]
        rows += [f"({head}, 'dimension', '{d.key}', {text(d.label)}, {text(d.description)})" for d in s.dimensions.values()]
    return ", ".join(rows)


@register(
    "catalogue_usage",
    O.routing_sql(
        O.QUESTION_LOG,
        f"""SELECT c.*, coalesce(m.perguntas, 0) AS perguntas
            FROM (VALUES {_catalogue_values()}) c(versao, fonte, padrao, aprovada, tipo, chave, rotulo, descricao)
            LEFT JOIN ({O.MIX}) m ON c.fonte = m.fonte AND c.tipo = m.tipo AND c.chave = m.chave""",
    ),
)
def _(star):
    return catalogue_usage(star.spark, _log_mix(star))
