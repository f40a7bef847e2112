"""DuckDB SQL for the registered queries, written straight on the given tables."""

from __future__ import annotations

import re
import unicodedata

from cantiga import vocabulary as V
from cantiga.catalog import SOURCES
from checks.questions import AS_OF_QUESTIONS, TEMPLATES

HOLIDAY_NAMES = {
    "01-01": "Confraternizacao Universal", "04-21": "Tiradentes", "05-01": "Dia do Trabalho", "09-07": "Independencia do Brasil",
    "10-12": "Nossa Senhora Aparecida", "11-02": "Finados", "11-15": "Proclamacao da Republica", "12-25": "Natal",
}


def _holiday(day: str) -> str:
    """The name of the holiday on ``day``; Easter by Oudin's rule, a month and a day number."""
    y = f"year({day})"
    g, c = f"({y} % 19)", f"({y} // 100)"
    h = f"(({c} - {c} // 4 - (8 * {c} + 13) // 25 + 19 * {g} + 15) % 30)"
    i = f"({h} - ({h} // 28) * (1 - (29 // ({h} + 1)) * ((21 - {g}) // 11)))"
    n = f"({i} - ({y} + {y} // 4 + {i} + 2 - {c} + {c} // 4) % 7)"
    month = f"(3 + ({n} + 40) // 44)"
    easter = f"make_date({y}, {month}, {n} + 28 - 31 * ({month} // 4))"
    fixed = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in HOLIDAY_NAMES.items())
    moved = "WHEN -48 THEN 'Carnaval' WHEN -47 THEN 'Carnaval' WHEN -2 THEN 'Sexta-feira Santa' WHEN 60 THEN 'Corpus Christi'"
    return f"coalesce(CASE strftime({day}, '%m-%d') {fixed} END, CASE {day} - {easter} {moved} END)"


def _calendar(span: str) -> str:
    return f"""
    SELECT strftime(d, '%Y-%m') AS ano_mes, d AS data,
           ['domingo', 'segunda', 'terca', 'quarta', 'quinta', 'sexta', 'sabado'][dayofweek(d) + 1] AS dia_semana,
           CAST(day(d) AS INTEGER) AS dia_numero,
           dayofweek(d) IN (0, 6) AS fim_de_semana,
           {_holiday('d')} IS NOT NULL AS feriado,
           {_holiday('d')} AS nome_feriado,
           CAST(NULL AS VARCHAR) AS uf_feriado,
           dayofweek(d) IN (5, 6) OR {_holiday('(d + 1)')} IS NOT NULL AS dia_critico
    FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM ({span}))"""


CTES = {
    "cust": """
    SELECT c_custkey, c_name, c_mktsegment, n_name, r_name
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "line": """
    SELECT l.*, o.o_custkey, o.o_orderdate, o.o_orderpriority, c.*,
           CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4)) AS val,
           strftime(l_shipdate, '%Y-%m') AS mes, CAST(l_quantity AS INTEGER) AS qtd,
           'BR' || lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS isrc,
           CASE WHEN p_partkey % 170 = 0 THEN repeat('?', length(p_name)) WHEN p_partkey % 190 = 0 THEN 'Sol d''Ouro' ELSE p_name END AS faixa,
           p_name, p_brand, p_type, s_name
    FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN cust c ON o_custkey = c_custkey
    LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey""",
    "artists": """
    SELECT c_custkey AS id, c_name AS nome_artistico,
           CASE WHEN c_custkey % 20 = 0 THEN c_mktsegment END AS gravadora,
           CASE WHEN c_custkey % 50 = 0 THEN upper(c_name)
                WHEN c_custkey % 20 = 0 THEN upper(substr(c_name, 1, 17)) END AS artista_keyword,
           CASE WHEN c_custkey % 3 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' - ' || c_name END AS dsu_artista,
           CASE WHEN c_custkey % 40 = 0 THEN 'Brand#' || CAST((c_custkey // 40) % 25 + 1 AS VARCHAR) END
               AS universal_compositor,
           CASE WHEN c_custkey % 4 = 0 THEN [c_name, upper(c_name)] END AS warner_chappel_deal_scope_name,
           CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) END AS warner_music_artist_name
    FROM customer""",
    "found": """
    SELECT 'DSU' AS plataforma_origem, dsu_artista AS chave_artista, min(id) AS id
    FROM artists WHERE dsu_artista IS NOT NULL GROUP BY 2
    UNION ALL
    SELECT 'Orchard', nome, id FROM (
        SELECT n.c_name AS nome, k.id,
               row_number() OVER (PARTITION BY n.c_name ORDER BY length(k.artista_keyword) DESC, k.id) AS rn
        FROM (SELECT DISTINCT c_name FROM cust WHERE r_name = 'AMERICA') n
        JOIN artists k ON n.c_name ILIKE '%' || k.artista_keyword || '%') WHERE rn = 1
    UNION ALL
    SELECT 'Universal', CAST(p_partkey AS VARCHAR), id FROM part
    JOIN (SELECT universal_compositor AS comp, min(id) AS id FROM artists WHERE universal_compositor IS NOT NULL GROUP BY 1)
      ON p_brand = comp
    UNION ALL
    SELECT 'Warner Chappell', k, min(id)
    FROM (SELECT unnest(warner_chappel_deal_scope_name) AS k, id FROM artists) GROUP BY 2
    UNION ALL
    SELECT 'Warner Music', warner_music_artist_name, min(id)
    FROM artists WHERE warner_music_artist_name IS NOT NULL GROUP BY 2""",
    "matches": """
    SELECT f.plataforma_origem, f.chave_artista, a.id AS matched_artista_id,
           CASE WHEN f.plataforma_origem = 'Orchard' THEN a.artista_keyword END AS matched_artista_keyword,
           a.nome_artistico AS artista_casado
    FROM found f JOIN artists a ON f.id = a.id""",
    "cal": _calendar("SELECT DATE '1998-01-01' AS a, DATE '1999-12-31' AS b"),
    "status_rows": """
    SELECT l_orderkey AS contrato, l_linenumber AS id, l_shipdate AS inserted_at,
           CASE l_returnflag WHEN 'R' THEN 'CONFIRMADO' WHEN 'N' THEN 'FINANCEIRO/AGUARDAR'
                             WHEN 'A' THEN 'CANCELADO/REMARCAR' END AS status,
           l_linestatus AS tag, CAST(l_extendedprice AS DECIMAL(18, 4)) AS valor,
           CAST(l_extendedprice * l_discount AS DECIMAL(18, 4)) AS falta_receber,
           CAST(l_extendedprice AS DECIMAL(18, 4)) - CAST(l_extendedprice * l_discount AS DECIMAL(18, 4)) AS valor_liquido,
           l_partkey, l_suppkey
    FROM lineitem""",
    "latest": """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY contrato
                  ORDER BY inserted_at DESC, id DESC, l_partkey DESC, l_suppkey DESC, valor DESC) AS rn
        FROM status_rows) WHERE rn = 1""",
    "contracts": """
    SELECT t.*, CAST(o_orderdate AS DATE) AS dt_show, o_orderpriority AS vendedor, o_orderstatus AS tipo_evento,
           'contratos_' || o_orderpriority AS source_file,
           lpad(CAST(c_custkey AS VARCHAR), 6, '0') || ' - ' || c_name AS artista, n_name AS uf,
           'CIDADE_' || CAST(c_custkey % 97 AS VARCHAR) AS cidade, c_mktsegment AS "local", c_mktsegment AS razao_social,
           r_name AS regiao, s_name AS contratante,
           dia_semana, fim_de_semana, feriado, nome_feriado, uf_feriado, dia_critico
    FROM latest t JOIN orders ON contrato = o_orderkey LEFT JOIN cust ON o_custkey = c_custkey
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN cal ON data = CAST(o_orderdate AS DATE)""",
    "branches": """
    SELECT strftime(dt_show, '%Y-%m') AS periodo, strftime(dt_show, '%Y-%m') AS periodo_receita,
           artista AS artista_raw, artista AS chave_artista, 'DSU' AS plataforma_origem, 'Shows' AS tipo_remuneracao,
           CAST(1 AS DECIMAL(18, 4)) AS quantidade, CAST(valor_liquido AS DECIMAL(18, 4)) AS valor_royalties,
           'ft_dsu_dados_analiticos' AS tabela_origem, razao_social
    FROM contracts WHERE status = 'CONFIRMADO' AND regiao = 'AFRICA'
    UNION ALL
    SELECT mes, strftime(CAST(mes || '-01' AS DATE) + INTERVAL 3 MONTH, '%Y-%m'),
           CASE r_name WHEN 'MIDDLE EAST' THEN upper(c_name) ELSE c_name END,
           CASE r_name WHEN 'MIDDLE EAST' THEN upper(c_name) WHEN 'ASIA' THEN CAST(l_partkey AS VARCHAR) ELSE c_name END,
           CASE r_name WHEN 'AMERICA' THEN 'Orchard' WHEN 'ASIA' THEN 'Universal' WHEN 'EUROPE' THEN 'Warner Chappell'
                       ELSE 'Warner Music' END,
           CASE l_returnflag WHEN 'A' THEN 'Editora' WHEN 'N' THEN 'Gravadora' WHEN 'R' THEN 'Publicidade' END,
           CAST(l_quantity AS DECIMAL(18, 4)), val,
           CASE r_name WHEN 'AMERICA' THEN 'ft_orchard_dados_analiticos' WHEN 'ASIA' THEN 'ft_universal_dados_analiticos'
                       WHEN 'EUROPE' THEN 'stg_warner_statement' ELSE 'ft_warner_music_dados_analiticos' END,
           c_mktsegment
    FROM line WHERE r_name <> 'AFRICA'""",
    "fact": """
    SELECT b.*, coalesce(artista_casado, artista_raw) AS artista, matched_artista_id, matched_artista_keyword,
           r.gravadora
    FROM branches b LEFT JOIN matches m USING (plataforma_origem, chave_artista) LEFT JOIN artists r ON r.id = matched_artista_id""",
    "ledger_rows": """
    SELECT 'user_' || CAST(user_id AS VARCHAR) AS projeto,
           CASE WHEN event_type IN ('purchase', 'signup') THEN 'Contas a receber' ELSE 'Contas a pagar' END AS tipo,
           event_type AS grupo, event_type AS categoria, CAST(ts AS DATE) AS data_de_vencimento,
           CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 51 = 0 THEN 0
                WHEN event_type IN ('purchase', 'signup') THEN CAST(value AS DECIMAL(18, 4))
                ELSE -CAST(value AS DECIMAL(18, 4)) END AS valor_liquido,
           CASE WHEN event_type = 'click' THEN CAST(value AS DECIMAL(18, 4)) END AS a_pagar_ou_receber
    FROM events""",
    "channel": """
    SELECT prov, src, min(canal) AS descricao_canal
    FROM (VALUES ('A', 'F', 'Radio'), ('A', 'O', 'Spotify'), ('N', 'F', 'TV'), ('R', 'O', 'Youtube'),
                 ('R', 'O', 'Youtube Music')) v(prov, src, canal) GROUP BY 1, 2""",
    # ---- the sources with the names of their metrics and dimensions
    "src_royalty_performance": """
    SELECT periodo AS period, artista AS artist, plataforma_origem AS origem, tipo_remuneracao AS revenue_type, gravadora,
           quantidade AS v_quantity, valor_royalties AS v_royalties FROM fact""",
    "src_dsu_detail": """
    SELECT strftime(dt_show, '%Y-%m') AS period, artista AS artist, uf AS territory, cidade AS city, "local" AS venue, status,
           contratante, vendedor, tipo_evento, dia_critico, valor_liquido AS v_royalties, 1 AS v_shows FROM contracts""",
    "src_omie_detail": """
    SELECT strftime(data_de_vencimento, '%Y-%m') AS period, projeto AS artist, categoria AS category, tipo AS type,
           CASE WHEN valor_liquido >= 0 THEN valor_liquido ELSE 0 END AS v_revenue,
           CASE WHEN valor_liquido <= 0 THEN valor_liquido * -1 ELSE 0 END AS v_cost,
           valor_liquido AS v_resultado, a_pagar_ou_receber AS v_payable
    FROM ledger_rows WHERE grupo IN ('purchase', 'signup', 'error', 'click')""",
    "src_orchard_detail": """
    SELECT mes AS period, coalesce(artista_casado, c_name) AS artist, faixa AS track, isrc, n_name AS territory,
           p_brand AS platform, l_returnflag AS revenue_type, val AS v_royalties, qtd AS v_quantity
    FROM line LEFT JOIN matches ON plataforma_origem = 'Orchard' AND chave_artista = c_name WHERE r_name = 'AMERICA'""",
    "src_somlivre_detail": """
    SELECT strftime(ts, '%Y-%m') AS period, 'user_' || CAST(user_id AS VARCHAR) AS artist,
           json_extract_string(props, '$.k') AS track, event_type AS platform,
           CAST(value AS DECIMAL(18, 4)) AS v_royalties, event_id % 7 - 1 AS v_quantity FROM events""",
    "src_universal_detail": """
    SELECT mes AS period, coalesce(artista_casado, c_name) AS artist, p_name AS track, p_brand AS composer,
           p_type AS platform, l_returnflag AS revenue_type, val AS v_royalties, qtd AS v_quantity
    FROM line LEFT JOIN matches ON plataforma_origem = 'Universal' AND chave_artista = CAST(l_partkey AS VARCHAR)
    WHERE r_name = 'ASIA'""",
    "src_warner_chappell_detail": """
    SELECT mes AS period, c_name || ' / ' || s_name AS artist, faixa AS track, s_name AS composer, n_name AS territory,
           descricao_canal AS platform, l_returnflag AS revenue_type, val AS v_royalties, qtd AS v_quantity
    FROM line LEFT JOIN channel ON prov = l_returnflag AND src = l_linestatus WHERE r_name = 'EUROPE'""",
    "src_warner_music_detail": """
    SELECT mes AS period, upper(c_name) AS artist, faixa AS track, isrc, n_name AS territory, p_brand AS platform,
           val AS v_royalties, qtd AS v_quantity FROM line WHERE r_name = 'MIDDLE EAST'""",
}

# Metrics that are whole numbers; the others are money.
WHOLE = {("dsu_detail", "shows")} | {
    (s, "quantity")
    for s in ("orchard_detail", "somlivre_detail", "universal_detail", "warner_chappell_detail", "warner_music_detail")
}


def with_ctes(body: str) -> str:
    """``body`` with the CTEs it names, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    return f"WITH {parts}\n{body}"


def metric_sql(source, metrics=(), dimensions=(), where="", limit=None) -> str:
    sums = []
    for m in metrics:
        if (source, m) in WHOLE:
            total = f"coalesce(sum(v_{m}), 0)" if m == "shows" else f"sum(v_{m})"
            sums.append(f"CAST({total} AS BIGINT) AS {m}")
        else:
            sums.append(f"CAST(sum(CAST(v_{m} AS DECIMAL(18, 4))) AS DOUBLE) AS {m}")
    dims = ", ".join(dimensions)
    columns = ", ".join([*dimensions, *sums])
    group = f" GROUP BY {dims}" if dimensions else ""
    order = " ORDER BY " + ", ".join(f"{d} ASC NULLS LAST" for d in dimensions) if limit and dimensions else ""
    tail = f" LIMIT {limit}" if limit else ""
    condition = f" WHERE {where}" if where else ""
    return with_ctes(f"SELECT {columns} FROM src_{source}{condition}{group}{order}{tail}")


def percent_sql(part: str, whole: str) -> str:
    """One decimal, half away from zero, in whole numbers."""
    return (
        f"CASE WHEN ({whole}) = 0 THEN NULL ELSE "
        f"CAST((CAST({part} AS BIGINT) * 2000 + ({whole})) // (2 * ({whole})) AS DOUBLE) / 10 END"
    )


# ---- routing -----------------------------------------------------------------


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(n, {_text(w)})" for w in words) + ")"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]::VARCHAR[]"


def _tag_list(words: dict[str, list[str]], default: list[str]) -> str:
    tags = ", ".join(f"CASE WHEN {_any(w)} THEN {_text(k)} END" for k, w in words.items())
    found = f"list_filter([{tags}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE {_list(default)} END"


def _source_case(values: dict[str, list[str]]) -> str:
    return "CASE src " + " ".join(f"WHEN {_text(s)} THEN {_list(v)}" for s, v in values.items()) + " END"


def routing_ctes(questions: str, as_of: str) -> str:
    """CTEs ending in ``routed`` for ``questions`` with columns id, t and given source g."""
    day = f"DATE '{as_of}'"
    standalone = " ".join(f"WHEN {_any(w)} THEN {_text(s)}" for s, w in V.SOURCE_WORDS.items())
    track = _any(V.TRACK_WORDS)
    platform = " ".join(
        f"WHEN {track} AND {_any([_plain(x) for x in w])} THEN {_text(s)}" for s, w in V.PLATFORM_WORDS.items()
    )
    filters = {
        f: "CASE "
        + " ".join(f"WHEN {_any([_plain(x) for x in w])} THEN {_text(v)}" for v, w in values.items())
        + " END"
        for f, values in V.FILTER_WORDS.items()
    }
    relative = " ".join(
        f"WHEN {_any(w)} THEN [strftime({day} - {a}, '%Y-%m-%d'), strftime({day} - {b}, '%Y-%m-%d')]"
        for w, a, b in V.RELATIVE_DAYS
    )
    metrics = {s.name: list(s.metrics) for s in SOURCES.values()}
    dims = {s.name: list(s.dimensions) for s in SOURCES.values()}
    detail_a, detail_b = V.NOTE_DETAIL.split("{source}")
    source_a, source_b = V.NOTE_SOURCE.split("{source}")
    return f"""
    q0 AS (SELECT *, strip_accents(lower(t)) AS n FROM ({questions})),
    q1 AS (SELECT *, CASE WHEN coalesce(g, '') <> '' THEN g {standalone} {platform}
                     ELSE {_text(V.DEFAULT_SOURCE)} END AS src0,
                  regexp_extract_all(t, '{V.ISO_DAY}') AS days,
                  regexp_extract(n, '{V.LAST_DAYS}', 2) AS nd FROM q0),
    q2 AS (SELECT *, CASE WHEN list_contains({_list(SOURCES)}, src0) THEN src0 ELSE {_text(V.DEFAULT_SOURCE)} END AS src FROM q1),
    q3 AS (SELECT *, {_source_case(metrics)} AS all_m, {_source_case(dims)} AS all_d,
                  {_tag_list(V.METRIC_WORDS, V.DEFAULT_METRICS)} AS m0,
                  {_tag_list(V.DIMENSION_WORDS, V.DEFAULT_DIMENSIONS)} AS d0,
                  CASE WHEN len(days) >= 2 THEN [days[1], days[2]] WHEN len(days) = 1 THEN [days[1], days[1]]
                       WHEN nd <> '' THEN [strftime({day} - greatest(CAST(nd AS INTEGER) - 1, 0), '%Y-%m-%d'),
                                           strftime({day}, '%Y-%m-%d')]
                       {relative} END AS rng FROM q2),
    q4 AS (SELECT *, list_filter(m0, lambda x: list_contains(all_m, x)) AS m1,
                  list_filter(d0, lambda x: list_contains(all_d, x)) AS d1 FROM q3),
    routed AS (SELECT id, src AS rota_source,
                  CASE WHEN len(m1) > 0 THEN m1 ELSE all_m[1:2] END AS ms,
                  CASE WHEN len(d1) > 0 THEN d1 ELSE all_d[1:1] END AS ds,
                  CASE WHEN list_contains(all_d, 'origem') THEN {filters['origem']} END AS filtro_origem,
                  CASE WHEN list_contains(all_d, 'revenue_type') THEN {filters['revenue_type']} END AS filtro_revenue_type,
                  rng[1] AS rota_start_date, rng[2] AS rota_end_date,
                  list_filter([CASE WHEN coalesce(g, '') = '' THEN {_text(source_a)} || src || {_text(source_b)} END,
                    {_text(V.NOTE_METRICS)}, {_text(V.NOTE_DIMENSIONS)},
                    CASE WHEN rng IS NULL THEN {_text(V.NOTE_NO_RANGE)} END,
                    CASE WHEN rng IS NOT NULL AND list_contains(all_d, 'period') THEN {_text(V.NOTE_MONTHS)} END,
                    CASE WHEN src <> {_text(V.DEFAULT_SOURCE)} THEN {_text(detail_a)} || src || {_text(detail_b)} END],
                    lambda x: x IS NOT NULL) AS notes FROM q4)"""


QUESTION_LOG = f"""
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'universal_detail'
                                  WHEN o_orderkey % 13 = 0 THEN 'does_not_exist' END AS g,
           replace(replace(replace(({_list(TEMPLATES)})[CAST(o_orderkey % {len(TEMPLATES)} AS INTEGER) + 1],
             '<n>', CAST(o_orderkey % 40 AS VARCHAR)), '<dia>', strftime(o_orderdate, '%Y-%m-%d')),
             '<fim>', strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d')) AS t
    FROM orders"""
MESSAGES = "SELECT conv_id * 1000 + turn AS id, CAST(NULL AS VARCHAR) AS g, text AS t FROM conversations"

ROUTED_COLUMNS = """id, rota_source, array_to_string(ms, ',') AS rota_metrics, array_to_string(ds, ',') AS rota_dimensions,
    filtro_origem, filtro_revenue_type, rota_start_date, rota_end_date, array_to_string(notes, ' | ') AS rota_notes"""


def routing_sql(questions: str, body: str) -> str:
    return f"WITH {routing_ctes(questions, AS_OF_QUESTIONS)}\n{body}"


MIX = """
    SELECT rota_source AS fonte, tipo, chave, count(*) AS perguntas FROM (
        SELECT rota_source, 'source' AS tipo, rota_source AS chave FROM routed
        UNION ALL SELECT rota_source, 'metric', unnest(ms) FROM routed
        UNION ALL SELECT rota_source, 'dimension', unnest(ds) FROM routed) GROUP BY ALL"""
