"""Words and messages of the question router."""

from __future__ import annotations

# The router must answer with exactly these keys, words, values
# and messages, in this order.

DEFAULT_SOURCE = "royalty_performance"
DEFAULT_METRICS = ["quantity", "royalties"]
DEFAULT_DIMENSIONS = ["artist"]

METRIC_WORDS = {
    "quantity": ["quantidade", "streams", "unidades", "shows", "quantity", "reproduções", "reproducoes",
                 "playback", "plays", "play"],
    "royalties": ["royalties", "royalty", "direitos autorais", "remuneracao autoral", "remuneração autoral",
                  "repasse", "arrecadação", "monetização"],
    "revenue": ["receita", "faturamento"],
    "cost": ["custo", "custos", "despesa", "despesas"],
}

DIMENSION_WORDS = {
    "artist": ["artista", "artist", "cantor", "cantora", "banda", "grupo", "mc", "dj", "intérprete", "talento",
               "dupla", "projeto", "collab", "colab"],
    "origem": ["origem", "distribuidora", "sistema de origem", "publisher", "plataforma", "fonte"],
    "revenue_type": ["tipo de royalty", "categoria de royalty", "tipo de receita", "categoria de receita",
                     "revenue type", "tipo de arrecadacao", "tipo de faturamento", "rubrica", "linha de receita"],
    "period": ["periodo", "por mes", "por data", "mensal", "anual", "trimestre", "semestre", "data", "dia", "ano",
               "mês", "temporalidade", "época", "período"],
    "track": ["faixa", "musica", "música", "cancao", "canção", "track", "som", "áudio", "single", "beat", "melodia",
              "composição", "obra", "fonograma"],
    "composer": ["compositor", "composer", "autor", "escritor", "letrista", "coautor", "co-autor", "criador"],
    "isrc": ["isrc", "código isrc", "cod isrc", "registro isrc", "identificador", "id da faixa"],
    "territory": ["territorio", "pais", "country"],
    "platform": ["plataforma", "dsp", "canal", "loja", "serviço", "app", "aplicativo", "streaming", "rede social"],
    "gravadora": ["gravadora", "label", "selo", "master", "master rights", "produtora", "companhia",
                  "produtora fonográfica"],
    "contratante": ["contratante", "cliente", "parceiro", "promotor", "produtor de evento", "organizador",
                    "patrocinador", "comprador"],
    "vendedor": ["vendedor", "responsavel comercial", "agente comercial", "comercial", "executivo de contas",
                 "representante", "booker", "negociador"],
    "tipo_evento": ["tipo de evento", "tipo evento", "formato do evento", "categoria do evento",
                    "estilo do evento", "formato de show"],
    "dia_critico": ["dia critico", "dia ideal", "noite livre", "dia de show", "dia de evento", "data de evento",
                    "dia principal", "data de show", "data chave"],
}

FILTER_WORDS = {
    "origem": {
        "DSU": ["dsu"],
        "Orchard": ["orchard"],
        "Universal": ["universal"],
        "Warner Chappell": ["warner chappell", "warner chappel", "warner chapel"],
        "Warner Music": ["warner music"],
    },
    "revenue_type": {
        "Editora": ["editora", "publisher", "publishing", "autoral", "direitos autorais"],
        "Gravadora": ["gravadora", "master", "label", "selo", "master rights"],
        "Publicidade": ["publicidade", "advertising"],
        "Shows": ["shows", "show ao vivo", "evento", "eventos", "contrato de show", "apresentação", "apresentacoes",
                  "bilheteria", "cachê", "cache", "tour", "turnê", "turne", "gig", "conserto"],
    },
}

# A word of these names the source by itself.
SOURCE_WORDS = {
    "dsu_detail": ["show", "shows", "evento", "eventos", "contrato de show"],
    "omie_detail": ["omie", "financeiro", "fluxo de caixa", "contas a pagar", "contas a receber", "erp", "receita",
                    "custo", "custos", "despesa", "despesas", "lucro", "resultado"],
}

# A word of these names the source only next to a word of TRACK_WORDS.
PLATFORM_WORDS = {
    "orchard_detail": ["orchard"],
    "somlivre_detail": ["som livre", "somlivre", "sony music", "sony"],
    "universal_detail": ["universal"],
    "warner_chappell_detail": ["warner chappell", "warner chappel"],
    "warner_music_detail": ["warner music"],
}

TRACK_WORDS = ["faixa", "musica", "compositor", "isrc", "obra", "cancao", "track"]

ISO_DAY = r"\b\d{4}-\d{2}-\d{2}\b"
LAST_DAYS = r"(ultimos|ultimas|last)\s+(\d+)\s+dias"

# (words, first day counted back from today, last day counted back from today)
RELATIVE_DAYS = [
    (["ontem", "yesterday"], 1, 1),
    (["hoje", "today"], 0, 0),
    (["ultima semana", "last week"], 6, 0),
    (["ultimo mes", "last month"], 29, 0),
    (["ultimo ano", "last year"], 364, 0),
]

NOTE_SOURCE = "Fonte inferida a partir da pergunta: '{source}'."
NOTE_METRICS = "Metricas inferidas a partir da pergunta."
NOTE_DIMENSIONS = "Dimensoes inferidas a partir da pergunta."
NOTE_NO_RANGE = "Sem intervalo explicito; a consulta usara todo o historico disponivel."
NOTE_OPEN_START = "O numero de dias pedido nao cabe no calendario; o inicio do intervalo ficou aberto."
NOTE_MONTHS = "Dados armazenados em grao mensal (period); o intervalo de datas e truncado para o mes."
NOTE_DETAIL = (
    "Fonte '{source}' e um detalhe de uma unica plataforma — nao combinar/agregar "
    "com a view unificada nem com outra fonte de detalhe."
)
