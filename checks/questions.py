"""A question log derived from the orders table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AS_OF_QUESTIONS = "2026-06-26"

# Sentences with known routes.  <n>, <dia> and <fim> are filled per order.
TEMPLATES = [
    "Como foram quantidade e royalties por artista nos ultimos <n> dias?",
    "Mostre royalties da Orchard por tipo de royalty",
    "Qual foi a receita da empresa no ultimo mes?",
    "Quanto foi o custo em fevereiro?",
    "Mostre dados do Omie por projeto",
    "Quais faixas da Orchard mais tocaram por artista?",
    "Quanto os shows geraram de receita por artista?",
    "Receita por artista",
    "Como foi a receita no ultimo ano?",
    "Royalties por gravadora",
    "Royalties de <dia> a <fim> por período e país",
    "Repasse em <dia> na Warner Chappel por compositor da obra",
    "Quantas MÚSICAS da Sony tocaram ontem por plataforma?",
    "Reproduções da Universal por canção, hoje",
    "Direitos autorais da Warner Music na última semana",
    "Apresentação e bilheteria da turnê last 7 days",
    "Royalties das últimas <n> dias por origem e rubrica",
    "Como o intérprete recebeu arrecadação?",
]


def question_log(orders: DataFrame) -> DataFrame:
    """One question per order, with a stated source on some."""
    key = F.col("o_orderkey")
    template = F.element_at(F.array(*[F.lit(t) for t in TEMPLATES]), (key % len(TEMPLATES)).cast("int") + 1)
    text = F.replace(template, F.lit("<n>"), (key % 40).cast("string"))
    text = F.replace(text, F.lit("<dia>"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    text = F.replace(text, F.lit("<fim>"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd"))
    return orders.select(
        key.alias("id"),
        text.alias("texto"),
        F.when(key % 11 == 0, "universal_detail").when(key % 13 == 0, "does_not_exist").alias("fonte_dada"),
    )
