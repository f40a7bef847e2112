from __future__ import annotations

import random
from collections import defaultdict
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from cantiga.plans.metrics import files_behind, metric_query, spellings
from cantiga.sources.registry import Registry, gravadora_lookup, jdbc_options, parquet_reader, table_registry
from cantiga.sources.relation import Relation

FACT = (
    "periodo string, artista string, plataforma_origem string, tipo_remuneracao string, quantidade decimal(18,4), "
    "valor_royalties decimal(18,4), matched_artista_id int"
)


def dec(value):
    return None if value is None else Decimal(str(value))


def fact_rows():
    rows = [
        ("2026-01", "Ana", "Orchard", "Gravadora", 10, 5, 1),
        ("2026-01", "Ana", "Orchard", "Gravadora", -4, "-1.5", 1),
        ("2026-02", "ana", "DSU", "Shows", 1, 100, 1),
        ("2026-02", "Bia", "Universal", None, None, None, 2),
        ("2026-03", None, "Orchard", "N/D", 3, 0, None),
        ("2026-04", "Bia", "Warner Music", "Gravadora", 7, 2, 99),
        ("2026-04", "O'Brien", "Warner Music", "Gravadora", 7, 2, 3),
    ]
    return [(a, b, c, d, dec(q), dec(v), i) for a, b, c, d, q, v, i in rows]


ARTISTS = [(1, "Selo A"), (2, None), (3, "Selo B"), (50, "Dup 1"), (50, "Dup 2")]


def fact_registry(spark, rows=None, artists=ARTISTS):
    fact = spark.createDataFrame(fact_rows() if rows is None else rows, FACT)
    register = spark.createDataFrame(artists, "id int, gravadora string")
    return Registry(
        {"royalty_performance": lambda: Relation(fact, ("public.fact",), (gravadora_lookup(lambda: register),))}
    )


def rows(result):
    return [tuple(r) for r in result.frame.collect()]


def test_order_has_nulls_last_and_reversals_count(spark):
    result = metric_query(fact_registry(spark), None, ["quantity", "royalties"], ["artist"])
    assert rows(result) == [
        ("Ana", dec(6), dec("3.5")),
        ("Bia", dec(7), dec(2)),
        ("O'Brien", dec(7), dec(2)),
        ("ana", dec(1), dec(100)),
        (None, dec(3), dec(0)),
    ]
    assert result.source == "royalty_performance" and result.source_tables == ("public.fact",)


def test_range_is_cut_to_months_and_both_ends_count(spark):
    result = metric_query(
        fact_registry(spark), None, ["royalties"], ["period"], date_range=("2026-02-20", "2026-03-01")
    )
    assert rows(result) == [("2026-02", dec(100)), ("2026-03", dec(0))]


def test_filter_ignores_case_and_takes_quotes_literally(spark):
    registry = fact_registry(spark)
    assert rows(metric_query(registry, None, ["royalties"], ["artist"], filters={"artist": "ANA"})) == [
        ("Ana", dec("3.5")),
        ("ana", dec(100)),
    ]
    assert rows(metric_query(registry, None, ["royalties"], [], filters={"artist": "o'brien"})) == [(dec(2),)]
    assert rows(metric_query(registry, None, ["royalties"], [], filters={"artist": "' or 1=1 --"})) == [(None,)]


def test_unknown_filter_is_ignored_and_reported(spark):
    result = metric_query(fact_registry(spark), None, ["royalties"], [], filters={"track": "x"})
    assert result.ignored_filters == ("track",)
    assert rows(result) == [(dec("107.5"),)]


def test_label_keeps_unmatched_rows(spark):
    result = metric_query(fact_registry(spark), None, ["royalties", "quantity"], ["gravadora"])
    assert rows(result) == [
        ("Selo A", dec("103.5"), dec(7)),
        ("Selo B", dec(2), dec(7)),
        (None, dec(2), dec(10)),
    ]


def test_filter_on_label(spark):
    result = metric_query(fact_registry(spark), None, ["royalties"], ["period"], filters={"gravadora": "selo a"})
    assert rows(result) == [("2026-01", dec("3.5")), ("2026-02", dec(100))]


def test_repeated_artist_id_fails_only_when_it_is_asked_for(spark):
    probing = [*fact_rows(), ("2026-05", "Cid", "Orchard", "N/D", dec(1), dec(1), 50)]
    with pytest.raises(Exception, match="more than one gravadora"):
        metric_query(fact_registry(spark, probing), None, ["royalties"], ["gravadora"]).frame.collect()


def test_limit_has_a_floor_of_one_and_cuts_by_dimension_order(spark):
    registry = fact_registry(spark)
    assert rows(metric_query(registry, None, ["royalties"], ["artist"], limit=0)) == [("Ana", dec("3.5"))]
    assert len(rows(metric_query(registry, None, ["royalties"], ["artist"], limit=-5))) == 1


def test_default_limit_is_100(spark):
    many = [("2026-01", f"a{i:04d}", "Orchard", "N/D", dec(1), dec(1), None) for i in range(250)]
    registry = fact_registry(spark, many)
    assert len(rows(metric_query(registry, None, ["royalties"], ["artist"]))) == 100
    assert len(rows(metric_query(registry, None, ["royalties"], ["artist"], limit=None))) == 250


def test_dimensions_without_metrics_are_distinct(spark):
    result = metric_query(fact_registry(spark), None, [], ["origem"])
    assert [r[0] for r in rows(result)] == ["DSU", "Orchard", "Universal", "Warner Music"]


def test_empty_table(spark):
    registry = fact_registry(spark, [])
    assert rows(metric_query(registry, None, ["royalties"], ["artist"])) == []
    assert rows(metric_query(registry, None, ["royalties"], [])) == [(None,)]


def test_refusals(spark):
    registry = fact_registry(spark)
    with pytest.raises(ValueError, match="not approved"):
        metric_query(registry, "nope", ["royalties"], [])
    with pytest.raises(ValueError, match="not approved"):
        metric_query(registry, "royalty_performance", ["revenue"], ["artist"])
    with pytest.raises(ValueError, match="not approved"):
        metric_query(registry, "omie_detail", ["royalties"], ["period"])
    with pytest.raises(ValueError, match="metric or a dimension"):
        metric_query(registry, None, [], [])
    with pytest.raises(ValueError, match="Unknown table"):
        registry.relation("omie_detail")


def test_ledger_split_by_sign_counts_null_as_zero(spark):
    entries = spark.createDataFrame(
        [("2026-01-31", "P", "c", "t", dec(10), dec(1)), ("2026-01-01", "P", "c", "t", dec(-4), None),
         ("2026-02-01", "P", "c", "t", None, None), ("2026-02-02", "P", "c", "t", dec(0), None)],
        "data_de_vencimento string, projeto string, categoria string, tipo string, valor_liquido decimal(18,4), "
        "a_pagar_ou_receber decimal(18,4)",
    ).withColumn("data_de_vencimento", __import__("pyspark.sql.functions", fromlist=["to_date"]).to_date("data_de_vencimento"))
    registry = Registry({"omie_detail": lambda: Relation(entries, ("ledger",))})
    result = metric_query(registry, "omie_detail", ["revenue", "cost", "resultado", "payable"], ["period"])
    assert rows(result) == [
        ("2026-01", dec(10), dec(4), dec(6), dec(1)),
        ("2026-02", dec(0), dec(0), dec(0), None),
    ]
    only_null = metric_query(registry, "omie_detail", ["revenue", "resultado"], ["period"], ("2026-02-01", "2026-02-28"))
    assert rows(only_null)[0][1] == 0


def test_channel_takes_one_row_of_a_repeated_key(spark):
    tables = {
        "warner_chappell.stg_warner_statement": spark.createDataFrame(
            [("p", "s", dec(1)), ("p", "s", dec(2)), ("p", "other", dec(4)), (None, "s", dec(8))],
            "income_provider_name string, exploitation_source string, amount_paid_less_tax decimal(18,4)",
        ),
        "warner_chappell.dim_exploitation_source": spark.createDataFrame(
            [("p", "s", "Youtube"), ("p", "s", "Radio")],
            "income_provider_name string, exploitation_source string, descricao_canal string",
        ),
    }
    registry = table_registry(tables.__getitem__)
    result = metric_query(registry, "warner_chappell_detail", ["royalties"], ["platform"])
    assert rows(result) == [("Radio", dec(3)), (None, dec(12))]


def test_hot_artist_gives_the_same_sums_as_a_plain_loop(spark):
    chance = random.Random(5)
    data = []
    for i in range(6000):
        artist = 1 if i % 3 == 0 else chance.randint(1, 400)
        data.append((f"2026-{chance.randint(1, 12):02d}", f"A{artist}", "Orchard", "N/D", dec(1), dec(i % 17), artist))
    artists = [(i, None if i % 2 else f"Selo {i % 7}") for i in range(1, 401)]
    expected = defaultdict(int)
    for row in data:
        expected[(dict(artists)[row[6]], row[0])] += row[5]
    result = metric_query(fact_registry(spark, data, artists), None, ["royalties"], ["gravadora", "period"], limit=None)
    assert {(a, b): c for a, b, c in rows(result)} == dict(expected)


def test_parquet_tables_and_jdbc_options(spark, tmp_path):
    spark.createDataFrame(fact_rows(), FACT).write.parquet(f"{tmp_path}/public/vw_ft_dados_analiticos_union")
    spark.createDataFrame(ARTISTS, "id int, gravadora string").write.parquet(f"{tmp_path}/public/dim_artistas")
    registry = table_registry(parquet_reader(spark, str(tmp_path)))
    result = metric_query(registry, None, ["royalties"], ["gravadora"], limit=1)
    assert rows(result) == [("Selo A", dec("103.5"))]
    assert result.source_tables == ("public.vw_ft_dados_analiticos_union",)
    options = jdbc_options("jdbc:postgresql://h/d", "public.t", "id", 0, 10, 4)
    assert options["numPartitions"] == "4" and options["partitionColumn"] == "id"


def test_rows_without_a_key_are_spread_over_tasks(spark):
    """Most rows unmatched: their null keys must not meet in one partition of the join."""
    from pyspark.sql import functions as F

    from cantiga.sources.relation import any_row_lookup

    frame = spark.range(0, 20_000, 1, 40).select(F.when(F.col("id") % 50 == 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    names = spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        joined = any_row_lookup(["k"], "name", lambda: names).attach(frame)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < 20_000 / 4
    assert joined.columns == ["k", "v", "name"]
    assert joined.count() == 20_000 and joined.where("name = concat('n', k)").count() == 400


def rows_scanned(frame):
    """Rows that the scans of an executed plan gave out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan

    def walk(node):
        node = node.plan() if "QueryStage" in node.nodeName() else node
        own = node.metrics().get("numOutputRows").get().value() if node.nodeName().startswith("Scan parquet") else 0
        return own + sum(walk(node.children().apply(i)) for i in range(node.children().size()))

    return walk(plan)


def test_spellings_let_the_scan_skip_what_is_not_asked_for(spark, tmp_path):
    names = [f"{w}{i:03}" for i in range(40) for w in ("Ana ", "ANA ", "Bia ", "ana ")]
    lines = [("2026-01", name, 1, 2.0) for name in names for _ in range(50)] + [("2026-01", None, 1, 2.0)]
    table = spark.createDataFrame(lines, "periodo_relatorio string, plataforma string, quantidade int, valor_liquido_moeda_conta double")
    table.repartitionByRange(16, "plataforma").sortWithinPartitions("plataforma").write.parquet(f"{tmp_path}/t")
    registry = Registry({"orchard_detail": lambda: Relation(spark.read.parquet(f"{tmp_path}/t"), ("t",))})

    def ask(**more):
        return metric_query(registry, "orchard_detail", ["quantity"], ["platform"], filters={"platform": "aNA 007"}, **more).frame

    assert [tuple(r) for r in ask(find_spellings=True).collect()] == [tuple(r) for r in ask().collect()] == [("ANA 007", 50), ("Ana 007", 50), ("ana 007", 50)]
    assert rows_scanned(ask()) == len(lines)
    assert rows_scanned(ask(find_spellings=True)) < len(lines) / 4
    none = metric_query(registry, "orchard_detail", ["quantity"], ["platform"], filters={"platform": "nobody"}, find_spellings=True).frame
    assert none.collect() == []


def test_too_many_spellings_are_not_listed(spark):
    frame = spark.createDataFrame([("ana",), ("ANA",), ("Ana",), (None,), ("bia",)], "a string").withColumn("n", F.lit(1))
    assert sorted(spellings(frame, "a", "aNa")) == ["ANA", "Ana", "ana"]
    assert spellings(frame, "a", "aNa", most=2) is None and spellings(frame, "n", "1") is None


def test_files_behind_a_question(spark, tmp_path):
    rows = [(f"2026-0{m}", p, m) for m in range(1, 5) for p in ("Orchard", "DSU")]
    table = spark.createDataFrame(rows, "periodo string, plataforma_origem string, quantidade int")
    table.repartition(1).write.partitionBy("periodo", "plataforma_origem").parquet(f"{tmp_path}/t")
    registry = Registry({"royalty_performance": lambda: Relation(spark.read.parquet(f"{tmp_path}/t"), ("public.fato",))})
    found = files_behind(registry, date_range=("2026-02-15", "2026-03-01"), filters={"origem": "orchard", "gravadora": "x"}).collect()
    assert sorted(r.arquivo.split("/")[-3] for r in found) == ["periodo=2026-02", "periodo=2026-03"]
    assert {(r.fonte, r.tabela, r.linhas) for r in found} == {("royalty_performance", "public.fato", 1)} and all(r.bytes > 0 for r in found)
    assert files_behind(registry).count() == 8 and files_behind(registry, date_range=("2030-01-01", None)).count() == 0
