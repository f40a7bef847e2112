from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from cantiga.operators.calendar import build_calendar, easter_sunday, with_calendar
from cantiga.operators.latest import change_counts, latest_per_key, status_changes
from cantiga.operators.ledger import active_ledger, category_drift
from cantiga.operators.matching import anchored, artist_lookup, artist_matches, match_keyword, name_pieces
from cantiga.operators.unify import show_branch, unify
from cantiga.sources.relation import Relation

HISTORY = "contrato string, id int, inserted_at timestamp_ntz, status string"


def test_latest_row_and_ties(spark):
    t1, t2 = datetime(2026, 1, 1), datetime(2026, 1, 2)
    frame = spark.createDataFrame(
        [("a", 1, t1, "AGUARDAR"), ("a", 2, t2, "CONFIRMADO"), ("b", 3, t1, "X"), ("b", 4, t1, "Y"), ("c", 5, None, "Z"),
         ("c", 6, t1, "W")],
        HISTORY,
    )
    latest = latest_per_key(frame, ["contrato"], ["inserted_at", "id"])
    assert {r.contrato: r.status for r in latest.collect()} == {"a": "CONFIRMADO", "b": "Y", "c": "W"}
    assert latest.columns == frame.columns


def test_status_changes_equal_a_plain_loop_with_a_hot_contract(spark):
    chance = random.Random(3)
    rows = []
    for i in range(3000):
        contract = "hot" if i % 3 == 0 else f"c{chance.randint(1, 300)}"
        moment = datetime(2026, 1, 1) + timedelta(hours=chance.randint(0, 4000))
        rows.append((contract, i, moment, chance.choice(["A", "B", "C", None])))
    history = {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        history.setdefault(row[0], []).append(row[3])
    expected = Counter()
    for states in history.values():
        expected.update((a, b) for a, b in zip(states, states[1:]) if a != b)
    for parts in ("1", "5", "40"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            changes = status_changes(spark.createDataFrame(rows, HISTORY), ["contrato"], "status", ["inserted_at", "id"])
            got = {(r.de_status, r.para_status): r.mudancas for r in change_counts(changes).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == dict(expected), parts


def calendar(spark, first="2026-01-01", last="2026-12-31", bridges=None):
    span = spark.range(1).select(F.lit(first).cast("date").alias("inicio"), F.lit(last).cast("date").alias("fim"))
    return build_calendar(span, None, bridges)


def test_calendar_marks_fridays_saturdays_and_eves(spark):
    days = {r.data: r for r in calendar(spark).collect()}
    assert len(days) == 365
    assert days[date(2026, 1, 2)].dia_critico and days[date(2026, 1, 2)].dia_semana == "sexta"
    assert days[date(2026, 1, 3)].dia_critico and days[date(2026, 1, 3)].fim_de_semana
    assert not days[date(2026, 1, 4)].dia_critico and days[date(2026, 1, 4)].fim_de_semana
    assert days[date(2026, 4, 20)].dia_critico and not days[date(2026, 4, 20)].feriado
    assert days[date(2026, 4, 21)].feriado and days[date(2026, 4, 21)].nome_feriado == "Tiradentes"
    assert not days[date(2026, 4, 21)].dia_critico
    assert days[date(2026, 12, 31)].dia_critico, "the holiday after the end still has an eve"
    assert days[date(2026, 3, 4)].ano_mes == "2026-03" and days[date(2026, 3, 4)].dia_numero == 4


def test_holidays_hold_in_every_year(spark):
    days = {r.data: r for r in calendar(spark, "2031-12-30", "2045-12-31").collect()}
    for year in range(2032, 2046):
        assert days[date(year, 4, 21)].nome_feriado == "Tiradentes" and days[date(year, 4, 20)].dia_critico
    assert days[date(2031, 12, 31)].dia_critico


def test_listed_holidays_replace_the_fixed_ones(spark):
    span = spark.range(1).select(F.lit("2026-04-01").cast("date").alias("inicio"), F.lit("2026-04-30").cast("date").alias("fim"))
    listed = spark.createDataFrame([(date(2026, 4, 8), "Local", "SP"), (date(2026, 4, 8), "Local", "SP")], "data date, nome_feriado string, uf_feriado string")
    days = {r.data: r for r in build_calendar(span, listed).collect()}
    assert len(days) == 30 and not days[date(2026, 4, 21)].feriado
    assert (days[date(2026, 4, 8)].nome_feriado, days[date(2026, 4, 8)].uf_feriado, days[date(2026, 4, 7)].dia_critico) == ("Local", "SP", True)


def test_calendar_takes_bridge_days(spark):
    bridges = spark.createDataFrame([(date(2026, 4, 22),), (date(2026, 4, 22),)], "data date")
    days = {r.data: r.dia_critico for r in calendar(spark, bridges=bridges).collect()}
    assert len(days) == 365 and days[date(2026, 4, 22)] and not days[date(2026, 4, 23)]


def test_show_outside_the_calendar_is_unknown_not_false(spark):
    shows = spark.createDataFrame([("a", date(2025, 1, 3)), ("b", date(2026, 1, 2)), ("c", None)], "contrato string, dt_show date")
    got = {r.contrato: r.dia_critico for r in with_calendar(shows, calendar(spark)).collect()}
    assert got == {"a": None, "b": True, "c": None}


def test_keyword_match_equals_comparing_all_pairs(spark):
    chance = random.Random(11)
    letters = "abAB ç%_"
    names = ["".join(chance.choice(letters) for _ in range(chance.randint(0, 14))) for _ in range(300)] + [None, "MC Ana & Bia"]
    keywords = [(i, "".join(chance.choice(letters) for _ in range(chance.randint(1, 4)))) for i in range(40)]
    keywords += [(100, None), (101, ""), (102, "mc ana"), (103, "BIA"), (7, "MC ANA")]
    expected = {}
    for name in {n for n in names if n is not None}:
        hits = [(-len(k), i) for i, k in keywords if k and k.lower() in name.lower()]
        if hits:
            expected[name] = min(hits)[1]
    got = match_keyword(
        spark.createDataFrame([(n,) for n in names], "nome string"),
        spark.createDataFrame(keywords, "id int, keyword string"),
    )
    assert {r.nome: r.id for r in got.collect()} == expected
    assert expected["MC Ana & Bia"] == 7


def test_names_give_one_piece_for_each_place(spark):
    """Whatever the lengths of the keywords."""
    names = spark.createDataFrame([("abcdefghij",), ("abcdefghij",), ("xyz",), ("",), (None,)], "nome string")
    assert name_pieces(names).count() == 10 + 3


def test_keywords_are_anchored_by_their_rarest_piece(spark):
    names = spark.createDataFrame([(f"customer {i}",) for i in range(20)] + [("customer zeta",)], "nome string")
    words = spark.createDataFrame([("customer zeta", 1), ("customer", 2), ("tome", 3), ("zz", 4), ("quux customer", 5)], "word string, best int")
    pieces = name_pieces(names)
    found = {r.word: r.gram for r in anchored(words, pieces).collect()}
    # No name has a piece of the last two.
    assert set(found) == {"customer zeta", "customer", "tome"}
    assert found["tome"] == "tome" and "z" in found["customer zeta"]
    by_name = {r.nome: r.id for r in match_keyword(names, words.selectExpr("best as id", "word as keyword")).collect()}
    assert by_name["customer zeta"] == 1 and by_name["customer 3"] == 2


def easter(year):
    """By the full moons of the lectionary, step by step."""
    golden = year % 19 + 1
    century = year // 100 + 1
    solar, lunar = 3 * century // 4 - 12, (8 * century + 5) // 25 - 5
    sunday = 5 * year // 4 - solar - 10
    epact = (11 * golden + 20 + lunar - solar) % 30
    if epact == 24 or (epact == 25 and golden > 11):
        epact += 1
    moon = 44 - epact
    if moon < 21:
        moon += 30
    moon += 7 - (sunday + moon) % 7
    return date(year, 3, 1) + timedelta(days=moon - 1)


def test_easter_of_three_centuries(spark):
    found = {r.y: r.e for r in spark.range(1900, 2201).select(F.col("id").cast("int").alias("y"), easter_sunday(F.col("id").cast("int")).alias("e")).collect()}
    assert found == {year: easter(year) for year in range(1900, 2201)}
    assert (found[2026], found[2024], found[1954], found[2038]) == (date(2026, 4, 5), date(2024, 3, 31), date(1954, 4, 18), date(2038, 4, 25))


def test_movable_holidays_and_their_eves(spark):
    days = {r.data: r for r in calendar(spark).collect()}
    named = {d: r.nome_feriado for d, r in days.items() if r.nome_feriado in ("Carnaval", "Sexta-feira Santa", "Corpus Christi")}
    assert named == {date(2026, 2, 16): "Carnaval", date(2026, 2, 17): "Carnaval", date(2026, 4, 3): "Sexta-feira Santa", date(2026, 6, 4): "Corpus Christi"}
    assert all(days[d].feriado and days[d - timedelta(days=1)].dia_critico for d in named)
    # In 2000 Good Friday fell on a fixed holiday, whose name goes first.
    span = spark.createDataFrame([(date(2000, 4, 20), date(2000, 4, 21))], "inicio date, fim date")
    assert [r.nome_feriado for r in build_calendar(span).orderBy("data").collect()] == [None, "Tiradentes"]


def test_keyword_match_without_keywords(spark):
    names = spark.createDataFrame([("Ana",)], "nome string")
    assert match_keyword(names, spark.createDataFrame([], "id int, keyword string")).count() == 0


def register(spark):
    return spark.createDataFrame(
        [
            (1, "Ana", "ana", "1 - Ana", "Comp", ["Ana", "ANA"], "ANA"),
            (2, "Bia", None, None, "Comp", ["Bia", "Ana"], None),
            (3, "Cid", "cid", "1 - Ana", None, None, "CID"),
        ],
        "id int, nome_artistico string, artista_keyword string, dsu_artista string, universal_compositor string, "
        "warner_chappel_deal_scope_name array<string>, warner_music_artist_name string",
    )


def test_each_platform_matches_its_own_key(spark):
    names = spark.createDataFrame([("Ana Live",), ("Zed",)], "nome string")
    tracks = spark.createDataFrame([("t1", "Comp"), ("t2", "Other"), ("t3", None)], "codigo_musica string, compositor string")
    got = {
        (r.plataforma_origem, r.chave_artista): (r.matched_artista_id, r.artista_casado)
        for r in artist_matches(register(spark), names, tracks).collect()
    }
    assert got == {
        ("DSU", "1 - Ana"): (1, "Ana"),
        ("Orchard", "Ana Live"): (1, "Ana"),
        ("Universal", "t1"): (1, "Ana"),
        ("Warner Chappell", "Ana"): (1, "Ana"),
        ("Warner Chappell", "ANA"): (1, "Ana"),
        ("Warner Chappell", "Bia"): (2, "Bia"),
        ("Warner Music", "ANA"): (1, "Ana"),
        ("Warner Music", "CID"): (3, "Cid"),
    }


def test_union_keeps_equal_lines_and_only_confirmed_shows(spark):
    contracts = spark.createDataFrame(
        [("1 - Ana", date(2026, 11, 5), s, Decimal("10"), "rs") for s in ("CONFIRMADO", "FINANCEIRO/AGUARDAR", "CANCELADO/REMARCAR")],
        "artista string, dt_show date, status string, valor_liquido decimal(18,4), razao_social string",
    )
    lines = spark.createDataFrame(
        [("2026-11", "Ana", "Ana", "Orchard", "Gravadora", Decimal(5), Decimal(-2), "ft", None)] * 2,
        "periodo string, artista_raw string, chave_artista string, plataforma_origem string, tipo_remuneracao string, "
        "quantidade decimal(18,4), valor_royalties decimal(18,4), tabela_origem string, razao_social string",
    )
    matches = spark.createDataFrame(
        [("DSU", "1 - Ana", 1, None, "Ana")],
        "plataforma_origem string, chave_artista string, matched_artista_id int, matched_artista_keyword string, artista_casado string",
    )
    fact = Relation(unify(show_branch(contracts), lines), ("f",), (artist_lookup(lambda: matches),))
    got = sorted(
        tuple(r)
        for r in fact.columns("plataforma_origem", "artista", "periodo_receita", "quantidade", "matched_artista_id").collect()
    )
    assert got == [
        ("DSU", "Ana", "2026-11", Decimal(1), 1),
        ("Orchard", "Ana", "2027-02", Decimal(5), None),
        ("Orchard", "Ana", "2027-02", Decimal(5), None),
    ]


def test_ledger_group_listed_twice_lets_entries_through_once(spark):
    entries = spark.createDataFrame([("g1", 1), ("g1", 2), ("g2", 3), (None, 4)], "grupo string, n int")
    groups = spark.createDataFrame([("t1", "g1", True), ("t2", "g1", True), ("t1", "g2", False)], "tipo string, grupo string, ativo boolean")
    assert sorted(r.n for r in active_ledger(entries, groups).collect()) == [1, 2]


def test_category_drift(spark):
    entries = spark.createDataFrame([("t", "g", "c"), ("t", "g", "new"), ("t", "g", "new"), ("t", None, "c")], "tipo string, grupo string, categoria string")
    known = spark.createDataFrame([("t", "g", "c"), ("t", "g", "unused")], "tipo string, grupo string, categoria string")
    got = {(r.grupo, r.categoria): r.lancamentos for r in category_drift(entries, known).collect()}
    assert got == {("g", "new"): 2, (None, "c"): 1}


def test_shows_put_only_their_own_contracts_in_order(spark, tmp_path):
    from datetime import datetime

    from cantiga.sources.star import StarSchema

    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    day = datetime(1998, 5, 1)
    table("region", [(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string")
    table("nation", [(0, "N0", 0), (1, "N1", 1)], "n_nationkey int, n_name string, n_regionkey int")
    table("customer", [(1, "C1", 0, "M"), (2, "C2", 1, "M")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string")
    # Order 10 is listed twice, 11 is of another region, 12 ends in another status, 13 has no lines.
    orders = [(10, 1, day), (10, 1, day), (11, 2, day), (12, 1, day), (13, 1, day), (None, 1, day)]
    table("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp")

    def line(key, number, flag, month, price):
        return (key, 1, 1, number, 1.0, price, 0.5, 0.0, flag, "O", None if month is None else datetime(1998, month, 1))

    lines = [
        line(10, 1, "R", 3, 100.0), line(10, 2, "N", 2, 200.0), line(10, 3, "A", None, 300.0), line(10, 1, "R", 3, 100.0),
        line(11, 1, "R", 3, 400.0), line(12, 1, "R", 1, 500.0), line(12, 2, "A", 2, 600.0), line(None, 1, "R", 9, 700.0),
    ]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    table("lineitem", lines, names)
    shows = StarSchema(spark, str(tmp_path)).show_lines
    got = [(r.periodo, r.artista_raw, r.quantidade, r.valor_royalties) for r in shows.collect()]
    assert got == [("1998-05", "000001 - C1", 1, 50)] * 2
    plan = shows._jdf.queryExecution().optimizedPlan().toString()
    # The other contracts are left out below the window, not above it.
    assert "Join LeftSemi" in plan.split("Window [row_number")[1].split("Relation")[0]
