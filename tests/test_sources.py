from __future__ import annotations

import json
import random
import re
from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cantiga import session
from cantiga.operators import quality
from cantiga.sources import contract, sinks
from cantiga.sources.relation import Relation, left_lookup


def test_months_are_folders_and_a_refresh_leaves_the_others(spark, tmp_path):
    path = f"{tmp_path}/stg"
    frame = spark.createDataFrame([("2026-01", 1), ("2026-01", 2), ("2026-02", 3), ("2026-03", 4)], "periodo string, v int")
    sinks.write_months(frame, path)
    sinks.write_months(spark.createDataFrame([("2026-02", 30), ("2026-04", 40)], "periodo string, v int"), path)
    back = sinks.read_months(spark, path)
    assert dict(back.dtypes)["periodo"] == "string"
    assert sorted((r.periodo, r.v) for r in back.collect()) == [
        ("2026-01", 1), ("2026-01", 2), ("2026-02", 30), ("2026-03", 4), ("2026-04", 40),
    ]
    plan = back.where(F.col("periodo").between("2026-02", "2026-03"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(periodo" in plan


def test_a_month_with_most_rows_is_written_by_several_tasks(spark, tmp_path):
    frame = spark.range(300_000).select(
        F.when(F.col("id") % 10 < 9, "2026-01").otherwise("2026-02").alias("periodo"), F.sha2(F.col("id").cast("string"), 256).alias("v")
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        sinks.write_months(frame, f"{tmp_path}/big")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = sinks.read_months(spark, f"{tmp_path}/big")
    assert back.count() == 300_000
    files = back.where("periodo = '2026-01'").select(F.input_file_name()).distinct().count()
    assert files > 3


def test_json_keeps_nulls_and_plain_values(spark, tmp_path):
    frame = spark.createDataFrame([(Decimal("1.5"), date(2026, 1, 2), None)], "d decimal(18,4), day date, n string")
    expected = {"d": 1.5, "day": "2026-01-02", "n": None}
    assert json.loads(sinks.json_rows(frame).first().linha) == expected
    sinks.write_json(frame, f"{tmp_path}/json")
    assert json.loads(spark.read.text(f"{tmp_path}/json").first().value) == expected


def test_shared_folder_follows_the_cluster_setting(spark, monkeypatch):
    assert session.shared_folder(spark, "x") != session.shared_folder(spark, "x")
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: "hdfs://cluster/checkpoints")
    assert session.shared_folder(spark, "x").startswith("hdfs://cluster/checkpoints/x-")


def test_tune_leaves_what_the_cluster_set(spark):
    session.tune(spark)
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_contract(spark):
    actual = contract.describe_frames(spark, {"t": spark.createDataFrame([(1, "a")], "id int, nome string")}, "public")
    assert [tuple(r) for r in actual.collect()] == [
        ("public", "t", 1, "id", "int", True), ("public", "t", 2, "nome", "string", True),
    ]
    expected = spark.createDataFrame([("t", "id", "int"), ("t", "nome", "bigint"), ("t", "x", "int")], "tabela string, coluna string, tipo string")
    assert sorted(tuple(r) for r in contract.contract_violations(expected, actual).collect()) == [
        ("t", "nome", "bigint", "string"), ("t", "x", "int", None),
    ]


def test_catalog_description_and_missing_schemas(spark):
    spark.range(1).createOrReplaceTempView("described_view")
    try:
        rows = contract.describe_catalog(spark, ["default"]).where("tabela = 'described_view'").collect()
        assert [(r.coluna, r.tipo) for r in rows] == [("id", "bigint")]
    finally:
        spark.catalog.dropTempView("described_view")
    assert [r.esquema for r in contract.missing_schemas(spark, ["default", "universal"]).collect()] == ["universal"]


def test_relation_joins_only_what_is_asked_for(spark):
    base = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "a int, b int")
    codes = spark.createDataFrame([(10, "x"), (20, None)], "b int, c string")
    names = spark.createDataFrame([("x", "name")], "c string, d string")
    relation = Relation(
        base, ("t",), (left_lookup(["c"], ["d"], lambda: names), left_lookup(["b"], ["c"], lambda: codes))
    )
    assert "Join" not in relation.columns("a")._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in relation.columns("a", "d").collect()) == [(1, "name"), (2, None), (3, None)]
    with pytest.raises(ValueError, match="no column z"):
        relation.columns("z")


def test_quality_measures(spark):
    frame = spark.createDataFrame([("k1", "????", None), ("k1", "ok?", 1), ("k2", "", 2), (None, None, None)], "k string, t string, n int")
    fills = {r.coluna: (r.posicao, r.tipo, r.linhas, r.preenchidas, r.pct_preenchidas) for r in quality.fill_rates(frame, "x").collect()}
    assert fills == {
        "k": (1, "string", 4, 3, Decimal("75.0")), "t": (2, "string", 4, 3, Decimal("75.0")), "n": (3, "int", 4, 2, Decimal("50.0")),
    }
    assert tuple(quality.corrupted_titles(Relation(frame, ("x",)), "t", ["t"]).first()) == (4, 1, Decimal("25.0"))
    assert tuple(quality.key_uniqueness(frame, ["k"], "k").first()) == ("k", 4, 3, 1, 1)
    assert [tuple(r) for r in quality.repeated_keys(frame, ["k"]).collect()] == [("k1", 2)]


def test_quality_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, t string")
    assert [r.pct_preenchidas for r in quality.fill_rates(empty, "x").collect()] == [None, None]
    assert tuple(quality.corrupted_titles(Relation(empty, ("x",)), "t", ["t"]).first()) == (0, 0, None)
    assert tuple(quality.key_uniqueness(empty, ["k"], "k").first()) == ("k", 0, 0, 0, 0)


def test_over_count(spark):
    raw = spark.createDataFrame(
        [("c1", 1, "A", Decimal(10)), ("c1", 2, "A", Decimal(7)), ("c2", 1, "B", Decimal(5)), ("c2", 2, None, Decimal(1)), ("c3", None, "B", Decimal(3)), ("c3", 1, "A", None), (None, 1, "B", Decimal(2))],
        "k string, at int, status string, v decimal(18,4)",
    )
    counted = quality.over_count(raw, ["k"], ["at"], "v")
    got = {r.status: (r.linhas_brutas, r.valor_bruto, r.linhas_unicas, r.valor_unico) for r in counted.collect()}
    assert got == {"A": (3, 17, 2, 7), "B": (3, 10, 1, 2), None: (1, 1, 1, 1)}


def test_over_count_reads_its_table_once(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("at"), F.lit("A").alias("status"), F.col("id").cast("decimal(18,4)").alias("v")).write.parquet(str(tmp_path / "raw"))
    plan = quality.over_count(spark.read.parquet(str(tmp_path / "raw")), ["k"], ["at"], "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def rows_scanned(frame):
    """Rows that the scan of an executed plan without shuffles gave out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    return plan.collectLeaves().apply(0).metrics().get("numOutputRows").get().value()


def test_clustered_months_let_a_filter_on_either_column_skip_row_groups(spark, tmp_path):
    n = 64_000
    frame = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 97 == 0, None).otherwise(F.format_string("artist %03d", F.col("id") * 7919 % 500)).alias("artista"),
        F.format_string("p%02d", F.col("id") * 104729 % 40).alias("plataforma"),
        F.when(F.col("id") % 2 == 0, "2026-01").otherwise("2026-02").alias("periodo"),
        F.col("id"),
    )
    plain, clustered = f"{tmp_path}/plain", f"{tmp_path}/clustered"
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "16384")
    try:
        sinks.write_months(frame, plain)
        sinks.write_clustered_months(frame, clustered, ["artista", "plataforma"])
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    for where, share in (("artista = 'artist 123'", 0.25), ("plataforma = 'p07'", 0.25), ("artista = 'artist 123' AND plataforma = 'p07'", 0.05)):
        rows = [sorted(r.id for r in sinks.read_months(spark, path).where(where).collect()) for path in (plain, clustered)]
        assert rows[0] == rows[1]
        assert rows_scanned(sinks.read_months(spark, clustered).where(where)) < share * n
    assert sinks.read_months(spark, clustered).count() == n and sinks.read_months(spark, clustered).where("artista IS NULL").count() == len(range(0, n, 97))


def files_of(path):
    return {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet") if "_fingerprints" not in str(f)}


def test_refresh_touches_only_months_that_differ(spark, tmp_path):
    path = tmp_path / "mv"
    rows = [("2024-01", 1, None), ("2024-01", None, 1), ("2024-02", 2, 2), ("2024-03", 3, 3), (None, 4, 4)]
    frame = lambda rows: spark.createDataFrame(rows, "periodo string, a int, b int").repartition(3)
    read = lambda: sorted((r.periodo, r.a, r.b) for r in spark.read.schema("a int, b int, periodo string").parquet(str(path)).na.fill("", ["periodo"]).collect())
    assert sinks.refresh_months(frame(rows), str(path)) == sinks.Refresh(("2024-01", "2024-02", "2024-03", None), (), 0)
    first = files_of(path)
    # The same rows in another order are the same month.
    assert sinks.refresh_months(frame(rows[::-1]), str(path)) == sinks.Refresh((), (), 4)
    assert files_of(path) == first
    # A null that moves to the next column is a change; so is a row more.
    changed = [("2024-01", 1, 1), ("2024-01", None, None), ("2024-03", 3, 3), ("2024-03", 3, 3), (None, 4, 4)]
    assert sinks.refresh_months(frame(changed), str(path)) == sinks.Refresh(("2024-01", "2024-03"), ("2024-02",), 1)
    assert not (path / "periodo=2024-02").exists()
    assert {f: t for f, t in files_of(path).items() if f in first} == {f: t for f, t in first.items() if "HIVE_DEFAULT" in str(f)}
    assert Counter((r.periodo, r.a, r.b) for r in spark.read.schema("a int, b int, periodo string").parquet(str(path)).collect()) == Counter(changed)
    assert sinks.refresh_months(frame([r for r in changed if r[0]]), str(path)).vanished == (None,)
    assert sinks.refresh_months(frame([]), str(path)).vanished == ("2024-01", "2024-03") and files_of(path) == {}


def test_refresh_builds_only_changed_months_and_follows_its_lookups(spark, tmp_path):
    seen = []

    def build(rows):
        seen.append(sorted(r.periodo for r in rows.select("periodo").distinct().collect()))
        return rows.withColumn("twice", F.col("a") * 2)

    def refresh(rows, names):
        frame = spark.createDataFrame(rows, "periodo string, a int")
        return sinks.refresh_months(frame, str(tmp_path / "mv"), build, depends_on=[spark.createDataFrame(names, "id int, name string")])

    refresh([("m1", 1), ("m2", 2)], [(1, "x")])
    refresh([("m1", 1), ("m2", 3)], [(1, "x")])
    assert refresh([("m1", 1), ("m2", 3)], [(1, "x")]) == sinks.Refresh((), (), 2)
    refresh([("m1", 1), ("m2", 3)], [(1, "y")])
    assert seen == [["m1", "m2"], ["m2"], ["m1", "m2"]]
    assert sorted((r.periodo, r.twice) for r in sinks.read_months(spark, str(tmp_path / "mv")).collect()) == [("m1", 2), ("m2", 6)]


def test_refresh_that_broke_off_is_done_again(spark, tmp_path):
    frame = spark.createDataFrame([("m1", 1)], "periodo string, a int")

    def broken(rows):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.refresh_months(frame, str(tmp_path / "mv"), broken)
    assert sinks.refresh_months(frame, str(tmp_path / "mv")).changed == ("m1",)


def measures(spark):
    """Each measure with rows for it."""
    draw = random.Random(3)
    some = lambda *values: draw.choice(values)
    artists = spark.createDataFrame([("P", "a", 1), ("P", "b", 2), ("Q", "a", 3)], "plataforma_origem string, chave_artista string, matched_artista_id int")
    names = left_lookup(["plataforma_origem", "chave_artista"], ["matched_artista_id"], lambda: artists)
    fact = spark.createDataFrame([(some("P", "Q", None), some("a", "b", "c", None), some("x", "y", None)) for _ in range(200)], "plataforma_origem string, chave_artista string, artista_raw string")
    yield quality.matching(Relation(fact, ("t",), (names,))), fact
    channels = spark.createDataFrame([("p", "s", "Radio")], "k string, l string, canal string")
    channel = left_lookup(["k", "l"], ["canal"], lambda: channels)
    lines = spark.createDataFrame([(some("p", "q", None), some("s", "t")) for _ in range(100)], "k string, l string")
    yield quality.key_matching(Relation(lines, ("t",), (channel,)), ["k", "l"], "canal"), lines
    titles = spark.createDataFrame([(some("??", "?", "x?", None, ""),) for _ in range(50)], "titulo string")
    yield quality.title_corruption(Relation(titles, ("t",)), "titulo", ["titulo"]), titles
    yield quality.uniqueness({"k+l": ["k", "l"], "k": ["k"]}), lines
    yield quality.filling(lines, "lines"), lines
    status = spark.createDataFrame([(some("c1", "c2", "c3", None), i, some("A", "B", None), Decimal(draw.randint(-5, 9))) for i in range(60)], "k string, at int, status string, v decimal(18,4)")
    yield quality.over_counting(["k"], ["at"], "v"), status


@pytest.mark.parametrize("split", ["pmod(xxhash64(n), 3)", "n % 7", "0"])
def test_sums_of_parts_add_up_to_the_report_of_all(spark, split, tmp_path):
    for i, (measure, rows) in enumerate(measures(spark)):
        kept = rows.withColumn("n", F.monotonically_increasing_id()).withColumn("periodo", F.expr(f"cast({split} as string)")).drop("n")
        sinks.refresh_months(kept.where("periodo != '1'"), f"{tmp_path}/{i}", lambda part, m=measure: m.state(part, "periodo"))
        done = sinks.refresh_months(kept, f"{tmp_path}/{i}", lambda part, m=measure: m.state(part, "periodo"))
        # What is there already is not summed again.
        assert done.changed == (() if split == "0" else ("1",))
        states = sinks.read_months(spark, f"{tmp_path}/{i}")
        assert Counter(measure.of_states(states).collect()) == Counter(measure.of(rows).collect()), i


def test_fingerprints_are_exact_sums_of_the_hashes_of_whole_rows(spark):
    """They are the same as before, when the hashes were added up as decimals, so that the months kept stay."""
    frame = spark.range(2000).select(
        F.when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("string")).alias("periodo"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 11).alias("a"),
        F.when(F.col("id") % 4 != 0, F.lit("x")).alias("b"),
    )
    got = sinks.fingerprints(frame, "periodo")
    values = [F.struct(F.col(c).isNull(), F.col(c)) for c in frame.columns]
    want = Counter()
    sums = {}
    for r in frame.select("periodo", *[F.xxhash64(F.lit(salt), *values).alias(f"h{salt}") for salt in (1, 2)]).collect():
        want[r.periodo] += 1
        one, two = sums.get(r.periodo, (0, 0))
        sums[r.periodo] = one + r.h1, two + r.h2
    assert dict(got.dtypes)["h1"] == dict(got.dtypes)["h2"] == "decimal(38,0)"
    assert {r.month: (r.n, int(r.h1), int(r.h2)) for r in got.collect()} == {m: (n, *sums[m]) for m, n in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "named_struct" not in plan and not re.search(r"sum\(cast\([^()]* as decimal\(38,0\)", plan)


def test_states_of_the_over_count_are_not_summed_again_before_the_report(spark):
    """A contract's months meet in one shuffle, by the contract; the report adds them up."""
    rows = [("1", "k", 1, "A", 2), ("1", "k", 2, "B", 3), ("2", "k", 5, "A", 4), ("2", "j", 1, None, 1), (None, None, 1, "B", 9), ("3", None, 1, "A", 7), ("2", "k", 5, "A", 4)]
    frame = spark.createDataFrame(rows, "periodo string, k string, at int, status string, v int")
    measure = quality.over_counting(["k"], ["at"], "v")
    states = measure.state(frame, "periodo")
    by_contract = measure.of_states(states)
    assert Counter(by_contract.collect()) == Counter(measure.of(frame).collect())
    assert Counter(by_contract.collect()) == Counter(measure.report(measure.merged(states)).collect())
    kept = spark.createDataFrame(states.collect(), states.schema)
    plan = measure.of_states(kept)._jdf.queryExecution().executedPlan().toString()
    # By the contract for the window, and by the status for the report.
    assert plan.count("Exchange hashpartitioning(") == 2


def test_the_rows_of_match_coverage_from_states_are_made_once(spark, monkeypatch):
    from checks import queries

    asked, refresh = [], sinks.refresh_months

    def seen(part, *rest):
        asked.append(part._jdf.queryExecution().optimizedPlan().toString())
        return refresh(part, *rest)

    monkeypatch.setattr(sinks, "refresh_months", seen)
    queries.QUERIES["match_coverage_from_states"](spark, "/root/testdata/sf0.001").collect()
    assert len(asked) == 2 and not any("Join" in plan or "Window" in plan for plan in asked)


def test_a_lookup_by_what_another_found_joins_the_rows_once(spark):
    from cantiga.operators.matching import artist_lookup
    from cantiga.sources.registry import gravadora_lookup
    from cantiga.sources.relation import fewest_joins

    matches = spark.createDataFrame(
        [("DSU", "a", 1, None, "A"), ("DSU", "b", 2, "kb", "B"), ("DSU", "c", 3, None, "C"), ("DSU", "n", None, None, "N"), ("DSU", "a", 1, None, "A")],
        "plataforma_origem string, chave_artista string, matched_artista_id int, matched_artista_keyword string, artista_casado string",
    )
    artists = spark.createDataFrame([(1, "X"), (2, None), (3, "Y"), (3, "Z"), (None, "W")], "id int, gravadora string")
    rows = [("DSU", "a", "ra", 1), ("DSU", "a", "ra", 1), ("DSU", "b", "rb", 2), ("DSU", "n", "rn", 3), ("DSU", None, None, 4), ("Orchard", "a", "ro", 5)]
    frame = spark.createDataFrame(rows, "plataforma_origem string, chave_artista string, artista_raw string, n int")
    chain = [artist_lookup(lambda: matches), gravadora_lookup(lambda: artists)]
    (both,) = fewest_joins(chain)
    assert both.provides == (*chain[0].provides, *chain[1].provides)
    wide = both.attach(frame)
    node, joins = wide._jdf.queryExecution().optimizedPlan(), 0
    while not node.children().isEmpty():
        joins, node = joins + (node.nodeName() == "Join"), node.children().head()
    assert joins == 1
    columns = ["n", "matched_artista_id", "matched_artista_keyword", "artista", "gravadora"]
    expected = [(1, 1, None, "A", "X"), (1, 1, None, "A", "X"), (2, 2, "kb", "B", None), (3, None, None, "N", None), (4, None, None, None, None), (5, None, None, "ro", None)]
    assert sorted(map(tuple, wide.select(*columns).collect()), key=lambda r: r[0]) == expected
    one_by_one = chain[1].attach(chain[0].attach(frame))
    assert wide.columns == one_by_one.columns and wide.exceptAll(one_by_one).isEmpty()
    # Artist 3 is registered twice: no matter, until a row asks for it.
    asked = frame.unionByName(spark.createDataFrame([("DSU", "c", "rc", 6)], frame.schema))
    with pytest.raises(Exception, match="more than one gravadora for id 3"):
        both.attach(asked).collect()


def test_lookups_without_shared_keys_stay_apart(spark):
    from cantiga.sources.relation import fewest_joins

    table = spark.createDataFrame([("x", "y")], "a string, b string")
    first = left_lookup(["a"], ["b"], lambda: table)
    other = left_lookup(["c"], ["d"], lambda: table.toDF("c", "d"))
    last = left_lookup(["d", "c"], ["e"], lambda: table.selectExpr("b AS d", "a AS c", "a AS e"))
    assert [entry.provides for entry in fewest_joins([first, other, last])] == [("b",), ("d",), ("e",)]


def test_rows_are_not_sorted_for_a_small_lookup(spark):
    table = spark.range(400).selectExpr("id AS k", "id AS v")
    frame = spark.range(20_000).selectExpr("id % 300 AS k", "id")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for key in before:
            spark.conf.set(key, "-1")
        wide = left_lookup(["k"], ["v"], lambda: table).attach(frame)
        assert sorted(wide.collect()) == sorted((i % 300, i, i % 300) for i in range(20_000))
        plan = wide._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
