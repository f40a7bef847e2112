from __future__ import annotations

import unicodedata
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from cantiga.functions.money import percent, plain_values
from cantiga.functions.months import add_months_text, days_between_months, receipt_month
from cantiga.functions.text import fold, fold_text, let, longest_of
from cantiga.plans.digest import formatted


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_months_cross_the_year_and_bad_text_is_null(spark):
    rows = spark.createDataFrame([("2026-11",), ("2026-13",), ("x",), (None,)], "m string")
    shifted = [r[0] for r in rows.select(add_months_text(F.col("m"), 3)).collect()]
    assert shifted == ["2027-02", None, None, None]


def test_receipt_month_is_the_same_month_for_shows(spark):
    row = one(spark, receipt_month(F.lit("2026-11"), F.lit("DSU")), receipt_month(F.lit("2026-11"), F.lit("Orchard")))
    assert tuple(row) == ("2026-11", "2027-02")


def test_day_bounds_need_real_months():
    assert days_between_months(F.lit(None), "2026-13-01", None) is None
    assert days_between_months(F.lit(None), None, "soon") is None


def test_percent_rounds_half_up_and_is_null_for_nothing(spark):
    values = one(spark, percent(F.lit(1), F.lit(16)), percent(F.lit(0), F.lit(0)), percent(F.lit(1), F.lit(8)))
    assert tuple(values) == (Decimal("6.3"), None, Decimal("12.5"))


def test_folding_equals_unicode_decomposition(spark):
    texts = [
        "ÁÉÍ ção", "ﬁm da ﬀaixa ½ …™", "ĳs №5", "ａｂｃ　１２３", "ΆΣ Ёж", "𝐚𝐛", "áb", "İstanbul", "㎏", "plain ASCII", "",
        "µ ² ³", "ﷺ", "“aspas” — travessão", "Ångström naïve",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold_text(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == {t: fold(t) for t in texts}


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_folding_of_every_code_point(spark):
    codes = spark.range(1, 0x110000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    # Letters in lower case are the engine's, whose Unicode version may be another.
    rows = codes.select(F.lower("c").alias("l"), fold_text(F.col("c")).alias("f")).toPandas()
    assert len(rows) == 0x110000 - 1 - 2048
    assert [(a, b) for a, b in zip(rows["l"], rows["f"]) if b != plain(a)] == []


def test_folding_of_hangul_among_other_text(spark):
    texts = ["한국어 노래", "가각힣", "😀한 ÁB ﬁm", "각각각", "ㄱㅏ", "한", "abc\n한\t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold_text(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == {t: plain(t.lower()) for t in texts} == {t: fold(t) for t in texts}
    assert {r.t: r.f for r in rows}["가각힣"] == "\u1100\u1161\u1100\u1161\u11a8\u1112\u1175\u11c2"


def test_folding_keeps_null(spark):
    assert one(spark, fold_text(F.lit(None).cast("string")))[0] is None


def test_longest_word_at_each_position(spark):
    words = ["show", "shows", "showroom", "how", "co-autor", "a b", "b"]
    for text in ["meus shows no showroo", "co-autor a b", "showshow", "", "sho"]:
        expected = []
        for at in range(len(text)):
            here = [w for w in words if text.startswith(w, at)]
            expected += [max(here, key=len)] if here else []
        got = one(spark, F.regexp_extract_all(F.lit(text), F.lit(f"(?=({longest_of(words)}))"), F.lit(1)))[0]
        assert got == expected, text


def test_let_binds_a_value(spark):
    row = one(spark, let(F.lit(3), lambda x: x * x), let(F.lit(None).cast("int"), lambda x: F.coalesce(x, F.lit(1))))
    assert tuple(row) == (9, 1)


def test_brazilian_numbers(spark):
    frame = spark.createDataFrame(
        [(1234567, 1234567.891, "n/a"), (-1000, -0.5, None), (None, None, "x")], "i bigint, f double, s string"
    )
    rows = [tuple(r) for r in formatted(frame, ["i", "f", "s"]).collect()]
    assert rows == [("1.234.567", "1.234.567,89", "n/a"), ("-1.000", "-0,50", "-"), ("-", "-", "x")]


def test_plain_values(spark):
    frame = spark.createDataFrame(
        [(Decimal("12.5"), date(2026, 8, 7), datetime(2026, 8, 7, 10, 30), "teste", None, 42)],
        "d decimal(18,4), day date, ts timestamp_ntz, t string, n string, i int",
    )
    row = plain_values(frame).first()
    assert tuple(row) == (12.5, "2026-08-07", "2026-08-07T10:30:00", "teste", None, 42)


def test_plain_timestamps_keep_fractions_and_zone(spark):
    frame = spark.sql("select timestamp_ntz'2026-08-07 10:30:00.25' a, timestamp'2026-08-07 10:30:00+00:00' b")
    assert tuple(plain_values(frame).first()) == ("2026-08-07T10:30:00.250000", "2026-08-07T10:30:00+00:00")
