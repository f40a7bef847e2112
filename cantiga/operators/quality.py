"""Data-quality measures.  Each is one aggregation; none collects a group.

A measure has two steps: sums by key, and a report made of the sums.  The sums
of any parts of the rows add up to those of all, so that they can be kept per
month, and a new month reads only itself.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cantiga.functions.money import money, percent
from cantiga.sources.relation import Relation


def _sum_if(condition: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0))


@dataclass(frozen=True)
class Measure:
    """How the sums of a measure are made, added up and reported."""

    keys: tuple[str, ...]
    #: Aggregates that add up, and those of which the greatest counts.
    sums: Callable[[], dict[str, Column]]
    report: Callable[[DataFrame], DataFrame]
    greatest: Callable[[], dict[str, Column]] = dict
    #: Rows in the shape that is summed, with the further columns named.
    shape: Callable[[DataFrame, Sequence[str]], DataFrame] = field(default=lambda rows, _: rows)
    #: Whether the report itself adds up several sums of one key.
    adds_up: bool = False

    def state(self, rows: DataFrame, *by: str) -> DataFrame:
        """The sums of ``rows``, for each of the columns ``by`` apart.

        The keys come first: where Spark sorts to group, it compares many different keys faster than few different months.
        """
        aggregates = {**self.sums(), **self.greatest()}
        return self.shape(rows, by).groupBy(*self.keys, *by).agg(*[value.alias(name) for name, value in aggregates.items()])

    def merged(self, states: DataFrame) -> DataFrame:
        """One state of many."""
        added = [F.sum(name).alias(name) for name in self.sums()]
        return states.groupBy(*self.keys).agg(*added, *[F.max(name).alias(name) for name in self.greatest()])

    def of(self, rows: DataFrame) -> DataFrame:
        return self.report(self.state(rows))

    def of_states(self, states: DataFrame) -> DataFrame:
        return self.report(states if self.adds_up else self.merged(states))


def _rows() -> dict[str, Column]:
    return {"__rows": F.count("*")}


def matching(fact: Relation) -> Measure:
    """Per platform: rows and distinct raw artists, and how many of each are matched.

    Rows are counted by name before the names are matched.
    """
    keys = ("plataforma_origem", "chave_artista", "artista_raw")

    def report(counted: DataFrame) -> DataFrame:
        matched = Relation(counted, fact.tables, fact.lookups).columns(*keys, "__rows", "matched_artista_id")
        is_matched = F.col("matched_artista_id").isNotNull()
        per_artist = matched.groupBy("plataforma_origem", "artista_raw").agg(
            F.sum("__rows").alias("__rows"),
            _sum_if(is_matched, F.col("__rows")).alias("__matched"),
        )
        artists, artists_matched = F.count("artista_raw"), F.count_if(F.col("__matched") > 0)
        return per_artist.groupBy("plataforma_origem").agg(
            F.sum("__rows").alias("linhas"),
            F.sum("__matched").alias("linhas_casadas"),
            percent(F.sum("__matched"), F.sum("__rows")).alias("pct_linhas"),
            artists.alias("artistas"),
            artists_matched.alias("artistas_casados"),
            percent(artists_matched, artists).alias("pct_artistas"),
        )

    return Measure(keys, _rows, report)


def match_coverage(fact: Relation) -> DataFrame:
    return matching(fact).of(fact.base)


def key_matching(lines: Relation, keys: Sequence[str], found: str) -> Measure:
    """Share of distinct key combinations and of rows for which the lookup finds something."""

    def report(counted: DataFrame) -> DataFrame:
        looked_up = Relation(counted, lines.tables, lines.lookups).columns(*keys, "__rows", found)
        hit = F.col(found).isNotNull()
        rows, rows_hit = F.coalesce(F.sum("__rows"), F.lit(0)), _sum_if(hit, F.col("__rows"))
        return looked_up.agg(
            F.count("*").alias("combinacoes"),
            F.count_if(hit).alias("combinacoes_resolvidas"),
            percent(F.count_if(hit), F.count("*")).alias("pct_combinacoes"),
            rows.alias("linhas"),
            rows_hit.alias("linhas_resolvidas"),
            percent(rows_hit, rows).alias("pct_linhas"),
        )

    return Measure(tuple(keys), _rows, report)


def key_coverage(lines: Relation, keys: Sequence[str], found: str) -> DataFrame:
    return key_matching(lines, keys, found).of(lines.base)


def filling(like: DataFrame, table: str) -> Measure:
    """One row per column of ``like`` in table order: type, rows, filled rows and their share."""
    fields = like.schema.fields

    def sums() -> dict[str, Column]:
        return _rows() | {f"__{i}": F.count(F.col(f"`{f.name}`")) for i, f in enumerate(fields)}

    def report(counts: DataFrame) -> DataFrame:
        entries = F.array(
            *[
                F.struct(
                    F.lit(i + 1).alias("posicao"),
                    F.lit(f.name).alias("coluna"),
                    F.lit(f.dataType.simpleString()).alias("tipo"),
                    F.coalesce(f"__{i}", F.lit(0)).alias("preenchidas"),
                )
                for i, f in enumerate(fields)
            ]
        )
        return counts.select(F.coalesce("__rows", F.lit(0)).alias("linhas"), F.inline(entries)).select(
            F.lit(table).alias("tabela"),
            "posicao",
            "coluna",
            "tipo",
            "linhas",
            "preenchidas",
            percent(F.col("preenchidas"), F.col("linhas")).alias("pct_preenchidas"),
        )

    return Measure((), sums, report)


def fill_rates(frame: DataFrame, table: str) -> DataFrame:
    return filling(frame, table).of(frame)


def title_corruption(lines: Relation, title: str, keys: Sequence[str]) -> Measure:
    """Rows whose title is nothing but question marks.

    ``keys`` decide the title; rows are counted by them first.
    """

    def report(counted: DataFrame) -> DataFrame:
        titles = Relation(counted, lines.tables, lines.lookups).columns("__rows", title)
        rows = F.coalesce(F.sum("__rows"), F.lit(0))
        corrupted = _sum_if(F.col(title).rlike(r"^[?]+$"), F.col("__rows"))
        return titles.agg(
            rows.alias("linhas"), corrupted.alias("corrompidas"), percent(corrupted, rows).alias("pct_corrompidas")
        )

    return Measure(tuple(keys), _rows, report)


def corrupted_titles(lines: Relation, title: str, keys: Sequence[str]) -> DataFrame:
    return title_corruption(lines, title, keys).of(lines.base)


def repeated_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that occur more than once, with their count."""
    return frame.groupBy(*keys).agg(F.count("*").alias("linhas")).where("linhas > 1")


def key_uniqueness(frame: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Distinct keys, repeated keys and rows beyond the first of a key."""
    counted = frame.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.agg(
        F.lit(name).alias("chave"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("linhas"),
        F.count("*").alias("chaves"),
        F.count_if(F.col("n") > 1).alias("chaves_repetidas"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("linhas_excedentes"),
    )


def uniqueness(keys: Mapping[str, Sequence[str]]) -> Measure:
    """``key_uniqueness`` of several keys in one pass: each row is counted under each of its keys; no rows, no result."""
    entry = lambda name, columns: F.struct(F.lit(name).alias("chave"), F.struct(*[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]).alias("v"))
    width = max(map(len, keys.values()))
    padded = {name: [*columns, *[columns[0]] * (width - len(columns))] for name, columns in keys.items()}

    def shape(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        return rows.select(*by, F.inline(F.array(*[entry(name, columns) for name, columns in padded.items()])))

    def report(counted: DataFrame) -> DataFrame:
        return counted.groupBy("chave").agg(
            F.sum("__rows").alias("linhas"),
            F.count("*").alias("chaves"),
            F.count_if(F.col("__rows") > 1).alias("chaves_repetidas"),
            F.sum(F.col("__rows") - 1).alias("linhas_excedentes"),
        )

    return Measure(("chave", "v"), _rows, report, shape=shape)


def keys_uniqueness(frame: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    return uniqueness(keys).of(frame)


def as_measures(frame: DataFrame, report: str, labels: Sequence[str] = ()) -> DataFrame:
    """A measure table in long form: report, label, measure, value."""
    numbers = [c for c in frame.columns if c not in labels]
    label = F.concat_ws(".", *labels) if labels else F.lit("")
    wide = frame.select(label.alias("item"), *[F.col(c).cast("double").alias(c) for c in numbers])
    return wide.unpivot("item", numbers, "medida", "valor").select(F.lit(report).alias("relatorio"), "item", "medida", "valor")


def quality_report(**parts: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Named (measure table, label columns) pairs below each other in long form."""
    return reduce(DataFrame.unionByName, [as_measures(frame, name, labels) for name, (frame, labels) in parts.items()])


def over_counting(keys: Sequence[str], order: Sequence[str], value: str) -> Measure:
    """Per status: rows and value with every status row counted, and with the latest row of each key only.

    One pass: rows are summed by key and status, which keeps of each the row
    with the greatest ``order`` columns; of a key's few statuses the one with the
    latest row is flagged.  A key with very many rows is a row per task by then.
    Sums kept per month are not added up before: the one with the latest row of
    all is flagged, and the sums by status are those of all.
    """

    def amount() -> Column:
        return money(F.col(value))

    def sums() -> dict[str, Column]:
        return {"__rows": F.count("*"), "__total": F.sum(amount())}

    def greatest() -> dict[str, Column]:
        return {"__last": F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], amount().alias("value")))}

    def report(by_status: DataFrame) -> DataFrame:
        newest = Window.partitionBy(*keys).orderBy(F.col("__last").desc())
        flagged = by_status.withColumn("__kept", F.row_number().over(newest) == 1)
        return flagged.groupBy("status").agg(
            F.sum("__rows").alias("linhas_brutas"),
            F.sum("__total").alias("valor_bruto"),
            F.count_if("__kept").alias("linhas_unicas"),
            F.coalesce(F.sum(F.when(F.col("__kept"), F.col("__last.value"))), F.lit(0)).alias("valor_unico"),
        )

    return Measure((*keys, "status"), sums, report, greatest, adds_up=True)


def over_count(raw: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    return over_counting(keys, order, value).of(raw)
