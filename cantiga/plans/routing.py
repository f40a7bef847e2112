"""A table of questions turned into a table of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cantiga import vocabulary as V
from cantiga.catalog import SOURCES
from cantiga.functions.text import fold, fold_text, let, longest_of, word_list

_TEXTS = "array<string>"
_PAIRS = "map<string,string>"

_TRACK = "track level"


def _metric(key: str) -> str:
    return f"metric {key}"


def _dimension(key: str) -> str:
    return f"dimension {key}"


def _filter(field: str, value: str) -> str:
    return f"filter {field} {value}"


def _source(name: str) -> str:
    return f"source {name}"


def _platform(name: str) -> str:
    return f"platform {name}"


def _days(rule: int) -> str:
    return f"days {rule}"


@lru_cache(maxsize=1)
def _tags_of_words() -> dict[str, list[str]]:
    """What each word says about a question.

    Filter and platform words are folded.  Metric and dimension words are taken
    as written, so an accented one can never occur in folded text; those are
    left out here.
    """
    said: dict[str, list[str]] = {}

    def say(tag: str, words: Iterable[str], as_written: bool = True) -> None:
        for word in words:
            known = word if as_written else fold(word)
            if fold(known) == known and tag not in said.setdefault(known, []):
                said[known].append(tag)

    for key, words in V.METRIC_WORDS.items():
        say(_metric(key), words)
    for key, words in V.DIMENSION_WORDS.items():
        say(_dimension(key), words)
    for field, values in V.FILTER_WORDS.items():
        for value, words in values.items():
            say(_filter(field, value), words, as_written=False)
    for name, words in V.SOURCE_WORDS.items():
        say(_source(name), words)
    for name, words in V.PLATFORM_WORDS.items():
        say(_platform(name), words, as_written=False)
    say(_TRACK, V.TRACK_WORDS)
    for rule, (words, _, _) in enumerate(V.RELATIVE_DAYS):
        say(_days(rule), words)

    def says_more(word: str) -> bool:
        """Whether the word says anything the words inside it do not say already."""
        inside = {tag for other, tags in said.items() if other != word and other in word for tag in tags}
        return not set(said[word]) <= inside

    return {word: tags for word, tags in said.items() if says_more(word)}


def _texts(values: Iterable[str]) -> Column:
    return word_list(values)


def question_tags(folded: Column) -> Column:
    """Everything the words found in the text say, as an array.

    A word counts wherever it occurs, also inside another word.  The text is
    read once: at each position the longest word is taken, and the words inside
    it, which include all shorter ones at that position, speak through it.
    """
    said = _tags_of_words()
    spoken = {
        word: dict.fromkeys(tag for other, tags in said.items() if other in word for tag in tags) for word in said
    }
    meaning = F.map_from_arrays(word_list(spoken), F.array(*[word_list(tags) for tags in spoken.values()]))
    found = F.array_distinct(F.regexp_extract_all(folded, F.lit(f"(?=({longest_of(said)}))"), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(found, lambda word: F.element_at(meaning, word))))


def _has(tags: Column, tag: str) -> Column:
    return F.array_contains(tags, tag)


def _named(tags: Column, keys: Iterable[str], tag_of: Callable[[str], str]) -> Column:
    """The keys whose tag is there, in their own order."""
    there = F.array_intersect(word_list(tag_of(key) for key in keys), tags)
    return F.transform(there, lambda tag: F.substring(tag, F.lit(len(tag_of("")) + 1), F.length(tag)))


def infer_source(tags: Column) -> Column:
    """Source named by a word; null when none is."""
    by_itself = [F.when(_has(tags, _source(name)), F.lit(name)) for name in V.SOURCE_WORDS]
    with_track = [
        F.when(_has(tags, _TRACK) & _has(tags, _platform(name)), F.lit(name)) for name in V.PLATFORM_WORDS
    ]
    return F.coalesce(*by_itself, *with_track)


def infer_filters(tags: Column) -> Column:
    """Map of field to the first value with a word in the text."""
    pairs = []
    for field, values in V.FILTER_WORDS.items():
        value = F.coalesce(*[F.when(_has(tags, _filter(field, v)), F.lit(v)) for v in values])
        pairs.append(F.struct(F.lit(field).alias("key"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda pair: pair["value"].isNotNull()))


def infer_dates(question: Column, folded: Column, tags: Column, today: Column) -> Column:
    """Struct of ISO ``start_date`` and ``end_date``; null when the text names no range.

    Days in the text are taken from the unfolded question and are not checked.
    """

    def span(first: Column, last: Column) -> Column:
        return F.struct(first.alias("start_date"), last.alias("end_date"))

    def back(days: Column | int) -> Column:
        return F.date_format(F.date_sub(today, days), "yyyy-MM-dd")

    found = F.regexp_extract_all(question, F.lit(f"(?U)({V.ISO_DAY})"), F.lit(1))
    first, second = F.get(found, 0), F.get(found, 1)
    rules = [F.when(first.isNotNull(), span(first, F.coalesce(second, first)))]
    digits = F.regexp_extract(folded, f"(?U){V.LAST_DAYS}", 2)
    count = digits.try_cast("int")
    days = F.when(count.isNotNull(), F.greatest(count - 1, F.lit(0)))
    # A count that reaches before year 1, or that is no integer, leaves the start open.
    start = F.when(days <= F.datediff(today, F.lit("0001-01-01").cast("date")), back(days))
    rules.append(F.when(digits != "", span(start, back(0))))
    for rule, (_, first_back, last_back) in enumerate(V.RELATIVE_DAYS):
        rules.append(F.when(_has(tags, _days(rule)), span(back(first_back), back(last_back))))
    return F.coalesce(*rules)


def _first_filled(*arrays: Column) -> Column:
    """The first array that has an element, else the last one."""
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays[:-1]], arrays[-1])


def _per_source(values: dict[str, list[str]], source: Column) -> Column:
    pairs = [part for name, keys in values.items() for part in (F.lit(name), _texts(keys))]
    return F.element_at(F.create_map(*pairs), source)


def _both(left: Column, right: Column) -> Column:
    return let(right, lambda allowed: F.filter(left, lambda key: F.array_contains(allowed, key)))


def route_questions(
    frame: DataFrame,
    text: str,
    as_of: date | str | None = None,
    source: str | None = None,
    metrics: str | None = None,
    dimensions: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    filters: str | None = None,
) -> DataFrame:
    """Add to each question the request it stands for.

    New columns: ``rota_source``, ``rota_metrics``, ``rota_dimensions``,
    ``rota_filters``, ``rota_start_date``, ``rota_end_date``, ``rota_notes``.
    The optional arguments name columns that hold what the asker stated; what
    is stated wins over what is inferred.  One pass over the table, no shuffle.
    """
    question = F.coalesce(F.col(text), F.lit(""))
    today = F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")

    def stated(name: str | None, kind: str) -> Column:
        return F.lit(None).cast(kind) if name is None else F.col(name)

    given_source = F.nullif(stated(source, "string"), F.lit(""))
    given_metrics, given_dimensions = stated(metrics, _TEXTS), stated(dimensions, _TEXTS)
    given_start, given_end = stated(start_date, "string"), stated(end_date, "string")
    given_filters = F.coalesce(stated(filters, _PAIRS), F.create_map().cast(_PAIRS))

    # Each step is a projection of its own, so that what several columns read is computed once.
    folded, tags, chosen, own = F.col("__folded"), F.col("__tags"), F.col("rota_source"), F.col("__own")
    routed = frame.withColumn("__folded", fold_text(question)).withColumn("__tags", question_tags(folded))

    wanted = F.coalesce(given_source, infer_source(tags), F.lit(V.DEFAULT_SOURCE))
    inferred_dates = infer_dates(question, folded, tags, today)
    given_dates = F.struct(given_start.alias("start_date"), given_end.alias("end_date"))
    routed = routed.withColumns(
        {
            "__wanted": wanted,
            "__metrics": _first_filled(
                given_metrics, _named(tags, V.METRIC_WORDS, _metric), _texts(V.DEFAULT_METRICS)
            ),
            "__dimensions": _first_filled(
                given_dimensions, _named(tags, V.DIMENSION_WORDS, _dimension), _texts(V.DEFAULT_DIMENSIONS)
            ),
            "__filters": F.map_zip_with(
                infer_filters(tags), given_filters, lambda _, inferred, given: F.coalesce(given, inferred)
            ),
            "__dates": F.when(given_start.isNotNull() | given_end.isNotNull(), given_dates).otherwise(inferred_dates),
        }
    )
    routed = routed.withColumn(
        "rota_source",
        F.when(F.col("__wanted").isin(*SOURCES), F.col("__wanted")).otherwise(F.lit(V.DEFAULT_SOURCE)),
    )

    source_metrics = {name: list(s.metrics) for name, s in SOURCES.items()}
    source_dimensions = {name: list(s.dimensions) for name, s in SOURCES.items()}
    routed = routed.withColumns(
        {
            "__own_metrics": _per_source(source_metrics, chosen),
            "__own": _per_source(source_dimensions, chosen),
        }
    ).withColumns(
        {
            "__kept_metrics": _both(F.col("__metrics"), F.col("__own_metrics")),
            "__kept": _both(F.col("__dimensions"), own),
        }
    )

    def named(message: str) -> Column:
        before, after = message.split("{source}")
        return F.concat(F.lit(before), chosen, F.lit(after))

    no_range = F.col("__dates").isNull()
    is_empty = lambda given: ~(F.coalesce(F.size(given), F.lit(0)) > 0)
    notes = [
        F.when(given_source.isNull(), named(V.NOTE_SOURCE)),
        F.when(is_empty(given_metrics), F.lit(V.NOTE_METRICS)),
        F.when(is_empty(given_dimensions), F.lit(V.NOTE_DIMENSIONS)),
        F.when(no_range, F.lit(V.NOTE_NO_RANGE)),
        F.when(~no_range & F.col("__dates.start_date").isNull(), F.lit(V.NOTE_OPEN_START)),
        F.when(~no_range & F.array_contains(own, "period"), F.lit(V.NOTE_MONTHS)),
        F.when(chosen != V.DEFAULT_SOURCE, named(V.NOTE_DETAIL)),
    ]
    return routed.select(
        *frame.columns,
        "rota_source",
        _first_filled(F.col("__kept_metrics"), F.slice("__own_metrics", 1, 2)).alias("rota_metrics"),
        _first_filled(F.col("__kept"), F.slice("__own", 1, 1)).alias("rota_dimensions"),
        let(
            own, lambda known: F.map_filter("__filters", lambda field, _: F.array_contains(known, field))
        ).alias("rota_filters"),
        F.col("__dates.start_date").alias("rota_start_date"),
        F.col("__dates.end_date").alias("rota_end_date"),
        F.array_compact(F.array(*notes)).alias("rota_notes"),
    )


def distinct_questions(frame: DataFrame, text: str, **stated: str | None) -> DataFrame:
    """Each different question, with what its asker stated, and the number of rows that ask it (``perguntas``).

    A question that a third of the table asks is a row per task before it is shuffled.
    """
    columns = list(dict.fromkeys([text, *[c for c in stated.values() if c is not None]]))
    maps = [c for c in columns if frame.schema[c].dataType.typeName() == "map"]
    # Maps are no grouping keys; their entries in order are.
    keys = [F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in columns]
    counted = frame.select(*keys).groupBy(*columns).agg(F.count("*").alias("perguntas"))
    return counted.withColumns({c: F.map_from_entries(c) for c in maps})


def question_mix(frame: DataFrame, text: str, as_of: date | str | None = None, **stated: str | None) -> DataFrame:
    """``routing_mix`` of a table of questions, each different one routed once; arguments as of ``route_questions``."""
    return routing_mix(route_questions(distinct_questions(frame, text, **stated), text, as_of, **stated), "perguntas")


def routing_mix(routed: DataFrame, weight: str | None = None) -> DataFrame:
    """How many questions ask for each key of each source, and how many go to the source at all.

    ``weight`` names the column that says how many questions a row stands for; one each without it.
    """
    kinds = {"source": F.array("rota_source"), "metric": F.col("rota_metrics"), "dimension": F.col("rota_dimensions")}

    def marked(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda key: F.struct(F.lit(kind).alias("tipo"), key.alias("chave")))

    asked = F.concat(*[marked(kind, keys) for kind, keys in kinds.items()])
    each = F.lit(1).cast("long") if weight is None else F.col(weight)
    return (
        routed.select(F.col("rota_source").alias("fonte"), each.alias("n"), F.explode(asked).alias("item"))
        .groupBy("fonte", "item.tipo", "item.chave")
        .agg(F.sum("n").alias("perguntas"))
    )
