"""Counts of a text that quality decisions read: one pass over whole texts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cantiga.llm.common import WORD, per_text

#: Words of a window whose repetition is counted.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(WORD)
_BLANKS = " \t\n\v\f\r"

#: Every count, in the order of ``counts``.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words",
    "n_top_word", "n_same_next", "n_exclamations", "n_bars", "n_stops", "n_commas", "n_digits", "n_more_bytes",
)

#: Shares that thresholds are put on: name, count, count it is divided by.
SHARES = (
    ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"),
    ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper_words", "n_words"),
    ("distinct_share", "n_distinct_words", "n_words"),
    ("top_word_share", "n_top_word", "n_words"),
    ("same_next_share", "n_same_next", "n_words"),
    ("exclamations_per_word", "n_exclamations", "n_words"),
    ("bars_per_word", "n_bars", "n_words"),
    ("stops_per_word", "n_stops", "n_words"),
    ("commas_per_word", "n_commas", "n_words"),
    ("digits_per_char", "n_digits", "word_chars"),
    ("chars_per_word", "word_chars", "n_words"),
    ("words_per_line", "n_words", "n_lines"),
)


def _codes(values: np.ndarray, more: np.ndarray) -> np.ndarray:
    """One small number for each different pair."""
    return np.unique(values * (int(more.max()) + 1) + more, return_inverse=True)[1]


def _repeated(ids: np.ndarray) -> int:
    """Words that lie in a window found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    # Windows are numbered exactly: pairs, pairs of pairs, and the fifth word.
    pairs = _codes(ids[:-1], ids[1:])
    fours = _codes(pairs[:-2], pairs[2:])
    windows = _codes(fours[:n], ids[WINDOW - 1 :])
    again = np.bincount(windows)[windows] > 1
    if not again.any():
        return 0
    edges = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edges, np.flatnonzero(again), 1)
    np.add.at(edges, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def counts(text: str | None) -> tuple[int, ...]:
    """The counts of one text; all 0 for null."""
    if not text:
        return (0,) * len(COUNTS)
    words = _WORD.findall(text)
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [line for line in text.split("\n") if line.strip(_BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, _BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(ids) if len(number) < len(words) else 0,
        len(lines),
        sum(map(str.isupper, words)),
        len(number),
        int(np.bincount(ids).max()) if words else 0,
        int((ids[1:] == ids[:-1]).sum()),
        text.count("!"),
        text.count("|"),
        text.count("."),
        text.count(","),
        sum(map(text.count, "0123456789")),
        len(text.encode("utf-8", "surrogatepass")) - len(text),
    )


def with_counts(documents: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of ``documents`` and the counts of each text."""

    def each(texts: pa.Array) -> list[pa.Array]:
        found = np.array([counts(x.as_py()) for x in texts], np.int64).reshape(-1, len(COUNTS))
        return [pa.array(found[:, i]) for i in range(len(COUNTS))]

    return per_text(documents, keep, dict.fromkeys(COUNTS, "long"), each, text)


def shares(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The shares of many texts at once; 0 where there is nothing to divide by."""
    return {name: values[a] / np.maximum(values[b], 1) for name, a, b in SHARES} | {"n_words": values["n_words"].astype(float)}
