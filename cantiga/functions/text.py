"""Case and accent folding with built-in column functions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_HANGUL = range(0xAC00, 0xD7A4)
_SURROGATES = range(0xD800, 0xE000)


@lru_cache(maxsize=1)
def _folding_rules() -> tuple[str, str, dict[str, str]]:
    """(characters, their replacements, characters that become several).

    Generated from the Unicode tables.  Characters past the end of the
    replacements are combining marks, which ``translate`` deletes.  Hangul
    syllables are not among them; they are taken apart by their numbers.
    """
    source, target, dropped, several = [], [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if code in _SURROGATES or code in _HANGUL:
            continue
        char = chr(code)
        folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if folded == char:
            continue
        if not folded:
            dropped.append(char)
        elif len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            several[char] = folded
    return "".join(source + dropped), "".join(target), several


@lru_cache(maxsize=1)
def _folding_table() -> dict[int, str | None]:
    source, target, several = _folding_rules()
    single = dict(zip(map(ord, source), [*target, *[None] * (len(source) - len(target))]))
    return single | {ord(char): letters for char, letters in several.items()}


def fold(text: str) -> str:
    """Folding of one word on the driver, for keyword lists: the same rules as ``fold_text``."""
    parts = [unicodedata.normalize("NFD", c) if ord(c) in _HANGUL else c for c in text.lower()]
    return "".join(parts).translate(_folding_table())


#: The letters that Hangul syllables are made of, numbered first, middle and last: the syllables are in the order of these numbers.
_FIRST, _MIDDLE, _LAST = range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)
_ANY_HANGUL = f"[{chr(_HANGUL[0])}-{chr(_HANGUL[-1])}]"


def _without_hangul(text: Column) -> Column:
    """Hangul syllables as the two or three letters they are made of."""

    def letter(letters: range, number: Column) -> Column:
        # The number 0 gives no letter.
        return F.substring(F.lit("".join(map(chr, letters))), number, F.when(number > 0, 1).otherwise(0))

    def letters(char: Column) -> Column:
        number = F.ascii(char) - _HANGUL[0]
        last = number % (len(_LAST) + 1)
        above = F.floor(number / (len(_LAST) + 1)).cast("int")
        middle, first = above % len(_MIDDLE) + 1, F.floor(above / len(_MIDDLE)).cast("int") + 1
        return F.concat(letter(_FIRST, first), letter(_MIDDLE, middle), letter(_LAST, last))

    chars = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(_ANY_HANGUL), letters(c)).otherwise(c))
    return F.when(text.rlike(_ANY_HANGUL), F.array_join(chars, "")).otherwise(text)


def fold_text(column: Column) -> Column:
    """Lower case, compatibility forms unified, combining marks removed.

    Plain ASCII text takes the first branch.  Only text holding a ligature or a
    similar character that becomes several letters takes the last one; most
    Latin text is cleared of that by the first, short class.
    """
    source, target, several = _folding_rules()
    lowered = F.lower(column)
    folded = F.translate(_without_hangul(lowered), source, target)
    spelling = F.map_from_arrays(word_list(several), word_list(several.values()))
    present = F.array_distinct(F.regexp_extract_all(folded, F.lit(f"({_near(several)})"), F.lit(0)))
    spelled_out = F.aggregate(
        present, folded, lambda text, char: F.replace(text, char, F.coalesce(F.try_element_at(spelling, char), char))
    )
    return (
        F.when(~column.rlike(r"[^\x00-\x7F]"), lowered)
        .when(~lowered.rlike(_near(several, 1)) | ~lowered.rlike(_near(several)), folded)
        .otherwise(spelled_out)
    )


def _near(chars: Iterable[str], runs_kept: int | None = None) -> str:
    """Character class of few ranges around ``chars``; gaps of up to 8 are filled.

    With ``runs_kept`` all ranges from that one on are taken as one, up to the
    last character there is: a class quicker to test that holds more.
    """
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code - runs[-1][1] <= 8:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    if runs_kept is not None:
        runs[runs_kept:] = [[runs[runs_kept][0], 0x10FFFF]]
    return "[" + "".join(f"{chr(first)}-{chr(last)}" for first, last in runs) + "]"


def word_list(words: Iterable[str]) -> Column:
    """Constant array of non-empty words."""
    return F.split(F.lit("\n".join(words)), "\n")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it.

    Without this, a column read inside a function over array elements may be
    merged into that function and computed again for each element.
    """
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), 0)


def longest_of(words: Iterable[str]) -> str:
    """Pattern for the longest of ``words`` at a position.

    Words that begin alike share their beginning, so a position is given up
    after one letter when no word begins with it.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [re.escape(char) + pattern(below) for char, below in node.items() if char]
        if not branches:
            return ""
        choice = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return choice + "?" if "" in node else choice

    return pattern(tree)
