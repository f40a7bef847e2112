"""Language identification by partial matching (PPM) over bytes.

Per language, a tree of byte contexts up to three long holds the counts of the
bytes that follow.  A byte is coded in its longest context; where that has not
seen it, an escape is coded (method C: as likely as the context has different
followers) and the next shorter context is tried, down to equal chances for
all bytes.  The statistics are frozen after learning, so the code length of a
byte depends on it and the three before it only; a text's language is the
one whose tree codes it in the fewest bits.

The trees are kept as tables of code lengths of the grams that any language
has seen, so that a text is scored with a few array lookups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the longest context.
ORDER = 3
#: What stands before a text.
_START = b"\n" * ORDER
#: Bytes that are scored at a time.
_AT_ONCE = 1 << 19


@dataclass(frozen=True)
class Trees:
    languages: list[str]
    #: Rank of each byte; 0 for those never seen.
    rank: np.ndarray
    #: Numbers of the grams of three and four ranks, 0 for those never seen.
    threes: np.ndarray
    fours: np.ndarray
    #: Code lengths in bits by gram and language: of the last byte of a gram, and of an escape after it.
    four_bits: np.ndarray
    three_bits: np.ndarray
    two_bits: np.ndarray
    escape_three: np.ndarray
    escape_two: np.ndarray

    def bits(self, data: np.ndarray) -> np.ndarray:
        """The code length of each byte after the first three, by language."""
        n = len(self.rank_names)
        r = self.rank[data].astype(np.int32)
        grams = self.threes[(r[:-2] * n + r[1:-1]) * n + r[2:]]
        context, tail = grams[:-1], grams[1:]
        four = self.fours[context, r[3:]]
        out = self.four_bits[four]
        new = np.flatnonzero(four == 0)
        if len(new):
            bits = self.three_bits[tail[new]]
            unseen = np.flatnonzero(tail[new] == 0)
            if len(unseen):
                at = new[unseen] + 1
                bits[unseen] = self.escape_two[r[at] * n + r[at + 1]] + self.two_bits[r[at + 1] * n + r[at + 2]]
            out[new] = self.escape_three[context[new]] + bits
        return out

    @property
    def rank_names(self) -> range:
        return range(int(self.rank.max()) + 1)


def grow(languages: list[str], grams: np.ndarray, language: np.ndarray, counts: np.ndarray) -> Trees:
    """Trees from counts of grams of four bytes (as one number each) by language."""
    n_lang = len(languages)
    raw = np.stack([(grams >> s) & 255 for s in (24, 16, 8, 0)], axis=1).astype(np.int64)
    seen = np.unique(raw)
    rank = np.zeros(256, np.int32)
    rank[seen] = np.arange(1, len(seen) + 1)
    n = len(seen) + 1
    r = rank[raw].astype(np.int64)

    def level(k: int) -> tuple[np.ndarray, np.ndarray]:
        """The different grams of the last k + 1 ranks, and their counts by language."""
        code = np.zeros(len(r), np.int64)
        for column in range(3 - k, 4):
            code = code * n + r[:, column]
        keys, inverse = np.unique(code, return_inverse=True)
        table = np.zeros((len(keys), n_lang))
        np.add.at(table, (inverse, language), counts)
        return keys, table

    shorter = np.full((n, n_lang), 8.0)  # equal chances for all bytes
    escapes: list[np.ndarray] = []
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    lower_keys: np.ndarray | None = None
    lower_bits = shorter
    for k in range(ORDER + 1):
        keys, table = level(k)
        context, inverse = np.unique(keys // n, return_inverse=True)
        total, kinds = np.zeros((len(context), n_lang)), np.zeros((len(context), n_lang))
        np.add.at(total, inverse, table)
        np.add.at(kinds, inverse, table > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(kinds > 0, -np.log2(kinds / (total + kinds)), 0.0)
            own = -np.log2(table / (total + kinds)[inverse])
        below = lower_bits[keys % n] if k == 0 else lower_bits[np.searchsorted(lower_keys, keys % n**k)]
        bits = np.where(table > 0, own, escape[inverse] + below)
        tables.append((keys, bits))
        escapes.append((context, escape))
        lower_keys, lower_bits = keys, bits
    # Orders 0 and 1 are filled in for all pairs of ranks.
    one = np.broadcast_to(escapes[0][1][0] + 8.0, (n, n_lang)).copy()
    one[tables[0][0]] = tables[0][1]
    two = np.tile(one, (n, 1)).reshape(n, n, n_lang)
    two[escapes[1][0]] += escapes[1][1][:, None, :]
    two = two.reshape(n * n, n_lang)
    two[tables[1][0]] = tables[1][1]
    threes = np.zeros(n**3, np.int32)
    threes[tables[2][0]] = np.arange(1, len(tables[2][0]) + 1)
    # Contexts of three that only start a text are grams of their own.
    extra = np.setdiff1d(escapes[3][0], tables[2][0])
    threes[extra] = len(tables[2][0]) + 1 + np.arange(len(extra))
    n_threes = len(tables[2][0]) + len(extra)
    escape_two = np.zeros((n * n, n_lang))
    escape_two[escapes[2][0]] = escapes[2][1]
    three_bits = np.zeros((n_threes + 1, n_lang))
    three_bits[threes[tables[2][0]]] = tables[2][1]
    if len(extra):
        three_bits[threes[extra]] = escape_two[extra // n] + two[extra % (n * n)]
    escape_three = np.zeros((n_threes + 1, n_lang))
    escape_three[threes[escapes[3][0]]] = escapes[3][1]
    fours = np.zeros((n_threes + 1, n), np.int32)
    keys = tables[3][0]
    fours[threes[keys // n], keys % n] = np.arange(1, len(keys) + 1)
    four_bits = np.concatenate([np.zeros((1, n_lang)), tables[3][1]])
    small = [x.astype(np.float32) for x in (four_bits, three_bits, two, escape_three, escape_two)]
    return Trees(languages, rank, threes, fours, *small)


def text_bits(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """The code length of each text, by language."""
    out = np.zeros((len(texts), len(trees.languages)))
    group: list[int] = []
    size = 0

    def score(members: list[int]) -> None:
        data = np.frombuffer(b"".join(_START + texts[i] for i in members), np.uint8)
        bits = trees.bits(data)
        start = 0
        for i in members:
            out[i] = bits[start : start + len(texts[i])].sum(axis=0, dtype=np.float64)
            start += len(texts[i]) + ORDER

    for i, text in enumerate(texts):
        if len(text) > _AT_ONCE:
            for start in range(0, len(text), _AT_ONCE):
                before = _START if start == 0 else text[start - ORDER : start]
                out[i] += trees.bits(np.frombuffer(before + text[start : start + _AT_ONCE], np.uint8)).sum(axis=0, dtype=np.float64)
            continue
        group.append(i)
        size += len(text)
        if size > _AT_ONCE:
            score(group)
            group, size = [], 0
    if group:
        score(group)
    return out


def learn(documents: DataFrame, fit_rows: int = 4_000) -> Trees | None:
    """Trees from ``documents`` (``doc_id``, ``text``, ``lang``), about ``fit_rows`` whole texts per language at most.

    The texts are taken by the hash of the id and the text.  Null languages and
    texts teach nothing; None if there is nothing to learn from.
    """
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    have = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # a row per language
    if not have:
        return None
    share = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 20))
    taken = F.lit(False)
    for language, n in have.items():
        taken = taken | ((F.col("lang") == language) & (share < int((1 << 20) * min(1.0, fit_rows / n))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts: dict[str, list[bytes]] = {}
            for name, text in zip(names, batch.column(1)):
                texts.setdefault(name, []).append(_START + text.as_py().encode("utf-8", "surrogatepass"))
            for name, parts in texts.items():
                codes = []
                for part in parts:
                    x = np.frombuffer(part, np.uint8).astype(np.uint32)
                    codes.append(x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:])
                grams, counts = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    counted = usable.where(taken).select("lang", "text").mapInArrow(each, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counted.toPandas().sort_values(["lang", "gram"])  # bounded by the texts that are fitted on
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    number = {x: i for i, x in enumerate(languages)}
    return grow(languages, rows["gram"].to_numpy(np.int64), rows["lang"].map(number).to_numpy(), rows["n"].to_numpy(float))


def identify(documents: DataFrame, trees: Trees | None, keep: list[str] | None = None) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` for every row of ``documents`` (``doc_id``, ``text``).

    A text that is null or has no letter is ``und`` with score 0, as is every text
    without trees.  The score is the language's share of the likelihoods; ties
    go to the first language in text order.  Repeated rows each get their row;
    an empty table gives no rows; a kept column named like a result gives way.
    """
    keep = ["doc_id", *[c for c in keep or [] if c.lower() not in ("lang_pred", "score", "doc_id")]]
    shared = documents.sparkSession.sparkContext.broadcast(trees)  # bounded by the texts that were fitted on

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(0)]
            usable = [i for i, t in enumerate(texts) if trees is not None and any(map(str.isalpha, t))]
            names: list[str] = ["und"] * len(texts)
            scores = np.zeros(len(texts))
            if usable:
                bits = text_bits(trees, [texts[i].encode("utf-8", "surrogatepass") for i in usable])
                best = bits.argmin(axis=1)
                over = np.exp2(np.minimum(0.0, np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0)))
                scores[usable] = 1 / over.sum(axis=1)
                for i, k in zip(usable, best):
                    names[i] = trees.languages[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names), pa.array(scores)], names=[*batch.schema.names[1:], "lang_pred", "score"])

    kept = documents.select(F.col("text").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[1:]) + "lang_pred string, score double"
    return kept.mapInArrow(each, schema)
