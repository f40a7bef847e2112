"""Cost-balanced packing of tokenized documents into sequences.

The cost of attention over a piece of n tokens is estimated as a linear and a
quadratic part.  Pieces are taken by descending length; each goes whole to the
sequence of the lowest cost among those with room for it.  A piece that no
sequence has room for is cut over the sequences with most room.  A batch opens
just as many sequences as its tokens need, so all are full but the last; the
rest of the batch goes to sequences whose lengths are powers of two.

Documents are packed with others of their input partition, as they are
tokenized: neither text nor token ids are shuffled.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of text before the merges: a fixed part of the vocabulary's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The one special token of the vocabulary; its text stands for its id, as the tokenizer file has it.
SPECIAL = {"<|endoftext|>": 50256}
#: The id after each document.
END = 1

_NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
_ARROW = pa.schema([(name, pa.int64()) for name in _NAMES])


class _Open:
    """Sequences with room, by the room they have: a tree over all rooms gives the cheapest that has enough."""

    def __init__(self, capacity: int, rooms: list[int]) -> None:
        self._size = 1 << capacity.bit_length()
        self._by_room: dict[int, list[tuple[float, int]]] = {}
        for k, room in enumerate(rooms):
            self._by_room.setdefault(room, []).append((0.0, k))
        # Of each part of the rooms: cost, less room, number.
        self._best: list[tuple[float, int, int] | None] = [None] * (2 * self._size)
        for room in self._by_room:
            self._renew(room)

    def _renew(self, room: int) -> None:
        of_room = self._by_room[room]
        self._best[self._size + room] = (of_room[0][0], -room, of_room[0][1]) if of_room else None
        at = (self._size + room) // 2
        while at:
            some = [x for x in self._best[2 * at : 2 * at + 2] if x is not None]
            self._best[at] = min(some, default=None)
            at //= 2

    def take(self, length: int) -> tuple[float, int] | None:
        """The cheapest sequence with so much room, of equal ones the one with most; it is no longer among the open ones."""
        found, low, high = None, self._size + length, 2 * self._size
        while low < high:
            for at, odd in ((low, low & 1), (high - 1, high & 1)):
                if odd and self._best[at] is not None and (found is None or self._best[at] < found):
                    found = self._best[at]
            low, high = (low + 1) // 2, high // 2
        if found is None:
            return None
        cost, room, k = found
        heapq.heappop(self._by_room[-room])
        self._renew(-room)
        return cost, k

    def add(self, cost: float, k: int, room: int) -> None:
        if room:
            heapq.heappush(self._by_room.setdefault(room, []), (cost, k))
            self._renew(room)


def pack(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token once.

    All sequences are full, but for the last ones, whose lengths are powers of two.
    Equal lengths go in the order given.
    """
    pieces, rest, sequences = [], [], 0
    for document, length in enumerate(lengths):
        for start in range(0, length - capacity + 1, capacity):
            pieces.append((document, start, capacity, sequences, 0))
            sequences += 1
        if length % capacity:
            rest.append((length % capacity, document, length - length % capacity))
    total = sum(length for length, _, _ in rest)
    rooms = [capacity] * (total // capacity)
    # The binary digits of what is over are the lengths of the last sequences.
    over = total % capacity
    rooms += [1 << bit for bit in range(over.bit_length() - 1, -1, -1) if over >> bit & 1]
    open_ones, used, cut = _Open(capacity, rooms), [0] * len(rooms), []

    def put(document: int, start: int, length: int, k: int) -> None:
        pieces.append((document, start, length, sequences + k, used[k]))
        used[k] += length

    for length, document, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        found = open_ones.take(length)
        if found is None:
            cut.append((length, document, start))
            continue
        spent, k = found
        put(document, start, length, k)
        open_ones.add(spent + linear * length + quadratic * length * length, k, rooms[k] - used[k])
    open_rooms = sorted((k for k in range(len(rooms)) if used[k] < rooms[k]), key=lambda k: (used[k] - rooms[k], k))
    at = 0
    for length, document, start in cut:
        while length:
            k = open_rooms[at]
            part = min(length, rooms[k] - used[k])
            put(document, start, part, k)
            start, length, at = start + part, length - part, at + (used[k] == rooms[k])
    return pieces


#: Runs of blanks, or of anything else, from which on a text goes to the tokenizer file.
_LONG_RUN = re.compile(r"\s{8192}|\S{8192}")


def encoder(ranks_path: str, tokenizer_path: str) -> Callable[[str], list[int]]:
    """The ids of a text under a byte-level BPE vocabulary, given as a rank file and as a tokenizer file.

    Both give the same ids (see the tests).  The ranks are several times as fast,
    but long runs take them time that grows with the square of the run, and very
    long ones of blanks are more than they can take; such texts, and any they
    fail on, go to the tokenizer file.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    slow: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if len(text) < 8192 or not _LONG_RUN.search(text):
            try:
                return encoding.encode(text, allowed_special="all")
            except ValueError:
                pass
        if not slow:
            slow.append(Tokenizer.from_file(tokenizer_path))
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def pack_documents(documents: DataFrame, ranks_path: str, tokenizer_path: str, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1 / 1024, batch_tokens: int = 4_000_000, with_ids: bool = False) -> DataFrame:
    """Pack ``documents`` (``doc_id``, ``text``) into sequences of ``capacity`` tokens.

    One row per piece: doc_id, start (the document's ids before it), length,
    ids_crc32, doc_tokens (with the end id), sequence_id, offset; with
    ``with_ids`` also its token ids.  A null or empty text has the end id only.
    A document of any length is cut; null ids and repeated rows are documents
    like others; other columns are ignored; an empty table gives no rows.
    ``batch_tokens`` is how many tokens are packed together, at the least; the
    files must lie at ``ranks_path`` and ``tokenizer_path`` on every executor.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        encode = encoder(ranks_path, tokenizer_path)
        first = TaskContext.get().partitionId() << 32
        doc_ids, texts_ids, tokens = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal first, doc_ids, texts_ids, tokens
            pieces = pack([len(x) for x in texts_ids], capacity, linear, quadratic)
            parts = [texts_ids[d][start : start + length] for d, start, length, _, _ in pieces]
            columns = [
                [doc_ids[p[0]] for p in pieces],
                [p[1] for p in pieces],
                [p[2] for p in pieces],
                [zlib.crc32(part.tobytes()) for part in parts],
                [len(texts_ids[p[0]]) for p in pieces],
                [first + p[3] for p in pieces],
                [p[4] for p in pieces],
            ]
            arrays = [pa.array(c, pa.int64()) for c in columns]
            schema = _ARROW
            if with_ids:
                ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
                arrays.append(pa.LargeListArray.from_arrays(ends, np.concatenate(parts).astype(np.int32)).cast(pa.list_(pa.int32())))
                schema = schema.append(pa.field("ids", pa.list_(pa.int32())))
            first += 1 + max(p[3] for p in pieces)
            doc_ids, texts_ids, tokens = [], [], 0
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(END)
                doc_ids.append(doc_id)
                texts_ids.append(np.array(ids, dtype="<u4"))
                tokens += len(ids)
                if tokens >= batch_tokens:
                    yield packed()
        if doc_ids:
            yield packed()

    schema = ", ".join(f"{name} long" for name in _NAMES) + (", ids array<int>" if with_ids else "")
    return documents.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(each, schema)
