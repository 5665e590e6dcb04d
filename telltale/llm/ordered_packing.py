"""Packing that keeps the documents' order: cuts between sequences are chosen by dynamic programming.

The documents of a partition are one stream of tokens. It may be cut after a document, after a sentence at a price, and at a higher price
at fixed distances within what has no sentence end for long. Of all ways to cut it into windows of at most ``capacity``
tokens the one of least padding plus prices is taken. A window is padded to the capacity unless its length is a power of two; so the
cheapest start for a window that ends at ``j`` is the least ``cost + place`` among the starts in reach, which a monotone queue
holds, or one of the few starts a power of two before ``j``.

The order is that of the table's rows, so nothing is shuffled: each task packs what it reads. Costs are settled, and pieces
given out, whenever enough tokens have come in, except for the last few windows, whose cuts may still change; so a task holds a bounded
part of its stream, and a text of any length is cut like others.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CACHE_ENTRIES, LibraryIds, byte_table, library_tokenizer, tidied
from .scratch import partitions

#: Prices of a cut within a document, in tokens of padding.
SENTENCE_CUT, WORD_CUT = 8, 64
#: A stretch of more tokens than this without a sentence end may be cut at each multiple of half of it.
STRETCH = 128
#: Tokens after which cuts are settled, and windows at the end that are kept open then.
SETTLE, OPEN = 1 << 19, 8


@functools.lru_cache(maxsize=4)
def marks(path: str) -> tuple[np.ndarray, np.ndarray]:
    """For each id of a vocabulary, whether it ends a sentence (a full stop, question or exclamation mark and other punctuation,
    no letter or digit), and whether it is a number."""
    byte_of = {c: i for i, c in enumerate(byte_table())}
    vocabulary = library_tokenizer(path).get_vocab()
    enders, digits = np.zeros(max(vocabulary.values()) + 1, bool), np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        shown = bytes(byte_of.get(c, 0x3F) for c in token.removesuffix("</w>")).decode(errors="ignore").strip()
        enders[i] = bool(re.fullmatch(r"[^\w\s]*[.!?…。！？][^\w\s]*", shown))
        digits[i] = shown.isdigit()
    return enders, digits


def sentence_ends(ids: np.ndarray, path: str) -> np.ndarray:
    """Places after which a sentence is over, of a document's ids; a full stop between two digits isn't one."""
    enders, digits = marks(path)
    known = ids < len(enders)
    safe = np.where(known, ids, 0)
    ends, digit = enders[safe] & known, digits[safe] & known
    over = ends[:-1] & ~ends[1:]
    over[1:] &= ~(digit[:-2] & digit[2:])
    return np.flatnonzero(over) + 1


def cuts(length: int, sentences: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a document of ``length`` tokens may be cut, its end among them, and their prices."""
    stretch = min(STRETCH, capacity)
    bounds = np.concatenate(([0], sentences, [length]))
    gaps = np.diff(bounds)
    inner = [np.arange(bounds[i] + stretch // 2 or 1, bounds[i + 1], stretch // 2 or 1) for i in np.flatnonzero(gaps > stretch)]
    forced = np.concatenate(inner) if inner else np.zeros(0, np.int64)
    places = np.concatenate((sentences, forced, [length]))
    prices = np.concatenate((np.full(len(sentences), SENTENCE_CUT), np.full(len(forced), WORD_CUT), [0]))
    order = np.argsort(places, kind="stable")
    return places[order], prices[order]


def best_cuts(places: list[int], prices: list[int], capacity: int) -> list[int]:
    """Indices of the places at which to cut, the last one among them, for least padding plus prices from place 0 on.

    ``places`` ascend, no further than ``capacity`` apart. Of equally cheap ways the one whose windows start earlier is taken.
    """
    at = np.concatenate(([0], np.asarray(places, np.int64)))
    powers = [1 << k for k in range(capacity.bit_length()) if 1 << k <= capacity]
    exact: dict[int, list[int]] = {}
    for size in powers:  # windows whose length is a power of two
        found = np.searchsorted(at, at - size)
        ends = np.flatnonzero(at[found] == at - size)
        for j, i in zip(ends.tolist(), found[ends].tolist()):
            exact.setdefault(j, []).append(i)
    where, cost, origin = at.tolist(), [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (cost + place, index): both ascend
    for j in range(1, len(where)):
        place = where[j]
        while where[queue[0][1]] < place - capacity:
            queue.popleft()
        least, i = queue[0]
        least += capacity - place
        for k in exact.get(j, ()):
            if cost[k] < least or (cost[k] == least and k < i):
                least, i = cost[k], k
        cost[j] = least = least + prices[j - 1]
        origin[j] = i
        while queue and queue[-1][0] > least + place:
            queue.pop()
        queue.append((least + place, j))
    chosen, j = [], len(where) - 1
    while j:
        chosen.append(j - 1)
        j = origin[j]
    return chosen[::-1]


class Stream:
    """Documents whose tokens aren't all in a window yet."""

    def __init__(self, path: str, capacity: int, first: int):
        self.path, self.capacity, self.sequence = path, capacity, first
        self.documents: list[list] = []  # key, ids, the first id that is still open
        self.places: list[np.ndarray] = []
        self.prices: list[np.ndarray] = []
        self.length = 0

    def add(self, key: object, ids: np.ndarray) -> None:
        places, prices = cuts(len(ids), sentence_ends(ids, self.path), self.capacity)
        self.documents.append([key, ids, 0])
        self.places.append(places + self.length)
        self.prices.append(prices)
        self.length += len(ids)

    def settle(self, last: bool) -> Iterator[tuple]:
        """Pieces of the windows that are settled: of all of them if no more documents come."""
        if not self.length:
            return
        places, prices = np.concatenate(self.places), np.concatenate(self.prices)
        chosen = places[best_cuts(places.tolist(), prices.tolist(), self.capacity)]
        if not last:
            chosen = chosen[chosen <= self.length - OPEN * self.capacity]
        begin, done = 0, 0
        for end in chosen.tolist():
            offset = 0
            while offset < end - begin:
                key, ids, start = self.documents[done]
                length = min(len(ids) - start, end - begin - offset)
                own = np.ascontiguousarray(ids[start : start + length], "<u4")
                yield key, start, length, zlib.crc32(own), len(ids), self.sequence, offset, own
                offset += length
                self.documents[done][2] = start + length
                if start + length == len(ids):
                    done += 1
            begin, self.sequence = end, self.sequence + 1
        left = places > begin
        self.documents = self.documents[done:]
        self.places, self.prices, self.length = [places[left] - begin], [prices[left]], self.length - begin


def pack(df: DataFrame, path: str, end_id: int, capacity: int = 2048, order: list[Column | str] | None = None, key: str = "doc_id", text: str = "text", keep_ids: bool = False, entries: int = CACHE_ENTRIES) -> DataFrame:
    """Packs the documents of ``df`` in their order into sequences of at most ``capacity`` tokens; one row for each piece.

    Returns ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``, and ``ids`` on demand. The order
    is that of the rows in each partition of ``df``; with ``order`` rows are sorted by it first, in ranges. A sequence never spans
    partitions. Null and empty texts have the end id alone; texts of any length are cut like others. Repeated rows and null
    keys are packed each for itself, ties in ``order`` as they come. Other columns of any name are ignored. An empty table
    gives no rows. ``entries`` bounds what a worker remembers of its vocabulary.
    """
    row = [F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")]
    if order:
        df = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    slim = df.select(F.struct(*row).alias("_row")).select("_row.*")
    longs = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField(key, slim.schema["_key"].dataType), *[T.StructField(x, T.LongType(), False) for x in longs], *([T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = LibraryIds.of(path, entries), np.array([end_id], np.uint32)
        stream = Stream(path, capacity, TaskContext.get().partitionId() << 33)

        def batch_of(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*pieces))
            arrays = [pa.array(columns[0], kind), *[pa.array(c, pa.int64()) for c in columns[1:7]]]
            if keep_ids:
                arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for each, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1))):
                stream.add(each, np.concatenate((ids, end)))
                if stream.length >= max(SETTLE, 4 * OPEN * capacity):
                    pieces = list(stream.settle(last=False))
                    if pieces:
                        yield batch_of(pieces, kind)
        pieces = list(stream.settle(last=True))
        if pieces:
            yield batch_of(pieces, kind)

    return slim.mapInArrow(tidied(run), schema)
