"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Only counts by length reach the driver, at most ``capacity`` of them. Best-fit decreasing runs over these counts:
bins that look alike are one group with a multiplicity, so a step places all pieces of a length that go to alike
bins. The plan says which ranks within a length go to which sequences; pieces take their place by joining on
(length, rank within length). Ranks are counted in salted parts of a length, so no length is sorted in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CACHE_ENTRIES, LibraryIds, tidied
from .scratch import partitions, written

PIECE = T.StructType([T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids_crc32", T.LongType(), False), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def cut_points(total: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces; all but the first are full."""
    first = total % capacity or capacity
    starts = [0, *range(first, total, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], total])]


def pieces_of(text: Column | str, path: str, end_id: int, capacity: int, keep_ids: bool = False, entries: int = CACHE_ENTRIES) -> Column:
    """An array with the pieces of each text's ids and ``end_id`` after them; null counts as empty."""

    @F.arrow_udf(T.ArrayType(PIECE, False))
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        ids_of, kind, end = LibraryIds.of(path, entries), to_arrow_type(PIECE), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ends, rows = [0], []
            for ids in ids_of(batch):
                raw = ids.tobytes() + end
                for i, (start, length) in enumerate(cut_points(len(raw) // 4, capacity)):
                    own = raw[4 * start : 4 * (start + length)]
                    rows.append((i, start, length, zlib.crc32(own), np.frombuffer(own, "<u4") if keep_ids else None))
                ends.append(len(rows))
            columns = list(zip(*rows)) or [[]] * 5
            arrays = [pa.array(c, f.type) for c, f in zip(columns, kind)]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, fields=list(kind)))

    return run(F.col(text) if isinstance(text, str) else text)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    Returns slots (length, first rank, past the last rank, pieces in each sequence, first sequence, offset) and the
    number of sequences. Ranks ``first + i`` go to sequence ``first sequence + i // pieces`` at ``offset + (i % pieces) *
    length``.
    """
    free: list[int] = []  # room left, ascending
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(room: int, pattern: tuple[tuple[int, int], ...], n: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(free, room)
        groups[room].append((pattern, n))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit into {capacity}")
        left = histogram[length]
        while left:
            at = bisect_left(free, length)
            room = free[at] if at < len(free) else capacity
            each = min(room // length, left)
            if at < len(free):
                pattern, n = groups[room].pop()
            else:
                pattern, n = (), left // each
            used = min(n, left // each)
            if at < len(free):
                if n > used:
                    groups[room].append((pattern, n - used))
                if not groups[room]:
                    del groups[room]
                    free.pop(at)
            put(room - each * length, (*pattern, (length, each)), used)
            left -= used * each
    slots, ranks, sequences = [], dict.fromkeys(histogram, 0), 0
    for room in sorted(groups):
        for pattern, n in groups[room]:
            offset = 0
            for length, each in pattern:
                first = ranks[length]
                ranks[length] = past = first + n * each
                slots.append((length, first, past, each, sequences, offset))
                offset += each * length
            sequences += n
    return slots, sequences


def ranked(pieces: DataFrame, order: list[str], length: str = "length") -> DataFrame:
    """Adds ``_rank``, from 0 and without gaps within a length, counted in salted parts of each length."""
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(partitions(pieces.sparkSession))))
    counts = salted.groupBy(length, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(length, "_part", (F.sum("_n").over(Window.partitionBy(length).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(length, "_part").orderBy(*order)) - 1
    return salted.withColumn("_own", own).join(before, [length, "_part"]).withColumn("_rank", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def place(pieces: DataFrame, order: list[str], capacity: int, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``.

    ``pieces`` is read twice and must give the same rows both times: pass a written table. The plan is broadcast; it
    has at most a few slots for each of ``capacity`` lengths, whatever the number of rows.
    """
    spark = pieces.sparkSession
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).agg(F.count(F.lit(1))).collect()}
    slots, _ = plan(histogram, capacity)
    names = [length, "_first", "_past", "_each", "_sequence", "_offset"]
    table = spark.createDataFrame(slots, ", ".join(f"{x} long" for x in names))
    joined = ranked(pieces, order, length).join(F.broadcast(table), [length])
    at = F.col("_rank") - F.col("_first")
    found = joined.where((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_past")))
    return found.withColumns({"sequence_id": (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long"), "offset": (F.col("_offset") + (at % F.col("_each")) * F.col(length)).cast("long")}).drop("_rank", *names[1:])


def pack(df: DataFrame, path: str, end_id: int, capacity: int = 1024, key: str = "doc_id", text: str = "text", keep_ids: bool = False, entries: int = CACHE_ENTRIES, tag: str = "query") -> DataFrame:
    """Packs the documents of ``df`` into sequences of at most ``capacity`` tokens; one row for each piece.

    Returns ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and ``offset``, and ``ids`` on demand.
    A document longer than ``capacity`` is cut into full pieces, of which only the first may be shorter. Null and empty
    texts have the end id alone. Repeated rows are packed each for itself, null keys included; ties in the order of ranks
    are between pieces of equal length, so any of them may take either place. An empty table gives no rows. ``entries`` bounds
    what a worker remembers of its vocabulary, and so its memory.
    """
    row = F.struct(F.col(key).alias("_key"), F.col(text).alias("_text"))
    slim = df.select(row.alias("_row")).select("_row._key", F.explode(pieces_of(F.col("_row._text"), path, end_id, capacity, keep_ids, entries)).alias("_p"))
    pieces = written(slim.select("_key", *[f"_p.{x}" for x in ("piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []))]), "pieces", tag)
    return place(pieces, ["_key", "piece", "ids_crc32"], capacity).withColumnRenamed("_key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack(..., keep_ids=True)``; a group holds one sequence's pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.flatten(F.col("_parts.ids")).alias("ids"))
