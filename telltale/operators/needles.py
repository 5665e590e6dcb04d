"""Theta join of texts and needles: where each entry of a lexicon, a table, stands in each text of another table.

A lexicon of a checked size goes to every task, which finds all needles in one pass over a text with an automaton. Texts and a larger
one meet by a join on the needles' first word, with as much of the text as the longest needle has. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.functions import features as X
from telltale.functions.places import LineIndex

#: The largest lexicon that goes to every task, in needles and in characters.
MOST_NEEDLES, MOST_CHARS = 200_000, 4_000_000
_FIRST = regex.compile(r"[\p{L}\p{N}_]+|\S")
_RUN = regex.compile(r"\s{2,}")
_SPACE = regex.compile(r"\s")
PLACES = ["start", "end", "line"]


@lru_cache(maxsize=10_000)
def _in_word(char: str) -> bool:
    return regex.match(r"[\p{L}\p{N}_]", char) is not None


class Spaced:
    """A text with each run of white space as one space, and the way back to its own places."""

    def __init__(self, text: str):
        runs = [m.span() for m in _RUN.finditer(text)]
        self.text = _SPACE.sub(" ", _RUN.sub(" ", text))
        lost = np.cumsum([0, *[b - a - 1 for a, b in runs]])
        self.after, self.lost = np.array([a for a, _ in runs], np.int64) - lost[:-1], lost

    def places(self, at: np.ndarray) -> np.ndarray:
        return at + self.lost[np.searchsorted(self.after, at)]

    def whole(self, start: int, end: int) -> bool:
        """Whether no letter, digit or underscore stands right before or after."""
        return not (start and _in_word(self.text[start - 1]) or end < len(self.text) and _in_word(self.text[end]))


def prepared_needle(needle: Column) -> Column:
    """In lower case, with single spaces and straight apostrophes, as texts are; null for nothing."""
    plain = F.regexp_replace(X.stripped(X.lowered(X.normalised(needle))), r"(?U)\s+", " ")
    return F.when(plain != "", plain)


@lru_cache(maxsize=4)
def _automaton(needles: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        found.add_word(needle, (i, len(needle)))
    found.make_automaton()
    return found


def _by_automaton(texts: DataFrame, needles: pa.Table, kind: T.DataType) -> DataFrame:
    entries = needles.group_by("needle").aggregate([("id", "list")])
    words, ids = tuple(entries.column("needle").to_pylist()), entries.column("id_list").to_pylist()
    schema = T.StructType([T.StructField("_key", texts.schema["_key"].dataType), T.StructField("_needle_id", kind), *[T.StructField(x, T.IntegerType()) for x in PLACES]])
    id_type = needles.schema.field("id").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(words) if words else None
        for batch in batches:
            keys, hits, places = batch.column(0), [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if not text or automaton is None:
                    continue
                own = Spaced(text)
                found = [(end + 1 - n, end + 1, i) for end, (i, n) in automaton.iter(own.text) if own.whole(end + 1 - n, end + 1)]
                if found:
                    starts, lasts = (np.array(x, np.int64) for x in zip(*[(a, b - 1) for a, b, _ in found]))
                    starts, lasts = own.places(starts), own.places(lasts)
                    lines = LineIndex(text).lines(starts)
                    for a, b, line, (_, _, i) in zip(starts.tolist(), lasts.tolist(), lines.tolist(), found):
                        hits.extend((row, x) for x in ids[i])
                        places.extend([(a, b + 1, line)] * len(ids[i]))
            rows, which = zip(*hits) if hits else ((), ())
            columns = zip(*places) if places else ((), (), ())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(which, id_type), *[pa.array(c, pa.int32()) for c in columns]], schema.names)

    return texts.mapInArrow(run, schema)


def _by_first_word(texts: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """Each word of a text is a row with the text around it: what comes after it as far as the longest needle goes, and the character before."""
    schema = T.StructType([T.StructField("_key", texts.schema["_key"].dataType), T.StructField("_first", T.StringType()), T.StructField("_ahead", T.StringType()), T.StructField("_from", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("_to", T.ArrayType(T.IntegerType()))])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = Spaced(text or "")
                spans = [m.span() for m in _FIRST.finditer(own.text)]
                starts = own.places(np.array([a for a, _ in spans], np.int64))
                ahead = [own.text[a : a + longest + 1] for a, _ in spans]
                ends = [(own.places(np.arange(a, a + len(x))) + 1).astype(np.int32) for (a, _), x in zip(spans, ahead)]
                kept = [i for i, (a, _) in enumerate(spans) if own.whole(a, len(own.text))]
                columns = [[own.text[slice(*spans[i])] for i in kept], [ahead[i] for i in kept], starts[kept], LineIndex(text or "").lines(starts[kept]), [ends[i] for i in kept]]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(kept), pa.int64())), *arrays], schema.names)

    @F.arrow_udf("string")
    def first(needles: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in needles:
            yield pa.array([_FIRST.match(x).group() for x in part.to_pylist()], pa.string())

    met = texts.mapInArrow(words, schema).join(lexicon.withColumn("_first", first("_needle")), "_first")
    size = F.length("_needle")
    after = F.substring(F.col("_ahead"), size + 1, F.lit(1))
    held = met.where(F.startswith(F.col("_ahead"), F.col("_needle")) & ~after.rlike(r"[\p{L}\p{N}_]"))
    return held.select("_key", "_needle_id", F.col("_from").alias("start"), F.get("_to", size - 1).alias("end"), "line")


def needle_hits(texts: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", needle_id: str = "needle_id", needle: str = "needle", most: int = MOST_NEEDLES) -> DataFrame:
    """``key, needle_id, start, end, line`` of every place where a needle stands between word boundaries, overlapping ones included.

    Texts are compared normalised and in lower case, white space of any length is like one space in a needle, and places are
    characters of the normalised text, from 0, with lines from 1. Null and empty texts and needles have no hits; a needle that
    several ids have gives a row for each. Null and repeated keys are each a row of their own. Texts are taken whole. Other columns of any
    name are ignored.
    """
    slim = texts.select(F.struct(F.col(key).alias("_key"), X.lowered(X.normalised(F.col(text))).alias("_text")).alias("_row")).select("_row.*")
    own = lexicon.select(F.col(needle_id).alias("_needle_id"), prepared_needle(F.col(needle)).alias("_needle")).where("_needle IS NOT NULL").distinct()
    n, chars, longest = own.agg(F.count(F.lit(1)), F.sum(F.length("_needle")), F.max(F.length("_needle"))).first()
    if n <= most and (chars or 0) <= MOST_CHARS:
        table = own.select(F.col("_needle_id").alias("id"), F.col("_needle").alias("needle")).toArrow()
        found = _by_automaton(slim, table, own.schema["_needle_id"].dataType)
    else:
        found = _by_first_word(slim, own, longest)
    return found.select(F.col("_key").alias(key), F.col("_needle_id").alias(needle_id), *PLACES)


def configured(lexicon: DataFrame, ignored: DataFrame, extra: DataFrame, needle: str = "needle") -> DataFrame:
    """One column of needles: those of ``lexicon`` and of ``extra`` that ``ignored`` hasn't, without regard to case, none twice.

    All three are tables with a column ``needle``; null and empty ones go. Any of them may be of any size.
    """
    plain = lambda df: df.select(prepared_needle(F.col(needle)).alias(needle)).where(F.col(needle).isNotNull())
    return plain(lexicon).union(plain(extra)).join(plain(ignored), needle, "left_anti").distinct()
