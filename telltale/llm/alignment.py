"""Alignment of two tokenizers over the same text, as relations of tokens and byte offsets.

Both tokenizers start anew at a plain space and at a line break that follow a visible character, and at punctuation that follows a letter, if
no piece of the model goes across (checked at load). So a text falls into segments whose tokens don't depend on their neighbours. Equal
segments are aligned once and weighted by how often they occur: tokens of the distinct segments become rows, windowed sums of their
lengths give the offset where each of them ends, and an equi-join on segment and end finds the cuts, where a token of both
ends. Running counts of cuts number the groups.

Every offset where a token of either side ends closes one stretch of bytes, and the tokens that cover it on both sides are a link; as
tokens are intervals, no two stretches have the same pair. So links are as many as ends, and each side's token of a link is
the next one that ends there or later: it is carried back over the group's rows, instead of joining all of a group's tokens
with each other.

Documents are read in blocks that number their own segments. A block's numbers find their segments' results by a join, and
documents are put together where both meet again.
"""

from __future__ import annotations

import re
import string
import uuid
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import _EDGE_SPACE, KEPT, byte_table, slices, tidied
from .scratch import partitions, release, settings, written

#: Bytes of text in a block, and that are split at a time.
BLOCK_BYTES, SLICE = 32_000_000, 2_000_000
#: Segments that are tokenized at a time.
AT_ONCE = 20_000
#: Segment numbers whose results are put together at a time.
CODES = 1_000_000

TOKENS = T.StructType([T.StructField(x, T.ArrayType(T.IntegerType(), False)) for x in ("a", "a_bytes", "b", "b_bytes")])
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


class Tokenizers:
    """Tokens of segments by a byte-level vocabulary (A) and a sentencepiece model (B)."""

    _by_paths: dict[tuple[str, str], "Tokenizers"] = {}

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_table())}
        self.a_bytes = {i: bytes(byte_of.get(c, 0x3F) for c in x) for x, i in self.a.get_vocab().items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = {i: self.b.id_to_piece(i) for i in range(self.b.get_piece_size())}
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in pieces.items()]
        written_out = [x for i, x in pieces.items() if not self.b.is_byte(i)]
        crossing = [x for x in written_out if re.search("[^▁]▁|\n", x)]
        if crossing:
            raise ValueError(f"pieces go across the start of a segment: {crossing[:5]}")
        joined = {b for x in written_out for a, b in zip(x, x[1:]) if a.isalpha()}
        apart = "".join(re.escape(c) for c in string.punctuation if c != "'" and c not in joined)
        self.cut = re.compile(rf"(?<=\S)(?= \S|\n)|(?<=[^\W\d_])(?=[{apart}])" if apart else r"(?<=\S)(?= \S|\n)").split
        self.space = self.b.piece_to_id("▁")

    @classmethod
    def of(cls, byte_path: str, piece_path: str) -> "Tokenizers":
        if (byte_path, piece_path) not in cls._by_paths:
            cls._by_paths[byte_path, piece_path] = cls(byte_path, piece_path)
        return cls._by_paths[byte_path, piece_path]

    def _b(self, segments: list[str]) -> list[list[int]]:
        """The model puts a space before what it gets: a segment's own one is left to it. Other segments are put behind a line break,
        which is a token of its own, and both are taken away."""
        out = self.b.encode([x[1:] if x[:1] == " " else "\n" + x for x in segments], num_threads=1)
        for i, x in enumerate(segments):
            if x[:1] != " ":
                if self.b_bytes[out[i][1]] != b"\n" or out[i][0] != self.space:
                    raise ValueError("a line break isn't a token of its own")
                out[i] = out[i][2:]
        return out

    def __call__(self, segments: list[str]) -> list[tuple[bytes, bytes, bytes, bytes] | None]:
        """Ids and lengths of both sides of each segment, as 4-byte numbers; None for one that its tokens don't give back."""
        out, of_a, of_b = [], self.a_bytes, self.b_bytes
        for lo in range(0, len(segments), AT_ONCE):
            part = segments[lo : lo + AT_ONCE]
            for x, left, right in zip(part, self.a.encode_batch_fast(part, add_special_tokens=False), self._b(part)):
                raw, a, b = x.encode(), [of_a[i] for i in left.ids], [of_b[i] for i in right]
                told = b"".join(a) == raw == b"".join(b)
                out.append(tuple(array("i", y).tobytes() for y in (left.ids, map(len, a), right, map(len, b))) if told else None)
        return out


KEPT.append(Tokenizers._by_paths)


def _int_lists(parts: list[bytes]) -> pa.Array:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def tokens_of(segment: Column, byte_path: str, piece_path: str) -> Column:
    """Both sides' ids and lengths in bytes; null for segments that the tokens don't give back."""

    @F.arrow_udf(TOKENS)
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenize = Tokenizers.of(byte_path, piece_path)
        for batch in batches:
            told = tokenize(batch.to_pylist())
            sides = [_int_lists([x[i] if x else b"" for x in told]) for i in range(4)]
            yield pa.StructArray.from_arrays(sides, TOKENS.names, mask=pa.array([x is None for x in told], pa.bool_()))

    return run(segment)


class Block:
    """Documents read so far and the segments that occur in them, numbered."""

    def __init__(self, cut: Callable[[str], list[str]]):
        self.cut, self.index, self.n_bytes = cut, {}, 0
        self.keys: list[pa.Array] = []
        self.codes: list[np.ndarray] = []

    def _numbers(self, text: str) -> list[int]:
        index = self.index
        return [index.setdefault(x, len(index)) for x in self.cut(" " + text)]

    def add(self, keys: pa.Array, texts: pa.Array) -> None:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        odd_word = pc.match_substring_regex(words, _EDGE_SPACE).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(odd_word[at], offsets[:-1])
        plain = ~np.repeat(odd, np.diff(offsets))  # odd texts are split one by one below
        used = np.bincount(at[plain], minlength=len(words)) > 0
        numbers = [self._numbers(x) if use else [] for x, use in zip(words.to_pylist(), used.tolist())]
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        table, starts = np.fromiter((n for x in numbers for n in x), np.int32), np.cumsum(sizes) - sizes
        each = sizes[at] * plain
        ends = np.cumsum(each)
        flat = table[np.repeat(starts[at] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[offsets]
        parts = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(odd).tolist():
            text = texts[i].as_py()
            parts[i] = np.array(self._numbers(text) if text else [], np.int32)
        self.keys.append(keys)
        self.codes.extend(parts)
        self.n_bytes += int(pc.sum(pc.binary_length(texts)).as_py() or 0)

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The block's documents with their segments' numbers, and its segments."""
        segments, n = list(self.index), len(self.codes)
        codes = np.concatenate(self.codes)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in self.codes])))
        counts = np.bincount(codes, minlength=len(segments))
        keys = pa.concat_arrays(self.keys)
        none = lambda kind, rows: pa.nulls(rows, kind)
        names, ints = ["block", "kind", "key", "codes", "code", "segment", "n"], pa.list_(pa.int32())
        for lo in range(0, n, 10_000):
            own = range(lo, min(lo + 10_000, n))
            lists = pa.ListArray.from_arrays(pa.array(ends[lo : own.stop + 1] - ends[lo], pa.int32()), pa.array(codes[ends[lo] : ends[own.stop]], pa.int32()))
            m = len(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.array(np.ones(m, np.int32)), keys.slice(lo, m), lists, none(pa.int32(), m), none(pa.string(), m), none(pa.int64(), m)], names)
        for lo in range(0, len(segments), 10_000):
            part = segments[lo : lo + 10_000]
            m = len(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, number)), pa.array(np.zeros(m, np.int32)), none(keys.type, m), none(ints, m), pa.array(np.arange(lo, lo + m), pa.int32()), pa.array(part, pa.string()), pa.array(counts[lo : lo + m], pa.int64())], names)


def blocks(df: DataFrame, byte_path: str, piece_path: str, key: str, text: str) -> DataFrame:
    """Rows of two kinds: 1 a document with its segments' numbers in its block, 0 a block's segment and how often it occurs there."""
    slim = df.select(F.struct(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).alias("_row")).select("_row.*")
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("key", slim.schema["key"].dataType), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("code", T.IntegerType()), T.StructField("segment", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, number = Tokenizers.of(byte_path, piece_path).cut, TaskContext.get().partitionId() << 32
        block = Block(cut)
        for batch in batches:
            lo = 0
            for part in slices(batch.column(1), SLICE):
                block.add(batch.column(0).slice(lo, len(part)), part)
                lo += len(part)
                if block.n_bytes >= BLOCK_BYTES:
                    yield from block.rows(number)
                    number, block = number + 1, Block(cut)
        if block.keys:
            yield from block.rows(number)

    return slim.mapInArrow(tidied(run), schema)


@dataclass
class Segments:
    """What ``segmented`` finds: documents (``block, kind, key, codes``), their blocks' segments (``block, kind, code, segment``), and the
    distinct ones (``seg, segment, n`` and tokens)."""

    documents: DataFrame
    dictionary: DataFrame
    distinct: DataFrame


def segmented(df: DataFrame, byte_path: str, piece_path: str, key: str, text: str, tag: str) -> Segments:
    """Written tables of the segments of all texts.

    Documents with a segment that its tokens don't give back, if there are any, lose all their segments.
    """
    table = written(blocks(df, byte_path, piece_path, key, text), "blocks", tag)
    documents, own = table.where("kind = 1").select("block", "kind", "key", "codes"), table.where("kind = 0").select("block", "kind", "code", "segment", "n")
    counts = own.groupBy("segment").agg(F.sum("n").alias("n"))
    told = counts.select("segment", "n", tokens_of(F.col("segment"), byte_path, piece_path).alias("_t"))
    distinct = written(told.select(F.monotonically_increasing_id().alias("seg"), "segment", "n", "_t.*"), "segments", tag)
    bad = distinct.where("a IS NULL").select("segment")
    if not bad.isEmpty():
        of_block = own.join(bad, "segment").groupBy("block").agg(F.collect_list("code").alias("_bad"))
        whole = F.coalesce(~F.arrays_overlap("codes", "_bad"), F.lit(True))
        marked = written(documents.join(of_block, "block", "left").select("block", "kind", "key", F.when(whole, F.col("codes")).alias("codes"), F.when(~whole, F.col("codes")).alias("_lost")), "documents", tag)
        documents = marked.drop("_lost")
        lost = marked.select("block", F.explode("_lost").alias("code")).groupBy("block", "code").agg(F.count(F.lit(1)).alias("_m"))
        less = lost.join(own, ["block", "code"]).groupBy("segment").agg(F.sum("_m").alias("_m"))
        distinct = distinct.join(less, "segment", "left").withColumn("n", F.col("n") - F.coalesce("_m", F.lit(0))).drop("_m").where("n > 0")
        distinct = written(distinct, "segments", tag)
    return Segments(documents, own.drop("n"), distinct)


def ends(segments: DataFrame, side: str) -> DataFrame:
    """``seg, end`` and the id (named ``side``) of each of a side's tokens."""
    tokens = segments.select("seg", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_bytes").alias("size"))).alias("at", "_t"))
    so_far = F.sum("_t.size").over(Window.partitionBy("seg").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return tokens.select("seg", so_far.cast("int").alias("end"), F.col("_t.id").alias(side))


def links(segments: DataFrame) -> DataFrame:
    """A row for each stretch of bytes that a pair of tokens shares: ``seg, end``, ``a`` and ``b`` (the ids of tokens that end
    there, else null), ``back`` (the group's number, counted from the segment's end) and the pair ``link_a, link_b``."""
    placed = segments.select("seg", *TOKENS.names).repartition(partitions(segments.sparkSession), "seg")
    met = ends(placed, "a").join(ends(placed, "b"), ["seg", "end"], "full_outer")
    later = Window.partitionBy("seg").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    return met.withColumns({"back": F.sum(cut).over(later), "link_a": F.last("a", True).over(later), "link_b": F.last("b", True).over(later)})


def aligned(linked: DataFrame) -> DataFrame:
    """For each ``seg`` its ``n_a, n_b, n_groups, n_links``, its ``groups`` as text and its ``links``, ``a, b, m`` times.

    Groups are built from their rows and then put in order; both follow the partitioning that links have, by segment.
    """
    listed = F.array_sort(F.collect_list(F.struct("end", F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))))
    pairs = F.collect_list(F.struct(F.col("link_a").alias("a"), F.col("link_b").alias("b")))
    by_group = linked.groupBy("seg", "back").agg(listed.alias("_ids"), pairs.alias("_links"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count(F.lit(1)).alias("n_links"))
    side = lambda x: F.array_join(F.col(f"_ids.{x}"), ",")  # noqa: E731, nulls are left out
    named = by_group.withColumn("_text", F.concat(side("a"), F.lit("|"), side("b")))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("back"), "_text")))
    own = named.groupBy("seg").agg(ordered.alias("_groups"), F.flatten(F.collect_list("_links")).alias("links"), F.count(F.lit(1)).alias("n_groups"), *[F.sum(x).alias(x) for x in ("n_a", "n_b", "n_links")])
    return own.select("seg", "n_a", "n_b", "n_groups", "n_links", F.array_join("_groups._text", ";").alias("groups"), "links")


def counted(table: DataFrame) -> DataFrame:
    """``link_a, link_b``, the pair's ``count`` over the corpus and ``best``, whether no pair of that ``link_b`` has more, from segments'
    ``n`` and ``links``.

    Both vocabularies bound the rows; counts are summed before they are shuffled.
    """
    rows = table.select("n", F.explode("links").alias("_l"))
    pairs = rows.groupBy(F.col("_l.a").alias("link_a"), F.col("_l.b").alias("link_b")).agg(F.sum("n").alias("count"))
    return pairs.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("link_b"))).cast("int"))


def measured(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """``segment``, its ``COUNTS`` and ``groups``; sums over a segment's links are partial before they are shuffled."""
    rows = table.select("seg", F.explode("links").alias("_l")).select("seg", F.col("_l.a").alias("link_a"), F.col("_l.b").alias("link_b"))
    sums = rows.join(pairs, ["link_a", "link_b"]).groupBy("seg").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    return table.drop("links", "n").join(sums, "seg").select("segment", *COUNTS, "groups")


def assembled(found: Segments, results: DataFrame, key: str) -> DataFrame:
    """Each document's sums and groups, from its block's segments, which come first in the block."""
    kind = found.documents.schema["key"].dataType
    rows = found.dictionary.join(results, "segment").drop("segment").unionByName(found.documents, allowMissingColumns=True)
    names = ["block", "kind", "code", "key", "codes", *COUNTS, "groups"]
    rows = rows.select(*names).repartition(partitions(results.sparkSession), "block").sortWithinPartitions("block", "kind", "code")
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(x, T.LongType(), False) for x in COUNTS], T.StructField("groups", T.StringType(), False)])

    def put(documents: pa.RecordBatch, codes_of: np.ndarray, table: np.ndarray, groups: pa.Array) -> Iterator[pa.RecordBatch]:
        lists = documents.column(4)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CODES, "right")))
            codes = lists.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False)
            at = np.searchsorted(codes_of, codes)
            bounds = np.concatenate(([0], np.cumsum(sizes[lo:hi])))
            sums = np.concatenate((np.zeros((1, len(COUNTS)), np.int64), np.cumsum(table[at], axis=0)))
            own = sums[bounds[1:]] - sums[bounds[:-1]]
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), groups.take(pa.array(at))), ";")
            yield pa.RecordBatch.from_arrays([documents.column(3).slice(lo, hi - lo), *[pa.array(c, pa.int64()) for c in own.T], texts], schema.names)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, ready = None, [], None
        for batch in batches:
            which = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if part.column(0)[0].as_py() != block:
                    block, held, ready = part.column(0)[0].as_py(), [], None
                if part.column(1)[0].as_py() == 0:
                    held.append([part.column(i) for i in (2, *range(5, 12))])
                    continue
                if ready is None:
                    columns = [pa.concat_arrays(x) for x in zip(*held)] or [pa.array([], pa.int64())] * 7 + [pa.array([], pa.string())]
                    ready = columns[0].to_numpy(zero_copy_only=False), np.stack([c.to_numpy(zero_copy_only=False) for c in columns[1:7]], axis=1).astype(np.int64), columns[7]
                    held = []
                yield from put(part, *ready)

    return rows.mapInArrow(tidied(run), schema)


def _aligned(found: Segments, tag: str) -> DataFrame:
    """A written table of the distinct segments, ``segment, n`` and what ``aligned`` finds. Both sides of its join are in place by
    segment already, so they are joined there: no setting but that for this one write allows it."""
    with settings(found.distinct.sparkSession, spark__sql__requireAllClusterKeysForCoPartition="false"):
        return written(aligned(links(found.distinct)).join(found.distinct.select("seg", "segment", "n"), "seg"), "aligned", tag)


def pair_counts(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", tag: str = "query") -> DataFrame:
    """``link_a, link_b, count, best`` of all id pairs that are linked in ``df``: a table from one vocabulary to the other.

    Texts as in ``align``; an empty table gives no rows.
    """
    return counted(_aligned(segmented(df, byte_path, piece_path, key, text, tag), tag))


def align(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", tag: str = "query") -> DataFrame:
    """The alignment of each text of ``df``: ``key``, ``n_a, n_b, n_groups, n_links, n_best, count_sum`` and ``groups``.

    A is the byte-level vocabulary on a space and the text, B the sentencepiece model, which puts that space itself; special
    tokens' strings are plain text. ``groups`` lists the ids between cuts, ``a1,a2|b1;a3|b2``. ``n_best`` counts links whose pair is
    the most frequent of its B id in all of ``df``, ``count_sum`` adds the pairs' counts up. Null and empty texts, and those that
    their tokens don't give back byte by byte, have no tokens: zeros and an empty string, and they don't count in the corpus.
    Texts of any length are taken whole. Null and repeated keys and repeated rows are each a row of their own, and ties are all best.
    Other columns of any name are ignored. An empty table gives no rows.
    """
    found = segmented(df, byte_path, piece_path, key, text, tag)
    own = f"{tag}-{uuid.uuid4().hex}"
    table = _aligned(found, own)
    pairs = written(counted(table), "pairs", own)
    results = written(measured(table, pairs), "results", tag)
    release(df.sparkSession, own)
    return assembled(found, results, key)
