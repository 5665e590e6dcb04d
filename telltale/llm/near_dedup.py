"""Near-duplicates by order MinHash, verified by banded alignment.

A text's k-mers of five words are labelled with their occurrence. Each sketch takes the few labelled k-mers that are smallest
under its own hash and keeps them in text order, so it feels moved text as well as changed text. Texts too short for that
also draw sketches of two-word k-mers. A pair is a link if the edit distance of its words, found within a band, leaves a
similarity of 0.85. Two texts that differ in 15 % of their words, spread evenly, still share some 29 % of their k-mers, and so
agree in a sketch with a probability of 0.08; those that agree in two of 56 or more are candidates.

Exact copies are one representative first. Texts that share a sketch are a bucket. Each member is compared with its bucket's
leader, by a join, whatever the bucket's size, and classes are the components of the links. Of a text's leaders one comes first, as those of
a large group of copies, one for each sketch, would mostly say the same again; with the others it is compared where its class is
still another one. Candidates still in different classes are then compared within their buckets. Members of large buckets, which often have no more than a passage in common, meet only if
they share one of their rarest words, as all similar texts do (``rare_words``), so the work grows with the rare words of these texts and not
with the square of the bucket. Of each text the words are counted by 1,024 numbers; two texts whose counts are too far apart can't
be similar and are told apart without their words. What is left is aligned in tiles, so that a text moves once for many pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import slices, tidied
from .passages import SLICE, asked, digest, texts_of
from .scratch import partitions, written
from .windows import BASE, between, flat, joined, lowered, mix, prefix, words

SHINGLE, TAKEN, SKETCHES, SIMILARITY = 5, 2, 56, 0.85
#: Texts of fewer words than this have further sketches, so many, of k-mers of so many words.
SHORT, SHORT_SKETCHES, SHORT_SHINGLE = 50, 16, 2
#: Sketches in which candidates agree.
LEAST_AGREED = 2
#: Texts of a block, and their bytes; pairs are aligned in tiles of two blocks.
TILE, TILE_BYTES = 500, 2_000_000
#: Members of a bucket that are compared in one task; those of larger buckets meet by their rare words instead, and in tiles where
#: even a rare word has more.
BUCKET = 1000
#: Counters of texts by the hash of a word, which say which of a text's words are rare.
COUNTERS = 1 << 21
#: Ranks of k-mers that are held at a time.
RANKS = 1 << 18
#: Numbers that a text's words are counted by.
BAG = 1024

_ALL = SKETCHES + SHORT_SKETCHES
_MULTIPLIERS = mix(np.arange(1, _ALL + 1, dtype=np.uint64), 0xA5A5) | np.uint64(1)
_SEEDS = mix(np.arange(1, _ALL + 1, dtype=np.uint64), 0x5A5A)


def with_occurrence(hashes: np.ndarray) -> np.ndarray:
    """Hashes of each one and how often it has come before; those that come first stay as they are."""
    _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    if len(counts) == len(hashes):
        return hashes
    order = np.argsort(inverse, kind="stable")
    nth = np.empty(len(hashes), np.uint64)
    nth[order] = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.where(nth > 0, mix(hashes + nth * np.uint64(BASE)), hashes)


def _drawn(hashes: np.ndarray, size: int, which: slice) -> np.ndarray:
    """The sketches ``which`` of a text's k-mers of ``size`` words; texts of fewer words are one k-mer."""
    n = max(1, len(hashes) - size + 1)
    at = np.arange(n)
    grams = between(prefix(hashes), at, np.minimum(at + size, len(hashes)))
    grams = with_occurrence(grams)
    return np.concatenate([_least(grams, _SEEDS[lo:hi], _MULTIPLIERS[lo:hi]) for lo, hi in _blocks(which, n)])


def _blocks(which: slice, n: int) -> Iterator[tuple[int, int]]:
    """Parts of the sketches ``which``, so small that the ranks of ``n`` k-mers in all of them are few."""
    step = max(1, RANKS // n)
    for lo in range(which.start, which.stop, step):
        yield lo, min(lo + step, which.stop)


def _least(grams: np.ndarray, seeds: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    ranks = (grams[None, :] ^ seeds[:, None]) * multipliers[:, None]
    ranks ^= ranks >> np.uint64(32)
    rows, places = np.arange(len(seeds)), []
    for _ in range(min(TAKEN, len(grams))):
        best = ranks.argmin(axis=1)
        places.append(best)
        ranks[rows, best] = np.uint64(0xFFFFFFFFFFFFFFFF)
    chosen = grams[np.sort(np.array(places), axis=0)]
    out = seeds.copy()
    for part in chosen:
        out = mix(out * np.uint64(BASE) + part)
    return out


def sketches(hashes: np.ndarray) -> np.ndarray:
    """Order MinHash sketches of a text's word hashes."""
    out = _drawn(hashes, SHINGLE, slice(0, SKETCHES))
    return np.concatenate((out, _drawn(hashes, SHORT_SHINGLE, slice(SKETCHES, _ALL)))) if len(hashes) < SHORT else out


SIGNATURE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("content", T.BinaryType()), T.StructField("bag", T.BinaryType()), T.StructField("sketches", T.ArrayType(T.LongType()))])


def bag_of(hashes: np.ndarray) -> bytes:
    """Counts of a text's words by hash; all at their greatest, which matches anything, where one could overflow."""
    counts = np.bincount((hashes % np.uint64(BAG)).astype(np.int64), minlength=BAG)
    return (counts if counts.max() < 0xFFFF else np.full(BAG, 0xFFFF)).astype("<u2").tobytes()


def may_be_similar(bag: np.ndarray, others: np.ndarray, longer: np.ndarray, similarity: float) -> np.ndarray:
    """Whether texts can be similar by their bags: an edit takes away one word at most."""
    common = np.minimum(others, bag).sum(axis=1, dtype=np.int64)
    return longer - common <= np.floor((1 - similarity) * longer + 1e-9)


def signature(text: Column | str) -> Column:
    """Number of words, a 128-bit digest of all words, their counts and the sketches; null for texts without words."""

    @F.arrow_udf(SIGNATURE)
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, contents, bags, drawn = [], [], [], []
            for part in slices(batch, SLICE):
                texts = lowered(flat(part))
                found = words(texts)
                data, begins, ends = joined(texts, found)
                raw = memoryview(data.tobytes())
                for lo, hi in zip(found.firsts[:-1].tolist(), found.firsts[1:].tolist()):
                    counts.append(hi - lo)
                    contents.append(digest(raw[begins[lo] : ends[hi - 1]]) if hi > lo else None)
                    bags.append(bag_of(found.hashes[lo:hi]) if hi > lo else None)
                    drawn.append(sketches(found.hashes[lo:hi]).view(np.int64) if hi > lo else None)
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(contents, pa.binary()), pa.array(bags, pa.binary()), pa.array(drawn, pa.list_(pa.int64()))], ["n_words", "content", "bag", "sketches"])

    return run(F.col(text) if isinstance(text, str) else text)


def numbered(texts: pa.Array) -> list[np.ndarray]:
    """Each text's words as numbers, alike for like words of all the texts: the words themselves are numbered, not their hashes."""
    low = lowered(flat(texts))
    found = words(low)
    data, begins, _ = joined(low, found)
    offsets = np.append(begins, len(data)).astype(np.int32)
    each = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
    ids = each.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return [ids[a:b] for a, b in zip(found.firsts[:-1], found.firsts[1:])]


def distance(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two sequences of numbers if it is at most ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return None
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        d = max(len(a), len(b))
        return d if d <= limit else None
    values, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    in_a, in_b = np.bincount(inverse[: len(a)], minlength=len(values)), np.bincount(inverse[len(a) :], minlength=len(values))
    if max(len(a), len(b)) - int(np.minimum(in_a, in_b).sum()) > limit:
        return None
    a, b = inverse[: len(a)].tolist(), inverse[len(a) :].tolist()
    return _in_band(a, b, limit) if len(a) >= len(b) else _in_band(b, a, limit)


def _in_band(a: list[int], b: list[int], limit: int) -> int | None:
    """Edit distance within ``limit`` diagonals of the main one, a column of the band at a time.

    A column's vertical steps up and down are bits of two integers that slide along with the band; cells outside it count
    as larger, which no path of at most ``limit`` edits notices. ``a`` isn't shorter than ``b``; the distance is followed on
    the diagonal that ends in the last cell.
    """
    mask, wide = (1 << (2 * limit + 1)) - 1, len(a) - len(b)
    found: dict[int, int] = {}
    for i, x in enumerate(a):
        found[x] = found.get(x, 0) | 1 << i
    up, down, d, last = mask & ~((1 << limit) - 1), 0, wide, 1 << (limit + wide)
    for shift, x in enumerate(b, -limit):
        equal = found.get(x, 0)
        equal = (equal >> shift if shift >= 0 else equal << -shift) & mask
        level = ((((equal & up) + up) ^ up) | equal | down) & mask
        right = down | (mask & ~(level | up))
        left = level & up
        if not level & last:
            d += 1
            if d > limit:
                return None
        level >>= 1
        up = left | (mask & ~(level | right))
        down = right & level
    return d


def allowed(n: int, m: int, similarity: float) -> int:
    return int((1 - similarity) * max(n, m) + 1e-9)


def similar_enough(n: Column, m: Column, similarity: float) -> Column:
    """Whether texts of ``n`` and ``m`` words can be similar by their lengths alone."""
    return F.abs(n - m) <= F.floor((1 - similarity) * F.greatest(n, m) + 1e-9)


def with_leaders(members: DataFrame, tag: str) -> DataFrame:
    """A written table of those ``members`` (``_bucket, _rep, _order, _bits, n_words`` and others) that share their bucket, with
    its size ``_n`` and the order of its first member, ``_lead``.

    Buckets are counted in partial aggregates, most members that are alone go by a filter of fixed size, and Spark can
    split a large bucket in the join.
    """
    buckets = members.groupBy("_bucket").agg(F.min("_order").alias("_lead"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    buckets = written(buckets, "buckets", tag)
    shared = asked(members.withColumn("_key", F.col("_bucket")), buckets.select(F.col("_bucket").alias("_key"))).where("_maybe").drop("_key", "_maybe")
    return written(shared.join(buckets, "_bucket"), "members", tag)


def agreed(bits: Column, other: Column) -> Column:
    return F.aggregate(F.zip_with(bits, other, lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)


def leader_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """``_leader, _member`` of candidates among the rows of ``with_leaders``; as many as rows at most."""
    leaders = members.where("_order = _lead").select("_lead", F.col("_rep").alias("_leader"), F.col("_bits").alias("_lead_bits"), F.col("n_words").alias("_lead_words")).dropDuplicates(["_lead", "_leader"])
    close = similar_enough(F.col("n_words"), F.col("_lead_words"), similarity)
    pairs = members.where("_order <> _lead").select("_lead", "_rep", "_bits", "n_words").dropDuplicates(["_lead", "_rep"]).join(leaders, "_lead")
    return pairs.where(close & (agreed(F.col("_bits"), F.col("_lead_bits")) >= LEAST_AGREED)).select("_leader", F.col("_rep").alias("_member"))


def foremost(pairs: DataFrame) -> DataFrame:
    """Of the ``pairs`` (``_leader, _member``) of each member the one whose leader comes first in the order of ``_order``, which a large group has in common."""
    return pairs.groupBy("_member").agg(F.min_by("_leader", F.xxhash64("_leader")).alias("_leader")).select("_leader", "_member")


def pairs_across(members: DataFrame, similarity: float) -> DataFrame:
    """``_leader, _member`` of all candidates of different classes in a bucket, from rows ``_bucket, _rep, _bits, n_words,
    _class, bag``; a task holds a bucket, so pass small ones. Only pairs whose words may be similar come out.

    With ``sketches`` (buckets are theirs then) a pair comes out of the bucket of the first one that both have, and of no other."""
    kind, once = members.schema["_rep"].dataType, "sketches" in members.columns

    def each(column: pa.Array) -> list[np.ndarray]:
        ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        return np.split(column.flatten().to_numpy(zero_copy_only=False), ends[:-1])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def found() -> pa.RecordBatch:
            number: dict = {}
            classes = np.array([number.setdefault(x[3], len(number)) for x in held])
            lengths = np.array([x[2] for x in held])
            bits = np.array([x[1] for x in held], np.int8)
            bags = np.frombuffer(b"".join(x[4] for x in held), "<u2").reshape(len(held), BAG)
            if once:  # a sketch that a text doesn't have differs from any other's
                drawn = np.repeat(np.arange(len(held))[:, None], _ALL, axis=1)
                for row, x in zip(drawn, held):
                    row[: len(x[5])] = x[5]
            left, right = [], []
            for i in range(len(held) - 1):
                at = np.flatnonzero(classes[i + 1 :] != classes[i]) + i + 1
                most = np.floor((1 - similarity) * np.maximum(lengths[at], lengths[i]) + 1e-9)
                at = at[np.abs(lengths[at] - lengths[i]) <= most]
                at = at[(bits[at] == bits[i]).sum(axis=1) >= LEAST_AGREED]
                if once:
                    at = at[drawn[i][(drawn[at] == drawn[i]).argmax(axis=1)] == bucket]
                at = at[may_be_similar(bags[i], bags[at], np.maximum(lengths[at], lengths[i]), similarity)]
                left.extend([held[i][0]] * len(at))
                right.extend(held[j][0] for j in at.tolist())
            return pa.RecordBatch.from_arrays([pa.array(left, arrow), pa.array(right, arrow)], ["_leader", "_member"])

        for batch in batches:
            arrow = batch.schema.field(1).type
            for start in range(0, batch.num_rows, 1000):
                columns = batch.slice(start, 1000).columns
                for b, *row in zip(*(c.to_pylist() for c in columns[:6]), *map(each, columns[6:])):
                    if b != bucket:
                        if len(held) > 1:
                            yield found()
                        bucket, held = b, []
                    held.append(row)
        if len(held) > 1:
            yield found()

    spread = members.repartition(partitions(members.sparkSession), "_bucket").sortWithinPartitions("_bucket", "_rep")
    schema = T.StructType([T.StructField("_leader", kind), T.StructField("_member", kind)])
    told = spread.select("_bucket", "_rep", "_bits", "n_words", "_class", "bag", *(["sketches"] if once else [])).mapInArrow(tidied(pair), schema)
    return told.select(F.least("_leader", "_member").alias("_leader"), F.greatest("_leader", "_member").alias("_member")).distinct()


def word_ranks(texts: Column, df: DataFrame) -> np.ndarray:
    """How many texts of ``df`` have a word, with its occurrence and by hash, in ``COUNTERS`` counters that are summed in the cluster."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for part in slices(batch.column(0), SLICE):
                found = words(lowered(flat(part)))
                for lo, hi in zip(found.firsts[:-1].tolist(), found.firsts[1:].tolist()):
                    np.add.at(total, counters_of(with_occurrence(found.hashes[lo:hi]), COUNTERS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    summed = df.select(texts).mapInArrow(tidied(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    return np.minimum(out, 0xFFFFFFFF).astype(np.uint32)


def counters_of(hashes: np.ndarray, counters: int) -> np.ndarray:
    return (hashes % np.uint64(counters)).astype(np.int64)


def first_words(hashes: np.ndarray, ranks: np.ndarray, similarity: float) -> np.ndarray:
    """The words of one text, each with its occurrence, that come first by rank and hash."""
    labelled = with_occurrence(hashes)
    order = np.lexsort((labelled, ranks[counters_of(labelled, len(ranks))]))
    return labelled[order[: allowed(len(hashes), len(hashes), similarity) + 1]]


def rare_words(text: Column, ranks: np.ndarray, similarity: float) -> Column:
    """Hashes of each text's rarest words, each with its occurrence, so many that two similar texts have one in common.

    Texts at most ``d`` edits apart share all but ``d`` words of the longer one. Whatever the order that all words are put in, the first
    ``d + 1`` words of both then have one in common; rare ones first makes them few. Those that one text alone has by their
    counter can't be it.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, ends = [np.zeros(0, np.int64)], [0]
            for part in slices(batch, SLICE):
                found = words(lowered(flat(part)))
                for lo, hi in zip(found.firsts[:-1].tolist(), found.firsts[1:].tolist()):
                    own = first_words(found.hashes[lo:hi], ranks, similarity)
                    own = own[ranks[counters_of(own, len(ranks))] > 1]
                    out.append(own.view(np.int64))
                    ends.append(ends[-1] + len(own))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out)))

    return run(text)


def tiles(members: DataFrame) -> DataFrame:
    """Members of buckets once for each pair of tiles they are in, so that every two members meet in a bucket of two tiles."""
    count = F.ceil(F.col("_n") / (BUCKET / 2)).cast("int")
    own = members.withColumn("_tiles", count).withColumn("_tile", F.pmod(F.col("_order"), F.col("_tiles")).cast("int"))
    met = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    return met.withColumn("_bucket", F.xxhash64("_bucket", F.least("_tile", "_with"), F.greatest("_tile", "_with")))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts are similar enough. ``texts``, a written table, has ``_rep, _text`` of all that occur in ``pairs``.

    Texts are dealt out in blocks by hash, and pairs in tiles of two blocks. A text moves once to each tile that it has a pair in, however
    many pairs that are; a task holds a tile's texts as numbers, and a tile has ``TILE`` squared pairs at most.
    """
    kind = texts.schema["_rep"].dataType
    n, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    blocks = F.lit(max(1, -(-n // TILE), -(-size // TILE_BYTES)))
    tiled = pairs.select("_leader", "_member", F.pmod(F.xxhash64("_leader"), blocks).alias("_a"), F.pmod(F.xxhash64("_member"), blocks).alias("_b"))
    wanted = tiled.select("_a", "_b", F.col("_leader").alias("_rep")).union(tiled.select("_a", "_b", "_member")).distinct()
    held = wanted.join(texts, "_rep").select("_a", "_b", F.lit(0).alias("_role"), F.col("_rep").alias("_leader"), F.lit(None).cast(kind).alias("_member"), "_text")
    asked = tiled.select("_a", "_b", F.lit(1).alias("_role"), "_leader", "_member", F.lit(None).cast("string").alias("_text"))
    rows = held.unionByName(asked).repartition(partitions(pairs.sparkSession), "_a", "_b").sortWithinPartitions("_a", "_b", "_role")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, at, held, found = None, {}, [], None
        for batch in batches:
            left, right = [], []
            roles, texts = batch.column(2).to_pylist(), batch.column(5)
            for i, (a, b, role, leader, member) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), roles, batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if (a, b) != tile:
                    tile, at, held, found = (a, b), {}, [], None
                if role == 0:
                    at[leader] = len(held)
                    held.append(texts[i].as_py() or "")
                    continue
                if found is None:
                    found, held = numbered(pa.array(held, pa.string())), []
                x, y = found[at[leader]], found[at[member]]
                if distance(x, y, allowed(len(x), len(y), similarity)) is not None:
                    left.append(leader)
                    right.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(left, batch.schema.field(3).type), pa.array(right, batch.schema.field(3).type)], ["_leader", "_member"])

    schema = T.StructType([T.StructField("_leader", kind), T.StructField("_member", kind)])
    return rows.select("_a", "_b", "_role", "_leader", "_member", "_text").mapInArrow(tidied(align), schema)


def components(links: DataFrame, tag: str = "query") -> DataFrame:
    """``_node, _class`` (the smallest node it is connected with) of all nodes in ``_leader, _member`` pairs.

    Alternates large-star and small-star steps until all edges are stars; each round is written, and only the number of nodes that
    aren't the end or the middle of a star reaches the driver.
    """
    edges = links.select(F.greatest("_leader", "_member").alias("u"), F.least("_leader", "_member").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges", tag)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges", tag)
        ends = edges.select(F.col("u").alias("_node"), F.lit(1).alias("_up"), F.lit(0).alias("_down")).union(edges.select("v", F.lit(0), F.lit(1)))
        told = ends.groupBy("_node").agg(F.sum("_up").alias("_up"), F.max("_down").alias("_down"))
        if told.where("_up + _down > 1").isEmpty():
            break
    stars = edges.select(F.col("u").alias("_node"), F.col("v").alias("_class"))
    return stars.union(edges.select("v", "v").distinct()).toDF("_node", "_class")


def with_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``_leader, _member`` and the classes ``_a, _b`` of both; a text without any is its own."""
    left, right = classes.toDF("_leader", "_a"), classes.toDF("_member", "_b")
    named = pairs.join(left, "_leader", "left").join(right, "_member", "left")
    return named.select("_leader", "_member", F.coalesce("_a", "_leader").alias("_a"), F.coalesce("_b", "_member").alias("_b"))


def united(classes: DataFrame, links: DataFrame, tag: str = "query") -> DataFrame:
    """A written table of the ``classes`` (``_node, _class``) that further ``links`` leave.

    Only the classes that are linked are traversed, not their members.
    """
    named = written(with_classes(links, classes), "named", tag)
    nodes = classes.union(named.select("_leader", "_a")).union(named.select("_member", "_b")).distinct()
    joined = components(named.select(F.col("_a").alias("_leader"), F.col("_b").alias("_member")), tag).toDF("_class", "_joined")
    return written(nodes.join(joined, "_class", "left").select("_node", F.coalesce("_joined", "_class").alias("_class")), "classes", tag)


def _links(df: DataFrame, pairs: DataFrame, key: str, text: str, similarity: float, tag: str) -> DataFrame:
    """A written table of those of ``pairs`` whose texts in ``df`` are similar enough."""
    ids = pairs.select(F.col("_leader").alias("_rep")).union(pairs.select("_member")).distinct()
    texts = written(texts_of(df, ids.withColumnRenamed("_rep", "_key"), key, text).withColumnRenamed("_key", "_rep").dropDuplicates(["_rep"]), "texts", tag)
    return written(verified(pairs, texts, similarity), "links", tag)


def pairs_in(members: DataFrame, similarity: float) -> DataFrame:
    """``pairs_across`` of buckets of any size."""
    small = members.where(F.col("_n") <= BUCKET)
    return pairs_across(small.unionByName(tiles(members.where(F.col("_n") > BUCKET)).select(*small.columns)), similarity)


def by_rare_words(held: DataFrame, texts: DataFrame, similarity: float, tag: str) -> DataFrame:
    """A written table of ``held`` (``_rep, _class`` and others) in buckets of texts that have a rare word in common, of those
    buckets that several classes are in.

    Words that one class alone has go with their counts, before any pair is looked at.
    """
    ranks = word_ranks(F.col("_text"), texts)
    own = written(texts.join(held, "_rep").withColumn("_bucket", F.explode(rare_words(F.col("_text"), ranks, similarity))).drop("_text"), "words", tag)
    several = own.groupBy("_bucket").agg(F.min("_class").alias("_a"), F.max("_class").alias("_b"), F.count(F.lit(1)).alias("_n")).where("_a <> _b").select("_bucket", "_n")
    return written(own.join(several, "_bucket"), "members", tag)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, tag: str = "query") -> DataFrame:
    """The class of each row of ``df``: ``key``, ``class_id`` (the smallest key of the class) and ``n_words``.

    Words are split at ASCII white space and compared without regard to the case of ASCII letters. Texts with the same
    words are one class, and so are texts linked by a chain of similar ones; texts of up to six words are only like equal ones. Null, empty and blank texts are classes of
    their own; a row with a null key has the class of its copies, null without any. Repeated rows share their class. Texts of
    any length are taken whole. ``key`` should identify a text: of rows that share a key and have different texts, any one is
    compared. Other columns are ignored. An empty table gives no rows.
    """
    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    told = slim.withColumn("_s", signature("_text")).select("_key", "_s.n_words", "_s.content", "_s.bag", "_s.sketches")
    rows = written(told, "signatures", tag)
    alike = rows.where("content IS NOT NULL AND _key IS NOT NULL").groupBy("content").agg(F.min("_key").alias("_rep"), F.first("sketches").alias("sketches"), F.first("n_words").alias("n_words"), F.first("bag").alias("bag"))
    reps = written(alike, "representatives", tag)
    # a byte of each sketch; where a text has no sketch, one of no meaning, which agrees with another's once in 256 times
    byte = lambda x: (F.pmod(x, F.lit(256)) - 128).cast("tinyint")
    bits = F.transform(F.sequence(F.lit(0), F.lit(_ALL - 1)), lambda i: byte(F.coalesce(F.get("sketches", i), F.xxhash64("_rep", i))))
    least = int(1 / (1 - similarity) + 1e-9) if similarity < 1 else 1 << 30  # words from which on a pair can differ
    full = reps.where(F.col("n_words") >= least).select("_rep", F.xxhash64("_rep").alias("_order"), bits.alias("_bits"), "n_words", F.explode("sketches").alias("_bucket"))
    members = with_leaders(full, tag)
    pairs = written(leader_pairs(members, similarity), "pairs", tag)
    tested = written(foremost(pairs), "foremost", tag)
    classes = written(components(_links(df, tested, key, text, similarity, tag), tag), "classes", tag)

    def compared(pairs: DataFrame) -> None:
        """Links that are found among ``pairs`` join their classes."""
        nonlocal tested, classes
        pairs = written(pairs.join(tested, ["_leader", "_member"], "left_anti").join(tested.toDF("_member", "_leader"), ["_leader", "_member"], "left_anti"), "pairs", tag)
        if pairs.isEmpty():
            return
        tested = tested.union(pairs)
        links = _links(df, pairs, key, text, similarity, tag)
        if not links.isEmpty():
            classes = united(classes, links, tag)

    def mixed(members: DataFrame) -> DataFrame:
        """Members of buckets with several classes, with ``_class``."""
        named = members.join(classes.withColumnRenamed("_node", "_rep"), "_rep", "left").withColumn("_class", F.coalesce("_class", "_rep"))
        several = named.groupBy("_bucket").agg(F.min("_class").alias("_a"), F.max("_class").alias("_b")).where("_a <> _b").select("_bucket")
        return written(named.join(several, "_bucket", "left_semi"), "mixed", tag)

    compared(with_classes(pairs, classes).where("_a <> _b").select("_leader", "_member"))
    bags = reps.select("_rep", "bag")
    left = mixed(members)
    # a pair whose first common sketch is that of a large bucket meets there, by its rare words
    compared(pairs_across(left.where(F.col("_n") <= BUCKET).join(reps.select("_rep", "bag", "sketches"), "_rep"), similarity))
    large = left.where(F.col("_n") > BUCKET).drop("_class")
    if not large.isEmpty():
        held = mixed(large).select("_rep", "_order", "_bits", "n_words", "_class").dropDuplicates(["_rep"])
        held = written(held.join(bags, "_rep"), "held", tag)
        texts = written(texts_of(df, held.select(F.col("_rep").alias("_key")), key, text).withColumnRenamed("_key", "_rep").dropDuplicates(["_rep"]), "texts", tag)
        compared(pairs_in(by_rare_words(held, texts, similarity, tag), similarity))
    of_rep = reps.select("content", "_rep").join(classes.withColumnRenamed("_node", "_rep"), "_rep", "left").select("content", F.coalesce("_class", "_rep").alias("_class"))
    told = rows.select("_key", "n_words", "content").join(of_rep, "content", "left")
    return told.select(F.col("_key").alias(key), F.coalesce("_class", "_key").alias("class_id"), "n_words")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, tag: str = "query") -> DataFrame:
    """The rows of ``df``, in its columns, whose key is that of their class.

    Texts without words stay, and so do rows with a null key; of rows that repeat a key all stay or none. Only rows that may have to go are
    shuffled. Columns of ``df`` may have any names. An empty table stays empty.
    """
    told = near_duplicates(df, key, text, similarity, tag).where(F.col(key).isNotNull())
    gone = written(told.groupBy(F.col(key).alias("_key")).agg(F.max((F.col(key) == F.col("class_id")).cast("int")).alias("_kept")).where("_kept = 0").select("_key"), "gone", tag)
    rows = asked(df.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in df.columns]).alias("_row")), gone)
    return rows.where("NOT _maybe").unionByName(rows.where("_maybe").join(gone, "_key", "left_anti")).select("_row.*")
