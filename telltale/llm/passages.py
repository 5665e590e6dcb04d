"""What the operators on repeated passages share: occurrences of anchors, texts by key, spans removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import slices, tidied
from .scratch import written
from .windows import anchors, between, flat, joined, prefix, words

OCCURRENCE = T.StructType([T.StructField("h", T.LongType(), False), T.StructField("c", T.BinaryType(), False), *[T.StructField(n, T.IntegerType(), False) for n in ("first", "last", "place")]])
#: Bytes of text whose words and anchors are found at a time.
SLICE = 1_000_000
#: Bits of the filter that keeps most texts that nobody asks for out of a shuffle; 1 MB, whatever the data.
FILTER_BITS = 1 << 23
#: Bytes of the fingerprint of a window; equal ones are verified before anything is decided.
FINGERPRINT = 4
SPACE = r"[\x20\x09-\x0D]+"


def digest(data: bytes | memoryview) -> bytes:
    """128 bits that tell any two stretches of text apart."""
    return hashlib.blake2b(data, digest_size=16).digest()


def _binaries(sizes: np.ndarray, data: bytes) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def scan(text: Column, window: int, gram: int, by_word: bool, fingerprints: bool) -> Column:
    """A struct for each text: its number of words or bytes, SHA-256 of all of them, and the occurrences of anchors.

    An occurrence has the digest ``c`` of all bytes or words its windows cover and, with ``fingerprints``, in ``w`` a few bytes
    of the hash of each of its windows.
    """
    occurrence = T.StructType([*OCCURRENCE, T.StructField("w", T.BinaryType(), False)]) if fingerprints else OCCURRENCE
    scanned = T.StructType([T.StructField("n", T.LongType(), False), T.StructField("sha256", T.StringType(), False), T.StructField("anchors", T.ArrayType(occurrence, False), False)])

    def of(part: pa.Array, kind: pa.DataType) -> pa.Array:
        texts = flat(part)
        if by_word:
            found = words(texts)
            data, begins, ends = joined(texts, found)
            values, firsts = found.hashes, found.firsts
        else:
            data, values, firsts = texts.data, texts.data, texts.offsets
            begins, ends = np.arange(len(data)), np.arange(1, len(data) + 1)
        raw = memoryview(data.tobytes())

        def stretches(lo: np.ndarray, hi: np.ndarray) -> list[memoryview]:
            """The bytes of values ``lo`` to ``hi``, the latter not among them."""
            some = hi > lo
            a, b = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
            a[some], b[some] = begins[lo[some]], ends[hi[some] - 1]
            return [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]

        a = anchors(values, firsts, window, gram)
        base = firsts[a.text]
        columns = [pa.array(a.hashes.view(np.int64)), pa.array([digest(x) for x in stretches(base + a.first, base + a.last + window)], pa.binary()), *[pa.array(x.astype(np.int32)) for x in (a.first, a.last, a.place)]]
        if fingerprints:
            sizes = a.last - a.first + 1
            starts = np.repeat(base + a.first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            prints = between(prefix(values), starts, starts + window).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :FINGERPRINT]
            columns.append(_binaries(sizes * FINGERPRINT, np.ascontiguousarray(prints).tobytes()))
        rows = pa.StructArray.from_arrays(columns, fields=list(kind[2].type.value_type))
        per_text = pa.array(np.searchsorted(a.text, np.arange(len(part) + 1)).astype(np.int32))
        shas = [hashlib.sha256(x).hexdigest() for x in stretches(firsts[:-1], firsts[1:])]
        return pa.StructArray.from_arrays([pa.array(np.diff(firsts), pa.int64()), pa.array(shas, pa.string()), pa.ListArray.from_arrays(per_text, rows, type=kind[2].type)], fields=list(kind))

    @F.arrow_udf(scanned)
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(scanned)
        for batch in batches:
            parts = [of(part, kind) for part in slices(batch, SLICE)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    return run(text)


def scanned(df: DataFrame, key: str, text: str, window: int, gram: int, by_word: bool, tag: str, fingerprints: bool = False) -> DataFrame:
    """A written table ``_key, n, sha256, anchors`` of all rows."""
    told = df.select(F.col(key).alias("_key"), scan(F.col(text), window, gram, by_word, fingerprints).alias("_s"))
    return written(told.select("_key", "_s.n", "_s.sha256", "_s.anchors"), "scan", tag)


def occurrences(table: DataFrame) -> DataFrame:
    """``_key, h, c, first, last, place`` (and ``w``); rows with a null key take no part."""
    return table.where("_key IS NOT NULL").select("_key", F.explode("anchors").alias("a")).select("_key", "a.*")


def asked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds ``_maybe`` to rows with a ``_key``: false for nearly all whose key is not in ``keys`` (``_key``, distinct, not null).

    A bitmap of fixed size goes to all executors; true may be wrong, false and null keys never are.
    """
    slot = F.pmod(F.xxhash64("_key"), F.lit(FILTER_BITS))
    bits = keys.select(F.bitmap_bucket_number(slot).alias("_slot"), F.bitmap_bit_position(slot).alias("_place")).groupBy("_slot").agg(F.bitmap_construct_agg("_place").alias("_bitmap"))
    placed = rows.withColumns({"_slot": F.bitmap_bucket_number(slot), "_place": F.bitmap_bit_position(slot)}).join(F.broadcast(bits), "_slot", "left")
    byte = F.conv(F.hex(F.expr("substring(_bitmap, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0, F.lit(False))
    return placed.withColumn("_maybe", hit & F.col("_key").isNotNull()).drop("_slot", "_place", "_bitmap")


def texts_of(df: DataFrame, keys: DataFrame, key: str, text: str) -> DataFrame:
    """``_key, _text`` of the rows of ``df`` whose key is in ``keys`` (one column ``_key``, distinct); the join is exact."""
    rows = asked(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), keys)
    return rows.where("_maybe").select("_key", "_text").join(keys, "_key")


REMOVED = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("kept_sha256", T.StringType())])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove(text: Column, spans: Column, by_word: bool, keep: bool) -> Column:
    """A struct for each text and its array of spans: what is removed, and what is left.

    ``kept_sha256`` is of the bytes left or, of words, of the words left with one space between them. The text left comes only
    with ``keep``: without characters that are removed in part and, cut by words, with its own white space but for what follows a
    removed word.
    """

    def of(text: str | None, own: list[dict] | None) -> tuple:
        raw, spans = (text or "").encode(), merged([(x["lo"], x["hi"]) for x in own or ()])
        n, cuts, left = len(raw), spans, None
        if by_word:
            texts = flat(pa.array([raw], pa.binary()))
            found = words(texts)
            whole, begins, ends = joined(texts, found)
            n, bounds = len(begins), [*found.starts.tolist(), len(raw)]
            cuts = [(bounds[a], bounds[b]) for a, b in spans]
            kept_words = [whole[begins[a] : ends[b - 1]].tobytes() for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), n]) if b > a]
            left = b" ".join(kept_words)
        kept = None
        if keep or left is None:
            kept = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(raw)]))
            left = kept if left is None else left
        return sum(b - a for a, b in spans), len(spans), kept.decode("utf-8", "ignore") if keep else None, hashlib.sha256(left).hexdigest()

    @F.arrow_udf(REMOVED)
    @tidied
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(REMOVED)
        for texts, spans in batches:
            out = []
            for lo in range(0, len(texts), 500):
                out.extend(map(of, texts.slice(lo, 500).to_pylist(), spans.slice(lo, 500).to_pylist()))
            columns = list(zip(*out)) or [[]] * 4
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))

    return run(text, spans)


def results(df: DataFrame, table: DataFrame, spans: DataFrame, key: str, text: str, by_word: bool, tag: str) -> DataFrame:
    """``key, n, n_removed, n_spans, kept_sha256`` of each row of the scan ``table``, given all spans (``_key, lo, hi``).

    Texts are read again only where something is removed and something may be left.
    """
    per_text = written(spans.groupBy("_key").agg(F.collect_set(F.struct("lo", "hi")).alias("_spans")), "spans", tag)
    left = table.select("_key", "n", "sha256").join(per_text, "_key", "left")
    reach = F.aggregate(F.array_sort("_spans"), F.lit(0), lambda to, x: F.when(x.lo <= to, F.greatest(to, x.hi)).otherwise(to))
    left = written(left.withColumn("_all", F.coalesce((reach == F.col("n")) & (F.col("n") > 0), F.lit(False))), "left", tag)
    asked = left.where("_spans IS NOT NULL AND NOT _all").select("_key").distinct()
    cut = texts_of(df, asked, key, text).join(per_text, "_key").select("_key", remove(F.col("_text"), F.col("_spans"), by_word, False).alias("_r")).dropDuplicates(["_key"])
    told = left.drop("_spans").join(cut, "_key", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    pick = lambda whole, own, none: F.when(F.col("_all"), whole).when(F.col("_r").isNotNull(), own).otherwise(none)
    return told.select(F.col("_key").alias(key), "n", pick(F.col("n"), F.col("_r.n_removed"), F.lit(0).cast("long")).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("_r.n_spans"), F.lit(0).cast("long")).alias("n_spans"), pick(F.lit(nothing), F.col("_r.kept_sha256"), F.col("sha256")).alias("kept_sha256"))


def cleaned(df: DataFrame, spans: DataFrame, key: str, text: str, by_word: bool, tag: str) -> DataFrame:
    """The rows of ``df`` without the spans (``_key, lo, hi``) in their texts, in the columns of ``df``, whatever their names.

    Only rows that may have a span are shuffled.
    """
    per_text = written(spans.groupBy("_key").agg(F.collect_set(F.struct("lo", "hi")).alias("_spans")), "spans", tag)
    rows = asked(df.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in df.columns]).alias("_row")), per_text.select("_key"))

    def columns(own: Column) -> list[Column]:
        return [own.alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns]

    touched = rows.where("_maybe").join(per_text, "_key", "left")
    kept = remove(F.col("_row")[text], F.col("_spans"), by_word, True)["kept"]
    changed = touched.where("_spans IS NOT NULL").select(*columns(kept))
    same = touched.where("_spans IS NULL").select(*columns(F.col("_row")[text]))
    return rows.where("NOT _maybe").select(*columns(F.col("_row")[text])).unionByName(same).unionByName(changed)
