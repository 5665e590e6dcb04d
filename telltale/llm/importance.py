"""Importance resampling towards a target distribution of word n-grams.

Features are runs of 1 to ``n`` words, hashed into buckets; a bucket's gain is the logarithm of how much likelier it is in the target
than in the corpus. A document's weight is the mean gain of its features, and Gumbel noise drawn from its id turns the highest
sums into a sample without replacement, the same in every run.

Texts longer than a chunk are split at word boundaries: a chunk owns the starting positions of its words and carries the first
``n - 1`` words after them, so each feature is counted by one chunk. Chunks of long texts are spread over the cluster, all other texts
are counted where they are read, and counts and weights are summed by document. Buckets and scores bound what reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import slices, tidied
from .scratch import partitions, written
from .windows import Flat, Words, flat, joined, lowered, words

#: Words are runs of ASCII letters and digits and of all characters beyond ASCII, which are bytes from 0x80 on.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes from which on a text is split, and words that a chunk owns.
LONG, OWNED = 1 << 18, 20_000
#: Bytes of text whose features are counted at a time.
SLICE = 2_000_000
FEATURES = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("n_features", T.LongType(), False), T.StructField("buckets", T.ArrayType(T.IntegerType(), False), False), T.StructField("counts", T.ArrayType(T.IntegerType(), False), False)])


def _words(texts: Flat) -> Words:
    return words(texts, WORD_BYTES)


def _grams(texts: Flat, found: Words, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``n``: the first word of every run of so many words in one text, and the CRC-32 of the run's bytes."""
    data, begins, ends = joined(texts, found)
    raw, last = memoryview(data.tobytes()), found.firsts[1:]
    owner = np.repeat(np.arange(len(last)), np.diff(found.firsts))
    like, at = np.zeros(len(begins), np.int64), np.arange(len(begins))
    offsets = np.append(begins, len(data)).astype(np.int32)
    each = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    number = each.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    for size in range(1, n + 1):
        within = at + size <= last[owner[at]]
        at, like = at[within], like[within]
        # runs are alike if what was alike before goes on with alike words
        _, first, inverse = np.unique(like * (len(begins) + 1) + number[at + size - 1], return_index=True, return_inverse=True)
        crc = np.fromiter((zlib.crc32(raw[begins[i] : ends[i + size - 1]]) for i in at[first].tolist()), np.int64, len(first))
        yield at, crc[inverse]
        like = inverse


def bucket_counts(text: Column, owned: Column, n: int, buckets: int) -> Column:
    """``n_words``, ``n_features`` and how many features each bucket has that occurs, of features starting in the first ``owned``
    words (null: in all of them)."""

    @F.arrow_udf(FEATURES)
    @tidied
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, limits in batches:
            lo, sizes, out = 0, [], []
            for part in slices(texts, SLICE):
                low = lowered(flat(part))
                found = _words(low)
                n_words = np.diff(found.firsts)
                limit = limits.slice(lo, len(part)).fill_null(np.iinfo(np.int32).max).to_numpy(zero_copy_only=False)
                lo += len(part)
                owner = np.repeat(np.arange(len(part)), n_words)
                own = np.arange(len(owner)) - found.firsts[:-1][owner] < limit[owner]
                keys = [owner[at[own[at]]] * buckets + crc[own[at]] % buckets for at, crc in _grams(low, found, n)]
                values, counts = np.unique(np.concatenate(keys), return_counts=True)
                text_of = values // buckets
                distinct = np.bincount(text_of, minlength=len(part))
                features = np.bincount(text_of, weights=counts, minlength=len(part)).astype(np.int64)
                sizes.append((np.minimum(n_words, limit), features, distinct))
                out.append((values % buckets, counts))
            own_words, features, distinct = [np.concatenate(x) for x in zip(*sizes)] if sizes else [np.zeros(0, np.int64)] * 3
            values, counts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2
            offsets = pa.array(np.concatenate(([0], np.cumsum(distinct))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (values, counts)]
            yield pa.StructArray.from_arrays([pa.array(own_words, pa.int64()), pa.array(features, pa.int64()), *lists], FEATURES.names)

    return run(text, owned)


def chunks(text: Column, n: int, owned: int) -> Column:
    """A text's chunks, each of at most ``owned`` words of its own and the ``n - 1`` words after them, as ``text, owned``."""
    kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType(), False), T.StructField("owned", T.IntegerType(), False)]), False)

    @F.arrow_udf(kind)
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            rows = []
            for part in slices(batch, SLICE):
                texts = flat(part)
                found = _words(texts)
                for i, (lo, hi) in enumerate(zip(found.firsts[:-1].tolist(), found.firsts[1:].tolist())):
                    raw, own = texts.data, []
                    for a in range(lo, hi, owned):
                        b, last = min(a + owned, hi), min(a + owned + n - 1, hi)
                        own.append((raw[found.starts[a] : found.ends[last - 1]].tobytes().decode(), b - a))
                    rows.append(own)
            yield pa.array(rows, to_arrow_type(kind))

    return run(text)


def features(df: DataFrame, n: int, buckets: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``_key, _digest, n_words, n_features, buckets, counts`` of each text, and of each chunk of long ones, which have a ``_digest``
    of the whole text and whose first chunk has ``_first`` 1."""
    slim = df.select(F.struct(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).alias("_row")).select("_row.*")
    is_long = F.coalesce(F.octet_length("_text"), F.lit(0)) > LONG
    short = slim.where(~is_long).select("_key", F.lit(None).cast("string").alias("_digest"), F.lit(1).alias("_first"), bucket_counts(F.col("_text"), F.lit(None).cast("int"), n, buckets).alias("_f"))
    parts = slim.where(is_long).select("_key", F.sha2("_text", 256).alias("_digest"), F.posexplode_outer(chunks(F.col("_text"), n, OWNED)).alias("_at", "_c"))
    spread = parts.repartition(partitions(df.sparkSession), "_digest", "_at")
    long = spread.select("_key", "_digest", F.when(F.coalesce("_at", F.lit(0)) == 0, 1).otherwise(0).alias("_first"), bucket_counts(F.col("_c.text"), F.col("_c.owned"), n, buckets).alias("_f"))
    return short.unionByName(long).select("_key", "_digest", "_first", "_f.*")


def histogram(counted: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: at most ``buckets`` rows reach the driver, summed in the cluster first."""
    rows = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("_b")).groupBy("_b.buckets").agg(F.sum("_b.counts")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of how much likelier each bucket is in the target, one feature added to each bucket."""
    there = (target + 1.0) * (float(corpus.sum()) + len(corpus))
    return np.floor(1000 * np.log(there / ((corpus + 1.0) * (float(target.sum()) + len(target))))).astype(np.int64)


def gain_sum(buckets: Column, counts: Column, gain: np.ndarray) -> Column:
    @F.arrow_udf("long")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for which, many in batches:
            ends = which.offsets.to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(gain[which.flatten().to_numpy()] * many.flatten().to_numpy())))
            yield pa.array(sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]])

    return run(buckets, counts)


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """``_key, n_words, n_features, weight`` of each document.

    Chunks are summed by key and text; rows that repeat both are as many rows again, counted by their first chunks.
    """
    rows = counted.select("_key", "_digest", "_first", "n_words", "n_features", gain_sum(F.col("buckets"), F.col("counts"), gain).alias("_gain"))
    columns = ["_key", "n_words", "n_features", "_gain"]
    whole = rows.where("_digest IS NULL").select(*columns)
    summed = rows.where("_digest IS NOT NULL").groupBy("_key", "_digest").agg(F.sum("_first").alias("_n"), *[F.sum(x).alias(x) for x in columns[1:]])
    each = summed.select("_key", *[F.expr(f"{x} DIV _n").alias(x) for x in columns[1:]], F.explode(F.sequence(F.lit(1), F.col("_n"))))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("_gain") / F.col("n_features"))).otherwise(0).cast("long")
    return whole.unionByName(each.select(*columns)).select("_key", "n_words", "n_features", weight.alias("weight"))


def noise(key: Column, seed: str) -> Column:
    """Thousandths of Gumbel noise from a hash of the seed and the key."""
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296))).cast("long")


def drawn(scored: DataFrame, eligible: Column, share: int, tag: str) -> DataFrame:
    """Adds ``rank`` to the ``share`` percent of eligible rows of highest ``score``, ties to the smaller ``_key``, null to all others.

    Distinct scores are bounded by the logarithms they are made of, so their counts may reach the driver. Rows from the last score drawn on
    are sorted by ranges and numbered from the ranges' sizes.
    """
    spark = scored.sparkSession
    counts = sorted(((int(r[0]), int(r[1])) for r in scored.where(eligible).groupBy("score").agg(F.count(F.lit(1))).collect()), reverse=True)
    wanted = sum(n for _, n in counts) * share // 100
    so_far, least = 0, None
    for score, n in counts:
        if so_far >= wanted:
            break
        so_far, least = so_far + n, score
    if least is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    among = F.coalesce(eligible & (F.col("score") >= least), F.lit(False))
    order = [F.desc("score"), F.asc("_key")]
    ranged = scored.where(among).repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranged", tag)
    sizes, before, rows = dict(ranged.groupBy("_part").agg(F.count(F.lit(1))).collect()), 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    starts = F.broadcast(spark.createDataFrame(rows, "_part int, _before long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ranged.withColumn("_own", own).join(starts, "_part").withColumn("rank", F.col("_before") + F.col("_own"))
    taken = numbered.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    return taken.unionByName(scored.where(~among).withColumn("rank", F.lit(None).cast("long")))


def resample(df: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, least_words: int = 20, share: int = 10, seed: str = "2024", key: str = "doc_id", text: str = "text", target_text: str = "text", tag: str = "query") -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of each row of ``df``; the resampled corpus is the rows with a ``rank``.

    Drawn are ``share`` percent, rounded down, of the documents of at least ``least_words`` words. Null and empty texts have no features
    and weight 0. Texts of any length are taken whole. A null key gives no draw, so such a row has a null score and is never drawn, but its words
    count in the corpus. Repeated rows each take part; ties in score go to the smaller key, and rows alike in both in any order. Other columns
    of any name are ignored. An empty table gives no rows, and an empty target makes all buckets alike in it.
    """
    counted = written(features(df, n, buckets, key, text), "features", tag)
    goal = features(target.select(F.lit(0).alias("_id"), F.col(target_text).alias("_goal")), n, buckets, "_id", "_goal")
    gain = gains(histogram(counted, buckets), histogram(goal, buckets))
    scored = written(weighed(counted, gain).withColumn("score", F.col("weight") + noise(F.col("_key"), seed)), "scored", tag)
    eligible = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    return drawn(scored, eligible, share, tag).select(F.col("_key").alias(key), "n_words", "n_features", "weight", "score", "rank")


#: CRC-32 isn't a DuckDB function: its table follows from the polynomial, and it is folded over the bytes of distinct words.
SQL = """
WITH RECURSIVE polynomial AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT range::BIGINT AS i FROM range(256))),
found AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
goal AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM benchmark),
flat AS (SELECT doc_id, unnest(w) AS word FROM found),
terms AS (SELECT DISTINCT word FROM (SELECT word FROM flat UNION ALL SELECT word FROM goal)),
bytes AS (SELECT word, hex(encode(word)) AS h FROM terms),
coded AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
                               lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, polynomial),
corpus AS (SELECT bucket, count(*) AS s FROM flat JOIN coded USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM goal JOIN coded USING (word) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM corpus), 0)::DOUBLE AS ss, coalesce((SELECT sum(t) FROM target), 0)::DOUBLE AS tt),
gain AS (
  SELECT c.bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (ss + 10000) / ((s + 1.0::DOUBLE) * (tt + 10000))))::BIGINT AS g
  FROM corpus c LEFT JOIN target USING (bucket), sums),
weighted AS (
  SELECT f.doc_id, len(w)::BIGINT AS n_features, coalesce(x.weight, 0)::BIGINT AS weight
  FROM found f LEFT JOIN (SELECT doc_id, floor(sum(g)::DOUBLE / count(*)) AS weight FROM flat JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY doc_id) x USING (doc_id)),
scored AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM weighted),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
