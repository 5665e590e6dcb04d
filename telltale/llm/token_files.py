"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank in the corpus, frequent ones first, so most take one byte. Of each rank two bits of a
control byte hold its length in bytes, less one, four ranks to a control byte; the bytes themselves, low ones first,
lie in a stream of their own. Blocks of documents are the rows of Parquet shards
in ascending order of the key, written by Spark's committer, so a lost executor leaves no half-written file; beside
them lie the vocabulary (rank, id) and the manifest (shard, ids before it).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import LibraryIds, library_tokenizer, tidied
from .scratch import partitions, written

#: Lengths of the four values of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: Tokens after which a block ends.
BLOCK_TOKENS = 1 << 18


def compress(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    if not len(values):
        return b"", b""
    values = values.astype("<u4")
    codes = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = codes
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= codes[:, None]]
    return control.tobytes(), data.tobytes()


def expand(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of control and data bytes."""
    if not n:
        return np.zeros(0, "<u4")
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(sizes)
    if ends[-1] != len(data):
        raise ValueError("the data bytes don't match their control bytes")
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < sizes[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


def id_kind(path: str) -> str:
    """Two bytes an id where the vocabulary allows, else four."""
    return "<u2" if library_tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def tokenised(df: DataFrame, path: str, end_id: int, key: str, text: str, tag: str) -> DataFrame:
    """A written table of ``_key`` and ``_ids`` (of ``id_kind``)."""
    kind = id_kind(path)

    @F.arrow_udf(T.BinaryType())
    @tidied
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of, end = LibraryIds.of(path), np.array([end_id], kind).tobytes()
        for batch in batches:
            yield pa.array([x.astype(kind).tobytes() + end for x in ids_of(batch)], pa.binary())

    return written(df.select(F.col(key).alias("_key"), ids(F.col(text)).alias("_ids")), "ids", tag)


def frequencies(table: DataFrame, kind: str) -> np.ndarray:
    """Ids by descending count, ties to the smaller id. The driver gets a row for each id of the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                found = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(lo, 1000).to_pylist()), kind))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counted = table.select("_ids").mapInArrow(tidied(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r[0] for r in sorted(counted, key=lambda r: (-r[1], r[0]))], np.int64)


def write(df: DataFrame, out: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", tag: str = "query") -> None:
    """Writes token files of all documents of ``df`` to the folder ``out``, which must not exist.

    Each document's ids are followed by ``end_id``; null and empty texts have the end id alone. Documents come in
    ascending order of ``key``, null keys first, rows of equal keys in the order of their ids. An empty table gives an
    empty folder of the same schema.
    """
    spark, kind = df.sparkSession, id_kind(path)
    ids = tokenised(df, path, end_id, key, text, tag)
    by_rank = frequencies(ids, kind)
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(by_rank)], "rank long, id long").coalesce(1).write.parquet(f"{out}/vocabulary")
    ranks = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
    ranks[by_rank] = np.arange(len(by_rank))
    shared = spark.sparkContext.broadcast(ranks)  # bounded by the vocabulary
    key_kind = ids.schema["_key"].dataType
    block = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("keys", T.ArrayType(key_kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("tokens", T.LongType()), T.StructField("control", T.BinaryType()), T.StructField("data", T.BinaryType())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, shard, width = to_arrow_schema(block), TaskContext.get().partitionId(), np.dtype(kind).itemsize
        number, before, keys, held, size = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(held), kind)
            fields = [shard, number, before, keys, [len(x) // width for x in held], len(values), *compress(shared.value[values])]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(fields, schema)], schema=schema)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    keys.append(k)
                    held.append(x)
                    size += len(x) // width
                    if size >= BLOCK_TOKENS or len(keys) >= 4096:
                        yield flush()
                        number, before, keys, held, size = number + 1, before + size, [], [], 0
        if keys:
            yield flush()

    ranged = ids.repartitionByRange(partitions(spark), "_key").sortWithinPartitions(F.col("_key").asc_nulls_first(), "_ids")
    ranged.mapInArrow(tidied(blocks), block).write.option("compression", "zstd").parquet(f"{out}/shards")
    totals = spark.read.schema(block).parquet(f"{out}/shards").groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    manifest = totals.select("shard", "tokens", (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("before"))
    manifest.coalesce(1).write.parquet(f"{out}/manifest")


def read(spark: SparkSession, out: str, ids: bool = True) -> DataFrame:
    """The documents of token files: ``key``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32`` and,
    unless ``ids`` is false, ``ids``.

    Blocks are decoded where they are read; the manifest, a row for each shard, is joined by shard.
    """
    shards = spark.read.parquet(f"{out}/shards")
    vocabulary = spark.read.parquet(f"{out}/vocabulary").orderBy("rank").collect()
    table = spark.sparkContext.broadcast(np.array([r["id"] for r in vocabulary], "<u4"))
    kind = shards.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("key", kind), T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else [])])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = table.value[expand(row["control"], row["data"], row["tokens"])]
                ends = np.cumsum(np.array(row["sizes"], np.int64))
                parts = np.split(found, ends[:-1])
                sums = [zlib.crc32(x.tobytes()) for x in parts]
                values = [[row["shard"]] * len(parts), row["keys"], row["first"] + ends - row["sizes"], row["sizes"], sums, *([[x.astype(np.int32) for x in parts]] if ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    decoded = shards.mapInArrow(tidied(decode), schema)
    before = spark.read.parquet(f"{out}/manifest").select("shard", "before")
    joined = decoded.join(before, "shard")
    return joined.select("key", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
