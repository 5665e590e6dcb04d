"""Approximate nearest neighbours by multiprobe p-stable hashing.

The largest inner product is the smallest distance once every vector has one more component that makes all norms equal.
Each table hashes a vector to a cell of a grid of random Gaussian projections, and the rows of a cell are a bucket. A query looks
up its own cell and cells beside it: perturbations of one step in some of the projections, in the order of their estimated
success, which is the order of the expected distances to the walls that are crossed. What the buckets hold is merged over
the tables and reranked by exact inner products in double precision.

How many buckets are visited is fitted on a bounded sample so that the sample's recall reaches a target; all rows are indexed.
Buckets lie in blocks of bounded size, and a query is sent to the blocks that have a bucket it visits, and to no other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import tidied
from .scratch import written
from .windows import mix

TABLES, WIDTH = 8, 2.0
#: Projections of a table for each doubling of the rows, so that buckets stay small.
PROJECTIONS = 0.6
TARGET = 0.94
#: Bounds of the sample that the number of probes is fitted on.
SAMPLE_ROWS, SAMPLE_NUMBERS, SAMPLE_QUERIES = 8192, 2_000_000, 200
#: Buckets of a table that a query may visit.
PROBES = [1, 2, 4, 8, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096]
#: Vectors in a block; a larger bucket is several blocks.
BLOCK = 65_536


def perturbations(size: int, most: int) -> np.ndarray:
    """Sets of steps in the order of their expected scores, as rows of 0 and 1; the first one is empty.

    Step ``j`` is the one to the ``j``-th nearest of a query's 2 * ``size`` walls; the squares of these distances have known
    expectations for a query that lies anywhere in its cell. A set is taken from the heap, and the two that follow it are put in:
    its last step moved on, and a further step added. Sets that cross both walls of a projection are left out.
    """
    j = np.arange(1, 2 * size + 1)
    near, far = j * (j + 1), (2 * size + 1 - j) * (2 * size + 2 - j)
    scale = 4 * (size + 1) * (size + 2)
    score = np.where(j <= size, near / scale, 1 - (2 * size + 1 - j) / (size + 1) + far / scale)
    heap, found = [(float(score[0]), (0,))], [np.zeros(2 * size, np.int64)]
    while heap and len(found) < most:
        total, steps = heapq.heappop(heap)
        if len({min(s, 2 * size - 1 - s) for s in steps}) == len(steps):
            found.append(np.isin(np.arange(2 * size), steps).astype(np.int64))
        last = steps[-1]
        if last + 1 < 2 * size:
            heapq.heappush(heap, (total - float(score[last]) + float(score[last + 1]), (*steps[:-1], last + 1)))
            heapq.heappush(heap, (total + float(score[last + 1]), (*steps, last + 1)))
    return np.array(found)


class Tables:
    """Grids of projections for vectors of ``size`` components and norms up to ``norm``; a cell is a 64-bit number."""

    def __init__(self, size: int, norm: float, total: int):
        random = np.random.default_rng(17)
        self.norm, self.count = norm, max(4, round(PROJECTIONS * np.log2(max(total, 2))))
        self.grids = [(random.standard_normal((size + 1, self.count)), random.uniform(0, WIDTH, self.count)) for _ in range(TABLES)]
        self.factors = random.integers(0, 1 << 63, (TABLES, self.count)).astype(np.uint64) << np.uint64(1) | np.uint64(1)
        self.sets = perturbations(self.count, PROBES[-1])

    def _numbers(self, table: int, sums: np.ndarray) -> np.ndarray:
        return mix(sums, 977 * table + 1).view(np.int64)

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        """The cell of each vector in each table."""
        scaled = x / self.norm
        full = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1, keepdims=True)))])
        return [self._numbers(t, (np.floor((full @ a + b) / WIDTH).astype(np.int64).view(np.uint64) * f).sum(axis=1, dtype=np.uint64)) for t, ((a, b), f) in enumerate(zip(self.grids, self.factors))]

    def probes(self, query: np.ndarray, count: int) -> list[np.ndarray]:
        """The first ``count`` cells that a query visits in each table."""
        full = np.append(query / (np.linalg.norm(query) or 1.0), 0.0)
        out = []
        for t, ((a, b), f) in enumerate(zip(self.grids, self.factors)):
            at = (full @ a + b) / WIDTH
            own = np.floor(at)
            below = at - own
            walls = np.argsort(np.concatenate((below, 1 - below)), kind="stable")
            step = np.where(walls < self.count, -1, 1).astype(np.int64).view(np.uint64) * f[walls % self.count]
            base = (own.astype(np.int64).view(np.uint64) * f).sum(dtype=np.uint64)
            out.append(self._numbers(t, base + (self.sets[:count].astype(np.uint64) * step).sum(axis=1, dtype=np.uint64)))
        return out


def fitted_probes(tables: Tables, sample: np.ndarray, total: int, k: int) -> int | None:
    """The least number of probes with which queries of the sample find enough of their true nearest.

    As a sample is thinner than the table, only so many neighbours are asked for as fall into it. Equal vectors count
    once: copies find each other anyway and say nothing about the rest.
    """
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(5).permutation(len(sample))]
    own = np.arange(len(sample))[:: max(1, len(sample) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    wanted = min(max(1, min(k, round(k * len(sample) / max(total, 1)))), len(sample) - 1)
    if wanted < 1:
        return PROBES[0]
    products = sample[own] @ sample.T
    products[np.arange(len(own)), own] = -np.inf
    near = products >= np.partition(products, -wanted, axis=1)[:, -wanted][:, None]
    cells = tables.cells(sample)
    needed = []  # of each near neighbour the probes with which it is found
    for i, row in enumerate(own):
        at = np.flatnonzero(near[i])
        best = np.full(len(at), len(tables.sets))
        for cell, probes in zip(cells, tables.probes(sample[row], len(tables.sets))):
            order = np.argsort(probes, kind="stable")
            place = np.minimum(np.searchsorted(probes[order], cell[at]), len(probes) - 1)
            best = np.minimum(best, np.where(probes[order][place] == cell[at], order[place], len(tables.sets)))
        needed.append(best)
    needed = np.concatenate(needed)
    return next((p for p in PROBES if (needed < min(p, len(tables.sets))).mean() >= TARGET), None)


class Block:
    """Vectors of some buckets, those of a bucket together."""

    def __init__(self, cells: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(cells, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.cells, self.starts = np.unique(cells[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(ids))

    def nearest(self, query: np.ndarray, me: int, cells: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of a query's nearest in the buckets ``cells`` (None: in all) but itself, ties to smaller ids."""
        if cells is None:
            rows = np.arange(len(self.ids))
        else:
            at = np.minimum(np.searchsorted(self.cells, cells), len(self.cells) - 1)
            at = np.unique(at[self.cells[at] == cells])
            sizes = self.ends[at] - self.starts[at]
            rows = np.repeat(self.starts[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        rows = rows[self.ids[rows] != me]
        rough = self.x[rows] @ query
        if len(rows) > k:
            least = np.partition(rough, len(rows) - k)[len(rows) - k]
            rows = rows[rough >= least - 1e-9 * max(1.0, abs(float(least)))]
        scores = (self.x[rows] * query).sum(axis=1)  # alike for equal vectors, wherever they stand
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``_id, _x`` of the rows whose vectors are neither null, zero nor with null or non-finite components."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("_x", lambda v: v != 0)
    return df.select(F.col(key).cast("long").alias("_id"), x.alias("_x")).where(F.col("_id").isNotNull() & F.col("_x").isNotNull()).where(F.coalesce(fine, F.lit(False)))


FOUND = "query_id long, vec_id long, score double, table int"


def _in_blocks(stored: DataFrame, asked: DataFrame, size: int, blocks: int, k: int) -> DataFrame:
    """``query_id, vec_id, score, table``: the ``k`` nearest of each query (``_block, _table, _id, _x, _cells``) among the buckets it
    visits of the stored rows (``_block, _table, _cell, _id, _x``) in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, block = None, [], None
        for batch in batches:
            numbers, roles, cells, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            x, visits = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), batch.column(5)
            tables = batch.column(6).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            edges = np.flatnonzero(np.concatenate(([True], (numbers[1:] != numbers[:-1]) | (roles[1:] != roles[:-1]))))
            for lo, hi in zip(edges, [*edges[1:], len(ids)]) if len(ids) else ():
                if numbers[lo] != number:
                    number, held, block = numbers[lo], [], None
                if roles[lo] == 0:
                    held.append((cells[lo:hi], ids[lo:hi], x[lo:hi]))
                    continue
                if block is None:
                    if not held:
                        continue
                    block = Block(*(np.concatenate(c) for c in zip(*held)))
                for i in range(lo, hi):
                    own = visits[i].values
                    found = block.nearest(x[i], ids[i], None if own is None else own.to_numpy(zero_copy_only=False), k)
                    out.append((np.full(len(found[0]), ids[i]), *found, np.full(len(found[0]), tables[i], np.int32)))
            columns = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score", "table"])

    rows = stored.select("_block", F.lit(0).alias("_role"), "_cell", "_id", "_x", F.lit(None).cast("array<long>").alias("_cells"), "_table")
    rows = rows.unionByName(asked.select("_block", F.lit(1).alias("_role"), F.lit(0).cast("long").alias("_cell"), "_id", "_x", "_cells", "_table"))
    return rows.repartition(blocks, "_block").sortWithinPartitions("_block", "_role").mapInArrow(tidied(run), FOUND)


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, tag: str = "query") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row whose key is divisible by ``every``, among all others.

    A query whose buckets hold fewer than ``k`` others is compared with all rows, and so is every query where no number of
    probes finds enough on the sample. Vectors that are null, zero or hold null or non-finite
    components take no part, and vectors of another length than the most frequent one, which have no inner product with the
    others, don't either. Repeated rows of a query are one query, and a query doesn't find rows of its own key; other
    repeated rows are found one by one. Other columns are ignored. An empty table gives no rows.
    """
    spark = df.sparkSession
    rows = usable(df, key, vector)
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v))
    sizes = rows.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, total, longest = sizes[0]
    rows = rows.where(F.size("_x") == size)
    tables = Tables(size, longest, total)
    some = rows.orderBy(F.xxhash64("_id"), "_id").limit(max(2, min(SAMPLE_ROWS, SAMPLE_NUMBERS // size))).select("_x").collect()
    count = fitted_probes(tables, np.array([r[0] for r in some]), total, k)
    shared = spark.sparkContext.broadcast(tables)  # projections and perturbations: bounded by the vectors' length
    blocks = -(-total // BLOCK)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    @tidied
    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.stack(shared.value.cells(batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)), axis=1) if len(batch) else np.zeros((0, TABLES), np.int64)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * TABLES, pa.int32()), pa.array(found.reshape(-1)))

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.LongType())))
    @tidied
    def visited(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            queries = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield pa.array([shared.value.probes(q, count or 1) for q in queries], pa.list_(pa.list_(pa.int64())))

    def block_of(table, cell, part):
        return F.xxhash64(table, F.pmod(cell, F.lit(blocks)), part)

    stored = written(rows.select("_id", "_x", F.posexplode(cells(F.col("_x"))).alias("_table", "_cell")), "cells", tag)
    # a bucket of more rows than a block is blocks of its own, by a hash of the rows
    large = written(stored.groupBy("_table", "_cell").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK).select("_table", "_cell", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_parts")), "large", tag)
    queries = rows.where(F.col("_id") % every == 0).dropDuplicates(["_id"])
    asked = queries.select("_id", "_x", F.posexplode(visited(F.col("_x"))).alias("_table", "_visits"))
    at = F.explode(F.array_distinct(F.transform("_visits", lambda c: F.pmod(c, F.lit(blocks))))).alias("_at")
    sent = asked.select("*", at).select("_id", "_x", "_table", F.xxhash64("_table", "_at", F.lit(0)).alias("_block"), F.filter("_visits", lambda c: F.pmod(c, F.lit(blocks)) == F.col("_at")).alias("_cells"))
    block = F.xxhash64("_table", F.pmod("_cell", F.lit(blocks)), F.lit(0))
    if large.isEmpty():
        placed = stored.withColumn("_block", block)
    else:
        part = F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int") + 1
        placed = stored.join(large, ["_table", "_cell"], "left").withColumn("_block", F.when(F.col("_parts").isNull(), block).otherwise(F.xxhash64("_table", "_cell", part)))
        more = asked.select("_id", "_x", "_table", F.explode("_visits").alias("_cell")).join(large, ["_table", "_cell"])
        more = more.select("_id", "_x", "_table", "_cell", F.explode(F.sequence(F.lit(1), F.col("_parts"))).alias("_part"))
        sent = sent.unionByName(more.select("_id", "_x", "_table", F.xxhash64("_table", "_cell", "_part").alias("_block"), F.array("_cell").alias("_cells")))
    found = written(_merged(_in_blocks(placed, sent, size, TABLES * blocks, k)), "found", tag)
    if count is None:
        found = found.limit(0)
    complete = found.groupBy("query_id").agg(F.sum("copies").alias("_found")).where(F.col("_found") >= k).select(F.col("query_id").alias("_id"))
    few = written(queries.join(complete, "_id", "left_anti"), "few", tag)
    if not few.isEmpty():
        everywhere = rows.select("_id", "_x", F.lit(0).alias("_table"), F.lit(0).cast("long").alias("_cell"), F.pmod(F.xxhash64("_id"), F.lit(blocks)).alias("_block"))
        to_all = few.select("_id", "_x", F.lit(0).alias("_table"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"), F.lit(None).cast("array<long>").alias("_cells"))
        rest = _merged(_in_blocks(everywhere, to_all, size, blocks, k))
        found = found.join(few.select(F.col("_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
    each = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("_copy"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _merged(found: DataFrame) -> DataFrame:
    """Each candidate once, whatever tables it comes from, with the number of its ``copies`` in the table."""
    per_table = found.groupBy("query_id", "vec_id", "score", "table").agg(F.count(F.lit(1)).alias("n"))
    return per_table.groupBy("query_id", "vec_id", "score").agg(F.max("n").alias("copies"))
