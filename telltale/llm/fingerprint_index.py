"""Substring deduplication against a log-structured index of window fingerprints.

The index is a row of sorted, immutable runs. A run holds the fingerprints (4 bytes) of all windows of 50 words of the documents of
a batch, gathered under the windows' anchors; of windows that are alike all through, only the document that had them
first. A new batch becomes a run of its own and is merge-joined with the runs before it: no earlier text is read to find
what may be repeated. Every match is then verified on the words themselves (digests of 128 bits), for which the matching
documents' texts, and no others, are fetched. Runs of a level are merged into one of the next level, so a fingerprint is
rewritten a logarithmic number of times.

Runs and manifests are folders below the shared folder. A manifest is written after the run it names, so what a lost driver left half
done is not seen, and ``FingerprintIndex(spark, folder)`` goes on from the last manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import passages as P
from .chunks import tidied
from .scratch import exists, new_path, partitions, release, remove, subfolders, written
from .windows import flat, joined, words

WINDOW, GRAM = 50, 10
#: Batches of the query, and runs of a level that are merged into one of the next.
BATCHES, FAN = 3, 2
ROW = ["h", "c", "batch", "_key", "first", "place", "copies", "w"]
#: Rows of an anchor hash that one task compares; larger groups are aggregated by fingerprint in Spark.
GROUP = 50_000


@dataclass(frozen=True)
class Run:
    name: str
    level: int
    batch: int


class FingerprintIndex:
    """The runs below ``folder``, oldest first; ``buckets`` is fixed when the index is made.

    A row of a run stands for windows of the same content around the same anchor: ``h`` (the anchor's hash), ``c`` (128-bit digest
    of the words they cover), ``batch`` and ``_key`` (the document that had them first), ``first`` (the first window's start), ``place``
    (the anchor's), ``copies`` (how often they occurred) and ``w`` (the windows' fingerprints, end to end).
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder, self.runs, self.version = spark, folder.rstrip("/"), [], 0
        self.buckets = buckets or partitions(spark)
        versions = sorted(v for v in subfolders(spark, f"{self.folder}/manifests") if exists(spark, f"{self.folder}/manifests/{v}/_SUCCESS"))
        if versions:
            rows = spark.read.json(f"{self.folder}/manifests/{versions[-1]}", "position int, name string, level int, batch int, buckets int").orderBy("position").collect()
            self.version, self.buckets = int(versions[-1]), rows[0]["buckets"]
            self.runs = [Run(r["name"], r["level"], r["batch"]) for r in rows if r["name"]]
        self._tables: dict[str, str] = {}

    @property
    def next_batch(self) -> int:
        return max((r.batch for r in self.runs), default=-1) + 1

    def _commit(self, runs: list[Run]) -> None:
        self.runs, self.version = runs, self.version + 1
        rows = [(i, r.name, r.level, r.batch, self.buckets) for i, r in enumerate(runs)]
        self.spark.createDataFrame(rows, "position int, name string, level int, batch int, buckets int").coalesce(1).write.json(f"{self.folder}/manifests/{self.version:08d}")

    def table(self, run: Run) -> DataFrame:
        """A run as a table bucketed and sorted by ``h``, so that joins on ``h`` don't shuffle it."""
        if run.name not in self._tables:
            name = f"telltale_{uuid.uuid4().hex}"
            kind = self.spark.read.parquet(f"{self.folder}/runs/{run.name}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/runs/{run.name}'")
            self._tables[run.name] = name
        return self.spark.table(self._tables[run.name])

    def write_run(self, rows: DataFrame, level: int, batch: int) -> Run:
        """Writes a run that no manifest names yet."""
        run = Run(f"{batch:08d}-{level}-{uuid.uuid4().hex}", level, batch)
        table = f"telltale_{uuid.uuid4().hex}"
        spread = rows.select(*ROW).repartition(self.buckets, "h")
        spread.write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/runs/{run.name}").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(table)
        self._tables[run.name] = table
        return run

    def append(self, run: Run) -> None:
        """Makes a written run part of the index, and merges the levels that are full."""
        self._commit([*self.runs, run])
        while True:
            full = next((level for level in sorted({r.level for r in self.runs}) if sum(r.level == level for r in self.runs) >= FAN), None)
            if full is None:
                return
            old = [r for r in self.runs if r.level == full]
            union = reduce(DataFrame.unionByName, [self.table(r) for r in old])
            merged = union.groupBy("h", "c").agg(F.min(F.struct("batch", "_key", "first", "place", "w")).alias("m"), F.sum("copies").alias("copies")).select("h", "c", "m.*", "copies")
            new = self.write_run(merged, full + 1, old[-1].batch)
            at = self.runs.index(old[0])
            self._commit([*self.runs[:at], new, *[r for r in self.runs[at:] if r not in old]])
            for r in old:
                self._forget(r)
                remove(self.spark, f"{self.folder}/runs/{r.name}")

    def _forget(self, run: Run) -> None:
        if run.name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(run.name)}")

    def close(self) -> None:
        """Drops the session's table names; runs and manifests stay."""
        for run in self.runs:
            self._forget(run)

    def add(self, table: DataFrame, texts: DataFrame, key: str, text: str, tag: str = "query") -> DataFrame:
        """Takes in a batch (``table``: its scan with fingerprints; ``texts``: all documents so far, read only where there is something to
        verify) and returns a written table of the spans of words to remove in it: ``_key, lo, hi``.

        Documents of earlier batches come before those of this one, which come in the order of their keys.
        """
        found, batch = P.occurrences(table), self.next_batch
        classes = found.groupBy("h", "c").agg(F.min(F.struct("_key", "first", "place", "w")).alias("m"), F.count(F.lit(1)).alias("copies"))
        run = self.write_run(classes.select("h", "c", F.lit(batch).alias("batch"), "m.*", "copies"), 0, batch)
        own, older = self.table(run), [self.table(r) for r in self.runs]
        # the merge join: rows of earlier runs around anchors that the batch has too
        member = ["h", "batch", "_key", "first", "place", "w"]
        parts = [o.select("c", *member).join(own.select("h").hint("merge"), "h", "left_semi") for o in older]
        known = written(reduce(DataFrame.unionByName, parts) if parts else own.select("c", *member).limit(0), "known", tag)
        had = known.select("h", "c").distinct().withColumn("_had", F.lit(True))
        # alike all through: what has been there before, and further occurrences within the batch
        told = own.select("h", "c", F.col("_key").alias("_first_key"), F.col("first").alias("_first_at"), "copies").join(had, ["h", "c"], "left")
        told = written(told.withColumn("_had", F.coalesce("_had", F.lit(False))).where("_had OR copies > 1"), "again", tag)
        same = found.join(told.drop("copies"), ["h", "c"]).where("_had OR _key > _first_key OR first > _first_at")
        same = same.select("_key", "h", "first", "last", "place", F.when(~F.expr("_had OR _key > _first_key"), F.col("w")).alias("w"))
        same = written(same, "same", tag)
        whole = same.where("w IS NULL").select("_key", F.col("first").alias("lo"), (F.col("last") + WINDOW).cast("int").alias("hi"))
        # the same anchor in other surroundings: windows are compared
        new = own.join(told.where("_had").select("h", "c"), ["h", "c"], "left_anti").select(*member)
        again = same.where("w IS NOT NULL").select("h", F.lit(batch).alias("batch"), "_key", "first", "place", "w")
        counted = own.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h")
        several = written(counted.union(known.select("h")).distinct(), "several", tag)
        pool = new.unionByName(again).join(several, "h", "left_semi").unionByName(known.select(*member))
        partial = repeated(written(pool, "pool", tag), texts, key, text, batch, tag)
        spans = written(whole.union(partial), "batch", tag)
        self.append(run)
        return spans


def claims_of(pool: DataFrame, batch: int) -> DataFrame:
    """``h, _key, lo, n, _other, _at``: runs of ``n`` windows of documents of the batch, and where an earlier document has the
    same fingerprints around the same anchor; one task compares an anchor's rows."""
    kind, width = pool.schema["_key"].dataType, P.FINGERPRINT
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("_key", kind), T.StructField("lo", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("_other", kind), T.StructField("_at", T.IntegerType())])

    def compared(rows: pa.Table) -> pa.RecordBatch:
        h, batches, keys, first, place, w = (rows.column(i).combine_chunks() for i in range(6))
        h, first, place, sizes = h.to_numpy(), first.to_numpy(), place.to_numpy(), pc.binary_length(w).to_numpy(zero_copy_only=False) // width
        row = np.repeat(np.arange(len(h)), sizes)
        start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        prints = np.zeros((len(row), 4), np.uint8)
        prints[:, :width] = np.frombuffer(b"".join(w.to_pylist()), np.uint8).reshape(-1, width)
        at = (place[row] - start).astype(np.uint64) << np.uint64(32) | prints.view("<u4").reshape(-1).astype(np.uint64)
        group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))[row]
        order = np.lexsort((at, group))  # stable: within a fingerprint in the order of the documents
        new = np.ones(len(order), bool)
        new[1:] = (at[order][1:] != at[order][:-1]) | (group[order][1:] != group[order][:-1])
        owner = np.empty(len(order), np.int64)
        owner[order] = row[order][new][np.cumsum(new) - 1]
        other = pc.not_equal(keys.take(pa.array(row)), keys.take(pa.array(owner))).to_numpy(zero_copy_only=False)
        earlier = other | (batches.to_numpy()[row] != batches.to_numpy()[owner])
        hit = np.flatnonzero(earlier & (batches.to_numpy()[row] == batch))
        head = np.ones(len(hit), bool)
        head[1:] = (hit[1:] != hit[:-1] + 1) | (row[hit][1:] != row[hit][:-1]) | (owner[hit][1:] != owner[hit][:-1])
        heads = np.flatnonzero(head)
        n = np.diff(np.append(heads, len(hit)))
        at_head = hit[heads]
        there = place[owner[at_head]] - (place[row[at_head]] - start[at_head])
        columns = [pa.array(h[row[at_head]]), keys.take(pa.array(row[at_head])), pa.array(start[at_head].astype(np.int32)), pa.array(n.astype(np.int32)), keys.take(pa.array(owner[at_head])), pa.array(there.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["h", "_key", "lo", "n", "_other", "_at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for lo in range(0, whole.num_rows, 4000):
                part = pa.Table.from_batches([whole.slice(lo, 4000)])
                rows = pa.concat_tables([held, part]) if held is not None else part
                last = rows.column(0)[-1].as_py()
                cut = int(np.searchsorted(rows.column(0).to_numpy(), last))
                if cut:
                    yield compared(rows.slice(0, cut))
                held = rows.slice(cut)
        if held is not None:
            yield compared(held)

    ordered = pool.repartition(partitions(pool.sparkSession), "h").sortWithinPartitions("h", "batch", "_key", "first")
    return ordered.select("h", "batch", "_key", "first", "place", "w").mapInArrow(tidied(run), schema)


def claims_by_fingerprint(pool: DataFrame, batch: int) -> DataFrame:
    """The same for groups of any size, a window at a time: partial aggregates keep any one fingerprint small."""
    places = F.sequence(F.lit(0), (F.length("w") / P.FINGERPRINT - 1).cast("int"))
    long = pool.select("h", "batch", "_key", "first", "place", F.posexplode(F.transform(places, lambda i: F.expr("w").substr(i * P.FINGERPRINT + 1, F.lit(P.FINGERPRINT)))).alias("i", "x"))
    long = long.select("h", "batch", "_key", (F.col("first") + F.col("i")).cast("int").alias("lo"), (F.col("place") - F.col("first") - F.col("i")).alias("j"), "x")
    first = long.groupBy("h", "j", "x").agg(F.min(F.struct("batch", "_key", "lo")).alias("m"))
    told = long.where(F.col("batch") == batch).join(first, ["h", "j", "x"]).where("m._key <> _key OR m.batch <> batch")
    return told.select("h", "_key", "lo", F.lit(1).alias("n"), F.col("m._key").alias("_other"), F.col("m.lo").alias("_at"))


def digests(texts: DataFrame, requests: DataFrame) -> DataFrame:
    """``_key, lo, n, d``: the digest of the words that ``n`` windows from ``lo`` on cover, of each request (``_key, lo, n``)."""
    asked = requests.groupBy("_key").agg(F.collect_set(F.struct("lo", "n")).alias("_asked"))
    kind = requests.schema["_key"].dataType
    schema = T.StructType([T.StructField("_key", kind), T.StructField("lo", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("d", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = flat(part.column(1))
                found = words(texts)
                data, begins, ends = joined(texts, found)
                raw = memoryview(data.tobytes())
                owner, at, n, out = [], [], [], []
                for i, spans in enumerate(part.column(2).to_pylist()):
                    base, past = found.firsts[i], found.firsts[i + 1]
                    for x in spans:
                        a, b = base + x["lo"], min(base + x["lo"] + x["n"] + WINDOW - 1, past)
                        owner.append(i)
                        at.append(x["lo"])
                        n.append(x["n"])
                        out.append(P.digest(raw[begins[a] : ends[b - 1]]) if a < b else b"")
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(out, pa.binary())], ["_key", "lo", "n", "d"])

    return texts.join(asked, "_key").select("_key", "_text", "_asked").mapInArrow(tidied(run), schema)


def repeated(pool: DataFrame, texts: DataFrame, key: str, text: str, batch: int, tag: str) -> DataFrame:
    """``_key, lo, hi``: verified spans of documents of the batch that earlier documents have too.

    ``pool`` is a written table. Where a fingerprint turns out to be equal by chance, all windows of its anchor's rows are told
    apart by digests of their words instead.
    """
    large = pool.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GROUP).select("h")
    claims = claims_of(pool, batch)
    if not large.isEmpty():
        claims = claims_of(pool.join(large, "h", "left_anti"), batch).unionByName(claims_by_fingerprint(pool.join(large, "h", "left_semi"), batch))
    claims = written(claims, "claims", tag)
    requests = claims.select("_key", "lo", "n").union(claims.select("_other", "_at", "n")).distinct()
    known = written(digests(P.texts_of(texts, requests.select("_key").distinct(), key, text), requests), "digests", tag)
    theirs = known.select(F.col("_key").alias("_other"), F.col("lo").alias("_at"), "n", F.col("d").alias("_d"))
    checked = written(claims.join(known, ["_key", "lo", "n"]).join(theirs, ["_other", "_at", "n"]).select("h", "_key", "lo", (F.col("lo") + F.col("n") + WINDOW - 1).cast("int").alias("hi"), (F.col("d") == F.col("_d")).alias("_same")), "checked", tag)
    spans = checked.where("_same").select("_key", "lo", "hi")
    chance = checked.where("NOT _same").select("h").distinct()
    if chance.isEmpty():
        return spans
    rows = pool.join(written(chance, "chance", tag), "h", "left_semi")
    each = written(rows.select("h", "batch", "_key", F.explode(F.sequence("first", F.col("first") + (F.length("w") / P.FINGERPRINT - 1).cast("int"))).alias("lo")).withColumn("n", F.lit(1)), "each", tag)
    own = written(each.join(digests(P.texts_of(texts, each.select("_key").distinct(), key, text), each.select("_key", "lo", "n").distinct()), ["_key", "lo", "n"]), "each-digest", tag)
    first = own.groupBy("h", "d").agg(F.min(F.struct("batch", "_key")).alias("m"))
    exact = own.where(F.col("batch") == batch).join(first, ["h", "d"]).where("m._key <> _key OR m.batch <> batch")
    return spans.union(exact.select("_key", "lo", (F.col("lo") + WINDOW).cast("int").alias("hi")))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, tag: str = "query") -> DataFrame:
    """``key, n, n_removed, n_spans, kept_sha256`` of each row of ``df``: words covered by a window of 50 words that also
    starts in a document of a smaller key are removed.

    The documents are taken in ``batches`` of ascending keys, bounded by approximate quantiles; the number of batches does
    not change the result. Null, empty and short texts lose nothing; texts of any length are taken whole. Rows with a null key lose nothing and
    cause no loss. Repeated rows have equal keys, so neither makes the other lose words. Other columns are ignored. An empty table gives
    no rows.
    """
    spark = df.sparkSession
    steps = [i / batches for i in range(1, batches)]
    bounds = sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", steps, 0.01))) if steps else []
    k = F.col(key)
    index, tables, spans = FingerprintIndex(spark, new_path(spark, "index", tag)), [], []
    for i, (low, high) in enumerate(zip([None, *bounds], [*bounds, None])):
        own = f"{tag}, batch {i}"  # what a batch keeps aside goes when its spans are written
        above = F.coalesce(k > low, F.lit(False)) if low is not None else F.lit(True)
        below = F.coalesce(k <= high, F.lit(low is None)) if high is not None else F.lit(True)
        table = P.scanned(df.where(above & below), key, text, WINDOW, GRAM, True, own, fingerprints=True)
        tables.append(written(table.select("_key", "n", "sha256"), "texts", tag))
        spans.append(written(index.add(table, df.where(below), key, text, own), "spans", tag))
        release(spark, own)
    index.close()
    return P.results(df, reduce(DataFrame.unionByName, tables), reduce(DataFrame.unionByName, spans), key, text, True, tag)
