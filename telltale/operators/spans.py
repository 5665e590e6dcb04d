"""Spans of any source within a document, brought down to spans that don't overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def swept(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", first: list[str] | None = None) -> DataFrame:
    """The rows of ``spans`` that a sweep from left to right keeps: the next span that begins where the last one kept ends or later, of
    those that begin at one place the longest, and of equal ones the first by ``first``.

    That is what an alternation of all spans' patterns, longest first, would match. Spans are sorted within their document, named by ``keys``,
    and pass through with one number of state, so no document's spans are held. Empty spans and those with a null place go; rows with
    equal keys are one document, null keys too. An empty table stays empty.
    """
    columns = [F.struct(*[F.col(c) for c in spans.columns]).alias("_row"), F.struct(*keys).alias("_keys"), F.col(start).alias("_start"), F.col(end).alias("_end"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(first or [])]]
    slim = spans.select(*columns).where("_start < _end")
    ordered = slim.repartition("_keys").sortWithinPartitions("_keys", "_start", F.desc("_end"), *[f"_by{i}" for i in range(len(first or []))])
    rows = ordered.select("_row.*", F.col("_start").cast("long"), F.col("_end").cast("long"), F.to_json("_keys", {"ignoreNullFields": "false"}).alias("_keys"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, past = None, 0
        for batch in batches:
            n = batch.num_columns - 3
            starts, ends, own = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist()
            kept = np.zeros(batch.num_rows, bool)
            for i, (a, b, key) in enumerate(zip(starts, ends, own)):
                if key != document:
                    document, past = key, 0
                if a >= past:
                    kept[i], past = True, b
            yield batch.select(list(range(n))).filter(pa.array(kept))

    return rows.mapInArrow(sweep, spans.schema)


def trimmed(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", first: list[str] | None = None) -> DataFrame:
    """The rows of ``spans`` with what an earlier one covers cut off, in place of ``start``; of one wholly covered nothing stays.

    Earlier is what begins before, then what ``first`` puts first, then the longer one. A window's running maximum of ends, sorted within a document.
    """
    order = [F.asc(start), *[F.asc(c) for c in first or []], F.desc(end)]
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    past = F.coalesce(F.max(end).over(before), F.lit(0))
    return spans.where(F.col(start) < F.col(end)).withColumn("_past", past).withColumn(start, F.greatest(start, "_past")).where(F.col(start) < F.col(end)).drop("_past")
