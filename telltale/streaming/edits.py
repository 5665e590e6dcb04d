"""Scores of documents that are edited while they stream in: a document is scored once it has been left alone for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telltale.sources.stores import batch_writer

from .stream import scored

#: What the state needs; set it on the session before a stream of edits starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastVersion(StatefulProcessor):
    """Keeps a document's highest version and gives it out when no higher one has come for ``pause`` milliseconds of event time.

    Versions that come late, or again, change nothing. A document that is given out leaves only its version's number behind, so that
    older versions are still told apart.
    """

    def __init__(self, pause: int):
        self.pause = pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "version long, text string, due long")
        self.known = handle.getValueState("known", "version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.known.get()[0] if self.known.exists() else None
        best = None
        for part in rows:
            for version, text, at in zip(part["version"], part["text"], part["at"]):
                if pd.notna(version) and (known is None or version > known) and (best is None or version > best[0]):
                    best = (int(version), None if pd.isna(text) else text, int(at))
        if best is not None:
            if self.waiting.exists():
                self.handle.deleteTimer(self.waiting.get()[2])
            due = best[2] + self.pause
            self.waiting.update((best[0], best[1], due))
            self.known.update((best[0],))
            self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            version, text, _ = self.waiting.get()
            self.waiting.clear()
            yield pd.DataFrame({"key": [key[0]], "version": [version], "text": [text]})

    def close(self) -> None:
        pass


def settled(stream: DataFrame, key: str, version: str, text: str, time: str, pause_ms: int, delay: str) -> DataFrame:
    """``key, version, text`` of documents as they are after ``pause_ms`` without a higher version, each state of a document once.

    ``time`` is an event time; events older than the watermark, ``delay`` behind the latest one, are dropped. Null versions are dropped, a null
    text is an empty document.
    """
    kind = stream.schema[key].dataType
    slim = stream.select(F.col(key).alias("key"), F.col(version).cast("long").alias("version"), F.col(text).alias("text"), F.col(time).alias("time"), (F.unix_micros(time) / 1000).cast("long").alias("at"))
    out = T.StructType([T.StructField("key", kind), T.StructField("version", T.LongType()), T.StructField("text", T.StringType())])
    told = slim.withWatermark("time", delay).groupBy("key").transformWithStateInPandas(LastVersion(pause_ms), out, "Append", "EventTime")
    return told.select(F.col("key").alias(key), F.col("version").alias(version), F.col("text").alias(text))


def score_edits(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", version: str = "version", text: str = "text", time: str = "time", pause_ms: int = 60_000, delay: str = "0 seconds", lang: str = "en", **trigger):
    """Starts the query that scores settled documents and writes ``key, version, score_per_1k, verdict`` below ``path``, a folder for each
    batch: a batch that is tried again after a failure replaces what it had written."""
    told = scored(settled(stream, key, version, text, time, pause_ms, delay), text, lang).drop(text)
    return told.writeStream.foreachBatch(batch_writer(path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
