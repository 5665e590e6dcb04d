"""Diagnostics as a data source of Spark: ``spark.read.format("telltale_diagnostics")`` and ``df.write`` to the same format.

A folder holds files of JSON lines, as review tools read them; each file is a partition. Tasks write files under hidden names, and only
a commit of all of them makes them visible, so a failed write leaves nothing that a reader sees. The folder must be one that the
driver and all executors mount.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SEVERITY = {"E": "ERROR", "W": "WARNING", "I": "INFO"}
LETTER = {v: k for k, v in SEVERITY.items()}
ENDING = ".rdjsonl"


@dataclass
class File(InputPartition):
    path: str


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        """A partition for each file; a folder that isn't there is an error, one without files is empty."""
        names = sorted(x for x in os.listdir(self.folder) if x.endswith(ENDING) and not x.startswith((".", "_")))
        return [File(os.path.join(self.folder, x)) for x in names] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        """``path, line, type, text`` of each valid line; others are left out."""
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                try:
                    told = json.loads(line)
                    place = told["location"]
                    yield place.get("path"), place["range"]["start"]["line"], LETTER.get(told.get("severity"), "W"), told["message"]
                except (ValueError, KeyError, TypeError, AttributeError):
                    continue


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    rows: int


class Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        hidden, n = os.path.join(self.folder, f".part-{uuid.uuid4().hex}{ENDING}"), 0
        with open(hidden, "w", encoding="utf-8") as out:
            for row in rows:
                place = {"path": row["path"], "range": {"start": {"line": row["line"]}}}
                out.write(json.dumps({"message": row["text"], "location": place, "severity": SEVERITY.get(row["type"], "WARNING")}, ensure_ascii=False) + "\n")
                n += 1
        return Written(hidden, n)

    def commit(self, messages: list[Written | None]) -> None:
        """What the tasks wrote becomes visible; with overwrite what was there before goes first."""
        done = [m for m in messages if m is not None]
        if self.overwrite and os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                if name.endswith(ENDING) and not name.startswith("."):
                    os.remove(os.path.join(self.folder, name))
        for m in done:
            folder, name = os.path.split(m.hidden)
            if m.rows:
                os.replace(m.hidden, os.path.join(folder, name[1:]))
            else:
                os.remove(m.hidden)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.hidden):
                os.remove(m.hidden)


class Diagnostics(DataSource):
    """Options: ``path``, the folder."""

    @classmethod
    def name(cls) -> str:
        return "telltale_diagnostics"

    def schema(self) -> str:
        return "path string, line int, type string, text string"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Diagnostics)
