"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode (tests) where the setting is absent."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="telltale-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def new_path(spark: SparkSession, name: str, tag: str = "query") -> str:
    """A fresh path below the shared folder, deleted when the application ends or ``release(tag)`` is called."""
    path = f"{shared_dir(spark)}/telltale-{name}-{uuid.uuid4().hex}"
    fs, hadoop = _filesystem(spark, path)
    fs.deleteOnExit(hadoop)
    _FOLDERS.setdefault(tag, []).append(path)
    return path


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session that hold for what runs within, ``__`` standing for a dot in their names."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, tag: str = "query") -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it back.

    The files outlive executors, so a lost executor costs the tasks it was running and nothing before them. What was shuffled for the
    table goes as soon as it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, name, tag)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _filesystem(spark, path)
    return fs.exists(hadoop)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it doesn't exist."""
    fs, hadoop = _filesystem(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(hadoop) if x.isDirectory()] if fs.exists(hadoop) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _filesystem(spark, path)
    fs.delete(hadoop, True)


def release(spark: SparkSession, tag: str) -> None:
    """Deletes what was written under ``tag``; call it once nothing that reads those tables is still to run."""
    for path in _FOLDERS.pop(tag, []):
        remove(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
