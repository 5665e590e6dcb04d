"""Folders for what a query keeps, and a sink that may get the same batch twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which the driver and all executors share; deleted when the application ends.

    In local mode, where the setting is absent, a temporary one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="telltale-")
    path = f"{shared.rstrip('/')}/telltale-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def batch_writer(path: str):
    """For ``foreachBatch``: a batch is a folder of its own below ``path``, and one that comes again takes the place of its first try."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All batches that were written, with their number in ``batch``; none if there are none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
    return spark.read.option("basePath", path).schema(schema).parquet(path)
