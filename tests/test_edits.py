from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from telltale.sources import stores
from telltale.streaming import edits

SCHEMA = "doc_id long, version long, text string, time timestamp"
START = datetime(2024, 1, 1)


@pytest.fixture
def state_store(spark):
    before = spark.conf.get(edits.STATE_STORE[0])
    spark.conf.set(*edits.STATE_STORE)
    yield
    spark.conf.set(edits.STATE_STORE[0], before)


def test_late_and_repeated_versions(spark, state_store, tmp_path):
    at = lambda seconds: START + timedelta(seconds=seconds)
    batches = [
        [(1, 1, "We delve into it.", at(0)), (2, 1, "Plain words here.", at(1)), (3, None, "no version", at(1))],
        [(1, 3, "Nothing of the kind.", at(20)), (1, 2, "We delve into it again.", at(21)), (1, 3, "delve", at(22))],
        [(9, 1, "later", at(100))],
        [(1, 2, "a late version", at(101)), (2, 1, "the same again", at(102)), (2, 2, None, at(103)), (9, 1, "later", at(300))],
        [(9, 2, "last", at(600))],
        [(9, 3, "end", at(601))],
    ]
    source = str(tmp_path / "in")
    out, kept = str(tmp_path / "out"), str(tmp_path / "kept")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        edits.score_edits(spark.readStream.schema(SCHEMA).parquet(source), out, kept, pause_ms=30_000).awaitTermination()
    told = stores.batches(spark, out, "doc_id long, version long, score_per_1k double, verdict string, batch long")
    got = {(r.doc_id, r.version): r.score_per_1k for r in told.collect()}
    assert {k for k in got if k[0] != 9} == {(1, 3), (2, 1), (2, 2)} and told.count() == len(got)
    assert got[1, 3] == 0.0 and got[2, 2] == 0.0


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    write = stores.batch_writer(str(tmp_path / "b"))
    df = spark.range(5)
    write(df, 0)
    write(df, 1)
    write(df, 1)
    got = stores.batches(spark, str(tmp_path / "b"), "id long, batch long")
    assert got.count() == 10 and got.select(F.countDistinct("batch")).first()[0] == 2
    assert stores.batches(spark, str(tmp_path / "none"), "id long").count() == 0
