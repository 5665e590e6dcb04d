import os

import pytest
from pyspark.sql import functions as F

from telltale.operators import findings
from telltale.sources import diagnostics_source


@pytest.fixture(scope="module")
def told(spark):
    diagnostics_source.register(spark)
    df = spark.createDataFrame([("a.txt", "We delve into it.\nAs an AI I cannot browse the internet."), ("b.txt", "Plain.\n\nIt's important to note “this”.")], "path string, text string")
    return findings.parse_diagnostics(findings.diagnostics(findings.findings(df, "path", lang="en"), "path"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_round_trip(spark, told, tmp_path):
    folder = str(tmp_path / "out")
    told.repartition(3).write.format("telltale_diagnostics").mode("append").save(folder)
    read = lambda: spark.read.format("telltale_diagnostics").load(folder)
    assert rows(read()) == rows(told) and len(rows(told)) >= 3
    told.limit(1).write.format("telltale_diagnostics").mode("append").save(folder)
    assert read().count() == told.count() + 1
    told.where("type = 'E'").write.format("telltale_diagnostics").mode("overwrite").save(folder)
    assert rows(read()) == rows(told.where("type = 'E'"))
    with open(os.path.join(folder, "more.rdjsonl"), "w") as out:
        out.write('not json\n{"message": "no place"}\n')
    assert read().count() == told.where("type = 'E'").count()
    assert read().where("line > 1").select("path").count() >= 1


def test_a_failed_write_leaves_nothing(spark, told, tmp_path):
    folder = str(tmp_path / "failed")
    broken = told.repartition(2).withColumn("line", F.when(F.col("type") == "E", F.raise_error("no")).otherwise(F.col("line")).cast("int"))
    with pytest.raises(Exception, match="no"):
        broken.write.format("telltale_diagnostics").mode("append").save(folder)
    os.makedirs(folder, exist_ok=True)
    assert spark.read.format("telltale_diagnostics").load(folder).count() == 0
