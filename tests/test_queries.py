import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
NAMES = ["word_counts", "sentence_stats", "buzz_hits", "artifact_hits", "lang_confusion", "prose_score_fr", "overlap_pool", "verdict_by_source", "html_comments", "ignore_anti_join"]


def test_registry_needs_no_session():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 70 and set(sql) <= set(queries)


def test_registry_without_the_folders_for_training_data(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    place = tmp_path / "copy"
    shutil.copytree(root, place, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; print(sorted(q for q in e.queries() if q == 'pipeline' or q[:2] == 'op' and q[2].isdigit()), len(e.oracle_sql()) > 60)"
    told = subprocess.run([sys.executable, "-c", code], cwd=place, env={**os.environ, "PYTHONPATH": str(place)}, capture_output=True, text=True, check=True)
    assert told.stdout.split("\n")[0] == "[] True"


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda rs: sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rs)
    a, b = rows(got.select(*columns).collect()), rows(want.project(", ".join(columns)).fetchall())
    assert a == b and len(set(a)) > 1


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_stream(spark):
    rows = entry.queries()["event_window_verdicts"](spark, SF).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()


def test_marks_are_computed_once(spark):
    """No filter on the array of marks may go below the projection that computes it."""
    told = entry.queries()["marked_spans"](spark, SF)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") == 1
    rows = {r.category: (r.n, r.chars) for r in told.collect()}
    assert len(rows) > 5 and all(n > 0 and chars >= n for n, chars in rows.values())


def test_files_are_lexed_once(spark):
    """Comments, docstrings and the code beside them come from one pass over the lexer's rows."""
    told = entry.queries()["restated_rows"](spark, SF)
    assert told._jdf.queryExecution().optimizedPlan().toString().count("LexSource(") == 1
    got = {tuple(r) for r in told.collect()}
    assert got == set(duckdb.sql(entry.oracle_sql()["restated_rows"].replace("FROM documents", f"FROM '{SF}/documents.parquet'")).fetchall()) and len(got) > 100
