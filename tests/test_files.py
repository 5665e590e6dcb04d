import json

import pytest

from telltale.__main__ import main
from telltale.operators import code, evaluate, files, findings, highlight
from telltale.sources import readers
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("files")
    (place / "b.md").write_text("We delve into it.\n\n```\nWe delve into code\n```\n", encoding="utf-8")
    (place / "a.py").write_text("# As an AI language model, I cannot\n# TODO — fix\nuser_counter = 1  # user counter value\n", encoding="utf-8")
    (place / "c.txt").write_text("plain words about a quiet day", encoding="utf-8")
    return place


def test_mixed_files(spark, folder):
    given = readers.read_texts(spark, f"{folder}/*")
    by = {r.path.rsplit("/", 1)[1]: r for r in files.score_files(given, lang="en").collect()}
    assert (by["a.py"]["mode"], by["b.md"]["mode"], by["c.txt"]["score"]) == ("code", "prose", 0.0)
    assert by["b.md"].score == 750.0 and json.loads(by["b.md"].record)["buzzwords"] == [{"key": "delve into", "n": 1}]
    assert by["a.py"].score >= 25 and len(json.loads(by["a.py"].record)) == len(code.FIELDS) + 1
    assert {r["mode"] for r in given.select(files.mode_of(F.col("ext"), "prose").alias("mode")).collect()} == {"prose"}
    assert files.score_files(given.limit(0), lang="en").count() == 0
    with pytest.raises(ValueError):
        files.score_files(given, mode="other")


def test_diagnostics_of_mixed_files(spark, folder):
    given = readers.read_texts(spark, f"{folder}/*")
    told = [json.loads(r.value) for r in files.file_diagnostics(given, lang="en").collect()]
    seen = {(d["location"]["path"].rsplit("/", 1)[1], d["location"]["range"]["start"]["line"], d["severity"], d["message"]) for d in told}
    assert ("b.md", 1, "WARNING", "buzzword: delve into") in seen and ("a.py", 1, "ERROR", "chat residue: as an ai language model") in seen
    assert ("a.py", 2, "WARNING", "typography of chats in a comment: em dash") in seen and ("a.py", 3, "WARNING", "comment that restates the code: user counter value") in seen
    assert findings.parse_diagnostics(files.file_diagnostics(given, lang="en")).count() == len(told)


def test_command(spark, folder, capsys):
    assert main([f"{folder}/c.txt", "--no-config", "--lang", "en"], spark) == 0
    assert "Nothing flagged." in capsys.readouterr().out
    assert main([f"{folder}/*", "--quiet", "--no-config", "--lang", "en"], spark) == 1
    lines = capsys.readouterr().out.strip().split("\n")
    assert len(lines) == 3 and "/100 lines" in lines[0] and "/1k" in lines[1]
    assert main([f"{folder}/c.txt", "--json", "--no-config", "--lang", "en"], spark) == 0
    assert json.loads(capsys.readouterr().out)["words"] == 5
    assert main([f"{folder}/*", "--json", "--no-config", "--lang", "en", "--threshold", "1e9"], spark) == 0
    assert [r["mode"] for r in json.loads(capsys.readouterr().out)] == ["code", "prose", "prose"]
    assert main([f"{folder}/*.none", "--no-config", "--lang", "en"], spark) == 2 and main([f"{folder}/none", "--no-config", "--lang", "en"], spark) == 2
    assert main([f"{folder}/c.txt", "--config", f"{folder}/none"], spark) == 2
    assert main([f"{folder}/a.py", "--no-config", "--lang", "en"], spark) == 1
    out = capsys.readouterr().out
    assert "chat residue: as an ai language model (lines 1)" in out and "language: Python" in out


def test_marks(spark):
    text = "We delve into it — ✅ not just one but two.\n• item\n- **Term:** x as an ai oaicite"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "plain", "x")], "id long, text string, marks string")
    got = {r.id: [(text[m.start : m.end], m.category, m.key) for m in r.marks] for r in highlight.with_marks(df, lang="en").collect()}
    assert got[1] == [("delve into", "buzzword", "delve into"), ("—", "emdash", "—"), ("✅", "emoji", "✅"), ("not just one but", "construction", got[1][3][2]), ("•", "bare-bullet", "•"), ("- **Term:**", "bold-bullet", "**Term:**"), ("as an ai oaicite", "artifact", "as an ai oaicite")]
    assert got[2] == got[3] == []


def test_overlapping_marks(spark):
    kind = "array<struct<start:int,rank:int,length:int,key:string>>"
    df = spark.createDataFrame([([(0, 3, 10, "a"), (4, 0, 3, "b"), (8, 1, 6, "c"), (8, 0, 3, "d"), (20, 7, 1, "e")],)], f"m {kind}")
    marks = df.select(highlight.resolved(F.col("m")).alias("x")).first().x
    assert [(m.start, m.end, m.key) for m in marks] == [(0, 10, "a"), (10, 11, "d"), (11, 14, "c"), (20, 21, "e")]


def test_evaluation_of_folders(spark, folder, tmp_path):
    people = tmp_path / "people"
    people.mkdir()
    (people / "d.txt").write_text("we met at noon and had tea", encoding="utf-8")
    told = readers.read_labelled(spark, {"machine": str(folder), "person": str(people)}).where("ext = '.txt' OR ext = '.md'")
    scored = files.score_files(told, lang="en").join(told.select("path", (F.col("label") == "machine").cast("int").alias("y")), "path").withColumn("n", F.lit(3))
    summary = evaluate.failures(evaluate.summary(scored, "score", "y"), evaluate.PROSE_FLOORS)
    assert "AUC: 0.7500" in evaluate.summary_lines(summary).first().value and evaluate.check_status(summary).first()[0] == 1
    lines = {(r.label, r.position): r.value for r in evaluate.score_table(scored, F.lit("x"), "score", "y", "n", "mode").collect()}
    assert lines["positive", 1].startswith("   750.0  x") and len(lines) == 3
