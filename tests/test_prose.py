"""Expected values are worked out by hand from the definitions."""

import pytest
from pyspark.sql import functions as F

from telltale.functions.features import without_code
from telltale.operators import evaluate, findings
from telltale.operators.prose import FIELDS, score_prose
from telltale.sources import readers

CASES = {
    "empty": ("", {"words": 1, "score_per_1k": 0.0, "language_source": "fallback"}),
    "null": (None, {"words": 1, "score_per_1k": 0.0, "punct_entropy": None}),
    "one buzzword of ten words": ("We delve into things that are here for all people", {"words": 10, "score_per_1k": 300.0, "buzzwords": [("delve into", 1)]}),
    "longer phrase wins": ("It stands as a testament to them", {"phrases": [("stands as a testament", 1)], "copula_avoidance": []}),
    "wrapped phrase": ("it's important to\nnote", {"phrases": [("it's important to note", 1)]}),
    "curly apostrophe": ("it’s important to note", {"phrases": [("it's important to note", 1)]}),
    "word boundary": ("deep divers have aides", {"buzzwords": [], "ai_artifacts": 0}),
    "artifact at the start": ("oaicite", {"ai_artifacts": 1, "score_per_1k": 10000.0}),
    "artifacts merge": ("see oaicite oai_citation here", {"ai_artifacts": 1}),
    "artifacts apart": ("see oaicite and oai_citation here", {"ai_artifacts": 2}),
    "artifact floor": ("oaicite " + "plain words here " * 400, {"ai_artifacts": 1, "score_per_1k": 25.0, "verdict": "reads as AI - needs a real rewrite"}),
    "not an artifact": ("it was an air leak", {"ai_artifacts": 0}),
    "free hit": ("It fell, highlighting the end.", {"score_per_1k": 0.0}),
    "case-sensitive": ("Not just this but that", {"patterns": []}),
    "one copula": ("It serves as a bridge.", {"copula_avoidance_scored": False}),
    "two copulas": ("It serves as a bridge. It acts as a testament.", {"copula_avoidance_scored": True}),
    "one generic heading": ("# Conclusion\n\ntext", {"generic_headings": 1, "score_per_1k": 0.0}),
    "two generic headings": ("# Introduction\n## **Key takeaways:**\ntext", {"generic_headings": 2}),
    "heading skip": ("## a\n#### b\n# c\n## d", {"heading_level_skips": 1}),
    "bare bullets": ("• a\n ▪ b\n‣ c", {"bare_bullets": 3}),
    "emoji": ("✅ ❤️ 🇫🇷 ✓ →", {"emoji": 3, "header_emoji": 0}),
    "heading emoji": ("# 🚀 go\n- ✅ x\n12. ✨", {"emoji": 3, "header_emoji": 3}),
    "em dashes": ("a — b — c — d", {"em_dashes": 3, "em_dash_excess": 1}),
    "bold labels": ("**a:** x\n- **b**: y\n1. **c.** z", {"bold_label_bullets": 3}),
    "quote mix": ("‘a’ ‘b' c' d'", {"quote_mix": 1}),
    "cross-kind quotes": ("‘a’ ‘b’ \"c\" \"d\"", {"quote_mix": 0}),
    "few marks": ("a, b.", {"punct_entropy": None, "punct_entropy_low": False}),
    "one mark": ("a, " * 30, {"punct_entropy": 0.0, "punct_entropy_low": True}),
    "even sentences": ("One two three. " * 5, {"sentence_uniformity_cv": 0.0, "staccato_runs": 1}),
    "openers": ("The a b c d e f. " * 8, {"opener_top_share": 1.0}),
    "paragraph openers": ("\n\n".join(["We met at noon today and talked."] * 5), {"paragraph_opener_repeat": 5, "paragraph_opener_repeat_text": "we met at noon today", "paragraph_uniformity_cv": 0.0}),
    "hooks": ("It works. Why not? It does. The end? Yes.", {"question_hooks": 2, "question_hook_excess": 1}),
    "windows": ("word " * 199, {"windowed_ttr": None}),
    "one window": ("same " * 250, {"windowed_ttr": 0.005}),
    "German": ("Der Hund und die Katze sind nicht da, das ist es, und wir haben ein Haus mit dem Garten", {"language": "de", "language_source": "detected"}),
}


@pytest.fixture(scope="module")
def records(spark):
    df = spark.createDataFrame([(k, t, "x") for k, (t, _) in CASES.items()], "name string, text string, words string")
    return {r.name: r for r in score_prose(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_record(records, name):
    row = records[name]
    for field, want in CASES[name][1].items():
        got = row[field]
        if isinstance(got, list):
            got = [tuple(x) for x in got]
        assert got == want, field


def test_schema_and_unknown_language(spark):
    assert len(FIELDS) == 40
    with pytest.raises(ValueError):
        score_prose(spark.createDataFrame([("a",)], "text string"), lang="xx")
    assert score_prose(spark.createDataFrame([], "text string")).count() == 0


def test_long_blank_text(spark):
    assert score_prose(spark.createDataFrame([("\n" * 20000 + "end",)], "text string")).first().words == 1


def test_findings_and_reports(spark):
    df = spark.createDataFrame([(1, "a\nWe delve in.\n\nIt's important to\nnote it may delve"), (2, "plain")], "id long, text string")
    rows = findings.findings(df, "id", lang="en")
    table = {(r.category, r.key_text): (r.n, list(r.lines)) for r in findings.finding_table(rows, "id").collect()}
    assert table == {("buzzword", "delve"): (2, [2, 5]), ("phrase", "it's important to note"): (1, [4]), ("pattern", "hedge"): (1, [5])}
    told = findings.parse_diagnostics(findings.diagnostics(rows, "id")).collect()
    assert sorted(r.type for r in told) == ["I", "W", "W", "W"]
    assert findings.parse_diagnostics(spark.createDataFrame([("{bad",)], "value string")).count() == 0
    scored = score_prose(df, lang="en")
    reports = {r.id: r.report for r in findings.report(scored, rows, "id").collect()}
    assert "2x  buzzword: delve (lines 2, 5)" in reports[1] and reports[2].endswith("Nothing flagged.")
    assert findings.exit_status(scored).first()[0] == 1


def test_markdown(spark):
    text = "a `x y` b\n```py\ndelve\n```\nafter\n~~~\nopen"
    got = spark.createDataFrame([(text,)], "text string").select(without_code(F.col("text"))).first()[0]
    assert got == "a " + " " * 5 + " b\n\n\n\nafter\n\n"


def test_config_and_ignored_files(spark, tmp_path):
    config = readers.load_config('{"ignore_words": ["Delve"], "extra_words": ["gizmo"], "extra_patterns": [{"regex": "zz+"}], "other": 1}')
    readers.check_patterns(spark, config)
    row = score_prose(spark.createDataFrame([("delve gizmo zzz",)], "text string"), lang="en", config=config).first()
    assert [tuple(x) for x in row.buzzwords] == [("gizmo", 1)] and row.patterns[0].name == "zz+"
    for bad in ("[]", '{"extra_words": "a"}', '{"extra_patterns": [{}]}'):
        with pytest.raises(ValueError):
            readers.load_config(bad)
    (tmp_path / "a.md").write_bytes("\ufeff`delve` é".encode() + b"\xff")
    (tmp_path / "skip.txt").write_text("x")
    found = readers.read_texts(spark, f"file://{tmp_path}/*", ignore=readers.ignore_lines("# no\nskip*\n")).collect()
    assert [(r.text, r.ext) for r in found] == [("        é\ufffd", ".md")]
    (tmp_path / ".telltale.json").write_text("{}")
    assert readers.find_config(str(tmp_path)) == str(tmp_path / ".telltale.json")


def test_area_and_summary(spark):
    df = spark.createDataFrame([(30.0, 1), (12.0, 1), (5.0, 0), (12.0, 0), (0.0, 0)], "s double, y int")
    assert evaluate.auc(df, "s", "y").first().auc == round(5.5 / 6, 6)
    row = evaluate.failures(evaluate.summary(df, "s", "y"), evaluate.PROSE_FLOORS).first()
    assert (row.detection_10, row.detection_25, row.max_negative) == (1.0, 0.5, 12.0)
    assert row.floor_failures == ["auc", "false_positive_10"]
