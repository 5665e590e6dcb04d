import pytest
from pyspark.sql import functions as F

from telltale.functions import code_lexer as L
from telltale.functions import code_parts as C
from telltale.operators.code import FIELDS, score_code
from telltale.operators.restated_rows import echoing_docstrings, redundant_comments


def test_extensions():
    assert len(L.extensions()) == 76 and len(L.FAMILIES) == 15 and L.extensions()[".el"] == ("lisp", "Emacs Lisp")


@pytest.mark.parametrize(
    "family, text, comments, strings",
    [
        ("c", 'a = "http://x"; // note\n/* two\nlines */', [(1, "note"), (2, "two\nlines")], [(1, "http://x")]),
        ("c", "x = `a ${b + `//c`} d`; // e", [(1, "e")], [(1, "a ${b + `//c`} d")]),
        ("c", "it's // fine", [(1, "fine")], []),
        ("rust", "/* a /* b */ c */ let x: &'a str;", [(1, "a /* b */ c")], []),
        ("rust", "/* a /* b */ open", [(1, "a /* b */ open")], []),
        ("html", "<!-- a --><p title='# b'>", [(1, "a")], [(1, "# b")]),
        ("html", "<!-- open\nto the end", [(1, "open\nto the end")], []),
        ("lua", "--[[ a ]] x -- b", [(1, "a"), (1, "b")], []),
        ("shell", "echo $# ${#x} # real\ncat <<EOF\n# not\nEOF\n# after", [(1, "real"), (5, "after")], [(3, "# not\n")]),
        ("shell", "y=$(( 1 << K ))\n# c", [(2, "c")], []),
        ("php", "$a = <<<HTML\n// no\n  HTML;\n# c", [(4, "c")], [(2, "// no\n")]),
        ("hash", 'x = "a\\"b" # c', [(1, "c")], [(1, 'a\\"b')]),
    ],
)
def test_lexer(family, text, comments, strings):
    parts, code = L.lex(text, family)
    of = lambda kind: [(line, x) for k, line, _, _, x in parts if k == kind]
    assert (of("comment"), of("string")) == (comments, strings)
    assert len(code) == len(text) and code.count("\n") == text.count("\n")


def test_docstrings_and_body_comments():
    text = '"""Top."""\ndef get_user_name(x):\n    """Get the user name."""\n    # Create it\n    y = """text"""\n    d = {"a":\n"""no"""}\n'
    parts, _ = L.lex(text, "hash")
    assert [(line, x) for k, line, _, _, x in parts if k == "docstring"] == [(1, "Top."), (3, "Get the user name.")]
    assert [x for k, *_, x in parts if k == "string"] == ["text", "a", "no"] and [(line, x) for _, line, _, alone, x in parts if alone] == [(4, "Create it")]


#: Files, what they restate in comments, and in docstrings.
RESTATED = [
    ("# increment the user counter\nuser_counter += 1\n# TODO: user counter value\nuser_counter = 2\n", [(1, "increment the user counter")], []),
    ("x = 1\n\n# the total price\n\n\ntotalPrice = 3\n", [(3, "the total price")], []),
    ("# total price\ntotalPrice = 3\n", [], []),
    ("# sum up the total price\n\n\ntotalPrice = sum(x)\n", [(1, "sum up the total price")], []),
    ("# sum up the total price\n\n\n\ntotalPrice = sum(x)\n", [], []),
    ("# configuration of parsers\nconf, parser = 1, 2\n", [(1, "configuration of parsers")], []),
    ("# map of idx values\nid = 1\n# total = price of item\ntotal_price_item = 1\n# step 2 total price\ntotal_price = 1\n# total price now;\ntotal_price = 1\n", [], []),
    ("a = 1\nb = 2  # user name here\nuser_name = 3\nhere = 4\n", [(2, "user name here")] , []),
    ('"""Top."""\ndef get_user_name(x):\n    """Get the user name."""\ndef f(x):\n\n    """F of user."""\ndef load(\n  a):\n    """Load."""\n', [], [(3, "Get the user name.")]),
]


def test_restated(spark):
    df = spark.createDataFrame([(i, t, ".py") for i, (t, _, _) in enumerate(RESTATED)], "id long, text string, ext string")
    for r in score_code(df).collect():
        assert [tuple(x) for x in r.redundant_comments] == RESTATED[r.id][1], r.id
        assert [tuple(x) for x in r.docstring_name_echoes] == RESTATED[r.id][2], r.id


def test_restated_in_rows(spark):
    """Joins of rows find what columns find, in files of the same key too long for one array as well."""
    files = [*enumerate(t for t, _, _ in RESTATED), (100, "x = 1\n" * 3000 + RESTATED[0][0])]
    rows = C.source_rows(spark.createDataFrame([(i, t, ".py", "x", 1) for i, t in files], "id long, text string, ext string, kind string, line int"), "id")
    want = {(i, *x) for i, (_, r, _) in enumerate(RESTATED) for x in r} | {(100, line + 3000, x) for line, x in RESTATED[0][1]}
    assert {tuple(r) for r in redundant_comments(rows, "id").collect()} == want
    assert {tuple(r) for r in echoing_docstrings(rows, "id").collect()} == {(i, *x) for i, (_, _, e) in enumerate(RESTATED) for x in e}
    assert redundant_comments(rows.limit(0), "id").count() == echoing_docstrings(rows.limit(0), "id").count() == 0


def test_table_function(spark):
    C.register(spark)
    spark.createDataFrame([(1, "x = 'a' # b\n\n# c\n", "hash"), (2, None, "hash")], "id long, text string, family string").createOrReplaceTempView("files")
    rows = spark.sql("SELECT f.id, p.kind, p.line, p.text FROM files f, LATERAL lex_source(f.text, f.family) p ORDER BY p.nth").collect()
    assert [tuple(r) for r in rows] == [(1, "string", 1, "a"), (1, "comment", 1, "b"), (1, "comment", 3, "c"), (1, "code", 1, "x =        ")]


def test_sniffing(spark):
    cases = {"#!/usr/bin/env bash\n// x": "shell", "// a\nx": "c", "-- a\n-- b": "dash", "x": "hash", "#include <a>\n  // b": "c", " # a\n\t# b\n// c": "hash", "": "hash", "/* a\n-- b": "c"}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", C.sniffed(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == cases


def test_measures(spark):
    text = "".join(f"def f{i}(data):\n    # Load the item {i}.\n    # NOTE\n    result = data + {'x' * i}\n" for i in range(12)) + "# ==== part ====\n# the end\n"
    row = score_code(spark.createDataFrame([(text, ".py"), (None, ".py")], "text string, ext string")).where("lines > 1").first()
    widths = [len(x.split("#")[0].rstrip(" ")) if "#" not in x else 0 for x in text.split("\n")]
    widths = [w for w in widths if w]
    mean = sum(widths) / len(widths)
    assert row.comment_sentence_share == round(12 / 13, 2) and row.docstring_coverage == 0.0 and row.banner_comments == 1
    assert row.line_length_cv is None and row.sloc == 24 and row.comment_lines == 26 and row.narration_comment_count == 12 and mean > 0
    assert row.generic_identifier_share == round(36 / (12 * 6 - 1), 3)  # keywords are names too


def test_scores(spark):
    rows = [
        (1, "x = 1\n" * 50, ".py"),
        (2, "# As an AI language model, I cannot\nx = 1\n", ".py"),
        (3, "x = 'a\u200bb'\n", ".py"),
        (4, "x = 1 \u200b\n", ".py"),
        (5, "try:\n    f()\nexcept Exception as e:\n    print('An error occurred')\n", ".py"),
        (6, None, None),
        (7, "# Step 1: load\n# Step 2: save\nx\n", ".py"),
    ]
    got = {r.id: r for r in score_code(spark.createDataFrame(rows, "id long, text string, ext string")).collect()}
    assert len(FIELDS) == 33
    assert [got[i].score_per_100 for i in (1, 3, 6, 7)] == [0.0] * 4
    assert got[2].ai_artifacts == 2 and got[2].score_per_100 >= 25
    assert got[4].invisible_chars == 1 and got[4].score_per_100 >= 25
    assert (list(got[5].error_boilerplate), list(got[5].swallowed_errors), got[5].score_per_100) == ([4], [3], 12.5)
