import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from telltale.llm import language_id, quality

from .test_near_dedup import brute_classes
from .test_passages import without_repeats

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    common = line(40)
    rows = [(i, "\n".join([common, line(60), line(30)]), "en", "a", 0) for i in range(130)]
    rows += [(200 + i, common + "\n" + line(20), "en", "a", 0) for i in range(5)]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, " \n\t", "en", "a", 0), (303, "x y z " * 40, "en", "b", 0), (304, "12 34 " * 60, "en", "b", 0)]
    return rows + [(305 + i, rows[3][1], "en", "b", 0) for i in range(3)]


def test_quality_matches_sql(spark):
    rows = odd_documents()
    df = spark.createDataFrame(rows, COLUMNS)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    want = con.sql(quality.SQL)
    got = quality.verdicts(df).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert kept[0] and not kept[200] and not kept[301] and not kept[303]
    cleaned = {r.doc_id: r.text for r in quality.clean(df).collect()}
    assert cleaned[0] == "\n".join(rows[0][1].split("\n")[1:]) and 200 not in cleaned and set(cleaned) == {k for k, v in kept.items() if v}


def test_quality_of_odd_tables(spark):
    assert quality.verdicts(spark.createDataFrame([], COLUMNS)).count() == 0
    twice = spark.createDataFrame([(1, "a b c", "en", "s", 0)] * 2 + [(None, "a b", None, None, 0)], COLUMNS)
    assert sorted((str(r.doc_id), r.n_words) for r in quality.verdicts(twice).collect()) == [("1", 3), ("1", 3), ("None", 2)]


def test_pages_that_are_mostly_template_count_apart(spark):
    rng = random.Random(9)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    template = [line(8) for _ in range(50)]
    rows = [(i, "\n".join([*template, line(30)]), "en", "a", 0) for i in range(200)]
    rows += [(1000 + i, "\n".join([line(60)] * 2), "en", "b", 0) for i in range(2)]
    rows += [(2000 + i, rows[0][1], "en", "c", 0) for i in range(200)]
    rows += [(3000 + i, "\n".join([*template[:20], line(30), line(200)]), "en", "d", 0) for i in range(400)]
    got = {r.doc_id: (r.n_words, r.n_line_words, r.kept) for r in quality.verdicts(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert all(got[i] == (430, 400, False) for i in range(200))
    assert all(got[i][1] == 0 for i in got if 1000 <= i < 3000)
    assert all(got[i] == (390, 160, True) for i in got if i >= 3000)


def test_quality_joins_by_host_where_lines_are_many(spark, monkeypatch):
    df = spark.createDataFrame(odd_documents(), COLUMNS)
    want = sorted(map(str, quality.clean(df).collect()))
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    assert sorted(map(str, quality.clean(df).collect())) == want


def test_quality_with_clashing_names(spark):
    names = ["removed_lines", "kept", "_row", "_host", "_text", "_lines", "n_words", "_keys"]
    df = spark.createDataFrame(odd_documents(), COLUMNS).withColumns({n: F.lit(i) for i, n in enumerate(names)})
    rows = quality.clean(df).collect()
    assert rows and all([r[n] for n in names] == list(range(len(names))) for r in rows)
    assert quality.verdicts(df).count() == df.count()


def test_clean_tells_rows_of_one_key_apart(spark):
    good = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(3)]
    rows = [(None, good[0], "en", "a", 0), (None, "short", "en", "a", 0), (None, None, "en", "a", 0), (7, good[1], "en", "a", 0), (7, "few words", "en", "a", 0), (8, good[2], "en", None, 0), (8, good[2], "en", None, 0)]
    got = [(r.doc_id, r.text) for r in quality.clean(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert sorted(got, key=str) == sorted([(None, good[0]), (7, good[1]), (8, good[2]), (8, good[2])], key=str)


def test_repeated_words():
    def brute(ws):
        n = len(ws) - 2
        again = [i for i in range(n) if sum(ws[i : i + 3] == ws[j : j + 3] for j in range(n)) > 1]
        return len({i + k for i in again for k in range(3)})

    rng = random.Random(1)
    for _ in range(200):
        ws = [rng.choice("abc") for _ in range(rng.randrange(0, 30))]
        assert quality.repeated_words(ws) == brute(ws)


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language_id.identify(docs, language_id.train(docs)).where(language_id.held_out("doc_id"))
    row = told.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert row[0] >= 0.98 and row[1] > 150


def test_every_labelled_language_can_be_told(spark):
    rng = random.Random(5)
    stems = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(8)] for i in range(30)}
    rows = [(i, " ".join(rng.choice(ws) for _ in range(12)), y) for i, (y, ws) in enumerate([x for x in stems.items() for _ in range(12)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.train(df)).where(language_id.held_out("doc_id")).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got) and len({r.lang_pred for r in got}) > 20


def test_languages_of_odd_rows(spark):
    rows = [(i, t, y) for i, (t, y) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("xx yy zz", "tlh"), (None, "en"), ("²³ Ⅷ", "fr"), ("the dog", None)] * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "_told": F.lit(5), "_row": F.lit(6)})
    got = {r.doc_id: r for r in language_id.identify(df, language_id.train(df)).collect()}
    assert all(got[i].lang_pred == ("und" if rows[i][1] in (None, "²³ Ⅷ") else rows[i][2] or "en") and 0 <= got[i].score <= 1 and (got[i]._told, got[i]._row) == (5, 6) for i in got)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.train(none) is None and language_id.identify(none, None).count() == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{tmp_path_factory.mktemp('stage')}/{i}"
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_match_brute_force(spark, stages):
    texts = [({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()} if "text" in after.columns else None) for before, after in stages]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert set(texts[0][1]) == {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    assert set(texts[1][1]) <= set(texts[1][0]) and len(texts[1][1]) >= 0.99 * len(texts[1][0])
    assert set(texts[2][1]) == set(brute_classes(texts[2][0]).values())
    assert texts[3][1] == without_repeats(texts[3][0], 50)
    for before, after in stages[:-1]:
        assert before.columns == after.columns
    assert {r.doc_id for r in stages[-1][1].select("doc_id").distinct().collect()} == set(texts[3][1])


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()


def test_pipeline_of_odd_documents(spark):
    docs = spark.createDataFrame(odd_documents(), COLUMNS)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert i == 4 or out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() > 0


def test_language_stage_without_labels(spark):
    rows = [(1, "the cat and the dog", None, "a", 0), (2, "été", None, "a", 0), (3, "12 !", None, "a", 0), (4, None, None, "a", 0), (5, "", None, "a", 0)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, COLUMNS), SF)
    assert sorted(tuple(r) for r in out.collect()) == rows[:2]
