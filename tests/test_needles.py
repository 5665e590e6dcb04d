"""The theta join, the sweep and the line index against plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from telltale.functions import features as X
from telltale.functions.lexicon import packs
from telltale.functions.places import LineIndex, lines_of
from telltale.operators import needles, spans

NEEDLES = [(1, "Delve into"), (2, "delve"), (3, "into the"), (4, "the"), (5, "it's"), (5, "don’t"), (6, "!?"), (7, "é"), (8, None), (9, " "), (10, "delve"), (11, "a a"), (12, "#1")]


def texts():
    rng = random.Random(2)
    parts = ["delve", "into", "the", "THE", "it’s", "é", "éa", "a", "!?", "#1", "x_the", "\n", " ", "  ", "\t\n ", "日本", "😀", ".", "delve into the"]
    out = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\r\n"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    return [*out, "", None, "a a a a", "delve " * 3000]


def plain(text):
    text = re.sub("\r\n?|[\x1c-\x1f\x85  ]", "\n", text or "").lower().replace("’", "'")
    for i, needle in NEEDLES:
        words = (needle or "").lower().replace("’", "'").split()
        if words:
            rx = re.compile(r"(?<!\w)" + r"\s+".join(map(re.escape, words)) + r"(?!\w)")
            for at in range(len(text)):
                if m := rx.match(text, at):
                    yield i, at, m.end(), 1 + text.count("\n", 0, at)


@pytest.mark.parametrize("most", [100, 0])
def test_hits(spark, most):
    rows = [*enumerate(texts()), (None, "the"), (3, "the end"), (3, "the end")]
    df = spark.createDataFrame([(k, t, 0, "x") for k, t in rows], "doc_id long, text string, start int, needle_id string").repartition(3)
    lexicon = spark.createDataFrame(NEEDLES, "needle_id int, needle string")
    got = needles.needle_hits(df, lexicon.union(lexicon), most=most)
    want = [(k, *hit) for k, t in rows for hit in sorted(set(plain(t)))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) > 1000
    assert needles.needle_hits(df.limit(0), lexicon, most=most).count() == 0
    assert needles.needle_hits(df, lexicon.limit(0), most=most).count() == 0


def test_configured(spark):
    table = lambda words: spark.createDataFrame([(w,) for w in words], "needle string")
    got = needles.configured(table(["delve", "robust", "key  point"]), table(["DELVE", None, "gizmo"]), table(["Gizmo", "Widget", "widget", "", "ROBUST"]))
    assert sorted(r.needle for r in got.collect()) == ["key point", "robust", "widget"]


def greedy(rows):
    past, out = 0, []
    for start, end, name in sorted(rows, key=lambda r: (r[0], -r[1], r[2])):
        if start < end and start >= past:
            out.append((start, end, name))
            past = end
    return out


def test_sweep(spark):
    rng = random.Random(4)
    made = {k: [(a, a + rng.randrange(0, 9), rng.choice("xyz")) for a in (rng.randrange(60) for _ in range(rng.randrange(30)))] for k in [None, *range(30)]}
    df = spark.createDataFrame([(k, "p", *r, "kept") for k, rows in made.items() for r in rows] + [(1, "p", None, 4, "x", "kept")], "doc long, pack string, start int, end int, name string, _row string").repartition(4)
    got = spans.swept(df, ["doc", "pack"], first=["name"])
    assert got.columns == df.columns
    assert sorted((str(r.doc), r.start, r.end, r.name) for r in got.collect()) == sorted((str(k), *r) for k, rows in made.items() for r in greedy(rows))
    cut = sorted((str(r.doc), r.start, r.end) for r in spans.trimmed(df, ["doc"]).collect())
    covered = {(str(k), i) for k, rows in made.items() for a, b, _ in rows for i in range(a, b)}
    assert sorted((k, i) for k, a, b in cut for i in range(a, b)) == sorted(covered)
    assert spans.swept(df.limit(0), ["doc"]).count() == 0


def test_sweep_is_the_alternation(spark):
    """Hits of all packs' lists, swept, are what each pack's one expression finds."""
    sample = [w for p in packs().values() for w in [*p.buzzwords[::5], *p.phrases[::5], *p.copula_avoidance]]
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(sample) + rng.choice(["", ",", "\n", "s"]) for _ in range(60))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    listed = [(p.code, w) for p in packs().values() for w in dict.fromkeys(w for _, ws in X.pool(p) for w in ws)]
    lexicon = spark.createDataFrame([(i, *x) for i, x in enumerate(listed)], "needle_id int, pack string, needle string")
    found = needles.needle_hits(df, lexicon).join(lexicon, "needle_id")
    got = {tuple(r) for r in spans.swept(found, ["doc_id", "pack"]).groupBy("doc_id", "pack", "needle").count().collect()}
    low = df.withColumn("_l", X.lowered(X.normalised(F.col("text"))))
    want = set()
    for p in packs().values():
        keys = low.select("doc_id", F.explode(F.transform(X.found(F.col("_l"), X.pool_pattern(p)), X.key_of)).alias("key"))
        want |= {(r.doc_id, p.code, r.key, r["count"]) for r in keys.groupBy("doc_id", "key").count().collect()}
    assert got == want and len(want) > 500


def test_lines(spark):
    text = "ab\n\n😀c\nd"
    assert LineIndex(text).lines([0, 2, 3, 4, 5, 6, 7]).tolist() == [1, 1, 2, 3, 3, 3, 4]
    df = spark.createDataFrame([(text, [0, 4, 7]), (None, [1]), ("", [])], "t string, p array<int>")
    assert [r[0] for r in df.select(lines_of(F.col("t"), F.col("p"))).collect()] == [[1, 3, 4], None, []]


def test_many_hits_are_located_in_time(spark):
    text = "delve into it\n" * 100_000
    df = spark.createDataFrame([(text,)], "t string")
    located = lambda n: df.select(F.element_at(X.located(F.col("t"), "delve"), n).alias("x")).first().x
    located(1)
    began = time.time()
    assert (located(100_000).line, located(100_000).hit) == (100_000, "delve")
    assert time.time() - began < 6
