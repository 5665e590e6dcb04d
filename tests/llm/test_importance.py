import hashlib
import math
import random
import re
import zlib

import pytest

from telltale.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, goal, n, buckets=10_000, least=20, share=10):
    def features(text):
        found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return len(found), [zlib.crc32(" ".join(found[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(found) - k + 1)]

    told = [(key, *features(text)) for key, text in rows]
    s, t = [0] * buckets, [0] * buckets
    for _, _, found in told:
        for b in found:
            s[b] += 1
    for text in goal:
        for b in features(text)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for key, words, found in told:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = None if key is None else int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
        score = None if key is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, words, len(found), weight, score, None])
    among = sorted((x for x in out if x[1] >= least and x[4] is not None), key=lambda x: (-x[4], x[0]))
    for i, x in enumerate(among[: len(among) * share // 100]):
        x[5] = i + 1
    return sorted(map(tuple, out), key=str)


def texts(n=600):
    rng = random.Random(7)
    vocabulary = ["The", "étude", "don't", "x1", "Ünder", "日本", "foo_bar", "a-b", "ZEBRA", *[f"w{i}" for i in range(80)]]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 3])
def test_like_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(importance, "LONG", 300)
    monkeypatch.setattr(importance, "OWNED", 7)
    rows = [*enumerate(texts()), (700, None), (701, ""), (702, " .,! "), (703, "?" * 400), (704, "w1 " * 5000), (705, "é" * 1000), (705, "é" * 1000), (None, "the " * 200), (3, "again " * 30), (3, "again " * 30)]
    goal = [*texts(50)[10:], None, ""]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_words int, rank string").repartition(5)
    target = spark.createDataFrame([(t, 1) for t in goal], "text string, doc_id int")
    got = importance.resample(df, target, n=n).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, goal, n)


def test_ties_and_empty(spark):
    rows = [(i, "one two three " * 10) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = df.limit(0)
    got = sorted(map(tuple, importance.resample(df.union(df), target, share=50).collect()), key=str)
    assert got == brute([*rows, *rows], [], 1, share=50)
    none = importance.resample(df.limit(0), df)
    assert none.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and none.count() == 0


def test_sql(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([*enumerate(texts(300)), (900, None)], "doc_id long, text string")
    goal = spark.createDataFrame([(t,) for t in texts(20)], "text string")
    con = duckdb.connect()
    documents, benchmark = df.toPandas(), goal.toPandas()
    con.register("documents", documents)
    con.register("benchmark", benchmark)
    want = con.sql(importance.SQL).fetchall()
    got = importance.resample(df, goal).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(want, key=lambda x: x[0])
