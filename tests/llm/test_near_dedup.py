import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from telltale.llm import near_dedup as N


def naive(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_distance_equals_the_full_table(seed):
    rng = random.Random(seed)
    for _ in range(60):
        a = [rng.randrange(6) for _ in range(rng.randrange(1, 50))]
        b = [x for x in a if rng.random() > 0.2] if rng.random() < 0.7 else [rng.randrange(6) for _ in range(rng.randrange(1, 50))]
        for _ in range(rng.randrange(6)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(6))
        want = naive(a, b)
        for limit in (0, 3, 5, 8, 20, 60):
            assert N.distance(np.array(a, np.uint64), np.array(b, np.uint64), limit) == (want if want <= limit else None)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def edits(a, b):
    """The whole table of edit distances, a row at a time."""
    number = {g: i for i, g in enumerate({*a, *b})}
    a, b = [number[g] for g in a], np.array([number[g] for g in b])
    at = np.arange(len(b) + 1)
    row = at
    for i, x in enumerate(a, 1):
        new = np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (b != x))))
        row = np.minimum.accumulate(new - at) + at
    return int(row[-1])


def brute_links(docs, similarity=0.85):
    """All pairs of texts that differ in at most 15 % of their words."""
    found = {k: words_of(t) for k, t in docs.items()}
    bags = {k: Counter(ws) for k, ws in found.items()}
    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = found[a], found[b]
            longer = max(len(x), len(y))
            most = int((1 - similarity) * longer + 1e-9)
            if x and y and most >= longer - (bags[a] & bags[b]).total() and edits(x, y) <= most:
                yield b, a


def brute_classes(docs, similarity=0.85):
    parent = {k: k for k in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for b, a in brute_links(docs, similarity):
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in docs}


def test_recall_within_the_promised_similarity(spark):
    rng = random.Random(11)
    new = lambda: f"w{rng.randrange(10**6)}"
    docs, group, k = {}, {}, 0
    for n in (7, 10, 14, 20, 30, 45, 60, 120, 200, 400):
        for rate in (0.05, 0.1, 0.15):
            for _ in range(30):
                base = [new() for _ in range(n)]
                other = list(base)
                for at in rng.sample(range(n), int(rate * n)):
                    other[at] = rng.choice([new(), new(), f"{other[at]} {new()}" if rate < 0.15 else new(), ""])
                docs[k], docs[k + 1] = " ".join(base), " ".join(other)
                group[k] = (n >= 50, rate)
                k += 2
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r[0]: r[1] for r in N.near_duplicates(df).select("doc_id", "class_id").collect()}
    found = {g: [] for g in group.values()}
    for a, g in group.items():
        if list(brute_links({a: docs[a], a + 1: docs[a + 1]})):
            found[g].append(got[a] == got[a + 1])
        else:
            assert got[a] != got[a + 1]
    recall = {g: sum(x) / len(x) for g, x in found.items()}
    assert min(map(len, found.values())) > 90 and min(recall.values()) >= 0.9, recall
    print(recall)


@pytest.mark.parametrize("counters", [4, 1 << 18])
def test_large_buckets_lose_nothing(spark, monkeypatch, counters):
    """Families of texts that share a passage but are no near-duplicates, with near copies among them; with few counters
    nearly all words look alike, so that many texts have one of the first in common and buckets of them are dealt out in tiles."""
    monkeypatch.setattr(N, "BUCKET", 4)
    monkeypatch.setattr(N, "COUNTERS", counters)
    rng = random.Random(12)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs, k, passage = {}, 0, new(60)
    for _ in range(40):
        base = passage + new(40)
        for _ in range(rng.choice([1, 1, 2, 3])):
            own = list(base)
            own[rng.randrange(100)] = new(1)[0]
            docs[k], k = " ".join(own), k + 1
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r[0]: r[1] for r in N.near_duplicates(df).select("doc_id", "class_id").collect()}
    assert got == brute_classes(docs) and 30 < len(set(got.values())) < len(docs)


def test_bags_of_similar_texts_are_close():
    rng = random.Random(8)
    hashes = lambda ws: N.words(N.flat(pa.array([" ".join(ws)]))).hashes
    for _ in range(200):
        a = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(7, 80))]
        b = list(a)
        for at in rng.sample(range(len(a)), int(0.15 * len(a))):
            b[at] = rng.choice(["", f"w{rng.randrange(40)}", f"{b[at]} x"])
        y = words_of(" ".join(b))
        longer = max(len(a), len(y))
        if edits(a, y) <= N.allowed(len(a), len(y), 0.85):
            bags = [np.frombuffer(N.bag_of(hashes(ws)), "<u2") for ws in (a, y)]
            assert N.may_be_similar(bags[0], bags[1][None], np.array([longer]), 0.85).all()


def test_rare_words_meet():
    """Whatever the counters say, texts within the edits have one of their first words in common."""
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(7, 60)
        a = [f"w{rng.randrange(30)}" for _ in range(n)]
        b = list(a)
        for at in rng.sample(range(n), int(0.15 * n)):
            b[at] = rng.choice(["", f"w{rng.randrange(30)}", f"{b[at]} x"])
        x, y = words_of(" ".join(a)), words_of(" ".join(b))
        if edits(x, y) <= N.allowed(len(x), len(y), 0.85):
            ranks = np.array([rng.randrange(5) for _ in range(N.COUNTERS)], np.uint32)
            assert set(N.first_words(N.words(N.flat(pa.array([" ".join(x)]))).hashes, ranks, 0.85)) & set(N.first_words(N.words(N.flat(pa.array([" ".join(y)]))).hashes, ranks, 0.85))


def test_classes_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, k = {}, 0
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 300))]
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 60)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            docs[k] = " ".join(own)
            k += 1
    for _ in range(30):
        docs[k] = passage + " " + " ".join(rng.choice(vocabulary) for _ in range(80))
        k += 1
    docs |= {k: None, k + 1: "", k + 2: " \n ", k + 3: "one", k + 4: "ONE\n", k + 5: docs[0], k + 6: docs[0].upper()}
    df = spark.createDataFrame([(i, t, "x", i, "y") for i, t in docs.items()], "doc_id long, text string, class_id string, _k long, _row string")
    got = {r[0]: r[1] for r in N.near_duplicates(df).select("doc_id", "class_id").collect()}
    assert got == brute_classes(docs)
    kept = N.one_of_each(df).collect()
    assert {r.doc_id for r in kept} == set(got.values()) and all((r.text, r.class_id, r._k, r._row) == (docs[r.doc_id], "x", r.doc_id, "y") for r in kept)


def test_star_of_inserts_matches_brute_force(spark):
    rng = random.Random(4)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs, k = {}, 0
    for _ in range(3):
        base = new(200)
        for at in range(0, 200, 4):
            docs[k] = " ".join(base[:at] + new(30) + base[at:])
            k += 1
        docs[k] = " ".join(base)
        k += 1
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r[0]: r[1] for r in N.near_duplicates(df).select("doc_id", "class_id").collect()}
    assert got == brute_classes(docs)


def test_large_group_of_near_copies_is_as_many_edges_as_texts(spark, monkeypatch):
    rng = random.Random(14)
    new = lambda: f"w{rng.randrange(10**6)}"
    base, docs = [new() for _ in range(120)], {}
    for k in range(100):
        own = list(base)
        for at in rng.sample(range(120), 4):
            own[at] = new()
        docs[k] = " ".join(own)
    edges, whole = [], N.written

    def counted(df, name, tag="query"):
        out = whole(df, name, tag)
        if name == "edges":
            edges.append(out.count())
        return out

    monkeypatch.setattr(N, "written", counted)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r[0]: r[1] for r in N.near_duplicates(df).select("doc_id", "class_id").collect()}
    assert got == brute_classes(docs)
    assert max(edges) < len(docs), edges


def test_a_pair_comes_out_of_one_bucket(spark):
    rng = random.Random(15)
    drawn = {k: [10 * i + rng.randrange(3) for i in range(N.SKETCHES + 16 * (k % 2))] for k in range(12)}
    bag = bytearray(b"\0\0" * N.BAG)
    rows = [(b, k, [x % 10 for x in s] + [0] * (N._ALL - len(s)), 30, k // 2, bag, s) for k, s in drawn.items() for b in s]
    df = spark.createDataFrame(rows, "_bucket long, _rep long, _bits array<tinyint>, n_words long, _class long, bag binary, sketches array<long>")
    out, plain = [], DataFrame.distinct
    DataFrame.distinct = lambda x: (out.append(x.collect()), plain(x))[1]
    try:
        got = {tuple(r) for r in N.pairs_across(df, 0.0).collect()}
    finally:
        DataFrame.distinct = plain
    assert got == {(a, b) for b in drawn for a in range(b) if a // 2 != b // 2} and len(out[0]) == len(got)


@pytest.mark.parametrize("seed", range(2))
def test_classes_united_by_further_links(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(60)]
    table = lambda rows: spark.createDataFrame(rows, "_leader long, _member long")
    classes = N.united(N.components(table(pairs[:25])), table(pairs[25:]))
    parent = list(range(60))
    for a, b in pairs * 60:
        parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r[0]: r[1] for r in classes.collect()}
    assert classes.count() == len(got) and {a for x in pairs for a in x} >= set(got)
    assert [got.get(x, x) for x in range(60)] == parent


def test_empty_null_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "z"), (7, "a b c d e f")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == [("1", "1"), ("1", "1"), ("7", "1"), ("None", "1"), ("None", "None")]
