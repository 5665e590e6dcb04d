import numpy as np
import pytest

from telltale.llm import neighbours


def brute(ids, x, k=20, every=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        rows = np.flatnonzero(ids != ids[i])
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in rows[np.lexsort((ids[rows], -s[rows]))][:k]]
    return out


@pytest.mark.parametrize("kind", ["uniform", "copies", "clusters", "norms"])
def test_recall_and_order(spark, monkeypatch, kind):
    if kind == "copies":
        monkeypatch.setattr(neighbours, "BLOCK", 500)  # several blocks, and a bucket larger than one
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32))
    if kind == "copies":
        x[rng.random(3000) < 0.4] = x[7]
    if kind == "clusters":
        x = rng.standard_normal((12, 32))[rng.integers(0, 12, 3000)] + 0.2 * x
    if kind != "norms":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, x)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    least = {q: v[-1][1] for q, v in want.items()}
    recall = np.mean([sum(s >= least[q] - 1e-12 for _, s in v) / 20 for q, v in got.items()])
    assert recall >= 0.9, recall
    for q, v in got.items():
        assert v == sorted(v, key=lambda t: (-t[1], t[0])) and q not in [i for i, _ in v]
        assert all(abs(s - float((x[i] * x[q]).sum())) < 1e-12 for i, s in v)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0]), (None, [1.0, 1.0]), (3, [])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 2.0), (0, 2, 1, 2.0)]
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
