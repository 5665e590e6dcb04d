import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from telltale.llm import fingerprint_index, passages, scratch, suffix_dedup
from telltale.llm.windows import anchors


def covered(n, starts, window):
    flags = [False] * n
    for s in starts:
        flags[s : s + window] = [True] * window
    return flags


def brute_bytes(docs, length):
    count = Counter()
    for t in docs.values():
        raw = (t or "").encode()
        count.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = {}
    for k, t in docs.items():
        raw = (t or "").encode()
        flags = covered(len(raw), [i for i in range(len(raw) - length + 1) if count[raw[i : i + length]] > 1], length)
        left = bytes(b for b, f in zip(raw, flags) if not f)
        spans = sum(f and not g for f, g in zip(flags, [False, *flags]))
        out[k] = (len(raw), sum(flags), spans, hashlib.sha256(left).hexdigest())
    return out


def brute_words(docs, window):
    first = {}
    for k in sorted(docs):
        ws = (docs[k] or "").encode().split()
        for i in range(len(ws) - window + 1):
            first.setdefault(tuple(ws[i : i + window]), k)
    out = {}
    for k, t in docs.items():
        ws = (t or "").encode().split()
        flags = covered(len(ws), [i for i in range(len(ws) - window + 1) if first[tuple(ws[i : i + window])] < k], window)
        left = b" ".join(w for w, f in zip(ws, flags) if not f)
        out[k] = (len(ws), sum(flags), hashlib.sha256(left).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    shared = [" ".join(word() for _ in range(rng.choice([45, 60, 150]))) for _ in range(6)]
    docs = {}
    for k in range(120):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 120)))]
        for _ in range(rng.randrange(3)):
            parts.append(rng.choice(shared) if rng.random() < 0.6 else shared[0])
            parts.append(" ".join(word() for _ in range(rng.randrange(0, 60))))
        docs[k] = rng.choice([" ", "\n", " "]).join(parts)
    docs |= {120: docs[3], 121: docs[3], 122: docs[5][7:], 123: None, 124: "", 125: "a" * 1500, 126: "ab " * 700, 127: "é" * 600, 128: "x" * 399, 129: "x" * 399, 130: docs[7] + docs[7], 131: " ".join(["w"] * 300)}
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, [3, 4, 30, 256][seed], 600)
    text[rng.integers(0, 500) :][:60] = 5
    text[300:420] = text[30:150]
    text = np.append(text, 0)
    array = suffix_dedup.suffix_array(text, 1000)
    assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    room = len(text) - 1 - np.arange(len(text))
    shared = suffix_dedup.common_prefixes(text, array, room, 50)
    for got, i, j in zip(shared, array[:-1], array[1:]):
        n = 0
        while n < min(50, room[i], room[j]) and text[i + n] == text[j + n]:
            n += 1
        assert got == n


def test_every_window_has_one_anchor(monkeypatch):
    from telltale.llm import windows

    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 5000).astype(np.uint64)
    firsts = np.array([0, 0, 40, 41, 1700, 1700, 5000])
    whole = anchors(values, firsts, 30, 6)
    monkeypatch.setattr(windows, "BLOCK", 97)
    parts = anchors(values, firsts, 30, 6)
    for a in (whole, parts):
        seen = sorted((t, s) for t, f, e in zip(a.text, a.first, a.last) for s in range(f, e + 1))
        assert seen == [(t, s) for t in range(6) for s in range(firsts[t + 1] - firsts[t] - 29)]
    assert [whole.text.tolist(), whole.hashes.tolist(), whole.first.tolist(), whole.last.tolist(), whole.place.tolist()] == [parts.text.tolist(), parts.hashes.tolist(), parts.first.tolist(), parts.last.tolist(), parts.place.tolist()]
    at = defaultdict(set)
    for t, h, f, e, p in zip(whole.text, whole.hashes, whole.first, whole.last, whole.place):
        for s in range(f, e + 1):
            at[tuple(values[firsts[t] + s :][:30].tolist())].add((h, p - s))
    assert all(len(x) == 1 for x in at.values())


@pytest.mark.parametrize("hot", [False, True])
def test_bytes_match_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "SEGMENTS", 2)
    docs = corpus(5)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs.items()], "doc_id long, text string, n int, h int").repartition(3)
    got = {r.doc_id: (r.n, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df).collect()}
    want = brute_bytes(docs, 400)
    assert sum(x[1] > 0 for x in want.values()) > 20
    assert got == want


@pytest.mark.parametrize("by_word", [False, True])
def test_one_passage_in_very_many_contexts_is_sorted_in_small_arrays(spark, monkeypatch, by_word):
    monkeypatch.setattr(suffix_dedup, "SEGMENTS", 20)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(60 if by_word else 140))[:420]
    docs = {k: " ".join([*(word() for _ in range(rng.randrange(3))), passage, *(word() for _ in range(rng.randrange(3)))]) for k in range(300)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    sorted_, most = suffix_dedup._sorted, []

    def watched(segments, length, by_word):
        most.append(max([r["count"] for r in segments.groupBy("h").count().collect()], default=0))
        return sorted_(segments, length, by_word)

    monkeypatch.setattr(suffix_dedup, "_sorted", watched)
    if by_word:
        assert {r.doc_id: r.text for r in suffix_dedup.clean(df).collect()} == without_repeats(docs, 50)
    else:
        assert {r.doc_id: (r.n, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicate(df).collect()} == brute_bytes(docs, 400)
    assert max(most) <= 20


def without_repeats(docs, window):
    """The texts without the words of windows that also start elsewhere; a removed word takes the white space after it along."""
    places = {k: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for k, t in docs.items()}
    count = Counter(tuple(docs[k][a:b] for a, b in ps[i : i + window]) for k, ps in places.items() for i in range(len(ps) - window + 1))
    out = {}
    for k, ps in places.items():
        flags = covered(len(ps), [i for i in range(len(ps) - window + 1) if count[tuple(docs[k][a:b] for a, b in ps[i : i + window])] > 1], window)
        bounds = [*(a for a, _ in ps), len(docs[k] or "")]
        out[k] = docs[k] if not any(flags) else docs[k][: bounds[0]] + "".join(docs[k][a:b] for a, b, f in zip(bounds, bounds[1:], flags) if not f)
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_cleaning_by_words_matches_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "SEGMENTS", 2)
    docs = corpus(7)
    docs |= {140: docs[4].replace(" ", " \n\t"), 141: "  x " + docs[8] + " \n"}
    df = spark.createDataFrame([(k, t, [k], k, "x") for k, t in docs.items()], "doc_id long, text string, _spans array<int>, _key long, _row string").repartition(3)
    rows = suffix_dedup.clean(df).collect()
    want = without_repeats(docs, 50)
    assert sum(want[k] != docs[k] for k in docs) > 20
    assert {r.doc_id: r.text for r in rows} == want
    assert all((r._spans, r._key, r._row) == ([r.doc_id], r.doc_id, "x") for r in rows) and len(rows) == len(docs)


@pytest.mark.parametrize(("batches", "group", "fingerprint"), [(1, 50_000, 4), (2, 3, 4), (3, 50_000, 1), (7, 3, 1)])
def test_words_match_brute_force(spark, monkeypatch, batches, group, fingerprint):
    monkeypatch.setattr(fingerprint_index, "GROUP", group)
    monkeypatch.setattr(passages, "FINGERPRINT", fingerprint)  # one byte is often equal by chance
    docs = corpus(6)
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs.items()], "doc_id long, text string, first int, c int").repartition(3)
    got = {r.doc_id: (r.n, r.n_removed, r.kept_sha256) for r in fingerprint_index.deduplicate(df, batches=batches).collect()}
    want = brute_words(docs, 50)
    assert sum(x[1] > 0 for x in want.values()) > 20
    assert got == want


def thue_morse(swap):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(1024))


def test_words_of_equal_polynomial_hashes(spark):
    """These two words have the same hash modulo 2 ** 64 under any base."""
    ws = [f"w{i}" for i in range(60)]
    docs = {1: " ".join([*ws[:30], thue_morse(0), *ws[30:]]), 2: " ".join([*ws[:30], thue_morse(1), *ws[30:]]), 3: " ".join([*ws[:30], thue_morse(1), *ws[30:55], "x"])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for batches in (1, 3):
        got = {r.doc_id: (r.n, r.n_removed, r.kept_sha256) for r in fingerprint_index.deduplicate(df, batches=batches).collect()}
        assert got == brute_words(docs, 50) and got[2][1] == 0 < got[3][1]
    changed = {r.doc_id: r.text for r in suffix_dedup.clean(df).collect()}
    assert changed == without_repeats(docs, 50) and changed[1] == docs[1]


def test_an_index_goes_on_from_its_folder(spark):
    docs = {k: t for k, t in corpus(9).items() if t}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    folder, spans = scratch.new_path(spark, "index"), []
    for i, (lo, hi) in enumerate([(0, 30), (30, 50), (50, 90), (90, 200)]):
        index = fingerprint_index.FingerprintIndex(spark, folder)  # as a new session would
        assert index.next_batch == i and len(index.runs) == [0, 1, 1, 2][i]
        table = passages.scanned(df.where(f"doc_id >= {lo} AND doc_id < {hi}"), "doc_id", "text", 50, 10, True, "query", fingerprints=True)
        spans += [(r[0], r.lo, r.hi) for r in index.add(table, df.where(f"doc_id < {hi}"), "doc_id", "text").collect()]
        index.close()
    lost = {k: sum(covered(x[0], [s for key, lo, hi in spans if key == k for s in range(lo, hi)], 1)) for k, x in brute_words(docs, 50).items()}
    assert lost == {k: x[1] for k, x in brute_words(docs, 50).items()}


def test_passages_twice_in_the_document_that_has_them_first(spark):
    for seed in range(2):
        rng = random.Random(seed)
        word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
        new = lambda n: [word() for _ in range(n)]
        docs, k = {}, 0
        for _ in range(20):
            q = new(200)
            docs[k], docs[k + 1] = " ".join(new(30) + q[:100] + new(30)), " ".join(q + new(20) + q + new(20) + q[40:])
            k += 2
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n, r.n_removed, r.kept_sha256) for r in fingerprint_index.deduplicate(df).collect()}
        assert got == brute_words(docs, 50)


def test_empty_null_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    long = " ".join(f"w{i}" for i in range(200))
    odd = spark.createDataFrame([(None, long), (1, long), (1, long), (2, None)], "doc_id long, text string")
    for run in (suffix_dedup.deduplicate, fingerprint_index.deduplicate):
        assert run(empty).count() == 0
        assert sorted((str(r[0]), r.n_removed) for r in run(odd).collect())[-1] == ("None", 0)
        assert run(odd).count() == 4
