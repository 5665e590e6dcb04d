import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from telltale.llm import ordered_packing

WORD = P.path("word_bpe_49k.json")


def padding(length, capacity):
    return 0 if length & (length - 1) == 0 else capacity - length


def least_cost(places, prices, capacity):
    at, cost = [0, *places], [0]
    for j in range(1, len(at)):
        cost.append(min(cost[i] + padding(at[j] - at[i], capacity) for i in range(j) if at[j] - at[i] <= capacity) + prices[j - 1])
    return cost[-1]


def test_cuts_cost_least():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([7, 16, 50, 64])
        places = np.cumsum([rng.randrange(1, rng.choice([3, capacity])) for _ in range(rng.randrange(1, 80))]).tolist()
        prices = [rng.choice([0, 2, 9]) for _ in places]
        chosen = ordered_packing.best_cuts(places, prices, capacity)
        ends = [places[i] for i in chosen]
        starts = [0, *ends[:-1]]
        assert ends[-1] == places[-1] and all(0 < b - a <= capacity for a, b in zip(starts, ends))
        assert sum(padding(b - a, capacity) for a, b in zip(starts, ends)) + sum(prices[i] for i in chosen) == least_cost(places, prices, capacity)


def test_sentences():
    tokenizer = Tokenizer.from_file(WORD)
    text = 'He paid 3.14 for it. "Really?!" she said... no end'
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    words = [tokenizer.id_to_token(i).removesuffix("</w>") for i in ids]
    found = [words[i - 1] for i in ordered_packing.sentence_ends(np.array(ids), WORD)]
    assert found == [".", '?!"', "..."]


def texts():
    rng = random.Random(5)
    words = "the a of model Zürich run. stop! why? 3.5 日本 x".split()
    out = [" ".join(rng.choice(words) for _ in range(int(rng.expovariate(1 / 60)))) for _ in range(400)]
    return [*out, "", None, "word " * 9000, "End. " * 3000, "!" * 2000, "the " * 15 + "x"]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces(spark, monkeypatch, capacity):
    monkeypatch.setattr(ordered_packing, "SETTLE", 3000)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in rows] + [(None, "twice. " * 40, "b", 2), (3, "copy", "b", 2), (3, "copy", "b", 2)], "doc_id long, text string, length string, offset int")
    df = df.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    got = ordered_packing.pack(df, WORD, end_id=1, capacity=capacity, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(WORD)
    known = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows if k != 3}
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, ids in known.items():
        pieces = sorted(by_document[k], key=lambda r: r.start)
        assert [i for r in pieces for i in r.ids] == ids and all(r.doc_tokens == len(ids) for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
    total, wasted, last = 0, 0, -1
    for s in sorted(by_sequence):
        pieces = sorted(by_sequence[s], key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        length = sum(r.length for r in pieces)
        assert 0 < length <= capacity
        total, wasted = total + length, wasted + padding(length, capacity)
        keys = [r.doc_id for r in pieces if r.doc_id is not None]
        assert keys == sorted(keys) and (not keys or keys[0] >= last)
        last = keys[-1] if keys else last
    assert total == sum(r.length for r in got)
    assert wasted < {64: 0.05, 2048: 0.01}[capacity] * total, (wasted, total)


def test_order_and_empty(spark):
    df = spark.createDataFrame([(i, f"text {i}.") for i in range(50)], "doc_id long, text string").repartition(4)
    got = ordered_packing.pack(df, WORD, 1, capacity=16, order=[df["doc_id"].desc()]).collect()
    placed = sorted((r.sequence_id, r.offset, r.doc_id) for r in got if r.start == 0)
    assert [x[2] for x in placed] == list(range(49, -1, -1))
    assert ordered_packing.pack(df.limit(0), WORD, 1).count() == 0
