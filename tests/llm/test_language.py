"""Votes and features of language identification, recomputed by plain loops on the fitted weights."""

import math
import random

from telltale.llm import language_id as L

WORDS = {"en": "the of and to in is that it was for".split(), "de": "der die und das ist nicht ein zu mit".split(), "fr": "le la et les des est que une dans".split(), "es": "el la los que y en un por con".split(), "xx": "zzq qqz zqz".split()}


def corpus():
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(5, 40))), lang) for i in range(400) for lang in [rng.choice(list(WORDS))]]
    odd = [(400, None, "en"), (401, "", "de"), (402, "123 !?", "fr"), (None, "der die das und", "de"), (None, None, None), (403, "É" * 300 + " the", None), (404, "the " * 4000, None), (5, rows[5][1], rows[5][2])]
    return rows + odd


def plain_features(text):
    letters = [b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in b" " + text.lower().encode() + b" "]
    counts = {}
    for size, shift, base in ((2, 20, 0), (3, 19, L.BIGRAMS)):
        for i in range(len(letters) - size + 1):
            number = 0
            for b in letters[i : i + size]:
                number = number << 8 | b
            slot = base + ((number * 2654435761 & 0xFFFFFFFF) >> shift)
            counts[slot] = counts.get(slot, 0) + 1
    roots = {slot: math.sqrt(n) for slot, n in counts.items()}
    length = math.sqrt(sum(v * v for v in roots.values()))
    return {slot: v / length for slot, v in roots.items()}


def plain_vote(vote, x):
    if len(vote.classes) == 1:
        return vote.classes[0], 1.0
    won, total, share = [[0.0] * len(vote.classes) for _ in range(3)]
    for weights, (a, b) in zip(vote.weights, vote.pairs):
        margin = float(weights[-1]) + sum(float(weights[slot]) * v for slot, v in x.items())
        won[a if margin >= 0 else b] += 1
        total[a] += margin
        total[b] -= margin
        p = 1 / (1 + math.exp(-L.STEEPNESS * margin))
        share[a] += p
        share[b] += 1 - p
    best = max(range(len(vote.classes)), key=lambda i: (won[i], total[i]))
    return vote.classes[best], share[best] / (len(vote.classes) - 1)


def test_like_plain_loops(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "old", 7) for r in rows], "doc_id long, text string, lang string, lang_pred string, k int").repartition(3)
    model = L.train(df)
    assert set(model.families.classes) == {"germanic", "romance", "xx"} and set(model.within["germanic"].classes) == {"de", "en"}
    got = L.identify(df, model).collect()
    assert len(got) == len(rows) and all(r.k == 7 for r in got)
    right = 0
    for r in got:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        x = plain_features(r.text)
        family, p = plain_vote(model.families, x)
        language, q = plain_vote(model.within[family], x)
        assert r.lang_pred == language and abs(r.score - p * q) < 1e-4
        right += r.lang_pred == r.lang
    assert right > 390


def test_no_labels_and_null_keys(spark):
    df = spark.createDataFrame([(None, "the cat", "en"), (None, "der Hund", "de")], "doc_id long, text string, lang string")
    assert L.train(df) is None
    assert [(r.lang_pred, r.score) for r in L.identify(df, None).collect()] == [("und", 0.0)] * 2
    assert L.identify(df.limit(0), None).count() == 0
