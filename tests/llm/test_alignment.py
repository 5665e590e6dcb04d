import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from telltale.llm import alignment
from telltale.llm.chunks import byte_table

BYTE, PIECE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(texts):
    """Groups and links of each text, by plain loops over whole texts."""
    a_side = Tokenizer.from_file(BYTE)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    byte_of = {c: i for i, c in enumerate(byte_table())}
    each, counts = [], Counter()
    for text in texts:
        a, b = [], []
        if text:
            encoded = a_side.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(byte_of[c] for c in a_side.id_to_token(i))) for i in encoded.ids]
            for i in b_side.encode(text):
                piece = b_side.id_to_piece(i)
                b.append((i, bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()))
            whole = (" " + text).encode()
            if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
                a, b = [], []
        groups, links, i, j, at_a, at_b, start = [], [], 0, 0, 0, 0, (0, 0)
        while i < len(a):
            links.append((a[i][0], b[j][0]))
            end_a, end_b = at_a + len(a[i][1]), at_b + len(b[j][1])
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(",".join(str(x) for x, _ in a[start[0] : i]) + "|" + ",".join(str(x) for x, _ in b[start[1] : j]))
                start = (i, j)
        counts.update(links)
        each.append((len(a), len(b), groups, links))
    best = {}
    for (_, b_id), n in counts.items():
        best[b_id] = max(best.get(b_id, 0), n)
    return [(a, b, len(g), len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, ls in each], counts, best


def texts():
    rng = random.Random(11)
    alphabet = " \n\r\t  a aa don't'sé日本語😀́\x00 \x1c\x85 .,!12x<s><|endoftext|>Σßİ=-▁"
    out = ["", None, " ", "  ", "\n", "a" * 3000, "<|endoftext|> <s> </s>", "x\n\n\ny", "a b c d", "foo \nbar", " lead", "trail ", "a\r\nb\n c", "no▁way", "日本語" * 300, "😀" * 50, "  two  spaces  "]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    words = "the model, runs Zürich\nover <unk> unbelievable 12,345 naïveté it's\n\nNew ...".split(" ")
    return out + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(200)]


@pytest.mark.parametrize("block", [300, 8_000_000])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "SLICE", min(block, 4000))
    rows = [*enumerate(texts()), (None, "it's null"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, groups string, code int").repartition(3)
    want, counts, best = brute([t for _, t in rows])
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else r.groups) for r in alignment.align(df, BYTE, PIECE).collect()]
    assert sorted(got, key=str) == sorted([(k, *x) for (k, _), x in zip(rows, want)], key=str)
    pairs = {(r.link_a, r.link_b): (r["count"], r.best) for r in alignment.pair_counts(df, BYTE, PIECE).collect()}
    assert pairs == {x: (n, int(n == best[x[1]])) for x, n in counts.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align(df, BYTE, PIECE).count() == 0 and alignment.pair_counts(df, BYTE, PIECE).count() == 0
    alone = spark.createDataFrame([("a", "▁"), ("b", None)], "doc_id string, text string")
    assert sorted(map(tuple, alignment.align(alone, BYTE, PIECE).collect())) == [(x, 0, 0, 0, 0, 0, 0, "") for x in "ab"]
