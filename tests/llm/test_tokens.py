import base64
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from telltale.llm import bpe_codec, packing, scratch, token_counts, token_files
from telltale.llm.chunks import LibraryIds

BYTE, WORD, MULTI = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


def texts():
    rng = random.Random(1)
    alphabet = " \n\t  a aa aaa'sé日本語😀́ \x1c\x85 .,!12x<|endoftext|>Σßİ=-"
    out = ["", " ", "  ", "\n", "a" * 3000, "<|endoftext|>", "x <|endoftext|> y", "Hello, world. It's 10,000.", "the " * 2000 + "end."]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    return out + ["".join(rng.choice(["<|endoftext|>", " ", "  ", "\n", "foo.", "É,", "bar"]) for _ in range(8)) for _ in range(100)]


TEXTS = texts()


def library(path):
    return [x.ids for x in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(len(TEXTS), None, 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, piece int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_counts(docs, empty):
    want = [*map(len, library(BYTE)), 0]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE).collect()}
    assert got == {i: (len(t.encode()), n, n > 1024) for i, (t, n) in enumerate(zip([*TEXTS, ""], want))}
    assert token_counts.count_tokens(empty, BYTE).count() == 0


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids(path):
    assert [x.tolist() for x in LibraryIds(path)(pa.array(TEXTS))] == library(path)


def test_codec(docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in bpe_codec.encode_table(docs, MULTI, P.PATTERN).collect()}
    for i, t in enumerate([*TEXTS, ""]):
        assert list(rows[i].ids) == encoding.encode_ordinary(t) and bytes(rows[i].decoded) == t.encode()
    assert bpe_codec.encode_table(empty, MULTI, P.PATTERN).count() == 0
    codec = bpe_codec.Codec.of(MULTI, P.PATTERN)
    text = "日本 a"
    ids = next(codec.encode(pa.array([text])))
    starts, ends = codec.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text) and all(a < b for a, b in zip(starts, ends))
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6]))


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(30):
        lengths = [rng.randrange(1, 65) for _ in range(rng.randrange(1, 300))]
        histogram = defaultdict(int)
        for x in lengths:
            histogram[x] += 1
        slots, n = packing.plan(dict(histogram), 64)
        bins = []
        for x in sorted(lengths, reverse=True):
            room = [b for b in bins if b[0] >= x]
            if room:
                min(room)[0] -= x
            else:
                bins.append([64 - x])
        assert n == len(bins)
        assert sum(past - first for _, first, past, *_ in slots) == len(lengths)


def test_packing(docs, empty):
    rows = packing.pack(docs, BYTE, 2, 1024, keep_ids=True).collect()
    ids = {i: [*x, 2] for i, x in enumerate([*library(BYTE), []])}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and list(r.ids) == own
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        found = sorted(pieces[i])
        assert [p for p, _, _ in found] == list(range(len(found))) and sum(n for *_, n in found) == len(x)
        assert all(n == 1024 for *_, n in found[1:]) and (len(found) == 1) == (len(x) <= 1024)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(empty, BYTE, 2).count() == 0
    whole = {r.sequence_id: list(r.ids) for r in packing.sequences(packing.pack(docs, BYTE, 2, keep_ids=True)).collect()}
    assert sum(map(len, whole.values())) == sum(map(len, ids.values()))


def test_byte_code():
    rng = np.random.default_rng(3)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype("<u4")
        assert token_files.expand(*token_files.compress(values), n).tolist() == values.tolist()
    with pytest.raises(ValueError):
        token_files.expand(b"\x00", b"", 1)


def test_token_files(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 500)
    out = scratch.new_path(spark, "test")
    token_files.write(docs, out, WORD, 1)
    got = sorted((r.key, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in token_files.read(spark, out).collect())
    start = 0
    for (key, at, n, crc, ids), (i, want) in zip(got, enumerate([*library(WORD), []])):
        want = [*want, 1]
        assert (key, at, n, crc, ids) == (i, start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()), want)
        start += n
    assert len(got) == len(TEXTS) + 1
    none = scratch.new_path(spark, "none")
    token_files.write(empty, none, WORD, 1)
    assert token_files.read(spark, none).count() == 0
