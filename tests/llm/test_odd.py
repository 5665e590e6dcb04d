"""Texts longer than any slice, repeated rows, null keys, clashing names and empty tables, for operators and stages alike."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from telltale.llm import bpe_codec, fingerprint_index, language_id, near_dedup, packing, quality, scratch, suffix_dedup, token_counts, token_files

BYTE, WORD, MULTI = (P.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def long_text():
    """Over 6 MB, the largest slice: every line is new."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]
    text = "\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(29_000))
    assert len(text) > 6_000_000
    return text


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    rows = [(1, long_text, "en", "a", 0), (2, "short " + long_text[:3000], "en", "a", 0), (3, long_text.replace(" ", "  ", 9).upper(), "en", "a", 0)]
    return spark.createDataFrame(rows, COLUMNS)


def test_long_texts_as_tokens(spark, long_docs, long_text):
    ids = {path: Tokenizer.from_file(path).encode(long_text, add_special_tokens=False).ids for path in (BYTE, WORD)}
    one = long_docs.where("doc_id = 1")
    assert token_counts.count_tokens(one, BYTE).first().n_tokens == len(ids[BYTE])
    assert bytes(bpe_codec.encode_table(one, MULTI, P.PATTERN).select("decoded").first()[0]) == long_text.encode()
    pieces = packing.pack(one, BYTE, 2, 1024).orderBy("piece").collect()
    whole = [*ids[BYTE], 2]
    assert sum(r.length for r in pieces) == len(whole) and all(r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
    out = scratch.new_path(spark, "long")
    token_files.write(one, out, WORD, 1)
    row = token_files.read(spark, out, ids=False).first()
    assert (row.n_tokens, row.ids_crc32) == (len(ids[WORD]) + 1, zlib.crc32(np.array([*ids[WORD], 1], "<u4").tobytes()))


def test_long_texts_as_words(long_docs, long_text):
    n = len(long_text.split())
    told = {r.doc_id: r for r in quality.verdicts(long_docs).collect()}
    assert told[1].n_words == n and told[1].kept and told[1].n_repeat_words == quality.repeated_words(long_text.split())
    assert [r.lang_pred for r in language_id.identify(long_docs, language_id.train(long_docs.withColumn("doc_id", F.col("doc_id") + 100))).collect()] == ["en"] * 3
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(long_docs).collect()} == {1: 1, 2: 2, 3: 1}
    removed = {r.doc_id: (r.n, r.n_removed) for r in fingerprint_index.deduplicate(long_docs, batches=2).collect()}
    shared = len(long_text[:3000].rsplit(" ", 1)[0].split())
    assert removed[1] == (n, 0) and removed[3] == (n, 0) and shared <= removed[2][1] <= shared + 1
    spans = {r.doc_id: (r.n, r.n_removed, r.n_spans) for r in suffix_dedup.deduplicate(long_docs).collect()}
    assert spans[1] == (len(long_text), 3000, 1) and spans[2] == (3006, 3000, 1)


def test_repeated_rows_and_null_keys(spark):
    text = "It's a test, of 10,000 words."
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, "")], "doc_id long, text string")
    n = len(Tokenizer.from_file(BYTE).encode(text).ids)
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_counts.count_tokens(df, BYTE).collect()) == [("1", n), ("1", n), ("2", 0), ("None", 0), ("None", n)]
    assert sorted((str(r.doc_id), len(r.ids) > 0, bytes(r.decoded).decode()) for r in bpe_codec.encode_table(df, MULTI, P.PATTERN).collect()) == [("1", True, text)] * 2 + [("2", False, ""), ("None", False, ""), ("None", True, text)]
    packed = packing.pack(df, BYTE, 2, 64).collect()
    assert sorted((str(r.doc_id), r.length) for r in packed) == [("1", n + 1), ("1", n + 1), ("2", 1), ("None", 1), ("None", n + 1)]
    out = scratch.new_path(spark, "repeated")
    token_files.write(df, out, WORD, 1)
    rows = sorted(token_files.read(spark, out, ids=False).collect(), key=lambda r: r.start)
    assert [r.key for r in rows] == [None, None, 1, 1, 2] and rows[2].ids_crc32 == rows[3].ids_crc32
    assert [r.start for r in rows] == list(np.cumsum([0, *(r.n_tokens for r in rows)])[:-1])


def test_stages_with_odd_tables(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage = text(60)
    rows = [(i, f"{text(80)} {passage} {text(20)}", "en", "a", 0) for i in range(4)]
    rows += [(7, text(90), "en", "a", 0)] * 2 + [(None, text(70), None, None, None), (8, None, "en", "a", 0), (9, "", "en", "a", 0)]
    extra = ["_row", "_key", "_text", "_spans", "_maybe", "lang_pred", "score", "class_id", "removed_lines", "_told", "_host", "kept"]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({n: F.lit(i) for i, n in enumerate(extra)})
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if i == 4:
            assert {r.doc_id for r in out.collect()} == {0, 1, 2, 3, 7, None}
            break
        assert out.columns == docs.columns
        kept = out.collect()
        assert all([r[n] for n in extra] == list(range(len(extra))) for r in kept)
        seen[name] = sorted((str(r.doc_id), r.text) for r in kept)
        docs = spark.createDataFrame(kept, out.schema)
    assert [k for k, _ in seen["near-duplicates"]] == ["0", "1", "2", "3", "7", "7", "None"]
    assert all(passage not in t for _, t in seen["suffix-array dedup"]) and sum(passage in t for _, t in seen["near-duplicates"]) == 4
    empty = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
