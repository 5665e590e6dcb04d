"""Byte-level BPE encoding and decoding with the tokenizers library, from a file of byte ranks.

The library merges by the place of a pair in a list; rank files give a rank to what a pair makes. So the list
holds every way to make each token out of two others, in the order of the ranks, and whole pieces that are
tokens are taken as they are.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CACHE_ENTRIES, KEPT, Chunks, Remembered, byte_table, shown, slices, tidied

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in file if x.strip())}


def splits_of(token: bytes, ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every two tokens that make this one, so ordered that of two ways that can overlap the left one comes first."""
    ways = [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    done: list[tuple[bytes, bytes]] = []
    while ways:  # (x, y) goes before (y, z): in x y z the library would otherwise take the right pair
        free = [w for w in ways if not any(v[1] == w[0] and v != w for v in ways)] or ways[:1]
        done += free
        ways = [w for w in ways if w not in free]
    return done


class Codec:
    """Encodes texts to ids and ids to bytes; one for each process and file."""

    _by_key: dict[tuple[str, str], "Codec"] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        ranks = read_ranks(path)
        chars = byte_table()
        named = {token: "".join([chars[b] for b in token]) for token in ranks}
        merges = [(named[a], named[b]) for token in sorted(ranks, key=ranks.__getitem__) for a, b in splits_of(token, ranks)]
        self.model = Tokenizer(BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(x) for x in self.tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.pieces = Remembered(self._encode, CACHE_ENTRIES // 4)
        self.chunks = Chunks(self._chunks, "<i4")

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        if (path, pattern) not in cls._by_key:
            cls._by_key[path, pattern] = cls(path, pattern)
        return cls._by_key[path, pattern]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        tokenize = self.model.model.tokenize
        return [array("i", [t.id for t in tokenize(shown(x))]).tobytes() for x in pieces]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        found = [self.find(x) for x in chunks]
        distinct = list(dict.fromkeys(p for ps in found for p in ps))
        known = dict(zip(distinct, self.pieces(distinct)))
        return [b"".join([known[p] for p in ps]) for ps in found]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        return self.chunks(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids end to end; a character whose bytes lie in several tokens comes out whole."""
        if ids.size == 0:
            return b""
        if ids.min() < 0 or ids.max() >= len(self.tokens):
            raise ValueError("an id is not in the vocabulary")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.bytes[at].tobytes()

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character start and end of each token; a token that holds part of a character spans that character."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.sizes[ids])
        starts = ends - self.sizes[ids]
        return char[starts], char[ends - 1] + 1


KEPT.append(Codec._by_key)


def encode(text: Column | str, path: str, pattern: str, offsets: bool = False) -> Column:
    """A column of ``array<int>`` with the ids of ``text``; null and empty texts give an empty array.

    With ``offsets`` it is a struct of ``ids``, ``starts`` and ``ends``, the latter in characters of the text.
    """
    ids_type = T.ArrayType(T.IntegerType(), False)
    kind = T.StructType([T.StructField(x, ids_type, False) for x in ("ids", "starts", "ends")]) if offsets else ids_type

    def as_list(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, arrays)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i4"), *arrays]), pa.int32()))

    @F.arrow_udf(kind)
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            parts = []
            for texts in slices(batch):
                ids = list(codec.encode(texts))
                if offsets:
                    spans = [codec.offsets(t or "", i) for t, i in zip(texts.to_pylist(), ids)]
                    parts.append(pa.StructArray.from_arrays([as_list(ids), as_list([s for s, _ in spans]), as_list([e for _, e in spans])], ["ids", "starts", "ends"]))
                else:
                    parts.append(as_list(ids))
            yield pa.concat_arrays(parts) if parts else pa.array([], batch_type(kind))

    return run(F.col(text) if isinstance(text, str) else text)


def batch_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decode(ids: Column | str, path: str, pattern: str) -> Column:
    """A binary column with the bytes of an ``array<int>`` of ids; null gives null, an unknown id is an error."""

    @F.arrow_udf(T.BinaryType())
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            out = []
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                flat, ends = part.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *[x or 0 for x in pc.list_value_length(part).to_pylist()]])
                out.extend(None if null else codec.decode(flat[a:b]) for null, a, b in zip(part.is_null().to_pylist(), ends, ends[1:]))
            yield pa.array(out, pa.binary())

    return run(F.col(ids) if isinstance(ids, str) else ids)


def encode_table(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` to the rows of ``df`` and, decoded from those ids, ``decoded`` (binary); no shuffle.

    Null and empty texts have no ids and decode to no bytes. Columns of the same names are replaced; repeated rows
    are coded each for itself; an empty table stays empty.
    """
    encoded = df.withColumn("ids", encode(text, path, pattern))
    return encoded.withColumn("decoded", decode("ids", path, pattern))
