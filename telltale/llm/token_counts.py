"""Token counts by rank-synchronous merging of ragged numpy arrays.

The symbols of many pre-tokens lie in one flat array. In each round every sequence finds its lowest-ranked
adjacent pair and merges all occurrences of that pair at once, from left to right where they overlap; sequences
without a pair that merges leave. What survives is counted, and no token id is ever materialised.

Merging all occurrences at once equals merging them one by one as long as a merge can't create a pair of a lower
rank than its own, which holds for every trained vocabulary and is checked when the file is loaded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import KEPT, PLAIN, Chunks, library_tokenizer, shown, tidied

NO_RANK = np.iinfo(np.int32).max
#: Pre-tokens merged together: bounds the arrays of a round.
SEQUENCES = 100_000


class RankTable:
    """Merge ranks of a byte-level BPE file and their results, looked up by pair for whole arrays."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int32)
        self.width = np.int64(max(self.vocab.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        born = np.full(int(self.width), -1, np.int64)
        born[made[::-1]] = np.arange(len(made))[::-1]
        if np.any(np.maximum(born[left], born[right]) >= np.arange(len(made))) or len(np.unique(made)) != len(made):
            raise ValueError(f"{path}: a merge comes before the merges that make its parts; rounds would not be exact")
        self.symbols = np.full(0x11000, -1, np.int32)
        for token, i in self.vocab.items():
            if len(token) == 1 and ord(token) < len(self.symbols):
                self.symbols[ord(token)] = i
        self.special = [x["content"] for x in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)


def survivors(symbols: np.ndarray, lengths: np.ndarray, table: RankTable) -> np.ndarray:
    """How many symbols each sequence keeps; ``symbols`` holds the sequences end to end, none of them empty."""
    kept = lengths.astype(np.int64).copy()
    alive = np.flatnonzero(lengths > 1)
    mask = np.repeat(lengths > 1, lengths)
    symbols, lengths = symbols[mask].astype(np.int32), kept[alive]
    while len(alive):
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        ends = starts + lengths - 1
        ranks = np.full(len(symbols), NO_RANK, np.int32)
        ranks[:-1] = table.rank(symbols[:-1], symbols[1:])
        ranks[ends] = NO_RANK
        lowest = np.minimum.reduceat(ranks, starts)
        chosen = np.flatnonzero((ranks == np.repeat(lowest, lengths)) & (ranks != NO_RANK))
        if len(chosen):
            new_run = np.concatenate(([True], chosen[1:] != chosen[:-1] + 1))
            place = np.arange(len(chosen))
            chosen = chosen[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]
            symbols[chosen] = table.made[ranks[chosen]]
            gone = np.zeros(len(symbols), bool)
            gone[chosen + 1] = True
            lengths = lengths - np.add.reduceat(gone.astype(np.int64), starts)
            going = np.repeat((lowest != NO_RANK) & (lengths > 1), lengths)
            symbols = symbols[~gone]
        else:
            going = np.zeros(len(symbols), bool)
        kept[alive] = lengths
        stay = (lowest != NO_RANK) & (lengths > 1)
        symbols, alive, lengths = symbols[going], alive[stay], lengths[stay]
    return kept


class Counter:
    """Counts tokens of texts; one for each process and file."""

    _by_path: dict[str, "Counter"] = {}

    def __init__(self, path: str):
        self.table = RankTable(path)
        self.pre = library_tokenizer(path).pre_tokenizer
        self.special = re.compile("|".join(map(re.escape, self.table.special))) if self.table.special else None
        self.chunks = Chunks(self._chunks, "<i4")

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        counts = np.zeros(len(chunks), np.int64)
        pieces: list[str] = []
        owner: list[int] = []
        split = self.pre.pre_tokenize_str
        for i, chunk in enumerate(chunks):
            if chunk[chunk[:1] == " " :].isalpha() and PLAIN(chunk):
                pieces.append(shown(chunk))
                owner.append(i)
                continue
            parts = [chunk]
            if self.special and self.special.search(chunk):
                counts[i] = len(self.special.findall(chunk))
                parts = self.special.split(chunk)
            for part in parts:
                for piece, _ in split(part) if part else ():
                    pieces.append(piece)
                    owner.append(i)
        for lo in range(0, len(pieces), SEQUENCES):
            some = pieces[lo : lo + SEQUENCES]
            points = np.frombuffer("".join(some).encode("utf-32-le"), "<u4")
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            found = survivors(self.table.symbols[points], lengths, self.table)
            np.add.at(counts, np.array(owner[lo : lo + SEQUENCES], np.int64), found)
        raw = counts.astype("<i4").tobytes()
        return [raw[4 * i : 4 * i + 4] for i in range(len(chunks))]

    def __call__(self, texts: pa.Array) -> list[int]:
        return [int(x.sum()) for x in self.chunks(texts)]


KEPT.append(Counter._by_path)


def token_count(text: Column | str, path: str) -> Column:
    """A column with the number of tokens of ``text`` under the byte-level BPE file at ``path``; null counts 0.

    Special tokens inside a text count one each, as the library's default has it; none are added.
    """

    @F.arrow_udf(T.LongType())
    @tidied
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter.of(path)
        for batch in batches:
            yield pa.array(counter(batch), pa.int64())

    return count(F.col(text) if isinstance(text, str) else text)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to the rows of ``df``; no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Every row, repeated rows included, gets its own count; an empty
    table stays empty. Columns of the same names that ``df`` already has are replaced.
    """
    counted = df.withColumns({"n_bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long"), "n_tokens": token_count(text, path)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
