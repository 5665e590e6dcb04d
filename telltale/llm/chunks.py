"""Cutting texts where every tokenizer here cuts too, so that work on repeated chunks is done once.

A plain space between two characters that are not white space always starts a new pre-token in the byte-level
pattern, and always separates pre-tokens in the lower-casing vocabulary. Text is cut there and nowhere else;
a chunk keeps the space before it. Other white space stays inside its chunk.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_ODD_SPACE = re.compile(r" \s|\s |^ | $")
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Chunks whose result a worker remembers; the first seen stay, which are mostly the frequent ones.
CACHE_ENTRIES = 400_000
#: Bytes of text handled at a time; a longer text is one slice.
SLICE_BYTES = 6_000_000
#: Below U+0250, but for one capital whose lower case is two characters, all libraries agree about letters and case.
PLAIN = re.compile("[\x00-\u012f\u0131-\u024f]*").fullmatch


def cut(text: str) -> list[str]:
    """The text's chunks without the space at which each of them, but the first, was cut off."""
    return _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")


#: What a worker keeps from task to task; it goes when another operator's task begins.
KEPT: list[dict] = []
_OWNER: list[str] = [""]


def tidied(run: Callable) -> Callable:
    """Keeps a worker small, as workers live on and share the executor's memory with others: what another operator kept is
    dropped when a task begins, and freed memory goes back to the system when it ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        if _OWNER[0] != run.__module__:
            for kept in KEPT:
                kept.clear()
            _OWNER[0] = run.__module__
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Parts of an array of about ``size`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


class Remembered:
    """Results by key; ``compute`` gets all unknown keys of a request at once."""

    def __init__(self, compute: Callable[[list[str]], list], entries: int = CACHE_ENTRIES):
        self.compute, self.entries, self.known = compute, entries, {}

    def __call__(self, keys: list[str]) -> list:
        """The results of distinct keys."""
        found = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            asked = [keys[i] for i in missing]
            results = self.compute(asked)
            for i, result in zip(missing, results, strict=True):
                found[i] = result
            room = max(0, self.entries - len(self.known))
            self.known.update(zip(asked[:room], results[:room]))
        return found


_EDGE_SPACE = r"^$|^[\s\v\x1c-\x1f\x85\p{Z}]|[\s\v\x1c-\x1f\x85\p{Z}]$"


class Chunks:
    """Numbers for each text of an array: those of its chunks, end to end.

    ``compute`` gives each of a list of chunks its numbers as bytes of ``kind``. Texts are split and their chunks numbered
    by Arrow, so only distinct chunks become Python strings. A full stop or comma after a letter is a chunk of its own;
    with ``lower``, chunks of letters alone are the same whatever the case of their ASCII letters.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], kind: str = "<u4", lower: bool = False, entries: int = CACHE_ENTRIES):
        self.kind, self.size, self.lower = np.dtype(kind), np.dtype(kind).itemsize, lower
        self.first = Remembered(compute, entries // 10)
        self.later = Remembered(lambda keys: compute([" " + x for x in keys]), entries)
        self.slice = min(SLICE_BYTES, 15 * entries)

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for part in slices(texts, self.slice):
            yield from self._slice(part)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """The stem's number of each word, the stems, and what follows the stem: 0 nothing, 1 a full stop, 2 a comma."""
        stop, comma = pc.ends_with(words, "."), pc.ends_with(words, ",")
        marked = np.flatnonzero(pc.or_(stop, comma).to_numpy(zero_copy_only=False))
        short = pc.utf8_slice_codeunits(words.take(pa.array(marked)), 0, -1)
        letter = pc.match_substring_regex(short, r"\p{L}$").to_numpy(zero_copy_only=False)
        tail = np.zeros(len(words), np.int64)
        tail[marked[letter]] = np.where(stop.to_numpy(zero_copy_only=False)[marked[letter]], 1, 2)
        stem = pc.replace_with_mask(words, pa.array(tail > 0), short.filter(pa.array(letter)))
        if self.lower:
            stem = pc.if_else(pc.utf8_is_alpha(stem), pc.ascii_lower(stem), stem)
        coded = stem.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), tail

    def _slice(self, part: pa.Array) -> Iterator[np.ndarray]:
        lists = pc.split_pattern(pc.fill_null(part.cast(pa.string()), ""), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        odd_word = pc.match_substring_regex(words, _EDGE_SPACE).to_numpy(zero_copy_only=False)
        odd = np.logical_or.reduceat(odd_word[at], offsets[:-1])
        leading = np.zeros(len(at), bool)
        leading[offsets[:-1]] = True
        used = np.flatnonzero((np.bincount(at[~leading], minlength=len(words)) > 0) & ~odd_word)
        first_at, first_place = np.unique(at[offsets[:-1]][~odd], return_inverse=True)
        stem_of, stems, tail = self._words(words)
        after = [b"", *self.first([".", ","])]
        table: list[bytes] = []
        for remembered, wanted in ((self.later, used), (self.first, first_at)):
            distinct, where = np.unique(stem_of[wanted], return_inverse=True)
            found = remembered([stems[i] for i in distinct.tolist()])
            table += [found[i] + after[t] for i, t in zip(where.tolist(), tail[wanted].tolist())]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.size
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), self.kind)
        place = np.full(len(words), -1, np.int64)
        place[used] = np.arange(len(used))
        code = place[at]
        code[offsets[:-1][~odd]] = len(used) + first_place
        code[np.repeat(odd, np.diff(offsets))] = -1
        lengths = np.where(code < 0, 0, sizes[code]) if len(sizes) else np.zeros(len(code), np.int64)
        ends = np.cumsum(lengths)
        source = np.repeat((starts[code] if len(starts) else code) - (ends - lengths), lengths)
        numbers = flat[source + np.arange(len(source))]
        bounds = np.concatenate(([0], ends[offsets[1:] - 1])) if len(ends) else [0]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield self._one(part[i].as_py() or "") if odd[i] else numbers[a:b]

    def _one(self, text: str) -> np.ndarray:
        chunks = cut(text)
        later = sorted(set(chunks[1:]))
        known = dict(zip(later, self.later(later)))
        return np.frombuffer(b"".join([self.first(chunks[:1])[0], *map(known.__getitem__, chunks[1:])]), self.kind)


def byte_table() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


_SHOWN = str.maketrans({chr(b): c for b, c in enumerate(byte_table())})


def shown(text: str) -> str:
    """The text's bytes as byte-level models see them."""
    if text.isascii() and text.isprintable():
        return text.replace(" ", _SHOWN[0x20])
    return text.encode().decode("latin-1").translate(_SHOWN)


_LOADED: dict[str, object] = {}
KEPT.append(_LOADED)


def library_tokenizer(path: str):
    """The tokenizer of a .json file, loaded once in each process."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


class LibraryIds:
    """Ids of texts by the tokenizers library, as unsigned 4-byte numbers.

    Unknown chunks are split as the file's own pattern splits them, and the library's model encodes the unknown pre-tokens
    among them; a chunk that may hold a special token, or characters about which libraries differ, goes through all of
    the library's own steps.
    """

    _by_path: dict[tuple[str, int], "LibraryIds"] = {}

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import json

        import regex

        self.tokenizer = library_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec["pre_tokenizer"]]
        pattern = next((x["pattern"]["Regex"] for x in steps if x["type"] == "Split"), None)
        self.lower = "Lowercase" in [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.find = regex.compile(pattern or BYTE_LEVEL).findall
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.pieces = Remembered(self._encode, entries // 4)
        self.chunks = Chunks(self._chunks, lower=self.lower, entries=entries)

    @classmethod
    def of(cls, path: str, entries: int = CACHE_ENTRIES) -> "LibraryIds":
        if (path, entries) not in cls._by_path:
            cls._by_path[path, entries] = cls(path, entries)
        return cls._by_path[path, entries]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(shown(x))]).tobytes() for x in pieces]

    def _whole(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(chunks), 20_000):
            out.extend(array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(chunks[lo : lo + 20_000], add_special_tokens=False))
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        letters = [i for i, x in enumerate(chunks) if x[x[:1] == " " :].isalpha() and (x.isascii() or PLAIN(x))]
        cased = [chunks[i].lower().lstrip(" ") for i in letters] if self.lower else [chunks[i] for i in letters]
        out = dict(zip(letters, self._encode(cased)))
        rest = [(i, x) for i, x in enumerate(chunks) if i not in out]
        whole = [i for i, x in rest if not (x.isascii() or PLAIN(x)) or any(s in x for s in self.special)]
        out.update(zip(whole, self._whole([chunks[i] for i in whole])))
        split = {i: self.find(x.lower() if self.lower else x) for i, x in rest if i not in out}
        distinct = list(dict.fromkeys(p for ps in split.values() for p in ps))
        known = dict(zip(distinct, self.pieces(distinct)))
        return [out[i] if i in out else b"".join([known[p] for p in split[i]]) for i in range(len(chunks))]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        return self.chunks(texts)


KEPT.append(LibraryIds._by_path)
#: Fixed value: how byte-level files split text that name no pattern.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
