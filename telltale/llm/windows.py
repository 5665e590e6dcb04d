"""Words, rolling hashes and content-defined anchors of whole Arrow slices, as flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .chunks import KEPT

_U = np.uint64
#: An odd number and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}
KEPT.append(_POWERS)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64, at least ``n`` of them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.full(size, base, _U)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scatters 64-bit values."""
    x = x ^ _U(seed)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers; ``between`` reads the hash of any stretch from them."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values.astype(_U) * powers(BASE, len(values) + 1)[: len(values)], out=out[1:])
    return out


def between(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from ``starts`` to ``ends``, alike for like values wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts] + (ends - starts).astype(_U))


@dataclass
class Flat:
    """The bytes of an array of texts, end to end; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray


def flat(texts: pa.Array) -> Flat:
    filled = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    if isinstance(filled, pa.ChunkedArray):
        filled = filled.combine_chunks()
    offsets = np.frombuffer(filled.buffers()[1], np.int32, len(filled) + 1, filled.offset * 4).astype(np.int64)
    buffer = filled.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return Flat(data[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Words:
    """Starts and ends of all words in the bytes, the first word of each text, and a hash of each word."""

    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    hashes: np.ndarray


def lowered(texts: Flat) -> Flat:
    """The same with ASCII letters in lower case."""
    return Flat(_ASCII_LOWER[texts.data], texts.offsets)


def words(texts: Flat, letters: np.ndarray | None = None) -> Words:
    """Runs of bytes that aren't white space, or of those that ``letters`` marks."""
    data = texts.data
    inside = ~_SPACE[data] if letters is None else letters[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    bounds = texts.offsets[:-1][texts.offsets[:-1] < len(data)]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = texts.offsets[1:][texts.offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.offsets), between(prefix(data), starts, ends))


def joined(texts: Flat, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' bytes with one space after each, and where each word starts and ends in them: what a stretch of words is,
    whatever white space stood between them."""
    sizes = found.ends - found.starts + 1
    ends = np.cumsum(sizes)
    out = texts.data[np.minimum(np.repeat(found.starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0), len(texts.data) - 1)]
    out[ends - 1] = 0x20
    return out, ends - sizes, ends - 1


@dataclass
class Anchors:
    """For each anchor: its text, its hash, and within the text the first and the last window (by their starts) it stands for
    and its own place.

    Of all grams in a window the one of the smallest hash, the leftmost among equals, is the window's anchor. So equal windows
    have anchors of equal hashes at equal places, and each window belongs to one anchor. Unequal grams of one hash do no harm:
    an anchor only says what is to be compared.
    """

    text: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray


#: Windows whose anchors are found at a time: bounds the memory whatever the length of a text.
BLOCK = 1 << 18


def anchors(values: np.ndarray, firsts: np.ndarray, window: int, gram: int) -> Anchors:
    """Anchors of all windows of ``window`` values; text ``i`` is ``values[firsts[i]:firsts[i + 1]]``."""
    parts = [_block(values[lo : lo + BLOCK + window - 1], firsts, lo, window, gram) for lo in range(0, max(0, len(values) - window + 1), BLOCK)]
    none = np.zeros(0, np.int64)
    text, hashes, first, last, place = [np.concatenate(x) for x in zip(*parts)] if parts else [none] * 5
    if len(parts) > 1:  # an anchor may go on in the next block
        more = np.zeros(len(text), bool)
        more[1:] = (text[1:] == text[:-1]) & (place[1:] == place[:-1]) & (first[1:] == last[:-1] + 1)
        head = np.flatnonzero(~more)
        tail = np.concatenate((head[1:], [len(text)])) - 1
        text, hashes, first, last, place = text[head], hashes[head], first[head], last[tail], place[head]
    return Anchors(text, hashes.astype(_U), first, last, place)


def _block(values: np.ndarray, firsts: np.ndarray, lo: int, window: int, gram: int) -> tuple[np.ndarray, ...]:
    width = window - gram + 1
    sums = prefix(values)
    at = np.arange(len(values) - gram + 1)
    grams = between(sums, at, at + gram)
    low, where = grams, at
    span = 1
    while span < width:  # low[i], where[i]: the smallest of the span grams from i on
        step = min(span, width - span)
        keep = len(low) - step
        take = low[step:] < low[:keep]
        low, where = np.where(take, low[step:], low[:keep]), np.where(take, where[step:], where[:keep])
        span += step
    starts = np.arange(len(low)) + lo
    owner = np.searchsorted(firsts, starts, "right") - 1
    valid = np.flatnonzero(starts + window <= firsts[np.minimum(owner + 1, len(firsts) - 1)])
    p, o = where[valid], owner[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(valid)])) - 1
    first, last, text = valid[head], valid[tail], o[head]
    base = firsts[text] - lo
    return text, grams[p[head]], first - base, last - base, p[head] - base
