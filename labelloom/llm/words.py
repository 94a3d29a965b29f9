"""Words of a batch of texts as numpy arrays: byte ranges and 64-bit hashes.

Texts stay in the Arrow buffer they came in. Word hashes add one random value per byte and place,
so they are formed by whole-array operations; a window's hash is a polynomial in its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
PLACES = 64
GOLDEN = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xD6E8FEB86659FD93

_bytes = np.arange(256)
#: Words between ASCII blanks.
VISIBLE = ~np.isin(_bytes, np.frombuffer(b" \t\n\x0b\f\r", np.uint8))
#: Runs of ASCII letters, digits and all characters beyond ASCII.
ALPHANUMERIC = ((_bytes >= 0x30) & (_bytes <= 0x39) | (_bytes >= 0x41) & (_bytes <= 0x5A)
                | (_bytes >= 0x61) & (_bytes <= 0x7A) | (_bytes >= 0x80))
SAME_CASE = _bytes.astype(np.uint8)
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACE_VALUES = mix(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(GOLDEN))


class Words(NamedTuple):
    """Words of consecutive texts; word i of text d is start[first[d] + i] .. end[first[d] + i]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.start))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary Arrow array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    wide = pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = at.astype(np.int64)
    return raw[at[0]:at[-1]], at - at[0]


def split_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = VISIBLE) -> Words:
    """Byte ranges of the words; a word never spans two texts."""
    member = inside[data]
    begin, last = member.copy(), member.copy()
    begin[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    borders = offsets[1:-1]
    starts = borders[borders < len(data)]
    begin[starts] = member[starts]
    ends = borders[borders > 0] - 1
    last[ends] = member[ends]
    start = np.flatnonzero(begin)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, words: Words, case: np.ndarray = SAME_CASE) -> np.ndarray:
    """64-bit hash of every word, formed block by block so that memory stays bounded."""
    lengths = words.end - words.start
    total = np.cumsum(lengths)
    out = np.empty(len(lengths), np.uint64)
    at = 0
    while at < len(lengths):
        base = total[at - 1] if at else 0
        to = max(int(np.searchsorted(total, base + BLOCK_BYTES, "right")), at + 1)
        size = lengths[at:to]
        before = total[at:to] - size - base
        place = np.arange(int(total[to - 1] - base), dtype=np.int64) - np.repeat(before, size)
        byte = case[data[place + np.repeat(words.start[at:to], size)]]
        value = _PLACE_VALUES[(place & (PLACES - 1)) * 256 + byte]
        if size.max() > PLACES:
            value = value * ((place >> 6).astype(np.uint64) * np.uint64(2 * GOLDEN & (2**64 - 1)) + np.uint64(1))
        out[at:to] = np.add.reduceat(value, before) + size.astype(np.uint64)
        at = to
    return mix(out)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on; the last width - 1 entries are meaningless."""
    out = np.zeros_like(hashes)
    done, doubled, size, rest = 0, hashes, 1, width
    while rest:
        if rest & 1:
            out = doubled + power(size) * _shift(out, size) if done else doubled
            done += size
        rest >>= 1
        if rest:
            doubled = doubled + power(size) * _shift(doubled, size)
            size *= 2
    return mix(out ^ np.uint64(width * GOLDEN & (2**64 - 1)))


def power(exponent: int) -> np.uint64:
    return np.uint64(pow(WINDOW_BASE, exponent, 2**64))


def _shift(values: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(values)
    if by < len(values):
        out[:-by] = values[by:]
    return out


def slices(texts: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    _, offsets = buffers(texts)
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1, at + 1)
        yield at, to
        at = to
