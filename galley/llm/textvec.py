"""Byte-level text vectors: words, hashes and windows of many texts at once, in NumPy.

A column of texts is an Arrow array; its UTF-8 buffer is cut into slices of about two
megabytes of whole texts, and everything below works on one slice, so memory stays a small
multiple of a slice whatever a batch holds (a single longer text forms a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

#: Bytes of white space: [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first n of eight bytes, for n = 0..8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """buf: the bytes of n texts one after another; off: n + 1 offsets; null: of each text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, null: np.ndarray):
        self.buf, self.off, self.null, self.n = buf, off, null, len(off) - 1

    def starts_of_texts(self) -> np.ndarray:
        return self.off[:-1][self.off[:-1] < self.off[1:]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and behind-last places of the runs of bytes that are inside, cut where a text begins."""
        if not len(self.buf):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        at = self.starts_of_texts()
        first[at] = inside[at]
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[at[1:] - 1] = inside[at[1:] - 1]
        return starts, np.flatnonzero(last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~IS_SPACE[self.buf])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the lines between \\n, and the text of each; an empty text has one empty line."""
        cut = np.flatnonzero(self.buf == 10)
        of = np.searchsorted(self.off, cut, "right") - 1
        starts = np.concatenate([self.off[:-1], cut + 1])
        text = np.concatenate([np.arange(self.n), of])
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:] - 1
        last = np.append(text[1:] != text[:-1], True) if self.n else np.zeros(0, bool)
        ends[last] = self.off[1:][text[last]]
        return starts, ends, text

    def text_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, starts, "right") - 1

    def _eights(self, fold: bool) -> np.ndarray:
        """The eight bytes that begin at each place (zeros behind the end) as one integer."""
        data = np.zeros(len(self.buf) + 16, np.uint8)
        data[: len(self.buf)] = FOLD[self.buf] if fold else self.buf
        return np.ndarray((len(self.buf) + 9,), "<u8", data, strides=(1,))

    def hashes(self, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
        """A 64-bit hash of each span of bytes; the spans may be empty, and may overlap.

        The sum of a bijective mix of each eight bytes and their place, which no repetitive text makes equal.
        """
        size, eights = ends - starts, self._eights(fold)
        out = mix((eights[starts] & _FIRST[np.minimum(size, 8)]) + _MUL) + size.astype(np.uint64) * _MUL
        long = np.flatnonzero(size > 8)
        if len(long):
            n = (size[long] - 1) >> 3
            at = np.cumsum(n) - n
            j = np.arange(1, int(n.sum()) + 1) - np.repeat(at, n)
            place = np.repeat(starts[long], n) + 8 * j
            rest = np.minimum(np.repeat(ends[long], n) - place, 8)
            out[long] += np.add.reduceat(mix((eights[place] & _FIRST[rest]) + mix(j.astype(np.uint64))), at)
        return mix(out)


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """The texts of the column in slices of whole texts, each with the row it begins at. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, Texts(data[off[row] : off[to]], off[row : to + 1] - off[row], null[row:to])
        row = to


def chain(hashes: np.ndarray, k: int, first: np.ndarray) -> np.ndarray:
    """A hash of hashes[i : i + k] for each i in first."""
    out = mix(hashes[first] + u64(k * int(_MUL)))
    for j in range(1, k):
        out = mix(out * _MUL + hashes[first + j])
    return out


def windows(text: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """The places in text (sorted) at which k equal entries follow each other."""
    m = len(text) - k + 1
    return np.flatnonzero(text[:m] == text[k - 1 :]) if m > 0 else np.zeros(0, np.int64)


def by_text(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """An order by text, then by key."""
    order = np.argsort(key)
    small = text[order].astype(np.uint16) if len(text) and text.max() < 65536 else text[order]
    return order[np.argsort(small, kind="stable")]


def shingles(texts: Texts, k: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct k-word windows of each text (a shorter text's words as one): text and hash, ordered by both; then a hash of each text's words."""
    starts, ends = texts.words()
    h, text = texts.hashes(starts, ends, fold), texts.text_of(starts)
    count = np.bincount(text, minlength=texts.n)
    begin = np.cumsum(count) - count
    at = windows(text, texts.n, k)
    keys, of = [chain(h, k, at)], [text[at]]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        keys.append(chain(h, n, begin[short]))
        of.append(short)
    key, of = np.concatenate(keys), np.concatenate(of)
    order = by_text(of, key)
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    place = (np.arange(len(h)) - np.repeat(begin, count)).astype(np.uint64)
    sums = np.zeros((texts.n, 2), np.uint64)
    full = np.flatnonzero(count)
    for j in range(2):
        if len(full):
            sums[full, j] = np.add.reduceat(mix(h + mix(place * np.uint64(2) + np.uint64(j)) * _MUL), begin[full])
    return of[new], key[new], sums
