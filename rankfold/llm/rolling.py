"""Vectorised words and window hashes over the bytes of Arrow string columns.

Texts stay in their Arrow buffer: words are found with byte masks and hashed eight bytes at a time
through a non-linear mixing step (so words of eight bytes or fewer never collide with others of
their length), words of over LONG bytes by XXH3.  A window's hash chains the hashes of its words
through such steps too, so that no algebraic relation between words carries over to windows.  No
Python object is made for a word, except for the long ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from .common import LOWER, UPPER

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.frombuffer(bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())), np.uint8)
#: Bytes of text that a worker handles at a time; its arrays take about 60 bytes for each.
SLICE = 1 << 19


#: Bytes above which a word is hashed by XXH3.
LONG = 256
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def mix(h: np.ndarray, first: int = 0x7FB5D329728EA185, then: int = 0x81DADEF4BC2DD44D) -> np.ndarray:
    """A bijection of 64-bit numbers, one for each pair of odd multipliers."""
    h = (h ^ (h >> U64(31))) * U64(first)
    h = (h ^ (h >> U64(27))) * U64(then)
    return h ^ (h >> U64(33))


def chain(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash for every run of `width` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = ids[:n].copy()
    for k in range(1, width):
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h += ids[k : k + n]
    return mix(h)


def sliding(h: np.ndarray, width: int, what) -> np.ndarray:
    """what (np.minimum or np.maximum) over each window of `width`, in about log2(width) steps."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out, have = what(out[: len(out) - step], out[step:]), have + step
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_slices(column: pa.Array, most: int = SLICE):
    """(first row, bytes, offsets) of runs of rows with about `most` bytes; a longer text runs alone."""
    data, offsets = column_bytes(column)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        stop = min(stop, len(column))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_slices(column: pa.Array, width: int, most: int = SLICE, lower: bool = False):
    """(first row, words, skipped) of text_slices(), but a text longer than `most` comes in pieces.

    Pieces overlap by width - 1 words, so each window of `width` is in exactly one; `skipped` is the
    number of words of the text before the piece.
    """
    for row, data, offsets in text_slices(column, most):
        if lower:
            data = LOWERED[data]
        if len(data) <= most:
            yield row, find_words(data, offsets), 0
            continue
        at, size, skipped = 0, most, 0
        while True:
            stop = at + size
            if stop < len(data):  # up to the end of the word that is cut
                gap = np.flatnonzero(SPACE[data[stop : stop + most]])
                while not len(gap) and stop + most < len(data):
                    stop += most
                    gap = np.flatnonzero(SPACE[data[stop : stop + most]])
                stop = stop + int(gap[0]) if len(gap) else len(data)
            part = data[at : min(stop, len(data))]
            words = find_words(part, np.array([0, len(part)]))
            if stop < len(data) and len(words.starts) < width:
                size *= 2  # few, long words: take more of the text
                continue
            yield row, words, skipped
            if stop >= len(data):
                break
            skipped += len(words.starts) - (width - 1)
            at, size = at + (int(words.starts[1 - width]) if width > 1 else len(part)), most


@dataclass
class Words:
    starts: np.ndarray  # bytes
    stops: np.ndarray
    doc: np.ndarray  # row in the slice
    counts: np.ndarray  # words of each row
    first: np.ndarray  # index of each row's first word
    data: np.ndarray

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of every word, by unlike functions."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, U64), np.zeros(0, U64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        # Every place of the text as the eight bytes from there on.
        eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        size = self.stops - self.starts
        one, two = size.astype(U64) * U64(0x9E3779B97F4A7C15), size.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(1)
        at, k = np.flatnonzero(size <= LONG), 0
        while len(at):
            left = size[at] - k
            part = eights[self.starts[at] + k] & MASKS[np.minimum(left, 8)]
            one[at] = mix(one[at] ^ part)
            two[at] = mix(two[at] + part, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
            at, k = at[left > 8], k + 8
        for i in np.flatnonzero(size > LONG).tolist():
            one[i], two[i] = np.frombuffer(xxhash.xxh3_128_digest(self.data[self.starts[i] : self.stops[i]].tobytes()), U64)
        return one, two

    def inside(self, width: int) -> np.ndarray:
        """For every start of `width` words in the slice, whether the window stays in its row."""
        n = max(0, len(self.starts) - width + 1)
        return self.doc[:n] == self.doc[width - 1 : width - 1 + n]


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    solid = ~SPACE[data]
    n = len(data)
    opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    opens[offsets] = True
    closes[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | opens[1:n]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | closes[1:n]
    starts, stops = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets[1:], starts, "right")
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    return Words(starts, stops, doc, counts, np.cumsum(counts) - counts, data)


def shingle_sets(column: pa.Array, shingle: int, most: int = SLICE):
    """For each text, in order, the sorted distinct hashes of its runs of `shingle` words, A-Z lower-cased.

    A text of fewer words, but not none, has one: that of the whole.
    """
    parts: list = []
    for _, words, skipped in word_slices(column, shingle, most, lower=True):
        ids = words.hashes()[0]
        runs = chain(ids, shingle)
        for k, (first, n) in enumerate(zip(words.first.tolist(), words.counts.tolist(), strict=True)):
            own = np.unique(runs[first : first + n - shingle + 1]) if n > shingle else chain(ids[first : first + n], max(1, n))
            if skipped and not k:
                parts.append(own)  # a further piece of the text before
                continue
            if parts:
                yield np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            parts = [own]
    if parts:
        yield np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
