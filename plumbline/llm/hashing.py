"""Words of whole batches of texts as 64-bit hashes, without a Python object per word.

A word's hash is a polynomial over its bytes, taken from running sums over the
batch, so all words of a batch cost a few array passes. Words are runs of anything
but ASCII white space, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xA0761D6478BD642F))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if len(_powers[0]) <= n:
        size = 1 << int(n).bit_length()
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, _U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


class Words:
    """The words of a batch: ``doc`` (which text), ``start``, ``end`` (in ``data``, lower-cased), ``hash``."""

    def __init__(self, texts: pa.Array):
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        at = at - at[0]
        self.n_docs, self.at, self.data = len(texts), at, _LOWER[raw]
        n = len(raw)
        solid = ~_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~solid[:-1]
            after[-1], after[:-1] = True, ~solid[1:]
        self.start = np.flatnonzero(solid & (before | edge[:n]))
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.doc = np.searchsorted(at, self.start, "right") - 1
        power, inverse = _tables(n)
        sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTES[self.data] * power[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * inverse[self.start] + (self.end - self.start).astype(_U))
        #: First word of each text, and one past the last.
        self.first = np.searchsorted(self.start, at)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def joined(self, which: np.ndarray) -> str:
        """These words, each between single spaces."""
        size = self.end[which] - self.start[which]
        out = np.full(int(size.sum()) + len(which) + 1, 32, np.uint8)
        to = np.cumsum(size + 1) - size  # where each word goes
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + step] = self.data[np.repeat(self.start[which], size) + step]
        return out.tobytes().decode("utf-8")


def portions(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text; a longer text goes alone."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    sizes = np.frombuffer(texts.cast(pa.large_string()).buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low = 0
    while low < len(texts):
        high = max(int(np.searchsorted(sizes, sizes[low] + limit, "right")) - 1, low + 1)
        yield batch.slice(low, high - low)
        low = high


def distinct_words(words: Words) -> tuple[str, np.ndarray, np.ndarray]:
    """The batch's distinct words as text, and its distinct (text, word) pairs."""
    _, index, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    n = max(len(index), 1)
    pair = np.unique(words.doc * n + inverse) if len(inverse) else np.empty(0, np.int64)
    return words.joined(index), pair // n, pair % n


def word_grams(spaced: str, lengths: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all character n-grams of the words in " w0 w1 ... "; a space marks a word's ends. ``buckets`` is a power of two."""
    chars = np.frombuffer(spaced.encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = chars == 32
    word = np.cumsum(space) - 1  # a space belongs to the word after it
    owners, out = [], []
    for n in lengths:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        inner = np.zeros(m, bool)
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + chars[j : j + m]
            if 0 < j < n - 1:
                inner |= space[j : j + m]
        keep = np.flatnonzero(~inner)
        owners.append(word[keep])
        out.append((mix(h[keep]) & np.uint64(buckets - 1)).astype(np.int64))
    return (np.concatenate(owners), np.concatenate(out)) if owners else (np.empty(0, np.int64), np.empty(0, np.int64))
