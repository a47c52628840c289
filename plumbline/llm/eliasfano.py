"""Elias-Fano sequences and memory-mapped files of arrays, searched a whole array of keys at a time."""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.fs

_U = np.uint64
_EACH, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the k-th one of a byte.
_BYTE_SELECT = np.zeros((256, 8), np.uint8)
for _i in range(256):
    for _k, _p in enumerate(p for p in range(8) if _i >> p & 1):
        _BYTE_SELECT[_i, _k] = _p


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another, each aligned, behind a header that names them."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    at, head = 0, {}
    for k, v in arrays.items():
        head[k] = (v.dtype.str, at, len(v))
        at += -(-v.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    with fs.open_output_stream(path) as f:
        f.write(np.uint64(len(text)).tobytes() + text)
        for v in arrays.values():
            f.write(np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 64))


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, as views of its memory map (read whole where the file system has no maps)."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
    data = np.frombuffer(source.read_buffer(source.size()), np.uint8)
    n = int(data[:8].view(np.uint64)[0])
    head = json.loads(data[8 : 8 + n].tobytes())
    return {k: data[8 + n + at : 8 + n + at + np.dtype(kind).itemsize * size].view(kind) for k, (kind, at, size) in head.items()}


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of ``width`` bits, end to end."""
    if not width:
        return np.zeros(1, _U)
    bit = np.arange(len(values), dtype=_U) * _U(width)
    out = np.zeros(len(values) * width // 64 + 2, _U)
    word, off = (bit >> _U(6)).astype(np.int64), bit & _U(63)
    np.bitwise_or.at(out, word, values << off)
    over = np.flatnonzero(off + _U(width) > 64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - off[over]))
    return out


class EliasFano:
    """A sorted sequence of 64-bit numbers in about 2 + log2(universe / n) bits each.

    High parts are a unary bit vector with sampled counts of ones; low parts are packed.
    """

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.high, self.ones, self.low, meta = (arrays[f"{name}.{x}"] for x in ("high", "ones", "low", "meta"))
        self.n, self.width = int(meta[0]), int(meta[1])
        # zeros before each word of the bit vector
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    @staticmethod
    def build(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        values = values.astype(_U)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, int(math.floor(math.log2((top + 1) / n)))) if n and top + 1 > n else 0
        high = (values >> _U(width)).astype(np.int64)
        place = high + np.arange(n)
        size = (int(place[-1]) + 2 if n else 1) // 64 + 2
        bits = np.zeros(size, _U)
        np.bitwise_or.at(bits, place >> 6, _U(1) << (place & 63).astype(_U))
        ones = np.concatenate([[0], np.cumsum(np.bincount(place >> 6, minlength=size))])[:-1].astype(np.int64)
        low = pack(values & _U((1 << width) - 1), width)
        return {f"{name}.high": bits, f"{name}.ones": ones, f"{name}.low": low, f"{name}.meta": np.array([n, width], np.int64)}

    def _select(self, k: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the k-th one (or zero, with ``flip``)."""
        word = np.searchsorted(before, k, "right") - 1
        x = self.high[word]
        x = ~x if flip else x
        rest = (k - before[word]).astype(_U)
        # running counts of ones by byte, eight in a number; then the byte in which the count passes the rest
        c = x - ((x >> _U(1)) & _U(0x5555555555555555))
        c = (c & _U(0x3333333333333333)) + ((c >> _U(2)) & _U(0x3333333333333333))
        c = ((c + (c >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _EACH
        passed = ((rest * _EACH | _TOPS) - c) & _TOPS
        shift = np.minimum(((passed >> _U(7)) * _EACH) >> _U(56), _U(7)) * _U(8)
        rest = np.clip(rest - (((c << _U(8)) >> shift) & _U(255)), 0, 7)
        return word * 64 + shift.astype(np.int64) + _BYTE_SELECT[(x >> shift) & _U(255), rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        bit = i.astype(_U) * _U(self.width)
        word, off = (bit >> _U(6)).astype(np.int64), bit & _U(63)
        out = (self.low[word] >> off) | np.where(off > 0, self.low[word + 1] << ((_U(64) - off) & _U(63)), _U(0))
        return out & _U((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, self.ones, False) - i).astype(_U) << _U(self.width)) | self._low(i)

    def _between(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the places (first, one past the last) of the numbers with its high part; n and n beyond the last."""
        h = (x >> _U(self.width)).astype(np.int64)
        last = int(self.zeros[-1]) + 64 - int(bin(int(self.high[-1])).count("1"))  # zeros in all
        inside = (h >= 0) & (h < last - 1)  # numbers of 64 bits may come out negative
        hh = np.where(inside, h, 0)
        # numbers of high part h lie between the zeros h - 1 and h; the second is mostly in what is left of the word
        start = np.where(hh > 0, self._select(np.maximum(hh - 1, 0), self.zeros, True) + 1, 0)
        free = ~self.high[start >> 6] >> (start & 63).astype(_U)
        end = start + np.bitwise_count(~free & (free - _U(1)))
        far = np.flatnonzero(free == 0)
        end[far] = self._select(hh[far], self.zeros, True)
        return np.where(inside, np.minimum(start - hh, self.n), self.n), np.where(inside, np.minimum(end - hh, self.n), self.n)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the first place whose number is x or more (n if none), and the end of the numbers with its high part."""
        low, high = self._between(x)
        end, want = high.copy(), x & _U((1 << self.width) - 1)
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            less = self._low(mid) < want[live]
            low[live[less]] = mid[less] + 1
            high[live[~less]] = mid[~less]
            live = live[low[live] < high[live]]
        return low, end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the first place whose number is x or more (n if none)."""
        return self._search(x)[0] if self.n else np.zeros(len(x), np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, -1 where it is not in the sequence. Distinct ones are searched in order, which goes through memory once."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        kinds, back = np.unique(x, return_inverse=True)
        at, end = self._search(kinds)
        # below the end, the high part is that of x
        ok = np.flatnonzero(at < end)
        hit = ok[self._low(at[ok]) == kinds[ok] & _U((1 << self.width) - 1)]
        out = np.full(len(kinds), -1, np.int64)
        out[hit] = at[hit]
        return out[back]
