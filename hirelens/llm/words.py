"""Word hashes and rolling hashes of word windows, a batch of texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Base of the rolling hash (odd, so it has an inverse modulo 2^64).
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes modulo 2^64 of every window of a row of word hashes."""

    def __init__(self) -> None:
        self.up, self.down = self._powers(BASE, 1024), self._powers(_INVERSE, 1024)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def reach(self, n: int) -> None:
        if n >= len(self.up):
            self.up, self.down = self._powers(BASE, n + n // 4 + 1), self._powers(_INVERSE, n + n // 4 + 1)

    def windows(self, row: np.ndarray, *lengths: int) -> list[np.ndarray]:
        """For each length, the hash of the window that starts at each place."""
        self.reach(len(row))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(row * self.up[: len(row)], dtype=np.uint64)])
        return [mixed((sums[k:] - sums[:-k]) * self.down[: len(sums) - k]) if len(row) >= k else np.zeros(0, np.uint64)
                for k in lengths]


def sliding(op: np.ufunc, row: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``width`` consecutive places."""
    out, have = row, 1
    while have < width:
        step = min(have, width - have)
        out, have = op(out[:-step], out[step:]), have + step
    return out


#: Bytes hashed at once.
_CHUNK = 1 << 22
_SOLID = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


class WordHashes:
    """64-bit hashes (XXH3 of the bytes) of the words (runs without ASCII white space)
    of string columns; each distinct word of a chunk is hashed once."""

    def __init__(self, lower: bool = False):
        self.lower, self.rolling = lower, Rolling()

    def _chunk(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in ``raw``, texts being [begin, end), and words per text."""
        solid = _SOLID[raw]
        before, after = np.append(False, solid[:-1]), np.append(solid[1:], False)
        full = end > begin
        before[begin[full]] = False
        after[end[full] - 1] = False
        first, last = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        counts = np.searchsorted(first, end) - np.searchsorted(first, begin)
        if not len(first):
            return np.zeros(0, np.uint64), counts
        # The words alone, end to end: a string column without a copy of each word.
        packed = (_LOWER[raw] if self.lower else raw)[solid]
        places = np.concatenate([[0], np.cumsum(last - first)])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(packed)])
        found = found.dictionary_encode()
        digest = xxhash.xxh3_64_intdigest
        hashes = np.fromiter((digest(w) for w in found.dictionary.to_pylist()), np.uint64, len(found.dictionary))
        return hashes[found.indices.to_numpy()], counts

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words in one row, and the number of words of each text."""
        column = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
        rows, counts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
            base = offsets[at]
            row, count = self._chunk(raw[base : offsets[to]], offsets[at:to] - base, offsets[at + 1 : to + 1] - base)
            rows.append(row)
            counts.append(count)
            at = to
        return np.concatenate(rows), np.concatenate(counts)
