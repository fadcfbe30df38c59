"""Vectorised numpy kernels over the bytes of a batch of texts.

Every function works on whole Arrow batches: the texts of a batch are one byte
buffer, words are index ranges in it, and no Python object is made per word.
All arithmetic on hashes is modulo 2**64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
# An odd 64-bit multiplier for byte polynomials, two for word polynomials.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1

# ASCII space characters: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BYTE_BASE ** i and its inverse for i < n; kept between batches and grown by doubling."""
    have = len(_powers.get("up", ()))
    if have < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", BYTE_BASE), ("down", pow(BYTE_BASE, -1, 1 << 64))):
            out = np.empty(size, dtype=U64)
            out[0] = 1
            filled = 1
            while filled < size:
                step = U64(pow(base, filled, 1 << 64))
                with np.errstate(over="ignore"):
                    out[filled : 2 * filled] = out[:filled] * step
                filled *= 2
            _powers[name] = out
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The space-separated words of a batch: ``start`` and ``end`` in ``raw``; words of row r are ``first[r]:first[r + 1]``."""

    def __init__(self, raw: np.ndarray, rows: np.ndarray):
        solid = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, dtype=bool)
        if len(raw):
            edge[0] = solid[0]
            edge[1:-1] = solid[1:] & ~solid[:-1]
            inner = rows[1:-1]
            inner = inner[inner < len(raw)]
            edge[inner] = solid[inner]
            stop = np.zeros(len(raw) + 1, dtype=bool)
            stop[1:-1] = solid[:-1] & ~solid[1:]
            stop[-1] = solid[-1]
            before = inner[inner > 0]
            stop[before] |= solid[before - 1]
            self.start, self.end = np.flatnonzero(edge), np.flatnonzero(stop)
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.raw, self.solid = raw, solid
        self.first = np.searchsorted(self.start, rows).astype(np.int64)
        self.first[-1] = len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, U64)
        up, down = _power_table(len(self.raw) + 1)
        with np.errstate(over="ignore"):
            sums = np.empty(len(self.raw) + 1, U64)
            sums[0] = 0
            np.cumsum((self.raw.astype(U64) + U64(1)) * up[: len(self.raw)], out=sums[1:])
            h = (sums[self.end] - sums[self.start]) * down[self.start]
            return mix(h + (self.end - self.start).astype(U64) * U64(WORD_BASES[1]))


def grams(h: np.ndarray, k: int, base: int = WORD_BASES[0]) -> np.ndarray:
    """Hash of each k consecutive values of the batch (rows are not told apart): a polynomial, mixed."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, width = None, 0
    block, size = h, 1
    bits = k
    with np.errstate(over="ignore"):
        while bits:
            if bits & 1:
                if out is None:
                    out, width = block, size
                else:
                    m = len(h) - (width + size) + 1
                    out = out[:m] * U64(pow(base, size, 1 << 64)) + block[width : width + m]
                    width += size
            bits >>= 1
            if bits:
                m = len(h) - 2 * size + 1
                block = block[:m] * U64(pow(base, size, 1 << 64)) + block[size : size + m]
                size *= 2
    return mix(out[:n])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    out, size = h, 1
    while size < w:
        step = min(size, w - size)
        m = len(out) - step
        if m <= 0:
            return out[:0]
        out = np.minimum(out[:m], out[step : step + m])
        size += step
    return out


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows_within(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which positions start a run of ``size`` words that stays in one row."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left >= size


def chunks(column, max_bytes: int = 1 << 19):
    """Row ranges of a string column that hold about ``max_bytes`` each (one longer row stands alone), as (low, raw, offsets)."""
    raw, rows = buffers(column)
    low, n = 0, len(rows) - 1
    while low < n:
        high = int(np.searchsorted(rows, rows[low] + max_bytes, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, raw[rows[low] : rows[high]], rows[low : high + 1] - rows[low]
        low = high


# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range ``raw[start:end]``; ranges of one length are hashed together."""
    out = np.empty(len(start), U64)
    if not len(start):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    at4 = np.ndarray((len(raw) + 1,), "<u4", padded, 0, (1,))
    size = end - start
    order = np.argsort(size, kind="stable")
    lengths, begin = np.unique(size[order], return_index=True)
    with np.errstate(over="ignore"):
        for length, a, b in zip(lengths.tolist(), begin.tolist(), [*begin.tolist()[1:], len(order)], strict=True):
            who = order[a:b]
            s = start[who]
            o = 0
            if length >= 32:
                acc = [np.full(len(s), v, U64) for v in ((U64(seed) + _P1 + _P2), (U64(seed) + _P2), U64(seed), (U64(seed) - _P1))]
                while o + 32 <= length:
                    for i in range(4):
                        acc[i] = _rotl(acc[i] + at8[s + (o + 8 * i)] * _P2, 31) * _P1
                    o += 32
                h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
                for v in acc:
                    h = (h ^ (_rotl(v * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(s), U64(seed) + _P5, U64)
            h = h + U64(length)
            while o + 8 <= length:
                h = _rotl(h ^ (_rotl(at8[s + o] * _P2, 31) * _P1), 27) * _P1 + _P4
                o += 8
            if o + 4 <= length:
                h = _rotl(h ^ (at4[s + o].astype(U64) * _P1), 23) * _P2 + _P3
                o += 4
            while o < length:
                h = _rotl(h ^ (raw[s + o].astype(U64) * _P5), 11) * _P1
                o += 1
            h = (h ^ (h >> U64(33))) * _P2
            h = (h ^ (h >> U64(29))) * _P3
            out[who] = h ^ (h >> U64(32))
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def respace(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the (kept) words, one space after each, and where each of them starts and ends there."""
    start, end = (words.start, words.end) if keep is None else (words.start[keep], words.end[keep])
    size = end - start
    tail = np.cumsum(size + 1) - 1
    where = tail - size
    total = int(tail[-1]) + 1 if len(tail) else 0
    out = np.full(total, 0x20, np.uint8)
    letter = np.ones(total, dtype=bool)
    letter[tail] = False
    if keep is None:
        out[letter] = words.raw[words.solid]
    else:
        inside = np.zeros(len(words.raw) + 1, np.int8)
        inside[start] += 1
        inside[end] -= 1
        out[letter] = words.raw[np.cumsum(inside[:-1]).astype(bool)]
    return out, where, tail


def simhash64(raw: np.ndarray, rows: np.ndarray, width: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each row over its ``width``-word shingles; a row without words has 0."""
    raw = _LOWER[raw]
    words = Words(raw, rows)
    n = words.counts
    out = np.zeros(len(n), U64)
    if not len(words.start):
        return out
    spaced, where, tail = respace(words)
    shingles = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), shingles)
    ordinal = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    low = words.first[:-1][row] + ordinal
    high = np.minimum(low + width, words.first[1:][row]) - 1
    h = xxh64(spaced, where[low], tail[high], seed)
    has = np.flatnonzero(shingles)
    begin = (np.cumsum(shingles) - shingles)[has]
    total = np.empty((len(has), 64), np.int64)
    step = 1 << 16
    if len(h) <= step:
        total[:] = np.add.reduceat(_bits(h), begin, axis=0, dtype=np.int64)
    else:
        for i, (a, m) in enumerate(zip(begin.tolist(), shingles[has].tolist(), strict=True)):
            total[i] = sum(_bits(h[x : min(x + step, a + m)]).sum(axis=0, dtype=np.int64) for x in range(a, a + m, step))
    ones = total * 2 > shingles[has][:, None]
    out[has] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8), bitorder="little").reshape(len(h), 64)
