"""Vectorised hashing of words, shingles and byte windows over Arrow texts.

All functions take a batch's UTF-8 bytes as one array with document offsets and
work in chunks of whole documents, so temporaries stay near ``CHUNK`` bytes
times a small factor (or the longest document's size).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessella.llm.common import portable

CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_rng = np.random.Generator(np.random.PCG64(7))
#: A random value for each byte, so that the polynomial's digits are not small.
DIGIT = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A second, well mixed hash of 64-bit values."""
    x = (x ^ np.uint64((seed * 0x632BE59BD9B4E019 + 0x1234567) & ((1 << 64) - 1))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        out = []
        for base in (_BASE, inverse):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            out.append(p[:size].copy())
        _powers[:] = out
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if len(column) == 0 or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents: (first, past last, bytes, offsets within them)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def prefix(b: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash; len(b) + 1 values."""
    p, _ = powers(len(b) + 1)
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(DIGIT[b] * p[: len(b)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes."""
    _, q = powers(len(pre))
    return mix((pre[ends] - pre[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_spans(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~IS_SPACE[b]
    first = np.zeros(len(b) + 1, bool)
    first[offsets] = True
    before = np.r_[False, inside[:-1]]
    after = np.r_[inside[1:], False]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and document of every word."""
    starts, ends, doc = word_spans(b, offsets)
    return span_hash(prefix(b), starts, ends), doc


_STEP = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(b: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each document the sorted distinct hashes of its n-word shingles (n up to 5).

    With fewer words the whole sequence is the one shingle; without words none.
    """
    h, doc = word_hashes(b, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    place = np.r_[0, np.cumsum(count)]
    s = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k in range(n):
        s += h[k : k + len(s)] * _STEP[k]
    s = mix(s, 3)
    out = []
    for i in range(len(count)):
        c, at = int(count[i]), int(place[i])
        if c >= n:
            v = np.sort(s[at : at + c - n + 1])
            out.append(v[np.r_[True, v[1:] != v[:-1]]] if len(v) > 1 else v)
        elif c:
            w = h[at : at + c]
            out.append(mix(np.array([sum(int(x) * int(_STEP[k]) for k, x in enumerate(w)) + c & ((1 << 64) - 1)], np.uint64), 4 + c))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


portable(__name__)
