"""Vectorised word hashing over the UTF-8 buffers of Arrow text columns.

Texts are handled as bytes: the separators of both word rules used here are
ASCII, and no byte of a multi-byte character is ASCII, so byte and code-point
word boundaries agree.  A batch is cut into slices of bounded size, so memory
follows the slice (or the longest single text), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import worker

#: Bytes of text handled at a time.
SLICE_BYTES = 500_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.ones(256, np.uint8)
    for low, high in ranges:
        table[low : high + 1] = 0
    return table


#: ``[^\x20\x09-\x0D]+``
SPACED = _separators((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text whose A-Z are lower-cased
ALNUM = _separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

#: One 64-bit value per byte after A-Z are lower-cased.
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_VALUES[65:91] = _VALUES[97:123]
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> _U(30))
    h *= _MIX1
    h ^= h >> _U(27)
    h *= _MIX2
    h ^= h >> _U(31)
    return h


@dataclass
class Words:
    """Words of some texts: bounds in bytes, 64-bit hashes, and for text i the
    words ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a text column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows: (from, to, bytes, offsets)."""
    worker.kept("bytetext")
    raw, offs = text_buffers(column)
    n, at = len(offs) - 1, 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(raw: np.ndarray, offs: np.ndarray, table: np.ndarray) -> Words:
    """The words of a slice, with 64-bit hashes of their A-Z-lowered bytes."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64))
    inside = table[raw]
    before = np.empty(n + 1, np.uint8)
    before[0] = 0
    before[1:] = inside
    cuts = offs[1:-1]
    cuts = cuts[cuts < n]
    opened = inside > before[:-1]
    opened[cuts] = inside[cuts] > 0
    start = np.flatnonzero(opened)
    after = np.empty(n, np.uint8)
    after[:-1] = inside[1:]
    after[-1] = 0
    after[cuts[cuts > 0] - 1] = 0
    end = np.flatnonzero(inside > after) + 1
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[raw] * _power("up", _BASE, n), out=sums[1:])
    h = (sums[end] - sums[start]) * _power("down", _BASE_INVERSE, n)[start]
    h += (end - start).astype(np.uint64) * _MIX1
    return Words(start, end, mix(h), np.searchsorted(start, offs))


_PLACE = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (across texts too; callers mask)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - k + 1] * _PLACE[0]
    for i in range(1, k):
        out = out + h[i : len(h) - k + 1 + i] * _PLACE[i]
    return mix(out + _U(k))


def hash_words(texts: list[str], table: np.ndarray) -> list[np.ndarray]:
    """Word hashes of each text, for small lists."""
    out: list[np.ndarray] = []
    for _, _, raw, offs in slices(pa.array(texts, pa.string())):
        w = words(raw, offs, table)
        out += [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(offs) - 1)]
    return out
