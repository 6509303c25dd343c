"""Vectorised kernels over many texts joined in one byte buffer.

Texts are joined with a line feed before, between and after them, so words and lines never span
two texts. All offsets are into that buffer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
BATCH_BYTES = 1 << 20

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def give_back() -> None:
    """Return freed memory to the system, and keep doing so for large arrays: workers are reused, and idle ones should be small."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_MMAP_THRESHOLD, 1 << 20)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: The number of that option in malloc.h.
_MMAP_THRESHOLD = -3


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, at least n of each."""
    for k, base in ((0, _MULTIPLIER), (1, _INVERSE)):
        if len(_powers[k]) < n:
            full = np.full(max(n, BATCH_BYTES + 4096), base, _U)
            full[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(full, dtype=_U)
    return _powers[0], _powers[1]


class Texts:
    """Some texts as one buffer. start[i] and end[i] bound text i."""

    def __init__(self, blobs: list[bytes]):
        self.blobs = blobs
        self.raw = b"\n" + b"\n".join(blobs) + b"\n"
        self.buf = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs))
        self.start = 1 + np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if len(blobs) else np.zeros(0, np.int64)
        self.end = self.start + sizes

    def lowered(self) -> Texts:
        """ASCII letters in lower case, everything else as it is."""
        out = Texts.__new__(Texts)
        out.blobs, out.raw, out.start, out.end = self.blobs, self.raw.lower(), self.start, self.end
        out.buf = np.frombuffer(out.raw, np.uint8)
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of each word, and bounds: text i has words bounds[i] to bounds[i + 1]."""
        inside = ~IS_SPACE[self.buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, last = edges[0::2], edges[1::2]
        bounds = np.searchsorted(first, np.append(self.start, len(self.buf)))
        return first, last, bounds

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of each \\n-split line, and bounds by text; an empty text has one empty line."""
        breaks = np.flatnonzero(self.buf == 10)
        first, last = breaks[:-1] + 1, breaks[1:]
        bounds = np.searchsorted(first, np.append(self.start, len(self.buf)))
        return first, last, bounds

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.end] - total[self.start]

    def span_hashes(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span, equal for equal bytes wherever they stand."""
        power, inverse = _power_tables(len(self.buf) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.buf) + 1, _U)
            np.cumsum(_BYTE_VALUES[self.buf] * power[: len(self.buf)], dtype=_U, out=total[1:])
            return mix64((total[last] - total[first]) * inverse[first] + (last - first).astype(_U))


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` values (a power of two), by doubling."""
    out, step = values.astype(_U), 1
    with np.errstate(over="ignore"):
        while step < width:
            out = mix64(out[:-step] * _U(0xD6E8FEB86659FD93) + out[step:]) if len(out) > step else out[:0]
            step *= 2
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def seen_before(keys: np.ndarray) -> np.ndarray:
    """True where an equal key stands earlier."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element, the text it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def blobs_of(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batches_of_texts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the record batches with at most `limit` bytes of text (one text at least)."""
    for batch in batches:
        blobs = blobs_of(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < len(blobs):
            to, size = at, 0
            while to < len(blobs) and (to == at or size + len(blobs[to]) <= limit):
                size += len(blobs[to])
                to += 1
            yield batch.slice(at, to - at), Texts(blobs[at:to])
            at = to
