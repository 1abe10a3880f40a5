"""Whole Arrow batches of texts cut into words and hashed with numpy, without a Python object for each word.

A batch is one byte buffer; a word's hash is taken from running sums of byte times power of an odd base (mod 2**64), so each
byte is touched a fixed number of times however long its text is.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(1 << 18, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    return h ^ (h >> np.uint64(33))


def pieces(column, limit: int = 1 << 21):
    """Yields (first row, bytes, offsets) of runs of rows of about `limit` bytes, a longer text by itself. Nulls are empty.

    column: a pyarrow binary or string array.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


KEPT: dict = {}  # what an operator keeps in a worker from task to task


def release() -> None:
    """Lets go of what another operator has kept in this worker, which Spark hands on from one to the next."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Gives memory that is free, and what is quickly made anew, back to the system: idle workers count as an executor's memory."""
    import pyarrow as pa

    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """The same function of batches; the worker is trimmed once its last batch is out and nothing of it is held."""

    def and_trim(batches):
        yield from run(batches)
        trim()

    return and_trim


def parts(batches, rows: int = 256):
    """The batches cut into small ones, without copying, so that what is made of one at a time stays small."""
    release()
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def words(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row and the total) of the words of each row."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~space[buf]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M2)


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's runs of n words; of a shorter row, of all its words; none without words."""
    starts, ends, at = words(buf, offsets)
    h = hashes(buf, starts, ends)
    salt = mix(np.arange(1, n + 2, dtype=np.uint64))
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        total += h[i : i + len(total)] * (salt[i] | np.uint64(1))
    total = mix(total)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(total[a : b - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = (h[a:b] * (salt[: b - a] | np.uint64(1))).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short ^ salt[b - a : b - a + 1]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
