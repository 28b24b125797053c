"""Vectorised word splitting and hashing over Arrow batches of whole texts.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D`` with A-Z lower-cased, so UTF-8 words
keep all their bytes. Texts are scanned in pieces cut at white space: memory follows the piece, not the
text, apart from eight bytes for each word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), so that every bit of ``x`` reaches every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random 64-bit number for each byte (A-Z as a-z) and which bytes are white space."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
    upper = np.arange(ord("A"), ord("Z") + 1)
    values[upper] = values[upper + 32]
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return values, space


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _ODD, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        up, down = np.cumprod(up), np.cumprod(down)
    return up, down


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of pieces that end after white space (or at the end of the data)."""
    space = _tables()[1]
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not space[data[end - 1]]:
            ahead = np.flatnonzero(space[data[end : end + PIECE]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + PIECE, len(data))
        yield at, end
        at = end


def words(texts: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Hashes, byte starts and ends of all words, the first word's index of each text (one more than texts), and the bytes."""
    texts = [t or b"" for t in texts]
    raw = b"\n".join(texts)
    data = np.frombuffer(raw, np.uint8)
    values, space = _tables()
    hashes, starts, ends = [], [], []
    for lo, hi in _pieces(data):
        piece = data[lo:hi]
        inside = ~space[piece]
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            continue
        size = 1 << max(20, int(hi - lo).bit_length())
        up, down = _powers(size)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[piece] * up[: hi - lo], out=total[1:])
        h = (total[last] - total[first]) * down[first]
        hashes.append(mix(h + (last - first).astype(np.uint64)))
        starts.append(first + lo)
        ends.append(last + lo)
    joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (starts, np.int64), (ends, np.int64))]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    firsts = np.searchsorted(joined[1], begins)
    return joined[0], joined[1], joined[2], firsts, raw


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words in order; a shorter non-empty text is one run."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    take = min(width, n)
    out = np.full(n - take + 1, take, np.uint64)
    for k in range(take):
        out = mix(out + hashes[k : n - take + 1 + k] * np.uint64(2 * k + 3))
    return out


def small_batches(batch, column: str = "text", limit: int = 2 << 20):
    """Slices of an Arrow batch with at most ``limit`` bytes of ``column`` each (or one row)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def bound_batches(spark) -> None:
    """Have Spark cut Arrow batches at 4 MB and 2,000 rows, so that very long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


@functools.cache
def lean() -> None:
    """Have this Python worker give large arrays back to the system as soon as they are free (glibc; elsewhere nothing)."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):
        return
    mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
    mallopt(-1, 1 << 18)  # M_TRIM_THRESHOLD
