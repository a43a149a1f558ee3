"""Vectorised access to the UTF-8 bytes of a text column inside Arrow tasks.

Texts are taken in blocks of a few megabytes, so a task's working memory depends on the
block size (or on its longest single text), never on the size of the table. Words are
``[^\\x20\\x09-\\x0D]+`` throughout; those bytes are ASCII, so byte and character rules agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def utf8_blocks(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of whole rows: (first row, end row, bytes, offsets of the rows' texts). Null texts are empty."""
    values = batch.column(column)
    if values.null_count:
        values = pc.fill_null(values, "" if not pa.types.is_binary(values.type) else b"")
    if not pa.types.is_binary(values.type):
        values = values.cast(pa.binary())
    n = len(values)
    if not n:
        return
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int32)[values.offset: values.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1)
        hi = min(hi, n, lo + BLOCK_ROWS)
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, BLOCK_BYTES + 64), _BASE if kind == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte codes times rising powers; any substring's hash follows from two of them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _table("up", len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends); equal bytes give equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _table("down", len(sums))[starts])


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all spans of one width, by start."""
    if len(sums) <= width:
        return np.zeros(0, np.uint64)
    return mix((sums[width:] - sums[:-width]) * _table("down", len(sums) - width))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row number of every word of a block."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    starts = np.flatnonzero(ink & (~before | first[:-1]))
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    ends = np.flatnonzero(ink & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_windows(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and row numbers of the windows of `width` words; a shorter, non-empty text is one window of all its words."""
    counts = np.bincount(rows, minlength=n_rows)
    if len(hashes) >= width:
        acc = hashes[: len(hashes) - width + 1].copy()
        for k in range(1, width):
            acc = acc * _BASE + hashes[k: len(hashes) - width + 1 + k]
        whole = rows[: len(acc)] == rows[width - 1:]
        out, owner = mix(acc[whole]), rows[: len(acc)][whole]
    else:
        out, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.cumsum(counts) - counts
        extra = np.array([int(mix(np.array([_fold(hashes[first[r]: first[r] + counts[r]])], np.uint64))[0]) for r in short], np.uint64)
        out, owner = np.concatenate([out, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def _fold(values: np.ndarray) -> int:
    acc = len(values)
    for v in values.tolist():
        acc = (acc * int(_BASE) + v) & 0xFFFFFFFFFFFFFFFF
    return acc
