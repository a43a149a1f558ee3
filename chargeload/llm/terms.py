"""Lower-case terms of texts inside Arrow tasks: runs of digits, ASCII letters and any non-ASCII characters.

Only A-Z are lower-cased. All separators are ASCII, so byte and character rules agree.
"""

from __future__ import annotations

import zlib

import numpy as np

from .textblocks import ASCII_LOWER

IS_TERM = np.zeros(256, bool)
IS_TERM[0x30:0x3A] = IS_TERM[0x61:0x7B] = IS_TERM[0x80:] = True


def _crc_table() -> np.ndarray:
    """Table of the reflected polynomial 0xEDB88320, from its rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return c


_CRC = _crc_table()
_LONG = 48  # longer spans are hashed one by one


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, row) of every term of a block; terms end with their text."""
    low = ASCII_LOWER[data]
    if not len(low):
        z = np.zeros(0, np.int64)
        return low, z, z, z
    ink = IS_TERM[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [start, end), range after range."""
    sizes = ends - starts
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return np.arange(total, dtype=np.int64) + shift


def joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms one after the other with one space between, and where each stands."""
    sizes = ends - starts
    to = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    out[ranges(to, to + sizes)] = low[ranges(starts, ends)]
    return out, to, to + sizes


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of the byte spans [start, end)."""
    sizes = ends - starts
    order = np.argsort(-np.minimum(sizes, _LONG + 1), kind="stable")
    s, n = starts[order], sizes[order]
    crc = np.full(len(s), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-n, -_LONG, "left"))  # spans before it are longer than _LONG
    live = len(s)
    for j in range(int(n[first]) if first < len(n) else 0):
        live = int(np.searchsorted(-n[first:], -j, "left")) + first  # spans of more than j bytes
        c = crc[first:live]
        crc[first:live] = _CRC[(c ^ data[s[first:live] + j]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(first):
        crc[i] = zlib.crc32(data[s[i]: s[i] + n[i]].tobytes())
    out = np.empty(len(s), np.uint32)
    out[order] = crc
    return out
