"""Text helpers that several operators of this subpackage share."""

from __future__ import annotations

import re

import numpy as np
import zstandard

#: The six ASCII white-space characters that end a word; bytes.split() uses the same set.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8 bytes, with A-Z lower-cased on request. Null has none."""
    data = (text or "").encode()
    return (data.translate(_LOWER) if lower else data).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (finaliser of murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def squeeze(values: np.ndarray) -> bytes:
    """An integer array as bytes for a shuffle: dtype width, byte planes, zstd."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return zstandard.compress(planes, 1)


def expand(data: bytes, dtype) -> np.ndarray:
    """The inverse of squeeze()."""
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(dtype)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + len)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of equal values."""
    cuts = np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)).tolist() if len(values) else []
    return list(zip([0, *cuts], cuts, strict=False))
