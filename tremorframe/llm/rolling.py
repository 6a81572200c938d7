"""Polynomial hashes of byte ranges, for whole arrays of ranges at once."""

from __future__ import annotations

import numpy as np

from tremorframe.llm.common import travels

travels(__name__)

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, *range(0x09, 0x0E)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least ``n`` places."""
    size = 1 << max(16, (n - 1).bit_length())
    have = max(_POWERS, default=0)
    if have < size:
        _POWERS.clear()
        both = []
        for b in (_BASE, _INVERSE):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _POWERS[size] = (both[0], both[1])
    return next(iter(_POWERS.values()))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all others (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class RangeHash:
    """Hashes of ranges of ``data``: equal ranges have equal hashes wherever they are."""

    def __init__(self, data: np.ndarray):
        self.up, down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:len(data)], out=self.total[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.total[ends] - self.total[starts]) * self.up[starts]
        return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def of_width(self, width: int) -> np.ndarray:
        """Of all ranges of one width."""
        n = max(len(self.total) - width, 0)
        return mixed((self.total[width:] - self.total[:n]) * self.up[:n])


def word_hashes(raw: bytes, piece: int = 4 << 20) -> np.ndarray:
    """A hash for each maximal run of bytes that are not white space (0x20, 0x09-0x0D)."""
    found, at = [], 0
    while at < len(raw):
        end = at + piece
        if end < len(raw):  # on to the next white space
            while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        data = np.frombuffer(raw[at:end], np.uint8)
        blank = _BLANKS[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        found.append(RangeHash(data).of(starts, ends))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)
