"""Content-defined anchors of a byte text, as numpy arrays.

Each window of ``window`` bytes chooses one anchor: the leftmost position in it whose ``gram`` bytes have the smallest hash. Equal windows
choose equal anchors at equal places. Consecutive windows with one anchor are a run; the bytes that the windows of a run cover are
its context.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Windows that are looked at together; longer texts go slice by slice.
SLICE = 1 << 20
_AT = np.uint64((1 << 24) - 1)


@lru_cache(maxsize=4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASES[which])
    with np.errstate(over="ignore"):
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, (2, 256), np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _prefix(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash, and the powers that bring a difference of them back to exponent 0."""
    up, down = _powers(which, 1 << max(13, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_tables()[which][data] * up[: len(data)], out=sums[1:])
    return sums, down


def _slice_runs(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    sums, down = _prefix(data, 0)
    n = len(data) - gram + 1
    hashes = _mix((sums[gram:] - sums[:n]) * down[:n])
    least = (hashes & ~_AT) | np.arange(n, dtype=np.uint64)
    wide, have = window - gram + 1, 1
    while 2 * have <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < wide:
        least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
    anchor = (least & _AT).astype(np.int64)
    edge = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    first, last = np.concatenate(([0], edge)), np.concatenate((edge, [len(anchor)])) - 1
    sums2, down2 = _prefix(data, 1)
    end = last + window
    context = _mix((sums2[end] - sums2[first]) * down2[first] + (end - first).astype(np.uint64))
    return first, last, hashes[anchor[first]].view(np.int64), context.view(np.int64), anchor[first]


def runs_of(raw: bytes, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and last window start, anchor hash, context hash and anchor place of every run; empty for a text below ``window``."""
    data, parts = np.frombuffer(raw, np.uint8), []
    with np.errstate(over="ignore"):
        for a in range(0, len(data) - window + 1, SLICE):
            got = _slice_runs(data[a : a + SLICE + window - 1], window, gram)
            parts.append((got[0] + a, got[1] + a, got[2], got[3], got[4] + a))
    if not parts:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def window_hashes(raw: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window."""
    data, out = np.frombuffer(raw, np.uint8), []
    n = len(data) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2
    with np.errstate(over="ignore"):
        for which in (0, 1):
            sums, down = _prefix(data, which)
            out.append(_mix((sums[window:] - sums[:n]) * down[:n]).view(np.int64))
    return out[0], out[1]
