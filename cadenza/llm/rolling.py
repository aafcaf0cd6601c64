"""Hashes of all windows of a sequence, by prefix sums of a polynomial mod 2^64."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that its powers can be inverted
_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for i, base in enumerate((BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (values[j] + 1) BASE^j over j < i."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def spread(h: np.ndarray) -> np.ndarray:
    """Mix the bits, as the low ones of a product depend on few inputs."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of every window of ``k`` values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = prefix_hashes(values)
    _, down = powers(len(values) + 1)
    return spread((sums[k:] - sums[:-k]) * down[:n])
