"""Polynomial prefix hashes over bytes, for numpy code inside tasks.

All arithmetic wraps at 2**64. With H[i] the sum of code(byte j) * BASE**j for j < i, the bytes
[s, e) hash to (H[e] - H[s]) * BASE**-s, wherever they stand.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """Mixes every bit of 64 into every other (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class PrefixHasher:
    """One base and one random code per byte, both following from the seed."""

    def __init__(self, seed: int):
        mixed = splitmix(np.arange(1, 258, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0xD1B54A32D192ED03 % 2**64))
        self.codes = mixed[:256]
        self.base = int(mixed[256]) | 5
        self.inverse = pow(self.base, -1, 2**64)
        self._powers = self._inverses = np.ones(1, dtype=_U)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, 1 << 16)
            one = np.ones(1, dtype=_U)
            self._powers = np.cumprod(np.concatenate([one, np.full(n - 1, self.base, dtype=_U)]), dtype=_U)
            self._inverses = np.cumprod(np.concatenate([one, np.full(n - 1, self.inverse, dtype=_U)]), dtype=_U)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """H[0..n] of an array of bytes."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(self.codes[data] * self._powers[: len(data)], out=out[1:])
        return out

    def spans(self, prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of [start, end), not mixed: equal bytes have equal hashes."""
        return (prefixes[ends] - prefixes[starts]) * self._inverses[starts]

    def windows(self, prefixes: np.ndarray, length: int) -> np.ndarray:
        """Hashes of every window of that length, not mixed."""
        n = len(prefixes) - length
        return (prefixes[length:] - prefixes[:n]) * self._inverses[:n]
