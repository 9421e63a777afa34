"""Exact products of whole-number matrices by residues: float32 products modulo small primes, signed by Chinese remainders."""

from __future__ import annotations

import numpy as np

#: Components of a product that float32 adds up exactly, and the greatest prime for which it does: TERMS * (p // 2) ** 2 < 2 ** 24.
TERMS, TOP = 64, 1023
LARGEST = 2**62


def primes(n: int) -> list[int]:
    """The n greatest primes up to TOP."""
    sieve = np.ones(TOP + 1, bool)
    sieve[:2] = False
    for i in range(2, int(TOP**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return np.flatnonzero(sieve)[::-1][:n].tolist()


PRIMES = primes(8)  # their product is over 2 ** 79


def residue(a: np.ndarray, p: int) -> np.ndarray:
    """a modulo p in float32, between -(p // 2) and p // 2. a: whole numbers in double precision; fmod is exact for all."""
    r = np.fmod(a, p)
    return (r - p * np.rint(r / p)).astype(np.float32)


def norms(a: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(a).sum(axis=1)) if a.size else np.zeros(len(a))


class Residues:
    """Rows whose residues are taken once for each prime that a product needs."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.norm, self._by = rows, norms(rows), {}
        self.most = float(self.norm.max(initial=0))

    def of(self, p: int) -> np.ndarray:
        if p not in self._by:
            self._by[p] = residue(self.rows, p)
        return self._by[p]

    def take(self, some: np.ndarray) -> Residues:
        out = Residues.__new__(Residues)
        out.rows, out.norm = self.rows[some], self.norm[some]
        out.most, out._by = float(out.norm.max(initial=0)), {p: r[some] for p, r in self._by.items()}
        return out


def product(a: Residues, b: Residues) -> np.ndarray:
    """a.rows @ b.rows.T, exact, as int64.

    As many primes are taken as the product of the longest rows asks for (Cauchy-Schwarz). A score whose bound is not
    below 2 ** 62 has no place in a long and raises OverflowError.
    """
    bound = a.most * b.most * (1 + 1e-6) + 1
    if not bound < LARGEST:
        raise OverflowError("inner products of these vectors may not fit into a long")
    used, reach = [], 1
    for p in PRIMES:
        if reach > 2 * bound + 1:
            break
        used.append(p)
        reach *= p
    digits: list[np.ndarray] = []
    for i, p in enumerate(used):
        x, y = a.of(p), b.of(p)
        total = np.zeros((len(x), len(y)), np.float32)
        for j in range(0, x.shape[1], TERMS):
            part = x[:, j : j + TERMS] @ y[:, j : j + TERMS].T
            part -= p * np.rint(part * np.float32(1 / p))
            total += part  # at most one p a step: exact for 16,000 steps
        digit = total.astype(np.int32)
        for q, before in zip(used[:i], digits):  # digits of the mixed radix: what is left after those before
            digit = (digit - before) * pow(q, -1, p) % p
        digits.append((digit + p // 2) % p - p // 2)
    out = np.zeros((len(a.rows), len(b.rows)), np.int64)
    for p, digit in zip(reversed(used), reversed(digits)):
        out = out * p + digit  # each partial value lies within the range of the primes used so far
    return out
