"""Sets of character n-grams as sorted 64-bit numbers, and signatures on which near sets meet.

Two sets of sizes m, n and Jaccard similarity >= t differ in at most (1 - t) / (1 + t) * (m + n) grams. Cut the space of
grams into one part more than that: then the sets are equal in one part at least. A signature is the number of a part
and a sum over the grams in it, so near sets share a signature, and two sets that share none are not near. The number of
parts follows from a class of sizes; a set looks for partners in each class that sizes of such similarity can have.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

#: Code points with the White_Space property.
SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_U = np.uint64
#: What a similarity may lose when it is rounded to six digits.
SLACK = 1e-6
#: Times the parts that are needed: the more, the more of them near sets have in common.
MORE = 1.25


@cache
def _visible() -> np.ndarray:
    out = np.ones(0x3002, bool)
    out[SPACES] = False
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def gram_sets(texts: list[str | None], n: int = 3) -> Iterator[np.ndarray]:
    """For each text the distinct runs of n characters, white space left out, as sorted numbers; a shorter one has none. Up
    to three characters a run has a number of its own, longer ones a hash."""
    for text in texts:
        c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
        c = c[_visible().take(np.minimum(c, 0x3001))].astype(_U)
        size = len(c) - n + 1
        if size <= 0:
            yield np.zeros(0, _U)
            continue
        key = c[:size]
        for k in range(1, n):
            key = (key if k < 3 else mixed(key)) * _U(1 << 21) + c[k : k + size]
        key = np.sort(mixed(key))
        new = np.ones(size, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        yield key[new]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


class Signatures:
    """The signatures of sets for one least similarity."""

    def __init__(self, least: float):
        self.least = least - SLACK
        self.bounds = [1]
        self.edges: dict[int, np.ndarray] = {}

    def size_class(self, n: int) -> int:
        while self.bounds[-1] <= n:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] / self.least)))
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def parts(self, c: int) -> np.ndarray:
        """Where the parts of a class begin, among all 64-bit numbers; its largest set can have most differences."""
        if c not in self.edges:
            most = self.bounds[c + 1] - 1
            n = int(MORE * (int((1 - self.least) / self.least * most * (1 + 1e-9)) + 1))
            self.edges[c] = np.array([i * (1 << 64) // n for i in range(n)], _U)
        return self.edges[c]

    def of_class(self, s: np.ndarray, sums: np.ndarray, c: int) -> np.ndarray:
        edges = self.parts(c)
        at = sums.take(np.append(np.searchsorted(s, edges), len(s)))
        out = at[1:] - at[:-1]
        out += np.arange(len(edges), dtype=_U) * _U(0x9E3779B97F4A7C15)
        out += _U(c * 0xD1342543DE82EF95 % (1 << 64))
        return mixed(out)

    def differences(self, m: np.ndarray, n: int) -> np.ndarray:
        """How many grams sets of m and n grams differ in at most. They are equal in all parts but as many."""
        return np.floor((1 - self.least) / (1 + self.least) * (m + n) * (1 + 1e-9)).astype(np.int64)

    @staticmethod
    def sums(s: np.ndarray) -> np.ndarray:
        out = np.zeros(len(s) + 1, _U)
        np.cumsum(mixed(s + _U(0x9E3779B97F4A7C15)), out=out[1:])
        return out

    def own(self, s: np.ndarray) -> np.ndarray:
        """The signatures under which a set is found."""
        return self.of_class(s, self.sums(s), self.size_class(len(s))) if len(s) else np.zeros(0, _U)

    def sought(self, s: np.ndarray) -> np.ndarray:
        """The signatures of all sets that can be near this one."""
        if not len(s):
            return np.zeros(0, _U)
        first, last = self.size_class(max(1, int(np.ceil(len(s) * self.least * (1 - 1e-9))))), self.size_class(int(len(s) / self.least * (1 + 1e-9)))
        sums = self.sums(s)
        return np.concatenate([self.of_class(s, sums, c) for c in range(first, last + 1)])
