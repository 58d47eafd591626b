"""Periodic runs of words, by Lyndon arrays in linear time (Ellert and Fischer, over general ordered alphabets).

A run's repeated part, read from the right place, is a Lyndon word, and it is the longest one that begins there in one
of two orders of the alphabet: the order given, or its reverse. So both Lyndon arrays hold all runs. An array is
computed from left to right with the chain of previous smaller suffixes, and each step of the chain needs the length
to which two suffixes match. What an earlier match has covered is not compared again: inside it the chain mirrors the
chain of its first copy, whose lengths are known, and symbols are only compared beyond the furthest match so far. No
suffix array, no suffix tree, no hash of symbols; words are ranked by sorting.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import doc_rows, slices, texts_of, words_of

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def lyndon_edges(x: list[int], least: int = 1) -> list[tuple[int, int, int]]:
    """(i, j, m) for each i whose next smaller suffix begins at j: x[i:j] is the longest Lyndon word at i, and the
    suffixes match over m symbols. Edges with m < least * (j - i) are left out. The end counts as smaller than all.

    x must end in a symbol that is smaller than all others and occurs nowhere else. Linear in len(x).
    """
    n = len(x) - 1
    following, shared = [n] * (n + 1), [0] * (n + 1)  # next smaller suffix, and to what length it matches
    previous, shared_back = [-1] * (n + 1), [0] * (n + 1)
    left = shift = right = 0  # x[left:right] is a copy of what lies `shift` before it, and x[right] differs
    out = []
    for i in range(1, n):
        j, m = i - 1, 0
        if i < right:
            copy, reach = i - shift, right - i
            while True:
                popped = following[j - shift] == copy
                m = shared[j - shift] if popped else shared_back[copy]
                if m >= reach:
                    m = reach  # known to match so far; what follows was not looked at
                    break
                if not popped:
                    previous[i], shared_back[i] = j, m
                    j = -2
                    break
                following[j], shared[j] = i, m
                if m and m >= least * (i - j):
                    out.append((j, i, m))
                j = previous[j]
            if j == -2:
                continue
        while True:
            if x[j + m] == x[i + m]:
                m += 1
                while x[j + m] == x[i + m]:
                    m += 1
            left, shift, right = i, i - j, i + m
            if x[j + m] < x[i + m]:
                previous[i], shared_back[i] = j, m
                break
            # The suffix at j is larger, and so are all before it in the chain that match it further than i does.
            while True:
                following[j], shared[j] = i, m
                if m and m >= least * (i - j):
                    out.append((j, i, m))
                back = shared_back[j]
                j = previous[j]
                if j < 0 or back <= m:
                    break
            if j < 0:
                break
            if back < m:
                previous[i], shared_back[i] = j, back
                break
    return out


def runs_of(ranks: np.ndarray, least_exponent: int = 4, least_length: int = 6) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least max(least_length, least_exponent * period) symbols, by start, then
    period. least_exponent is 3 or more.

    A run of exponent e holds its Lyndon word e - 1 times or more; from the first of them, at most a period after the
    run's start, its suffix matches the next over at least (e - 2) periods and one symbol. What stands before that first
    one is compared symbol by symbol, for less than a period, once a run.
    """
    if least_exponent < 3:
        raise ValueError("least_exponent must be 3 or more")
    n, out = len(ranks), []
    if n < least_length:
        return out
    top = int(ranks.max()) + 1
    for order in (0, 1):
        x = [*(top - ranks if order else ranks + 1).tolist(), 0]
        edges = lyndon_edges(x, least_exponent - 2)
        roots = {(i, j) for i, j, _ in edges}
        for i, j, m in edges:
            p = j - i
            # Not the first Lyndon word of its run (the one before matches a period further), or known from the other order.
            if m <= (least_exponent - 2) * p or (i - p, i) in roots or order and j + m == n:
                continue
            k = 0
            while k < p and i - k > 0 and x[i - k - 1] == x[j - k - 1]:
                k += 1
            length = k + p + m
            if length >= max(least_length, least_exponent * p):
                out.append((i - k, length, p))
    return sorted(out)


def periodic_tail(words: list, doc_id: int | None) -> list:
    """The words of a document; of every tenth document, by a hash of its id, with a tail that repeats itself."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def ranked(words: list[bytes]) -> np.ndarray:
    """The place of each word among the distinct words, by bytes; found by sorting."""
    return pc.rank(pa.array(words, pa.binary()), sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)


def described(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_words and the other columns of SCHEMA but for the id. A word is dropped if it stands in a run behind its first period."""
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    kept = words
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        kept = [words[k] for k in np.flatnonzero(keep).tolist()]
    listing = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(words), len(runs), *longest, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def periodic_runs(docs: DataFrame, least_exponent: int = 4, least_length: int = 6, tails: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_runs, the longest run (start, length, period, exponent_milli; ties: the smallest start, then
    period), and digests of all runs and of the text with each run cut to its first period.

    tails: every tenth document, by its id, first gets a tail that repeats itself, so that there are runs to find.
    Null or empty text: no words, no runs. Repeated rows and ids: a row each. Null doc_id: stays null, and gets no tail.
    Empty table: no rows. Other columns, also ones named like the results, are ignored. A text is one task's work,
    linear in its words; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for whole in batches:
            for b in slices(whole, "text"):
                docs = [words_of(x) for x in texts_of(b.column(1))]
                if tails:
                    docs = [periodic_tail(w, i) for w, i in zip(docs, b.column(0).to_pylist(), strict=True)]
                # One sort for all texts of the slice: any order of the words will do.
                ranks = ranked([w for d in docs for w in d])
                ends = np.cumsum([len(d) for d in docs])
                rows = [described(d, runs_of(ranks[e - len(d) : e], least_exponent, least_length)) for d, e in zip(docs, ends.tolist(), strict=True)]
                columns = [pa.array(c, pa.string() if k >= 6 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names)

    return doc_rows(docs, text, doc_id).mapInArrow(run, SCHEMA)
