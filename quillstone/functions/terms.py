"""Many-term matching: an Aho-Corasick automaton in flat arrays, run over many pieces of text in step.

States are the prefixes of the terms. The table of moves is whole (what a missing edge leads to by the longest suffix
that is a state is filled in), so each character is one look-up; characters that no term has share one column. Texts
are cut into pieces that overlap by the longest term less one, and all pieces of a batch take a step together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one automaton's moves; more terms are several automata, each sent by itself.
AUTOMATON_BYTES = 48 << 20
#: Characters of a piece besides its overlap, and of all pieces that are held at once.
PIECE, HELD = 512, 4 << 20


class Automaton:
    """terms: distinct and not empty. found() gives the places of terms in the list."""

    def __init__(self, terms: list[str]):
        self.terms, self.longest = terms, max(map(len, terms), default=1)
        letters = sorted({ord(c) for t in terms for c in t})
        self.letters = np.array(letters, np.uint32)
        column = {c: k for k, c in enumerate(letters, 1)}  # column 0: any other character
        moves: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for place, t in enumerate(terms):
            at = 0
            for c in t:
                k = column[ord(c)]
                if k not in moves[at]:
                    moves[at][k] = len(moves)
                    moves.append({})
                    ends.append([])
                at = moves[at][k]
            ends[at].append(place)
        # Breadth first: a state's row is that of its longest proper suffix, but for its own edges.
        self.moves = np.zeros((len(moves), len(letters) + 1), np.int32)
        suffix, order = [0] * len(moves), [0]
        for at in order:
            if at:
                self.moves[at] = self.moves[suffix[at]]
            for k, to in moves[at].items():
                suffix[to] = int(self.moves[at, k]) if at else 0
                self.moves[at, k] = to
                order.append(to)
        for at in order[1:]:
            ends[at] = ends[at] + ends[suffix[at]]
        self.first = np.concatenate([[0], np.cumsum([len(e) for e in ends])])
        self.places = np.array([p for e in ends for p in e], np.int64)
        self.accepts = np.diff(self.first) > 0

    @staticmethod
    def cost(characters: int, letters: int) -> int:
        """Bytes of moves, at most."""
        return 4 * (characters + 1) * (letters + 1)

    def found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of each term that a text has, once, ordered."""
        warm = self.longest - 1
        pieces = [(k, at) for k, t in enumerate(texts) for at in range(0, len(t), PIECE)]
        out: list[np.ndarray] = []
        step = max(1, HELD // (PIECE + warm))
        for a in range(0, len(pieces), step):
            out.append(self._run(texts, pieces[a : a + step], warm))
        pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        n = max(1, len(self.places) and int(self.places.max()) + 1)
        return pairs // n, pairs % n

    def _run(self, texts: list[str], pieces: list[tuple[int, int]], warm: int) -> np.ndarray:
        # A match belongs to the piece in which it ends; what stands before only brings the state there.
        cut = [texts[k][max(0, at - warm) : at + PIECE] for k, at in pieces]
        sizes = np.array([len(c) for c in cut])
        order = np.argsort(-sizes, kind="stable")
        width, n = int(sizes.max()), max(1, len(self.places) and int(self.places.max()) + 1)
        codes = np.frombuffer("".join(cut).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.letters, codes)
        at[at == len(self.letters)] = 0
        columns = np.where(self.letters[at] == codes, at + 1, 0) if len(self.letters) else at
        start = (np.cumsum(sizes) - sizes)[order]
        live = np.searchsorted(-sizes[order], -np.arange(width), "left")  # pieces longer than each step
        own = np.array([min(warm, at) for _, at in pieces])[order]
        text = np.array([k for k, _ in pieces], np.int64)[order]
        state, hits = np.zeros(len(pieces), np.int32), []
        for step in range(width):
            m = int(live[step])
            state[:m] = self.moves[state[:m], columns[start[:m] + step]]
            at = np.flatnonzero(self.accepts[state[:m]] & (own[:m] <= step))
            if len(at):
                s = state[at]
                count = self.first[s + 1] - self.first[s]
                flat = np.repeat(self.first[s] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
                hits.append(np.repeat(text[at], count) * n + self.places[flat])
                if len(hits) > 256:
                    hits = [np.unique(np.concatenate(hits))]
        return np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)


def automata(terms: Iterable[str]) -> Iterator[tuple[int, Automaton]]:
    """(place of the first term, automaton) for parts of the terms of bounded size; a single term is always a part."""
    part: list[str] = []
    letters: set[str] = set()
    characters = base = 0
    for t in terms:
        more = letters | set(t)
        if part and Automaton.cost(characters + len(t), len(more)) > AUTOMATON_BYTES:
            yield base, Automaton(part)
            base += len(part)
            part, characters, more = [], 0, set(t)
        part.append(t)
        letters = more
        characters += len(t)
    if part:
        yield base, Automaton(part)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > HELD:
            yield start, k
            start, size = k, 0
        size += len(t)
    if len(texts) > start:
        yield start, len(texts)


def _pairs(automaton: Broadcast, names: list[str]):
    """Rows (key, text) -> a row for each term of this automaton that the text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for a, z in _slices(texts):
                text, place = automaton.value.found(texts[a:z])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text + a)), pa.array([automaton.value.terms[p] for p in place.tolist()], pa.string())], names)

    return run


def term_hits(texts: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """key, hits: the terms that a text contains, each once, in the order of the list; every row of texts has a row.

    The list is given by the caller and small enough for the driver; its automata are sent one by one. An empty term is
    in every text but a null one. Null text: no hits. Repeated rows and keys: a row each. Terms that repeat count once.
    """
    spark = texts.sparkSession
    wanted = list(dict.fromkeys(terms))
    parts = [(base, spark.sparkContext.broadcast(a)) for base, a in automata(t for t in wanted if t)]
    schema = T.StructType([texts.select(key).schema.fields[0], T.StructField("hits", T.ArrayType(T.StringType()))])
    blank, names = wanted.index("") if "" in wanted else None, [t for t in wanted if t]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1).to_pylist()
            for a, z in _slices([x or "" for x in raw]):
                out: list[list[str]] = [[] for _ in range(a, z)]
                for base, automaton in parts:
                    for row, place in zip(*(x.tolist() for x in automaton.value.found([x or "" for x in raw[a:z]])), strict=True):
                        out[row].append(names[base + place])
                if blank is not None:
                    before = set(wanted[:blank])
                    out = [h if x is None else [*(t for t in h if t in before), "", *(t for t in h if t not in before)] for h, x in zip(out, raw[a:z], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(out, pa.list_(pa.string()))], schema.names)

    return texts.select(key, text).mapInArrow(run, schema)


def term_pairs(texts: DataFrame, terms: DataFrame, key: str, text: str, term: str = "term") -> DataFrame:
    """key, term: each term of a table that a text contains, once. The table may be of any size: its distinct terms come
    to the driver one by one and go out in automata of bounded bytes, each a pass over the texts. Null and empty terms
    are in no text, nor is any term in a null text."""
    spark, out = texts.sparkSession, None
    wanted = terms.select(F.col(term).cast("string").alias("t")).filter("t is not null and t <> ''").distinct()
    asked = texts.select(key, text).filter(F.col(text).isNotNull())
    kind = T.StructType([asked.schema.fields[0], T.StructField(term, T.StringType())])
    for _, automaton in automata(r[0] for r in wanted.toLocalIterator()):
        pairs = asked.mapInArrow(_pairs(spark.sparkContext.broadcast(automaton), kind.names), kind)
        out = pairs if out is None else out.unionByName(pairs)
    return (out if out is not None else spark.createDataFrame([], kind)).distinct()
