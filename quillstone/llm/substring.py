"""Substring dedup by relative Lempel-Ziv parsing against a sharded reference index.

Every document is factored into literals and factors: copies of earlier text, each with its place there (document,
word) and length. Factors that cover windows of at least WINDOW words are duplicate spans. The reference, all earlier
text, is indexed in blocks that are shards by hash and live in different tasks:

1. Seeds. In every WINDOW consecutive words the run of SEED words with the least hash is the seed. Equal windows
   have equal seeds, so only seeds that occur twice in the corpus can start a factor; the rest never travel again.
2. Matches. At seeds that do repeat, every window that the seed stands for is looked up in the reference block of its
   hash (96 bits); the block answers with the earliest place that has the same window.
3. Parsing. A match runs on while the next word's window has the next place of the same document. Of the matches that
   reach the end of the last factor, the one that goes on longest becomes the next factor, from that end on; so the
   windows that straddle the boundary of two factors are checked too, and no word that they cover is left out. Where
   no match reaches, literals stand until the next one begins.

Texts of equal words are one reference text: all but the first (least doc_id) are one factor as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, slices, texts_of, words_of, written

WINDOW, SEED = 20, 6
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _rolled(h: np.ndarray, width: int, mul: np.uint64) -> np.ndarray:
    """A well mixed hash of each run of `width` word hashes."""
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * mul + h[i : i + n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _seeds(h: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each seed-sized run; for each window, where its seed begins (the leftmost of equals)."""
    g = _rolled(h, seed, _MUL[0])
    spans = np.lib.stride_tricks.sliding_window_view(g, window - seed + 1)
    return g, spans.argmin(1) + np.arange(len(spans))


#: A factor: first word, words, document that has them earlier, its first word of them.
FACTOR = np.dtype([("start", "<i8"), ("length", "<i8"), ("source", "<i8"), ("source_start", "<i8")])


def parse(matches: np.ndarray, window: int) -> np.ndarray:
    """Rows (place, source, source place) of windows with an earlier equal, in ascending order of place -> factors."""
    if not len(matches):
        return np.zeros(0, FACTOR)
    place, source, shift = matches[:, 0], matches[:, 1], matches[:, 0] - matches[:, 2]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])]))
    begin, end = place[first].tolist(), (place[np.append(first[1:], len(place)) - 1] + window).tolist()
    out, at, k = [], 0, 0
    while k < len(begin):
        at = max(at, begin[k])
        # Of the runs that reach this place, the one that goes on longest.
        best = k
        while k < len(begin) and begin[k] <= at:
            if end[k] > end[best]:
                best = k
            k += 1
        if end[best] > at:
            i = first[best]
            out.append((at, end[best] - at, source[i], at - shift[i]))
            at = end[best]
    return np.array(out, FACTOR)


_INFO = "key long, mark long, n_words long, d1 long, d2 long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "text"):
            n, d = [], []
            for x in texts_of(b.column(1)):
                w = words_of(x)
                n.append(len(w))
                d.append(xxhash.xxh3_128_digest(b" ".join(w)))
            d = np.frombuffer(b"".join(d), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1])], ["key", "mark", "n_words", "d1", "d2"])


def _batches(batches: Iterator[pa.RecordBatch], emit: Callable, names: list[str], first: int) -> Iterator[pa.RecordBatch]:
    """emit(key, base, text, is_copy, list) -> columns for one document; batches of bounded size come out.

    `base` tells documents apart that share a key: it is added to places, and is 0 where the key is unique.
    Of equal hashes in a batch, the first ones by (key, place) go on to meet those of other tasks; for the rest the
    answer is known already, and they are marked, with the place of the first one: a passage of very many documents
    sends each task few rows.
    """

    def marked() -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        order = np.lexsort(cols[::-1])
        cols = [c[order] for c in cols]
        begin = np.maximum.accumulate(np.where(_groups(cols[:-2]), np.arange(len(order)), 0))
        # Rows of one key and place are one window of repeated rows: none is later than the other.
        known = (np.arange(len(order)) - begin >= first) & ((cols[-2] != cols[-2][begin]) | (cols[-1] != cols[-1][begin]))
        source, there = np.where(known, cols[-2][begin], 0), np.where(known, cols[-1][begin], 0)
        return pa.RecordBatch.from_arrays([*map(pa.array, [*cols, known, source, there])], [*names, "known", "source", "there"])

    out, size = [], 0
    for whole in batches:
        for b in slices(whole, "text"):
            texts = texts_of(b.column(1))
            lists = b.column(5) if b.num_columns > 5 else None
            for i, (key, mark, info) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True)):
                got = emit(key, _base(mark, info), texts[i], _original(mark, info) is not None, lists[i].values.to_numpy() if lists is not None and lists[i].is_valid else None)
                if got is not None:
                    out.append(got)
                    size += len(got[0])
                if size > 200_000:
                    yield marked()
                    out, size = [], 0
    if out:
        yield marked()


def _base(mark: int, info: list[dict]) -> int:
    """What a text's places begin from, by all texts that share its key."""
    return mark << 32 if len({x["mark"] for x in info}) > 1 else 0


def _original(mark: int, info: list[dict]) -> int | None:
    """The key of the first text that this one is a copy of."""
    return next((x["first"] for x in info if x["mark"] == mark and x["first"] is not None), None)


def _groups(columns: list[np.ndarray]) -> np.ndarray:
    """Where a group of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, key, place, known) sorted by hash -> key, place of those whose hash occurs more than once."""
    held: np.ndarray | None = None  # the last row, and whether the row before it has its hash
    tied = False
    for b in batches:
        rows = np.stack([c.to_numpy() for c in b.columns[:3]], 1)
        known = b.column(3).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(rows[known, 1]), pa.array(rows[known, 2])], ["key", "place"])
        rows = rows[~known]
        if not len(rows):
            continue
        same = tied
        if held is not None:
            rows = np.concatenate([held, rows])
        new = _groups([rows[:, 0]])
        again = ~new
        again[0] = same
        keep = again | np.append(~new[1:], False)
        held, tied = rows[-1:], bool(again[-1])
        part = rows[:-1][keep[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 1]), pa.array(part[:, 2])], ["key", "place"])
    if held is not None and tied:
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 1]), pa.array(held[:, 2])], ["key", "place"])


def _matches(key: np.ndarray, place: np.ndarray, source: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
    """key, match: (place, source, its place) as 24 bytes."""
    data = np.ascontiguousarray(np.stack([place, source, there], 1).astype("<i8"))
    packed = pa.Array.from_buffers(pa.binary(24), len(data), [None, pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(key), packed.cast(pa.binary())], ["key", "match"])


def _unpacked(matches: pa.BinaryArray) -> np.ndarray:
    at = np.frombuffer(matches.buffers()[1], np.int32)[matches.offset]
    return np.frombuffer(matches.buffers()[2], "<i8", 3 * len(matches), at).reshape(-1, 3)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, check, key, place, known, source, there) sorted by the first four -> matches of those with an
    earlier equal."""
    first: np.ndarray | None = None
    for b in batches:
        rows = np.stack([c.to_numpy().astype(np.int64) for c in b.columns[:4]], 1)
        known = b.column(4).to_numpy(zero_copy_only=False)
        if known.any():
            yield _matches(rows[known, 2], rows[known, 3], *(b.column(i).to_numpy()[known] for i in (5, 6)))
        rows = rows[~known]
        if not len(rows):
            continue
        if first is not None:
            rows = np.concatenate([first, rows])
        start = np.maximum.accumulate(np.where(_groups([rows[:, 0], rows[:, 1]]), np.arange(len(rows)), 0))
        late = (rows[:, 2] != rows[start, 2]) | (rows[:, 3] != rows[start, 3])
        first = rows[start[-1]][None]
        yield _matches(rows[late, 2], rows[late, 3], rows[start[late], 2], rows[start[late], 3])


#: Parts that the copies of one text are dealt into while their first one is found.
SALTS = 64


def copies(info: DataFrame, window: int) -> DataFrame:
    """info(key, mark, n_words, d1, d2) -> key, mark, first: texts of equal words and the least key of them, for all
    but that. The copies of one text meet in SALTS parts, never in one task."""
    salted = info.filter(F.col("n_words") >= window).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    part = salted.groupBy("d1", "d2", "salt").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    whole = part.groupBy("d1", "d2").agg(F.min("least").alias("first"), F.max("most").alias("most"), F.collect_list("salt").alias("salts")).filter("most > first")
    first = whole.select("d1", "d2", "first", F.explode("salts").alias("salt"))
    return salted.join(first, ["d1", "d2", "salt"]).filter("key > first").select("key", "mark", "first")


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors, factors, kept: each text without the words that lie in a window of
    `window` words whose word sequence also starts earlier (smaller doc_id, or same document, earlier start). factors:
    start, length, source, source_start of each factor: the words from `start` on also stand in document `source` (its
    doc_id, or a hash of its text if it has none) from `source_start` on.

    Windows are judged on the input, not on what is left. Words are [^\\x20\\x09-\\x0D]+; kept words are joined by
    one space. Null or empty text, and texts of fewer than `window` words: nothing is removed. Rows that share a
    doc_id: with equal texts, none comes before the other; with different texts, a hash of the text orders them.
    Null doc_id: the row stands among the others by a hash of its text, and its doc_id stays null. Empty table: no
    rows. Other columns are ignored.
    """
    n_seed = min(seed, window)
    rows = doc_rows(docs, text, doc_id).withColumn("text", F.coalesce("text", F.lit("")))
    mark = F.shiftrightunsigned(F.xxhash64("text", F.lit(1)), 34)
    rows = rows.select(F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "text", mark.alias("mark"), "doc_id")
    info = written(rows.select("key", "text", "mark").mapInArrow(_digests, _INFO), "substring-digests")
    info = info.select("key", "mark", F.lit(None).cast("long").alias("first")).unionByName(copies(info, window))
    info = written(info.groupBy("key").agg(F.collect_set(F.struct("mark", "first")).alias("info")), "substring-info")
    # The texts are dealt out by key once; all three uses below have this very exchange.
    dealt = rows.repartition("key").join(info, "key").select("key", "text", "mark", "doc_id", "info")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _Hashes().__getitem__

        def emit(key, base, text, copy, _):
            words = words_of(text)
            if copy or len(words) < window:
                return None
            g, at = _seeds(np.fromiter(map(get, words), np.uint64, len(words)), window, n_seed)
            at = np.unique(at)
            return g[at].view(np.int64), np.full(len(at), key), at + base

        return _batches(batches, emit, ["hash", "key", "place"], 2)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _Hashes().__getitem__

        def emit(key, base, text, copy, places):
            words = words_of(text)
            if copy or len(words) < window:
                return None
            mine = places[(places >= base) & (places < base + len(words))] - base
            if not len(mine):
                return None
            h = np.fromiter(map(get, words), np.uint64, len(words))
            _, at = _seeds(h, window, n_seed)
            again = np.zeros(len(words), bool)
            again[mine] = True
            go = np.flatnonzero(again[at])
            return _rolled(h, window, _MUL[0])[go].view(np.int64), (_rolled(h, window, _MUL[1])[go] >> np.uint64(33)).astype(np.int32), np.full(len(go), key), go + base

        return _batches(batches, emit, ["hash", "check", "key", "place"], 1)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = (1 << 32) - 1
        for whole in batches:
            for b in slices(whole, "text"):
                out, found = [], []
                for i, (x, m, doc, about) in enumerate(zip(texts_of(b.column(1)), *(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)):
                    words, base, whole_of = words_of(x), _base(m, about), _original(m, about)
                    if whole_of is not None:
                        factors = np.array([(0, len(words), whole_of, 0)], FACTOR)
                    elif b.column(5)[i].is_valid:
                        p = _unpacked(b.column(5)[i].values)
                        p = p[(p[:, 0] >= base) & (p[:, 0] < base + max(1, len(words)))]
                        p = p[np.unique(p[:, 0], return_index=True)[1]]
                        factors = parse(np.stack([p[:, 0] - base, p[:, 1], p[:, 2] & low], 1), window)
                    else:
                        factors = np.zeros(0, FACTOR)
                    kept, at = [], 0
                    for start, length in zip(factors["start"].tolist(), factors["length"].tolist(), strict=True):
                        kept += words[at:start]
                        at = start + length
                    kept += words[at:]
                    data = b" ".join(kept)
                    found.append(factors)
                    out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(data).hexdigest(), len(factors), data))
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary())
                cols = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                flat = np.concatenate(found)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[n])) for n in FACTOR.names], FACTOR.names))
                yield pa.RecordBatch.from_arrays([*cols[:5], lists, cols[5].cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "factors", "kept"])

    # Rows whose answer is known are dealt out by key, the others meet by hash.
    meet = F.when(F.col("known"), F.xxhash64("key")).otherwise(F.col("hash"))
    found = dealt.mapInArrow(seeds, "hash long, key long, place long, known boolean, source long, there long").select("hash", "key", "place", "known")
    found = found.repartition(meet).sortWithinPartitions("hash").mapInArrow(_repeated, "key long, place long")
    found = found.groupBy("key").agg(F.collect_list("place").alias("places"))
    hits = dealt.join(found, "key").mapInArrow(windows, "hash long, check int, key long, place long, known boolean, source long, there long")
    hits = hits.repartition(meet).sortWithinPartitions("hash", "check", "key", "place").mapInArrow(_later, "key long, match binary")
    hits = hits.groupBy("key").agg(F.collect_list("match").alias("matches"))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors int, factors array<struct<start: long, length: long, source: long, source_start: long>>, kept string"
    return dealt.join(hits, "key", "left").select("key", "text", "mark", "doc_id", "info", "matches").mapInArrow(parsed, out)
