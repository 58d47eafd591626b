"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document's windows are its runs of as many words as an item has. A document with fewer words is one window, whole:
it is verified with each longer item that shares a shingle, whatever their fingerprints. Of the other windows, those
without a shingle of any item have similarity 0 to all and get no fingerprint. A window's fingerprint looks up the
items of its length: two fingerprints within RADIUS = 15 bits agree in one of four 16-bit blocks but for 3 bits, so the
index holds each block of each item with up to 2 bits changed, the lookup asks with up to 1 more, and every item within
the radius is found, and few others (about one in 25). Those within it are verified by the weighted Jaccard similarity
of their shingles, a shingle's weight being how often it occurs.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_rows, shared_dir, slices, texts_of

RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
SHINGLE = 5
#: Bytes of item texts that one pass over the documents takes along; more items make more passes.
BLOCK_BYTES = 4 << 20
# ASCII letters in lower case, other visible ASCII but digits as spaces: case and punctuation do not hide a passage.
_FOLD = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))


def _changes(bits: int) -> np.ndarray:
    """Masks of at most `bits` bits of a block."""
    return np.array([sum(1 << i for i in c) for n in range(bits + 1) for c in combinations(range(BLOCK_BITS), n)], np.int64)


#: What the index and a lookup change in a block: together up to RADIUS // BLOCKS bits.
_STORED, _ASKED = _changes(2), _changes(1)


def fold(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def shingles(words: list[bytes]) -> list[bytes]:
    """Five words each; fewer words: all of them as one; none: none."""
    return [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))] if words else []


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(sums: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints from the counts of set bits among n shingles: a bit is 1 if set in over half."""
    return np.packbits(2 * sums > n, axis=1, bitorder="little").view("<u8").reshape(-1)


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    union = sum(a.values()) + sum(b.values()) - both
    return both / union if union else 0.0


class Items:
    """The index over one block of items."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items = [(i, w) for i, text in items if (w := fold(text))]
        self.vocabulary: dict[bytes, int] = {}
        self.weights, prints, self.lengths = [], [], np.array([len(w) for _, w in self.items], np.int64)
        keys = []
        for _, words in self.items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
            s = shingles(words)
            self.weights.append(Counter(s))
            prints.append(_packed(_bits(np.array([xxhash.xxh64_intdigest(x) for x in s], np.uint64)).sum(0, dtype=np.int64)[None], len(s))[0])
            keys.append(self._keys(np.array([self.vocabulary[w] for w in words], np.uint64), min(SHINGLE, len(words))))
        self.prints = np.array(prints, np.uint64)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys]) if keys else np.zeros(0, np.int64)
        width = np.repeat(np.minimum(self.lengths, SHINGLE), [len(k) for k in keys]) if keys else owner
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        #: By shingle width (5, or that of shorter items): sorted keys and their items.
        self.table = {}
        for w in np.unique(width).tolist():
            pick = width == w
            order = np.argsort(flat[pick], kind="stable")
            self.table[w] = (flat[pick][order], owner[pick][order])
        #: Sorted keys of length, block and value, and their items.
        self.sizes = np.unique(self.lengths)
        size = np.searchsorted(self.sizes, self.lengths)
        blocks = self._block_keys(self.prints, _STORED) | (size << 18)[:, None]
        order = np.argsort(blocks, axis=None, kind="stable")
        self.block_keys, self.block_items = blocks.reshape(-1)[order], (order // blocks.shape[1]).astype(np.int32)
        #: Of the lookups so far: items they could have met, and items whose distance was taken.
        self.possible, self.compared = 0, 0

    @staticmethod
    def _block_keys(prints: np.ndarray, changes: np.ndarray) -> np.ndarray:
        """For each fingerprint, all its blocks' numbers and values, changed by each mask."""
        parts = [((prints >> np.uint64(BLOCK_BITS * k)) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ changes | k << BLOCK_BITS for k in range(BLOCKS)]
        return np.concatenate(parts, 1)

    @staticmethod
    def _keys(ids: np.ndarray, width: int) -> np.ndarray:
        """A key for each run of `width` word numbers; equal runs, equal keys (keys that collide are told apart later)."""
        n = len(ids) - width + 1
        out = np.zeros(max(n, 0), np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        return out

    def near(self, prints: np.ndarray, length: int) -> dict[int, list[tuple[int, int]]]:
        """For each place in prints: (item of that length, distance) within RADIUS, through the block index."""
        size = int(np.searchsorted(self.sizes, length))
        keys = (self._block_keys(prints, _ASKED) | size << 18).reshape(-1)
        lo = np.searchsorted(self.block_keys, keys, "left")
        n = np.searchsorted(self.block_keys, keys, "right") - lo
        ends = np.cumsum(n)
        at = np.repeat(np.repeat(np.arange(len(prints)), BLOCKS * len(_ASKED)), n)
        items = self.block_items[np.repeat(lo - ends + n, n) + np.arange(len(at))].astype(np.int64)
        pairs = np.unique(at * len(self.items) + items)
        at, items = pairs // len(self.items), pairs % len(self.items)
        self.possible += len(prints) * int((self.lengths == length).sum())
        self.compared += len(pairs)
        d = np.bitwise_count(self.prints[items] ^ prints[at])
        out: dict[int, list[tuple[int, int]]] = {}
        for p, i, x in zip(*(c[d <= RADIUS].tolist() for c in (at, items, d)), strict=True):
            out.setdefault(p, []).append((i, x))
        return out

    def find(self, text: bytes, least: float) -> list[tuple[int | None, int, int, int, float]]:
        """(item_id, first word, words, distance, similarity) of the best window for each item reached."""
        words = fold(text)
        if not words or not self.items:
            return []
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        best: dict[int, tuple] = {}
        starts: dict[int, set[int]] = defaultdict(set)
        longer: set[int] = set()
        for width, (keys, owners) in self.table.items():
            if len(ids) < width:
                continue
            known = np.concatenate([[0], np.cumsum(ids > 0)])
            full = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(full):
                continue
            mine = self._keys(ids, width)[full]
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            for p, a, b in zip(full[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                long = self.lengths[owners[a:b]] > len(words)
                longer.update(owners[a:b][long].tolist())
                for n in np.unique(self.lengths[owners[a:b]][~long]).tolist():
                    # Every item-sized window that holds this shingle.
                    starts[n].update(range(max(0, p - n + width), min(p, len(words) - n) + 1))
        if longer:
            whole = shingles(words)
            mine, bits = Counter(whole), _bits(np.array([xxhash.xxh64_intdigest(x) for x in whole], np.uint64))
            bits_ = _packed(bits.sum(0, dtype=np.int64)[None], len(whole))[0]
            for item in longer:
                s = similarity(mine, self.weights[item])
                if s >= least:
                    best[item] = ((-s, 0), (self.items[item][0], 0, len(words), int(np.bitwise_count(self.prints[item] ^ bits_)), s))
        for n, places in starts.items():
            places = sorted(places)
            m = max(1, n - SHINGLE + 1)
            for at in range(0, len(places), 4096):
                part = np.array(places[at : at + 4096])
                # Shingles of the spans that these windows cover, each hashed once.
                need = np.unique((part[:, None] + np.arange(m)).reshape(-1))
                text_of = {s: b" ".join(words[s : s + min(n, SHINGLE)]) for s in need.tolist()}
                bits = _bits(np.array([xxhash.xxh64_intdigest(x) for x in text_of.values()], np.uint64))
                sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(bits, 0, dtype=np.int64)])
                first = np.searchsorted(need, part)
                for k, found in self.near(_packed(sums[first + m] - sums[first], m), n).items():
                    mine = None
                    for item, distance in found:
                        mine = mine or Counter(text_of[s] for s in range(part[k], part[k] + m))
                        s = similarity(mine, self.weights[item])
                        if s >= least and (item not in best or (-s, int(part[k])) < best[item][0]):
                            best[item] = ((-s, int(part[k])), (self.items[item][0], int(part[k]), n, distance, s))
        return [best[i][1] for i in sorted(best)]


_INDEXES: dict[str, Items] = {}


def _index(name: str, items: list[tuple[int | None, bytes]]) -> Items:
    """The index of a block of items, made once in each worker process; the last one is kept."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = Items(items)
    return _INDEXES[name]


def item_blocks(items: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of at most BLOCK_BYTES (or one item), read through the driver one block at a time."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("long"), F.col(text).cast("string")).toLocalIterator():
        data = (row[1] or "").encode()
        if block and size + len(data) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], data))
        size += len(data)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity: for each document row and item, the window most
    similar to the item (ties: the first), if its similarity is at least `least`. A document of fewer words than the
    item is one window, whole.

    Words are compared without ASCII case and punctuation, in shingles of five. An item of fewer words has one
    shingle of them all; an item, text or document without words (null, empty) matches nothing. Repeated rows and
    ids: each counts. A null id stays null. Empty tables: no rows. Other columns are ignored. No shuffle: items go
    along with each pass over the documents, BLOCK_BYTES of text at most, and a larger benchmark makes more passes.
    """
    spark: SparkSession = docs.sparkSession
    rows, schema = doc_rows(docs, text, doc_id), "doc_id long, item_id long, start_word int, n_words int, distance int, similarity double"
    parts = []
    for block in item_blocks(items, item_text, item_id):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value)
            for whole in batches:
                for b in slices(whole, "text"):
                    found = [(doc, *hit) for doc, x in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True) for hit in index.find(x, least)]
                    cols = list(zip(*found, strict=True)) or [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

        parts.append((rows.mapInArrow(run, schema), shared))
        if len(parts) == 2 and isinstance(parts[0], tuple):
            # More than one block: each block's results are written once, and its items leave the executors.
            parts[0] = _settled(*parts[0])
        if len(parts) > 1:
            parts[-1] = _settled(*parts[-1])
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0][0] if isinstance(parts[0], tuple) else spark.read.schema(schema).parquet(*parts)


def _settled(part: DataFrame, shared: Broadcast) -> str:
    path = shared_dir(part.sparkSession, "contaminated")
    part.write.parquet(path)
    shared.unpersist()
    return path


def decontaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of docs, all columns as they are, that hold no benchmark passage. Null and empty texts hold none, and a
    null or empty item is in none. Repeated rows and ids: each row is judged by its own text. Empty tables: of docs,
    no rows; of items, all rows stay. Every block of items reads what the blocks before it left."""
    for block in item_blocks(items, item_text, item_id):
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared.value)
            for whole in batches:
                for b in slices(whole, text):
                    yield b.filter(pa.array([not index.find(x, least) for x in texts_of(b.column(b.schema.get_field_index(text)))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
