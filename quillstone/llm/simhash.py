"""SimHash near-duplicates: fingerprints, BK-trees over shards of fingerprints, components.

Fingerprints within RADIUS = 3 bits agree in at least one of four 16-bit blocks. A shard is all distinct fingerprints
that agree in some bits of one block: as many bits as leave about TREE fingerprints in a shard, so trees have the same
size however large the corpus is. Above 65,536 x TREE fingerprints a shard agrees in a whole block and in bits of one
of four pieces of the rest, by the same argument; so does a shard that is LARGE although others are not.

A shard's BK-tree has children keyed by integer Hamming distance to the parent, and a query follows only the edges
within the radius. Trees reach the tasks that hold their queries through the shuffle, not through the driver: all trees
together are all fingerprints. What is still larger than TREE is cut into several trees, each sent to every chunk of
the shard's queries, so no task holds an unbounded group.

Only distinct fingerprints take part; documents with one fingerprint are one class, found by aggregation. Inside a
shard links are united at once and one edge for each fingerprint leaves it, so large groups never make all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, slices, texts_of, written

RADIUS = 3
BLOCKS, BLOCK_BITS = 4, 16
#: Fingerprints that one BK-tree holds, about; and from how many on a shard is divided by more bits.
TREE, LARGE = 1024, 8192
#: Fingerprints that ask one copy of a tree, about.
QUERIES = 16_384
BOTH, STORED, ASKING = 0, 1, 2
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits: bit i is set if it is set in over half of the XXH64 (seed 42) of the text's word shingles."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], 42) for a, b in zip((ends - sizes)[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(0, dtype=np.uint32 if n > 65535 else np.uint16)
    return int(np.packbits(2 * counts.astype(np.int64) > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", doc_id: str = "doc_id", key: Column | None = None) -> DataFrame:
    """doc_id, fingerprint (the 64 bits as a signed long); and _key, the long value `key`, if one is given. Null text
    counts as empty, a null doc_id stays null, repeated rows have a row each, an empty table gives none, and other
    columns are ignored."""
    more = [key.cast("long").alias("_key")] if key is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                prints = np.array([fingerprint(x, width) for x in texts_of(b.column(1))], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64)), *b.columns[2:]], ["doc_id", "fingerprint", *b.schema.names[2:]])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)
    return rows.mapInArrow(run, "doc_id long, fingerprint long" + ", _key long" * len(more))


class BKTree:
    """A fingerprint's children are keyed by their integer Hamming distance to it. Built and searched level by level,
    all fingerprints or queries of a level in a few array operations."""

    EDGE = 128  # more than any distance: an edge is parent * EDGE + distance

    def __init__(self, prints: np.ndarray):
        self.prints = np.asarray(prints, np.uint64)
        self.visited = 0
        n = len(self.prints)
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo, at = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        while len(todo):
            edge = at * self.EDGE + np.bitwise_count(self.prints[at] ^ self.prints[todo])
            # The first with an edge becomes the child, the others go on below it.
            own, first, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(own)
            children.append(todo[first])
            at = todo[first][which]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, at = todo[left], at[left]
        edges, children = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the query, place of the fingerprint) for all within the radius."""
        queries = np.asarray(queries, np.uint64)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        step = max(1, (1 << 20) // max(1, len(self.prints)))
        for start in range(0, len(queries), step):
            part = queries[start : start + step]
            q = np.arange(len(part)) if len(self.prints) else np.zeros(0, np.int64)
            at = np.zeros(len(q), np.int64)
            while len(q):
                self.visited += len(q)
                d = np.bitwise_count(self.prints[at] ^ part[q]).astype(np.int64)
                hit = d <= radius
                out.append((q[hit] + start, at[hit]))
                lo = np.searchsorted(self.edges, at * self.EDGE + np.maximum(d - radius, 0), "left")
                n = np.searchsorted(self.edges, at * self.EDGE + d + radius, "right") - lo
                ends = np.cumsum(n)
                q = np.repeat(q, n)
                at = self.children[np.repeat(lo - ends + n, n) + np.arange(len(q))]
        a, b = zip(*out, strict=True)
        return np.concatenate(a), np.concatenate(b)


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links -> (node, least node of its component) for all nodes but the least ones."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _finer(block: int, bits: int) -> list[int]:
    """A whole block, and `bits` of each of four pieces of the other 48 bits."""
    others = [i for i in range(64) if i // BLOCK_BITS != block]
    whole = ((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * block)
    return [whole | sum(1 << i for i in others[12 * j : 12 * j + bits]) for j in range(4)]


def shard_masks(n: int) -> list[tuple[int, int]]:
    """(block, mask): n fingerprints that agree in a mask's bits are a shard, of about TREE if they are spread evenly."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / TREE)))
    if bits <= BLOCK_BITS:
        return [(k, ((1 << bits) - 1) << (BLOCK_BITS * k)) for k in range(BLOCKS)]
    return [(k, m) for k in range(BLOCKS) for m in _finer(k, min(bits - BLOCK_BITS, 12))]


def _shards(prints: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """k (number of the mask), v, fingerprint: a row for each mask."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for i, (_, m) in enumerate(masks)])
    return prints.select("fingerprint", F.explode(keys).alias("s")).select(F.col("s.k").alias("k"), F.col("s.v").alias("v"), "fingerprint")


def _shard_links(prints: DataFrame, radius: int) -> DataFrame:
    """prints(fingerprint), distinct -> edges (a, b): whose components are those of all links."""
    masks = shard_masks(prints.count())
    shards = written(_shards(prints, masks), "simhash-shards")
    # Shards of one fingerprint have no links.
    counts = written(shards.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-counts")
    if not counts.filter(F.col("n") > LARGE).isEmpty():
        # A large shard's rows go to shards of their own, by more bits of the fingerprint.
        large = shards.join(counts.filter(F.col("n") > LARGE).select("k", "v"), ["k", "v"], "left_semi")
        parts = [_shards(large.filter(F.col("k") == i).select("fingerprint").distinct(), [(b, m) for m in _finer(b, 12)]).withColumn("k", F.col("k") + len(masks) + 4 * i) for i, (b, _) in enumerate(masks)]
        few = shards.join(counts.filter(F.col("n") <= LARGE).select("k", "v"), ["k", "v"], "left_semi")
        for part in parts:
            few = few.unionByName(part)
        shards = written(few, "simhash-shards")
        counts = written(shards.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-counts")
    counts = counts.withColumn("trees", F.when(F.col("n") > LARGE, F.ceil(F.col("n") / TREE)).otherwise(1).cast("int")).withColumn("chunks", F.ceil(F.col("n") / QUERIES).cast("int"))
    # A shard of several trees: each fingerprint is in one tree, by a hash of its own, and queries all of them.
    # Queries of a very large shard come in chunks, and each chunk has a copy of the tree.
    own, mine = (F.pmod(F.xxhash64("fingerprint", F.lit(i)), F.col(c)).cast("int") for i, c in enumerate(("trees", "chunks")))
    rows = shards.join(counts, ["k", "v"]).select("k", "v", "trees", "chunks", "fingerprint", own.alias("own"), mine.alias("mine"))
    role = lambda tree, chunk, what: F.struct(tree.alias("tree"), chunk.alias("chunk"), what.cast("int").alias("role"))
    stored = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: role(F.col("own"), c, F.when(c == F.col("mine"), BOTH).otherwise(STORED)))
    asking = F.filter(F.transform(F.sequence(F.lit(0), F.col("trees") - 1), lambda t: role(t, F.col("mine"), F.lit(ASKING))), lambda x: x["tree"] != F.col("own"))
    rows = rows.select("k", "v", "fingerprint", F.explode(F.concat(stored, asking)).alias("at")).select("k", "v", "at.tree", "at.chunk", "at.role", "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard, tree and chunk. A group, all of one of them, may go on in the next batch."""

        def links() -> pa.RecordBatch:
            prints, roles = (np.concatenate(c) for c in zip(*held, strict=True))
            stored, asking = prints[roles != ASKING], prints[roles != STORED]
            q, at = BKTree(stored).near(asking, radius)
            a, b = asking[q], stored[at]
            # A link is found from both sides.
            a, b = united(a[a < b], b[a < b])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)], 1)
            roles, prints = b.column(4).to_numpy(), b.column(5).to_numpy().view(np.uint64)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]])
            for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                group = tuple(keys[x].tolist())
                if group != now and held:
                    yield links()
                    held = []
                now = group
                held.append((prints[x:y], roles[x:y]))
        if held:
            yield links()

    key = F.xxhash64("k", "v", "tree", "chunk")
    dealt = rows.repartition(key).sortWithinPartitions("k", "v", "tree", "chunk")
    return dealt.select("k", "v", "tree", "chunk", "role", "fingerprint").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a, b) of longs -> node, root: the smallest node (signed) of its component, for all nodes but the roots.

    Alternating large-star and small-star steps, each written to the shared folder: a node never meets more than its
    own neighbours, and what is kept stays linear in the edges. Ends when a round changes nothing.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        # Large star: a node's larger neighbours hang on its least neighbour (or itself).
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours hang on the least of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        last, e = e, written(step, name)
        discard(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """prints(doc_id, fingerprint) -> _print, root (one fingerprint for each component), component_id."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"radius must be from 0 to {BLOCKS - 1}")
    least = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-classes")
    edges = written(_shard_links(least.select("fingerprint"), radius), "simhash-edges")
    roots = components(edges, "simhash-components")
    discard(edges)
    classes = least.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    first = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(classes.join(first, "root").select(F.col("fingerprint").alias("_print"), "root", "component_id"), "simhash-members")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hexadecimal digits), component_id (the smallest doc_id reachable through
    links of `radius` or fewer differing bits, itself included), for every row.

    Null text counts as empty; texts without words have fingerprint zero and link like any other. Repeated rows and
    ids: a row each, one component for equal texts. Null doc_id: stays null and counts last; a component of nothing
    else has a null component_id. Empty table: no rows. Other columns are ignored. radius is at most 3: the four
    blocks guarantee no more.
    """
    d = written(fingerprints(docs, width, text, doc_id), "simhash-prints")
    # A fingerprint may stand for a third of all documents: the side of classes has a row for each, and the join
    # splits on that side's skew; the documents are small rows here.
    out = d.join(_classes(d, radius), F.col("fingerprint") == F.col("_print"))
    return out.select("doc_id", hex16("fingerprint").alias("fingerprint"), "component_id")


def hex16(x: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(x), 16, "0"))


def deduplicated(docs: DataFrame, radius: int = RADIUS, width: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, all columns as they are, with one row of each component: that with the smallest doc_id; of rows that share
    it any one, and a row without doc_id only where no row of the component has one.

    Null text counts as empty. Repeated rows and ids: copies of each other, so one of them stays. Empty table: no rows.
    Rows are found again by doc_id and a hash of the text; only where several rows share both are they compared. The
    columns that this takes have names that clash with none.
    """
    content = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    d = written(fingerprints(docs, width, text, doc_id, content), "simhash-prints")
    keys = d.groupBy("doc_id", "_key", "fingerprint").agg(F.count(F.lit(1)).alias("rows"))
    keys = keys.join(_classes(d, radius), F.col("fingerprint") == F.col("_print"))
    keep = keys.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key", "rows")).alias("f"))
    number, mine, often = (free_name(docs, n) for n in ("_number", "_content", "_often"))
    keep = written(keep.select(F.col("f.doc_id").alias(number), F.col("f._key").alias(mine), (F.col("f.rows") > 1).alias(often)), "simhash-kept")
    once, several = keep.filter(~F.col(often)).drop(often), keep.filter(often).drop(often)
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(number)) & (content == F.col(mine))
    out = docs.join(once, same, "left_semi")
    if several.isEmpty():
        return out
    # One row of each key; the partial aggregate leaves one for each task, however many share it.
    more = docs.join(several, same).dropDuplicates([number, mine]).drop(number, mine)
    return out.unionByName(more)
