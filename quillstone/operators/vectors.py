"""Exact inner-product search by matrix products: over rows, or over a stored collection of vector blocks.

A block is one row: the ids and one float matrix of near vectors, their mean and the largest distance from it. No
vector x of a block can score more than q.mean + |q| * radius, so a search skips the blocks that can't reach what a
query already has. The scores are the same as over rows: double products, rounded half away from zero.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of queries that are sent to all tasks at once; more are searched in blocks of as many.
QUERY_BYTES = 32 << 20
#: Vectors in a block at most; vectors whose sample chooses the pivots; scores that are held at once.
BLOCK_ROWS, PIVOT_SAMPLE, SCORES = 1024, 4096, 4 << 20


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero."""
    m = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * m + 0.5) / m, x) + 0.0


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix) of the vectors of an array column that are whole: not null, of the first one's length, without nulls
    or NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if not len(valid):
        return valid, np.zeros((0, 0))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)[valid].astype(np.int64)
    valid = valid[sizes == sizes[0]]
    some = column.take(pa.array(valid)) if len(valid) < len(column) else column
    x = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(valid), int(sizes[0]))
    whole = np.isfinite(x).all(1)
    return valid[whole], x[whole]


class Best:
    """The k best (score, id) of each query so far; ties go to the least id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.rows: list[list[tuple]] = [[] for _ in range(queries)]

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: list, skip: list | None, digits: int | None = None) -> None:
        """scores: queries x ids, rounded, or still to be rounded to digits. skip: the id that each query does not meet."""
        # Most scores can't be among the best, and are not rounded: half a unit of the last digit is what rounding adds.
        slack = 0.0 if digits is None else 0.5001 * 10.0**-digits
        some = scores >= (self.least[queries] - slack)[:, None]
        for at in np.flatnonzero(some.any(1)).tolist():
            q, mine = int(queries[at]), np.flatnonzero(some[at])
            if len(mine) > 4 * self.k:  # only those that can be among the best, and one more for the one that is skipped
                cut = np.partition(scores[at, mine], len(mine) - self.k - 1)[len(mine) - self.k - 1]
                mine = mine[scores[at, mine] >= cut - 2 * slack]
            values = scores[at, mine] if digits is None else rounded(scores[at, mine], digits)
            new = [(-v, ids[j]) for v, j in zip(values.tolist(), mine.tolist(), strict=True) if skip is None or ids[j] != skip[q]]
            self.rows[q] = sorted(self.rows[q] + new)[: self.k]
            if len(self.rows[q]) == self.k:
                self.least[q] = -self.rows[q][-1][0]


def _batch(qid: pa.Array, best: Best, cid: pa.DataType) -> pa.RecordBatch:
    at = [q for q, rows in enumerate(best.rows) for _ in rows]
    flat = [r for rows in best.rows for r in rows]
    return pa.RecordBatch.from_arrays([qid.take(pa.array(at, pa.int64())), pa.array([i for _, i in flat], cid), pa.array([-s + 0.0 for s, _ in flat], pa.float64())], ["qid", "cid", "score"])


def _query_blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, matrix) of the queries (qid, vector), some QUERY_BYTES at once. A query without a whole vector finds nothing."""
    rows, size = queries.select(F.count(F.lit(1)), F.sum(F.size("vector").cast("long"))).first()
    blocks = -(-8 * (size or 0) // QUERY_BYTES)
    for k in range(max(1, blocks) if rows else 0):
        part = (queries.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k) if blocks > 1 else queries).toArrow()
        at, x = matrix(part.column(1))
        if len(at):
            yield part.column(0).combine_chunks().take(pa.array(at)), x


def _schema(queries: DataFrame, cid: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("cid", cid), T.StructField("score", T.DoubleType())])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_rows(queries: DataFrame, corpus: DataFrame, k: int, digits: int, exclude_self: bool) -> DataFrame:
    """queries(qid, vector), corpus(cid, vector) -> qid, cid, score, rank."""
    spark, out = corpus.sparkSession, []
    schema = _schema(queries, corpus.schema["cid"].dataType)
    for qid, q in _query_blocks(queries):
        shared = spark.sparkContext.broadcast((qid, q))

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best, skip, kind = Best(len(q), k), qid.to_pylist() if exclude_self else None, None
            for b in batches:
                kind = b.column(0).type
                places, x = matrix(b.column(1))
                if x.shape[1] != q.shape[1]:
                    continue
                ids = b.column(0).take(pa.array(places)).to_pylist()
                # A query meets all rows of a batch at once: it is looked at once for them, not once for each few.
                step = max(1, SCORES // max(1, len(x)))
                for at in range(0, len(q), step):
                    best.add(np.arange(at, min(at + step, len(q))), q[at : at + step] @ x.T, ids, skip, digits)
            if kind is not None:
                yield _batch(qid, best, kind)

        out.append(_ranked(corpus.mapInArrow(run, schema), k))
    if not out:
        return _ranked(spark.createDataFrame([], schema), k)
    return reduce(DataFrame.unionByName, out)


# --- stored collections ---

BLOCKS = "cell int, n int, dim int, ids array<long>, vectors binary, mean array<double>, radius double"


def _pivots(vectors: DataFrame, cells: int) -> np.ndarray:
    """Vectors that lie far from each other, of a bounded sample chosen by a hash of the id: a space to cut, not a result."""
    sample = vectors.orderBy(F.xxhash64("cid"), "cid").limit(PIVOT_SAMPLE).toArrow()
    _, x = matrix(sample.column(1))
    if not len(x):
        return x
    chosen, near = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(cells, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    # A few rounds of moving each pivot into the middle of those that are nearest to it.
    p = x[chosen]
    for _ in range(5):
        at = (x @ p.T - 0.5 * (p**2).sum(1)).argmax(1)
        p = np.stack([x[at == c].mean(0) if (at == c).any() else p[c] for c in range(len(p))])
    return p


def vector_blocks(vectors: DataFrame, key: str, vector: str = "embedding", cells: int = 64) -> DataFrame:
    """Rows of BLOCKS: vectors of one cell (those nearest to one pivot) stand together, BLOCK_ROWS in a block.

    Null, broken and NaN vectors, and those of another length than the sample's, are left out. A large cell is dealt
    to several tasks by a hash of the id: a hot spot of the space is many blocks and not one task's work. An id is a
    whole number; repeated ids are vectors of their own.
    """
    v = vectors.select(F.col(key).cast("long").alias("cid"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    pivots = _pivots(v, cells)
    shared = v.sparkSession.sparkContext.broadcast(pivots)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            places, x = matrix(b.column(1))
            if not len(p) or x.shape[1] != p.shape[1]:
                continue
            at = (x @ p.T - 0.5 * (p**2).sum(1)).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0).take(pa.array(places)), b.column(1).take(pa.array(places))], ["cell", "cid", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            cell, ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=True):
                for at in range(a, z, BLOCK_ROWS):
                    end = min(at + BLOCK_ROWS, z)
                    if end == len(cell) and end - at < BLOCK_ROWS and not last:
                        held.append((cell[at:], ids[at:], x[at:]))
                        return
                    part = x[at:end]
                    mean = part.mean(0)
                    radius = float(np.sqrt(((part - mean) ** 2).sum(1)).max())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(cell[at])], pa.int32()), pa.array([end - at], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([ids[at:end].tolist()], pa.list_(pa.int64())), pa.array([part.astype("<f8").tobytes()], pa.binary()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([radius], pa.float64())],
                        ["cell", "n", "dim", "ids", "vectors", "mean", "radius"],
                    )

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2))[1]))
                yield from blocks(False)
        if held:
            yield from blocks(True)

    dealt = v.mapInArrow(assigned, "cell int, cid long, v array<double>").repartition("cell", F.pmod(F.xxhash64("cid"), F.lit(8)))
    return dealt.sortWithinPartitions("cell", "cid").mapInArrow(packed, BLOCKS)


def write_collection(vectors: DataFrame, path: str, key: str, vector: str = "embedding", cells: int = 64) -> None:
    vector_blocks(vectors, key, vector, cells).write.mode("overwrite").parquet(path)


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def search_blocks(queries: DataFrame, blocks: DataFrame, k: int, qid: str, vector: str = "embedding", digits: int = 5, exclude_self: bool = True) -> tuple[DataFrame, DataFrame]:
    """(qid, cid, score, rank; the same rows as over the vectors themselves) and (qid, blocks, skipped).

    Each query first meets the few blocks whose means it scores highest, all over the collection; what it finds there
    is the least that a block must be able to reach, in every task. Queries are a stated set, sent in blocks of
    QUERY_BYTES; blocks are read where they lie, and only k rows for each query and task are shuffled.
    """
    spark = blocks.sparkSession
    stated = queries.select(F.col(qid).alias("qid"), F.col(vector).alias("vector"))
    schema = T.StructType([*_schema(stated, T.LongType()).fields, T.StructField("blocks", T.LongType()), T.StructField("skipped", T.LongType())])
    means = blocks.select("n", F.xxhash64("ids").alias("block"), "mean", "radius")
    found, counts = [], []
    for ids, q in _query_blocks(stated):
        norms = np.sqrt((q**2).sum(1))
        least = _seeded(means, blocks, ids, q, k, digits, exclude_self)
        shared = spark.sparkContext.broadcast((ids, q, norms, least))

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            ids, q, norms, least = shared.value
            best, skip = Best(len(q), k), ids.to_pylist() if exclude_self else None
            best.least = least.copy()
            seen, skipped = 0, np.zeros(len(q), np.int64)
            for b in batches:
                for n, dim, cids, raw, mean, radius in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("n", "dim", "ids", "vectors", "mean", "radius")), strict=True):
                    if dim != q.shape[1]:
                        continue
                    seen += 1
                    # Half a unit of the last digit, and what rounding a sum may lose.
                    most = q @ np.array(mean) + norms * radius + 0.5 * 10.0**-digits + 1e-9 * (1 + norms)
                    go = np.flatnonzero(most >= best.least)
                    skipped += 1
                    skipped[go] -= 1
                    if len(go):
                        x = np.frombuffer(raw, "<f8").reshape(n, dim)
                        best.add(go, q[go] @ x.T, cids, skip, digits)
            if seen:
                got = _batch(ids, best, pa.int64())
                none = pa.nulls(len(got), pa.int64())
                yield pa.RecordBatch.from_arrays([*got.columns, none, none], ["qid", "cid", "score", "blocks", "skipped"])
                yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.float64()), pa.array(np.full(len(ids), seen)), pa.array(skipped)], ["qid", "cid", "score", "blocks", "skipped"])

        rows = blocks.mapInArrow(run, schema)
        found.append(_ranked(rows.filter("cid is not null").select("qid", "cid", "score"), k))
        counts.append(rows.filter("blocks is not null").groupBy("qid").agg(F.sum("blocks").alias("blocks"), F.sum("skipped").alias("skipped")))
    if not found:
        none = spark.createDataFrame([], schema)
        return _ranked(none.select("qid", "cid", "score"), k), none.select("qid", "blocks", "skipped")
    return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, counts)


#: Blocks of the highest means that a query looks into first.
FIRST = 2


def _seeded(means: DataFrame, blocks: DataFrame, ids: pa.Array, q: np.ndarray, k: int, digits: int, exclude_self: bool) -> np.ndarray:
    """For each query, the k-th best score within its FIRST nearest blocks; -inf if those hold fewer."""
    spark, kind = means.sparkSession, "q int, block long, s double"
    shared = spark.sparkContext.broadcast(q)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = Best(len(q), FIRST)
        for b in batches:
            at, m = matrix(b.column(1))
            if m.shape[1] == q.shape[1]:
                best.add(np.arange(len(q)), q @ m.T, b.column(0).take(pa.array(at)).to_pylist(), None)
        rows = [(i, block, -s) for i, r in enumerate(best.rows) for s, block in r]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.float64()), strict=True)], ["q", "block", "s"])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "block")
    # FIRST rows for each query of this block of queries.
    first = means.select("block", "mean").mapInArrow(near, kind).withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= FIRST).select("q", "block").toArrow()
    by: dict[int, list[int]] = {}
    for i, block in zip(first.column(0).to_pylist(), first.column(1).to_pylist(), strict=True):
        by.setdefault(block, []).append(i)
    chosen = spark.sparkContext.broadcast(by)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, by = shared.value, chosen.value
        skip = ids.to_pylist() if exclude_self else None
        for b in batches:
            for n, dim, cids, raw, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block not in by or dim != q.shape[1]:
                    continue
                go = np.array(by[block])
                best = Best(len(q), k)
                best.add(go, rounded(q[go] @ np.frombuffer(raw, "<f8").reshape(n, dim).T, digits), cids, skip)
                rows = [(int(i), -s) for i in go for s, _ in best.rows[i]]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([s for _, s in rows], pa.float64())], ["q", "s"])

    got = blocks.select("n", "dim", "ids", "vectors", F.xxhash64("ids").alias("block")).mapInArrow(look, "q int, s double").toArrow()
    least = np.full(len(q), -np.inf)
    who, scores = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.lexsort([-scores, who])
    who, scores = who[order], scores[order]
    start = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else np.zeros(0, np.int64)
    for a, z in itertools.pairwise([*start.tolist(), len(who)]):
        if z - a >= k:
            least[who[a]] = scores[a + k - 1]
    return least
