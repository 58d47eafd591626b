"""The learning experiment: character n-gram TF-IDF and ridge regression of a log target, judged on three splits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import three_way_split
from ..stages import Stages

#: Characters that are cut into grams at once; grams that a task counts before it hands them on; entries of a table of steps.
SLICE, HELD, TABLE = 1 << 20, 1 << 18, 1 << 23
#: Texts in a block of counts; numbers of a sum that one task adds up; directions that a preconditioner knows.
BLOCK, PART, SKETCH = 256, 1 << 16, 96


def split(docs: DataFrame) -> DataFrame:
    """Rows with text and a target above 0, the log target, and their split."""
    kept = docs.filter((F.col("text") != "") & (F.col("n_chars") != 0)).select("doc_id", "text", F.log(F.col("n_chars").cast("double")).alias("y"))
    return three_way_split(kept, "doc_id", 42)


def grams(x: Column, low: int = 2, high: int = 4) -> Column:
    """Runs of low to high characters, repeats included: from an array of the characters, so that the work is linear."""
    letters = F.filter(F.split(x, ""), lambda c: c != "")
    run = lambda c, n: F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(0), F.size(c) - n), lambda i: F.concat(*[F.get(c, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))
    # Bound by a one-element array, so that the characters are split once.
    return F.flatten(F.transform(F.array(letters), lambda c: F.flatten(F.array(*[run(c, n) for n in range(low, high + 1)]))))


def vocabulary(rows: DataFrame, top: int) -> DataFrame:
    """gram, df, idf (smoothed: ln((1 + n) / (1 + df)) + 1) of the `top` most frequent grams; ties by gram."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    df = rows.select("doc_id", F.explode(F.array_distinct(grams(F.col("text")))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    best = df.orderBy(F.desc("df"), "gram").limit(top)
    return best.crossJoin(F.broadcast(n)).select("gram", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """The texts in slices of about SLICE characters (one text at least), and where each slice begins."""
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and (at == first or size + len(texts[at] or "") <= SLICE):
            size += len(texts[at] or "")
            at += 1
        yield first, [t or "" for t in texts[first:at]]


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, one text after the other, and whose each is."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])


def gram_counts(texts: list[str], low: int = 2, high: int = 4) -> Iterator[tuple[list[str], list[int]]]:
    """The distinct runs of low to high characters of texts, and how often they occur in all of them."""
    points, doc = _points(texts)
    letters = np.flatnonzero(np.bincount(points))
    base = len(letters) + 1
    if base**high >= 1 << 63:  # so many letters that a run is no number
        counts = Counter(t[i : i + n] for t in texts for n in range(low, high + 1) for i in range(len(t) - n + 1))
        yield list(counts), list(counts.values())
        return
    number = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, np.int64)
    number[letters] = np.arange(1, base)
    place = number.take(points)
    key = place
    for n in range(2, high + 1):
        # A run as the digits of a number.
        key = key[:-1] * base
        key += place[n - 1 :]
        if n < low or not len(key):
            continue
        got = pc.value_counts(pa.array(key[doc[: len(key)] == doc[n - 1 :]]))
        distinct = got.field(0).to_numpy()
        flat = letters.astype("<u4")[np.stack([distinct // base**k % base - 1 for k in range(n - 1, -1, -1)], 1)].tobytes().decode("utf-32-le", "surrogatepass") if len(distinct) else ""
        yield [flat[i : i + n] for i in range(0, len(flat), n)], got.field(1).to_pylist()


def most_frequent(train: DataFrame, features: int) -> list[str]:
    """The most frequent grams of the training rows; ties by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Counted over all batches of a task, as far as HELD grams reach.
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["gram", "times"])
            held.clear()
            return got

        for b in batches:
            for _, part in _slices(b.column(0).to_pylist()):
                for runs, times in gram_counts(part):
                    for gram, n in zip(runs, times, strict=True):
                        held[gram] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    counts = train.select("text").mapInArrow(run, "gram string, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    return [r["gram"] for r in counts.orderBy(F.desc("times"), "gram").limit(features).collect()]


class Trie:
    """Chosen grams as steps from node to node: a step of all places of a text is one look into an array."""

    def __init__(self, grams: list[str]):
        letters = sorted({ord(c) for g in grams for c in g})
        self.base, self.depth = len(letters) + 1, max(map(len, grams), default=0)
        self.number = np.zeros(0x110000, np.int32)
        self.number[letters] = np.arange(1, self.base)
        # Node 0 is nowhere, 1 the root; letter 0 is any other.
        steps: dict[tuple[int, int], int] = {}
        gram: list[int] = [-1, -1]
        for i, g in enumerate(grams):
            at = 1
            for c in g:
                step = (at, int(self.number[ord(c)]))
                if step not in steps:
                    steps[step] = len(gram)
                    gram.append(-1)
                at = steps[step]
            gram[at] = i
        self.gram, self.size = np.array(gram, np.int32), len(grams)
        keys = np.array([a * self.base + c for a, c in steps], np.int64)
        to = np.array(list(steps.values()), np.int32)
        self.dense = None
        if len(gram) * self.base <= TABLE:
            self.dense = np.zeros(len(gram) * self.base, np.int32)
            self.dense[keys] = to
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], -1), np.append(to[order], 0).astype(np.int32)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        key = nodes.astype(np.int64) * self.base + letters
        if self.dense is not None:
            return self.dense.take(key)
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys.take(at) == key, self.to.take(at), 0)

    def counts(self, texts: list[str]) -> np.ndarray:
        """texts x grams: how often each text has each gram."""
        points, doc = _points(texts)
        letters, size, found = self.number.take(points), self.size, []
        nodes = self.step(np.ones(len(letters), np.int32), letters)
        for n in range(1, self.depth + 1):
            if n > 1:
                nodes = self.step(nodes[:-1], letters[n - 1 :])
            i = self.gram.take(nodes)
            go = np.flatnonzero((i >= 0) & (doc[: len(i)] == doc[n - 1 :]))
            found.append(doc.take(go).astype(np.int64) * size + i.take(go))
            if len(nodes) <= 1:
                break
        return np.bincount(np.concatenate(found) if found else np.zeros(0, np.int64), minlength=len(texts) * size).reshape(len(texts), size)


def counted(rows: DataFrame, grams: list[str]) -> DataFrame:
    """rows(split, y, text) as blocks of BLOCK texts of one split: split, y, ends, place, times: for each text how often it
    has which of the grams. The four are arrays of float64, int32, and unsigned numbers of 1, 2 or 4 bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False)
            for split in pc.unique(b.column(0)).to_pylist():
                mine = np.flatnonzero(pc.equal(b.column(0), split).to_numpy(zero_copy_only=False))
                for first, part in _slices(b.column(2).take(pa.array(mine)).to_pylist()):
                    for at in range(0, len(part), BLOCK):
                        table = trie.counts(part[at : at + BLOCK])
                        row, place = np.nonzero(table)
                        parts = [y[mine[first + at : first + at + len(table)]].astype("<f8"), np.cumsum(np.bincount(row, minlength=len(table))).astype("<i4"), _narrow(place), _narrow(table[row, place])]
                        yield pa.RecordBatch.from_arrays([pa.array([split]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["split", "y", "ends", "place", "times"])

    return rows.select("split", "y", "text").mapInArrow(run, "split string, y binary, ends binary, place binary, times binary")


def _narrow(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


class Block:
    """Some texts as rows of a sparse matrix: y, starts, row, place, value."""

    def __init__(self, b: pa.RecordBatch, i: int, idf: np.ndarray | None = None):
        y, ends, *both = (b.column(c)[i].as_buffer() for c in range(1, 5))
        self.y, ends = np.frombuffer(y, "<f8"), np.frombuffer(ends, "<i4")
        self.place, times = (np.frombuffer(x, f"<u{max(1, x.size // max(1, int(ends[-1])))}") for x in both)
        self.row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        if idf is not None:
            self.value = times * idf.take(self.place)
            norm = np.sqrt(self.by_row(self.value * self.value))
            self.value /= norm.take(self.row)

    def by_row(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, x, len(self.y))

    def times(self, v: np.ndarray) -> np.ndarray:
        return self.by_row(self.value * v.take(self.place))

    def dense(self, size: int) -> np.ndarray:
        out = np.zeros((len(self.y), size))
        out[self.row, self.place] = self.value
        return out


def _summed(blocks: DataFrame, size: tuple[int, ...], f: Callable[[Block], np.ndarray], idf: np.ndarray | None = None) -> np.ndarray:
    """The sum of f over all blocks: an array of each task, summed in parts by others."""
    n = int(np.prod(size))
    cut = max(1, -(-n // PART))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for b in batches:
            for i in range(b.num_rows):
                out += f(Block(b, i, idf))
        parts = np.array_split(out.reshape(-1), cut)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cut), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "sum"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0.0) + np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "sum"])

    kind = "part int, sum binary"
    got = {r["part"]: np.frombuffer(r["sum"]) for r in blocks.mapInArrow(run, kind).repartition(cut, "part").mapInArrow(add, kind).collect()}
    return np.concatenate([got[k] for k in range(cut)]).reshape(size) if got else np.zeros(size)


def _nearly_inverse(sketch: np.ndarray, test: np.ndarray, alpha: float) -> Callable[[np.ndarray], np.ndarray]:
    """A preconditioner for A + alpha from sketch = A test (Nystroem): the directions in which A is large are solved."""
    shift = np.finfo(float).eps * np.linalg.norm(sketch)
    moved = sketch + shift * test
    inner = test.T @ moved
    w, q = np.linalg.eigh((inner + inner.T) / 2)
    go = w > max(w.max(initial=0.0), 0.0) * 1e-12
    if not go.any():
        return lambda r: r
    u, sigma, _ = np.linalg.svd(moved @ (q[:, go] / np.sqrt(w[go])), full_matrices=False)
    large = np.maximum(sigma**2 - shift, 0.0)
    return lambda r: r + u @ (((large[-1] + alpha) / (large + alpha) - 1) * (u.T @ r))


def ridge(train: DataFrame, idf: np.ndarray, n: int, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and offset for blocks of training rows: conjugate gradients on the normal equations of the centred matrix,
    one pass over the blocks for each step; a first pass finds the directions in which they are ill-conditioned."""
    size, n = len(idf), max(n, 1)
    test = np.linalg.qr(np.random.default_rng(0).normal(size=(size, min(SKETCH, size))))[0]

    def first(b: Block) -> np.ndarray:
        x = b.dense(size)
        return x.T @ np.column_stack([np.ones(len(b.y)), b.y, x @ test])

    start = _summed(train, (size, 2 + test.shape[1]), first, idf)
    total, square = _summed(train, (2,), lambda b: np.array([b.y.sum(), b.y @ b.y]))
    mean, y = start[:, 0] / n, total / n
    centred = lambda out, v: out - n * np.outer(mean, mean @ v).reshape(out.shape)
    near = _nearly_inverse(centred(start[:, 2:], test), test, alpha)
    w, r = np.zeros(size), start[:, 1] - n * mean * y
    z = near(r)
    p, rz, loss = z, r @ z, (square - n * y * y) / 2
    # Until a step lowers the loss by less than 1e-9 of it.
    for _ in range(200):
        if not rz > 0:
            break
        step = p
        a = centred(_summed(train, (size,), lambda b: np.bincount(b.place, b.value * b.times(step).take(b.row), size), idf), p) + alpha * p  # noqa: B023
        go = rz / (p @ a)
        w, r, loss = w + go * p, r - go * a, loss - go * rz / 2
        if go * rz / 2 <= 1e-9 * loss:
            break
        z, was = near(r), rz
        rz = r @ z
        p = z + rz / was * p
    return w, y - mean @ w


def experiment(rows: DataFrame, features: int = 5000, alpha: float = 1.0) -> DataFrame:
    """split, n, mae, rmse, r2 (log target), mae_units (target itself). Whole texts; grams are counted by the training
    rows alone. Each text is cut into grams twice: to choose the most frequent, and to write its counts, which all steps of
    the fit and the errors read. The plan is run now, stage by stage."""
    with Stages(rows.sparkSession, "ridge") as stages:
        train = rows.filter("split = 'train'")
        n = train.count()
        chosen = most_frequent(train, features)
        blocks = stages.table(counted(rows, chosen), "counts")
        known, size = blocks.filter("split = 'train'"), len(chosen)
        idf = np.log((1 + n) / (1 + _summed(known, (size,), lambda b: np.bincount(b.place, minlength=size).astype(float)))) + 1
        w, offset = ridge(known, idf, n, alpha)

        def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    some = Block(b, i, idf)
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(some.y)), pa.array(some.y), pa.array(some.times(w) + offset)], ["split", "y", "prediction"])

        p = blocks.mapInArrow(predicted, "split string, y double, prediction double")
        err, units = F.col("prediction") - F.col("y"), F.exp("prediction") - F.exp("y")
        return stages.result(p.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(err)), 4).alias("mae"), F.round(F.sqrt(F.avg(err * err)), 4).alias("rmse"), F.round(1 - F.sum(err * err) / (F.var_pop("y") * F.count(F.lit(1))), 4).alias("r2"), F.round(F.avg(F.abs(units)), 2).alias("mae_units")))
