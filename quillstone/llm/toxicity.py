"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are itself and its character n-grams (3 to 5, with word ends), hashed into BUCKETS rows of one
embedding table, so a misspelling shares most vectors with the word it stands for. A text is the average of all its
features and of PAD zero vectors, which keep a text of very few words near the prior; a linear softmax over two
classes follows. Training is end to end: the table and the softmax move together, by full-batch Adam whose step for
the table is normalised by the largest gradient, so that what many texts share moves first and rare words hardly.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, slices, texts_of

BUCKETS, DIM = 1 << 16, 2
#: Zero vectors in each average, and what the average is multiplied by before the softmax.
PAD, SCALE = 200, 400.0
#: The softmax's log odds for a text without words, before training.
BIAS = -0.8
#: Labelled documents that training may see, chosen by a hash of doc_id: the bound of the sample.
SAMPLE_DOCS = 3_000
#: The share of the training documents that a row must occur in to be learned; in two at least.
LEAST_SHARE = 1 / 500
_FOLD = bytes(i if i > 127 else ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(256))
#: Characters of one piece of a very long word, and how many it shares with the next: every 5-gram is in a piece.
PIECE, OVERLAP = 1000, 4
# Other spaces, punctuation and controls, zero-width space and byte-order mark (none lies above).
_MARKS = {i: " " for i in range(128, 0x20000) if unicodedata.category(chr(i))[0] in "ZP" or unicodedata.category(chr(i)) == "Cc" or i in (0x200B, 0xFEFF)}


def _pieces(word: bytes) -> list[bytes]:
    w = word.decode("utf-8", "replace")
    return [w[i : i + PIECE].encode() for i in range(0, len(w) - OVERLAP, PIECE - OVERLAP)] if len(w) > PIECE else [word]


def words_for(text: bytes) -> list[bytes]:
    """ASCII letters in lower case, other visible ASCII but digits as spaces; words end at Unicode spaces and
    punctuation too. A word of more than PIECE characters is cut into overlapping pieces, each a word of its own."""
    words = text.translate(_FOLD).split()
    if not text.isascii():
        words = [x for w in words for x in ((w,) if w.isascii() else [y.encode() for y in w.decode("utf-8", "replace").translate(_MARKS).split()])]
    if max(map(len, words), default=0) > PIECE:
        words = [x for w in words for x in _pieces(w)]
    return words


def features(word: bytes) -> list[int]:
    """The word and all its n-grams of characters, as rows of the table."""
    w = "<" + word.decode("utf-8", "replace") + ">"
    grams = {w} | {w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)}
    return [xxhash.xxh32_intdigest(g.encode()) & (BUCKETS - 1) for g in sorted(grams)]


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIM
    weight: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def logits(self) -> np.ndarray:
        """What a row adds to the sum of a text, as log odds of class 1."""
        return self.table.astype(np.float64) @ (self.weight[:, 1] - self.weight[:, 0]) * SCALE


@dataclass
class Bags:
    """Texts as words and words as rows of the table: which word stands in which text with what share of its average, and
    which row is of which word."""

    word: np.ndarray
    doc: np.ndarray
    share: np.ndarray
    rows: np.ndarray
    owner: np.ndarray
    n_docs: int
    n_words: int

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of a value for each row, each text's average (times SCALE)."""
        return np.bincount(self.doc, self.share * np.bincount(self.owner, values[self.rows], self.n_words)[self.word], self.n_docs)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Of a value for each text, what reaches each row: the transpose of sums()."""
        return np.bincount(self.rows, np.bincount(self.word, self.share * values[self.doc], self.n_words)[self.owner], BUCKETS)


def loss_and_gradient(table: np.ndarray, weight: np.ndarray, bias: np.ndarray, bags: Bags, y: np.ndarray, balance: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The balanced cross-entropy of the softmax over averaged rows, and its gradient by table, weight and bias."""
    h = np.stack([bags.sums(table[:, k]) for k in range(table.shape[1])], 1)
    z = h @ weight + bias
    odds = np.clip(z[:, 1] - z[:, 0], -30, 30)
    g = (1 / (1 + np.exp(-odds)) - y) * balance
    gz = np.stack([-g, g], 1)
    gh = gz @ weight.T
    loss = float((balance * (np.logaddexp(0, odds) - y * odds)).sum())
    return loss, np.stack([bags.spread(gh[:, k]) for k in range(table.shape[1])], 1), h.T @ gz, gz.sum(0)


def counted(text: bytes) -> dict[bytes, int]:
    """The words of a text and how often each stands in it, in order of first place."""
    seen: dict[bytes, int] = {}
    for w in words_for(text):
        seen[w] = seen.get(w, 0) + 1
    return seen


def train(texts: list[bytes], labels: list[int], seed: int = 7, rounds: int = 100, rate: float = 0.1) -> Model:
    """train_counts() of the words of texts."""
    return train_counts([counted(t) for t in texts], labels, seed, rounds, rate)


def train_counts(texts: list[dict[bytes, int]], labels: list[int], seed: int = 7, rounds: int = 100, rate: float = 0.1) -> Model:
    """Both classes weigh the same in the loss; table, weights and bias move together.
    Without texts, or with one class only, the table is zero and every text gets the first bias alone."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    n1, n0 = y.sum(), (1 - y).sum()
    bias = np.array([0.0, BIAS])
    table, weight = rng.normal(0, 0.01, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2))
    if not n1 or not n0:
        return Model(np.zeros((BUCKETS, DIM)), weight, bias)
    # Texts -> distinct words with counts; words -> rows.
    number: dict[bytes, int] = {}
    word = np.array([number.setdefault(w, len(number)) for seen in texts for w in seen], np.int32)
    count = np.array([n for seen in texts for n in seen.values()], np.float64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(seen) for seen in texts])
    of = [np.array(features(w), np.int32) for w in number]
    lengths = np.array([len(f) for f in of])
    rows = np.concatenate(of)
    owner = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    share = count * SCALE / (np.bincount(doc, count * lengths[word], len(texts)) + PAD)[doc]
    bags = Bags(word, doc, share, rows, owner, len(texts), len(lengths))
    # A row occurs in at least as many texts as the most frequent of its words does.
    frequent = np.zeros(BUCKETS, np.int64)
    np.add.at(frequent, rows, np.bincount(word, minlength=len(lengths))[owner])
    keep = (frequent >= max(2, LEAST_SHARE * len(texts)))[:, None]
    table *= keep
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    params = (table, weight, bias)
    state, most = [(np.zeros_like(p), np.zeros_like(p)) for p in params], None
    for step in range(1, rounds + 1):
        _, gt, gw, gb = loss_and_gradient(table, weight, bias, bags, y, balance)
        gt = gt * keep + 1e-5 * table
        most = most or np.abs(gt).max()
        for (m, v), p, grad, least in zip(state, params, (gt, gw + 1e-4 * weight, gb), (most, 1e-8, 1e-8), strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + least)
    return Model(table, weight, bias)


class Scorer:
    """Scores texts by distinct words: a word's part in the average is a sum and a count."""

    MOST = 500_000

    def __init__(self, logits: np.ndarray, bias: float):
        self.logits, self.bias = logits, bias
        self.number: dict[bytes, int] = {}
        self.part, self.size = np.zeros(1024), np.zeros(1024)

    def _learn(self, docs: list[list[bytes]]) -> None:
        new = set().union(*docs) - self.number.keys()
        if len(self.number) + len(new) > self.MOST:
            self.number.clear()
            new = set().union(*docs)
        at = len(self.number)
        while at + len(new) > len(self.part):
            self.part, self.size = np.resize(self.part, 2 * len(self.part)), np.resize(self.size, 2 * len(self.size))
        new = sorted(new)
        rows = [np.array(features(w), np.int64) for w in new]
        if rows:
            n = np.array([len(r) for r in rows])
            flat = np.concatenate(rows)
            self.part[at : at + len(new)] = np.add.reduceat(self.logits[flat], np.cumsum(n) - n)
            self.size[at : at + len(new)] = n
        self.number.update(zip(new, range(at, at + len(new)), strict=True))

    def score(self, texts: list[bytes]) -> np.ndarray:
        docs = [words_for(x) for x in texts]
        self._learn(docs)
        get = self.number.__getitem__
        z = np.empty(len(docs))
        for i, words in enumerate(docs):
            ids = np.fromiter(map(get, words), np.int64, len(words))
            # Summed in order of value, so that equal bags of words have equal scores.
            z[i] = np.sort(self.part.take(ids)).sum() / (self.size.take(ids).sum() + PAD)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def held_out(doc_id) -> F.Column:
    """Rows kept from training: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE_DOCS) -> Model:
    """Trains on at most `sample` labelled rows that are not held out, chosen by a hash of doc_id. The words of these
    rows, with their counts, come to the driver. Null labels, ids and texts do not take part. Of repeated ids with
    labels that differ the greatest counts, and of documents that share an id one, by a hash of the text. Empty tables:
    a model that gives every text the bias alone. Other columns are ignored."""
    chosen = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y is not null")
    chosen = chosen.filter(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    d = doc_rows(docs, text, doc_id).filter("text is not null")
    # `sample` rows of two numbers: a size known beforehand.
    rows = d.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y")
    # Repeated ids in documents could exceed the sample: a row each, in a fixed order.
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("_y").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                seen = [counted(x) for x in texts_of(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([list(c) for c in seen], pa.list_(pa.binary())), pa.array([list(c.values()) for c in seen], pa.list_(pa.int64()))], ["doc_id", "y", "words", "counts"])

    # Distinct words and their counts come to the driver, not texts.
    counts = rows.mapInArrow(run, "doc_id long, y int, words array<binary>, counts array<long>")
    got = sorted(((r[0], r[1], r[2], r[3]) for r in counts.toLocalIterator()), key=lambda r: r[0])
    return train_counts([dict(zip(map(bytes, w), n, strict=True)) for _, _, w, n in got], [1 if y else 0 for _, y, _, _ in got])


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only the text is looked at. Null text, or one without words, scores by the softmax's bias alone. Repeated rows
    and ids: a row each. Null doc_id: stays null, not held out. Empty table: no rows. Other columns are ignored.
    No shuffle; the model has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.logits(), float(model.bias[1] - model.bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.score(texts_of(b.column(1))), pa.float64())], ["doc_id", "score"])

    scored = doc_rows(docs, text, doc_id).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the threshold. Null text scores as empty, and
    equal texts alike, so repeated rows stay or go together; ids do not matter. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((model.logits(), float(model.bias[1] - model.bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for whole in batches:
            for b in slices(whole, text):
                keep = scorer.score(texts_of(b.column(b.schema.get_field_index(text)))) < threshold
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
