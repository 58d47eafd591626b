"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints, scored in numpy.

The statistics of a text (statistics()) say nothing of its language: lengths, shares, repetition, case and marks.
Trees grow level by level on binned statistics; second-order gains of the logistic loss choose the splits. A statistic
in FALLING can only lower the score: a split on it whose right side would score higher is not taken, and the values of
everything below a split stay on their side of its middle. A model is a set of flat node arrays; scoring moves all
texts through all trees one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, slices, texts_of, words_of

STATISTICS = (
    "n_words", "mean_length", "long_words", "short_words", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "top_word_share", "echo_share", "upper_words", "capital_words",
    "digit_share", "ending_marks", "shouts", "bare_marks", "inner_marks", "line_words", "short_lines", "wide_chars", "worst_upper", "worst_marks", "worst_echo", "bars",
)
#: More of these never makes a text better.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "top_word_share", "echo_share", "bars")
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Labelled documents that training may see, chosen by a hash of doc_id: the bound of the sample.
SAMPLE_DOCS = 8_000
#: Words in a line or more for its own shares to count among the worst.
LINE_WORDS = 8


def repeated_words(ids: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each word, whether it stands in a window of as many words that occurs twice or more in its text.

    ids number the words, doc the texts they are of, both in order. Windows are compared exactly: those of twice the
    length are numbered by the pairs of numbers of the halves. `window` is a power of two.
    """
    n = len(ids)
    covered = np.zeros(n, bool)
    if n < window:
        return covered
    number, size = ids.astype(np.int64), 1
    while size < window:
        pairs = number[:-size] * (int(number.max()) + 1) + number[size:]
        number = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    inside = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    key = number[inside] * (int(doc[-1]) + 1) + doc[inside]
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    at = inside[times[back] > 1]
    marks = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(at + window, n), minlength=n + 1)
    return np.cumsum(marks)[:n] > 0


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(base, x) of texts: base holds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words as integers, x the
    STATISTICS. A text without words has zeros, but for n_symbols, which then is zero too."""
    k = len(texts)
    base, x = np.zeros((k, 5), np.int64), np.zeros((k, len(STATISTICS)))
    col = {s: i for i, s in enumerate(STATISTICS)}
    docs = [words_of(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    base[:, 0] = sizes
    base[:, 2] = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
    lines = np.array([_line_counts(t) for t in texts], np.int64).reshape(-1, 2)
    base[:, 3] = lines[:, 1]
    flat = [w for d in docs for w in d]
    if not flat:
        return base, x
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    ids, doc = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(k), sizes)
    # What a word is, once for each distinct word of the slice.
    distinct = coded.dictionary.cast(pa.string(), safe=False)
    flag = lambda a: a.to_numpy(zero_copy_only=False).astype(np.float64)
    length = flag(pc.utf8_length(distinct))
    upper = flag(pc.match_substring_regex(distinct, r"\pL\pL")) * flag(pc.utf8_is_upper(distinct))
    each = {
        "long_words": length > 12,
        "short_words": length < 4,
        "upper_words": upper,
        "capital_words": flag(pc.match_substring_regex(distinct, r"^\p{Lu}\p{Ll}")),
        "digit_share": flag(pc.count_substring_regex(distinct, r"[0-9]")) / np.maximum(length, 1),
        "ending_marks": flag(pc.match_substring_regex(distinct, r"[.,;:?]$")),
        "shouts": flag(pc.match_substring(distinct, "!")),
        "bare_marks": flag(pc.match_substring_regex(distinct, r"^[^\pL\pN]+$")),
        "inner_marks": flag(pc.match_substring_regex(distinct, r"[\pL\pN][^\pL\pN]+[\pL\pN]|[^\pL\pN.,;:!?'\"()\x{2019}-]")),
        "bars": flag(pc.match_substring_regex(distinct, r"[|<>]")),
    }
    total = lambda values: np.bincount(doc, values, k)
    some = np.maximum(sizes, 1)
    chars = total(length[ids])
    base[:, 1] = chars
    repeated = repeated_words(ids, doc)
    base[:, 4] = total(repeated)
    for name, values in each.items():
        x[:, col[name]] = total(values[ids]) / some
    x[:, col["n_words"]], x[:, col["mean_length"]] = sizes, chars / some
    x[:, col["symbol_share"]] = base[:, 2] / np.maximum(chars, 1)
    x[:, col["dup_line_share"]] = lines[:, 1] / np.maximum(lines[:, 0], 1)
    x[:, col["repeat_share"]] = base[:, 4] / some
    # Distinct words of a text, and the share of the most frequent.
    pairs, times = np.unique(doc * len(distinct) + ids, return_counts=True)
    of = pairs // len(distinct)
    x[:, col["distinct_share"]] = np.bincount(of, minlength=k) / some
    top = np.zeros(k)
    np.maximum.at(top, of, times)
    x[:, col["top_word_share"]] = top / some
    echo = np.concatenate([[False], (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])]).astype(np.float64)
    x[:, col["echo_share"]] = total(echo) / some
    x[:, col["wide_chars"]] = (sizes > 0) - chars / np.maximum(total(flag(pc.binary_length(coded.dictionary))[ids]), 1)
    # Shares of single lines, the worst of a text.
    per_line = [len(line.split()) for t in texts for line in t.split(b"\n")]
    line_doc = np.repeat(np.arange(k), [t.count(b"\n") + 1 for t in texts])
    per_line = np.array(per_line, np.int64)
    x[:, col["line_words"]] = sizes / np.maximum(lines[:, 0], 1)
    x[:, col["short_lines"]] = np.bincount(line_doc, (per_line > 0) & (per_line < 4), k) / np.maximum(lines[:, 0], 1)
    line = np.repeat(np.arange(len(per_line)), per_line)
    enough = np.flatnonzero(per_line >= LINE_WORDS)
    for name, values in (("worst_upper", upper[ids]), ("worst_marks", (each["bare_marks"] + each["inner_marks"])[ids]), ("worst_echo", echo)):
        share = np.bincount(line, values, len(per_line))[enough] / per_line[enough]
        worst = np.zeros(k)
        np.maximum.at(worst, line_doc[enough], share)
        x[:, col[name]] = worst
    return base, x


@dataclass
class Forest:
    """Flat nodes of all trees. A leaf points to itself, so that a text that has reached one stays."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 of each row."""
        z = np.full(len(x), self.prior)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
            z[at : at + 4096] += self.value[node].sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = (), rounds: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Forest:
    """Trees on rows x with labels y (0 or 1). A split needs `least` rows on both sides. Without rows, or with one class
    only, there are no trees, and every row gets the prior (without rows 0.5). Equal input gives an equal model: ties between splits go to the
    first statistic, then the lowest threshold."""
    n, m = x.shape
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    prior = float(np.log(p / (1 - p)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new_node() -> int:
        i = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(i), right.append(i), value.append(0.0)
        return i

    if n and 0 < y.sum() < n:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)  # bin b: up to cuts[b]
        sign = np.zeros(m)
        sign[list(falling)] = -1
        z = np.full(n, prior)
        for _ in range(rounds):
            prob = 1 / (1 + np.exp(-z))
            g, h = prob - y, prob * (1 - prob)
            root = new_node()
            roots.append(root)
            where = np.full(n, root)
            level = {root: (-np.inf, np.inf)}
            for d in range(depth + 1):
                if not level:
                    break
                nodes = sorted(level)
                at = np.full(len(feature), -1)
                at[nodes] = np.arange(len(nodes))
                rows = np.flatnonzero(at[where] >= 0)
                cell = (at[where[rows], None] * m + np.arange(m)) * bins + binned[rows]
                shape = (len(nodes), m, bins)
                sums = [np.bincount(cell.ravel(), np.repeat(v[rows], m), np.prod(shape)).reshape(shape).cumsum(2) for v in (g, h, np.ones(n))]
                low, high = (np.array([level[i][k] for i in nodes])[:, None, None] for k in (0, 1))
                gl, hl, nl = sums
                ga, ha, na = (s[:, :, -1:] for s in sums)
                weight = lambda a, b: np.clip(-a / (b + ridge), low, high)  # noqa: E731, B023
                gain_of = lambda a, b, w: -(a * w + 0.5 * (b + ridge) * w * w)
                wl, wr, wa = weight(gl, hl), weight(ga - gl, ha - hl), weight(ga, ha)
                gain = gain_of(gl, hl, wl) + gain_of(ga - gl, ha - hl, wr) - gain_of(ga, ha, wa)
                fits = (nl >= least) & (na - nl >= least) & (sign[None, :, None] * (wr - wl) >= 0)
                gain = np.where(fits, gain, -np.inf)
                best = gain.reshape(len(nodes), -1).argmax(1)
                below = {}
                for k, i in enumerate(nodes):
                    f, b = divmod(int(best[k]), bins)
                    if d == depth or not gain[k, f, b] > 1e-6:
                        value[i] = rate * float(wa[k, 0, 0])
                        continue
                    a, c = new_node(), new_node()
                    feature[i], threshold[i], left[i], right[i] = f, float(cuts[f][b]), a, c
                    lo, hi = level[i]
                    middle = (wl[k, f, b] + wr[k, f, b]) / 2
                    below[a], below[c] = ((middle, hi), (lo, middle)) if sign[f] < 0 else ((lo, hi), (lo, hi))
                    mine = rows[where[rows] == i]
                    where[mine] = np.where(binned[mine, f] > b, c, a)
                level = below
            z += np.array(value)[where]
    as_int = lambda v: np.array(v, np.int64)
    return Forest(as_int(feature), np.array(threshold), as_int(left), as_int(right), np.array(value), as_int(roots), depth, prior)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE_DOCS) -> Forest:
    """Trains on at most `sample` labelled rows, chosen by a hash of doc_id. Only their statistics come to the driver.
    Null labels, ids and texts do not take part; of repeated ids with labels that differ the smallest counts, and of
    documents that share an id one, by a hash of the text. Empty tables: a model that gives every text 0.5. Other
    columns are ignored."""
    chosen = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).filter("_id is not null and _y is not null")
    chosen = chosen.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    d = doc_rows(docs, text, doc_id).filter("text is not null")
    # `sample` rows of two numbers: a size known beforehand.
    rows = d.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_y", F.xxhash64("text").alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                _, x = statistics(texts_of(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "h", "x"])

    measured = rows.mapInArrow(run, "doc_id long, y int, h long, x array<double>").groupBy("doc_id").agg(F.min_by(F.struct("y", "x"), "h").alias("r"))
    got = sorted((r[0], r[1]["y"], r[1]["x"]) for r in measured.toLocalIterator())
    x = np.array([r[2] for r in got]).reshape(-1, len(STATISTICS))
    return train(x, np.array([1.0 if r[1] else 0.0 for r in got]), tuple(STATISTICS.index(s) for s in FALLING))


def quality(docs: DataFrame, model: Forest, threshold: float = 0.5, least_words: int = 20, most_repeated: int = 30, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    base_failed: fewer than least_words words, or more than most_repeated percent of them in windows of 8 words that
    occur twice or more in the text. kept: not base_failed, and score >= threshold.

    Null or empty text: zeros, base_failed, and the score of a text without words. Equal texts get equal rows.
    Repeated rows and ids: a row each. Null doc_id: stays null. Empty table: no rows. Other columns, also ones named
    like the results, are ignored. No shuffle; the model has a fixed size (rounds and depth bound its nodes).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                base, x = statistics(texts_of(b.column(1)))
                score = shared.value.score(x)
                failed = (base[:, 0] < least_words) | (100 * base[:, 4] > most_repeated * base[:, 0])
                columns = [pa.array(c) for c in (*base.T, failed, score, ~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"])

    return doc_rows(docs, text, doc_id).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean")
