"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

The field tags a text's words as begin, inside or outside of a secret. A word's score for each tag is the sum of
weights of its own features (shape: length, classes of characters, entropy, changes between them, vowels), those of
the two words before and the one after, and those of the text as a whole; tags that follow each other have weights
too. Weights are trained in numpy by the exact gradient (forward-backward) on a bounded sample whose tags come from
the base patterns, with neighbours hidden at random so that shape alone can tell. So that the field finds more than the
patterns know, training also sees the sample's own contexts with other secrets and with what only looks like one set
in: other keywords, separators, prefixes and alphabets; ids, dates, addresses, versions, file names. Viterbi decodes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, slices, texts_of

# The base patterns; the least length is of group 2 for assign, of the match for the others.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Texts with a base hit, and texts of any kind, that training may see: the bound of the sample.
SAMPLE_HITS, SAMPLE_OTHERS = 600, 200
#: Words of these texts around which training looks: every word of a hit, every long word, and this many others of each
#: text; of more than SAMPLE_WINDOWS in all, a seeded choice of as many.
OTHER_WORDS, SAMPLE_WINDOWS = 5, 4_000
#: Contexts that get another secret, and as many that get something that is none.
VARIANTS = 1_800
B, I, O = 0, 1, 2  # noqa: E741
_REACH = 5  # words on each side of a hit that training looks at
_CORE = "\"'`()<>[]{},;:.!?"
_KEY = re.compile(r"passw|passphrase|pwd|secret|token|api[_-]?key|credential|auth|bearer|private|access|signing|_key")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end): leftmost, non-overlapping within a kind; sorted."""
    out, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_LENGTHS = (4, 8, 12, 16, 20, 24, 32, 48)
N_FEATURES = 50
_INNER = re.compile(r"^(.*?[A-Za-z_\"'])(?::=|=>|[=:])[\"']?(?!/)([^=:\"']{4,}=*)$")
_PREFIX = re.compile(r"[A-Za-z]{2,6}[_-][^_-]{12,}$")
_RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")
_HEXES = frozenset("0123456789abcdefABCDEF")


def features(word: bytes) -> list[int]:
    """The word's active features, by number. Those of shape are of the value, where the word is name=value."""
    w = word.decode("utf-8", "replace")
    core = w.strip(_CORE)
    n = len(core)
    out = []
    if core.isalpha() and n < 20:
        out += [sum(n >= x for x in _LENGTHS), 9, 10 if core.islower() else 11]  # to 8, then 9 to 11
        if n >= 3 and _KEY.search(core.lower()):
            out.append(12)
    else:
        inner = _INNER.match(core)
        value = inner[2] if inner else core
        n = len(value)
        out.append(sum(n >= x for x in _LENGTHS))
        if inner:
            out.append(37)
            if _KEY.search(inner[1].lower()):
                out.append(38)
        elif n >= 3 and _KEY.search(core.lower()):
            out.append(12)
        runs = _RUNS.findall(value)
        kinds = {"a" if r[0] in "abcdefghijklmnopqrstuvwxyz" else "A" if "A" <= r[0] <= "Z" else "0" if r[0].isdigit() and r[0].isascii() else "-" for r in runs}
        out += [13 + k for k, x in enumerate("aA0-") if x in kinds]
        if value and _HEXES.issuperset(value):
            out.append(17)
            if n >= 16 and "A" in kinds and "0" in kinds and "a" not in kinds:
                out.append(45)
        out.append(18 + min(len(runs) // 3, 4))  # to 22
        if n >= 8:
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
            out.append(23 + min(int(entropy), 5))  # to 28
        digits = sum(len(r) for r in runs if r[0].isdigit())
        if digits * 2 > n:
            out.append(29)
        if value.startswith("AKIA"):
            out.append(30)
        if "://" in w or "@" in w or "www." in w or "/" in value and "." in value.rsplit("/", 1)[-1]:
            out.append(31)
        if _PREFIX.match(value):
            out.append(39)
        letters = sum(len(r) for r in runs if r[0].isalpha())
        if letters >= 6:
            vowels = sum(value.count(v) for v in "aeiouAEIOU")
            out += [40] if vowels * 5 < letters else [41] if vowels * 20 >= letters * 7 else []
        if letters == 0:
            out.append(46 if digits == n else 42)
        if value.count("-") >= 2:
            out.append(43)
        if value.count(".") >= 2:
            out.append(44)
        if letters == n and len(runs) >= 5:
            out.append(47)
        if not value.isascii():
            out.append(48)
    if w in ("=", ":", ":=", "=>"):
        out.append(32)
    if w[-1:] in "=:":
        out.append(33)
    if w[:1] in "\"'":
        out.append(34)
    if len(w) > 1 and w[-1:] in "\"'":
        out.append(35)
    if w.isascii():
        out.append(36)
    return out


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALPHABETS = [_LOWER + _LOWER.upper() + _DIGITS] * 3 + [_LOWER + _LOWER.upper() + _DIGITS + "+/", _LOWER + _LOWER.upper() + _DIGITS + "_-.", "ABCDEF" + _DIGITS, "abcdef" + _DIGITS, _LOWER + _DIGITS, _LOWER.upper() + _DIGITS]
_TYPED = _LOWER + _LOWER.upper() + _DIGITS * 2 + "!#%&*@^~"
_NAMES = ["passphrase", "client_secret", "auth", "credential", "signing_key", "access_key", "bearer_token", "auth_token", "PASSWORD", "Secret", "user_token", "db_password", "encryption_key", "service_credentials"]
_NO_NAMES = ["id", "ref", "order", "page", "file", "see", "item", "version", "date", "user", "title", "count", "no", "name", "time"]


def _secret(rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """Words of a secret in some form, and their tags."""
    draw = lambda xs: xs[int(rng.integers(len(xs)))]
    value = lambda least: "".join(draw(alphabet) for _ in range(int(rng.integers(least, 49)))) if (alphabet := draw(_ALPHABETS)) else ""
    form = int(rng.integers(8))
    if form < 4:
        name, v = draw(_NAMES), value(10) if rng.random() < 0.6 else "".join(draw(_TYPED) for _ in range(int(rng.integers(8, 25))))
        return ([f"{name}:", v], [O, B]) if form == 0 else ([name, draw(["=", ":", ":=", "=>"]), draw([v, f'"{v}"', f"'{v}'"])], [O, O, B]) if form == 1 else ([draw([f"{name}={v}", f'{name}="{v}"', f"{name}:{v}"])], [B]) if form == 2 else ([f'"{name}":', f'"{v}",'], [O, B])
    if form == 4:
        return [draw(["Authorization:", "X-Auth:", "header"]), draw(["Bearer", "Basic", "Token"]), value(20)], [O, O, B]
    if form == 5:
        mixed = draw(_ALPHABETS[:3])
        if rng.random() < 0.3:  # a prefix, a number and the rest
            return [draw("-_.").join(["".join(draw(a) for _ in range(int(rng.integers(least, most)))) for a, least, most in ((_LOWER, 2, 6), (_DIGITS, 6, 14), (mixed, 16, 33))])], [B]
        return ["".join(draw(_LOWER) for _ in range(int(rng.integers(2, 5)))) + draw("_-") + "".join(draw(mixed) for _ in range(int(rng.integers(18, 45))))], [B]
    return [value(26)], [B]


def _no_secret(rng: np.random.Generator, word: str) -> list[str]:
    """Words of something that is no secret, though it has digits, capitals, marks or a name before it."""
    draw = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda n: "".join(draw(_DIGITS) for _ in range(n))
    letters = lambda n: "".join(draw(_LOWER) for _ in range(n))
    n = int(rng.integers(4, 13))
    thing = [
        lambda: [digits(n)],
        lambda: [f"{draw(['ORD', 'INV', 'DOC', 'ab'])}-{digits(4)}-{digits(5)}"],
        lambda: [f"20{digits(2)}-0{draw('123456789')}-1{draw(_DIGITS)}"],
        lambda: [f"{digits(2)}:{digits(2)}:{digits(2)}"],
        lambda: [f"v{digits(1)}.{digits(2)}.{digits(1)}-{letters(4)}"],
        lambda: [f"{word}.{letters(5)}{digits(2)}@{letters(7)}.org"],
        lambda: [f"https://{letters(7)}.com/{word}/{digits(6)}?q={letters(6)}{digits(3)}"],
        lambda: [f"{word}_{letters(6)}_{digits(2)}.{draw(['txt', 'csv', 'py', 'json'])}"],
        lambda: ["/".join(letters(int(rng.integers(3, 8))) for _ in range(4))],
        lambda: [f"{digits(8)}-{letters(4)}-4{digits(3)}-a{digits(3)}-{digits(12)}"],
        lambda: [f"+{digits(2)}-{digits(3)}-{digits(7)}"],
        lambda: [word.capitalize() + letters(6).capitalize() + letters(7).capitalize()],
        lambda: [f"{word.upper()}_{letters(5).upper()}_{letters(6).upper()}"],
        lambda: [f"{draw(_NO_NAMES)}={draw([digits(6), letters(8), letters(5) + digits(2)])}"],
        lambda: [f"{draw(_NO_NAMES)}:", draw([digits(9), letters(9), letters(4).upper() + digits(4)])],
        lambda: [draw(_NAMES), draw(["is", "was", "and", "=", ":"]), word],
        lambda: [f"{draw(_NAMES)}:", draw(["none", "required", "optional", "see", word])],
        lambda: [letters(3) + digits(4)],
        lambda: ["".join(f"{draw('abcdef')}{draw(_DIGITS)}" for _ in range(4))[:7]],
        lambda: [letters(10) + word + letters(10)],
        lambda: [f"{word}-{letters(6)}-{letters(8)}-{letters(5)}"],
        lambda: [f"{digits(3)}.{digits(2)}.{digits(1)}.{digits(3)}:{digits(4)}"],
    ]
    return draw(thing)()


def _varied(rng: np.random.Generator, docs: list[list[bytes]], n: int) -> list[tuple[list[bytes], list[int]]]:
    """Words and tags around n places of the sample's texts, with a secret set in; and n with something that is none."""
    out = []
    docs = [d for d in docs if d]
    for k in range(2 * n if docs else 0):
        words = docs[int(rng.integers(len(docs)))]
        at = int(rng.integers(len(words) + 1))
        plain = [w for w in words[max(0, at - 60) : at + 60] if len(w) < 13 and w.isalpha()] or [b"word"]
        mine, tags = _secret(rng) if k % 2 else (_no_secret(rng, plain[int(rng.integers(len(plain)))].decode()), None)
        # The words around it: only those that are surely none themselves.
        side = lambda part: [w if len(w) < 13 and w.isalpha() else plain[int(rng.integers(len(plain)))] for w in part]  # noqa: B023, E731
        before, after = side(words[max(0, at - _REACH) : at]), side(words[at : at + _REACH])
        out.append(([*before, *(w.encode() for w in mine), *after], [O] * len(before) + (tags or [O] * len(mine)) + [O] * len(after)))
    return out


def text_features(text: bytes) -> np.ndarray:
    """Of the file: keywords in it, marks of code, any long run of digits and letters."""
    n = max(1, len(text))
    return np.array([_KEY.search(text.decode("utf-8", "replace").lower()) is not None, (text.count(b"=") + text.count(b"{") + text.count(b";")) * 200 > n, n > 4096], np.float64)


@dataclass
class Field:
    own: np.ndarray  # N_FEATURES x 3; likewise for the words before, two before, and after
    before: np.ndarray
    before2: np.ndarray
    after: np.ndarray
    file: np.ndarray  # 3 x 3
    follow: np.ndarray  # from tag x to tag

    def gains(self) -> np.ndarray:
        """For begin and inside: the most that such a tag can win over outside through its neighbours in any path."""
        a = np.vstack([self.follow, np.zeros(3)])  # no neighbour before
        z = np.hstack([self.follow, np.zeros((3, 1))])  # none after
        return np.array([(a[:, t] - a[:, O]).max() + (z[t] - z[O]).max() for t in (B, I)])


def viterbi(scores: np.ndarray, follow: np.ndarray) -> list[int]:
    best, back = scores[0], []
    for s in scores[1:]:
        m = best[:, None] + follow
        back.append(m.argmax(0))
        best = m.max(0) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _tags(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words, and tags by the base patterns: the words that touch a hit's value."""
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]
    words = list(re.finditer(r"[^ \t-\r]+", text))
    tags = np.full(len(words), O)
    if spans:
        starts = np.array([m.start() for m in words])
        for a, b in sorted(spans):
            first, last = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left")) - 1
            tags[first] = B
            tags[first + 1 : last + 1] = I
    return [m[0].encode() for m in words], tags


def likelihood(params: list[np.ndarray], x: np.ndarray, places: tuple[np.ndarray, ...], files: np.ndarray, gold: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The negative log likelihood of the tags of all windows, and its gradient, by forward-backward.

    params as in Field; x: a row of features for each word; places: the words' numbers themselves, then those before, two
    before and after; files: text features of each window; gold: windows x places x 3, one 1 each."""
    own, before, before2, after, file, follow = params
    seqs, width = places[0], places[0].shape[1]
    e = sum((x @ w)[ids] for w, ids in zip((own, before, before2, after), places, strict=True)) + (files @ file)[:, None]
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, width):
        m = alpha[:, t - 1, :, None] + follow
        top = m.max(1)
        alpha[:, t] = top + np.log(np.exp(m - top[:, None]).sum(1)) + e[:, t]
    for t in range(width - 2, -1, -1):
        m = follow + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
        top = m.max(2)
        beta[:, t] = top + np.log(np.exp(m - top[..., None]).sum(2))
    z = alpha[:, -1].max(1) + np.log(np.exp(alpha[:, -1] - alpha[:, -1].max(1, keepdims=True)).sum(1))
    d = np.exp(alpha + beta - z[:, None, None]) - gold
    both = alpha[:, :-1, :, None] + follow + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
    pairs = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    flat, grads = d.reshape(-1, 3), []
    for ids in places:
        per_word = np.stack([np.bincount(ids.reshape(-1), flat[:, k], len(x)) for k in range(3)], 1)
        grads.append(x.T @ per_word)
    grads += [files.T @ d.sum(1), np.exp(both).sum((0, 1)) - pairs]
    return float(z.sum() - (gold * e).sum() - (pairs * follow).sum()), grads


def train(texts: list[str], seed: int = 5, rounds: int = 80) -> Field | None:
    """None where no text of the sample has a hit."""
    rng = np.random.default_rng(seed)
    number: dict[bytes, int] = {b"": 0}
    kept, places = [], []
    width = 2 * _REACH + 1
    for text in texts:
        words, tags = _tags(text)
        if not words:
            continue
        ids = [0] * _REACH + [number.setdefault(w, len(number)) for w in words] + [0] * _REACH
        padded = np.concatenate([np.full(_REACH, O), tags, np.full(_REACH, O)])
        # Around each hit, around long words, and around some others.
        hits, others = np.flatnonzero(tags != O), np.flatnonzero(tags == O)
        long = [i for i in others.tolist() if len(words[i]) > 12]
        some = rng.choice(others, min(OTHER_WORDS, len(others)), replace=False) if len(others) else others
        places += [(len(kept), i) for i in [*hits.tolist(), *long, *some.tolist()]]
        kept.append((np.array(ids), padded, text_features(text.encode())))
    if len(places) > SAMPLE_WINDOWS:
        places = [places[i] for i in np.sort(rng.choice(len(places), SAMPLE_WINDOWS, replace=False))]
    seqs = [kept[k][0][i : i + width] for k, i in places]
    golds = [kept[k][1][i : i + width] for k, i in places]
    files = [kept[k][2] for k, _ in places]
    if not seqs or not any((g != O).any() for g in golds):
        return None
    for words, tags in _varied(rng, [t.encode().split() for t in texts], VARIANTS):
        # What is set in stands near the middle; longer pieces lose words at their ends.
        first = max(0, (len(words) - width) // 2)
        ids = [number.setdefault(w, len(number)) for w in words[first : first + width]]
        pad = width - len(ids)
        seqs.append(np.array([0] * (pad // 2) + ids + [0] * (pad - pad // 2)))
        golds.append(np.array([O] * (pad // 2) + tags[first : first + width] + [O] * (pad - pad // 2)))
        files.append(text_features(b" ".join(words)) * (rng.random() < 0.5))
    seqs, golds, files = np.array(seqs), np.array(golds), np.array(files)
    x = np.zeros((len(number), N_FEATURES))
    for w, i in number.items():
        if w:
            x[i, features(w)] = 1
    shift = lambda k: np.roll(np.pad(seqs, ((0, 0), (2, 2))), k, 1)[:, 2:-2]
    around = [shift(1), shift(2), shift(-1)]
    hide = [rng.random(seqs.shape) < 0.3 for _ in around]
    around = [np.where(h, 0, a) for h, a in zip(hide, around, strict=True)]
    params = [np.zeros((N_FEATURES, 3)) for _ in range(4)] + [np.zeros((3, 3)), np.zeros((3, 3))]
    params[5][O, I] = -4
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    gold = np.eye(3)[golds]
    n = len(seqs)
    for step in range(1, rounds + 1):
        _, grads = likelihood(params, x, (seqs, *around), files, gold)
        for (m, v), p, g in zip(state, params, grads, strict=True):
            g = g / n + 2e-4 * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(*params)


class Scanner:
    """Base spans and the field's spans of texts. Scores of distinct words are kept, in a cache of bounded size."""

    MOST = 500_000

    def __init__(self, field: Field | None):
        self.field = field
        if field:
            self.weights = np.concatenate([field.own, field.before, field.before2, field.after], 1)
            self.margin = field.gains()
            self.sums: dict[tuple[int, ...], np.ndarray] = {}  # by sets of features: far fewer than words
            self._reset()

    def _reset(self) -> None:
        self.number: dict[bytes, int] = {b"": 0}
        self.scores = np.zeros((1024, 12))

    def _learn(self, docs: list[list[bytes]]) -> None:
        new = set().union(*docs) - self.number.keys()
        if len(self.number) + len(new) > self.MOST:
            self._reset()
            new = set().union(*docs)
        at = len(self.number)
        while at + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for i, w in enumerate(new, at):
            self.number[w] = i
            f = tuple(features(w))
            row = self.sums.get(f)
            if row is None:
                row = self.sums[f] = self.weights[list(f)].sum(0)
            self.scores[i] = row

    def tagged(self, words: list[bytes], file: np.ndarray) -> list[tuple[int, int]]:
        """Runs [first word, end) that Viterbi tags as secrets.

        A word whose score for outside beats the others' by more than any neighbours could make up for is outside in
        the best path, whatever its neighbours: the chain is decoded between such words, with the same result.
        """
        if len(words) == 0:
            return []
        ids = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        s = self.scores[ids]
        e = s[:, 0:3] + self.field.file.T @ file
        e[1:] += s[:-1, 3:6]
        e[2:] += s[:-2, 6:9]
        e[:-1] += s[1:, 9:12]
        sure = (e[:, O] - e[:, B] > self.margin[0]) & (e[:, O] - e[:, I] > self.margin[1])
        open_ = np.flatnonzero(~sure)
        out = []
        if len(open_):
            cuts = np.flatnonzero(np.diff(open_) > 1) + 1
            for part in np.split(open_, cuts):
                a, b = int(part[0]), int(part[-1]) + 1
                # The sure words on both sides take part: their tag is known, and weighs on the first and last.
                lo, hi = max(0, a - 1), min(len(words), b + 1)
                run = None
                for i, tag in enumerate([*viterbi(e[lo:hi], self.field.follow), O], lo):
                    if run is not None and tag != I:
                        out.append((run, i))
                        run = None
                    if tag == B or tag == I and run is None:
                        run = i
        return out

    def scan(self, texts: list[bytes]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """For each text: base spans, and all spans."""
        docs = [x.split() for x in texts]
        if self.field:
            self._learn(docs)
        out = []
        for data, words in zip(texts, docs, strict=True):
            text = data.decode("utf-8", "replace")
            base = base_spans(text)
            spans = base
            runs = self.tagged(words, text_features(data)) if self.field else []
            if runs:
                at = [m.span() for m in re.finditer(r"[^ \t-\r]+", text)]
                extra = []
                for first, end in runs:
                    a, b = at[first][0], at[end - 1][1]
                    while a < b and text[a] in _CORE:
                        a += 1
                    while a < b and text[b - 1] in _CORE:
                        b -= 1
                    if end == first + 1 and (inner := _INNER.match(text[a:b])):
                        a += inner.start(2)  # of name=value, the value
                    if a < b and not any(x < b and a < y for x, _, y in base):
                        extra.append((a, 3, b))
                spans = sorted(base + extra)
            out.append((base, spans))
        return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Field | None:
    """Trains on a bounded sample, chosen by a hash of the text: SAMPLE_HITS texts that may have a base hit,
    SAMPLE_OTHERS of all, SAMPLE_WINDOWS places in them. Null texts do not take part, and equal texts count once; None
    for an empty table, or where no text of the sample has a hit. Other columns are ignored."""
    d = doc_rows(docs, text, doc_id).filter("text is not null").select("text", F.xxhash64("text").alias("h"))
    some = F.regexp_like("text", F.lit("(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]")) | F.contains("text", F.lit("AKIA")) | F.regexp_like("text", F.lit("[0-9a-f]{24}"))
    # Hashes are sorted first, so that texts do not pass through the limit.
    hashes = d.select("h", some.alias("hit"))
    least = hashes.filter("hit").select("h").distinct().orderBy("h").limit(SAMPLE_HITS).union(hashes.select("h").distinct().orderBy("h").limit(SAMPLE_OTHERS)).distinct()
    rows = d.join(F.broadcast(least), "h").dropDuplicates(["h"])
    return train([t for _, t in sorted((r["h"], r["text"]) for r in rows.toLocalIterator())])


def secret_scan(docs: DataFrame, field: Field | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans: spans as kind:start:end, ordered by start, then kind,
    comma-joined; code points, end exclusive. A span of the field ("crf") that touches a base span is left out.

    Null or empty text: no spans (""). Repeated rows and ids: a row each. Null doc_id stays null. Empty table: no
    rows. field None: base spans only. Other columns are ignored. No shuffle; the field has a fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for whole in batches:
            for b in slices(whole, "text"):
                got = scanner.scan(texts_of(b.column(1)))
                counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in got], pa.int64()) for kind in range(3)]
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([joined(base) for base, _ in got], pa.string()), pa.array([joined(s) for _, s in got], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])

    return doc_rows(docs, text, doc_id).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")
