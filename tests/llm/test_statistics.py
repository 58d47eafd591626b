"""Quality rules, periodic runs and collocations: edge cases, brute force, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillstone.llm import collocations as phrases
from quillstone.llm import quality, runs
from quillstone.llm.collocations import collocations
from quillstone.llm.perfect_hash import PerfectHash
from quillstone.llm.queries import COLLOCATIONS_SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(random.Random(4).choice("alpha beta gamma delta epsilon zeta".split()) + str(k % 700) for k in range(30_000))
#: Null, empty, blank, ties, repeated rows, null ids, very long; and extra columns whose names clash.
TEXTS = [(3, "same text here"), (1, "same text here"), (2, None), (5, ""), (4, " \n\t "), (None, "x x x x x x x"), (9, LONG), (9, LONG), (7, "Ünï # co|de “quotes” 漢字 😀\x0b\x1c&\xa0b"), (10, "a b " * 40 + "\n" + "a b " * 9)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, "x", 0.5, True, 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, phrase string, score double, kept boolean, rank long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# --- periodic runs ---


def plain_runs(x, exponent=4, least=6):
    n, out = len(x), []
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            if i > s and i - s + p >= max(least, exponent * p):
                out.append((s, i - s + p, p))
            i = max(i, s + 1)
    smallest = lambda s, n, p: not any(all(x[k] == x[k + q] for k in range(s, s + n - q)) for q in range(1, p))
    return sorted(r for r in out if smallest(*r))


def periodic_cases(n, seed=1):
    r = random.Random(seed)
    for _ in range(n):
        k = r.choice([1, 2, 2, 3, 4])
        x = [r.randrange(k) for _ in range(r.randint(0, 50))]
        if x and r.random() < 0.6:
            at = r.randrange(len(x))
            x = (x[:at] + [r.randrange(k) for _ in range(r.randint(1, 6))] * r.randint(2, 8) + x[at:]) * r.randint(1, 3)
        yield x


def test_lyndon_edges_against_suffix_comparison():
    for x in periodic_cases(500):
        want = []
        for i in range(len(x)):
            j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), None)
            if j is not None:
                m = next((m for m in range(len(x) - j) if x[i + m] != x[j + m]), len(x) - j)
                want += [(i, j, m)] * (m > 0)
        assert sorted(e for e in runs.lyndon_edges([v + 1 for v in x] + [0], 0)) == want


def test_runs_against_brute_force():
    for x in periodic_cases(1500, seed=2):
        for exponent in (3, 4, 5):
            assert runs.runs_of(np.array(x, np.int64), exponent, 6) == plain_runs(x, exponent)
    with pytest.raises(ValueError):
        runs.runs_of(np.zeros(9, np.int64), 2)


def test_lyndon_arrays_take_linear_comparisons():
    class Counted(int):
        seen = 0

        def __eq__(self, other):
            Counted.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    fib, nest = ([0], [0, 1]), [0]
    for _ in range(15):
        fib = fib[1], fib[1] + fib[0]
    for c in range(1, 12):
        nest = nest + nest + [c]
    for x in ([0] * 4000, [0, 1] * 2000, fib[1], fib[1][::-1], nest, list(range(4000)), [0, 0, 1, 0, 1] * 800):
        for y in (x, [99_999 - v for v in x]):
            Counted.seen = 0
            runs.lyndon_edges([Counted(v + 1) for v in y] + [Counted(0)])
            assert Counted.seen <= 2 * len(y)


def test_periodic_runs_query(spark, docs, empty):
    for tails in (False, True):
        got = runs.periodic_runs(docs, tails=tails)
        assert got.columns == [c.split()[0] for c in runs.SCHEMA.split(", ")]
        want = []
        for i, text in TEXTS:
            w = [x.encode() for x in WORD.findall(text or "")]
            h = zlib.crc32(str(i).encode())
            if tails and i is not None and h % 10 == 0 and w:
                g, n = h // 10, len(w)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            number = {x: k for k, x in enumerate(sorted(set(w)))}
            found = runs.runs_of(np.array([number[x] for x in w], np.int64)) if len(w) > 1000 else plain_runs([number[x] for x in w])
            gone = {k for s, n, p in found for k in range(s + p, s + n)}
            best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
            listing = "".join(f"{s},{n},{p}\n" for s, n, p in found)
            four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
            want.append((i, len(w), len(found), *four, hashlib.sha256(listing.encode()).hexdigest(), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert runs.periodic_runs(empty).count() == 0


def test_tails_have_runs(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(f"w{k * 7 % 101}" for k in range(90))) for i in ids]
    got = runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), tails=True).collect()
    assert len(got) == len(ids) and sum(r["n_runs"] > 0 for r in got) > len(ids) // 3
    assert all(r["period"] * 4 <= r["length"] for r in got if r["n_runs"])


# --- quality ---


def plain_base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    again = {j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def test_base_counts(spark, docs, empty):
    r = random.Random(8)
    texts = [t or "" for _, t in TEXTS] + ["".join(r.choice(["a", "b", " ", " ", "\n", "#", "é", "\t", "\x0c", "\x1c"]) for _ in range(r.randint(0, 120))) for _ in range(400)]
    base, x = quality.statistics([t.encode() for t in texts])
    assert [tuple(b) for b in base.tolist()] == [plain_base(t) for t in texts]
    assert np.isfinite(x).all() and (quality.statistics([b""])[1] == 0).all() and quality.statistics([])[1].shape == (0, len(quality.STATISTICS))
    # One text at a time or all at once: the same statistics.
    assert all(np.allclose(quality.statistics([t.encode()])[1][0], x[k]) for k, t in enumerate(texts[:60]))
    labels = spark.createDataFrame([(1, 1), (9, 0), (None, 1), (2, 1), (3, None)], "doc_id long, quality int")
    got = quality.quality(docs, quality.fit(docs, labels))
    want = [(i, *plain_base(t or "")) for i, t in TEXTS]
    rows = got.collect()
    assert sorted((tuple(q)[:6] for q in rows), key=repr) == sorted(want, key=repr)
    assert all(q["base_failed"] == (q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"]) and (not q["kept"] or not q["base_failed"]) for q in rows)
    none = quality.fit(empty, labels)
    assert quality.quality(empty, none).count() == 0 and {q["score"] for q in quality.quality(docs, none).collect()} == {0.5}


def plain_score(forest, row):
    z = forest.prior
    for node in forest.roots.tolist():
        while forest.left[node] != node:
            node = forest.right[node] if row[forest.feature[node]] > forest.threshold[node] else forest.left[node]
        z += forest.value[node]
    return 1 / (1 + np.exp(-z))


def test_trees_are_monotonic_and_scored_alike():
    r = np.random.default_rng(5)
    x = r.normal(size=(1500, 4))
    # The label rises with the first in truth: a falling constraint must keep the trees from using it.
    y = (x[:, 0] + x[:, 1] - x[:, 2] + 0.3 * r.normal(size=1500) > 0).astype(float)
    free, held = quality.train(x, y, (2,)), quality.train(x, y, (0, 2))
    score = free.score(x)
    assert np.allclose(score[:50], [plain_score(free, row) for row in x[:50]])
    assert ((score > 0.5) == y).mean() > 0.9
    for forest, falling in ((free, (2,)), (held, (0, 2))):
        for f in falling:
            for step in (0.01, 0.5, 3.0):
                more = x.copy()
                more[:, f] += step
                assert (forest.score(more) <= forest.score(x) + 1e-12).all()
    more = x.copy()
    more[:, 0] += 1
    assert free.score(more).mean() > score.mean() + 0.1 and abs(held.score(more) - held.score(x)).max() < 1e-9
    again = quality.train(x, y, (2,))
    assert (again.value == free.value).all() and (again.feature == free.feature).all()
    assert len(quality.train(x, np.ones(1500)).roots) == 0 and quality.train(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_first_split_has_the_best_gain():
    r = np.random.default_rng(6)
    x, y = r.integers(0, 12, (200, 3)).astype(float), r.integers(0, 2, 200).astype(float)
    forest = quality.train(x, y, rounds=1, depth=1, bins=64)
    g, h = y.mean() - y, np.full(200, y.mean() * (1 - y.mean()))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((gain(x[:, f] <= t) + gain(x[:, f] > t), -f, -t) for f in range(3) for t in range(11) if 4 <= (x[:, f] <= t).sum() <= 196)
    left = x[:, forest.feature[0]] <= forest.threshold[0]
    assert np.isclose(gain(left) + gain(~left), best[0])
    assert np.isclose(forest.value[forest.left[0]], -0.1 * g[left].sum() / (h[left].sum() + 1))


def test_quality_of_held_out_texts():
    tables = duckdb.sql("select encode(coalesce(text, '')), quality from '/root/testdata/sf0.01/documents.parquet' join '/root/testdata/sf0.01/labels.parquet' using (doc_id) order by doc_id").fetchall()
    x = quality.statistics([t for t, _ in tables])[1]
    y = np.array([q for _, q in tables], float)
    learn = np.arange(len(y)) % 3 != 1
    forest = quality.train(x[learn], y[learn], tuple(quality.STATISTICS.index(s) for s in quality.FALLING))
    right = (forest.score(x[~learn]) >= 0.5) == y[~learn]
    assert right[y[~learn] == 1].mean() >= 0.97 and right[y[~learn] == 0].mean() >= 0.9


# --- collocations ---


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        keys = np.unique(r.integers(-(2**62), 2**62, n))
        h = PerfectHash(keys)
        slots = h.lookup(keys)
        assert sorted(slots.tolist()) == list(range(len(keys))) and (h.keys[slots] == keys).all()
        assert (h.lookup(np.setdiff1d(r.integers(-(2**62), 2**62, 3000), keys)) == -1).all()


def test_keys_left_after_all_levels(monkeypatch):
    from quillstone.llm import perfect_hash

    monkeypatch.setattr(perfect_hash, "LEVELS", 1)
    keys = np.arange(-500, 500)
    h = PerfectHash(keys)
    assert len(h.rest) and sorted(h.lookup(keys).tolist()) == list(range(1000)) and (h.lookup(np.arange(500, 900)) == -1).all()


def plain_collocations(rows, least, longest, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    frequent = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in frequent.items():
        if any(other == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (other, v), b in frequent.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))  # noqa: E741
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(x[0], k, *x[1:]) for k, x in enumerate(mine, 1)]
    return sorted(ranked)


def phrase_rows(n, seed):
    r = random.Random(seed)
    words = ["The", "the", "ab", "Éa", "éa", "b\x00", "漢", "x\xa0y", "q", "zz"]
    return [(r.choice(["en", "de", None, "und", ""]), " ".join(r.choices(words, weights=range(10, 0, -1), k=r.randint(0, 25))).replace("q", r.choice([". q", "q\n", "\tq", "q!?", "q"]))) for _ in range(n)] + [("en", None), ("en", ""), ("de", "ab ab ab ab ab ab ab ab ab")] * 2


def found(df):
    return sorted(map(tuple, df.collect()))


def test_collocations_against_brute_force(spark, monkeypatch):
    rows = phrase_rows(300, 11)
    df = spark.createDataFrame([(t, a, 1, "x") for a, t in rows], "text string, lang string, rank long, phrase string").repartition(5)
    want = plain_collocations(rows, 12, 5, 40)
    assert len(want) > 80 and {x[0] for x in want} == {"en", "de", "und", ""}
    assert found(collocations(df, least=12, top=40)) == want
    # Tables of a few entries: several passes a level give the same.
    monkeypatch.setattr(phrases, "MOST", 7)
    monkeypatch.setattr(phrases, "PAIRS", 50)
    monkeypatch.setattr(phrases, "WORDS", 20)
    few = spark.createDataFrame([(t, a) for a, t in rows[:150]], "text string, lang string").repartition(3)
    want = plain_collocations(rows[:150], 12, 5, 40)
    assert len(want) > 30 and found(collocations(few, least=12, top=40)) == want


def test_collocations_of_little(spark, docs, empty):
    assert collocations(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and collocations(empty).count() == 0
    assert collocations(docs, least=10**6).count() == 0
    assert found(collocations(docs, least=20, top=9)) == plain_collocations([("en", t) for _, t in TEXTS], 20, 5, 9)


def test_words_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(phrases.xxhash, "xxh3_64_intdigest", lambda e: len(e))
    table = phrases.WordTable(["en"] * 4 + ["de"], ["ab", "cd", "abc", "d" * 9, "ab"], 100)
    assert sorted(table.slots("en", [b"ab", b"cd", b"abc", b"d" * 9]) + table.slots("de", [b"ab"])) == [100, 101, 102, 103, 104]
    assert table.slots("en", [b"xy", b"xyz", b"e" * 9]) == [-1] * 3 and table.slots("de", [b"cd"]) == [-1]


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, n, l = 3 * 10**12, 9 * 10**13, 4 * 10**12  # noqa: E741
    exact = lambda c: F.lit(c).cast("decimal(19,0)")
    row = spark.range(1).select(F.call_function("div", exact(1000 * a) * exact(n), exact(l) * exact(l)).alias("s")).first()
    assert row["s"] == 1000 * a * n // (l * l)


def test_collocations_sql_equals_brute_force():
    rows = [(a, t) for a, t in phrase_rows(900, 12) if a in ("en", None)]
    con = duckdb.connect()
    con.execute("create table documents (lang varchar, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(COLLOCATIONS_SQL).fetchall()) == plain_collocations(rows, 100, 5, 2000)
