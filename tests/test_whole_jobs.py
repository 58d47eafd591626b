"""Queries over tables whose rows don't all match, repeat or fit: nothing is lost, and nothing is computed again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from quillstone.functions import citations


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_label_references_keep_every_label_and_every_turn(spark, tmp_path):
    d = written(
        spark, tmp_path,
        orders=([(1, 5), (2, 6), (3, 7), (4, 8), (5, 9)], "o_orderkey long, o_custkey long"),
        conversations=([(2, 0), (2, 1), (4, 0), (9, 0)], "conv_id long, turn int"),
    )
    got = {tuple(r) for r in contract.queries()["label_references"](spark, d).select("conv_id", "turn", "label_no", "article").collect()}
    assert got == {(None, None, 1, "2"), (2, 0, 2, "3之一"), (2, 1, 2, "3之一"), (None, None, 3, "4之2"), (4, 0, 4, "0"), (None, None, 5, None), (9, 0, None, None)}


def test_citations_are_cut_out_once(spark):
    rows = [
        (1, "依食安法😀😀😀😀😀😀第3條、第4條、第5條之2、第3條", [(3, None, "食安法"), (4, None, None), (5, "二", None)]),
        (2, "本法第1條第2條第3條第4條第5條", [(1, None, "本法"), (2, None, "本法"), (3, None, "本法"), (4, None, "本法"), (5, None, None)]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "i int, a string").select("i", citations.cited(F.col("a")).alias("c"))
    assert {r["i"]: [tuple(c) for c in r["c"]] for r in df.collect()} == {i: want for i, _, want in rows}
    # The text itself is matched and split once: neither four times nor again for each citation.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(coalesce(a#") == 1 and plan.count("split(coalesce(a#") == 1


def test_a_worker_loads_a_vocabulary_once(monkeypatch):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    from quillstone.llm import byte_level, token_counts

    loads, load = [], tokenizers.Tokenizer.from_file

    class Counted:
        from_file = staticmethod(lambda path: loads.append(path) or load(path))

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    monkeypatch.setattr(token_counts, "_ENCODERS", {})
    path = public.path("byte_bpe_50k.json")
    enc = token_counts.encoder(path, "byte")
    assert isinstance(enc, byte_level.ByteLevelEncoder) and loads == [path]
    texts = ["It's  a test,\n\n twice  twice", "", "Ünïcode　 第3條 😀"]
    assert [np.frombuffer(x, "<u2").tolist() for x in enc.ids(texts)] == [load(path).encode(x, add_special_tokens=False).ids for x in texts]


def test_near_texts_meet_without_moving_grams(spark, monkeypatch):
    from quillstone.functions.gramsets import gram_sets
    from quillstone.functions.gramsets import similarity as jaccard
    from quillstone.operators import similarity as S

    r = np.random.default_rng(5)
    texts = ["".join(r.choice(list("abcdefghijk 　"), int(n))) for n in r.integers(0, 400, 60)]
    near = lambda t, k: "".join("é" if i in r.choice(len(t), k) else c for i, c in enumerate(t)) if t else t
    rows = [(i, t) for i, t in enumerate([*texts, *[near(t, k) for t in texts for k in (1, 2, 4)], None, "ab", *texts[:9]])]
    df = spark.createDataFrame(rows, "id long, t string")
    sets = [set(x.tolist()) for x in gram_sets([t for _, t in rows])]
    plain = lambda t: {u[i : i + 3] for u in ["".join((t or "").split())] for i in range(len(u) - 2)}
    assert [len(s) for s in sets] == [len(plain(t)) for _, t in rows]
    want = {}
    for i, t in rows[::3]:
        best = [(1.0 if t == u and t is not None else round(len(a & b) / len(a | b), 6) if (a := plain(t)) and (b := plain(u)) else 0.0, t == u, -j) for j, u in rows if j != i]
        same = max((x for x in best if x[1] and t is not None), default=None)
        top = same or max(best, key=lambda x: (x[0], x[2]))
        if same or top[0] >= 0.8:
            want[i] = (-top[2], top[0], "exact" if same else "fuzzy")
    assert jaccard(*list(gram_sets(["abcd", "abce"]))) == 1 / 3
    monkeypatch.setattr(S, "SIGNATURE_BYTES", 4000)  # several blocks
    out = S.fuzzy_best(df.filter("id % 3 = 0"), df, "id", "id", "t", 0.8, exclude_self=True)
    got = {x["lid"]: (x["rid"], x["similarity"], x["how"]) for x in out.collect()}
    assert got.keys() == want.keys() and all(got[i][::2] == w[::2] and abs(got[i][1] - w[1]) < 2e-6 for i, w in want.items()) and {x[2] for x in want.values()} == {"exact", "fuzzy"}
    # Grams stay in the tasks that cut them: the plan has no row for each.
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_grams_are_cut_twice_and_counted_exactly(spark, monkeypatch):
    from collections import Counter

    from quillstone.plans import learning

    r = np.random.default_rng(4)
    texts = ["", None, "a", "ab", "日本語x", *["".join(r.choice(list("ab c日é😀"), int(n))) for n in r.integers(0, 60, 30)], "".join(map(chr, range(0x4E00, 0x9F00)))]
    plain = lambda t: Counter(t[i : i + k] for k in (2, 3, 4) for i in range(len(t) - k + 1))
    whole = [t or "" for t in texts]
    for part in (whole, whole[:-1], [""], ["a"]):
        got = Counter()
        for runs, times in learning.gram_counts(part):
            got.update(dict(zip(runs, times, strict=True)))
        assert got == sum(map(plain, part), Counter())
    some = [*sorted(sum(map(plain, whole[:-1]), Counter()))[::3], "\u4e00\u4e01"]
    for entries in (0, 1 << 23):
        monkeypatch.setattr(learning, "TABLE", entries)
        got = learning.Trie(some).counts(whole)
        assert got.tolist() == [[c[g] for g in some] for c in map(plain, whole)]
    monkeypatch.setattr(learning, "SLICE", 50)
    # The texts are cut to choose grams and to write vectors; neither the fit nor the errors cut them again.
    cuts = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(i, float(i % 5), ("train", "val", "test")[i % 3]) for i in range(60)], "doc_id long, y double, split string").coalesce(1)
    counted = F.udf(lambda i: cuts.add(1) or f"text {i} of {i % 5}")
    got = learning.experiment(rows.withColumn("text", counted.asNondeterministic()("doc_id")), 50)
    assert {x["split"]: x["n"] for x in got.collect()} == {"train": 20, "val": 20, "test": 20} and 0 < cuts.value <= 120


def test_searches_round_only_what_can_win(spark, monkeypatch):
    from quillstone.operators import vectors as V

    r = np.random.default_rng(7)
    x = np.round(r.normal(size=(600, 3)), 1)  # many ties
    x[:50] += 4e-6
    done, plain = [], V.rounded
    monkeypatch.setattr(V, "rounded", lambda a, digits: done.append(a.size) or plain(a, digits))
    best, skip, ids = V.Best(40, 3), list(range(40)), list(range(600))
    for at in (0, 300):
        best.add(np.arange(40), x[:40] @ x[at : at + 300].T, ids[at : at + 300], skip, 5)
    want = [sorted((-float(s), j) for j, s in enumerate(plain(x[q] @ x.T, 5)) if j != q)[:3] for q in range(40)]
    assert best.rows == want and sum(done) < 40 * 600 / 10
