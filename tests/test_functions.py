"""Truth tables of the text, chunking, reference, statistics and decision functions, on literals of our own."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import chunking, citations, stats, text
from quillstone.operators import decisions as D
from quillstone.operators import relational as R
from quillstone.operators import similarity as S
from quillstone.plans import answering
from quillstone.plans.models import Models, hashed
from quillstone.sources import files, snapshots, html


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "want"),
    [
        (text.remove_invisible, "﻿a\xa0b​c", "a bc"), (text.remove_cid, "a(cid:12)b(cid:)", "ab(cid:)"), (text.remove_placeholders, "x @# y @ z a@b", "x  y  z a@b"),
        (text.remove_page_numbers, "第 3 頁，共 9 頁- 4 - 12/30 ~ 5 ~", "  "), (text.compact, "  a \t b\n\n\n\nc　", "a b\n\nc"), (text.nfkc, "ＡＢ１２", "AB12"), (text.nfkc, None, None),
        (text.fix_spaced, "食 品 負 責 ab c d", "食品負責 ab c d"), (text.merge_lines, "第一段開頭\n繼續\n\n一、新段\n句子。\n下一句", "第一段開頭繼續\n\n一、新段句子。\n下一句"),
        (text.strip, "　 x \n", "x"),
    ],
)
def test_cleaning(spark, f, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(f(F.col("t"))).first()[0] == want


def test_cid_ratio(spark):
    assert one(spark, text.cid_ratio(F.col("t")), t="(cid:1)abc") == pytest.approx(0.7)
    assert one(spark, text.cid_ratio(F.col("t")), t="") == 0


def test_questions(spark):
    assert one(spark, text.split_questions(F.col("q")), q="甲可以嗎？乙呢? ") == ["甲可以嗎?", "乙呢?"]
    assert one(spark, text.split_questions(F.col("q")), q=" 只有一問？ ") == ["只有一問？"]
    assert one(spark, text.keyword_question(F.col("q")), q="減肥廣告") == "減肥廣告的相關規定是什麼?"
    assert one(spark, text.keyword_question(F.col("q")), q="哪一條") == "哪一條"


def test_tables(spark):
    df = spark.createDataFrame([([["a|b", "c"], ["d"]],)], "t array<array<string>>")
    assert df.select(text.markdown_table(F.col("t"))).first()[0] == "| a\\|b | c |\n| --- | --- |\n| d |  |"
    valid = lambda t: spark.createDataFrame([(t,)], "t array<array<string>>").select(text.valid_table(F.col("t"))).first()[0]
    assert valid([["a", "b", "c"], ["1", "2", "3"]]) and not valid([["a", "b"]]) and not valid([["a"], ["b"]])
    assert not valid([["a", ""], ["b", ""], ["c", "d"]]) and not valid([["a", "", "", ""], ["", "", "", ""]])


def test_path_metadata(spark):
    m = one(spark, text.path_metadata(F.col("p")), p="cat/act 28/a/b/file.docx")
    assert tuple(m) == ("cat", "act 28", "a/b", "file")
    assert tuple(one(spark, text.path_metadata(F.col("p")), p="cat/file.txt")) == ("cat", None, "", "file")
    assert one(spark, text.kind_of(F.col("n")), n="問答集") == "qa"


def test_enumerated(spark):
    assert one(spark, text.enumerated(F.col("t")), t="原料例如紅麴米、大豆異黃酮、魚油膠囊、鈣等。另如甲、乙。") == ["紅麴米", "大豆異黃酮", "魚油膠囊"]


LINE = "這是一段足夠長的內容，" * 4


def test_chunkers(spark):
    got = spark.createDataFrame([(f"@head\n{LINE}#short#{LINE}2",)], "t string").select(chunking.hash_chunks(F.col("t"))).first()[0]
    assert got == [LINE, LINE + "2"]
    assert chunking.question_chunks("Q1 only one " + LINE) == []
    qa = chunking.question_chunks(f"前言\nQ1: {LINE}\nA1: 答\n| Q9 | x |\nQ2: {LINE}\n#")
    assert len(qa) == 2 and qa[0].startswith("Q1") and qa[1].endswith("，")
    heads = chunking.heading_chunks(f"丟掉\n一、{LINE}\n二、短\n三、{LINE}")
    assert heads[0].startswith("一、") and heads[1].startswith("二、短") and "三、" in heads[1]
    long = "".join(f"第{i}句的內容在這裡。" for i in range(200))
    parts = chunking.length_chunks(long, 100, 20, 10)
    assert all(len(p) <= 100 for p in parts) and all(b.startswith(a[-20:]) for a, b in zip(parts, parts[1:]))
    assert all(len(p) <= 100 for p in chunking.cut_long("字" * 950, 100, 10))
    assert chunking.chunk("", "x") == ([], "empty") and chunking.chunk(None) == ([], "empty")
    assert chunking.chunk("tiny") == (["tiny"], "whole")
    assert chunking.chunk(f"#{LINE}#{LINE}", "AI資料庫")[1] == "hash"
    assert chunking.chunk("\n".join(f"Q{i}. {LINE}" for i in range(5)))[1] == "qa"
    assert chunking.chunk(f"一、{LINE}\n二、{LINE}")[1] == "header"
    df = chunking.chunk_documents(spark.createDataFrame([(1, LINE), (2, None)], "doc_id long, text string"))
    assert [(r["doc_id"], r["strategy"]) for r in df.collect()] == [(1, "length")]


def test_references():
    assert citations.detect("食安法第28條第1項規定，處新臺幣六萬元罰鍰") == [("食安法", 28, "28", "1", "penalty")]
    assert citations.detect("食品安全衛生管理法第15條之一及健康食品管理法第14條") == [("食安法", 15, "15之一", None, "primary"), ("健康食品管理法", 14, "14", None, "primary")]
    assert citations.detect("第15條") == [] and citations.detect("本法第3條所稱") == []
    assert citations.detect("本法第3條所稱", "食安法第28條") == [("食安法", 3, "3", None, "definition")]
    assert [citations.number(citations.numeral(n)) for n in range(1, 100)] == list(range(1, 100)) and citations.numeral(104) == "104"


def test_cited_articles(spark):
    rows = [
        ("依食安法第二十八條及第15條之1、第28條", [], [(28, None, "食安法"), (15, "一", "食安法")]),
        ("第104條", ["第104條"], [(104, None, None)]),
        ("第28條、第9條", ["第 28 條之一"], [(28, None, None), (9, None, None)]),
        ("第15條之一", ["第15之一條", None], [(15, "一", None)]),
        ("藥事法及其他許多不相干的內容，依第 十 條", None, [(10, None, None)]),
        ("本法第3條，健食法第4條之 2", ["第四條之二"], [(3, None, "本法"), (4, "二", "健食法")]),
        ("第百條", [], []), ("", [], []), (None, ["第1條"], []),
    ]
    df = spark.createDataFrame([(i, a, e) for i, (a, e, _) in enumerate(rows)], "i int, a string, e array<string>")
    got = {r["i"]: r for r in df.select("i", citations.cited(F.col("a")).alias("c"), citations.unsupported(F.col("a"), F.col("e")).alias("u")).collect()}
    assert [[tuple(c) for c in got[i]["c"]] for i in range(len(rows))] == [want for *_, want in rows]
    assert [[(c["article"], c["suffix"]) for c in got[i]["u"]] for i in range(len(rows))] == [[(28, None), (15, "一")], [], [(9, None)], [], [(10, None)], [(3, None)], [], [], []]


def test_law_labels(spark):
    labels = ["食安法第28條", "食安法第15條之一", " 食安法第15之一條\n", "食安法第15條之1", "健康食品管理法第14條", "藥事法第1條", "食安法", "", None]
    got = [r["r"] for r in spark.createDataFrame([(x,) for x in labels], "x string").select(citations.law_reference(F.col("x")).alias("r")).collect()]
    want = [("食安法", 28, "28"), ("食安法", 15, "15之一"), ("食安法", 15, "15之一"), ("食安法", 15, "15之1"), ("健康食品管理法", 0, "0"), None, None, None, None]
    assert [r and tuple(r)[:3] for r in got] == want and {tuple(r)[3:] for r in got if r} == {(None, "primary")}


def test_sign_test(spark):
    p = lambda a, b: one(spark, stats.sign_test(F.col("a"), F.col("b")), a=a, b=b)
    assert p(9, 0) == pytest.approx(0.00390625) and p(15, 3) == pytest.approx(0.00754, abs=1e-5) and p(0, 0) == 1
    assert p(13, 2) == pytest.approx(0.00739, abs=1e-5) and p(9, 8) == pytest.approx(1.0) and 0 < p(60, 40) < 1


def test_bootstrap(spark):
    assert np.isnan(stats.bootstrap_numpy(np.array([]))).all()
    assert stats.bootstrap_numpy(np.ones(5)) == (1, 1, 1)
    v = np.arange(20) % 2
    assert stats.bootstrap_numpy(v, 2000, 1) == stats.bootstrap_numpy(v, 2000, 1)
    empty = stats.bootstrap(spark.createDataFrame([], "i int, v double"), "v", "i", 10, 0).first()
    assert empty["n"] == 0 and empty["mean"] is None


def test_lcs():
    assert stats.longest_common_substring("abcdef", "zcdez") == 3 and stats.longest_common_substring("", "a") == 0
    assert stats.longest_common_substring("食品😀安全", "x😀安") == 2


def test_threshold_sweep(spark):
    df = spark.createDataFrame([(0.9, True), (0.4, True), (0.5, False), (0.4, False)], "s double, inside boolean")
    got = {r["threshold"]: (r["false_rejects"], r["false_accepts"]) for r in stats.threshold_sweep(df, "s", "inside").collect()}
    assert got == {0.4: (0, 2), 0.5: (1, 1), 0.9: (1, 0)}


def test_router(spark):
    def go(q):
        return spark.createDataFrame([(q,)], "q string").select(D.route(F.col("q"))).first()[0]

    assert go("跟第28條一起被引用的有哪些條文") == "multi_hop" and go("違反哪條？有被罰的案例嗎") == "multi_hop"
    assert go("幫我審這段文案") == "ad_review" and go("標示規定？上限是哪條？") == "regulation_qa"
    assert go("標示規定？會罰多少？") is None and go("罰款") is None and go("這樣標示有哪些規定？") == "regulation_qa" and go("你好") is None
    df = spark.createDataFrame([("你好", "multi_hop"), ("你好", "other"), ("你好", None)], "q string, m string")
    assert [tuple(r[0]) for r in df.select(D.routed(F.col("q"), F.col("m"))).collect()] == [("multi_hop", "llm"), ("regulation_qa", "fallback"), ("regulation_qa", "fallback")]


def test_refusals_and_verdicts(spark):
    r = lambda a: spark.createDataFrame([(a,)], "a string").select(D.refused(F.col("a"))).first()[0]
    assert r(D.REFUSAL) and r("查無資料。無法回答。") and not r("第28條。查無案例。") and not r("") and not r(None)
    v = lambda t: one(spark, D.verdict_line(F.col("t")), t=t)
    assert v("x\nVERDICT：**High**") == "high" and v("VERDICT: low.") == "low" and v("none") is None
    lex = D.Lexicon({"bad": ("cure",), "soft": ("glow",)}, {"bad": 2, "soft": 1})
    df = spark.createDataFrame([("cure", "low", True), ("glow", "low", True), ("plain", "medium", True), ("plain", "medium", False), ("plain", None, False)], "t string, r string, w boolean")
    assert [x[0] for x in df.select(D.verdict(D.lexicon_scan(F.col("t"), lex), lex, F.col("r"), F.col("w"))).collect()] == ["high", "medium", "low", "medium", "low"]


def test_budget(spark):
    df = spark.createDataFrame([(4, 0, 0.0), (1, 12000, 99.0), (1, 1, 90.0), (3, 11999, 89.9)], "c int, t int, s double")
    assert [r[0] for r in df.select(D.over_budget(F.col("c"), F.col("t"), F.col("s"))).collect()] == ["tool_calls", "tokens", "seconds", None]


def test_gate_and_cascade(spark):
    pool = spark.createDataFrame([(1, 7, 0.52), (1, 8, 0.52), (2, 9, 0.51)], "qid int, cid int, score double")
    got = {r["qid"]: (r["confident"], r["top_score"], r["kept"]) for r in S.gate(pool, spark.createDataFrame([(1,), (2,), (3,)], "qid int"), 0.52, 5).collect()}
    assert got == {1: (True, 0.52, [7, 8]), 2: (False, 0.51, []), 3: (False, None, [])}
    first = spark.createDataFrame([(1, True, 0.9), (2, False, 0.1), (3, False, 0.2)], "qid int, confident boolean, top_score double")
    retry = spark.createDataFrame([(2, True, 0.8), (3, False, 0.3)], "qid int, confident boolean, top_score double")
    assert {r["qid"]: (r["confident"], r["top_score"], r["used_retry"], r["attempts"]) for r in S.cascade(first, retry).collect()} == {1: (True, 0.9, False, 1), 2: (True, 0.8, True, 2), 3: (False, 0.2, False, 2)}


def test_knn_in_blocks(spark, monkeypatch):
    e = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, S.knn(e, e, 3, "vec_id", "vec_id").collect()))
    monkeypatch.setattr("quillstone.operators.vectors.QUERY_BYTES", 200)
    assert sorted(map(tuple, S.knn(e, e, 3, "vec_id", "vec_id").collect())) == whole and len(whole) == 120


def test_fuzzy_best_loses_nothing(spark):
    import random

    r = random.Random(3)
    base = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    near = lambda t: t[:10] + r.choice("xyz") + t[11:]
    left = spark.createDataFrame([(i, near(t) if i % 2 else t) for i, t in enumerate(base)], "id long, t string")
    right = spark.createDataFrame([(100 + i, t) for i, t in enumerate(base)], "id long, t string")

    def grams(t):
        t = t.replace(" ", "")
        return {t[i : i + 3] for i in range(len(t) - 2)}

    want = set()
    for i, t in ((x["id"], x["t"]) for x in left.collect()):
        best = max(((len(grams(t) & grams(u)) / len(grams(t) | grams(u)), -j) for j, u in ((x["id"], x["t"]) for x in right.collect())))
        if best[0] >= 0.8:
            want.add((i, -best[1]))
    assert {(x["lid"], x["rid"]) for x in S.fuzzy_best(left, right, "id", "id", "t", 0.8).collect()} == want


def test_fuzzy_best_leaves_itself_out(spark):
    base = "abcdefghijklmnopqrstuvwxyz0123456789" * 2
    rows = [(0, base), (1, "x" + base), (2, base), (100, base + "y"), (200, "quite another text"), (300, "alone " * 5)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r["lid"]: (r["rid"], r["how"]) for r in S.fuzzy_best(df.filter("id % 100 = 0"), df, "id", "id", "t", 0.8, exclude_self=True).collect()}
    assert got == {0: (2, "exact"), 100: (0, "fuzzy")}
    pairs = {(r["a"], r["b"]) for r in S.jaccard_self(df, "id", "t", 0.8).collect()}
    assert pairs == {(0, 1), (0, 2), (0, 100), (1, 2), (1, 100), (2, 100)}


def test_page_numbers_and_nouns_of_whole_texts(spark):
    import re

    rows = ["- 3 -\n body 12/30 of\n12\n3-4\nend " * 40, "第 3 頁，共 9 頁\n5)\n|\nx ~ 7 ~", "", "a - b", "x" * 3000 + "\n88\n"]
    got = [r["y"] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(text.remove_page_numbers(F.col("x")).alias("y")).collect()]
    for x, y in zip(rows, got, strict=True):
        for p in text.PAGE_NUMBERS:
            x = re.sub(p, "", x)
        assert x == y
    docs = spark.createDataFrame([(i, "x" * 5000 + "例如白糖塊、黑糖塊、紅糖塊、冰糖塊等。") for i in range(5)] + [(9, "沒有")], "doc_id long, text string")
    nouns = {r["noun"]: (r["n"], r["rows"]) for r in text.noun_map(docs, F.col("text"), "doc_id", 3).collect()}
    assert nouns == {n: (5, [0, 1, 2]) for n in ("白糖塊", "黑糖塊", "紅糖塊", "冰糖塊")}


def test_ridge_equals_its_normal_equations(spark):
    from quillstone.plans import learning

    r = np.random.default_rng(3)
    words = ["ab", "cde", "fgh", "bcd", "efg"]
    data = [(i, " ".join(r.choice(words, 6)), float(r.normal()), ("train", "val", "test")[i % 3]) for i in range(90)]
    rows = spark.createDataFrame(data, "doc_id long, text string, y double, split string")
    got = {x["split"]: x for x in learning.experiment(rows, 5000, 1.0).collect()}
    grams = [[t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)] for _, t, *_ in data]
    train = np.array([d[3] == "train" for d in data])
    vocab = sorted({g for x, t in zip(grams, train, strict=True) if t for g in x})
    x = np.array([[g.count(v) for v in vocab] for g in grams], float)
    x *= np.log((1 + train.sum()) / (1 + (x[train] > 0).sum(0))) + 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([d[2] for d in data])
    xc, yc = x[train] - x[train].mean(0), y[train] - y[train].mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(len(vocab)), xc.T @ yc)
    p = y[train].mean() + (x - x[train].mean(0)) @ beta
    for split in ("train", "val", "test"):
        m = np.array([d[3] == split for d in data])
        assert got[split]["n"] == m.sum() and got[split]["mae"] == pytest.approx(np.abs(p - y)[m].mean(), abs=2e-3)


def test_running_sums_in_parts(spark, monkeypatch):
    monkeypatch.setattr(stats, "PARTS", 5)
    df = spark.createDataFrame([((i * 37) % 101, i % 4) for i in range(101)], "k long, v long")
    got = {r["k"]: r["s"] for r in stats.running(df, "k", s=F.col("v")).collect()}
    rows, total = sorted((r["k"], r["v"]) for r in df.collect()), 0
    for k, v in rows:
        assert got[k] == total
        total += v


def test_relational(spark):
    df = spark.createDataFrame([(2, "a\n", 1), (1, "a", 2), (3, None, 3), (4, None, 4)], "id int, t string, v int")
    assert sorted((r["id"], r["v"]) for r in R.keep_first(df, "t", ["id"]).collect()) == [(1, 2), (3, 3)]
    assert R.within(df, "id", None).count() == 4 and R.within(df, "id", df.limit(0)).count() == 0
    assert R.supplied(df, id=None, t="").count() == 4 and R.containing(df, "t", "a").count() == 2
    assert sorted(r["id"] for r in R.bag_union(df.filter("id < 3"), df, ["id"]).collect()) == [1, 2, 3, 4]
    edges = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "z"), (3, "z")], "g int, i string")
    assert [tuple(r) for r in R.co_occurring(edges, "g", "i", F.col("i") == "x").collect()] == [("y", 2), ("z", 1)]


def test_plans_join_without_products(spark):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    plan = R.co_occurring(a, "a", "b", F.col("b") == 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_tool_loop(spark):
    q = spark.createDataFrame([(1,), (2,)], "qid int")
    call = lambda ok, tokens: spark.createDataFrame([(i, ok, 10 * i, tokens, 1.0) for i in (1, 2)], "qid int, confident boolean, top_id int, tokens int, seconds double")
    tools = {"search_regulations": call(False, 7000), "cases": call(True, 6000), "related": call(True, 10)}
    plan = F.when(F.col("qid") == 1, F.array(F.lit("cases"), F.lit("related"))).otherwise(F.array(F.lit("search_regulations")))
    calls = answering.tool_loop(q, tools, plan)
    assert [(r["hop"], r["tool"], r["stop"]) for r in calls.filter("qid = 1").orderBy("hop").collect()] == [(0, "search_regulations", None), (1, "cases", None), (2, "related", "tokens")]
    got = {r["qid"]: (r["calls"], r["grounded"], r["answer_id"], r["stop_reason"]) for r in answering.loop_results(calls).collect()}
    assert got == {1: (2, True, 10, "tokens"), 2: (1, False, None, None)}


def test_fixed_path(spark):
    text_ = ["apples keep the doctor away today", "rivers run down to the sea slowly", "nothing fits here"]
    chunks = spark.createDataFrame([(i, t, hashed(t)) for i, t in enumerate(text_)], "cid int, text string, embedding array<double>")
    q = spark.createDataFrame([(1, "apples keep doctor away? rivers run down sea?"), (2, "quantum chromodynamics lattice")], "qid long, question string")
    got = {r["qid"]: r for r in answering.fixed_path(q, chunks, Models()).collect()}
    assert got[1]["sources"][:1] == [0] and 1 in got[1]["sources"] and got[1]["supported"] and not got[1]["refused"]
    assert got[2]["refused"] and got[2]["sources"] == [] and got[2]["used_retry"] is False


def test_fixed_path_has_all_places_cases_and_boost(spark):
    rows = [f"apples number {i} keep doctors away" for i in range(10)] + ["第28條 apples keep doctors away always"]
    chunks = spark.createDataFrame([(i, t, hashed(t)) for i, t in enumerate(rows)], "cid long, text string, embedding array<double>")
    cases = spark.createDataFrame([(900, "fined for apples", hashed("fined for apples"))], "cid long, text string, embedding array<double>")
    q = spark.createDataFrame([(1, "apples keep doctors away"), (2, "quantum lattice"), (3, "fined for apples")], "qid long, question string")
    got = {r["qid"]: r for r in answering.fixed_path(q, chunks, Models(), cases=cases, case_words=("fined",)).collect()}
    assert len(got[1]["sources"]) == 8 and got[1]["cases"] == [] and got[2]["refused"] and got[2]["cases"] == []
    assert got[3]["cases"] == [900] and not got[3]["refused"]
    nouns = spark.createDataFrame([("lattice", 4), ("absent", 5)], "noun string, cid long")
    assert [tuple(r) for r in answering.boosted(q, nouns).collect()] == [(2, 4)]
    pool = answering.retrieve(q, chunks, Models(rerank=lambda a, b: F.lit(1.0)), keep=20, nouns=nouns)
    assert 4 in next(r["kept"] for r in pool.collect() if r["qid"] == 2)


def test_verify_writes_anew_once(spark):
    rows = [
        (1, ["第28條 規定"], "依第28條辦理。", ("依第28條辦理。", [], False)),
        (2, ["第28條 規定"], "依第28條辦理。另依第9條。", ("依第28條辦理。", [], True)),
        (3, ["無"], "依第9條", ("依第9條", ["第9條"], True)),
        (4, [], answering.REFUSE, (answering.REFUSE, [], False)),
    ]
    df = spark.createDataFrame([(i, "q", e, a) for i, e, a, _ in rows], "i int, question string, evidence array<string>, answer string")
    got = {r["i"]: (r["answer"], r["unsupported"], r["regenerated"]) for r in answering.verify(df, Models()).collect()}
    assert got == {i: want for i, *_, want in rows}


def test_review_path_finds_guaranteed_rules_wherever_they_rank(spark):
    rows = [(i, f"slim fast now {i}") for i in range(30)] + [(99, "entirely different words here")]
    rules = spark.createDataFrame([(i, t, hashed(t)) for i, t in rows], "cid long, text string, embedding array<double>")
    texts = spark.createDataFrame([(1, "slim fast now 3")], "qid long, question string")
    (got,) = answering.review_path(texts, rules, D.Lexicon({"a": ("slim",)}, {"a": 1}), Models(), F.col("cid") == 99).collect()
    assert got["sources"][0] == 99 and got["sources"][1] == 3 and len(got["sources"]) == 5 and got["level"] == "medium"


def test_search_tool_drift_and_retry(spark):
    rows = ["alpha beta gamma delta", "omega sigma kappa theta", "quarks leptons bosons gluons"]
    chunks = spark.createDataFrame([(i, t, hashed(t)) for i, t in enumerate(rows)], "cid long, text string, embedding array<double>")
    calls = spark.createDataFrame([
        (1, "alpha beta gamma delta", "alpha beta gamma delta"), (2, "alpha beta gamma delta", "omega sigma kappa theta"),
        (3, "is it so that it was as he or we do?", "a is of quarks leptons bosons gluons to be it as so no"), (4, "nothing at all fits in here", None),
    ], "qid long, query string, original string")
    got = {r["qid"]: r for r in answering.search_tool(calls, chunks, Models(), "%s?").collect()}
    assert (got[1]["kept"][0], got[1]["drift"], got[1]["used_retry"]) == (0, False, False)
    assert (got[2]["kept"][0], got[2]["drift"]) == (1, True)
    assert (got[3]["kept"][:1], got[3]["used_retry"], got[3]["drift"]) == ([2], True, False)
    assert not got[4]["confident"] and got[4]["kept"] == []


def test_decomposed(spark):
    rows = [("可以賣嗎?要標示營養嗎?", '["可以賣糖果嗎", "糖果要標示營養嗎?"]'), ("這個產品可以賣嗎?這個產品要標示營養嗎?", '["x"]'), ("一個問題", '["x","y"]'), ("可以賣嗎?要標示營養嗎?", None), ("可以賣嗎?要標示營養嗎?", "no list")]
    got = [r["d"] for r in spark.createDataFrame(rows, "q string, reply string").select(text.decomposed(F.col("q"), F.col("reply")).alias("d")).collect()]
    assert [(len(r["subs"]), r["used_llm"]) for r in got] == [(2, True), (2, False), (1, False), (2, False), (2, True)]
    assert got[0]["subs"] == ["可以賣糖果嗎?", "糖果要標示營養嗎?"] and got[4]["subs"] == got[3]["subs"]


def test_agent_answers(spark):
    q = spark.createDataFrame([(1, "apples"), (2, "rivers")], "qid int, question string")
    call = lambda ok, top: spark.createDataFrame([(i, ok if i == 1 else False, top, 100, 1.5) for i in (1, 2)], "qid int, confident boolean, top_id int, tokens int, seconds double")
    tools = {"search_regulations": call(True, 7), "search_related": call(False, 8)}
    calls = answering.tool_loop(q, tools, F.array(F.lit("search_regulations"), F.lit("nonsense"), F.lit("search_related"), F.lit("search_regulations")))
    assert {r["error"] for r in calls.collect()} == {None, "unknown tool: nonsense"}
    chunks = spark.createDataFrame([(7, "apples keep"), (8, "related")], "cid int, text string")
    got = {r["qid"]: r for r in answering.agent_answers(q, calls, chunks).collect()}
    assert got[1]["sources"] == [7, 8] and got[1]["tokens"] == 300 and got[1]["seconds"] == 4.5 and "apples keep" in got[1]["answer"]
    assert got[2]["answer"] == answering.REFUSE and got[2]["sources"] is None and not got[2]["grounded"]


def zipped(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, d in members.items():
            z.writestr(n.replace("__", "."), d)
    return b.getvalue()


DOCX = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'


def test_files(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", DOCX)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.DOCX").write_bytes(b.getvalue())
    (tmp_path / "b.txt").write_bytes("食品".encode("big5"))
    (tmp_path / "~$b.txt").write_bytes(b"x")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.docx").write_bytes(b"junk")
    (tmp_path / "e.bin").write_bytes(b"junk")
    got = {r["path"].rsplit("/", 1)[-1]: (r["status"], r["reason"], r["text"]) for r in files.parse_files(files.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.DOCX": ("ok", None, "one\n\n| a | b |\n| --- | --- |"), "b.txt": ("ok", None, "食品"), "c.pdf": ("failed", "no_reader_for_pdf", ""), "d.docx": ("failed", "not_a_docx", "")}
    nested = zipped(x__txt=b"1", in__zip=zipped(y__txt=b"2"))
    rows = spark.createDataFrame([("z.zip", nested), ("bad.zip", b"no")], "path string, content binary")
    assert sorted((r["path"], r["error"]) for r in files.unpack(rows).collect()) == [("bad.zip", "bad_archive"), ("z.zip!in.zip!y.txt", None), ("z.zip!x.txt", None)]
    assert files.repaired("食".encode("big5").decode("cp437"), 0) == "食" and files.repaired("食", 0x800) == "食"


def test_tables_of_files(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, "x" * 50, False), ("b", 1, "(cid:1)" * 9 + "abcdefgh" * 4, False), ("c", 1, "y" * 40, True), ("d", 1, "z", False)], "path string, page int, text string, has_table boolean")
    assert {r["path"]: r["kind"] for r in files.classify_pages(pages).collect()} == {"a": "normal_text", "b": "needs_ocr", "c": "has_tables", "d": "needs_ocr"}
    cells = ["1", "113.1.2", "p", "ch", "v", "co", "NT$ 40,000", "食安法第28條之1"]
    rows = spark.createDataFrame([("115年3月裁罰.pdf", cells), ("115年3月裁罰.pdf", ["no"] * 8), ("115年3月裁罰.pdf", ["2"] * 5), ("x.pdf", cells)], "file string, cells array<string>")
    (r,) = files.notices(rows).collect()
    assert (r["year"], r["month"], r["penalty"], r["article_no"]) == (115, 3, 40000, 28)
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "q.json").write_text('[{"question": "a", "gold_chunk_id": 1}, {"question": "b", "gold_chunk_id": 2, "source": "s"}]')
    assert sorted(r["source"] for r in files.read_questions(spark, str(tmp_path / "q.json")).collect()) == ["manual", "s"]
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    assert [r["id"] for r in files.numbered(df, ["k"]).orderBy("k").collect()] == list(range(1, 101))
    files.write_splits(df.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert files.read_splits(spark, str(tmp_path / "s"), "k long").count() == 100
    files.write_tables(spark.createDataFrame([(1, "t", [("act", 28)]), (2, "u", [])], "id long, text string, refs array<struct<law_name:string,article_no:int>>"), str(tmp_path / "t"))
    assert snapshots.read(spark, str(tmp_path / "t"), "chunk_laws").count() == 1


def test_a_binary_doc_under_another_name():
    assert files.parse_file("a.docx", files.OLE + b"rest")[:2] == ("failed", "binary_doc") and files.parse_file("a.docx", b"PK damaged")[:2] == ("failed", "not_a_docx")


def test_sinks_and_loads(spark, tmp_path):
    root = str(tmp_path)
    assert files.read_nouns(spark, f"{root}/none.json").count() == 0 and files.read_prompt(spark, f"{root}/none.txt") == ""
    nouns = spark.createDataFrame([("茶", 1), ("茶", 2), ("糖", 1)], "noun string, cid long")
    files.write_nouns(nouns, f"{root}/nouns")
    assert sorted(map(tuple, files.read_nouns(spark, f"{root}/nouns").collect())) == sorted([("茶", 1), ("茶", 2), ("糖", 1)])
    (tmp_path / "p.txt").write_text("one {x}\ntwo")
    assert files.read_prompt(spark, f"{root}/p.txt") == "one {x}\ntwo"
    files.write_vectors(spark.createDataFrame([(2, [3.0, 4.0]), (1, [0.0, 0.0]), (3, None)], "cid int, embedding array<double>"), f"{root}/v")
    held = {i: v for r in snapshots.read(spark, f"{root}/v").collect() for i, v in zip(r["ids"], np.frombuffer(r["vectors"]).reshape(r["n"], r["dim"]).round(3).tolist(), strict=True)}
    assert held == {1: [0.0, 0.0], 2: [0.6, 0.8]}
    files.write_results(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), f"{root}/r.json")
    assert '"b":null' in "".join(r[0] for r in spark.read.text(f"{root}/r.json").collect())
    snapshots.write(spark.createDataFrame([(1, None), (2, "x")], "a int, b string"), f"{root}/s", "json")
    assert files.rewrite(spark, f"{root}/s", lambda df: df) is False
    assert files.rewrite(spark, f"{root}/s", lambda df: df.withColumn("a", F.col("a") + 1)) is True
    assert sorted(r["a"] for r in snapshots.read(spark, f"{root}/s").collect()) == [2, 3] and len(snapshots.versions(spark, f"{root}/s")) == 2
    chunks = spark.createDataFrame([(p, n, "t") for p in "cab" for n in (1, 0)], "path string, chunk_no int, text string").repartition(3)
    files.write_parsed(chunks, spark.createDataFrame([("f", "1")], "file string, no string"), spark.createDataFrame([("x", "failed", "empty")], "path string, status string, reason string"), f"{root}/out")
    assert [(r["path"], r["chunk_no"]) for r in spark.read.json(f"{root}/out/chunks").orderBy("id").collect()] == [(p, n) for p in "abc" for n in (0, 1)]
    assert [r["reason"] for r in spark.read.json(f"{root}/out/failed").collect()] == ["empty"]


def test_pages(spark):
    pages = spark.createDataFrame([("a", 2, "two", None), ("a", 1, "one", None), ("a", 3, " ", None), ("e", None, None, "The file is password protected"), ("f", None, None, "EOF marker not found"), ("h", 1, " " * 400, None), ("i", 1, "x" * 40, None), ("g", None, None, None)], "path string, page int, text string, error string")
    assert {r["path"]: r["text"] for r in files.joined_pages(pages.filter("path = 'a'")).collect()} == {"a": "one\n\ntwo"}
    kinds = {r["path"]: r["kind"] for r in files.classify_pages(pages.withColumn("has_table", F.lit(False)), error="error").collect()}
    assert kinds == {"a": "needs_ocr", "e": "encrypted", "f": "corrupted", "g": "empty", "h": "needs_ocr", "i": "normal_text"}
    rows = spark.createDataFrame([("ocr", "x" * 49, "ok", None), ("ocr", "x" * 50, "ok", None), ("txt", "x", "ok", None)], "how string, text string, status string, reason string")
    assert [(r["status"], r["reason"]) for r in files.settled(rows).collect()] == [("failed", "ocr_no_text"), ("ok", None), ("ok", None)]


def test_answer_sheets(spark):
    sheet = "標題\n題號 第1題 第2題 3\n答案ＡC#\n題號 4 5\n無\n題號 6\n答案 D"
    assert [tuple(x) for x in one(spark, files.answer_key(F.col("s")), s=sheet)] == [(1, "A"), (2, "C"), (6, "D")]
    paper = "1. 題幹\n7. 是題幹的一部分\n(A) 甲\n(B) 乙\n(C) 丙\n(D) 丁\n2. 次題\n(A) 甲\n(B) 乙\n(C) 丙\n(D) 標示"
    items = one(spark, files.exam_items(F.col("s")), s=paper)
    assert [(r["no"], r["stem"]) for r in items] == [(1, "題幹7. 是題幹的一部分"), (2, "次題")]
    hint = spark.createDataFrame([(r["stem"], r["options"]) for r in items], "stem string, options map<string,string>").select(files.about_rules(F.col("stem"), F.col("options")).alias("x"))
    assert [r["x"] for r in hint.collect()] == [False, True]


def test_exam(spark):
    paper = "1. 題幹\n續行\n(A) 甲\n(B) 乙\n(C) 丙\n(D) 丁\n2. 缺\n(A) 甲"
    (first, second) = one(spark, files.exam_items(F.col("s")), s=paper)
    assert tuple(first) == (1, "題幹續行", {"A": "甲", "B": "乙", "C": "丙", "D": "丁"}) and second["options"] == {"A": "甲"}
    papers = [(113, paper), (112, REAL_PAPER), (111, None), (110, "")]
    keys = [(113, 1, "B"), (113, 2, "A"), (112, 1, "C"), (112, 2, "D"), (112, 3, "#")]
    got = files.exam_table(spark.createDataFrame(papers, "year int, text string"), spark.createDataFrame(keys, "year int, no int, answer string")).orderBy("year", "no").collect()
    assert [(r["year"], r["no"], r["stem"], r["answer"]) for r in got] == [(112, 1, "下列何者正確？", "C"), (112, 2, "依第28條,何者為12 倍?續行", "D"), (113, 1, "題幹續行", "B")]
    assert got[0]["options"] == {"A": "甲", "B": "乙", "C": "丙續", "D": "丁"} and one(spark, files.exam_items(F.col("s")), s=None) is None


#: As papers come: an essay part, heads and feet within a question, numbers followed by a space, full-width letters.
REAL_PAPER = """甲、申論題部分
1 申論題不算
乙、測驗題部分
說明文字
1 下列何者正確？
A.甲
B. 乙
代號：1234
頁次：4－2
C.丙
續
Ｄ.丁
2 依第28條,何者為
12 倍?續行
A.一
B.二
C.三
D.四
3 沒有四個選項
A.一
"""


def test_html():
    assert html.parse(None)[1] == "empty" and html.parse("<script>x</script>")[1] == "no_text"
    ok = html.parse("<p>a &amp; b</p><nav>menu</nav><table><tr><th>h</th><td>1</td></tr></table><div>c<br>d</div>")
    assert ok == ("ok", None, "a & b\nc\nd", [[["h", "1"]]])


def test_rendering(spark):
    from quillstone.functions import rendering as G

    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "q int, i int, t string")
    assert G.prompt_rows(df, "q", ["i"], F.col("t"), "|").first()["prompt"] == "[1] a|[2] b"
    assert one(spark, G.filled("{a}-{b}", a=F.col("x"), b=F.lit(None)), x=3) == "3-"
    assert one(spark, G.answer_letter(F.col("r")), r="答案：Ｂ") == "B" and one(spark, G.answer_letter(F.col("r")), r="?") == "X"
    assert one(spark, G.listed_questions(F.col("r")), r='["a", " ", "b?"]') == ["a?", "b?"] and one(spark, G.listed_questions(F.col("r")), r="junk") is None
    assert one(spark, G.case_label(F.col("r")), r="違反第28條第1項") == "第28條第1項" and one(spark, G.case_label(F.col("r")), r="無") == "other"
    assert one(spark, G.penalty_report(F.col("r"), "裁罰"), r="115年3月裁罰.PDF")
    m = spark.createDataFrame([("a", "x", 1.5)], "section string, name string, value double")
    assert G.markdown_report(m, ["a", "b"]) == "## a\n\n| metric | value |\n|-|-|\n| x | 1.5 |\n\n## b\n\n_not run_\n"
    ok = lambda **k: one(spark, G.part_ok(F.col("a"), F.array(F.lit("第28條")), F.col("c"), F.col("n"), "[0-9]+元", "公司", "查無"), **k)
    assert ok(a="依第28條", c=False, n=False) and ok(a="某公司罰5元", c=True, n=False) and ok(a="查無", c=False, n=True) and not ok(a="某公司", c=True, n=False)


def test_domain_lexicons(spark):
    from quillstone.operators import lexicons as L

    ads = [("可治療失眠", "無", "high"), ("減肥首選", "**VERDICT:** 合規", "medium"), ("維持正常精力", "VERDICT 有疑慮", "low"), ("好吃", "易生誤解", "medium"), ("好吃", "涉及醫療效能", "high"), ("好吃", "無", "low")]
    df = spark.createDataFrame(ads, "t string, r string, want string")
    level = D.verdict(D.lexicon_scan(F.col("t"), L.RISK), L.RISK, D.report_level(F.col("r"), L.REPORT_HIGH, L.REPORT_MEDIUM), D.any_of(F.col("t"), L.ALLOWED))
    assert [r["got"] for r in df.select(level.alias("got")).collect()] == [w for *_, w in ads]
    f = lambda q: spark.createDataFrame([(q,)], "q string").select(D.inferred_filter(F.col("q"), L.ADVERTISING, L.CLAIMS, L.LABELS, L.ADVERTISING_LAW)).first()[0]
    assert f("減肥廣告") == "食安法第28條" and f("廣告標示") is None and f("添加物") is None
    assert [len(L.RISK.terms[c]) for c in L.RISK.terms] == [24, 30, 3] and len(L.EXAM) == 33
