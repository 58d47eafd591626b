"""The answering plans to their ends: citations by the article of origin, notes, verdict lines, exchanges, the loop."""

import re
import time

import pytest
from pyspark.sql import functions as F

from quillstone.operators import cocitation
from quillstone.operators import decisions as D
from quillstone.plans import answering, loop
from quillstone.plans.models import Models, encode, hashed
from quillstone.stages import Stages


def chunks_of(spark, rows):
    return spark.createDataFrame([(i, t, hashed(t), law) for i, t, law in rows], "cid long, text string, embedding array<double>, primary_law string")


def test_encode_is_hashed_row_by_row(spark):
    texts = ["apples keep the doctor apples", "", None, "  ", "Äpfel ÄPFEL x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", encode("t").alias("v")).orderBy("i").collect()
    for t, r in zip(texts, got, strict=True):
        assert r["v"] == pytest.approx(hashed(t))


def test_the_article_of_origin_supports_a_citation(spark):
    rows = [
        (1, "依第28條辦理。", ["沒有條號"], ["沒有條號\n食安法第28條"], False, "依第28條辦理。", []),
        (2, "依第28條辦理。", ["沒有條號"], ["沒有條號\n"], True, "依第28條辦理。", ["第28條"]),
        (3, "依第15條之1。另依第二十八條。", ["第 28 條"], ["第 28 條\n食安法第15之一條"], False, "依第15條之1。另依第二十八條。", []),
        (4, "依食安法第5條。依食安法第28條。", [""], ["\n食安法第28條"], True, "依食安法第28條。", []),
    ]
    df = spark.createDataFrame([(i, "q", e, h, a) for i, a, e, h, *_ in rows], "i int, question string, evidence array<string>, haystacks array<string>, answer string")
    got = {r["i"]: (r["regenerated"], r["answer"], r["unsupported"]) for r in answering.verify(df, Models()).collect()}
    assert got == {i: (again, answer, left) for i, _, _, _, again, answer, left in rows}
    # Without haystacks the texts alone support.
    assert answering.verify(df.drop("haystacks").filter("i = 1"), Models()).first()["regenerated"]


def test_fixed_path_cites_the_article_of_its_source(spark):
    chunks = chunks_of(spark, [(1, "apples keep the doctor away", "食安法第28條"), (2, "rivers run down to the sea", None)])
    q = spark.createDataFrame([(1, "apples keep the doctor away"), (2, "rivers run down to the sea")], "qid long, question string")
    models = Models(generate=lambda q, e, n: F.concat(F.lit("依食安法第28條辦理。"), F.get(e, F.lit(0)), F.lit("。"), n))
    got = {i: answering.fixed_path(q.filter(F.col("qid") == i), chunks.filter(F.col("cid") == i), models).first() for i in (1, 2)}
    assert not got[1]["regenerated"] and got[1]["supported"] and got[1]["answer"].startswith("依食安法第28條")
    assert got[2]["regenerated"] and got[2]["supported"] and got[2]["answer"].startswith("rivers run")


def test_notes_cases_and_parts(spark):
    chunks = chunks_of(spark, [(1, "apples keep the doctor away", None), (2, "rivers run down to the sea", None)])
    cases = chunks_of(spark, [(900, "fined for selling pears", "食安法第45條")])
    told = Models(generate=lambda q, e, n: F.concat(F.lit("依第45條。"), n))
    q = spark.createDataFrame([(1, "apples keep the doctor away?rivers run down to the sea?"), (2, "fined for selling pears"), (3, "apples keep the doctor away"), (4, "quantum lattice")], "qid long, question string")
    got = {r["qid"]: r for r in answering.fixed_path(q, chunks, told, cases=cases, case_words=("fined",)).collect()}
    assert answering.EACH_PART in got[1]["answer"] and "1. apples keep the doctor away?" in got[1]["answer"] and "2. rivers" in got[1]["answer"]
    # A case grounds the answer alone, and its article supports what it cites.
    assert got[2]["cases"] == [900] and answering.ONLY_CASES in got[2]["answer"] and not got[2]["regenerated"] and not got[2]["confident"]
    assert answering.EACH_PART not in got[3]["answer"] and answering.ONLY_CASES not in got[3]["answer"] and got[4]["refused"]
    # One part that asks for cases is enough; the caller can ask for them too.
    parts = spark.createDataFrame([(1, "apples keep the doctor away?fined for selling pears?")], "qid long, question string")
    assert answering.fixed_path(parts, chunks, told, cases=cases, case_words=("fined",)).first()["n_subs"] == 2
    asked = answering.fixed_path(q.filter("qid = 2"), chunks, told, cases=cases, case_words=("none",)).first()
    assert asked["refused"] and answering.fixed_path(q.filter("qid = 2"), chunks, told, cases=cases, case_words=("none",), include_cases=True).first()["cases"] == [900]


def test_questions_of_nothing(spark):
    chunks = chunks_of(spark, [(1, "apples keep the doctor away", None)])
    q = spark.createDataFrame([(1, None), (2, "")], "qid long, question string")
    assert all(r["refused"] and r["sources"] == [] for r in answering.fixed_path(q, chunks).collect())
    assert answering.fixed_path(q.limit(0), chunks).count() == 0
    assert answering.fixed_path(spark.createDataFrame([(1, "apples")], "qid long, question string"), chunks.limit(0)).first()["refused"]


def test_review_answers_without_the_verdict_line(spark):
    lines = ["報告。\n\nVERDICT: 高風險", "報告。\n**VERDICT**：**有疑慮**  ", "VERDICT: high\n報告", "報告", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", D.without_verdict(F.col("t")).alias("a")).orderBy("i").collect()
    assert [r["a"] for r in got] == ["報告。", "報告。", "VERDICT: high\n報告", "報告", None]
    rules = chunks_of(spark, [(1, "slim fast now", "食安法第28條"), (2, "other words", None)])
    texts = spark.createDataFrame([(1, "slim fast now"), (2, "plain other words")], "qid long, question string")
    models = Models(generate=lambda q, e, n: F.lit("違反食安法第28條。以下說明與法規名稱無關的事項。依第3條。"))
    got = {r["qid"]: r for r in answering.review_path(texts, rules, D.Lexicon({"a": ("slim",)}, {"a": 1}), models).collect()}
    assert all("VERDICT" not in r["answer"] for r in got.values()) and got[1]["answer"].startswith("違反食安法第28條") and "第3條" not in got[1]["answer"]
    assert got[1]["level"] == "medium" and got[2]["level"] == "low"


def shuffles(spark, run):
    """Exchanges of all jobs that run() starts, and Python encodings of a corpus."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    time.sleep(1)
    done = store.executionsList()
    plans = [done.apply(i).physicalPlanDescription().split("Initial Plan")[0].split("\n\n")[0] for i in range(before, done.size())]
    return sum(len(re.findall(r"(?:\+-|:-) Exchange", p)) for p in plans), sum("ArrowEvalPython" in p and "documents.parquet" in p for p in plans)


def test_the_fixed_path_moves_little_and_encodes_once(spark):
    from quillstone.queries import QUERIES

    moved, encoded = shuffles(spark, lambda: QUERIES["pipeline_query"](spark, "/root/testdata/sf0.001").collect())
    assert moved <= 12 and encoded <= 1


# --- the loop ---


def found(spark, calls, answers, name, seen):
    """A tool that knows its answers, and notes what it was asked."""
    rows = [(r["qid"], r["query"]) for r in calls.collect()]
    seen.setdefault(name, []).extend(rows)
    return spark.createDataFrame([(q, answers[q][0], 0.9, [(10 * q + len(name), f"text of {name}", answers[q][1])], answers[q][2], 1.0, False) for q, _ in rows if q in answers], loop.FOUND)


def simulated(qid, plan, answers, budget):
    """The loop for one question, by hand."""
    calls = tokens = hop = 0
    grounded = forced = False
    tools, trace = [], []
    while True:
        over = "tool_calls" if calls >= budget.calls else "tokens" if tokens >= budget.tokens else None
        tokens += 100
        wanted = None if over else plan(qid, tools, trace)
        if wanted is None:
            if over or forced or "search_regulations" in tools:
                return calls, tokens, grounded, over or "answered", tools
            wanted, forced = "search_regulations", True
        ok, _, cost = answers.get(wanted, {}).get(qid, (False, None, 0))
        calls, tokens, grounded = calls + 1, tokens + cost, grounded or ok
        tools = [*tools, wanted]
        trace.append(ok)
        hop += 1


def test_the_loop_runs_only_what_was_decided(spark):
    n = 24
    answers = {
        "search_regulations": {q: (q % 3 == 0, "食安法第28條", 1000) for q in range(n)},
        "search_violation_cases": {q: (q % 2 == 0, None, 3000) for q in range(n) if q != 5},
        "search_related_laws": {q: (False, "食安法第45條", 10) for q in range(n)},
    }

    def plan(qid, tools, trace):
        if not tools:
            return {0: "search_violation_cases", 1: None, 2: "nonsense", 3: "search_regulations"}[qid % 4]
        if tools[-1] == "search_regulations":
            return "search_related_laws" if trace[-1] else "search_violation_cases"
        if tools[-1] == "search_violation_cases" and qid % 5 == 0:
            return "search_violation_cases"
        return None

    last, cases = F.col("last_tool"), "search_violation_cases"
    first = F.when(F.col("qid") % 4 == 0, cases).when(F.col("qid") % 4 == 2, "nonsense").when(F.col("qid") % 4 == 3, "search_regulations")
    policy = loop.Policy(F.when(last.isNull(), first).when(last == "search_regulations", F.when(F.col("last_confident"), "search_related_laws").otherwise(cases)).when((last == cases) & (F.col("qid") % 5 == 0), cases), F.concat(F.lit("ask "), F.col("question")), F.lit(100))
    q = spark.createDataFrame([(i, f"question {i}") for i in range(n)], "qid long, question string")
    for budget in (loop.Budget(4, 12_000), loop.Budget(3, 2_500), loop.Budget(1, 10**6)):
        seen = {}
        tools = {name: (lambda calls, name=name: found(spark, calls, answers[name], name, seen)) for name in answers}
        with Stages(spark, "loop") as stages:
            states, trace = loop.run_loop(q, tools, policy, stages, budget)
            got = {r["qid"]: (r["calls"], r["tokens"], r["grounded"], r["stop"], r["tools"]) for r in states.collect()}
            rows = trace.collect()
            out = {r["qid"]: r for r in loop.loop_answers(states, trace, Models(generate=lambda q, e, n: F.concat(F.lit("依食安法第28條。依食安法第45條。"), F.array_join(e, "。")))).collect()}
        assert got == {i: simulated(i, plan, answers, budget) for i in range(n)}
        # The calls that were made are the calls that were computed, those of unknown tools aside.
        assert sorted((r["qid"], r["query"], r["tool"]) for r in rows if r["error"] is None) == sorted((i, x, name) for name, asked in seen.items() for i, x in asked)
        assert all(r["error"] == "unknown tool: nonsense" and not r["confident"] for r in rows if r["tool"] == "nonsense")
        assert all(r["query"] == (f"question {r['qid']}" if r["forced"] else f"ask question {r['qid']}") for r in rows)
        for i, r in out.items():
            grounded = got[i][2]
            assert r["grounded"] == grounded and (r["answer"] == answering.REFUSE) == (not grounded)
            if grounded:  # what related laws name may be cited, though it grounds nothing
                assert ("第28條" in r["answer"]) == (answers["search_regulations"][i][0] and "search_regulations" in got[i][4])
                assert ("第45條" in r["answer"]) == ("search_related_laws" in got[i][4])


def test_related_laws_as_a_tool(spark):
    edges = spark.createDataFrame([(1, "食安法", "28"), (1, "食安法", "45"), (2, "食安法", "28"), (2, "食安法", "45"), (2, "食安法", "7")], "chunk_id long, law_name string, article string")
    cocitation.write_edges(edges, "loop_test", 4)
    try:
        calls = spark.createDataFrame([(1, "食安法第28條", "q"), (2, "no article", "q")], "qid long, query string, original string")
        got = {r["qid"]: r for r in loop.related("loop_test")(calls).collect()}
        assert [p["primary_law"] for p in got[1]["pieces"]] == ["食安法第45條", "食安法第7條"] and not got[1]["confident"] and not got[2]["pieces"]
    finally:
        cocitation.drop_edges(spark, "loop_test")


# --- question sets ---


def test_question_sets(spark):
    from quillstone.plans import questions as Q

    texts = [(i, "ab"[i % 2], f"chunk number {i} " + " ".join(f"w{i}x{j}" for j in range(25)) if i % 4 else "twin chunk " * 15) for i in range(40)] + [(90, "a", "short"), (91, "c", "other kind " * 20), (92, "a", None)]
    chunks = spark.createDataFrame([(i, k, t, hashed(t)) for i, k, t in texts], "cid long, kind string, text string, embedding array<double>")
    replies = {1: lambda i: None if i % 5 == 0 else "ok" if i % 5 == 1 else f"chunk number {i} w" if i % 5 == 2 else f"what is said there about {i}?", 2: lambda i: "no" if i % 3 else f"asked again about {i}, please?"}
    asked = {n: spark.sparkContext.broadcast({t: f(i) for i, _, t in texts if t}) for n, f in replies.items()}
    reply = lambda n: F.udf(lambda t: asked[n].value.get(t), "string")
    ask = lambda text, attempt: F.when(attempt == 1, reply(1)(text)).otherwise(reply(2)(text))
    with Stages(spark, "questions") as stages:
        kept = stages.table(chunks, "chunks")
        picked = {r["cid"]: r for r in Q.sampled_chunks(kept, {"a": 6, "b": 9}, stages, seed=1).collect()}
        every = {r["cid"] for r in Q.sampled_chunks(kept, {"a": 99, "b": 99}, stages, seed=1, seen=spark.createDataFrame([(1,), (2,)], "cid long")).collect()}
        got = {r["cid"]: r for r in Q.question_set(kept.filter("cid < 40 and cid % 4 <> 0"), ask, stages).collect()}
        assert Q.sampled_chunks(kept.limit(0), {"a": 3}, stages).count() == 0
    # Twins are near duplicates of each other (all multiples of four); a quota is met from the others.
    assert len(picked) == 6 + 9 and not any(i % 4 == 0 or i >= 90 for i in picked) and every == {i for i in range(40) if i % 4} - {1, 2}

    def lcs(a, b):
        return max((n for n in range(len(a) + 1) for s in range(len(a) - n + 1) if a[s : s + n] in b), default=0)

    text = {i: t for i, _, t in texts}
    bad = lambda q, t: "no reply" if q is None else "length" if not 12 <= len(q) <= 60 else "copied" if lcs(q, t) > 12 else None
    for i, r in got.items():
        one = replies[1](i)
        why = bad(one, text[i])
        two = replies[2](i) if why in ("length", "copied") else None
        taken = two if two and bad(two, text[i]) is None else one
        assert (r["question"], r["reason"], r["attempts"]) == (taken, bad(taken, text[i]), 2 if two else 1)
    assert {r["reason"] for r in got.values()} == {None, "length", "copied", "no reply"}
