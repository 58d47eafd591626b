"""The tool loop, hop by hop: a table of questions' states, one written hop at a time.

At each hop a policy, a column over the state, names the next tool of every open question, or none where it would answer;
only those questions run, each by the tool it named. What the tool found goes into the state that the next decision
sees. A question closes when its policy answers or a budget is used up; a question that would answer without a search of
regulations has one made for it first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import haystack, law_reference
from ..operators.cocitation import related_evidence, related_laws
from ..operators.decisions import over_budget
from ..stages import Stages
from .answering import CASES, REFUSE, evidence_lists, nearest_cases, search_tool, verify, with_law
from .models import Models

PIECES = "array<struct<cid:bigint,text:string,primary_law:string>>"
#: What a tool gives for its calls (qid, query, original): one row for each.
FOUND = f"qid bigint, confident boolean, top_score double, pieces {PIECES}, tokens bigint, seconds double, retried boolean"
#: A question's state, as the policy sees it.
STATE = f"qid bigint, question string, calls int, llm_calls int, tokens bigint, seconds double, grounded boolean, forced boolean, tools array<string>, last_tool string, last_confident boolean, last_score double, last_pieces {PIECES}, stop string"
TRACE = f"qid bigint, hop int, tool string, query string, confident boolean, top_score double, pieces {PIECES}, tokens bigint, seconds double, forced boolean, error string"

Tool = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Policy:
    """tool: the next tool's name, null to answer; query: what it is asked, null for the question itself; tokens: what
    the decision costs. Columns over STATE."""

    tool: Column
    query: Column
    tokens: Column


@dataclass(frozen=True)
class Budget:
    """A null bound is none; but the number of calls has to have one."""

    calls: int = 4
    tokens: int = 12_000
    seconds: float = 90.0


def _pieces(cids: Column, texts: Column, laws: Column) -> Column:
    zipped = F.arrays_zip(cids.alias("cid"), texts.alias("text"), laws.alias("law"))
    return F.transform(zipped, lambda z: F.struct(z["cid"].cast("bigint").alias("cid"), z["text"].alias("text"), z["law"].alias("primary_law")))


def regulations(chunks: DataFrame, models: Models, stages: Stages, shell: str, tokens: int = 2000, **how) -> Tool:
    """search_tool() over chunks(cid, text, embedding, [primary_law]) as a tool of the loop."""

    def call(calls: DataFrame) -> DataFrame:
        got = stages.table(search_tool(calls, chunks, models, shell, stages=stages, **how), "search")
        found = stages.table(got.select("qid", F.posexplode("kept").alias("place", "cid")), "kept")
        rows = evidence_lists(found, with_law(chunks))
        pieces = _pieces(F.col("sources"), F.col("evidence"), F.col("laws"))
        return got.join(rows.select("qid", pieces.alias("pieces")), "qid", "left").select("qid", "confident", "top_score", "pieces", F.lit(tokens).alias("tokens"), F.lit(0.0).alias("seconds"), F.col("used_retry").alias("retried"))

    return call


def violation_cases(cases: DataFrame, models: Models, stages: Stages, top: int = CASES, tokens: int = 1000) -> Tool:
    """nearest_cases() over cases(cid, text, embedding, [primary_law]): what it finds is evidence if it is near enough. The
    ids of cases are below zero, so that they are no chunk's."""

    def call(calls: DataFrame) -> DataFrame:
        near = nearest_cases(calls.select("qid", F.col("query").alias("question")), cases, models, top, stages=stages)
        ids = F.transform("cases", lambda c: -c.cast("bigint") - 1)
        pieces = F.when(F.col("case_confident"), _pieces(ids, F.col("case_texts"), F.col("case_laws")))
        return calls.select("qid").join(near, "qid", "left").select("qid", F.coalesce("case_confident", F.lit(False)).alias("confident"), F.lit(None).cast("double").alias("top_score"), pieces.alias("pieces"), F.lit(tokens).alias("tokens"), F.lit(0.0).alias("seconds"), F.lit(False).alias("retried"))

    return call


def related(edges: str, top: int = 10, tokens: int = 500) -> Tool:
    """related_laws() over the bucketed edges: the query is an article's label. Never confident: any article has
    neighbours, so they ground nothing, but what they name may be cited."""

    def call(calls: DataFrame) -> DataFrame:
        asked = calls.select("qid", law_reference(F.col("query"))["article_full"].alias("article"))
        found = related_evidence(related_laws(asked, edges, top))
        order = F.array_sort(F.collect_list(F.struct("place", "text", "primary_law")))
        lists = found.groupBy("qid").agg(F.transform(order, lambda x: F.struct(F.lit(None).cast("bigint").alias("cid"), x["text"].alias("text"), x["primary_law"].alias("primary_law"))).alias("pieces"))
        return calls.select("qid").join(lists, "qid", "left").select("qid", F.lit(False).alias("confident"), F.lit(None).cast("double").alias("top_score"), "pieces", F.lit(tokens).alias("tokens"), F.lit(0.0).alias("seconds"), F.lit(False).alias("retried"))

    return call


def _first_states(questions: DataFrame) -> DataFrame:
    none = F.lit(None)
    values = {"calls": F.lit(0), "llm_calls": F.lit(0), "tokens": F.lit(0), "seconds": F.lit(0.0), "grounded": F.lit(False), "forced": F.lit(False), "tools": F.array()}
    kinds = [c.split(" ", 1) for c in STATE.split(", ")]
    return questions.select(*[(F.col(n) if n in ("qid", "question") else values.get(n, none)).cast(k).alias(n) for n, k in kinds])


def run_loop(questions: DataFrame, tools: dict[str, Tool], policy: Policy, stages: Stages, budget: Budget = Budget(), search: str = "search_regulations", force: bool = True, grounding: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """questions(qid, question) -> (states, trace): a question's last state, and a row for each call that was made.

    Each tool gets the calls of the questions that named it at this hop, and is not run where there are none. An unknown
    tool is a call with an error that grounds nothing. A question is grounded by a confident call of any tool, or of those
    in `grounding`. A forced search of regulations asks the question as it is; where the budget of calls is used up
    it is not made. stop says which budget ended a question, or "answered". A qid is distinct and not null; a null
    question is asked as it is. There are at most budget.calls + 1 hops.
    """
    state, traces = stages.table(_first_states(questions), "state"), []
    grounds = F.col("confident") if grounding is None else F.col("confident") & F.col("tool").isin(*grounding)
    for hop in range(budget.calls + 1):
        opened = state.filter("stop is null")
        over = over_budget(F.col("calls"), F.col("tokens"), F.col("seconds"), budget.calls, budget.tokens, budget.seconds)
        # The decision itself is paid for, also the one to answer; with a used-up budget no tool is offered.
        asked = opened.select("*", over.alias("_over"), policy.tool.alias("_wanted"), policy.query.alias("_query"), policy.tokens.cast("bigint").alias("_cost"))
        asked = asked.withColumn("_wanted", F.when(F.col("_over").isNull(), F.col("_wanted")))
        must = F.lit(force) & F.col("_wanted").isNull() & F.col("_over").isNull() & ~F.col("forced") & ~F.array_contains("tools", search)
        asked = asked.withColumn("_forced", must).withColumn("_tool", F.when(must, search).otherwise(F.col("_wanted")))
        asked = asked.withColumn("_query", F.when(must, F.col("question")).otherwise(F.coalesce("_query", "question")))
        asked = stages.table(asked, f"asked-{hop}")
        calls = asked.filter("_tool is not null").select("qid", F.col("_query").alias("query"), F.col("question").alias("original"), F.col("_tool").alias("tool"), F.col("_forced").alias("forced"))
        named = {r[0] for r in calls.select("tool").distinct().limit(len(tools) + 1).collect()}
        if named:
            results = [tool(calls.filter(F.col("tool") == name).select("qid", "query", "original")).select(*[F.col(c.split(" ")[0]).cast(c.split(" ", 1)[1]) for c in FOUND.split(", ")], F.lit(None).cast("string").alias("error")) for name, tool in tools.items() if name in named]
            unknown = calls.filter(~F.col("tool").isin(*tools)).select("qid", *[F.lit(v).cast(c.split(" ", 1)[1]).alias(c.split(" ")[0]) for c, v in zip(FOUND.split(", ")[1:], (False, None, None, 0, 0.0, False), strict=True)], F.concat(F.lit("unknown tool: "), F.col("tool")).alias("error"))
            found = stages.table(reduce(DataFrame.unionByName, [*results, unknown]), f"found-{hop}")
        else:
            found = questions.sparkSession.createDataFrame([], FOUND + ", error string")
        made = calls.join(found, "qid", "left").withColumn("confident", F.coalesce("confident", F.lit(False))).withColumn("pieces", F.coalesce("pieces", F.array().cast(PIECES)))
        made = stages.table(made.withColumn("grounds", grounds), f"made-{hop}")
        traces.append(made.select("qid", F.lit(hop).alias("hop"), "tool", "query", "confident", "top_score", "pieces", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"), "forced", "error"))
        f = made.select("qid", *[F.col(c).alias(f"f_{c}") for c in ("tool", "confident", "top_score", "pieces", "tokens", "seconds", "retried", "grounds", "forced")])
        j = asked.join(f, "qid", "left")
        was = F.col("f_tool").isNotNull()
        moved = j.select(
            "qid", "question", (F.col("calls") + was.cast("int")).alias("calls"), (F.col("llm_calls") + 1 + F.coalesce(F.col("f_retried").cast("int"), F.lit(0))).alias("llm_calls"),
            (F.col("tokens") + F.coalesce("_cost", F.lit(0)) + F.coalesce("f_tokens", F.lit(0))).alias("tokens"), (F.col("seconds") + F.coalesce("f_seconds", F.lit(0.0))).alias("seconds"),
            (F.col("grounded") | F.coalesce("f_grounds", F.lit(False))).alias("grounded"), (F.col("forced") | F.coalesce("f_forced", F.lit(False))).alias("forced"),
            F.when(was, F.array_append("tools", F.col("f_tool"))).otherwise(F.col("tools")).alias("tools"),
            *[F.when(was, F.col(f"f_{a}")).otherwise(F.col(f"last_{b}")).alias(f"last_{b}") for a, b in (("tool", "tool"), ("confident", "confident"), ("top_score", "score"), ("pieces", "pieces"))],
            F.when(~was, F.coalesce("_over", F.lit("answered"))).alias("stop"),
        )
        kinds = [c.split(" ", 1) for c in STATE.split(", ")]
        state = stages.table(state.filter("stop is not null").unionByName(moved.select(*[F.col(n).cast(k).alias(n) for n, k in kinds])), f"state-{hop}")
        if state.filter("stop is null").isEmpty():
            break
    # Whoever is still open has used up the calls.
    state = state.withColumn("stop", F.coalesce("stop", F.lit("tool_calls")))
    return state, reduce(DataFrame.unionByName, traces)


def loop_pieces(trace: DataFrame, also: tuple[str, ...] = ("search_related_laws",)) -> DataFrame:
    """qid, sources, evidence, haystacks: what confident calls found, and those of the tools in `also`, which ground
    nothing but name real articles; each piece once, in the order of the calls."""
    rows = trace.filter(F.col("confident") | F.col("tool").isin(*also)).select("qid", "hop", "pieces")
    order = F.array_sort(F.collect_list(F.struct("hop", "pieces")))
    lists = rows.groupBy("qid").agg(F.array_distinct(F.flatten(F.transform(order, lambda x: x["pieces"]))).alias("p"))
    return lists.select("qid", F.array_distinct(F.filter(F.transform("p", lambda x: x["cid"]), lambda c: c.isNotNull())).alias("sources"), F.transform("p", lambda x: x["text"]).alias("evidence"), F.transform("p", lambda x: haystack(x["text"], x["primary_law"])).alias("haystacks"))


def loop_answers(states: DataFrame, trace: DataFrame, models: Models = Models(), also: tuple[str, ...] = ("search_related_laws",)) -> DataFrame:  # noqa: B008
    """qid, calls, llm_calls, tokens, seconds, grounded, stop, tools, sources, answer, unsupported, regenerated: a question
    that no call grounds is refused; else an answer is generated from what the calls found, and verified."""
    out = states.drop("last_pieces").join(loop_pieces(trace, also), "qid", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumn("evidence", F.coalesce("evidence", empty)).withColumn("haystacks", F.coalesce("haystacks", empty))
    out = out.withColumn("answer", F.when(F.col("grounded"), models.generate(F.col("question"), F.col("evidence"), F.lit(""))).otherwise(REFUSE))
    done = verify(out, models)
    return done.select("qid", "calls", (F.col("llm_calls") + F.col("regenerated").cast("int")).alias("llm_calls"), "tokens", "seconds", "grounded", "stop", "tools", F.when(F.col("grounded"), F.col("sources")).alias("sources"), "answer", "unsupported", "regenerated")
