"""Whole plans: gated retrieval, the fixed path, the review path, the bounded tool loop."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citations import haystack
from ..operators import cocitation
from ..operators import similarity as S
from ..plans import answering, loop
from ..plans.models import Models
from ..session import table
from ..stages import Stages
from .decisions import LEXICON
from .registry import query
from .similarity import _DOT, _TOP


@query(f"""WITH t AS (SELECT * FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank <= 10), q AS (SELECT vec_id AS qid, label FROM embeddings WHERE vec_id % 25 = 0), r AS (SELECT t.*, c.label AS cl FROM t JOIN embeddings c ON c.vec_id = t.cid)
SELECT q.qid, max(score) AS top_score, coalesce(max(score) >= 0.55, false) AS confident, min(rank) FILTER (r.cl = q.label) AS gold_rank, round(coalesce(1.0 / min(rank) FILTER (r.cl = q.label), 0), 6) AS rr FROM q LEFT JOIN r ON r.qid = q.qid GROUP BY q.qid""")
def gated_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Search, gate, rank of the gold row, reciprocal rank: one row for each query, rejected ones too."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 25 = 0")
    pool = S.knn(q, e, 10, "vec_id", "vec_id")
    gate = S.gate(pool, q.select(F.col("vec_id").alias("qid")), 0.55, 10)
    gold = pool.join(e.select(F.col("vec_id").alias("cid"), F.col("label").alias("cl")), "cid").join(q.select(F.col("vec_id").alias("qid"), "label"), "qid")
    rank = gold.filter("cl = label").groupBy("qid").agg(F.min("rank").alias("gold_rank"))
    return gate.join(rank, "qid", "left").select("qid", "top_score", "confident", "gold_rank", F.round(F.coalesce(1.0 / F.col("gold_rank"), F.lit(0.0)), 6).alias("rr"))


def _chunks(spark: SparkSession, d: str, models: Models) -> DataFrame:
    """Documents as chunks that come from an article each."""
    docs = table(spark, d, "documents")
    law = F.concat(F.lit("食安法第"), (F.col("doc_id") % 60 + 1).cast("string"), F.lit("條"))
    return docs.select(F.col("doc_id").alias("cid"), "text", models.encode(F.col("text")).alias("embedding"), law.alias("primary_law"))


@query()
def pipeline_query(spark: SparkSession, d: str) -> DataFrame:
    """The fixed path: benchmark passages ask, documents answer or the question is refused."""
    models = Models()
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    with Stages(spark, "pipeline-query") as stages:
        return answering.fixed_path(questions, stages.table(_chunks(spark, d, models), "chunks"), models, split="[.]+")


@query()
def review_path(spark: SparkSession, d: str) -> DataFrame:
    """The review path over user turns, with benchmark items as the rules."""
    models = Models()
    texts = table(spark, d, "conversations").filter("role = 'user'").select(F.struct("conv_id", "turn").alias("qid"), F.col("text").alias("question"))
    rules = table(spark, d, "benchmark").select(F.col("item_id").alias("cid"), "text", models.encode(F.col("text")).alias("embedding"))
    with Stages(spark, "review-query") as stages:
        out = answering.review_path(texts, stages.table(rules, "rules"), LEXICON, models, F.col("cid") < 3)
    return out.select("qid.*", F.size("matched.grave").alias("grave"), F.size("matched.mild").alias("mild"), "sources", "level")


_BEST = f"SELECT qid, cid AS top_id, score FROM ({_TOP} WHERE q.vec_id % 25 = 0{{}}) WHERE rank = 1"
_LOOP = f"""WITH reg AS ({_BEST.format(" AND c.label < 5")}), cas AS ({_BEST.format(" AND c.label >= 5")}), rel AS ({_BEST.format(" AND c.label % 3 = 0")}),
calls AS (SELECT qid, 'search_regulations' AS tool, top_id, score >= 0.4 AS confident, 4000 AS tokens FROM reg UNION ALL SELECT qid, 'search_cases', top_id, score >= 0.45, 5000 FROM cas UNION ALL SELECT qid, 'search_related', top_id, false, 4000 FROM rel),
plan AS (SELECT vec_id AS qid, CASE label % 3 WHEN 0 THEN ['search_regulations', 'search_cases', 'search_related', 'search_cases'] WHEN 1 THEN ['search_cases', 'search_related'] ELSE ['search_regulations'] END AS p FROM embeddings WHERE vec_id % 25 = 0),
steps AS (SELECT qid, unnest(range(len(f))) AS hop, unnest(f) AS tool FROM (SELECT qid, CASE WHEN list_contains(p, 'search_regulations') THEN p ELSE list_concat(['search_regulations'], p) END AS f FROM plan)),
run AS (SELECT s.qid, s.hop, s.tool, c.confident, c.top_id, CASE WHEN s.hop >= 4 THEN 'tool_calls' WHEN coalesce(sum(c.tokens) OVER (PARTITION BY s.qid ORDER BY s.hop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 12000 THEN 'tokens' END AS stop FROM steps s JOIN calls c USING (qid, tool))"""


def _loop(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 25 = 0")
    best = lambda c: answering.best_of(S.knn(q, c, 1, "vec_id", "vec_id"))
    call = lambda c, ok, tokens: best(c).select("qid", ok.alias("confident"), "top_id", F.lit(tokens).alias("tokens"), F.lit(1.0).alias("seconds"))
    tools = {
        "search_regulations": call(e.filter("label < 5"), F.col("score") >= 0.4, 4000),
        "search_cases": call(e.filter("label >= 5"), F.col("score") >= 0.45, 5000),
        "search_related": call(e.filter("label % 3 = 0"), F.lit(False), 4000),
    }
    names = {0: ("search_regulations", "search_cases", "search_related", "search_cases"), 1: ("search_cases", "search_related"), 2: ("search_regulations",)}
    array = lambda k: F.array(*[F.lit(x) for x in names[k]])
    plan = F.when(F.col("label") % 3 == 0, array(0)).when(F.col("label") % 3 == 1, array(1)).otherwise(array(2))
    return answering.tool_loop(q.select(F.col("vec_id").alias("qid"), "label"), tools, plan)


@query(f"{_LOOP} SELECT qid, hop::INTEGER AS hop, tool, confident, top_id, stop FROM run")
def agent_hops(spark: SparkSession, d: str) -> DataFrame:
    """The bounded tool loop, unrolled: every planned call, and which budget cut it off."""
    return _loop(spark, d).select("qid", "hop", "tool", "confident", "top_id", "stop")


@query(f"""{_LOOP} SELECT qid, count(*) FILTER (stop IS NULL) AS calls, coalesce(bool_or(stop IS NULL AND confident), false) AS grounded, arg_max(top_id, hop) FILTER (stop IS NULL AND confident) AS answer_id, arg_min(stop, hop) FILTER (stop IS NOT NULL) AS stop_reason, coalesce(bool_or(stop IS NULL AND confident), false) AS answered FROM run GROUP BY qid""")
def agent_results(spark: SparkSession, d: str) -> DataFrame:
    return answering.loop_results(_loop(spark, d))


@query()
def agent_answers(spark: SparkSession, d: str) -> DataFrame:
    """The loop's questions answered from what its calls found, or refused; usage, sources, verification."""
    e = table(spark, d, "embeddings")
    name = lambda c: F.concat(F.lit("vector "), F.col(c).cast("string"), F.lit(" of label "), F.col("label").cast("string"))
    questions = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("qid"), name("vec_id").alias("question"))
    out = answering.agent_answers(questions, _loop(spark, d), e.select(F.col("vec_id").alias("cid"), name("vec_id").alias("text")))
    return out.select("qid", "calls", "tokens", "seconds", "grounded", "stop_reason", F.size("sources").alias("n_sources"), "answer")


@query()
def search_tool(spark: SparkSession, d: str) -> DataFrame:
    """The tool that searches regulations: the first words of each item call it, the whole item is the original."""
    models = Models()
    calls = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.substring_index("text", " ", 6).alias("query"), F.col("text").alias("original"))
    with Stages(spark, "search-tool") as stages:
        out = answering.search_tool(calls, stages.table(_chunks(spark, d, models), "chunks"), models, "%s: which rules hold?", marks="[.]+", stages=stages)
        return stages.result(out.select("qid", "confident", "top_score", F.size("kept").alias("n_kept"), "drift", "used_retry", "query"))


@query()
def agent_loop(spark: SparkSession, d: str) -> DataFrame:
    """The tool loop hop by hop: user turns ask, documents are the regulations, benchmark items the cases, and the parts of
    one order the articles that stand together. The next tool depends on what the last one found."""
    models = Models()
    turns = table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.lit("食安法").alias("law_name"), (F.col("l_partkey") % 60 + 1).cast("string").alias("article"))
    name = f"loop_edges_{uuid.uuid4().hex[:12]}"
    with Stages(spark, "agent-loop") as stages:
        chunks = stages.table(_chunks(spark, d, models), "chunks")
        items = table(spark, d, "benchmark").select(F.col("item_id").alias("cid"), "text", models.encode(F.col("text")).alias("embedding"))
        items = stages.table(items, "items")
        cocitation.write_edges(edges, name)
        try:
            policy = loop.Policy(
                F.when(F.col("calls") == 0, F.when(F.col("qid") % 5 == 0, "search_violation_cases").when(F.col("qid") % 7 == 0, "search_the_web").otherwise("search_regulations"))
                .when((F.col("last_tool") == "search_regulations") & F.col("last_confident"), F.when(F.col("qid") % 2 == 0, "search_related_laws"))
                .when((F.col("last_tool") == "search_regulations") & ~F.col("last_confident"), F.lit("search_violation_cases")),
                F.when(F.col("last_tool") == "search_regulations", F.coalesce(F.get("last_pieces", F.lit(0))["primary_law"], F.col("question"))).otherwise(F.substring_index("question", " ", 8)),
                F.lit(1500),
            )
            tools = {"search_regulations": loop.regulations(chunks, models, stages, "%s: which rules hold?"), "search_violation_cases": loop.violation_cases(items, models, stages), "search_related_laws": loop.related(name)}
            states, trace = loop.run_loop(turns, tools, policy, stages)
            out = loop.loop_answers(states, trace, models)
            return stages.result(out.select("qid", "calls", "llm_calls", "tokens", "grounded", "stop", F.array_join("tools", ",").alias("tools"), F.size("sources").alias("n_sources"), "answer", F.size("unsupported").alias("n_unsupported")))
        finally:
            cocitation.drop_edges(spark, name)


_VERIFIED = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 120 + 1 AS a, CASE WHEN l_suppkey % 7 = 0 THEN '之一' ELSE '' END AS tail FROM lineitem),
o AS (SELECT l_orderkey AS qid, string_agg('依食安法第' || a || '條' || tail || '辦理。', '' ORDER BY l_linenumber, '依食安法第' || a || '條' || tail || '辦理。') AS answer,
string_agg(CASE l_linenumber % 4 WHEN 1 THEN '規定第' || a || '條' || tail || chr(10) WHEN 3 THEN '另見' || chr(10) || '食安法第' || a || '條' || tail WHEN 0 THEN CASE WHEN tail = '' THEN '第 ' || a || ' 條' ELSE '第' || a || tail || '條' END || chr(10) END, chr(10)) AS hay FROM l GROUP BY 1),
c AS (SELECT qid, min(pos) AS pos, a, tail FROM (SELECT l_orderkey AS qid, l_linenumber AS pos, a, tail FROM l) GROUP BY qid, a, tail),
u AS (SELECT c.qid, list('食安法第' || a || '條' || tail ORDER BY pos, '食安法第' || a || '條' || tail || '辦理。') AS labels FROM c JOIN o USING (qid) WHERE NOT (contains(coalesce(hay, ''), '第' || a || '條' || tail) OR contains(coalesce(hay, ''), '第 ' || a || ' 條' || tail) OR (tail <> '' AND contains(coalesce(hay, ''), '第' || a || tail || '條'))) GROUP BY c.qid),
r AS (SELECT o.qid, answer, coalesce(labels, []) AS labels, array_to_string(list_filter(string_split(answer, '。'), lambda s: len(list_filter(coalesce(labels, []), lambda x: contains(s, x))) = 0), '。') AS better FROM o LEFT JOIN u USING (qid))
SELECT qid, len(labels) > 0 AS regenerated, CASE WHEN len(labels) > 0 AND better <> '' THEN better ELSE answer END AS answer, CASE WHEN len(labels) > 0 AND better = '' THEN array_to_string(labels, ',') ELSE '' END AS unsupported FROM r"""


@query(_VERIFIED)
def citations_verified(spark: SparkSession, d: str) -> DataFrame:
    """Answers that cite an article for each line of an order, and evidence for some of the lines: in its text, spelled in
    several ways, or only as the article it comes from. What nothing supports is written out of the answer."""
    own = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    no, tail = (F.col("l_partkey") % 120 + 1).cast("string"), F.when(F.col("l_suppkey") % 7 == 0, "之一").otherwise("")
    # A line travels as its sentence alone; what its evidence says follows from that and its number.
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), F.struct("l_linenumber", own(no, "條", tail, "辦理。").alias("s")).alias("x"))
    lists = rows.groupBy("qid").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def evidence(x: Column) -> Column:
        line, plain = x["l_linenumber"] % 4, own("第", F.substring_index(x["s"], "辦", 1))
        article = F.substring_index(x["s"], "條", 1)
        spelled = F.when(F.endswith(plain, F.lit("之一")), own("第", article, "之一條")).otherwise(own("第 ", article, " 條"))
        text = F.when(line == 1, own("規定", plain)).when(line == 3, F.lit("另見")).when(line == 0, spelled)
        return F.struct(text.alias("text"), haystack(text, F.when(line == 3, own("食安法", plain))).alias("hay"))

    pieces = F.transform(F.filter("x", lambda x: x["l_linenumber"] % 4 != 2), evidence)
    answer = F.array_join(F.transform("x", lambda x: own("依食安法第", x["s"])), "")
    answers = lists.select("qid", F.lit("").alias("question"), answer.alias("answer"), pieces.alias("pieces"))
    answers = answers.select("qid", "question", "answer", F.col("pieces.text").alias("evidence"), F.col("pieces.hay").alias("haystacks"))
    return answering.verify(answers, Models()).select("qid", "regenerated", "answer", F.array_join("unsupported", ",").alias("unsupported"))


@query(f"""WITH a AS ({_BEST.format(" AND c.label % 2 = 0")}), b AS ({_BEST.format("")})
SELECT a.qid, CASE WHEN b.score >= 0.5 AND a.top_id <> b.top_id THEN true ELSE a.score >= 0.5 END AS confident, CASE WHEN b.score >= 0.5 AND a.top_id <> b.top_id THEN b.top_id ELSE a.top_id END AS top_id, (b.score >= 0.5 AND a.top_id <> b.top_id) AS drift FROM a JOIN b USING (qid)""")
def drift_check(spark: SparkSession, d: str) -> DataFrame:
    """A rewritten query's result gives way to the literal one's where that is confident and finds something else."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 25 = 0")
    one = lambda c: answering.best_of(S.knn(q, c, 1, "vec_id", "vec_id")).select("qid", (F.col("score") >= 0.5).alias("confident"), "top_id")
    return answering.drift_checked(one(e.filter("label % 2 = 0")), one(e))


__all__ = ["_DOT", "agent_answers", "agent_hops", "agent_loop", "agent_results", "citations_verified", "drift_check", "gated_retrieval", "pipeline_query", "review_path", "search_tool"]
