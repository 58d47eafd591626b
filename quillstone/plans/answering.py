"""The question-answering plans over tables of questions: fixed path, review path, tool loop.

A stage that costs (a second search, a regeneration) runs only on the rows that need it. What a search has found is a
stage table, so no later stage searches or encodes again; texts are fetched by the few ids found, never moved. chunks,
rules and cases are stored tables: each search reads their vectors once. Every question has one row at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import citation_label, haystack, unsupported
from ..functions.terms import term_pairs
from ..functions.text import decomposed, keyword_question, split_questions, strip
from ..operators.decisions import Lexicon, any_of, lexicon_scan, over_budget, refused, report_level, verdict, wants_cases, without_verdict
from ..operators.lexicons import CASES as CASE_WORDS
from ..operators.lexicons import REPORT_HIGH, REPORT_MEDIUM
from ..operators.relational import bag_union, first_wins, quota_fill, ranked
from ..operators.similarity import cascade, gate, knn
from ..stages import Stages, stored_bytes
from .models import Models

#: Gate, pool and budgets of a question.
THRESHOLD, POOL, KEEP, CASE_THRESHOLD, CASES = 0.52, 10, 5, 0.58, 3
REFUSE = "The indexed documents do not answer this question."
#: What the generator is told where only cases are reliable, and where a question has several parts.
ONLY_CASES = "No reliable rule was found: answer from the cases above only, and add no rules of your own."
EACH_PART = "The question has several parts. Answer them in order; say of a part without evidence that nothing was found, and answer the others:"
#: Bytes of a stage table that may be sent to all tasks to fetch texts by id; a larger one meets them by a shuffle.
FETCH_BYTES = 32 << 20


def boosted(questions: DataFrame, nouns: DataFrame) -> DataFrame:
    """questions(qid, question), nouns(noun, cid) -> qid, cid: the rows of every noun that a question contains. One walk of
    an automaton over each question finds all its nouns."""
    return term_pairs(questions, nouns, "qid", "question", "noun").join(nouns, "noun").select("qid", "cid").distinct()


def _kept(stages: Stages | None, df: DataFrame, name: str) -> DataFrame:
    return stages.table(df, name) if stages else df


def fetched(found: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of found and, for each, those of table with its cid. What was found is sent to the table while it is small: the
    table, which is the corpus, stays where it is."""
    size = stored_bytes(found)
    return table.join(F.broadcast(found) if size is not None and size <= FETCH_BYTES else found, "cid")


def with_law(chunks: DataFrame) -> DataFrame:
    """cid, chunk, law: the text, and the article it comes from where the table has one (primary_law)."""
    law = F.col("primary_law").cast("string") if "primary_law" in chunks.columns else F.lit(None).cast("string")
    return chunks.select("cid", F.col("text").alias("chunk"), law.alias("law"))


def retrieve(questions: DataFrame, chunks: DataFrame, models: Models, threshold: float = THRESHOLD, pool: int = POOL, keep: int = KEEP, nouns: DataFrame | None = None, stages: Stages | None = None) -> DataFrame:
    """questions(qid, question), chunks(cid, text, embedding) -> qid, confident, top_score, kept: search, the rows that
    `nouns` (noun, cid) adds to the pool, rerank, gate."""
    q = _kept(stages, questions.select("qid", models.encode(F.col("question")).alias("embedding")), "encoded")
    found = knn(q.withColumnRenamed("qid", "vec"), chunks.select(F.col("cid").alias("vec"), "embedding"), pool, "vec", "vec", exclude_self=False).select("qid", "cid")
    if nouns is not None:
        found = bag_union(found, boosted(questions, nouns), ["qid", "cid"])
    pairs = fetched(_kept(stages, found.join(questions.select("qid", "question"), "qid"), "found"), chunks.select("cid", "text"))
    scored = pairs.select("qid", "cid", models.rerank(F.col("question"), F.col("text")).alias("score"))
    return _kept(stages, gate(scored, questions, threshold, keep), "gated")


def retrieve_with_retry(questions: DataFrame, chunks: DataFrame, models: Models, base: Column | None = None, stages: Stages | None = None, **how) -> DataFrame:
    """A rejected question is reformulated once (`base`, if given, is what is reformulated); its second result counts
    only if it is confident."""
    first = retrieve(questions, chunks, models, stages=stages, **how)
    again = questions.join(first.filter("not confident").select("qid"), "qid", "left_semi").withColumn("question", models.rewrite(F.col("question") if base is None else base))
    again = _kept(stages, again, "again")
    return _kept(stages, cascade(first, retrieve(again, chunks, models, stages=stages, **how)), "answered")


def evidence_lists(found: DataFrame, texts: DataFrame) -> DataFrame:
    """found(qid, place, cid), texts of with_law() -> qid, sources, evidence, laws, haystacks: ids, texts and articles in
    order of place, and what citations are looked up in."""
    rows = fetched(found, texts)
    order = F.array_sort(F.collect_list(F.struct("place", "cid", "chunk", "law")))
    lists = rows.groupBy("qid").agg(order.alias("o"))
    return lists.select("qid", F.transform("o", lambda x: x["cid"]).alias("sources"), F.transform("o", lambda x: x["chunk"]).alias("evidence"), F.transform("o", lambda x: x["law"]).alias("laws"), F.transform("o", lambda x: haystack(x["chunk"], x["law"])).alias("haystacks"))


def nearest_cases(questions: DataFrame, cases: DataFrame, models: Models, top: int, threshold: float = CASE_THRESHOLD, stages: Stages | None = None) -> DataFrame:
    """questions(qid, question), cases(cid, text, embedding) -> qid, cases (ids in order), case_texts, case_laws,
    case_haystacks, case_confident: whether the best is near enough; a question without neighbours has no row."""
    q = _kept(stages, questions.select(F.col("qid").alias("vec"), models.encode(F.col("question")).alias("embedding")), "encoded")
    found = knn(q, cases.select(F.col("cid").alias("vec"), "embedding"), top, "vec", "vec", exclude_self=False)
    found = _kept(stages, found.select("qid", "cid", "score", F.col("rank").alias("place")), "cases")
    rows = fetched(found, with_law(cases))
    order = F.array_sort(F.collect_list(F.struct("place", "cid", "chunk", "law")))
    lists = rows.groupBy("qid").agg(order.alias("o"), F.max("score").alias("best"))
    of = lambda c: F.transform("o", lambda x: x[c])
    parts = [of(c).alias(n) for c, n in (("cid", "cases"), ("chunk", "case_texts"), ("law", "case_laws"))]
    return lists.select("qid", *parts, F.transform("o", lambda x: haystack(x["chunk"], x["law"])).alias("case_haystacks"), F.coalesce(F.col("best") >= threshold, F.lit(False)).alias("case_confident"))


def verify(answers: DataFrame, models: Models, sentence: str = REFUSE) -> DataFrame:
    """answers(question, evidence, answer, [haystacks], ...) -> answer, unsupported, regenerated: an answer that cites an
    article that no piece of its evidence has, in its text or as the article it comes from, is written anew once, with the
    labels as feedback; what is still unsupported is reported. Refusals are left alone. Without haystacks the texts
    alone support."""
    where = F.col("haystacks" if "haystacks" in answers.columns else "evidence")
    labels = lambda: F.transform(unsupported(F.col("answer"), where), citation_label)
    none = F.array().cast("array<string>")
    out = answers.withColumn("_refused", refused(F.col("answer"), sentence)).withColumn("_first", F.when(F.col("_refused"), none).otherwise(labels()))
    out = out.withColumn("regenerated", F.size("_first") > 0)
    better = F.nullif(models.regenerate(F.col("question"), F.col("evidence"), F.col("answer"), F.col("_first")), F.lit(""))
    out = out.withColumn("answer", F.when(F.col("regenerated"), F.coalesce(better, F.col("answer"))).otherwise(F.col("answer")))
    return out.withColumn("unsupported", F.when(F.col("regenerated"), labels()).otherwise(none)).drop("_refused", "_first")


def notes_for(subs: Column, confident: Column) -> Column:
    """What the generator is told besides question and evidence; empty for a single question with reliable rules."""
    listed = F.concat_ws("\n", F.lit(EACH_PART), F.array_join(F.transform(subs, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n"))
    return F.concat_ws("\n\n", F.when(~confident, ONLY_CASES), F.when(F.size(subs) >= 2, listed))


def fixed_path(questions: DataFrame, chunks: DataFrame, models: Models = Models(), split: str = "[?？]+", top: int = 8, cases: DataFrame | None = None, case_words: tuple[str, ...] = CASE_WORDS, include_cases: bool = False, **how) -> DataFrame:  # noqa: B008
    """questions(qid, question) -> qid, n_subs, used_llm, confident, used_retry, n_sources, sources, cases, refused, answer,
    unsupported, regenerated, supported.

    Decompose, retrieve for each part with max(3, top // parts) places, merge the confident parts' results (first
    wins); where a part asks for cases, or include_cases is set, the nearest ones; refuse if neither regulations nor cases
    are confident, else generate, verify the citations and write the answer anew once. A qid is distinct and not null;
    a null question has no parts and is refused. The plan is run now, stage by stage.
    """
    with Stages(questions.sparkSession, "fixed-path") as stages:
        parts = stages.table(questions.select("qid", "question", decomposed(F.col("question"), models.split(F.col("question")), split).alias("d")).select("qid", "question", "d.*"), "parts")
        subs = parts.select("qid", F.posexplode("subs").alias("sub", "question")).select(F.concat_ws(":", F.col("qid").cast("string"), F.col("sub").cast("string")).alias("sid"), "qid", "sub", "question")
        subs = stages.table(subs, "subs")
        got = retrieve_with_retry(subs.select(F.col("sid").alias("qid"), "question"), chunks, models, keep=how.pop("keep", max(top, KEEP)), stages=stages, **how).withColumnRenamed("qid", "sid")
        # Every part has its budget; a single question has all places.
        each = subs.join(got, "sid").join(parts.select("qid", F.size("subs").alias("n_subs")), "qid")
        budget = F.when(F.col("confident"), F.greatest(F.lit(3), F.floor(F.lit(top) / F.col("n_subs")).cast("int"))).otherwise(0)
        order = F.array_sort(F.collect_list(F.struct("sub", F.slice("kept", F.lit(1), budget).alias("ids"))))
        merged = each.groupBy("qid").agg(F.array_distinct(F.flatten(F.transform(order, lambda x: x["ids"]))).alias("ids"), F.bool_or("confident").alias("confident"), F.bool_or("used_retry").alias("used_retry"))
        merged = stages.table(merged, "merged")
        evidence = evidence_lists(stages.table(merged.select("qid", F.posexplode("ids").alias("place", "cid")), "sources"), with_law(chunks))
        out = parts.join(merged.drop("ids"), "qid", "left").fillna(False, ["confident", "used_retry"]).join(evidence, "qid", "left")
        kind = dict(out.dtypes)["sources"]
        if cases is None:
            out = out.select("*", F.array().cast(kind).alias("cases"), F.array().cast("array<string>").alias("case_texts"), F.array().cast("array<string>").alias("case_haystacks"), F.lit(False).alias("case_confident"))
        else:
            wanted = F.lit(include_cases) | F.exists("subs", lambda s: wants_cases(s, case_words))
            near = nearest_cases(parts.filter(wanted).select("qid", "question"), cases, models, CASES, stages=stages)
            out = out.join(near, "qid", "left").withColumn("case_confident", F.coalesce("case_confident", F.lit(False)))
        empty = F.array().cast("array<string>")
        sure = F.col("case_confident")
        both = lambda a, b: F.concat(F.coalesce(a, empty), F.when(sure, F.col(b)).otherwise(empty))
        out = out.withColumn("evidence", both("evidence", "case_texts")).withColumn("haystacks", both("haystacks", "case_haystacks"))
        none = (~F.col("confident") | F.col("sources").isNull()) & ~sure
        answer = F.when(none, REFUSE).otherwise(models.generate(F.col("question"), F.col("evidence"), notes_for(F.col("subs"), F.col("confident"))))
        # Generated once: what verifies and rewrites reads the answer from a table.
        out = verify(stages.table(out.withColumn("answer", answer), "generated"), models)
        return stages.result(out.select(
            "qid", F.size("subs").alias("n_subs"), "used_llm", "confident", "used_retry", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"), F.coalesce("sources", F.array().cast(kind)).alias("sources"),
            F.when(sure, F.col("cases")).otherwise(F.array().cast(dict(out.dtypes)["cases"])).alias("cases"), refused(F.col("answer"), REFUSE).alias("refused"), "answer", "unsupported", "regenerated", (F.size("unsupported") == 0).alias("supported"),
        ))


def review_path(texts: DataFrame, rules: DataFrame, lexicon: Lexicon, models: Models = Models(), guaranteed: Column | None = None, top: int = 5, cases: DataFrame | None = None, white: tuple[str, ...] = ()) -> DataFrame:  # noqa: B008
    """texts(qid, question), rules(cid, text, embedding, [primary_law]) -> qid, matched, sources, cases, answer,
    unsupported, regenerated, level.

    Lexicon scan; the nearest of the guaranteed rules (a search of their own, so that they are found wherever they
    rank among all), then the nearest others up to `top`; the nearest cases; a report, its verification by the rules
    found, the verdict, which is no part of the answer. The plan is run now, stage by stage.
    """
    with Stages(texts.sparkSession, "review-path") as stages:
        q = stages.table(texts.select(F.col("qid").alias("vec"), models.encode(F.col("question")).alias("embedding")), "encoded")
        search = lambda df: knn(q, df.select(F.col("cid").alias("vec"), "embedding"), top, "vec", "vec", exclude_self=False)
        sure = guaranteed if guaranteed is not None else F.lit(False)
        first, others = search(rules.filter(sure)).withColumn("_sure", F.lit(True)), search(rules).withColumn("_sure", F.lit(False))
        both = stages.table(first.unionByName(others).groupBy("qid", "cid").agg(F.bool_or("_sure").alias("_sure"), F.max("score").alias("score")), "found")
        filled = stages.table(quota_fill(both, ["qid"], F.col("_sure"), F.col("score"), top, ["cid"]).select("qid", "place", "cid"), "filled")
        out = texts.withColumn("matched", lexicon_scan(F.col("question"), lexicon)).join(evidence_lists(filled, with_law(rules)), "qid", "left")
        if cases is None:
            out = out.withColumn("cases", F.array().cast("array<bigint>"))
        else:
            out = out.join(nearest_cases(texts, cases, models, top, stages=stages).select("qid", "cases"), "qid", "left")
        hits = reduce(lambda a, b: a + b, [F.size(F.col("matched")[c]) for c in lexicon.terms])
        level = F.when(hits >= 3, "high").when(hits >= 1, "medium").otherwise("low")
        report = F.concat(models.generate(F.col("question"), F.coalesce("evidence", F.array().cast("array<string>")), F.lit("")), F.lit("\n\nVERDICT: "), level)
        out = verify(stages.table(out.withColumn("answer", report), "generated"), models)
        level = verdict(F.col("matched"), lexicon, report_level(F.col("answer"), REPORT_HIGH, REPORT_MEDIUM), any_of(F.col("question"), white))
        return stages.result(out.select("qid", "matched", "sources", "cases", without_verdict(F.col("answer")).alias("answer"), "unsupported", "regenerated", level.alias("level")))


def search_tool(calls: DataFrame, chunks: DataFrame, models: Models, shell: str, drift: bool = True, retry: bool = True, marks: str = "[?？]+", stages: Stages | None = None, **how) -> DataFrame:
    """calls(qid, query, original) -> qid, confident, top_score, kept, drift, used_retry, query: the tool that searches
    regulations.

    Keywords become a question. Where the original question's own search is confident and finds another best row, that
    result takes over. A result that is still not confident is searched once more by a reformulation: of the original
    question, or of the call's own where the original is several questions.
    """
    asked = _kept(stages, calls.withColumn("question", keyword_question(F.col("query"), shell)), "calls")
    first = retrieve(asked.select("qid", "question"), chunks, models, stages=stages, **how)
    best = lambda df: df.withColumn("top_id", F.get("kept", F.lit(0)))
    out = best(first).withColumn("drift", F.lit(False))
    if drift:
        differ = asked.filter(F.col("original").isNotNull() & (strip(F.col("question")) != strip(F.col("original"))))
        literal = best(retrieve(differ.select("qid", F.col("original").alias("question")), chunks, models, stages=stages, **how))
        other = literal.filter("confident").select("qid", *[F.col(c).alias(f"_{c}") for c in ("confident", "top_score", "kept", "top_id")])
        j = out.drop("drift").join(other, "qid", "left").withColumn("drift", F.coalesce(F.col("_confident") & ~F.col("_top_id").eqNullSafe(F.col("top_id")), F.lit(False)))
        out = j.select("qid", *[F.when(F.col("drift"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("confident", "top_score", "kept")], "drift")
    out = out.select("qid", "confident", "top_score", "kept", "drift")
    if retry:
        base = F.when(F.col("original").isNull() | (F.size(split_questions(F.col("original"), marks)) >= 2), F.col("question")).otherwise(F.col("original"))
        again = asked.join(out.filter("not confident").select("qid"), "qid", "left_semi").select("qid", models.rewrite(base).alias("question"))
        second = retrieve(_kept(stages, again, "again"), chunks, models, stages=stages, **how)
        marked = out.select("qid", "drift")
        out = cascade(out.drop("drift"), second).drop("attempts").join(marked, "qid")
    else:
        out = out.withColumn("used_retry", F.lit(False))
    return out.join(asked.select("qid", F.col("question").alias("query")), "qid")


def tool_loop(questions: DataFrame, tools: dict[str, DataFrame], plan: Column, most_calls: int = 4, most_tokens: int = 12_000, most_seconds: float = 90.0) -> DataFrame:
    """questions(qid), tools name -> (qid, confident, top_id, tokens, seconds), plan: each question's tools in order
    (array of names) -> one row for each call that was made: qid, hop, tool, confident, top_id, stop, tokens, seconds, error.

    A tool that does not exist is a call with an error, which costs its place and nothing else.
    The loop is unrolled: every call a plan could make is a row, running sums cut the calls that come after a used-up
    budget, and stop says which budget that was. A search of regulations is forced at the head of a plan without it.
    """
    steps = questions.select("qid", plan.alias("plan"))
    forced = F.when(F.array_contains("plan", "search_regulations"), F.col("plan")).otherwise(F.concat(F.array(F.lit("search_regulations")), F.col("plan")))
    steps = steps.select("qid", F.posexplode(forced).alias("hop", "tool"))
    calls = reduce(DataFrame.unionByName, [df.select("qid", "confident", "top_id", "tokens", "seconds").withColumn("tool", F.lit(name)) for name, df in tools.items()])
    rows = steps.join(calls, ["qid", "tool"], "left").fillna({"tokens": 0, "seconds": 0.0, "confident": False})
    before = Window.partitionBy("qid").orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)
    spent = [F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("tokens", "seconds")]
    rows = rows.withColumn("stop", over_budget(F.col("hop"), spent[0], spent[1], most_calls, most_tokens, most_seconds))
    error = F.when(~F.col("tool").isin(*tools), F.concat(F.lit("unknown tool: "), F.col("tool")))
    return rows.select("qid", "hop", "tool", "confident", "top_id", "stop", "tokens", "seconds", error.alias("error"))


def loop_evidence(calls: DataFrame, also: tuple[str, ...] = ("search_related",)) -> DataFrame:
    """qid, place, cid: what the calls that were made and confident found, and those of the tools in `also`, which are
    never confident and supply evidence all the same; each row once, in the order of the calls."""
    made = calls.filter(F.col("stop").isNull() & (F.col("confident") | F.col("tool").isin(*also)) & F.col("top_id").isNotNull())
    return first_wins(made.select("qid", F.col("hop").alias("place"), F.col("top_id").alias("cid")), ["qid"], "cid", ["place"])


def agent_answers(questions: DataFrame, calls: DataFrame, chunks: DataFrame, models: Models = Models()) -> DataFrame:  # noqa: B008
    """questions(qid, question), calls of tool_loop(), chunks(cid, text, [primary_law]) -> qid, calls, tokens, seconds (of
    the calls that were made), grounded, stop_reason, sources, answer, unsupported, regenerated: a question that no call
    grounds is refused; the others' evidence is fetched again in order, an answer is generated and verified."""
    made = F.col("stop").isNull()
    usage = calls.groupBy("qid").agg(F.coalesce(F.sum(F.when(made, F.col("tokens"))), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum(F.when(made, F.col("seconds"))), F.lit(0.0)), 3).alias("seconds"))
    evidence = evidence_lists(loop_evidence(calls), with_law(chunks))
    out = questions.join(loop_results(calls), "qid").join(usage, "qid").join(evidence, "qid", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumn("evidence", F.coalesce("evidence", empty)).withColumn("haystacks", F.coalesce("haystacks", empty))
    out = out.withColumn("answer", F.when(F.col("grounded"), models.generate(F.col("question"), F.col("evidence"), F.lit(""))).otherwise(REFUSE))
    return verify(out, models).select("qid", "calls", "tokens", "seconds", "grounded", "stop_reason", F.when(F.col("grounded"), F.col("sources")).alias("sources"), "answer", "unsupported", "regenerated")


def loop_results(calls: DataFrame) -> DataFrame:
    """qid, calls, grounded, answer_id (of the last confident call), stop_reason (the first budget hit), answered."""
    made = F.col("stop").isNull()
    return calls.groupBy("qid").agg(
        F.count_if(made).alias("calls"), F.coalesce(F.bool_or(made & F.col("confident")), F.lit(False)).alias("grounded"),
        F.max_by(F.when(made & F.col("confident"), F.col("top_id")), F.when(made & F.col("confident"), F.col("hop"))).alias("answer_id"),
        F.min_by("stop", F.when(~made, F.col("hop"))).alias("stop_reason"),
    ).withColumn("answered", F.col("grounded"))


def drift_checked(rewritten: DataFrame, literal: DataFrame) -> DataFrame:
    """Both (qid, confident, top_id): the literal query's result takes over only if it is confident and its best row is
    another one. + drift."""
    b = literal.select("qid", F.col("confident").alias("_c"), F.col("top_id").alias("_t"))
    drift = F.coalesce(F.col("_c") & ~F.col("_t").eqNullSafe(F.col("top_id")), F.lit(False))
    return rewritten.join(b, "qid", "left").select("qid", F.when(drift, F.col("_c")).otherwise(F.col("confident")).alias("confident"), F.when(drift, F.col("_t")).otherwise(F.col("top_id")).alias("top_id"), drift.alias("drift"))


def best_of(pool: DataFrame) -> DataFrame:
    """(qid, cid, score) -> qid, top_id, score."""
    return ranked(pool, ["qid"], F.col("score"), ["cid"], "_p").filter("_p = 1").select("qid", F.col("cid").alias("top_id"), "score")
