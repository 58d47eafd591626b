"""Routing, verdicts, refusals, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import decisions as D
from ..operators import lexicons as X
from ..session import table
from .registry import query

#: The router's cues for the tables' turns: words of their invented language in the roles of the real ones.
CUES = D.Cues(case=("her", "thon"), amount_only="", amount="", penalty=("sh ",), rule=("ing", "que"), weak=("the",), related=("ttr",), review=("Please",), split="[.]+", asks=(",",))
_HAS = "({})".format
_any = lambda ws, t="x": _HAS(" OR ".join(f"contains({t}, '{w}')" for w in ws)) if ws else "false"
_ROUTE = f"""SELECT conv_id, turn, role, CASE WHEN {_any(CUES.related)} THEN 'multi_hop' WHEN {_any(CUES.case)} AND {_any(CUES.rule)} THEN 'multi_hop' WHEN {_any(CUES.review)} THEN 'ad_review'
WHEN len(p) >= 2 THEN CASE WHEN len(list_filter(p, lambda s: NOT (NOT {_any((*CUES.case, *CUES.penalty, *CUES.related), "s")} AND {_any((*CUES.rule, *CUES.weak), "s")}))) = 0 THEN 'regulation_qa' END
WHEN {_any(CUES.case)} OR {_any(CUES.penalty)} THEN NULL WHEN ({_any(CUES.rule)} OR {_any(CUES.weak)}) AND {_any(CUES.asks)} THEN 'regulation_qa' END AS rule
FROM (SELECT conv_id, turn, role, x, list_transform(list_filter(list_transform(regexp_split_to_array(x, '[.]+'), lambda y: trim(y, ' ' || chr(9) || chr(13) || chr(10) || ',，;；、。')), lambda y: length(y) >= 2), lambda y: y || '?') AS p FROM (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM conversations))"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with its route; a stand-in model answers by the turn's number, sometimes outside the list."""
    c = table(spark, d, "conversations")
    model = F.element_at(F.array(F.lit("case_lookup"), F.lit("nonsense"), F.lit("multi_hop")), (F.col("turn") % 3 + 1).cast("int"))
    return c.select("conv_id", "turn", "role", D.routed(F.col("text"), model, CUES).alias("r")).select("conv_id", "turn", "role", "r.*")


_ROUTED = f"""SELECT conv_id, turn, role, coalesce(rule, CASE turn % 3 WHEN 0 THEN 'case_lookup' WHEN 2 THEN 'multi_hop' END, 'regulation_qa') AS intent, CASE WHEN rule IS NOT NULL THEN 'rules' WHEN turn % 3 <> 1 THEN 'llm' ELSE 'fallback' END AS source FROM ({_ROUTE})"""


@query(_ROUTED.replace("role, coalesce", "coalesce"))
def route_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules, else the model if its answer is of the list, else the default."""
    return _turns(spark, d).select("conv_id", "turn", "intent", "source")


_GOLD = "CASE role WHEN 'user' THEN 'regulation_qa' WHEN 'assistant' THEN 'multi_hop' ELSE 'case_lookup' END"


@query(f"""SELECT gold, count(*) FILTER (intent = 'regulation_qa') AS regulation_qa, count(*) FILTER (intent = 'case_lookup') AS case_lookup, count(*) FILTER (intent = 'ad_review') AS ad_review, count(*) FILTER (intent = 'multi_hop') AS multi_hop, count(*) AS n, round(avg(CASE WHEN gold = intent THEN 1.0 ELSE 0.0 END), 6) AS recall
FROM (SELECT {_GOLD} AS gold, intent FROM ({_ROUTED})) GROUP BY gold""")
def route_confusion(spark: SparkSession, d: str) -> DataFrame:
    gold = F.when(F.col("role") == "user", "regulation_qa").when(F.col("role") == "assistant", "multi_hop").otherwise("case_lookup")
    m = stats.confusion(_turns(spark, d).withColumn("gold", gold), "gold", "intent", ["regulation_qa", "case_lookup", "ad_review", "multi_hop"])
    return m.withColumn("recall", F.round("recall", 6))


@query(f"""SELECT source, count(*) AS n, round(avg(CASE WHEN gold = intent THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (gold = 'multi_hop' AND intent <> 'multi_hop') AS harmful, count(*) FILTER (gold <> 'multi_hop' AND intent = 'multi_hop') AS wasteful, count(*) FILTER (gold <> intent AND gold <> 'multi_hop' AND intent <> 'multi_hop') AS others FROM (SELECT {_GOLD} AS gold, intent, source FROM ({_ROUTED})) GROUP BY source""")
def route_source_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and accuracy of each source; errors that lose evidence, those that only cost time, and the others."""
    gold = F.when(F.col("role") == "user", "regulation_qa").when(F.col("role") == "assistant", "multi_hop").otherwise("case_lookup")
    t = _turns(spark, d).withColumn("gold", gold)
    multi = lambda c: F.col(c) == "multi_hop"
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("gold") == F.col("intent"), 1.0).otherwise(0.0)), 6).alias("accuracy"), F.count_if(multi("gold") & ~multi("intent")).alias("harmful"), F.count_if(~multi("gold") & multi("intent")).alias("wasteful"), F.count_if((F.col("gold") != F.col("intent")) & ~multi("gold") & ~multi("intent")).alias("others"))


#: Questions in the domain's words, and near misses of its cues; two of them make a compound one.
_ASKED = (
    "膠囊食品要怎麼標示?", "這樣算不算誇大?", "有人被罰過嗎?", "被罰多少錢?", "沒標示會罰多少?", "食安法第28條常跟哪些條文一起被引用?", "幫我看這段文案",
    "益生菌違反哪條?", "今天天氣很好", "添加上限是多少?", "最近的案例有哪些?", "請審稿:本產品三天見效", "需要登錄嗎？", "可以嗎", "規定的單位", "罰鍰多少才合法?", "開罰單位是誰", "關聯不大的問題呢?", "案子例外嗎?", "什麼是防腐劑?",
)
_OWN = D.Cues()
_PLAIN = tuple(w for w in _OWN.case if w != _OWN.amount_only)
_CASE = f"({_any(_PLAIN)} OR ({_any((_OWN.amount_only,))} AND NOT regexp_matches(x, '{_OWN.amount}')))"


@query(f"""SELECT o_orderkey, CASE WHEN {_any(_OWN.related)} THEN 'multi_hop' WHEN {_CASE} AND {_any(_OWN.rule)} THEN 'multi_hop' WHEN {_any(_OWN.review)} THEN 'ad_review'
WHEN len(p) >= 2 THEN CASE WHEN len(list_filter(p, lambda s: {_any((*_OWN.case, *_OWN.penalty, *_OWN.related), "s")} OR NOT {_any((*_OWN.rule, *_OWN.weak), "s")})) = 0 THEN 'regulation_qa' END
WHEN {_CASE} OR {_any(_OWN.penalty)} THEN NULL WHEN ({_any(_OWN.rule)} OR {_any(_OWN.weak)}) AND {_any(_OWN.asks)} THEN 'regulation_qa' END AS intent
FROM (SELECT o_orderkey, x, list_transform(list_filter(list_transform(regexp_split_to_array(x, '[?？]+'), lambda y: trim(y, ' ' || chr(9) || chr(13) || chr(10) || ',，;；、。')), lambda y: length(y) >= 2), lambda y: y || '?') AS p
FROM (SELECT o_orderkey, {"[" + ", ".join(f"'{w}'" for w in _ASKED) + "]"}[o_orderkey % {len(_ASKED)} + 1] || CASE WHEN o_custkey % 3 = 0 THEN {"[" + ", ".join(f"'{w}'" for w in _ASKED) + "]"}[o_custkey % {len(_ASKED)} + 1] ELSE '' END AS x FROM orders))""")
def route_domain(spark: SparkSession, d: str) -> DataFrame:
    """The rules on the domain's own cues: single and compound questions, near misses among them."""
    pick = lambda i: F.element_at(F.array(*[F.lit(w) for w in _ASKED]), (i % len(_ASKED) + 1).cast("int"))
    asked = F.concat(pick(F.col("o_orderkey")), F.when(F.col("o_custkey") % 3 == 0, pick(F.col("o_custkey"))).otherwise(""))
    return table(spark, d, "orders").select("o_orderkey", D.route(asked).alias("intent"))


LEXICON = D.Lexicon({"grave": ("idiot", "scum"), "mild": ("token", "License"), "white": ("gentle",)}, {"grave": 2, "mild": 1, "white": 0})


@query("""SELECT doc_id, array_to_string(list_filter(['idiot', 'scum'], lambda t: contains(text, t)), ',') AS grave, array_to_string(list_filter(['token', 'License'], lambda t: contains(text, t)), ',') AS mild,
CASE WHEN contains(text, 'idiot') OR contains(text, 'scum') THEN 'high' WHEN contains(text, 'token') OR contains(text, 'License') THEN 'medium' WHEN n_chars > 5000 AND NOT lang = 'fr' THEN 'medium' ELSE 'low' END AS level FROM documents""")
def risk_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The higher of lexicon level and report level; the white list only lowers what no keyword raised."""
    x = table(spark, d, "documents").withColumn("m", D.lexicon_scan(F.col("text"), LEXICON))
    report = F.when(F.col("n_chars") > 5000, "VERDICT：**Medium**").otherwise("no verdict")
    return x.select("doc_id", *[F.array_join(f"m.{c}", ",").alias(c) for c in ("grave", "mild")], D.verdict(F.col("m"), LEXICON, D.verdict_line(report), F.col("lang") == "fr").alias("level"))


@query("""SELECT doc_id, CASE WHEN (contains(text, 'of') OR contains(text, 'was')) AND NOT contains(text, 'License') THEN 'law-28' END AS law FROM documents""")
def filter_inference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", D.inferred_filter(F.col("text"), ("of",), ("was",), ("License",), "law-28").alias("law"))


@query("""SELECT conv_id, turn, coalesce(x = 'not sure about it' OR starts_with(x, 'not sure about') OR (len(p) > 0 AND len(list_filter(p, lambda s: NOT (contains(s, 'he') OR contains(s, 'qu')))) = 0), false) AS refused
FROM (SELECT conv_id, turn, x, list_filter(list_transform(regexp_split_to_array(x, '[.\\n]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS p FROM (SELECT conv_id, turn, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM conversations))""")
def refusal_flag(spark: SparkSession, d: str) -> DataFrame:
    """A refusal has a cue in every sentence; a partial answer does not."""
    return table(spark, d, "conversations").select("conv_id", "turn", D.refused(F.col("text"), "not sure about it", ("he", "qu"), "[.\n]").alias("refused"))


@query("""SELECT user_id, CASE WHEN n >= 12 THEN 'tool_calls' WHEN v >= 600 THEN 'tokens' WHEN m >= 99 THEN 'seconds' END AS stop FROM (SELECT user_id, count(*) AS n, sum(value) AS v, max(value) AS m FROM events GROUP BY user_id)""")
def budget_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The first budget that is used up."""
    u = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.max("value").alias("m"))
    return u.select("user_id", D.over_budget(F.col("n"), F.col("v"), F.col("m"), 12, 600, 99.0).alias("stop"))


_TERMS = [t for words in X.RISK.terms.values() for t in words]
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_COUNT = lambda words, x="x": f"len(list_filter({_LIST(dict.fromkeys(words))}, lambda t: contains({x}, t)))"
_BY_WORDS = f"greatest({', '.join(f'CASE WHEN {_COUNT(X.RISK.terms[c])} > 0 THEN {n} ELSE 0 END' for c, n in X.RISK.level.items())})"
_BY_REPORT = f"CASE WHEN contains(report, 'VERDICT') THEN 0 WHEN {_COUNT(X.REPORT_HIGH, 'report')} > 0 THEN 2 WHEN {_COUNT(X.REPORT_MEDIUM, 'report')} > 0 THEN 1 ELSE 0 END"


@query(f"""SELECT o_orderkey, {", ".join(f"{_COUNT(w)}::INTEGER AS {c}" for c, w in X.RISK.terms.items())}, ['low', 'medium', 'high'][CASE WHEN b = 1 AND {_COUNT(_TERMS)} = 0 AND {_COUNT(X.ALLOWED)} > 0 THEN 0 ELSE b END + 1] AS level
FROM (SELECT *, greatest({_BY_WORDS}, {_BY_REPORT}) AS b FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '本品' ELSE '本品可' || {_LIST(_TERMS)}[o_custkey % {len(_TERMS)} + 1] END || '，' || {_LIST(X.ALLOWED)}[o_orderkey % {len(X.ALLOWED)} + 1] AS x,
CASE o_orderkey % 5 WHEN 0 THEN '此文案易生誤解' WHEN 1 THEN '涉及醫療效能' WHEN 2 THEN 'VERDICT: 合規，但違反' ELSE '尚可' END AS report FROM orders))""")
def domain_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The domain's own lexicon, white list and report words on advertisements made of them."""
    o = table(spark, d, "orders")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
    x = F.concat(F.when(F.col("o_orderkey") % 4 == 0, "本品").otherwise(F.concat(F.lit("本品可"), pick(_TERMS, F.col("o_custkey")))), F.lit("，"), pick(X.ALLOWED, F.col("o_orderkey")))
    report = pick(("此文案易生誤解", "涉及醫療效能", "VERDICT: 合規，但違反", "尚可", "尚可"), F.col("o_orderkey"))
    t = o.select("o_orderkey", x.alias("x"), report.alias("report")).withColumn("m", D.lexicon_scan(F.col("x"), X.RISK))
    level = D.verdict(F.col("m"), X.RISK, D.report_level(F.col("report"), X.REPORT_HIGH, X.REPORT_MEDIUM), D.any_of(F.col("x"), X.ALLOWED))
    return t.select("o_orderkey", *[F.size(f"m.{c}").alias(c) for c in X.RISK.terms], level.alias("level"))


@query(f"""SELECT o_orderkey, CASE WHEN ({_COUNT(X.ADVERTISING)} > 0 OR {_COUNT(X.CLAIMS)} > 0) AND {_COUNT(X.LABELS)} = 0 THEN '{X.ADVERTISING_LAW}' END AS law, {_COUNT(X.CASES)} > 0 AS cases, {_COUNT(X.EXAM)} > 0 AS exam
FROM (SELECT o_orderkey, {_LIST((*X.ADVERTISING, *X.CLAIMS, *X.LABELS, *X.CASES, "問題"))}[o_custkey % {len(X.ADVERTISING) + len(X.CLAIMS) + len(X.LABELS) + len(X.CASES) + 1} + 1] || '怎麼' || {_LIST((*X.CASES, "辦", "寫"))}[o_orderkey % {len(X.CASES) + 2} + 1] || '?' AS x FROM orders)""")
def domain_questions(spark: SparkSession, d: str) -> DataFrame:
    """The law a question implies, whether it asks for cases, and whether it is about the rules: by the domain's lists."""
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
    x = F.concat(pick((*X.ADVERTISING, *X.CLAIMS, *X.LABELS, *X.CASES, "問題"), F.col("o_custkey")), F.lit("怎麼"), pick((*X.CASES, "辦", "寫"), F.col("o_orderkey")), F.lit("?"))
    t = table(spark, d, "orders").select("o_orderkey", x.alias("x"))
    return t.select("o_orderkey", D.inferred_filter(F.col("x"), X.ADVERTISING, X.CLAIMS, X.LABELS, X.ADVERTISING_LAW).alias("law"), D.wants_cases(F.col("x"), X.CASES).alias("cases"), D.any_of(F.col("x"), X.EXAM).alias("exam"))
