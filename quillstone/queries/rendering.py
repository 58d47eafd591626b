"""Prompts, templates, replies, part checks, question generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rendering as G
from ..functions import stats
from ..operators.relational import quota_sample
from ..operators.similarity import knn
from ..plans.models import Models
from ..plans.questions import question_set, sampled_chunks
from ..session import table
from ..stages import Stages
from .registry import query


@query("""SELECT o_custkey, string_agg('[' || i || '] ' || line, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS prompt FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority || ': ' || format('{:,}', o_orderkey) AS line FROM orders) GROUP BY 1""")
def prompt_rendering(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat("o_orderpriority", F.lit(": "), G.money(F.col("o_orderkey")))
    return G.prompt_rows(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], line)


@query("""SELECT c_custkey, 'Dear ' || c_name || ', segment ' || coalesce(c_mktsegment, '') || '.' AS letter FROM customer""")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", G.filled("Dear {name}, segment {segment}.", name=F.col("c_name"), segment=F.col("c_mktsegment")).alias("letter"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(upper(text), '[ABCDX]') THEN regexp_extract(upper(text), '([ABCDX])', 1) ELSE 'X' END AS letter FROM conversations""")
def answer_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", G.answer_letter(F.col("text")).alias("letter"))


@query("""SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type || '? / ' || user_id || '?' END AS asked FROM events""")
def json_question_list(spark: SparkSession, d: str) -> DataFrame:
    """A reply that is a list of questions; anything else is null."""
    reply = F.when(F.col("event_type") != "click", F.to_json(F.array("event_type", F.lit(" "), F.concat(F.col("user_id").cast("string"), F.lit("?"))))).otherwise("no list")
    return table(spark, d, "events").select("event_id", F.array_join(G.listed_questions(reply), " / ").alias("asked"))


@query("""SELECT doc_id, (contains(text, 'idiot') OR contains(text, 'License')) OR (lang = 'en' AND regexp_matches(text, '[0-9]{3}') AND regexp_matches(text, '@')) OR (lang = 'de' AND regexp_matches(text, 'nicht')) AS ok FROM documents""")
def part_check(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents")
    return x.select("doc_id", G.part_ok(F.col("text"), F.array(F.lit("idiot"), F.lit("License")), F.col("lang") == "en", F.col("lang") == "de", "[0-9]{3}", "@", "nicht").alias("ok"))


@query("""SELECT toxic, printf('%.3f [%.3f, %.3f]', avg(quality), min(quality)::DOUBLE, max(quality)::DOUBLE) AS text FROM labels GROUP BY toxic""")
def interval_format(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "labels").groupBy("toxic").agg(F.avg("quality").alias("m"), F.min("quality").cast("double").alias("lo"), F.max("quality").cast("double").alias("hi"))
    return a.select("toxic", stats.interval_text(F.col("m"), F.col("lo"), F.col("hi")).alias("text"))


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings), s AS (SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('3|' || vec_id), vec_id) AS p FROM e) WHERE p <= 4),
n AS (SELECT q.vec_id FROM s JOIN e q USING (vec_id) JOIN e c ON c.vec_id <> q.vec_id AND round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 5) >= 0.6)
SELECT vec_id, label, vec_id NOT IN (SELECT vec_id FROM n) AS fresh FROM s""")
def question_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Rows to make questions of: a quota for each kind in a seeded order, those with a near duplicate marked."""
    e = table(spark, d, "embeddings")
    s = quota_sample(e, "label", "vec_id", 4, 3)
    near = knn(s, e, 1, "vec_id", "vec_id").filter("score >= 0.6").select(F.col("qid").alias("vec_id"), F.lit(True).alias("_near"))
    return s.join(near, "vec_id", "left").select("vec_id", "label", F.col("_near").isNull().alias("fresh"))


@query("""SELECT conv_id, count(*) AS steps, count(*) FILTER (role = 'assistant') AS calls, sum(length(text))::BIGINT AS tokens, bool_or(contains(text, 'ing')) AS grep_hit FROM conversations GROUP BY conv_id""")
def trace_usage(spark: SparkSession, d: str) -> DataFrame:
    """Usage added up over a question's trace, and whether a pattern is in it."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("role") == "assistant").alias("calls"), F.sum(F.length("text")).alias("tokens"), F.bool_or(F.contains("text", F.lit("ing"))).alias("grep_hit"))


@query("""SELECT a.vec_id AS qid, a.rank AS before, b.rank AS after, b.rank < a.rank AS better FROM (SELECT vec_id, (vec_id * 7 % 10)::INTEGER AS rank FROM embeddings) a JOIN (SELECT vec_id, (vec_id * 3 % 10)::INTEGER AS rank FROM embeddings) b USING (vec_id)""")
def paired_systems(spark: SparkSession, d: str) -> DataFrame:
    """Two systems' results paired by question."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"))
    a = e.withColumn("before", (F.col("qid") * 7 % 10).cast("int"))
    b = e.withColumn("after", (F.col("qid") * 3 % 10).cast("int"))
    return a.join(b, "qid").select("qid", "before", "after", (F.col("after") < F.col("before")).alias("better"))


@query("""SELECT count(*) AS n, count(*) FILTER (f) AS full_hit, count(*) FILTER (NOT f) AS missed FROM (SELECT o_orderkey, bool_or(list_contains([1, 2, 3, 5, 8], l_suppkey)) AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def gold_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Sets of found laws against gold ones: hit where they overlap."""
    found = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("found"))
    hit = F.arrays_overlap("found", F.array(*[F.lit(x).cast("long") for x in (1, 2, 3, 5, 8)]))
    j = table(spark, d, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey")).select(hit.alias("f"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if("f").alias("full_hit"), F.count_if(~F.col("f")).alias("missed"))


@query()
def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    """A question set: turns of each role without near duplicates, a stand-in that asks by a turn's first words, and by its
    last ones when it is asked again."""
    models = Models()
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("cid"), F.col("role").alias("kind"), "text", models.encode(F.col("text")).alias("embedding"))
    ask = lambda text, attempt: F.when(attempt == 1, F.concat(F.substring(text, 1, 30), F.lit("?"))).otherwise(F.concat(F.lit("What of "), F.reverse(F.substring(F.reverse(text), 1, 10)), F.lit("?")))
    with Stages(spark, "questions") as stages:
        chunks = stages.table(c, "chunks")
        picked = sampled_chunks(chunks, {"user": 60, "assistant": 40}, stages, lengths=(20, 2000))
        return stages.result(question_set(picked, ask, stages))
