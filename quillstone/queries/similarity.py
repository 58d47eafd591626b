"""Vector search, gates, cascades, n-gram joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import term_pairs
from ..operators import cocitation as C
from ..operators import relational as R
from ..operators import similarity as S
from ..operators import vectors as V
from ..plans.answering import boosted
from ..session import table
from ..stages import Stages
from .registry import query

_DOT = "round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 5)"
_TOP = f"""SELECT q.vec_id AS qid, c.vec_id AS cid, {_DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, c.vec_id)::INTEGER AS rank
FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id"""


def _queries(spark: SparkSession, d: str, every: int = 25) -> tuple[DataFrame, DataFrame]:
    """A stated set of queries: every 25th vector, against all vectors."""
    e = table(spark, d, "embeddings")
    return e.filter(F.col("vec_id") % every == 0), e


@query(f"SELECT * FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank <= 10")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    q, e = _queries(spark, d)
    return S.knn(q, e, 10, "vec_id", "vec_id")


@query(f"SELECT * FROM ({_TOP} WHERE q.vec_id % 25 = 0 AND c.label IN (1, 3, 5)) WHERE rank <= 5")
def knn_prefiltered(spark: SparkSession, d: str) -> DataFrame:
    """The filter runs before the search, never after it."""
    q, e = _queries(spark, d)
    return S.knn(q, e.filter(F.col("label").isin(1, 3, 5)), 5, "vec_id", "vec_id")


@query(f"SELECT qid, count(*) AS n, max(score) AS best FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank <= 3 AND score >= 0.4 GROUP BY qid")
def near_dup_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Probes with another neighbour among the top three at or above the threshold."""
    q, e = _queries(spark, d)
    return S.knn(q, e, 3, "vec_id", "vec_id").filter("score >= 0.4").groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))


@query(f"""WITH t AS (SELECT * FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank <= 5), q AS (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 25 = 0)
SELECT q.qid, coalesce(max(score) >= 0.55, false) AS confident, max(score) AS top_score, CASE WHEN coalesce(max(score) >= 0.55, false) THEN count(cid) ELSE 0 END::INTEGER AS n_kept FROM q LEFT JOIN t ON t.qid = q.qid GROUP BY q.qid""")
def gate_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Confidence gate: queries below the threshold keep nothing, but keep their row."""
    q, e = _queries(spark, d)
    return S.gate(S.knn(q, e, 5, "vec_id", "vec_id"), q.select(F.col("vec_id").alias("qid")), 0.55, 5).select("qid", "confident", "top_score", F.size("kept").alias("n_kept"))


@query(f"""WITH a AS (SELECT qid, max(score) AS s FROM ({_TOP} WHERE q.vec_id % 25 = 0 AND c.label % 2 = 0) WHERE rank <= 5 GROUP BY qid),
b AS (SELECT qid, max(score) AS s FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank <= 5 GROUP BY qid)
SELECT a.qid, (a.s >= 0.55 OR b.s >= 0.55) AS confident, CASE WHEN a.s < 0.55 AND b.s >= 0.55 THEN b.s ELSE a.s END AS top_score, (a.s < 0.55 AND b.s >= 0.55) AS used_retry, CASE WHEN a.s >= 0.55 THEN 1 ELSE 2 END AS attempts FROM a JOIN b USING (qid)""")
def retry_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A narrow search first; only the rejected queries search all, and the retry counts only if it is confident."""
    q, e = _queries(spark, d)
    ids = q.select(F.col("vec_id").alias("qid"))
    with Stages(spark, "retry-cascade") as stages:
        first = stages.table(S.gate(S.knn(q, e.filter("label % 2 = 0"), 5, "vec_id", "vec_id"), ids, 0.55, 5), "first")
        again = q.join(first.filter("not confident").select(F.col("qid").alias("vec_id")), "vec_id", "left_semi")
        retry = S.gate(S.knn(again, e, 5, "vec_id", "vec_id"), again.select(F.col("vec_id").alias("qid")), 0.55, 5)
        return stages.result(S.cascade(first, retry).select("qid", "confident", "top_score", "used_retry", "attempts"))


@query(f"SELECT * FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank <= 10")
def knn_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The same search over a stored collection of vector blocks, which skips blocks that can't reach the best."""
    q, e = _queries(spark, d)
    with Stages(spark, "knn-blocks") as stages:
        blocks = stages.table(V.vector_blocks(e, "vec_id"), "blocks")
        return stages.result(V.search_blocks(q, blocks, 10, "vec_id")[0])


@query(f"""WITH t AS (SELECT * FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank <= 10), b AS (SELECT q.vec_id AS qid, c.vec_id AS cid, {_DOT} AS score FROM embeddings q JOIN embeddings c ON q.label = c.label AND c.label IN (2, 7) AND q.vec_id <> c.vec_id WHERE q.vec_id % 25 = 0)
SELECT qid, cid, score, 'dense' AS how FROM t UNION ALL SELECT qid, cid, score, 'boost' FROM b WHERE (qid, cid) NOT IN (SELECT (qid, cid) FROM t)""")
def entity_boost_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of the search, and those that a match of labels, for two labels, adds; the boost only widens the pool."""
    q, e = _queries(spark, d)
    dense = S.knn(q, e, 10, "vec_id", "vec_id").select("qid", "cid", "score", F.lit("dense").alias("how"))
    a = q.select(F.col("vec_id").alias("qid"), "label", F.col("embedding").alias("x"))
    b = e.filter("label in (2, 7)").select(F.col("vec_id").alias("cid"), "label", F.col("embedding").alias("y"))
    boost = a.join(b, "label").filter("qid <> cid").select("qid", "cid", F.round(S.dot(F.col("x"), F.col("y")), 5).alias("score"), F.lit("boost").alias("how"))
    return R.bag_union(dense, boost, ["qid", "cid"])


@query(f"""WITH t AS (SELECT * FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank <= 10)
SELECT qid, cid, score, rerank, place::INTEGER AS place FROM (SELECT t.qid, t.cid, t.score, round(t.score * 0.5 + CASE WHEN q.label = c.label THEN 0.5 ELSE 0 END, 6) AS rerank,
row_number() OVER (PARTITION BY t.qid ORDER BY round(t.score * 0.5 + CASE WHEN q.label = c.label THEN 0.5 ELSE 0 END, 6) DESC, t.cid) AS place FROM t JOIN embeddings q ON q.vec_id = t.qid JOIN embeddings c ON c.vec_id = t.cid) WHERE place <= 5""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """A second score over the pool orders it; the first score stays in the row."""
    from ..operators.relational import ranked

    q, e = _queries(spark, d)
    pool = S.knn(q, e, 10, "vec_id", "vec_id")
    ql, cl = e.select(F.col("vec_id").alias("qid"), F.col("label").alias("ql")), e.select(F.col("vec_id").alias("cid"), F.col("label").alias("cl"))
    scored = pool.join(ql, "qid").join(cl, "cid").withColumn("rerank", F.round(F.col("score") * 0.5 + F.when(F.col("ql") == F.col("cl"), 0.5).otherwise(0.0), 6))
    return ranked(scored, ["qid"], F.col("rerank"), ["cid"], "place").filter("place <= 5").select("qid", "cid", "score", "rerank", "place")


_GRAMS = "CASE WHEN length({t}) >= 3 THEN list_distinct(list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3))) ELSE [] END"


@query(f"""WITH b AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM benchmark), g AS (SELECT item_id, {_GRAMS.format(t="t")} AS g FROM b)
SELECT x.item_id AS a, y.item_id AS b, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 6) AS similarity FROM g x JOIN g y ON x.item_id < y.item_id AND len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) >= 0.12""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of benchmark items by 3-gram similarity, through the rarest grams of each."""
    return S.jaccard_self(table(spark, d, "benchmark"), "item_id", "text", 0.12)


@query()
def fuzzy_remap_best(spark: SparkSession, d: str) -> DataFrame:
    """Old ids to new ones by whole text: an equal text first, then the most similar one at 0.9 or more. The stated
    queries are the rows whose id is divisible by 100, against all rows but themselves."""
    t = table(spark, d, "documents").select("doc_id", "text")
    with Stages(spark, "fuzzy-remap") as stages:
        return stages.result(S.fuzzy_best(t.filter("doc_id % 100 = 0"), t, "doc_id", "doc_id", "text", 0.9, exclude_self=True, stages=stages))


_NOUNS = "SELECT DISTINCT w AS noun, item_id AS cid FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) >= 9"


def _nouns(spark: SparkSession, d: str) -> DataFrame:
    """Long words of the benchmark's items, and the items that have them."""
    w = table(spark, d, "benchmark").select(F.col("item_id").alias("cid"), F.explode(F.split("text", "[^A-Za-z]+")).alias("noun"))
    return w.filter(F.length("noun") >= 9).select("noun", "cid").distinct()


@query(f"""SELECT conv_id, turn, noun FROM conversations JOIN (SELECT DISTINCT noun FROM ({_NOUNS})) ON contains(text, noun)""")
def terms_in_turns(spark: SparkSession, d: str) -> DataFrame:
    """Which of many terms each turn contains: one walk of an automaton over each text."""
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    return term_pairs(turns, _nouns(spark, d), "k", "text", "noun").select("k.*", "noun")


@query(f"""SELECT DISTINCT conv_id * 1000 + turn AS qid, cid FROM (SELECT * FROM conversations WHERE role = 'user') JOIN ({_NOUNS}) ON contains(text, noun)""")
def boosted_pool(spark: SparkSession, d: str) -> DataFrame:
    """The rows that the nouns of a question add to the pool of its search."""
    q = table(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("question"))
    return boosted(q, _nouns(spark, d))


_EDGES = "SELECT DISTINCT l_orderkey AS c, CASE WHEN l_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS law, (l_partkey % 90)::VARCHAR AS a FROM lineitem"


def _edge_tables(spark: SparkSession, d: str, make: Callable[[str], DataFrame]) -> DataFrame:
    """make(name) over bucketed tables of orders as chunks and their parts as articles; the tables go afterwards."""
    law = F.when(F.col("l_suppkey") % 2 == 0, "even").otherwise("odd")
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), law.alias("law_name"), (F.col("l_partkey") % 90).cast("string").alias("article"))
    name = f"edges_{uuid.uuid4().hex[:12]}"
    C.write_edges(edges, name)
    try:
        with Stages(spark, "co-citation") as stages:
            return stages.result(make(name))
    finally:
        C.drop_edges(spark, name)


@query(f"""WITH e AS ({_EDGES}) SELECT x.law AS law_name, x.a AS article, y.law AS related_law, y.a AS related_article, count(*) AS co_count FROM e x JOIN e y ON x.c = y.c AND (x.law <> y.law OR x.a <> y.a) GROUP BY 1, 2, 3, 4""")
def co_cited_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles that stand in the same chunks, and in how many: a self-join of bucketed edges that moves none of them."""
    return _edge_tables(spark, d, lambda name: C.co_cited(spark, name))


@query(f"""WITH e AS ({_EDGES}), q AS (SELECT c_custkey AS qid, (c_custkey % 100)::VARCHAR AS article FROM customer), n AS (SELECT a, count(DISTINCT c) AS n FROM e GROUP BY 1),
r AS (SELECT x.a, y.law, y.a AS b, count(DISTINCT x.c) AS k, row_number() OVER (PARTITION BY x.a ORDER BY count(DISTINCT x.c) DESC, y.law, y.a) AS rank FROM e x JOIN e y ON x.c = y.c AND (x.law <> y.law OR x.a <> y.a) GROUP BY 1, 2, 3)
SELECT qid, article, coalesce(n.n, 0) AS n_chunks, rank::INTEGER AS rank, law AS related_law, b AS related_article, k AS co_count FROM q LEFT JOIN n ON n.a = q.article LEFT JOIN r ON r.a = q.article AND r.rank <= 5""")
def related_articles(spark: SparkSession, d: str) -> DataFrame:
    """For each question's article, in how many chunks it stands and the articles most often beside it."""
    q = table(spark, d, "customer").select(F.col("c_custkey").alias("qid"), (F.col("c_custkey") % 100).cast("string").alias("article"))
    return _edge_tables(spark, d, lambda name: C.related_laws(q, name, 5))
