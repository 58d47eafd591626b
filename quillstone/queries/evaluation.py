"""Metrics, intervals, tests, sweeps, matrices, and the learning experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators.similarity import knn
from ..plans import learning
from ..session import table
from ..stages import Stages
from .registry import query
from .similarity import _TOP

_RANKS = f"""WITH t AS (SELECT * FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank <= 10), r AS (SELECT q.vec_id AS qid, q.label, min(t.rank) AS rank FROM embeddings q LEFT JOIN (SELECT t.qid, t.rank, c.label FROM t JOIN embeddings c ON c.vec_id = t.cid) t ON t.qid = q.vec_id AND t.label = q.label WHERE q.vec_id % 25 = 0 GROUP BY 1, 2)"""


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    """For each query, the place of the first row with its label among the ten nearest, or null."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 25 = 0")
    found = knn(q, e, 10, "vec_id", "vec_id").join(e.select(F.col("vec_id").alias("cid"), "label"), "cid").select("qid", "label", "rank")
    gold = q.select(F.col("vec_id").alias("qid"), "label")
    return gold.join(found.groupBy("qid", "label").agg(F.min("rank").alias("rank")), ["qid", "label"], "left")


@query(f"""{_RANKS} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3,
round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r""")
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("rank")
    return _ranks(spark, d).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(stats.recall_at(r, k)), 6).alias(f"recall_{k}") for k in (1, 3, 5)], F.round(F.avg(stats.reciprocal(r)), 6).alias("mrr"))


@query(f"""{_RANKS} SELECT CASE WHEN grouping(label) = 1 THEN 'all' ELSE label::VARCHAR END AS label, count(*) AS n, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY GROUPING SETS ((label), ())""")
def recall_by_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_group_and_all(_ranks(spark, d), "label", F.count(F.lit(1)).alias("n"), F.round(F.avg(stats.reciprocal(F.col("rank"))), 6).alias("mrr"))


_SCORES = f"SELECT qid, score, (SELECT label FROM embeddings WHERE vec_id = qid) < 7 AS inside FROM ({_TOP} WHERE q.vec_id % 25 = 0) WHERE rank = 1"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Best score of each query; labels under 7 play the questions that belong to the corpus."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 25 = 0")
    return knn(q, e, 1, "vec_id", "vec_id").join(e.select(F.col("vec_id").alias("qid"), (F.col("label") < 7).alias("inside")), "qid").select("qid", "score", "inside")


def _swept(spark: SparkSession, d: str) -> DataFrame:
    """The sweep reads its scores several times: they are written once, and nothing is searched again."""
    with Stages(spark, "sweep") as stages:
        return stages.result(stats.threshold_sweep(stages.table(_scores(spark, d), "scores"), "score", "inside"))


@query(f"""WITH s AS ({_SCORES}), t AS (SELECT DISTINCT score AS threshold FROM s)
SELECT threshold, (SELECT count(*) FROM s WHERE inside AND score < threshold) AS false_rejects, (SELECT count(*) FROM s WHERE NOT inside AND score >= threshold) AS false_accepts,
(SELECT count(*) FROM s WHERE inside AND score < threshold) + (SELECT count(*) FROM s WHERE NOT inside AND score >= threshold) AS errors FROM t""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _swept(spark, d)


@query(f"""WITH s AS ({_SCORES}), t AS (SELECT DISTINCT score AS threshold FROM s), e AS (SELECT threshold, (SELECT count(*) FROM s WHERE inside AND score < threshold) + (SELECT count(*) FROM s WHERE NOT inside AND score >= threshold) AS errors FROM t)
SELECT threshold, errors FROM e ORDER BY errors, threshold LIMIT 1""")
def threshold_argmin(spark: SparkSession, d: str) -> DataFrame:
    """Fewest errors; of equals, the lowest threshold."""
    return _swept(spark, d).orderBy("errors", "threshold").limit(1).select("threshold", "errors")


@query(f"""WITH s AS ({_SCORES}) SELECT min(score) FILTER (inside) AS low_in, max(score) FILTER (NOT inside) AS high_out, round(min(score) FILTER (inside) - max(score) FILTER (NOT inside), 6) AS gap,
quantile_disc(score, 0.5) AS median FROM s""")
def score_gap(spark: SparkSession, d: str) -> DataFrame:
    a = _scores(spark, d).agg(F.min(F.when(F.col("inside"), F.col("score"))).alias("low_in"), F.max(F.when(~F.col("inside"), F.col("score"))).alias("high_out"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY score)").alias("median"))
    return a.select("low_in", "high_out", F.round(F.col("low_in") - F.col("high_out"), 6).alias("gap"), "median")


def _intervals_sql(values: str, metrics: dict[str, str], grouped: bool = True, resamples: int = 200) -> str:
    """SQL of stats.intervals over a query that gives id, g and what the metrics need."""
    w = " + ".join(f"(u >= {t})::INTEGER" for t in stats.POISSON)
    own = " UNION ALL ".join(f"SELECT g, k, w, '{n}' AS metric, {m} AS m FROM w" for n, m in metrics.items())
    sets = "GROUPING SETS ((g, k, metric), (k, metric))" if grouped else "g, k, metric"
    name = "CASE WHEN grouping(g) = 1 THEN 'all' ELSE g END" if grouped else "g"
    return f"""WITH v AS ({values}), d AS (SELECT v.*, b, md5(id::VARCHAR || '|' || b || '|0') AS h FROM v, range({resamples // 4}) t(b)),
w AS (SELECT * EXCLUDE (u, h, b, j), {w} AS w FROM (SELECT *, b * 4 + j AS k, concat('0x', substr(h, 1 + 8 * j, 8))::UBIGINT AS u FROM d, range(4) s(j)) UNION ALL SELECT *, -1 AS k, 1 AS w FROM v),
x AS ({own}), r AS (SELECT {name} AS "group", k, metric, sum(w * m) / nullif(sum(w) FILTER (m IS NOT NULL), 0) AS m, sum(w) FILTER (m IS NOT NULL) AS c FROM x GROUP BY {sets})
SELECT "group", metric, coalesce(max(c) FILTER (k = -1), 0)::BIGINT AS n, round(max(m) FILTER (k = -1), 6) AS mean, round(quantile_cont(m, 0.025) FILTER (k >= 0), 6) AS low, round(quantile_cont(m, 0.975) FILTER (k >= 0), 6) AS high FROM r GROUP BY 1, 2"""


def _shown(df: DataFrame) -> DataFrame:
    return df.select("group", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


@query(_intervals_sql("SELECT doc_id AS id, 'all' AS g, quality FROM labels", {"quality": "quality::DOUBLE"}, False))
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return _shown(stats.intervals(table(spark, d, "labels"), "doc_id", {"quality": F.col("quality")}))


@query(f"""SELECT *, low > 0 OR high < 0 AS ci_excludes_zero FROM ({_intervals_sql("SELECT doc_id AS id, 'all' AS g, quality - toxic AS diff FROM labels", {"diff": "diff::DOUBLE"}, False)})""")
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The interval of a difference of two systems on the same questions, and whether zero lies outside it."""
    out = _shown(stats.intervals(table(spark, d, "labels"), "doc_id", {"diff": F.col("quality") - F.col("toxic")}))
    return out.withColumn("ci_excludes_zero", stats.excludes_zero(F.col("low"), F.col("high")))


_AT = {f"recall_{k}": f"CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE" for k in (1, 3, 5)} | {"mrr": "coalesce(1.0 / rank, 0)::DOUBLE"}


@query(_intervals_sql(f"{_RANKS} SELECT qid AS id, label::VARCHAR AS g, rank FROM r", _AT))
def recall_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 1, 3 and 5 and the mean reciprocal rank with their intervals, by label and over all."""
    r = F.col("rank")
    metrics = {f"recall_{k}": stats.recall_at(r, k) for k in (1, 3, 5)} | {"mrr": stats.reciprocal(r)}
    return _shown(stats.intervals(_ranks(spark, d), "qid", metrics, "label"))


@query(_intervals_sql(f"{_RANKS} SELECT qid AS id, 'all' AS g, rank FROM r", {"mrr": _AT["mrr"]}, False))
def mrr_interval(spark: SparkSession, d: str) -> DataFrame:
    """The mean reciprocal rank with its interval."""
    return _shown(stats.intervals(_ranks(spark, d), "qid", {"mrr": stats.reciprocal(F.col("rank"))}))


@query(_intervals_sql("SELECT conv_id || ':' || turn AS id, role AS g, CASE WHEN length(text) > 60 THEN 1.0 WHEN text IS NOT NULL THEN 0.0 END::DOUBLE AS ok FROM conversations", {"rate": "ok"}))
def rate_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The rate of each group, and of all, with its interval."""
    c = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "role", (F.length("text") > 60).cast("double").alias("ok"))
    return _shown(stats.intervals(c, "id", {"rate": F.col("ok")}, "role"))


@query(f"""WITH s AS ({_SCORES}) SELECT qid, score, 'lowest' AS list FROM (SELECT * FROM s WHERE inside ORDER BY score, qid LIMIT 10) UNION ALL SELECT qid, score, 'highest' FROM (SELECT * FROM s WHERE NOT inside ORDER BY score DESC, qid LIMIT 10)""")
def score_listings(spark: SparkSession, d: str) -> DataFrame:
    """The ten lowest scores of questions that belong to the corpus, and the ten highest of those that don't."""
    s = _scores(spark, d)
    low, high = s.filter("inside").orderBy("score", "qid").limit(10), s.filter("not inside").orderBy(F.desc("score"), "qid").limit(10)
    return low.select("qid", "score", F.lit("lowest").alias("list")).unionByName(high.select("qid", "score", F.lit("highest").alias("list")))


@query("""SELECT role, count(*) FILTER (ok) AS count, count(*) AS total, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS rate, strftime(max(run_at), '%Y-%m-%d %H:%M') AS run_at FROM (SELECT role, length(text) > 60 AS ok, TIMESTAMP '2024-03-01 00:00:00' + to_minutes(turn) AS run_at FROM conversations) GROUP BY role""")
def rate_summary(spark: SparkSession, d: str) -> DataFrame:
    """Count, total and rate of each group, and the label of its last run."""
    c = table(spark, d, "conversations").select("role", (F.length("text") > 60).alias("ok"), F.timestamp_add("MINUTE", F.col("turn").cast("int"), F.lit("2024-03-01 00:00:00").cast("timestamp")).alias("run_at"))
    return c.groupBy("role").agg(F.count_if("ok").alias("count"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("rate"), F.date_format(F.max("run_at"), "yyyy-MM-dd HH:mm").alias("run_at"))


@query(_intervals_sql("SELECT doc_id AS id, toxic::VARCHAR AS g, quality FROM labels", {"quality": "quality::DOUBLE"}))
def bootstrap_by_toxic(spark: SparkSession, d: str) -> DataFrame:
    """The interval of each group, from sums that tasks have made."""
    return _shown(stats.intervals(table(spark, d, "labels"), "doc_id", {"quality": F.col("quality")}, "toxic"))


@query("""WITH f AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS up, count(*) FILTER (quality = 0 AND toxic = 1) AS down FROM labels)
SELECT up, down, CASE WHEN up + down = 0 THEN 1.0 ELSE round(least(1.0, 2 * (SELECT sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2))) FROM range(least(up, down)::BIGINT + 1) r(i))), 9) END AS p FROM f""")
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    """Exact test on paired outcomes."""
    f = table(spark, d, "labels").agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("up"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("down"))
    return f.select("up", "down", F.round(stats.sign_test(F.col("up"), F.col("down")), 9).alias("p"))


@query("""SELECT 'regulation' AS subset, count(*) AS n, round(avg(quality), 6) AS closed, round(avg(CASE WHEN toxic = 0 THEN quality END), 6) AS when_answered, round(avg(CASE WHEN toxic = 1 THEN 0 ELSE quality END), 6) AS rag, round(avg(CASE WHEN toxic = 1 THEN quality ELSE 1 END), 6) AS fallback FROM labels""")
def exam_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Three systems on one set: closed book, with retrieval (may abstain), and the first where the second abstains."""
    t = table(spark, d, "labels")
    abstain, q = F.col("toxic") == 1, F.col("quality")
    means = {"closed": q, "when_answered": F.when(~abstain, q), "rag": F.when(abstain, 0).otherwise(q), "fallback": F.when(abstain, q).otherwise(1)}
    return t.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(n) for n, c in means.items()]).select(F.lit("regulation").alias("subset"), "*")


@query("""SELECT config, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT c.config, (l.quality = 1 AND (c.config <> 'no_check' OR l.doc_id % 7 <> 0) AND (c.config <> 'no_retry' OR l.doc_id % 5 <> 0)) AS hit FROM labels l, (VALUES ('full'), ('no_check'), ('no_retry')) c(config)) GROUP BY config""")
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every configuration on every question, one aggregate."""
    configs = spark.createDataFrame([("full",), ("no_check",), ("no_retry",)], "config string")
    grid = table(spark, d, "labels").crossJoin(F.broadcast(configs))
    c, i = F.col("config"), F.col("doc_id")
    hit = (F.col("quality") == 1) & ((c != "no_check") | (i % 7 != 0)) & ((c != "no_retry") | (i % 5 != 0))
    return grid.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 6).alias("rate"))


@query("""SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(sum(value), 2) AS total FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def latency_by_handler(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return stats.by_group_and_all(e, "event_type", F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT o_custkey, bool_or(o_orderstatus = 'F') AS grounded, bool_and(coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice > 100000 END, true)) AS full_hit FROM orders GROUP BY 1""")
def grounded_and_full_hit(spark: SparkSession, d: str) -> DataFrame:
    """Any record that holds; all required parts hold, where null means not required."""
    need = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 100000)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("grounded"), F.bool_and(F.coalesce(need, F.lit(True))).alias("full_hit"))


@query()
def tfidf_chars(spark: SparkSession, d: str) -> DataFrame:
    """Character 2-4-grams of training rows, weighted; the terms of highest document frequency."""
    return learning.vocabulary(learning.split(table(spark, d, "documents")).filter("split = 'train'"), 200)


@query()
def ridge_regression(spark: SparkSession, d: str) -> DataFrame:
    """Log target, character features fitted on training rows only, ridge; errors on the three splits."""
    return learning.experiment(learning.split(table(spark, d, "documents")))
