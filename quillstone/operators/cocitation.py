"""Co-citation over bucketed edge tables: which articles stand in the same chunks.

Edges are stored twice, both bucketed and sorted by (chunk, salt), so the self-join reads bucket against bucket and moves
nothing. A chunk with very many articles is cut: its left edges are dealt to salts, its right ones stand at every salt,
so no task meets all pairs of it. Only counts, summed in each task first, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges of a chunk that stand at one salt, about.
HOT = 256


def salted(edges: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """edges(chunk_id, law_name, article) -> left, right, both (chunk_id, salt, law_name, article). An edge counts once,
    however often it is there; edges without a chunk or an article are left out."""
    e = edges.select("chunk_id", "law_name", "article").filter("chunk_id is not null and article is not null").distinct()
    salts = e.groupBy("chunk_id").agg(F.ceil(F.count(F.lit(1)) / hot).alias("_salts"))
    rows = e.join(salts, "chunk_id")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("law_name", "article"), F.col("_salts")).cast("int"))
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("_salts") - 1).cast("int"))))
    keep = ("chunk_id", "salt", "law_name", "article")
    return left.select(*keep), right.select(*keep)


def write_edges(edges: DataFrame, name: str, buckets: int = 64, hot: int = HOT) -> None:
    """The edge tables `name`_left and `name`_right of the session's warehouse, rebuilt as a whole. Choose as many buckets
    as leave each about the size of a task's input."""
    for side, df in zip(("left", "right"), salted(edges, hot), strict=True):
        # Dealt as the buckets are, so that each bucket is one file.
        dealt = df.repartition(buckets, "chunk_id", "salt")
        dealt.write.mode("overwrite").bucketBy(buckets, "chunk_id", "salt").sortBy("chunk_id", "salt").format("parquet").saveAsTable(f"{name}_{side}")


def drop_edges(spark: SparkSession, name: str) -> None:
    for side in ("left", "right"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{side}")


def co_cited(spark: SparkSession, name: str, asked: Column | None = None) -> DataFrame:
    """law_name, article, related_law, related_article, co_count: the chunks that hold both, for all articles, or those
    for which `asked` (over law_name and article) is true. An article is not related to itself."""
    left = spark.table(f"{name}_left")
    if asked is not None:
        left = left.filter(asked)
    right = spark.table(f"{name}_right").select("chunk_id", "salt", F.col("law_name").alias("related_law"), F.col("article").alias("related_article"))
    other = ~(F.col("law_name").eqNullSafe(F.col("related_law")) & (F.col("article") == F.col("related_article")))
    pairs = left.hint("merge").join(right, ["chunk_id", "salt"]).filter(other)
    return pairs.groupBy("law_name", "article", "related_law", "related_article").agg(F.count(F.lit(1)).alias("co_count"))


def chunk_counts(spark: SparkSession, name: str) -> DataFrame:
    """article, n_chunks: in how many chunks an article number stands, whatever the law."""
    return spark.table(f"{name}_left").groupBy("article").agg(F.count_distinct("chunk_id").alias("n_chunks"))


def related_laws(questions: DataFrame, name: str, top: int = 10) -> DataFrame:
    """questions(qid, article) -> qid, article, n_chunks, rank, related_law, related_article, co_count: the `top` articles
    that stand with an article number most often, of whatever law it is; ties by law, then article. A question whose
    article stands alone, or nowhere, has one row with nulls (n_chunks says which); a null article likewise."""
    spark = questions.sparkSession
    asked = questions.select("article").filter("article is not null").distinct()
    # The edges of the articles asked for: the join keeps the buckets of the other side where it can broadcast this one.
    left = spark.table(f"{name}_left").join(asked, "article", "left_semi")
    right = spark.table(f"{name}_right").select("chunk_id", "salt", F.col("law_name").alias("related_law"), F.col("article").alias("related_article"))
    other = ~(F.col("law_name").eqNullSafe(F.col("related_law")) & (F.col("article") == F.col("related_article")))
    pairs = left.hint("merge").join(right, ["chunk_id", "salt"]).filter(other)
    # Of one number, several laws may stand in a chunk: it counts once.
    counts = pairs.groupBy("article", "related_law", "related_article").agg(F.count_distinct("chunk_id").alias("co_count"))
    w = Window.partitionBy("article").orderBy(F.desc("co_count"), "related_law", "related_article")
    best = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    totals = chunk_counts(spark, name).join(asked, "article", "left_semi")
    out = questions.select("qid", "article").join(totals, "article", "left").join(best, "article", "left")
    return out.select("qid", "article", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "rank", "related_law", "related_article", "co_count")


def related_evidence(related: DataFrame) -> DataFrame:
    """What related_laws() found as evidence: qid, place, text, primary_law. It names real articles, so that an answer may
    cite them; it grounds no question by itself."""
    law = F.concat(F.col("related_law"), F.lit("第"), F.col("related_article"), F.lit("條"))
    text = F.concat(law, F.lit("(與第"), F.col("article"), F.lit("條共同引用 "), F.col("co_count").cast("string"), F.lit(" 次)"))
    return related.filter("rank is not null").select("qid", F.col("rank").alias("place"), text.alias("text"), law.alias("primary_law"))
