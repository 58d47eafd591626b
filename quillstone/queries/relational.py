"""Filters, joins, groupings, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, citations, stats
from ..functions.rendering import learning_rows
from ..operators import relational as R
from ..session import table
from ..sources.files import classify_pages
from .registry import query


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3' AND n_chars BETWEEN 120 AND 7000")
def scan_filter_meta(spark: SparkSession, d: str) -> DataFrame:
    """Equality filters where supplied, a range, pruned columns."""
    df = R.supplied(table(spark, d, "documents"), lang="en", source="src3", kind=None)
    return df.filter(F.col("n_chars").between(120, 7000)).select("doc_id", "lang", "source", "n_chars")


@query("SELECT page_id, url FROM pages WHERE contains(url, '1')")
def filter_contains(spark: SparkSession, d: str) -> DataFrame:
    return R.containing(table(spark, d, "pages"), "url", "1").select("page_id", "url")


@query("SELECT DISTINCT o_orderkey, o_orderpriority FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' OR l_partkey = 17")
def filter_disjunctive_left_join(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    edges = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return R.either_side(orders, edges, ("o_orderkey", "l_orderkey"), F.col("o_orderpriority") == "1-URGENT", F.col("l_partkey") == 17)


@query("""SELECT 'all' AS mode, count(*) AS n FROM orders UNION ALL SELECT 'none', 0
UNION ALL SELECT 'ids', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def filter_three_valued(spark: SparkSession, d: str) -> DataFrame:
    """No filter given, an empty id list, an id list."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    out = None
    for mode, given in (("all", None), ("none", ids.limit(0)), ("ids", ids)):
        one = R.within(orders, "o_custkey", given, "c_custkey").agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = one if out is None else out.union(one)
    return out


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 400000)")
def fetch_semi(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(ids, "l_orderkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_seen(spark: SparkSession, d: str) -> DataFrame:
    """Rows that no urgent order has seen."""
    seen = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(seen, "c_custkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber, coalesce(o_totalprice, 0.0) AS score FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'")
def lookup_with_default(spark: SparkSession, d: str) -> DataFrame:
    """Fetched rows with their score from a map, 0 where the map has none."""
    scores = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return table(spark, d, "lineitem").join(scores, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.coalesce("o_totalprice", F.lit(0.0)).alias("score"))


@query("""SELECT b.l_partkey, count(DISTINCT b.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
WHERE a.l_partkey BETWEEN 1 AND 20 AND NOT (a.l_partkey = b.l_partkey) GROUP BY b.l_partkey ORDER BY n DESC, b.l_partkey LIMIT 10""")
def co_occurrence_topn(spark: SparkSession, d: str) -> DataFrame:
    """Parts ordered together with given parts: the chunk-article graph's one-hop projection."""
    return R.co_occurring(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", F.col("l_partkey").between(1, 20))


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS n_orders, count(*) AS n_edges FROM lineitem GROUP BY l_partkey")
def edge_degree(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("n_orders"), F.count(F.lit(1)).alias("n_edges"))


@query("SELECT l_linestatus, l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10")
def two_key_distinct(spark: SparkSession, d: str) -> DataFrame:
    return R.top_distinct(table(spark, d, "lineitem"), ["l_linestatus", "l_suppkey"], "l_orderkey", 10)


@query("""SELECT 'documents' AS name, '' AS bucket, count(*) AS n FROM documents UNION ALL SELECT 'pages', '', count(*) FROM pages
UNION ALL SELECT 'labels', '', count(*) FROM labels UNION ALL SELECT 'embeddings', '', count(*) FROM embeddings
UNION ALL SELECT 'lang', coalesce(lang, '(none)'), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'source', coalesce(nullif(source, 'src3'), '(none)'), count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'toxic', '1', count(*) FILTER (toxic = 1) FROM labels UNION ALL SELECT 'quality', '1', count(*) FILTER (quality = 1) FROM labels""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of four tables, counts by key with a bucket for null, conditional counts."""
    t = {n: table(spark, d, n) for n in ("documents", "pages", "labels", "embeddings")}
    out = None
    for name, df in t.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit("").alias("bucket"), "n")
        out = one if out is None else out.unionByName(one)
    lang = R.with_none_bucket(t["documents"], "lang").select(F.lit("lang").alias("name"), F.col("lang").alias("bucket"), "n")
    source = R.with_none_bucket(t["documents"].withColumn("source", F.nullif("source", F.lit("src3"))), "source").select(F.lit("source").alias("name"), F.col("source").alias("bucket"), "n")
    both = t["labels"].agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("quality"))
    flags = both.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit("1").alias("bucket"), F.col(n).alias("n")) for n in ("toxic", "quality")])).alias("x")).select("x.*")
    return out.unionByName(lang).unionByName(source).unionByName(flags)


@query("""SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total,
round(avg(coalesce(o_totalprice, 0)), 4) AS mean FROM orders GROUP BY 1, 2""")
def penalty_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sum and mean of an amount, null counting as 0, by year and month."""
    o = table(spark, d, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.round(F.avg(F.coalesce("o_totalprice", F.lit(0.0))), 4).alias("mean")
    )


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def article_topn(spark: SparkSession, d: str) -> DataFrame:
    return R.top_counts(table(spark, d, "orders").filter("o_orderpriority is not null"), ["o_orderpriority"], 5)


@query("""SELECT reason, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 200 THEN 'too_short'
WHEN length(regexp_replace(text, '[^#$%&*|]', '', 'g')) * 20 > length(text) THEN 'symbols' END AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY reason""")
def dead_letter_reasons(spark: SparkSession, d: str) -> DataFrame:
    """One parse column, split into kept and failed rows; failed rows by reason."""
    t = F.col("text")
    reason = F.when(t.isNull() | (F.trim(t) == ""), "empty").when(F.length(t) < 200, "too_short").when(F.length(F.regexp_replace(t, "[^#$%&*|]", "")) * 20 > F.length(t), "symbols")
    return table(spark, d, "documents").select("doc_id", reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars, count(*) FILTER (lang <> 'en') AS other FROM documents GROUP BY source")
def partial_counter_merge(spark: SparkSession, d: str) -> DataFrame:
    """Counters that each task keeps and a shuffle of counters merges: the ordinary two-phase aggregate."""
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars"), F.count_if(F.col("lang") != "en").alias("other"))


@query("""SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, row_number() OVER (PARTITION BY regexp_replace(text, '^\\s+|\\s+$', '', 'g') ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_first(table(spark, d, "documents").select("doc_id", "text", "n_chars"), "text", ["doc_id"]).select("doc_id", "n_chars")


@query("""SELECT l_orderkey, l_linenumber, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END, l_extendedprice DESC, l_linenumber) AS place FROM lineitem) WHERE place <= 3""")
def fill_quota(spark: SparkSession, d: str) -> DataFrame:
    """Guaranteed rows first, then the best others, three in all for each order."""
    return R.quota_fill(table(spark, d, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", F.col("l_extendedprice"), 3, ["l_linenumber"]).select("l_orderkey", "l_linenumber", "place")


@query("""WITH a AS (SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F')
SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'union_all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a, b = li.filter("l_returnflag = 'R'").select("l_orderkey"), li.filter("l_linestatus = 'F'").select("l_orderkey")
    out = None
    for name, df in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)), ("union_all", a.union(b))):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT doc_id, lang, place::INTEGER AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS place FROM documents) WHERE place <= 12""")
def quota_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.quota_sample(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 12, 7).select("doc_id", "lang", "place")


@query("""SELECT doc_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, concat('0x', substr(md5('42|' || doc_id), 1, 8))::UBIGINT % 100 AS b FROM documents)""")
def split_70_15_15(spark: SparkSession, d: str) -> DataFrame:
    return R.three_way_split(table(spark, d, "documents").select("doc_id"), "doc_id", 42).select("doc_id", "split")


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT event_id, CASE WHEN ok THEN event_type ELSE 'other' END AS intent, CASE WHEN ok THEN 'model' ELSE 'fallback' END AS source, CASE WHEN ok THEN repeat('x', 60) ELSE 'no valid reply' END AS reason FROM (SELECT event_id, event_type, event_type IN ('click', 'view', 'purchase') AND value <= 60 AS ok FROM events)""")
def json_validate_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A reply must be JSON with an intent of the list; a broken one, or anything else, falls back. Of a reason the first 60
    characters are kept."""
    whole = F.to_json(F.struct(F.col("event_type").alias("intent"), F.lit("x" * 80).alias("reason")))
    reply = F.when(F.col("value") > 60, F.substring(whole, 1, 30)).otherwise(whole)
    parsed = F.from_json(reply, "intent string, reason string")
    ok = F.coalesce(parsed["intent"].isin("click", "view", "purchase"), F.lit(False))
    return table(spark, d, "events").select("event_id", F.when(ok, parsed["intent"]).otherwise("other").alias("intent"), F.when(ok, "model").otherwise("fallback").alias("source"), F.when(ok, F.substring(parsed["reason"], 1, 60)).otherwise("no valid reply").alias("reason"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem""")
def explode_refs(spark: SparkSession, d: str) -> DataFrame:
    """Nested references to edge rows: order rows with an array of lines, exploded again."""
    li = table(spark, d, "lineitem")
    nested = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("refs"))
    return nested.select("l_orderkey", F.inline("refs"))


@query("""SELECT l_orderkey, CASE WHEN list_contains(list(l_partkey), 7) THEN arg_min(l_partkey, l_linenumber * 1000000000::BIGINT + l_partkey) ELSE 7 END AS head, (count(*) + CASE WHEN list_contains(list(l_partkey), 7) THEN 0 ELSE 1 END)::INTEGER AS n FROM lineitem GROUP BY 1""")
def insert_primary_ref(spark: SparkSession, d: str) -> DataFrame:
    """The primary reference goes to the head of the list unless it is in it."""
    li = table(spark, d, "lineitem")
    refs = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("refs"))
    full = citations.with_primary(F.col("refs"), F.lit(7).cast("long"))
    return refs.select("l_orderkey", full[0].alias("head"), F.size(full).alias("n"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value > 50) WHERE r = 1")
def last_confident(spark: SparkSession, d: str) -> DataFrame:
    """Of each user's calls that pass, the last one."""
    e = table(spark, d, "events").filter("value > 50")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("""SELECT user_id, count(*) AS kept, round(max(spent), 4) AS spent FROM (SELECT user_id, row_number() OVER w AS calls, sum(value) OVER w AS spent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) WHERE calls <= 4 AND spent <= 250 GROUP BY user_id""")
def budget_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Steps that stay within both budgets: calls, and a running sum."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = table(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("calls"), F.sum("value").over(w).alias("spent"))
    return e.filter("calls <= 4 and spent <= 250").groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.round(F.max("spent"), 4).alias("spent"))


@query("SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def nested_projection(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS preview FROM documents""")
def truncate_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 120, F.concat(F.substring("text", 1, 120), F.lit("..."))).otherwise(F.col("text")).alias("preview"))


@query("""SELECT w, array_to_string(list_sort(list(DISTINCT doc_id))[:20], ',') AS docs, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY w HAVING count(DISTINCT doc_id) >= 3""")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Term -> ordered distinct documents (the first 20 shown), for terms in three documents or more."""
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w")).filter("w <> ''").distinct()
    # The shown ones are cut off within each task before they meet; the counts are sums. No list of all documents.
    shown = w.withColumn("_p", F.row_number().over(Window.partitionBy("w").orderBy("doc_id"))).filter("_p <= 20")
    lists = shown.groupBy("w").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("docs"))
    counts = w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    return counts.join(lists, "w").select("w", "docs", "n")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 12 AND 20 AND l_returnflag IN ('A', 'R') AND l_shipdate IS NOT NULL")
def filter_range_members(spark: SparkSession, d: str) -> DataFrame:
    """A range, a list of members and a column that must be there, all of which reach the scan."""
    li = table(spark, d, "lineitem").filter(F.col("l_quantity").between(12, 20) & F.col("l_returnflag").isin("A", "R") & F.col("l_shipdate").isNotNull())
    return li.select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT sub, k, place FROM (SELECT sub, k, place, row_number() OVER (PARTITION BY l_orderkey, k ORDER BY sub, place) AS r FROM (SELECT l_orderkey, l_linenumber % 2 AS sub, l_suppkey % 7 AS k, l_linenumber AS place FROM lineitem)) WHERE r = 1""")
def sub_merge_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Lists of sub-questions merged: of rows with one key, the first by sub-question and place stays."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2).alias("sub"), (F.col("l_suppkey") % 7).alias("k"), F.col("l_linenumber").alias("place"))
    return R.first_wins(li, ["l_orderkey"], "k", ["sub", "place"]).select("sub", "k", "place")


@query("""SELECT l_orderkey AS k, 'part' AS origin FROM lineitem WHERE l_partkey < 20 UNION SELECT l_orderkey, 'part' FROM lineitem WHERE l_suppkey = 3 UNION SELECT o_orderkey, 'part' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def union_three_sources(spark: SparkSession, d: str) -> DataFrame:
    """Keys from three sources, each once."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    keys = li.filter("l_partkey < 20").select(F.col("l_orderkey").alias("k")).union(li.filter("l_suppkey = 3").select("l_orderkey")).union(o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey"))
    return keys.distinct().select("k", F.lit("part").alias("origin"))


@query("""SELECT count(*) AS n, (SELECT count(*) FROM orders WHERE o_totalprice >= 100000) AS kept, (SELECT count(*) FROM orders WHERE o_totalprice < 100000) AS rejected, 0::BIGINT AS in_both, 0::BIGINT AS in_neither FROM orders""")
def partition_check(spark: SparkSession, d: str) -> DataFrame:
    """What is kept and what is rejected make up everything, and share nothing: in one pass over the marks of each key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    kept, rejected = o.filter("o_totalprice >= 100000").select("o_orderkey"), o.filter("o_totalprice < 100000").select("o_orderkey")
    return R.partition_check(o, kept, rejected, "o_orderkey")


@query("""SELECT reason, doc_id FROM (SELECT doc_id, CASE WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 15000 THEN 'too_long' END AS reason FROM documents) WHERE reason IS NOT NULL ORDER BY reason, doc_id LIMIT 200""")
def failed_listing(spark: SparkSession, d: str) -> DataFrame:
    """The failed list, by reason and then by file, 200 rows at most."""
    reason = F.when(F.col("n_chars") < 200, "too_short").when(F.col("n_chars") > 15000, "too_long")
    return table(spark, d, "documents").select(reason.alias("reason"), "doc_id").filter("reason is not null").orderBy("reason", "doc_id").limit(200)


@query("""SELECT 'documents' AS name, count(*) > 0 AS ok, count(*) AS n FROM documents UNION ALL SELECT 'vectors', count(*) = count(*) FILTER (len(embedding) = 64), count(*) FILTER (len(embedding) <> 64) FROM embeddings
UNION ALL SELECT 'labels', count(*) = 0, count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'pages', count(*) = 0, count(*) FROM pages WHERE html IS NULL OR html = ''
UNION ALL SELECT 'failed', count(*) = 0, count(*) FROM documents WHERE text IS NULL OR n_chars < 200""")
def health(spark: SparkSession, d: str) -> DataFrame:
    """Five checks of the index, each with what it counted."""
    t = {n: table(spark, d, n) for n in ("documents", "embeddings", "labels", "pages")}
    n = F.count(F.lit(1))
    checks = [
        t["documents"].agg(n.alias("n")).select(F.lit("documents").alias("name"), (F.col("n") > 0).alias("ok"), "n"),
        t["embeddings"].filter(F.size("embedding") != 64).agg(n.alias("n")).select(F.lit("vectors"), F.col("n") == 0, "n"),
        t["labels"].join(t["documents"].select("doc_id"), "doc_id", "left_anti").agg(n.alias("n")).select(F.lit("labels"), F.col("n") == 0, "n"),
        t["pages"].filter("html is null or html = ''").agg(n.alias("n")).select(F.lit("pages"), F.col("n") == 0, "n"),
        t["documents"].filter("text is null or n_chars < 200").agg(n.alias("n")).select(F.lit("failed"), F.col("n") == 0, "n"),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.union(c)
    return out


@query("""SELECT c.conv_id, c.turn, o.o_orderkey AS label_no, CASE WHEN o.o_custkey % 5 = 4 THEN NULL WHEN o.o_custkey % 5 = 3 THEN '0' WHEN o.o_custkey % 5 = 0 THEN (o.o_orderkey % 60 + 1)::VARCHAR ELSE (o.o_orderkey % 60 + 1) || '之' || CASE o.o_custkey % 5 WHEN 1 THEN '一' ELSE '2' END END AS article FROM conversations c FULL JOIN orders o ON o.o_orderkey = c.conv_id""")
def label_references(spark: SparkSession, d: str) -> DataFrame:
    """Labels of laws as references, plain, with a suffix on either side, a whole act, none, beside the turns of the
    conversation of their number. Labels without a turn and turns without a label have rows too."""
    no = (F.col("o_orderkey") % 60 + 1).cast("string")
    kind = F.col("o_custkey") % 5
    label = F.when(kind == 0, F.concat(F.lit("食安法第"), no, F.lit("條"))).when(kind == 1, F.concat(F.lit("食安法第"), no, F.lit("條之一"))).when(kind == 2, F.concat(F.lit("食安法第"), no, F.lit("之2條"))).when(kind == 3, "健康食品管理法").otherwise("其他")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("label_no"), citations.law_reference(label)["article_full"].alias("article"))
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return c.join(o, F.col("conv_id") == F.col("label_no"), "full").select("conv_id", "turn", "label_no", "article")


_LAWS = """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN '健康食品管理法' ELSE '食安法第' || (o_custkey % 40 + 1) || '條' END AS law FROM orders), e AS (SELECT l_orderkey AS id, (l_partkey % 60 + 1)::VARCHAR AS a FROM lineitem)"""


@query(f"""{_LAWS} SELECT '28' AS asked, id FROM c WHERE law = '食安法第28條' OR id IN (SELECT id FROM e WHERE a = '28') UNION ALL SELECT 'act', id FROM c WHERE law = '健康食品管理法' UNION ALL SELECT 'none', id FROM c""")
def law_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by a law: those that come from the article or refer to it; by an act without an article, those that come from
    it alone, and the edges are not read; without a law all."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    law = F.when(F.col("o_custkey") % 3 == 0, "健康食品管理法").otherwise(F.concat(F.lit("食安法第"), (F.col("o_custkey") % 40 + 1).cast("string"), F.lit("條")))
    chunks, edges = o.select(F.col("o_orderkey").alias("id"), law.alias("primary_law")), li.select(F.col("l_orderkey").alias("chunk_id"), (F.col("l_partkey") % 60 + 1).cast("string").alias("article_full"))
    asked = {"28": "食安法第28條", "act": "健康食品管理法", "none": None}
    parts = [R.by_law(chunks, edges, law).select(F.lit(name).alias("asked"), "id") for name, law in asked.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT path, n_pages, round(avg_chars, 6) AS avg_chars, CASE WHEN message IS NOT NULL THEN CASE WHEN regexp_matches(lower(message), 'password|encrypt') THEN 'encrypted' ELSE 'corrupted' END WHEN (CASE WHEN chars > 0 THEN codes / chars ELSE 0 END) >= 0.15 OR avg_chars < 30 THEN 'needs_ocr' WHEN tables THEN 'has_tables' ELSE 'normal_text' END AS kind
FROM (SELECT l_orderkey AS path, count(*) AS n_pages, avg(length(regexp_replace(t, '^\\s+|\\s+$', '', 'g'))) AS avg_chars, bool_or(l_suppkey % 9 = 0) AS tables, coalesce(sum(length(t) - length(regexp_replace(t, '\\(cid:[0-9]+\\)', '', 'g'))) FILTER (l_linenumber <= 5), 0)::DOUBLE AS codes, coalesce(sum(length(t)) FILTER (l_linenumber <= 5), 0) + greatest(count(*) FILTER (l_linenumber <= 5) - 1, 0) AS chars, max(CASE WHEN l_orderkey % 50 = 0 THEN 'File has not been decrypted' WHEN l_orderkey % 51 = 0 THEN 'Password required' END) AS message
FROM (SELECT *, CASE l_partkey % 6 WHEN 0 THEN repeat(' ', 400) WHEN 1 THEN repeat('x', 100) WHEN 2 THEN repeat('(cid:12)', 5) || 'abc' WHEN 3 THEN '  short  ' WHEN 4 THEN '' ELSE repeat('y z ', 20) END AS t FROM lineitem) GROUP BY 1)""")
def page_classes(spark: SparkSession, d: str) -> DataFrame:
    """Files by what their pages hold: text, tables, blanks, font codes, or nothing that a reader could open."""
    kind = F.col("l_partkey") % 6
    text = F.when(kind == 0, " " * 400).when(kind == 1, "x" * 100).when(kind == 2, "(cid:12)" * 5 + "abc").when(kind == 3, "  short  ").when(kind == 5, "y z " * 20)
    message = F.when(F.col("l_orderkey") % 50 == 0, "File has not been decrypted").when(F.col("l_orderkey") % 51 == 0, "Password required")
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("page"), text.alias("text"), (F.col("l_suppkey") % 9 == 0).alias("has_table"), message.alias("error"))
    return classify_pages(pages, error="error").withColumn("avg_chars", F.round("avg_chars", 6))


@query("""SELECT conv_id, question, hit FROM (SELECT conv_id, arg_min(text, turn) AS question, bool_or(role = 'assistant' AND contains(text, 'ing ')) AS hit FROM conversations GROUP BY 1) WHERE NOT coalesce(hit, false) AND contains(question, 'the')""")
def trace_misses(spark: SparkSession, d: str) -> DataFrame:
    """The records of a run that missed, and whose question has a text."""
    c = table(spark, d, "conversations")
    records = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"), F.bool_or((F.col("role") == "assistant") & F.contains("text", F.lit("ing "))).alias("hit"))
    return R.replayed(records, miss=True, grep="the")


@query("""SELECT p_partkey, trim(regexp_replace(coalesce(p_name, '') || ' ' || coalesce(p_type, ''), '\\s+', ' ', 'g')) AS text, (p_size % 7)::BIGINT AS penalty, round(ln(p_size % 7), 9) AS log_penalty, CASE WHEN p_partkey % 3 = 0 THEN '第' || (p_partkey % 50) || '條第' || (p_partkey % 4) || '項' ELSE 'other' END AS label FROM part WHERE p_size % 7 <> 0""")
def training_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases as rows to learn from: text without runs of white space, a penalty above zero and its logarithm, the article."""
    law = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("違反第"), (F.col("p_partkey") % 50).cast("string"), F.lit("條第"), (F.col("p_partkey") % 4).cast("string"), F.lit("項"))).otherwise("第3條")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_name"), F.lit(" \n\t ")).alias("product"), F.col("p_type").alias("violation"), (F.col("p_size") % 7).cast("long").alias("penalty"), law.alias("law_cited"))
    return learning_rows(rows).withColumn("log_penalty", F.round("log_penalty", 9)).select("p_partkey", "text", "penalty", "log_penalty", "label")


@query("""SELECT o_custkey, count(*) AS n, round_even(count(*) FILTER (o_orderstatus = 'F') / 8, 2) AS eighths FROM orders GROUP BY 1""")
def half_even(spark: SparkSession, d: str) -> DataFrame:
    """A ratio whose halves go to the even digit."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), stats.ratio(F.count_if(F.col("o_orderstatus") == "F"), F.lit(8), 2).alias("eighths"))


@query("""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS n, s AS start, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), l) AS "end" FROM (SELECT doc_id, l, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, p FROM (SELECT doc_id, length(text) AS l, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM (SELECT doc_id, text, string_split(replace(text, chr(10), chr(7) || chr(10)), chr(7)) AS x FROM documents))) WHERE p <> ''""")
def header_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans from each line's beginning to the next."""
    return chunking.header_spans(table(spark, d, "documents"), "\n")
