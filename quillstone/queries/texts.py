"""Cleaning, chunking, references, tables, metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, citations, stats, text
from ..operators import similarity as S
from ..operators.decisions import evidence_text
from ..session import table
from ..sources import html
from .registry import query


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("""SELECT doc_id, length(x)::INTEGER AS n, md5(x) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(160), ' '), chr(65279), ''), chr(8203), ''), '\\(cid:[0-9]+\\)', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS x FROM documents)""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """The parts of cleaning that SQL can say: invisible characters, font codes, white space."""
    cleaned = _docs(spark, d).select("doc_id", text.compact(text.remove_cid(text.remove_invisible(F.col("text")))).alias("x"))
    return cleaned.select("doc_id", F.length("x").alias("n"), F.md5("x").alias("digest"))


@query()
def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Page-number patterns go from whole texts, in their order; with a foot line of each kind put before and behind."""
    n = F.col("doc_id").cast("string")
    x = F.concat(F.lit("- "), n, F.lit(" -\n"), F.col("text"), F.lit("\n第 "), n, F.lit(" 頁，共 "), n, F.lit(" 頁 "), n, F.lit("/"), n, F.lit(" ~"), n, F.lit("~\n12\n3-4\n5)\n |\nend"))
    y = text.remove_page_numbers(x)
    return _docs(spark, d).select("doc_id", F.length(y).alias("n"), F.md5(y).alias("digest"))


@query("""SELECT o_orderkey, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '第\\s*\\d+\\s*頁[,，]\\s*共\\s*\\d+\\s*頁', '', 'g'), '-\\s*\\d+\\s*-', '', 'g'), '\\b\\d+\\s*/\\s*\\d+\\b', '', 'g'), '(?m)^\\s*\\d{1,3}\\s*$', '', 'g'), '(?m)^\\s*\\d{1,3}-\\d{1,3}\\s*$', '', 'g'), '(?m)^\\d{1,3}\\)\\s*$', '', 'g'), '~\\s*\\d+\\s*~', '', 'g'), '(?m)^\\s*\\|\\s*$', '', 'g')) AS digest
FROM (SELECT o_orderkey, '- ' || o_orderkey || ' -' || chr(10) || o_orderpriority || chr(10) || '第 ' || o_custkey || ' 頁，共 9 頁 x' || chr(10) || o_custkey || '/' || o_orderkey || ' ~' || o_custkey || '~ y' || chr(10) || (o_custkey % 1000) || chr(10) || 'a' || chr(10) || (o_custkey % 100) || '-7' || chr(10) || 'b' || chr(10) || '5)' || chr(10) || 'c' || chr(10) || ' |' || chr(10) || 'end' AS x FROM orders)""")
def page_number_patterns(spark: SparkSession, d: str) -> DataFrame:
    """All eight patterns, on notes that hold each of them."""
    c, o = F.col("o_custkey"), F.col("o_orderkey").cast("string")
    part = lambda x: x.cast("string")
    x = F.concat(
        F.lit("- "), o, F.lit(" -\n"), F.col("o_orderpriority"), F.lit("\n第 "), part(c), F.lit(" 頁，共 9 頁 x\n"), part(c), F.lit("/"), o, F.lit(" ~"), part(c), F.lit("~ y\n"),
        part(c % 1000), F.lit("\na\n"), part(c % 100), F.lit("-7\nb\n5)\nc\n |\nend"),
    )
    return table(spark, d, "orders").select("o_orderkey", F.md5(text.remove_page_numbers(x)).alias("digest"))


@query()
def normalize_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility forms of whole texts."""
    return _docs(spark, d).select("doc_id", F.md5(text.nfkc(F.col("text"))).alias("digest"))


@query()
def merge_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that a layout broke, joined."""
    x = text.merge_lines(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(x).alias("n"), F.size(F.split(x, "\n")).alias("lines"))


@query()
def fix_spaced(spark: SparkSession, d: str) -> DataFrame:
    """Spaced ideographs closed up, in whole texts with such a run put before."""
    return _docs(spark, d).select("doc_id", F.md5(text.fix_spaced(F.concat(F.lit("食 品 安 全 "), F.col("text")))).alias("digest"))


@query()
def normalize_all(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain, NFKC and line folding included; the share of font codes before it."""
    return _docs(spark, d).select("doc_id", F.length(text.clean(F.col("text"))).alias("n"), F.round(text.cid_ratio(F.col("text")), 6).alias("cid_ratio"))


@query("""SELECT doc_id, len(c)::INTEGER AS chunks, list_sum(list_transform(c, lambda x: length(x)))::BIGINT AS chars FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '#'), lambda b: regexp_replace(regexp_replace(regexp_replace(b, '^\\s+|\\s+$', '', 'g'), '@[^\\n]*\\n?', '', 'g'), '^\\s+|\\s+$', '', 'g')), lambda b: length(b) >= 30) AS c FROM documents) WHERE len(c) > 0""")
def chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    c = _docs(spark, d).select("doc_id", chunking.hash_chunks(F.col("text")).alias("c")).filter(F.size("c") > 0)
    return c.select("doc_id", F.size("c").alias("chunks"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query()
def chunk_router(spark: SparkSession, d: str) -> DataFrame:
    """Every document through the chunkers: strategy, chunks, characters."""
    return chunking.chunk_counts(table(spark, d, "documents"))


def _strategy(spark: SparkSession, d: str, make: Callable[[str], list[str]], shape: Column) -> DataFrame:
    """A chunker's results on whole texts brought into the shape it is for: doc_id, chunks, chars."""
    docs = _docs(spark, d).select("doc_id", shape.alias("text"))
    chunks = chunking.chunks_by(docs, make)
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@query()
def chunk_qa_simple(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence that ends a line or is followed by a space as a question of its own."""
    i = F.regexp_replace("text", r"\.\s+", ".\nQ1: ")
    return _strategy(spark, d, chunking.question_chunks, F.concat(F.lit("Q1: "), i))


@query()
def chunk_header(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence as a section under a heading."""
    return _strategy(spark, d, chunking.heading_chunks, F.concat(F.lit("一、"), F.regexp_replace("text", r"\.\s+", ".\n二、")))


@query()
def chunk_length_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Texts by length alone, with overlap."""
    return _strategy(spark, d, chunking.length_chunks, F.col("text"))


@query()
def chunk_table(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as rows, equal ones once (the first), with ids from a fixed order."""
    from ..operators.relational import keep_first

    c = chunking.chunk_documents(table(spark, d, "documents"))
    return keep_first(c, "chunk", ["doc_id", "chunk_no"]).select("doc_id", "chunk_no", "strategy", "char_len")


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?i)\\b(version|section|article) \\d+(\\.\\d+)?'))::INTEGER AS n FROM documents WHERE regexp_matches(text, '(?i)\\b(version|section|article) \\d+(\\.\\d+)?')""")
def citations_extract_count(spark: SparkSession, d: str) -> DataFrame:
    p = r"(?i)\b(version|section|article) \d+(\.\d+)?"
    return _docs(spark, d).filter(F.regexp_like("text", F.lit(p))).select("doc_id", F.regexp_count("text", F.lit(p)).alias("n"))


@query("""WITH r AS (SELECT doc_id % 97 AS n, min(doc_id) AS k FROM documents GROUP BY 1) SELECT n, 'section ' || n AS form FROM r UNION ALL SELECT n, 'Section ' || n FROM r UNION ALL SELECT n, '§' || n FROM r""")
def surface_forms(spark: SparkSession, d: str) -> DataFrame:
    n = _docs(spark, d).select((F.col("doc_id") % 97).alias("n")).distinct()
    return n.select("n", F.explode(citations.reference_spellings(F.col("n"))).alias("form"))


@query()
def citations_detect(spark: SparkSession, d: str) -> DataFrame:
    """References with roles, as edge rows, from notices made of the tables' numbers."""
    no = (F.col("o_orderkey") % 60 + 1).cast("string")
    notice = F.concat(F.lit("依食安法第"), no, F.lit("條第"), (F.col("o_custkey") % 3 + 1).cast("string"), F.lit("項規定，處新臺幣"), F.col("o_custkey").cast("string"), F.lit("元罰鍰；本法第"), no, F.lit("條之一所稱"))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(citations.detect_udf(notice, F.lit("食安法第28條"))).alias("r"))
    return rows.select("o_orderkey", "r.*")


@query("""SELECT o_orderkey, o_orderkey % 60 + 1 AS cited, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '第' || (o_orderkey % 60 + 1) || '條' END AS missing FROM orders""")
def citations_unsupported(spark: SparkSession, d: str) -> DataFrame:
    """Cited articles that the evidence does not have in any spelling."""
    no = F.col("o_orderkey") % 60 + 1
    answer = F.concat(F.lit("依第"), no.cast("string"), F.lit("條規定辦理。"))
    evidence = F.array(F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("第 "), no.cast("string"), F.lit(" 條 內容"))).otherwise(F.lit("無")))
    return table(spark, d, "orders").select("o_orderkey", no.alias("cited"), F.array_join(F.transform(citations.unsupported(answer, evidence), citations.citation_label), ",").alias("missing"))


@query("""SELECT page_id, p[1] AS category, CASE WHEN len(p) >= 3 THEN p[2] END AS "primary", CASE WHEN len(p) > 3 THEN array_to_string(p[3:len(p) - 1], '/') ELSE '' END AS subtopic, regexp_replace(p[len(p)], '\\.[A-Za-z0-9]+$', '') AS document FROM (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS p FROM pages)""")
def path_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.path_metadata(F.col("url")).alias("m")).select("page_id", "m.*")


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Pages parsed to text and tables; what fails goes to the error channel with a reason."""
    p = html.parse_pages(table(spark, d, "pages"))
    return p.select("page_id", "status", "reason", F.length("text").alias("n"), F.size("tables").alias("tables"))


@query("""SELECT l_orderkey, '| line | part | flags |' || chr(10) || '| --- | --- | --- |' || string_agg(chr(10) || '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || '\\|' || l_linestatus || ' |', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS markdown FROM lineitem GROUP BY 1""")
def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Valid data tables as Markdown: each order's lines as rows of cells under a header."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.concat("l_returnflag", F.lit("|"), "l_linestatus"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("cells")))).alias("r"))
    whole = F.concat(F.array(F.array(F.lit("line"), F.lit("part"), F.lit("flags"))), F.transform("r", lambda x: x["cells"]))
    return rows.select("l_orderkey", whole.alias("rows")).filter(text.valid_table(F.col("rows"))).select("l_orderkey", text.markdown_table(F.col("rows")).alias("markdown"))


@query("""SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(list_filter(list_transform(flatten(list_transform(list_filter(regexp_extract_all(text, '(?:of|the) ([^.]{1,80})', 1), lambda s: len(string_split(s, ' ')) > 3), lambda s: string_split(s, ' '))), lambda p: regexp_replace(regexp_replace(p, '等.*$', ''), '^\\s+|\\s+$', '', 'g')), lambda p: length(p) BETWEEN 3 AND 12)) AS w FROM documents)""")
def enumerated_entities(spark: SparkSession, d: str) -> DataFrame:
    """Nouns of all enumerations of a text, after a cue, cut at the mark, 3 to 12 characters long."""
    nouns = text.enumerated(F.col("text"), cue="(?:of|the) ", mark=" ", stop=".")
    return _docs(spark, d).select("doc_id", F.explode(nouns).alias("w"))


@query()
def entity_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Enumerated nouns of whole texts -> how many rows they come from, and the first of these, 50 at most shown."""
    made = F.concat(F.lit("例如"), F.array_join(F.filter(F.split("text", r"\s+"), lambda w: F.length(w) > 6), "、"), F.lit("等。"))
    return text.noun_map(_docs(spark, d), made, "doc_id", 50)


@query()
def lcs_filter(spark: SparkSession, d: str) -> DataFrame:
    """Questions of 12 to 60 characters whose longest run in common with their source is short; with the reason. User
    turns ask, and the turn that follows, whole, is the source; a turn without one has an empty source."""
    c = table(spark, d, "conversations")
    replies = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("source"))
    b = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(replies, ["conv_id", "turn"], "left")
    lcs = b.withColumn("lcs", stats.lcs_udf("question", "source"))
    reason = F.when(~F.coalesce(F.length("question").between(12, 60), F.lit(False)), "length").when(F.col("lcs") > 6, "copied")
    return lcs.select("conv_id", "turn", "lcs", reason.isNull().alias("ok"), reason.alias("reason"))


_QUERY_TERMS = ["idiot", "license", "token", "the", "Licensed under", "xyzzy"]


@query(f"""SELECT doc_id, array_to_string(list_filter({_QUERY_TERMS}, lambda t: contains(text, t)), ',') AS hits FROM documents WHERE len(list_filter({_QUERY_TERMS}, lambda t: contains(text, t))) > 0""")
def lexicon_match(spark: SparkSession, d: str) -> DataFrame:
    """Terms of a lexicon that a text has, in lexicon order."""
    return S.lexicon_hits(_docs(spark, d), _QUERY_TERMS, "doc_id", "text").filter(F.size("hits") > 0).withColumn("hits", F.array_join("hits", ","))


@query("""SELECT conv_id, turn, CASE WHEN len(p) >= 2 THEN array_to_string(p, ' / ') ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS subs FROM (SELECT conv_id, turn, text, list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.]+'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || ',，;；、。')), lambda x: length(x) >= 2), lambda x: x || '?') AS p FROM conversations WHERE role = 'user')""")
def decompose_questions(spark: SparkSession, d: str) -> DataFrame:
    """User turns cut into sub-questions at sentence ends."""
    c = table(spark, d, "conversations").filter("role = 'user'")
    return c.select("conv_id", "turn", F.array_join(text.split_questions(F.col("text"), "[.]+"), " / ").alias("subs"))


@query("""SELECT conv_id, turn, CASE WHEN x <> '' AND length(x) <= 40 AND NOT contains(x, ' the ') THEN trim(text, ' ' || chr(9) || chr(13) || chr(10) || ',，;；、。') || ': which rules hold?' ELSE text END AS question FROM (SELECT conv_id, turn, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS x FROM conversations)""")
def keyword_to_question(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.keyword_question(F.col("text"), "%s: which rules hold?", 40, (" the ",)).alias("question"))


@query("""SELECT conv_id, turn, CASE WHEN length(x) > 100 THEN substr(x, 1, 100) || '...' ELSE x END AS evidence FROM (SELECT conv_id, turn, CASE WHEN contains(text, '. ') THEN regexp_replace(substr(text, instr(text, '. ') + 2), '^\\s+|\\s+$', '', 'g') WHEN contains(text, ' the ') THEN regexp_replace(substr(text, instr(text, ' the ') + 5), '^\\s+|\\s+$', '', 'g') ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS x FROM conversations)""")
def evidence_after_marker(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", evidence_text(F.col("text"), (". ", " the "), 100).alias("evidence"))
