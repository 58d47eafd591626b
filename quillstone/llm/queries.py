"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, quality, secret_scan, toxicity
from .collocations import collocations
from .common import table
from .decontam import contaminated
from .mixing import mix
from .runs import periodic_runs
from .simhash import near_duplicates
from .substring import substring_dedup
from .tiff import text_tiffs, tiff_pages
from .token_counts import token_counts
from .token_output import token_output


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards of all documents, written and read back."""
    return token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), vocab=50257, end_id=2)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, linked at three bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents"), radius=3, width=3)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows of 20 that stand earlier."""
    return substring_dedup(table(spark, sf_dir, "documents"), window=20).select("doc_id", "n_words", "n_removed", "kept_sha256", "n_factors")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document, by canonical digests."""
    return licences.licence_scan(table(spark, sf_dir, "documents"), licences.known_digests(spark))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), total_share=1.5, max_epochs=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document, by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a TIFF, read back page by page."""
    pages = tiff_pages(text_tiffs(table(spark, sf_dir, "documents")))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "page",
        "width",
        "height",
        "error",
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.8)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns, and what the field adds."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.secret_scan(docs, secret_scan.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of trees that were trained on labels.quality, for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, every tenth of which first gets a tail that repeats itself."""
    return periodic_runs(table(spark, sf_dir, "documents"), least_exponent=4, least_length=6, tails=True)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language."""
    return collocations(table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, percent=100)


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces
), sizes AS (SELECT unnest([1, 2, 3, 4, 5]) AS k
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)
), counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), frequent AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE f >= 100
), candidates AS (SELECT * FROM frequent WHERE k > 1
), inside AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT *, unnest(range(1, k - s + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS s FROM candidates)) GROUP BY ALL
), cuts AS (
  SELECT lang, phrase, f AS a, w[1:c] AS head, w[c + 1:] AS tail, c FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, n, c,
         ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN totals ON totals.lang = cuts.lang
  JOIN frequent x ON x.lang = cuts.lang AND x.phrase = array_to_string(head, ' ')
  JOIN frequent y ON y.lang = cuts.lang AND y.phrase = array_to_string(tail, ' ')
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, c) = 1
), kept AS (SELECT s.* FROM scored s LEFT JOIN inside i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f < 100 * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

QUERIES = {f.__name__: f for f in (op1_token_output, op2_simhash_near_dedup, op3_substring_dedup, op4_license_scan, op5_token_counts, op6_mixing, op7_toxicity, op8_media_columns, op9_decontamination, op10_secret_scan, op11_quality_rules, op12_periodic_runs, op13_phrase_collocations)}

ORACLE_SQL: dict[str, str] = {"op4_license_scan": licences.oracle_sql(), "op13_phrase_collocations": COLLOCATIONS_SQL}
