"""The corpus pipeline: five stages from documents to token shards, each over all that its predecessor kept.

All stages take null and repeated ids, null, empty and very long texts, repeated rows, columns of any other name, and
empty tables; what each makes of them stands with it. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontam, mixing, simhash, toxicity
from quillstone.llm.common import table, written
from quillstone.llm.token_output import token_output


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. A null or empty text scores by the bias alone and stays; rows of
    equal texts stay or go together; without usable labels every text scores by the bias and stays."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model, threshold=0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links: that of the smallest doc_id; a row without an id only where no
    other of its component has one. Null and empty texts are one component; repeated rows are copies of each other."""
    return simhash.deduplicated(docs, radius=3, width=3)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts hold none; each row is judged by its own text;
    without benchmark items every row stays."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"), least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: up to twice, or not at all. Rows count one by one, whatever their
    ids; texts without words are never taken; a null source is a source of its own."""
    return mixing.mixed(docs, weights=(3, 1, 2), total_share=1.5, max_epochs=2.0)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token shards, as read back: doc_id, start, n_tokens, ids_crc32, shard. Rows without an id come first, rows that
    share one in the order of a hash of their texts; a null or empty text is the end id alone; no rows: no shards."""
    return token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), vocab=50257, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: SQL can't express training, fingerprints and tokenizing: tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
