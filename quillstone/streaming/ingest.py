"""Incremental ingest: what any earlier batch has had is left out, and a batch that runs again adds nothing.

The digests of all chunks are keyed state of the stream, kept in its checkpoint; a batch's rows are a folder named by the
batch, and a batch counts from the moment its manifest is renamed into place. A batch that failed half-way is written
anew when it runs again; one that has its manifest is passed over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.chunking import chunk_documents


def fresh_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk_no, strategy, chunk, char_len, digest: each chunk once, whatever documents, batches or runs of the stream
    have it. Which of equal chunks stays is that which comes first; of those of one batch, any.

    The state grows with the distinct chunks (32 bytes and its key each); on a cluster let RocksDB hold it
    (spark.sql.streaming.stateStore.providerClass). Null and empty texts have no chunks. Not streaming: of one table."""
    return chunk_documents(docs, key, text).withColumn("digest", F.unhex(F.sha2("chunk", 256))).dropDuplicates(["digest"])


def _names(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def batches(spark: SparkSession, root: str) -> list[int]:
    """The batches that count."""
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{root}/batches") if n.endswith(".json") and not n.startswith("."))


def put_batch(df: DataFrame, batch: int, root: str) -> bool:
    """Writes a batch and then its manifest; False, and nothing done, where it has one already."""
    spark = df.sparkSession
    if batch in batches(spark, root):
        return False
    folder = f"{root}/rows/batch={batch}"
    df.write.mode("overwrite").parquet(folder)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    beside, at = (jvm.org.apache.hadoop.fs.Path(f"{root}/batches/{n}") for n in (f".{uuid.uuid4().hex}", f"{batch}.json"))
    files = at.getFileSystem(conf)
    out = files.create(beside, False)
    try:
        out.write(bytearray(json.dumps({"batch": batch, "schema": df.schema.jsonValue()}).encode()))
    finally:
        out.close()
    return bool(files.rename(beside, at))


def ingest(docs: DataFrame, root: str, checkpoint: str, key: str = "doc_id", text: str = "text", once: bool = True) -> StreamingQuery:
    """A stream of documents into the chunk table below root: all there is (once), or for as long as it runs."""
    w = fresh_chunks(docs, key, text).writeStream.foreachBatch(lambda df, n: put_batch(df, n, root)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The chunks of all batches that count; raises FileNotFoundError where there is none."""
    have = batches(spark, root)
    if not have:
        raise FileNotFoundError(f"no batch at {root}")
    first = spark.read.option("wholetext", True).text(f"{root}/batches/{have[0]}.json").first()[0]
    schema = T.StructType.fromJson(json.loads(first)["schema"])
    return spark.read.schema(schema).parquet(*[f"{root}/rows/batch={n}" for n in have])
