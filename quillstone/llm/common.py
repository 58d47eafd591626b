"""What the operators of this subpackage share: word rule, byte-balanced slices, shared folders, piece-wise tokenizing."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most text bytes that one step of an Arrow function holds in expanded (word-wise) form.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that driver and executors share (spark.checkpoint.dir)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        # Only on one machine (tests): a folder of our own, kept for the session.
        conf = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", conf)
        spark.sparkContext.setCheckpointDir(conf)
    return f"{conf.rstrip('/')}/quillstone/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote; only for tables that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def keyed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df with a number of its own for each row, as a table, so that every reader sees the same numbers; and the name
    of that column, which clashes with no other."""
    key = free_name(df, "_row_key")
    return written(df.withColumn(key, F.monotonically_increasing_id()), name), key


def give_back() -> None:
    """Returns what earlier tasks of this worker have freed to the system: workers outlive the stages of a pipeline."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about `most` bytes of a text or binary column, or a single row."""
    col = batch.column(batch.schema.get_field_index(text))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        col = col.cast(pa.binary())
    at, size, start = 0, 0, 0
    offsets = memoryview(col.buffers()[1]).cast("i") if len(col) else []
    for at in range(len(col)):
        n = offsets[col.offset + at + 1] - offsets[col.offset + at]
        if at > start and size + n > most:
            yield batch.slice(start, at - start)
            start, size = at, 0
        size += n
    if len(col) > start:
        yield batch.slice(start)


def texts_of(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+: bytes.split() cuts at just these six bytes."""
    return text.split()


def doc_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *more: str) -> DataFrame:
    """The columns an operator reads, whatever other columns the input carries."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c) for c in more])


class PieceEncoder:
    """Encodes whole texts by their distinct pieces, cut where no token can reach across.

    pre="word": every ASCII white-space byte is a boundary (tokenizers whose pre-tokenizer drops white space).
    pre="byte": a piece is white space and the visible run after it (byte-level BPE: its pattern
    starts a new match wherever white space follows a visible character, and looks ahead only inside white space).
    Each distinct piece goes through the library once while it stays in the cache; the cache is emptied at
    `most` entries, so memory is bounded whatever the vocabulary of the corpus.
    """

    # The code points with the White_Space property.
    SPACE = "\\t-\\r \x85\xa0  -     　"
    PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
    #: Control characters on which regex engines disagree; a text with one is encoded in one go.
    ODD = re.compile("[\x1c-\x1f᠎​⁠﻿]")

    def __init__(self, path: str, pre: str, most: int = 1_000_000, width: str = "<u2", tokenizer=None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path) if tokenizer is None else tokenizer
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pre, self.most, self.width = pre, most, width
        self.cache: dict = {}

    def pieces(self, text: str) -> list[str]:
        if self.pre == "word":
            return [text] if self.ODD.search(text) else re.findall(r"[^ \t-\r]+", text)
        return [text] if self.ODD.search(text) else self.PIECES.findall(text)

    def _learn(self, docs: list[list[str]], value) -> None:
        new = set().union(*docs) - self.cache.keys()
        if len(self.cache) + len(new) > self.most:
            self.cache.clear()
            new = set().union(*docs)
        todo = list(new)
        for at in range(0, len(todo), 4096):
            part = todo[at : at + 4096]
            self.cache.update(zip(part, map(value, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    def lengths(self, texts: list[str]) -> list[int]:
        docs = [self.pieces(x) for x in texts]
        self._learn(docs, len)
        get = self.cache.__getitem__
        return [sum(map(get, x)) for x in docs]

    def encoded(self, texts: list[str], end: list[int] | None = None):
        """The ids of all texts, one after the other, `end` behind each; and how many each text has."""
        import numpy as np

        tail = np.array(end or [], self.width).tobytes()
        parts = [x + tail for x in self.ids(texts)]
        flat = np.frombuffer(b"".join(parts), self.width)
        return flat, np.array([len(x) for x in parts], np.int64) // flat.itemsize

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of `width`."""
        import numpy as np

        docs = [self.pieces(x) for x in texts]
        self._learn(docs, lambda e: np.array(e.ids, self.width).tobytes())
        get = self.cache.__getitem__
        return [b"".join(map(get, x)) for x in docs]
