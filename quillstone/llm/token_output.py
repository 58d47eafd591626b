"""Token-id shards: range-partitioned documents -> checksummed binary files, and back.

File format, all integers little-endian. A shard holds documents in ascending order of doc_id, then a hash of the text:
    magic "QTOK1\\0\\0\\0"
    blocks as rangecoder.py writes them, each decodable alone
    zlib-compressed index: int64 doc_id, uint8 whether it is null, uint32 ids, for each document
    trailer: uint32 vocabulary, uint32 documents, uint64 ids, uint64 index bytes, uint32 crc32 of the index, magic
A document may span blocks; blocks never span shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_rows, give_back, shared_dir, slices, written
from .rangecoder import BLOCK_IDS, decode_block, encode_block
from .token_counts import encoder

MAGIC = b"QTOK1\0\0\0"
_TRAILER = struct.Struct("<IIQQI8s")
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long, crc32 long"
#: Text bytes that are encoded at once: each piece of them is looked up once.
BATCH_BYTES = 4 << 20
#: Input text bytes that one shard gets, about.
SHARD_BYTES = 32 << 20


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Buffers one block of ids; everything else goes to the file at once."""

    def __init__(self, uri: str, vocab: int):
        self.fs, self.path = _open(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.fs.open_output_stream(self.part)
        self.vocab, self.crc, self.size, self.n_ids = vocab, 0, 0, 0
        self.docs: list[tuple[int | None, int]] = []
        self.buffer: list[np.ndarray] = []
        self.held = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents, their ids one after the other, and how many each has."""
        self.docs += zip(doc_ids, lengths.tolist(), strict=True)
        self.buffer.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= BLOCK_IDS:
            ids, at = np.concatenate(self.buffer), 0
            while len(ids) - at >= BLOCK_IDS:
                self._put(encode_block(ids[at : at + BLOCK_IDS], self.vocab))
                at += BLOCK_IDS
            self.buffer, self.held = [ids[at:]], len(ids) - at

    def close(self) -> tuple[int, int, int, int]:
        if self.held:
            self._put(encode_block(np.concatenate(self.buffer), self.vocab))
        index = zlib.compress(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([d is None for d, _ in self.docs], "u1").tobytes() + np.array([n for _, n in self.docs], "<u4").tobytes())
        self._put(index)
        self._put(_TRAILER.pack(self.vocab, len(self.docs), self.n_ids, len(index), zlib.crc32(index), MAGIC))
        self.file.close()
        # A task that runs again writes the same bytes under the same name.
        self.fs.move(self.part, self.path)
        return len(self.docs), self.n_ids, self.size, self.crc


def read_shard(uri: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a shard, one block in memory at a time. ValueError: the file is damaged."""
    files, path = _open(uri)
    with files.open_input_file(path) as f:
        f.seek(f.size() - _TRAILER.size)
        _, n_docs, n_ids, index_bytes, index_crc, magic = _TRAILER.unpack(f.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        end = f.size() - _TRAILER.size - index_bytes
        f.seek(end)
        index = f.read(index_bytes)
        if zlib.crc32(index) != index_crc:
            raise ValueError("damaged index")
        index = zlib.decompress(index)
        doc_ids, nulls, lengths = np.frombuffer(index, "<i8", n_docs), np.frombuffer(index, "u1", n_docs, 8 * n_docs), np.frombuffer(index, "<u4", n_docs, 9 * n_docs)
        at, rest = len(MAGIC), np.zeros(0, np.int64)
        parts: list[np.ndarray] = []
        have = 0
        for doc, null, n in zip(doc_ids.tolist(), nulls.tolist(), lengths.tolist(), strict=True):
            while have < n:
                f.seek(at)
                head = f.read(28)
                size = 28 + struct.unpack_from("<I", head, 16)[0]
                f.seek(at)
                ids, _ = decode_block(f.read(size))
                at += size
                parts.append(ids)
                have += len(ids)
            rest = np.concatenate(parts) if len(parts) != 1 else parts[0]
            yield None if null else doc, rest[:n]
            parts, have = [rest[n:]], have - n
        if at != end or have:
            raise ValueError("blocks and index differ")


def _shards(rows: DataFrame) -> int:
    """As many shards as leave each about SHARD_BYTES of text. Spark's estimate counts where it is that of files that
    are read as they stand (compressed: about a third); for any other plan the bytes of the texts are summed up."""
    plan = rows._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    files = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = int(str(plan.stats().sizeInBytes()))
    if leaves.size() == 1 and size <= files < 1 << 60 and "Relation" in leaves.apply(0).nodeName():
        return max(1, 3 * size // SHARD_BYTES)
    return max(1, (rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // SHARD_BYTES)


def write_token_shards(docs: DataFrame, out: str, tokenizer: str, vocab: int, end_id: int, pre: str = "byte", text: str = "text", doc_id: str = "doc_id", shards: int | None = None) -> DataFrame:
    """Encodes every whole text, appends end_id to each, and writes shards below the folder URI `out` (any file
    system that pyarrow and all executors reach). Returns the manifest, itself a written table: shard, path,
    n_docs, n_ids, n_bytes, crc32 of the file. Shards follow each other in ascending doc_id order (nulls first).

    Null or empty text: just the end id. Repeated ids and rows: each is kept. Empty table: no shards. Other columns
    are ignored. Rows are dealt by ranges of doc_id, then of a hash of the text, so shard sizes depend neither on
    sources or groups of copies nor on how many rows share an id or have none.
    """
    rows = doc_rows(docs, text, doc_id)
    if shards is None:
        shards = _shards(rows)
    fs_, path = _open(out)
    fs_.create_dir(path, recursive=True)
    width = "<u2" if max(vocab, end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        give_back()
        enc, sink = encoder(tokenizer, pre, width), None
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES):
                if sink is None:
                    sink = ShardWriter(f"{out}/shard-{shard:06d}.tok", max(vocab, end_id + 1))
                sink.add(b.column(0).to_pylist(), *enc.encoded([x or "" for x in b.column(1).to_pylist()], [end_id]))
        if sink:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "path", "n_docs", "n_ids", "n_bytes", "crc32"), (shard, f"{out}/shard-{shard:06d}.tok", *sink.close()), strict=True))], pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64()), ("crc32", pa.int64())]))

    # The hash deals out rows that share an id (or have none), and orders them; the text settles its ties.
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange(int(shards), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    return written(dealt.select("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")


def read_token_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard: read from the shards' files.

    The manifest has a row for each shard; the running sum over it is over shards, not documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                at, rows = row["base"], []
                for doc, ids in read_shard(row["path"]):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"]))
                    at += len(ids)
                if at - row["base"] != row["n_ids"] or len(rows) != row["n_docs"]:
                    raise ValueError(f"{row['path']} does not match its manifest")
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    n = max(1, manifest.count())
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # Each task gets one shard: the id of its partition is its place in the manifest.
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long"))).withColumn("place", F.row_number().over(Window.orderBy("shard")) - 1)
    return placed.repartitionByRange(n, "place").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def token_output(docs: DataFrame, tokenizer: str, vocab: int, end_id: int, out: str | None = None, pre: str = "byte") -> DataFrame:
    """Writes shards (by default below the shared folder) and returns what reading them back gives. Nulls, ties,
    repeated rows and empty tables: as write_token_shards() says; other columns are ignored."""
    out = out or shared_dir(docs.sparkSession, "token-shards")
    return read_token_shards(docs.sparkSession, write_token_shards(docs, out, tokenizer, vocab, end_id, pre))
