"""Archives in two phases: one pass lists the central directories as rows, then the members are dealt out, and each task
reads and inflates only its own byte ranges.

Archives within archives are inflated into the shared stage folder, each by the task that has it, and listed in turn. The
paths must be ones that Arrow can open on the executors (local or shared folders, HDFS, object stores); tables of archive
contents that Spark has read already are unpacked by files.unpack().
"""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import Stages
from .files import MOST_MEMBER, repaired

MEMBERS = "source string, path string, offset long, packed long, size long, method int, flags int, crc long, nested boolean, error string"
FILES = "path string, content binary, error string"
#: Packed bytes that a task gets, about; bytes that are inflated at a time; archives within archives, at most so deep.
TASK_BYTES, STEP, DEPTH = 64 << 20, 1 << 20, 16
_LOCAL = struct.Struct("<4s5H3L2H")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _listed(source: str, path: str) -> Iterator[tuple]:
    files, at = _open(source)
    try:
        with files.open_input_file(at) as f:
            infos = zipfile.ZipFile(f).infolist()
    except (zipfile.BadZipFile, EOFError, struct.error, OSError, ValueError) as e:
        yield source, path, 0, 0, 0, 0, 0, 0, False, "bad_archive" if not isinstance(e, OSError) else f"unreadable: {type(e).__name__}"
        return
    for m in infos:
        if m.is_dir():
            continue
        name = f"{path}!{repaired(m.filename, m.flag_bits)}"
        error = "encrypted" if m.flag_bits & 1 else f"unknown_method: {m.compress_type}" if m.compress_type not in (0, 8) else None
        yield source, name, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.flag_bits, m.CRC, name.lower().endswith(".zip"), error


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def list_members(archives: DataFrame) -> DataFrame:
    """archives(source, path) -> MEMBERS: a row for each member (folders aside), from the central directory at an
    archive's end alone. An archive that can't be read is one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for row in _listed(source, path):
                    held.append(row)
                    if len(held) == 4096:
                        yield _rows(held, MEMBERS)
                        held = []
                if held:
                    yield _rows(held, MEMBERS)

    return archives.select("source", "path").mapInArrow(run, MEMBERS)


def inflated(source: str, offset: int, packed: int, method: int, size: int, crc: int) -> Iterator[bytes]:
    """A member's bytes in steps, from its own range of the archive; zlib.error or ValueError where they are damaged."""
    files, at = _open(source)
    with files.open_input_file(at) as f:
        f.seek(offset)
        head = f.read(_LOCAL.size)
        if len(head) < _LOCAL.size or head[:4] != b"PK\3\4":
            raise ValueError("no member here")
        *_, names, extra = _LOCAL.unpack(head)
        f.seek(offset + _LOCAL.size + names + extra)
        inflate = zlib.decompressobj(-15) if method == 8 else None
        seen = check = 0
        left = packed
        while left:
            data = f.read(min(STEP, left))
            if not data:
                raise ValueError("the archive ends too early")
            left -= len(data)
            while data:
                out = inflate.decompress(data, STEP) if inflate else data
                data = inflate.unconsumed_tail if inflate else b""
                seen, check = seen + len(out), zlib.crc32(out, check)
                if seen > size:
                    raise ValueError("longer than the directory says")
                yield out
        if inflate:
            out = inflate.flush()
            seen, check = seen + len(out), zlib.crc32(out, check)
            yield out
        if seen != size or check != crc:
            raise ValueError("not what the directory says")


def _content(row: dict) -> tuple[str, bytes | None, str | None]:
    if row["error"] is None and row["size"] > MOST_MEMBER:
        return row["path"], None, "too_large"
    if row["error"] is not None:
        return row["path"], None, row["error"]
    out = io.BytesIO()
    try:
        for part in inflated(*(row[c] for c in ("source", "offset", "packed", "method", "size", "crc"))):
            out.write(part)
    except (zlib.error, ValueError, OSError) as e:
        return row["path"], None, f"corrupted: {type(e).__name__}"
    return row["path"], out.getvalue(), None


def read_members(members: DataFrame) -> DataFrame:
    """MEMBERS -> path, content, error: each member's bytes, or what is wrong with it. One longer than a binary value can
    be is an error row (too_large)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield _rows([_content(row)], FILES)

    return members.mapInArrow(run, FILES)


def _dealt(members: DataFrame) -> DataFrame:
    """Members dealt to tasks by their place, not by their archive: as many tasks as TASK_BYTES asks for."""
    total = members.agg(F.sum("packed")).first()[0] or 0
    return members.repartition(max(1, -(-total // TASK_BYTES)), "source", "offset")


def _extracted(members: DataFrame, folder: str) -> DataFrame:
    """source, path, error: archives within archives as files in the folder. A task that runs again writes another file,
    and only the one whose row is kept is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        for b in batches:
            for row in b.to_pylist():
                name, error = f"{uuid.uuid4().hex}.zip", row["error"]
                if error is None:
                    try:
                        with files.open_output_stream(f"{root}/{name}") as out:
                            for part in inflated(*(row[c] for c in ("source", "offset", "packed", "method", "size", "crc"))):
                                out.write(part)
                    except (zlib.error, ValueError, OSError) as e:
                        error = f"corrupted: {type(e).__name__}"
                yield _rows([(f"{folder}/{name}", row["path"], error)], "source string, path string, error string")

    return members.mapInArrow(run, "source string, path string, error string")


def archive_paths(spark: SparkSession, root: str) -> DataFrame:
    """source, path of all .zip files below root; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return found.filter(F.regexp_like(F.lower("path"), F.lit(r"\.zip$"))).select(F.col("path").alias("source"), "path")


def unpack_archives(spark: SparkSession, archives: DataFrame, stages: Stages) -> DataFrame:
    """archives(source, path) -> path, content, error: a row for each member of each archive, those of archives within
    archives too, as archive!member!member. The listings, and the inner archives, are stage tables: read the result, or
    keep it by stages.result(), within the block. Empty table: no rows."""
    level, out = archives.select("source", "path"), None
    for depth in range(DEPTH):
        members = stages.table(list_members(level.repartition("source")), f"members-{depth}")
        own = read_members(_dealt(members.filter("not nested")))
        out = own if out is None else out.unionByName(own)
        inner = members.filter("nested")
        if inner.isEmpty():
            return out
        made = stages.table(_extracted(_dealt(inner), f"{stages.root}/stages/inner-{depth}"), f"extracted-{depth}")
        failed = made.filter("error is not null").select("path", F.lit(None).cast("binary").alias("content"), "error")
        out = out.unionByName(failed)
        level = made.filter("error is null").select("source", "path")
    rest = level.select("path", F.lit(None).cast("binary").alias("content"), F.lit("too_deep").alias("error"))
    return out.unionByName(rest)
