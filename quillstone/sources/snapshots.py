"""Tables that are rebuilt as a whole: every version is a folder of its own, and one small pointer names the current one.

A writer fills a new folder and swaps the pointer last, by one atomic rename; a reader that follows the pointer sees the
old table or the new one, whole, whenever a writer stops. Versions that nothing points at are removed by vacuum(), not by
writers: a reader that began with one can finish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER, VERSIONS = "CURRENT", "versions"


class Stale(RuntimeError):
    """Another writer has replaced the version that this one began from."""


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> dict | None:
    """number, version (the folder's name) and what it was made from; None where nothing was ever written."""
    at, files = _files(spark, f"{root}/{POINTER}")
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def versions(spark: SparkSession, root: str) -> list[str]:
    at, files = _files(spark, f"{root}/{VERSIONS}")
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def _point(spark: SparkSession, root: str, to: dict) -> None:
    """Swaps the pointer: written beside it, then renamed over it in one step."""
    jvm = spark._jvm
    beside, files = _files(spark, f"{root}/.{POINTER}-{uuid.uuid4().hex}")
    out = files.create(beside, False)
    try:
        out.write(bytearray(json.dumps(to).encode()))
    finally:
        out.close()
    at, _ = _files(spark, f"{root}/{POINTER}")
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, at, how)


def write_set(tables: dict[str, DataFrame], root: str, kind: str = "parquet", base: int | None = None, **options: object) -> int:
    """Tables that belong together, as the next version below root, under one pointer; its number. They may read the
    current version.

    base: the number of the version that they were made from. If another writer has gone ahead by the time the pointer
    would be swapped, Stale is raised and the current version stays. One writer at a time is meant; two that swap in the
    same instant without a base: the later pointer stands, and both versions are whole.
    """
    spark, name = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    for table, df in tables.items():
        df.write.format(kind).options(**options).save(f"{root}/{VERSIONS}/{name}/{table}")
    was = current(spark, root)
    number = was["number"] if was else 0
    if base is not None and base != number:
        raise Stale(f"version {number} is current, not {base}")
    _point(spark, root, {"number": number + 1, "version": name, "kind": kind, "schemas": {t: df.schema.json() for t, df in tables.items()}})
    return number + 1


def write(df: DataFrame, root: str, kind: str = "parquet", base: int | None = None, **options: object) -> int:
    """One table as the next version below root."""
    return write_set({"table": df}, root, kind, base, **options)


def read(spark: SparkSession, root: str, table: str = "table") -> DataFrame:
    """A table of the current version, with the schema it was written with."""
    now = current(spark, root)
    if now is None or table not in now["schemas"]:
        raise FileNotFoundError(f"no table {table} at {root}")
    return spark.read.format(now["kind"]).schema(T.StructType.fromJson(json.loads(now["schemas"][table]))).load(f"{root}/{VERSIONS}/{now['version']}/{table}")


def update(spark: SparkSession, root: str, make: Callable[[DataFrame], DataFrame]) -> int | None:
    """The table replaced by make(table), or None, and nothing done, where that has the same rows."""
    now = current(spark, root)
    old = read(spark, root)
    new = make(old)
    if old.schema == new.schema and old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty():
        return None
    return write(new, root, now["kind"], base=now["number"])


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Removes all versions but the current one and the `keep` - 1 newest others; how many went."""
    now = current(spark, root)
    at, files = _files(spark, f"{root}/{VERSIONS}")
    if now is None or not files.exists(at):
        return 0
    others = sorted((s for s in files.listStatus(at) if s.getPath().getName() != now["version"]), key=lambda s: s.getModificationTime(), reverse=True)
    gone = others[max(0, keep - 1) :]
    for s in gone:
        files.delete(s.getPath(), True)
    return len(gone)
