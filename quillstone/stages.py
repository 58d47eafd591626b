"""Reliable tables between the stages of a plan: written once, read by every later stage, deleted when spent.

A stage table lies in the folder that driver and executors share (spark.checkpoint.dir), so it cuts the plan behind it
and survives lost executors. The tables of a plan are deleted when its block ends; its result is a table too, which
goes when the session ends or when discard() is called.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

_RESULTS: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on a single machine that has none (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes of a stage table's files, asked of the file system; None for anything else."""
    path = getattr(df, "_stage_path", None)
    if path is None:
        return None
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return int(at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(at).getLength())


def _delete_results() -> None:
    for spark, path in _RESULTS:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the session may be gone; its folder then stays
            return


atexit.register(_delete_results)


class Stages:
    """with Stages(spark, "plan") as stages: a = stages.table(df, "a"); ...; return stages.result(df)"""

    def __init__(self, spark: SparkSession, plan: str):
        self.spark, self.root, self.written = spark, f"{shared_folder(spark)}/quillstone/{plan}-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        delete(self.spark, f"{self.root}/stages")

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path
        return out

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, computed now, as a table that later stages read."""
        self.written += 1
        return self._written(df, f"{self.root}/stages/{self.written:03d}-{name}")

    def result(self, df: DataFrame) -> DataFrame:
        """df, computed now: the rows of the plan, which outlive its stages."""
        path = f"{self.root}/result"
        out = self._written(df, path)
        _RESULTS.append((self.spark, path))
        return out


def discard(result: DataFrame) -> None:
    """Deletes a plan's result that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in result.inputFiles()}:
        delete(result.sparkSession, path)
