"""The progress of questions as a stream of messages: in order, each once, with one terminal message at the end.

progress_stream() is keyed state: the steps of a question may come late or in any order, a message leaves when all
before it have left, and the terminal message when the last step has. TraceSink writes messages so that each arrives
once: tasks write parts, and a batch's commit names its parts in one file that is renamed into place.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MESSAGE = "qid string, hop int, kind string, detail string"


def _advancing(wait_ms: int | None):
    """The state of a question: the next place, whether a step was confident, the last place (-1: not known, -2: ended), and
    the steps that wait for earlier ones."""

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ok, last, held = state.get if state.exists else (0, False, -1, "{}")
        waiting = {int(k): v for k, v in json.loads(held).items()}
        out = []
        if state.hasTimedOut:
            # Steps that never came: what waits goes out in order, and the question ends.
            for hop in sorted(waiting):
                out.append((key[0], hop, "step", waiting[hop][0]))
                ok, at = ok or waiting[hop][1], hop + 1
            out += [(key[0], at, "result" if ok else "error", "timed out")] * (last != -2)
            state.update((at, ok, -2, "{}"))
        elif last != -2:  # of an ended question nothing is told again
            for f in frames:
                for hop, tool, sure, done in zip(f["hop"], f["tool"], f["confident"], f["done"], strict=True):
                    if hop >= at:
                        waiting.setdefault(int(hop), (tool, bool(sure) if sure is not None and sure == sure else False))
                    if done:
                        last = max(last, int(hop))
            while at in waiting:
                tool, sure = waiting.pop(at)
                out.append((key[0], at, "step", tool))
                ok, at = ok or sure, at + 1
            if 0 <= last < at:
                out.append((key[0], at, "result" if ok else "error", ""))
                last, waiting = -2, {}
            state.update((at, ok, last, json.dumps(waiting)))
            if wait_ms is not None and last != -2:
                state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(out, columns=["qid", "hop", "kind", "detail"])

    return advance


def progress_stream(steps: DataFrame, wait_ms: int | None = None) -> DataFrame:
    """A stream of steps(qid, hop from 0, tool, confident, done) -> qid, hop, kind, detail.

    A step that comes twice is told once; what comes after a question's end is not told. `done` marks a question's last
    step. result: some step was confident; else error. timeout: a question that waits too long for a step ends too.
    The state of a question is one small row; that of ended ones stays as long as the checkpoint does.
    """
    how = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    rows = steps.select(F.col("qid").cast("string").alias("qid"), F.col("hop").cast("int").alias("hop"), F.col("tool").cast("string").alias("tool"), "confident", F.coalesce("done", F.lit(False)).alias("done")).filter("qid is not null and hop is not null")
    return rows.groupBy("qid").applyInPandasWithState(_advancing(wait_ms), MESSAGE, "at int, ok boolean, last int, waiting string", "append", how)


class _Part(WriterCommitMessage):
    def __init__(self, name: str | None, rows: int):
        self.name, self.rows = name, rows


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """A task's messages, by question and place, as one part."""
        messages = sorted((r.asDict() for r in rows), key=lambda m: (str(m.get("qid")), m.get("hop") or 0))
        if not messages:
            return _Part(None, 0)
        files, root = _open(self.path)
        files.create_dir(f"{root}/parts", recursive=True)
        name = f"{uuid.uuid4().hex}.jsonl"
        with files.open_output_stream(f"{root}/parts/{name}") as out:
            out.write("".join(json.dumps(m, ensure_ascii=False, default=str) + "\n" for m in messages).encode())
        return _Part(name, len(messages))

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        """Names the parts of a batch; a batch that was committed before stays as it was."""
        parts = sorted(m.name for m in messages if isinstance(m, _Part) and m.name)
        files, root = _open(self.path)
        files.create_dir(f"{root}/commits", recursive=True)
        at = f"{root}/commits/{batchId:012d}.json"
        if files.get_file_info(at).type != fs.FileType.NotFound:
            self._drop(parts)
            return
        beside = f"{root}/commits/.{uuid.uuid4().hex}"
        with files.open_output_stream(beside) as out:
            out.write(json.dumps({"batch": batchId, "parts": parts}).encode())
        files.move(beside, at)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        self._drop([m.name for m in messages if isinstance(m, _Part) and m.name])

    def _drop(self, parts: list[str]) -> None:
        files, root = _open(self.path)
        for name in parts:
            if files.get_file_info(f"{root}/parts/{name}").type != fs.FileType.NotFound:
                files.delete_file(f"{root}/parts/{name}")


class TraceSink(DataSource):
    """writeStream.format("trace").option("path", ...): a folder that Arrow can open on driver and executors alike."""

    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        return MESSAGE

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _Writer(self.options["path"])


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """batch, qid, hop, kind, detail of all committed batches; parts that no commit names are not read."""
    files, root = _open(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json") and not f.base_name.startswith("."))
    commits = []
    for name in names:
        with files.open_input_stream(name) as f:
            commits.append(json.loads(f.read()))
    schema = f"batch long, {MESSAGE}"
    parts = [(c["batch"], p) for c in commits for p in c["parts"]]
    if not parts:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(MESSAGE).json([f"{path.rstrip('/')}/parts/{p}" for _, p in parts]).withColumn("_part", F.element_at(F.split(F.input_file_name(), "/"), -1))
    of = spark.createDataFrame([(p, b) for b, p in parts], "_part string, batch long")
    return rows.join(F.broadcast(of), "_part").select("batch", "qid", "hop", "kind", "detail")
