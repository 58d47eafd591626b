"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .byte_level import ByteLevelEncoder, is_plain
from .common import PieceEncoder, doc_rows, slices

_ENCODERS: dict = {}


def encoder(path: str, pre: str, width: str = "<u2") -> PieceEncoder:
    """One encoder for each worker process: loading a vocabulary costs more than a batch."""
    key = (path, pre, width)
    if key not in _ENCODERS:
        out = PieceEncoder(path, pre, width=width)
        # The loaded vocabulary is handed on: two of them at once are most of what a worker holds when it starts.
        _ENCODERS[key] = ByteLevelEncoder(path, width=width, tokenizer=out.tokenizer) if pre == "byte" and is_plain(out.tokenizer) else out
    return _ENCODERS[key]


def token_counts(docs: DataFrame, tokenizer: str, pre: str = "word", limit: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row.

    `tokenizer` is the path of a tokenizers JSON file, readable on every executor; `pre` says where its texts can
    be cut (see PieceEncoder). Special strings inside texts follow the library's default; no begin, end, padding
    or truncation. Work goes through batches of bounded bytes; within a batch every text is cut at safe
    boundaries and each distinct piece is encoded once.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows and ids: a row each. Null doc_id: stays null. Empty
    table: no rows. Other columns, also ones named like the results, are ignored. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, pre)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = [x or "" for x in b.column(1).to_pylist()]
                n = enc.lengths(texts)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_rows(docs, text, doc_id).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
