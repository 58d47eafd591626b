"""Models as column functions: encoder, reranker, rewriter, generator, planner. The defaults are deterministic
stand-ins that need no network; they make the dataflow run and say nothing about any model's quality."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64


def hashed(text: str | None, dim: int = DIM) -> list[float]:
    """Signed hashed bag of words, of unit length; zero without words."""
    v = np.zeros(dim)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h & 0x10000 else -1.0
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """hashed() of a batch at once: each distinct word is hashed once, and all places are summed by one count."""
    for b in batches:
        docs = [(t or "").lower().split() for t in b]
        number: dict[str, int] = {}
        at = np.array([number.setdefault(w, len(number)) for d in docs for w in d], np.int64)
        h = np.array([zlib.crc32(w.encode()) for w in number], np.int64)
        cell = np.repeat(np.arange(len(docs)), [len(d) for d in docs]) * DIM
        v = np.bincount(cell + (h % DIM)[at], np.where(h & 0x10000, 1.0, -1.0)[at], len(docs) * DIM).reshape(-1, DIM) if len(at) else np.zeros((len(docs), DIM))
        n = np.linalg.norm(v, axis=1, keepdims=True)
        yield pd.Series(list(v / np.where(n, n, 1)), index=b.index)


def words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def overlap(query: Column, text: Column) -> Column:
    """Reranker: the share of the query's words that the text has, in steps that tie-breaks settle."""
    q = words(query)
    return F.when(F.size(q) > 0, F.round(F.size(F.array_intersect(q, words(text))) / F.size(q), 5)).otherwise(0.0)


def rewrite(query: Column) -> Column:
    """Reformulation for a retry: only the longer words."""
    long = F.filter(words(query), lambda w: F.length(w) >= 5)
    return F.when(F.size(long) > 0, F.array_join(long, " ")).otherwise(query)


def generate(question: Column, evidence: Column, notes: Column | None = None) -> Column:
    """Extractive: the opening of the best evidence, after the question's. Notes are for models that can follow them."""
    return F.concat(F.lit("Q: "), F.substring(question, 1, 60), F.lit(" A: "), F.substring(F.coalesce(F.get(evidence, F.lit(0)), F.lit("")), 1, 200))


def regenerate(question: Column, evidence: Column, answer: Column, unsupported: Column) -> Column:
    """The answer without the sentences that hold an unsupported label; empty if nothing is left."""
    sentences = F.filter(F.split(answer, "。"), lambda s: ~F.exists(unsupported, lambda u: F.contains(s, u)))
    return F.array_join(sentences, "。")


def no_split(question: Column) -> Column:
    """No model that decomposes: null."""
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Models:
    encode: Callable[[Column], Column] = encode
    rerank: Callable[[Column, Column], Column] = overlap
    rewrite: Callable[[Column], Column] = rewrite
    #: question, evidence, notes on what to answer from or in which order (empty for none) -> an answer.
    generate: Callable[[Column, Column, Column], Column] = generate
    #: question, evidence, answer, labels that the evidence does not have -> another answer, empty for none.
    regenerate: Callable[[Column, Column, Column, Column], Column] = regenerate
    #: question -> a JSON list of sub-questions, or null.
    split: Callable[[Column], Column] = no_split
