"""Question sets from chunks: a quota of each kind without near duplicates, a question for each, filters, one retry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import lcs_udf
from ..functions.text import strip
from ..operators.relational import ranked
from ..operators.similarity import knn
from ..stages import Stages

#: Characters of a chunk and of a question, the longest run that a question may share with its chunk, and
#: how near the next chunk may be.
CHUNK, QUESTION, COPIED, NEAR = (120, 900), (12, 60), 12, 0.97

Ask = Callable[[Column, Column], Column]


def sampled_chunks(chunks: DataFrame, quota: dict[str, int], stages: Stages, seed: int = 42, seen: DataFrame | None = None, lengths: tuple[int, int] = CHUNK, near: float = NEAR) -> DataFrame:
    """chunks(cid, kind, text, embedding) -> cid, kind, text: of each kind `quota` chunks in a seeded order, of a fitting
    length, not in seen(cid), and without another chunk as near as `near`.

    A kind's first quota chunks in the order are looked up; where near duplicates drop some, the next ones follow, twice
    as many each time, until the quota is full or the kind is used up. So few chunks are searched, and none is missed.
    """
    fits = chunks.filter(F.length("text").between(*lengths) & F.col("kind").isin(*quota) & F.col("embedding").isNotNull())
    if seen is not None:
        fits = fits.join(seen.select("cid"), "cid", "left_anti")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("cid").cast("string")))
    pool = stages.table(ranked(fits.select("cid", "kind", order.alias("_h")), ["kind"], F.lit(0), ["_h", "cid"], "place").drop("_h"), "pool")
    sizes = {r["kind"]: r["n"] for r in pool.groupBy("kind").agg(F.max("place").alias("n")).toLocalIterator()}
    done = {k: 0 for k in sizes}
    clean, step, have = None, 1, dict[str, int]()
    while todo := {k: n for k, n in sizes.items() if done[k] < n and have.get(k, 0) < quota[k]}:
        upto = {k: min(n, done[k] + quota[k] * step) for k, n in todo.items()}
        inside = F.lit(False)
        for k, n in upto.items():
            inside = inside | ((F.col("kind") == k) & F.col("place").between(done[k] + 1, n))
        asked = pool.filter(inside).join(chunks.select("cid", "embedding"), "cid")
        twins = knn(asked.withColumnRenamed("cid", "vec"), chunks.select(F.col("cid").alias("vec"), "embedding"), 1, "vec", "vec").filter(F.col("score") >= near).select(F.col("qid").alias("cid"))
        fresh = stages.table(asked.select("cid", "kind", "place").join(twins, "cid", "left_anti"), "fresh")
        clean = fresh if clean is None else clean.unionByName(fresh)
        done |= upto
        step *= 2
        have = {r["kind"]: r["n"] for r in clean.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    if clean is None:
        return chunks.limit(0).select("cid", "kind", "text")
    most = F.element_at(F.create_map(*[F.lit(x) for k, n in quota.items() for x in (k, n)]), F.col("kind"))
    picked = ranked(clean, ["kind"], F.lit(0), ["place"], "rank").filter(F.col("rank") <= most).select("cid")
    return chunks.join(F.broadcast(picked), "cid").select("cid", "kind", "text")


def _checked(question: Column, text: Column, lengths: tuple[int, int], copied: int) -> Column:
    """struct(question, lcs, reason): why a question is not taken, null for a good one."""
    q = strip(question)
    lcs = lcs_udf(q, text)
    reason = F.when(q.isNull(), "no reply").when(~F.length(q).between(*lengths), "length").when(lcs > copied, "copied")
    return F.struct(q.alias("question"), lcs.alias("lcs"), reason.alias("reason"))


def question_set(chunks: DataFrame, ask: Ask, stages: Stages, lengths: tuple[int, int] = QUESTION, copied: int = COPIED) -> DataFrame:
    """chunks(cid, kind, text) -> cid, kind, question, lcs, attempts, reason: a question for each chunk by ask(text,
    attempt), where attempt is 1, or 2 for those whose first question was too short, too long or copied. A failed reply
    (null) is not asked again. reason is null for what is accepted; a rejected one keeps its first question and reason."""
    first = stages.table(chunks.select("cid", "kind", "text", ask(F.col("text"), F.lit(1)).alias("_q")), "asked")
    first = stages.table(first.select("cid", "kind", "text", _checked(F.col("_q"), F.col("text"), lengths, copied).alias("a")), "checked")
    # Only the rejected ones are asked again.
    again = first.filter(F.col("a.reason").isin("length", "copied")).select("cid", "text", ask(F.col("text"), F.lit(2)).alias("_q"))
    second = stages.table(again.select("cid", _checked(F.col("_q"), F.col("text"), lengths, copied).alias("b")), "again")
    out = first.join(second, "cid", "left")
    better = F.col("b").isNotNull() & F.col("b.reason").isNull()
    best = F.when(better, F.col("b")).otherwise(F.col("a"))
    return out.select("cid", "kind", best["question"].alias("question"), best["lcs"].alias("lcs"), F.when(F.col("b").isNotNull(), 2).otherwise(1).alias("attempts"), best["reason"].alias("reason"))
