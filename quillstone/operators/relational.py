"""Filters, joins, set operations, groupings and rankings over chunk-like tables, set-oriented."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def supplied(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters; a value that is None, empty, zero or false is not supplied and does not filter."""
    for name, value in equal.items():
        if value:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def containing(df: DataFrame, column: str, part: str | None) -> DataFrame:
    """Rows whose column has `part` as it stands (case and wildcards are ordinary characters); none given: all."""
    return df.filter(F.contains(F.col(column), F.lit(part))) if part else df


def within(df: DataFrame, column: str, ids: DataFrame | None, id_column: str | None = None) -> DataFrame:
    """Three-valued id filter: None leaves df as it is, an empty table gives no rows, else a semi-join."""
    if ids is None:
        return df
    return df.join(ids.select(F.col(id_column or column).alias(column)).distinct(), column, "left_semi")


def either_side(left: DataFrame, edges: DataFrame, on: tuple[str, str], left_test: Column, edge_test: Column) -> DataFrame:
    """Rows of left that pass left_test, or have an edge that passes edge_test; each once.

    A left join with a disjunction and DISTINCT, written as a filter or a semi-join of the tested edges: the edges
    are filtered before they meet anything, and no row is multiplied. left must have unique rows.
    """
    hit = edges.filter(edge_test).select(F.col(on[1]).alias("_hit")).distinct()
    joined = left.join(hit, left[on[0]] == hit["_hit"], "left")
    return joined.filter(F.coalesce(left_test, F.lit(False)) | F.col("_hit").isNotNull()).drop("_hit")


def by_law(chunks: DataFrame, edges: DataFrame, law: str | None) -> DataFrame:
    """chunks(id, primary_law, ...), edges(chunk_id, article_full): the chunks that come from a law's article or refer to it.
    A law without an article: those that come from it alone, and the edges are not read. No law: all. Each chunk once."""
    if not law:
        return chunks
    own = F.col("primary_law") == law
    article = re.search(r"第(\d+(?:之[一二三四五]|之\d+)?)條", law)
    return either_side(chunks, edges, ("id", "chunk_id"), own, F.col("article_full") == article[1]) if article else chunks.filter(own)


def replayed(records: DataFrame, miss: bool = False, grep: str | None = None, question: str = "question", hit: str = "hit") -> DataFrame:
    """The records of a run that are shown: with miss, those without a hit (null counts as none); with grep, those whose
    question has the text as it stands."""
    out = records.filter(~F.coalesce(F.col(hit), F.lit(False))) if miss else records
    return containing(out, question, grep)


def keep_first(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """One row for each text, white space at its ends aside: the first by `order`. Null texts are one text.

    By aggregation (min over a struct), not by a window: the partial minimum is taken before the shuffle, so a text
    that a third of all rows share is one row for each task. Texts meet by their digest (SHA-256), not as keys.
    """
    stripped = F.sha2(F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", ""), 256)
    rest = [c for c in df.columns if c not in order]
    best = df.groupBy(stripped.alias("_key")).agg(F.min(F.struct(*order)).alias("_first"), F.min_by(F.struct(*rest), F.struct(*order)).alias("_rest"))
    cols = [F.col(f"_first.{c}") if c in order else F.col(f"_rest.{c}") for c in df.columns]
    return best.select(*[c.alias(n) for c, n in zip(cols, df.columns, strict=True)])


def co_occurring(edges: DataFrame, group: str, item: str, start: Column, top: int = 10) -> DataFrame:
    """Items that share a group with an item that passes `start`, itself aside: item, n (distinct groups).

    The self-join meets only the groups that hold a start item. Ties: by item.
    """
    seeds = edges.filter(start).select(F.col(group).alias("_g"), F.col(item).alias("_start")).distinct()
    pairs = edges.select(group, item).distinct().join(seeds, F.col(group) == F.col("_g")).filter(F.col(item) != F.col("_start"))
    return pairs.groupBy(item).agg(F.countDistinct(group).alias("n")).orderBy(F.desc("n"), item).limit(top)


def top_counts(df: DataFrame, keys: Sequence[str], top: int, name: str = "n") -> DataFrame:
    """GROUP BY keys, COUNT(*), the largest first; ties by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), *keys).limit(top)


def top_distinct(df: DataFrame, keys: Sequence[str], counted: str, top: int, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(counted).alias(name)).orderBy(F.desc(name), *keys).limit(top)


def with_none_bucket(df: DataFrame, key: str, label: str = "(none)") -> DataFrame:
    """Counts by key; null is a bucket of its own under `label`."""
    return df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(label)).alias(key)).agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, by: Sequence[str], score: Column, tie: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """1-based places within `by`, best score first, then `tie`."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), *tie)))


def quota_fill(df: DataFrame, by: Sequence[str], first: Column, score: Column, k: int, tie: Sequence[str]) -> DataFrame:
    """Guaranteed rows first, then the best of the others, up to k rows of each group."""
    w = Window.partitionBy(*by).orderBy(F.when(first, 0).otherwise(1), score.desc(), *tie)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def first_wins(df: DataFrame, by: Sequence[str], key: str, order: Sequence[str]) -> DataFrame:
    """Union-distinct of ranked lists: of rows with one key in a group, the first by `order` stays."""
    w = Window.partitionBy(*by, key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def bag_union(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left, and the rows of right that left does not have by `on`."""
    return left.unionByName(right.join(left.select(*on).distinct(), list(on), "left_anti"))


def partition_check(everything: DataFrame, kept: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """One row: n, kept, rejected, in_both, in_neither (counts of keys). The parts are a partition if the last two are 0."""
    marks = [df.select(F.col(key).alias("_k"), *[F.lit(i == j).alias(c) for j, c in enumerate("akr")]) for i, df in enumerate((everything, kept, rejected))]
    by = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy("_k").agg(*[F.bool_or(c).alias(c) for c in "akr"])
    a, k, r = (F.col(c) for c in "akr")
    return by.agg(F.count_if(a).alias("n"), F.count_if(k).alias("kept"), F.count_if(r).alias("rejected"), F.count_if(k & r).alias("in_both"), F.count_if(a & ~k & ~r).alias("in_neither"))


def quota_sample(df: DataFrame, by: str, key: str, quota: int, seed: int) -> DataFrame:
    """`quota` rows of each class in the order of md5(seed|key): the same rows wherever it runs."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return ranked(df.withColumn("_h", order), [by], F.lit(0), ["_h", key], "place").filter(F.col("place") <= quota).drop("_h")


def three_way_split(df: DataFrame, key: str, seed: int, shares: tuple[int, int] = (70, 15)) -> DataFrame:
    """train, val or test by a hash of the key, in hundredths: no sort of all rows, and a row never moves."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(100))
    return df.withColumn("split", F.when(bucket < shares[0], "train").when(bucket < sum(shares), "val").otherwise("test"))
