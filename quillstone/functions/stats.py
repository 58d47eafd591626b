"""Ranking metrics, bootstrap intervals, exact sign tests, threshold sweeps, confusion matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def recall_at(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def reciprocal(rank: Column) -> Column:
    """0 where the gold row is not in the list."""
    return F.coalesce(1.0 / rank, F.lit(0.0))


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole, halves to the even digit as Python rounds; 0 for nothing."""
    return F.when(whole != 0, F.bround(part / whole, digits)).otherwise(0.0)


def by_group_and_all(df: DataFrame, group: str, *aggs: Column) -> DataFrame:
    """Each group, and "all", in one pass (grouping sets)."""
    return df.groupingSets([[F.col(group)], []], F.col(group)).agg(F.grouping(group).alias("_all"), *aggs).withColumn(group, F.when(F.col("_all") == 1, "all").otherwise(F.col(group).cast("string"))).drop("_all")


def hash_index(k: Column, i: Column, n: Column | int, seed: int) -> Column:
    """The row that draw i of resample k takes, from md5: the same in any engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", k.cast("string"), i.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, n if isinstance(n, Column) else F.lit(n))


#: Parts into which an ordered table is cut for running sums and numbers.
PARTS = 64


def parted(df: DataFrame, column: str, name: str) -> DataFrame:
    """df and the part of the column's range that each row is in: fixed bounds, so a row's part never changes. Equal
    values are in one part."""
    bounds = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / PARTS for i in range(1, PARTS)], 1000)).first()[0]
    above = [F.when(F.col(column) > F.lit(b), 1).otherwise(0) for b in sorted(set(bounds or []))]
    return df.withColumn(name, sum(above, F.lit(0)))


def running(df: DataFrame, column: str, **values: Column) -> DataFrame:
    """df and, for each name, the sum of its value over all rows before it, in the order of a column of distinct numbers:
    sums within parts of the column's range, and the sums of the parts before."""
    rows = parted(df, column, "_part").withColumns({f"_v_{n}": v for n, v in values.items()})
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_part").agg(*[F.sum(f"_v_{n}").alias(n) for n in values])
    before = sums.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)).alias(f"_i_{n}") for n in values])
    # At most PARTS rows.
    out = rows.join(F.broadcast(before), F.col("_part") == F.col("_p"))
    return out.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_i_{n}")).alias(n) for n in values])


def bootstrap(values: DataFrame, value: str, order: str, resamples: int, seed: int) -> DataFrame:
    """n, mean, low, high: the 2.5 and 97.5 percentiles of the means of resamples drawn by hash_index.

    `order` is a column of distinct numbers, by which values are numbered. Every value makes a draw in each resample;
    draws meet the values by number. The work is n x resamples, dealt out by number. Nulls do not take part. An empty
    table gives n = 0 and nulls.
    """
    v = running(values.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.col(order).alias("_o")), "_o", i=F.lit(1).cast("long")).select("v", "i")
    size = v.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"))
    # One row of two numbers goes to every task, and each row is repeated once for each resample.
    draws = v.select("i").crossJoin(F.broadcast(size.select("n"))).select(F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("k"), "i", "n")
    draws = draws.select("k", hash_index(F.col("k"), F.col("i"), F.col("n"), seed).alias("i"))
    means = draws.join(v, "i").groupBy("k").agg(F.avg("v").alias("m"))
    ends = means.agg(F.expr("percentile(m, 0.025)").alias("low"), F.expr("percentile(m, 0.975)").alias("high"))
    return size.crossJoin(ends)


def excludes_zero(low: Column, high: Column) -> Column:
    """Whether an interval lies on one side of zero; null: no."""
    return F.coalesce((low > 0) | (high < 0), F.lit(False))


def bootstrap_numpy(values: np.ndarray, resamples: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """Mean, low, high, by numpy's default generator; NaN for no values. Draws 1,000 resamples at a time."""
    v = np.asarray(values, float)
    if not len(v):
        return (float("nan"),) * 3
    rng = np.random.default_rng(seed)
    means = np.concatenate([v[rng.integers(0, len(v), (min(1000, resamples - at), len(v)))].mean(1) for at in range(0, resamples, 1000)])
    return float(v.mean()), float(np.percentile(means, 2.5)), float(np.percentile(means, 97.5))


#: At most so many of 2^32 draws give a count of 0, 1, ... (Poisson with mean 1).
POISSON = (1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817)
#: Draws that one md5 gives.
_DRAWS = 4


def intervals(df: DataFrame, key: str, metrics: dict[str, Column], group: str | None = None, resamples: int = 200, seed: int = 0) -> DataFrame:
    """group, metric, n, mean, low, high: each metric's mean and the 2.5 and 97.5 percentiles of its resampled means, for
    each group (as a string; null as "null") and for all rows ("all").

    How often a row counts in a resample is a Poisson draw by a hash of its key and the resample, the limit of drawing rows
    with replacement; a resample is two sums, which merge. So rows stay where they are: a task keeps `resamples` sums for
    each group and metric, and only those are shuffled. Nulls of a metric take no part in it; a metric without values has
    n = 0 and nulls. Rows that share a key are drawn alike: it should be distinct.
    """
    named = F.coalesce(F.col(group).cast("string"), F.lit("null")) if group else F.lit("all")
    rows = df.select(named.alias("group"), F.col(key).cast("string").alias("_key"), *[m.cast("double").alias(f"m_{n}") for n, m in metrics.items()])
    blocks = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // _DRAWS) - 1))))
    h = F.md5(F.concat_ws("|", "_key", F.col("_b").cast("string"), F.lit(str(seed))))
    drawn = [F.struct((F.col("_b") * _DRAWS + j).alias("k"), F.conv(F.substring("_h", 1 + 8 * j, 8), 16, 10).cast("long").alias("u")) for j in range(_DRAWS)]
    # Resample -1 is the table itself: every row once.
    itself = F.when(F.col("_b") == 0, F.array(F.struct(F.lit(-1).alias("k"), F.lit(POISSON[0]).cast("long").alias("u"))))
    blocks = blocks.withColumn("_h", h).withColumn("_d", F.explode(F.concat(F.array(*drawn), F.coalesce(itself, F.array().cast("array<struct<k:int,u:bigint>>"))))).filter(F.col("_d.k") < resamples)
    times = sum([(F.col("_d.u") >= t).cast("int") for t in POISSON], F.lit(0)).cast("double")
    weighed = blocks.select("group", F.col("_d.k").alias("k"), times.alias("w"), *[f"m_{n}" for n in metrics]).filter("w > 0")
    sums = [x for n in metrics for x in (F.sum(F.col("w") * F.col(f"m_{n}")).alias(f"s_{n}"), F.sum(F.when(F.col(f"m_{n}").isNotNull(), F.col("w"))).alias(f"c_{n}"))]
    sets = [[F.col("group"), F.col("k")], [F.col("k")]] if group else [[F.col("group"), F.col("k")]]
    by = weighed.groupingSets(sets, F.col("group"), F.col("k")).agg(F.grouping("group").alias("_all"), *sums).withColumn("group", F.when(F.col("_all") == 1, "all").otherwise(F.col("group")))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"s_{n}").alias("s"), F.col(f"c_{n}").alias("c")) for n in metrics]))
    means = by.select("group", "k", each.alias("x")).select("group", "k", "x.*").withColumn("m", F.col("s") / F.nullif(F.col("c"), F.lit(0.0)))
    own, others = F.col("k") == -1, F.when(F.col("k") >= 0, F.col("m"))
    return means.groupBy("group", "metric").agg(
        F.coalesce(F.max(F.when(own, F.col("c"))), F.lit(0)).cast("long").alias("n"), F.max(F.when(own, F.col("m"))).alias("mean"),
        F.percentile(others, F.lit(0.025)).alias("low"), F.percentile(others, F.lit(0.975)).alias("high"),
    )


def sign_test(up: Column, down: Column) -> Column:
    """Exact two-sided p of `up` against `down` flips: min(1, 2 * sum_{i <= min} C(n, i) / 2^n); 1 without flips."""
    n, k = (up + down).cast("double"), F.least(up, down)
    # C(n, i) / 2^n by its logarithm, each from the one before: no factorial, which ends at 20.
    state = lambda at, total: F.struct(at.alias("at"), total.alias("total"))
    step = lambda s, i: state(s["at"] + F.log((n - i + 1) / i), s["total"] + F.exp(s["at"] + F.log((n - i + 1) / i)))
    first = -n * F.log(F.lit(2.0))
    places = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(places, state(first, F.exp(first)), step)["total"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def threshold_sweep(scored: DataFrame, score: str, inside: str) -> DataFrame:
    """threshold, false_rejects, false_accepts, errors for every distinct score: rejects are inside rows below it,
    accepts are outside rows at or above it. By running sums over distinct scores, so each row is read once."""
    by = scored.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(inside)).alias("a"), F.count_if(~F.col(inside)).alias("b"))
    total = by.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("_all"))
    out = running(by, "threshold", false_rejects=F.col("a"), _below=F.col("b"))
    out = out.crossJoin(F.broadcast(total)).withColumn("false_accepts", F.col("_all") - F.col("_below"))
    return out.select("threshold", "false_rejects", "false_accepts", (F.col("false_rejects") + F.col("false_accepts")).alias("errors"))


def confusion(df: DataFrame, gold: str, predicted: str, classes: list[str]) -> DataFrame:
    """A row for each gold class: a count for each predicted class, n, recall."""
    counts = df.groupBy(gold).agg(*[F.count_if(F.col(predicted) == c).alias(c) for c in classes], F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(gold) == F.col(predicted), 1.0).otherwise(0.0)).alias("recall"))
    return counts


def interval_text(point: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", point, low, high)


class SuffixAutomaton:
    """All substrings of a text in a linear number of states, built character by character."""

    def __init__(self, text: str):
        self.moves: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            new = self._state({}, self.length[last] + 1, 0)
            at = last
            while at >= 0 and c not in self.moves[at]:
                self.moves[at][c] = new
                at = self.link[at]
            if at >= 0:
                to = self.moves[at][c]
                if self.length[to] > self.length[at] + 1:
                    # The shorter substrings that end in this state part from the longer ones.
                    part = self._state(dict(self.moves[to]), self.length[at] + 1, self.link[to])
                    while at >= 0 and self.moves[at].get(c) == to:
                        self.moves[at][c] = part
                        at = self.link[at]
                    self.link[to] = to = part
                self.link[new] = to
            last = new

    def _state(self, moves: dict[str, int], length: int, link: int) -> int:
        self.moves.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.moves) - 1

    def longest_in(self, other: str) -> int:
        """Length of the longest substring of the text that the other has too; linear in the other."""
        best = size = at = 0
        for c in other:
            while at and c not in self.moves[at]:
                at = self.link[at]
                size = self.length[at]
            if c in self.moves[at]:
                at, size = self.moves[at][c], size + 1
                best = max(best, size)
        return best


def longest_common_substring(a: str, b: str) -> int:
    """Length of the longest run of characters that both have, in time linear in both."""
    short, long = sorted((a, b), key=len)
    return SuffixAutomaton(short).longest_in(long) if short else 0


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """longest_common_substring of each row; null counts as empty."""
    return pd.Series([longest_common_substring(x or "", y or "") for x, y in zip(a, b, strict=True)])
