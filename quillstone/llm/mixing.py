"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_rows, free_name, keyed, written

#: Documents of a source that share one running sum, about; a larger source is cut into that many more groups.
GROUP_ROWS = 1_000


def word_count(text: Column) -> Column:
    r"""Words [^\x20\x09-\x0D]+; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, total_share: float, max_epochs: float) -> DataFrame:
    """sources(source, weight, source_size) -> + target.

    Shares total_share x all sizes by weight; no source above max_epochs x its size; what a clamped source leaves
    goes to the others by weight until none is above. Closed form: with sources in ascending order of cap / weight,
    the clamped ones are a prefix, found by running sums. One row for each source takes part, never documents.
    If all caps together are below the total, every source gets its cap. Weight 0 or size 0: target 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    ratio = F.when(F.col("weight") > 0, F.col("source_size") * F.lit(float(max_epochs)) / F.col("weight"))
    order = Window.orderBy(F.col("_ratio").asc_nulls_first(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sources.withColumn("_ratio", ratio).withColumn("_cap", F.when(F.col("weight") > 0, cap).otherwise(0.0))
    s = (
        s.withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("_capped", F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.coalesce("_capped", F.lit(0.0))) / F.nullif("_open", F.lit(0.0)))
        .withColumn("_stops", F.coalesce(F.col("_ratio") <= F.col("_level"), F.lit(True)))
    )
    # The level of the first source that is not clamped holds for all after it.
    level = F.first(F.when(~F.col("_stops"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("_final", level)
    target = F.when(F.col("_stops"), F.col("_cap")).otherwise(F.col("weight") * F.col("_final"))
    return s.select("source", "weight", "source_size", target.alias("target"))


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """sizes(source, ...): weights repeat over the sources in code-point order, null last."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 42, text: str = "text", doc_id: str = "doc_id", source: str = "source", key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of this document, repeats counted).
    And the column `key` of docs as it is, if one is named.

    A source with target / size = w + f gives w whole repetitions of each document and, of its documents in a seeded
    order, whole ones until the fraction f of its words is reached; the document at the edge gives a part of itself.
    So each source's taken words equal its target but for rounding, and no document exceeds max_epochs x its size.

    Large sources are cut by a seeded hash into groups of about GROUP_ROWS documents, each of which meets its share
    of the fraction: a running sum never covers many more, however much of the corpus one source holds, and rows that
    repeat (one id and text, or none) have groups of their own as soon as they would fill one.
    Null text or no words: size 0, taken 0. Null source: a source of its own, last. Repeated rows and ids: each
    counts. Empty table: no rows. The same input and seed give the same result. Other columns are ignored.
    """
    more = [key] if key else []
    d = doc_rows(docs, text, doc_id, source, *more).withColumnRenamed(source, "source").select(*more, "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text", F.lit(seed)).alias("_order2"), F.monotonically_increasing_id().alias("_row"))
    # Sizes are needed twice; the second time they come from here and not from the texts.
    d = written(d, "mix-sizes")
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    filled = water_fill(cyclic_weights(sizes, weights), total_share, max_epochs)
    plan = filled.join(sizes.select("source", "_rows"), filled["source"].eqNullSafe(sizes["source"])).drop(sizes["source"])
    plan = plan.withColumn("_groups", F.ceil(F.col("_rows") / GROUP_ROWS)).withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    # As many rows as sources: a table by itself, so that Spark sees its size before it chooses how to join.
    plan = written(plan.withColumnRenamed("source", "_source"), "mix-plan")
    d = d.join(plan, d["source"].eqNullSafe(plan["_source"])).withColumn("_whole", F.floor("_ratio"))
    # Rows that repeat more often than a group is large have groups of their own, as many as they fill.
    alike = d.groupBy("source", "doc_id", "_order2").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > GROUP_ROWS)
    alike = written(alike.select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("_order2").alias("_o"), F.ceil(F.col("_n") / GROUP_ROWS).alias("_parts")), "mix-repeated")
    d = d.join(alike, d["source"].eqNullSafe(alike["_s"]) & d["doc_id"].eqNullSafe(alike["_d"]) & (d["_order2"] == alike["_o"]), "left")
    own = F.xxhash64("doc_id", "_order2", F.pmod(F.col("_row"), F.col("_parts"))).bitwiseAND(F.lit((1 << 62) - 1))
    d = d.withColumn("_group", F.when(F.col("_parts").isNotNull(), -1 - own).otherwise(F.pmod(F.xxhash64("doc_id", "_order2", F.lit(seed)), F.col("_groups"))))
    order = F.xxhash64(F.lit(seed + 1), "doc_id", "_order2")
    group = Window.partitionBy("source", "_group")
    run = group.orderBy(order, "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_before", F.sum("size").over(run) - F.col("size")).withColumn("_words", F.sum("size").over(group))
    rest = F.round(F.col("_words") * (F.col("_ratio") - F.col("_whole"))).cast("long") - F.col("_before")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return d.select(*more, "doc_id", "source", "size", "source_size", "target", (F.col("_whole") * F.col("size") + part).cast("long").alias("taken"))


def repeated(docs: DataFrame, taken: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixed corpus itself: each document as many times as it was taken, a part of half or more counting as once.

    docs must have a unique, non-null `key`, and taken the same; columns stay as they are. Empty tables: no rows.
    mixed() takes any rows.
    """
    mine, times = free_name(docs, "_doc"), free_name(docs, "_times")
    often = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    counts = taken.select(F.col(key).alias(mine), often.alias(times)).filter(F.col(times) > 0)
    out = docs.join(counts, F.col(f"`{key}`") == F.col(mine)).withColumn(times, F.explode(F.sequence(F.lit(1), times)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """The mixed corpus: each row of docs, all columns as they are, as many times as mix() takes it. Nulls, empty
    texts, ties and empty tables: as mix() says.

    Rows are told apart by a key of their own, written once: null and repeated ids lose and multiply nothing.
    """
    rows, key = keyed(docs, "mix-rows")
    return repeated(rows, mix(rows, weights, total_share, max_epochs, key=key), key).drop(key)
