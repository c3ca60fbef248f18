"""Mixing sources to target weights.

Word counts are summed per source; a source's target over its size is its repetition rate; each document is emitted
floor(rate) times, and once more with a probability equal to the rest, drawn from a hash of its id and text. All of it is
DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import same, stored, text_of

#: Weights of the sources by code point, repeating.
WEIGHTS = (1, 2, 3)
#: A target stops at this many times the source's size.
MOST = 3
SEED = "mix-1"


def size_of(text: str = "text") -> Column:
    """The number of ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 32 bits of a hash of the seed, the id and the text; only rows that are equal in both share one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row for each source of ``sizes`` (source, size).

    Sources rank by code point, null last, and take the weights in turn. A target above ``most`` times its source's size
    stops there, and the excess is shared by weight among the others, until none is above. Each round is one aggregate
    over the table of sources; the driver sees two sums. The rank is made in ranges of the sorted sources, so no task
    holds them all.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = stored(table.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    from pyspark.sql import Window

    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(parts), F.lit(0))).select("part", "before")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    ranked = stored(ranged.join(before, "part").select("source", "source_size", weight.alias("weight")))

    limit = F.col("source_size") * most
    above = F.lit(False)  # over the limit under the last share
    capped, left = 0, None
    while True:
        sums = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, limit).otherwise(0)).alias("capped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weights"), F.count(F.when(above, 1)).alias("n")).first()
        if left is not None and sums["n"] == capped:
            break
        capped, left = sums["n"], sums
        if not sums["all"] or not sums["weights"]:
            break
        above = F.col("weight") * (left["all"] - left["capped"]) > limit * left["weights"]
    if not left["all"] or not left["weights"]:
        return ranked.select("source", "source_size", limit.cast("double").alias("target"))
    share = (F.col("weight") * (left["all"] - left["capped"])).cast("double") / F.lit(float(left["weights"]))
    return ranked.select("source", "source_size", F.when(above, limit.cast("double")).otherwise(share).alias("target"))


def copies(drawn: Column) -> Column:
    """How often a document is emitted, from its draw, and target and source_size beside it."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixed_report(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted).

    Null and empty texts have size 0; a null source is a source; rows that are equal in id and text share one draw, all
    others have draws of their own, also those without an id; sources of size 0 have target 0. Other columns of ``docs`` aren't returned.
    """
    rows = stored(docs.select("doc_id", "source", size_of().alias("size"), draw(F.col("doc_id"), F.col("text")).alias("drawn")))
    table = stored(targets(rows))
    return rows.join(table, same(rows, table, "source"), "left").select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("drawn"))).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The documents as often as the mix takes them, with their columns; their names can't clash with ours."""
    table = stored(targets(docs.select("source", size_of().alias("size")))).select(F.col("source").alias("__s"), "source_size", "target")
    rows = docs.select(F.col("source").alias("__source"), draw(F.col("doc_id"), F.col("text"), seed).alias("__drawn"), F.struct(*(docs[c] for c in docs.columns)).alias("__row"))
    taken = rows.join(table, rows["__source"].eqNullSafe(table["__s"])).withColumn("__n", copies(F.col("__drawn"))).where("__n > 0")
    return taken.select("__row", F.explode(F.expr("sequence(1L, __n)")).alias("__k")).select("__row.*")
