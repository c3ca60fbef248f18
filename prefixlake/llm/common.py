"""Helpers shared by the corpus operators: shared-folder tables, words, and small Column idioms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlake.sources.stored import shared_dir, stored

__all__ = ["WHITE", "documents", "joined_to", "let", "same", "shared_dir", "stored", "text_of", "without_white", "words"]

#: The separators of words: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def without_white(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of columns of both sides."""
    out = F.lit(True)
    for name in names:
        out &= left[name].eqNullSafe(right[name])
    return out


def joined_to(left: DataFrame, right: DataFrame, key: str, how: str = "left", share: int = 1000) -> DataFrame:
    """``left`` (stored; any number of rows of a key) joined with ``right`` (stored; a row for each key) on ``key``.

    Keys with more than one in ``share`` of the rows of ``left`` are at most ``share``: they meet their rows of ``right``
    by a broadcast, so no task gets a hot key's rows; all other keys meet by a join that Catalyst plans.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("__n"))
    total = left.count()
    hot = stored(counts.where(F.col("__n") * share > total).select(key))
    if not hot.limit(1).count():
        return left.join(right, key, how)
    few = F.broadcast(hot)  # at most ``share`` rows
    dealt = left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how)
    return dealt.unionByName(left.join(few, key, "left_anti").join(right.join(few, key, "left_anti"), key, how))
