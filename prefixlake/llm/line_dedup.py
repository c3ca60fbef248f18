"""Line dedup: windows of three consecutive lines that occur again are removed, all but the first occurrence.

Windows compare by 128 bits of hash. The first occurrence in the corpus is that of the smallest doc_id (null last), then
digest of the text, then line. The lines that later occurrences cover are merged into runs and cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import let, stored, text_of, without_white

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def window_hashes(text: Column) -> Column:
    """Array of the hash of each window of lines (two numbers of 64 bits), null for windows without a word."""

    def hashed(lines: Column) -> Column:
        n = F.size(lines) - (WINDOW - 1)
        one = lambda i: let(F.slice(lines, i, WINDOW), lambda w: F.when(without_white(F.array_join(w, "")) != "", F.struct(F.xxhash64(w).alias("h"), F.xxhash64(F.lit(1), w).alias("g"))))
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one)).otherwise(F.array().cast("array<struct<h:bigint,g:bigint>>"))

    return let(lines_of(text), hashed)


def keys(docs: DataFrame) -> DataFrame:
    """A document's key: its id and a digest of its text. Rows that are equal in both are one document."""
    return docs.withColumn("__digest", F.xxhash64(text_of(), F.lit(1)))


def later_windows(docs: DataFrame) -> DataFrame:
    """doc_id, __digest, starts: for each document with any, the lines (from 0) where a later occurrence of a window begins.

    Counting is combined before the shuffle; the table of repeated windows, one row for each, meets the windows again in
    a join that Spark splits where one window holds many rows.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__digest", "at")
    windows = stored(keys(docs.select("doc_id", "text")).select("doc_id", "__digest", F.posexplode(window_hashes(text_of())).alias("at", "w")).where("w IS NOT NULL").select("doc_id", "__digest", "at", "w.h", "w.g"))
    repeated = windows.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "g", "first")
    later = windows.join(repeated, ["h", "g"]).where(place != F.col("first")).select("doc_id", "__digest", "at")
    return later.groupBy("doc_id", "__digest").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def cut(lines: Column, starts: Column) -> Column:
    """The lines outside the merged windows that begin at ``starts`` (ascending)."""
    end = lambda k: F.coalesce(F.get(starts, k - 1) + WINDOW, F.lit(0))  # noqa: E731  where the window before ends
    kept = F.transform(starts, lambda s, k: F.slice(lines, end(k) + 1, F.greatest(s - end(k), F.lit(0))))
    tail = let(F.element_at(starts, -1) + WINDOW, lambda e: F.slice(lines, e + 1, F.greatest(F.size(lines) - e, F.lit(0))))
    return F.concat(F.flatten(kept), tail)


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with text cut, and the columns n_lines and n_removed (long) after the others; names that clash are replaced.

    A null text stays null and an empty one empty; a text of fewer than three lines stays as it is. A text whose lines
    all go becomes empty, and its row stays. Repeated rows (equal doc_id and text) are one document and get one result.
    """
    starts = stored(later_windows(docs)).select(F.col("doc_id").alias("__id"), F.col("__digest").alias("__of"), F.col("starts").alias("__starts"))
    rows = keys(docs)
    # both sides grow with the corpus: always a shuffle join
    joined = rows.join(starts.hint("merge"), rows["doc_id"].eqNullSafe(starts["__id"]) & (rows["__digest"] == starts["__of"]), "left")
    lines = lines_of(F.col("text"))
    left = F.when(F.col("__starts").isNotNull(), let(lines, lambda x: let(F.col("__starts"), lambda s: cut(x, s)))).otherwise(lines)
    out = joined.withColumn("__left", left)
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    cols = [F.array_join("__left", "\n").alias(c) if c == "text" else out[c] for c in docs.columns if c not in ("n_lines", "n_removed")]
    total = F.when(F.col("text").isNull(), 0).otherwise(count(lines))
    return out.select(*cols, total.alias("n_lines"), (total - F.when(F.col("text").isNull(), 0).otherwise(count(F.col("__left")))).alias("n_removed"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_lines, n_removed of every document."""
    return dedup(docs.select("doc_id", "text"))

