"""Quality rules with adaptive thresholds.

Each text gets four ratios (word length, symbols, repeated lines, repeated word runs). A quantile sketch of each ratio
is kept per language and source, of the texts that pass the base rules; a fence stands beyond a tail quantile of that sketch, by a multiple of the way from the
median to it (and a small floor), and documents outside a fence are rejected. Ratios that are zero in most texts have
their tail at the 99th percentile, so that a source's own few repeats set its fence. The sketch counts values in bins of fixed relative width (1/64, exact below 128), so
sketches merge by adding counts, in any order, with the same result; small groups use the merged sketch of their
language, and then that of the whole corpus.

All of it is DataFrame functions: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import let, same, stored, text_of, without_white, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: Documents from which a group of language and source has thresholds of its own.
MIN_DOCS = 200
#: Of each metric: the tail quantile (per mille), how many times the way from the median to it a fence stands beyond, and what it stands further in any case, in thousandths.
FENCES = {"word_len": (900, 3, 500), "symbols": (900, 3, 20), "dup_lines": (990, 1, 20), "repeats": (990, 1, 20)}
#: Metrics with a lower fence as well.
TWO_SIDED = ("word_len",)
METRICS = tuple(FENCES)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(w: Column) -> Column:
    """Words inside runs of WINDOW words that the text holds twice or more. Runs compare by 64-bit hash."""

    def covered(runs: Column) -> Column:
        pairs = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(pairs, lambda p: F.filter(p, lambda e, k: F.coalesce(F.get(p, k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(p, k + 1)["h"] == e["h"], F.lit(False))))
        starts = F.sort_array(F.transform(again, lambda e: e["i"]))
        widths = let(starts, lambda q: F.transform(q, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    # the hash of a run of 8 joins those of 4 pairs of words
    pairs = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    runs = let(pairs, lambda a: F.slice(F.transform(a, lambda x, i: F.xxhash64(x, *(F.get(a, i + k) for k in range(2, WINDOW, 2)))), 1, F.size(a) - (WINDOW - 1)))
    count = let(runs, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(w) > WINDOW, count).otherwise(0).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one more column, the struct ``quality``: the base counts and the ratios in thousandths.

    A null text counts as empty; a text without words has null ratios, and fails the base rules.
    """
    lines = F.filter(F.split(text_of(text), "\n"), lambda x: without_white(x) != "")
    parts = docs.withColumn("quality", F.struct(words(text_of(text)).alias("w"), lines.alias("l")))
    w, n = F.col("quality.w"), F.size("quality.w").cast("long")
    counted = parts.withColumn("quality", F.struct(
        n.alias("n_words"),
        F.length(without_white(text_of(text))).cast("long").alias("word_chars"),
        (F.length(text_of(text)) - F.length(F.translate(text_of(text), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("quality.l") - F.size(F.array_distinct("quality.l"))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
        F.size("quality.l").cast("long").alias("n_lines"),
    ))
    q = lambda k: F.col(f"quality.{k}")
    ratio = lambda a, b: F.when(q(b) > 0, F.floor(q(a) * 1000 / q(b)).cast("long"))
    return counted.withColumn("quality", F.struct(
        *(q(k).alias(k) for k in BASE),
        ratio("word_chars", "n_words").alias("word_len"),
        ratio("n_symbols", "n_words").alias("symbols"),
        ratio("n_dup_lines", "n_lines").alias("dup_lines"),
        ratio("n_repeat_words", "n_words").alias("repeats"),
        ((q("n_words") < MIN_WORDS) | (100 * q("n_repeat_words") > REPEAT_PERCENT * q("n_words"))).alias("base_failed"),
    ))


def sketch(rows: DataFrame) -> DataFrame:
    """Mergeable sketches: the count of each (lang, source, metric, bin). ``rows`` has lang, source and the struct quality."""
    values = rows.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"quality.{m}").alias("v")) for m in METRICS))).alias("m"))
    bits = "greatest(length(bin(m.v)) - 7, 0)"
    return values.where("m.v IS NOT NULL").groupBy("lang", "source", F.col("m.metric").alias("metric"), F.expr(f"shiftleft(shiftright(m.v, {bits}), {bits})").alias("bin")).agg(F.count("*").alias("n"))


def fences(bins: DataFrame, *keys: str) -> DataFrame:
    """A row for each value of ``keys``: docs, and for each metric low_ and high_, from the merged sketches."""
    from pyspark.sql import Window

    merged = bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("docs", F.sum("n").over(group))
    of_metric = lambda k: F.create_map(*(x for m, f in FENCES.items() for x in (F.lit(m), F.lit(f[k]))))[F.col("metric")]
    at = lambda share: F.min(F.when(F.col("upto") * 1000 >= F.col("docs") * share, F.col("bin")))
    quantiles = ranked.groupBy(*keys, "metric").agg(F.max("docs").alias("docs"), at(1000 - of_metric(0)).alias("low"), at(F.lit(500)).alias("mid"), at(of_metric(0)).alias("high"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    return quantiles.groupBy(*keys).agg(
        F.max("docs").alias("docs"),
        *(of(m, F.col("high") + (F.col("high") - F.col("mid")) * of_metric(1) + of_metric(2)).alias(f"high_{m}") for m in METRICS),
        *(of(m, F.col("low") - (F.col("mid") - F.col("low")) * of_metric(1) - of_metric(2)).alias(f"low_{m}") for m in TWO_SIDED),
    )


def thresholds(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The fences of each (lang, source) in ``rows``, from the texts that pass the base rules: its own, its language's or the corpus's. Nulls are a group each; a group without such texts has no fences."""
    bins = stored(sketch(rows.where("NOT quality.base_failed")))
    names = [f"high_{m}" for m in METRICS] + [f"low_{m}" for m in TWO_SIDED]
    whole = fences(bins).first()
    own = fences(bins, "lang", "source")
    wide = fences(bins, "lang").select(F.col("lang").alias("l"), F.col("docs").alias("l_docs"), *(F.col(c).alias(f"l_{c}") for c in names))
    pick = lambda c: F.when(F.col("docs") >= min_docs, F.col(c)).when(F.col("l_docs") >= min_docs, F.col(f"l_{c}")).otherwise(F.lit(whole[c] if whole else None).cast("long"))
    return stored(own.join(wide, own["lang"].eqNullSafe(wide["l"])).select("lang", "source", *(pick(c).alias(c) for c in names)))


def judged(rows: DataFrame, fence: DataFrame) -> DataFrame:
    """``rows`` (with quality) and a boolean ``kept`` inside quality. A text without words isn't kept."""
    fence = fence.select(F.col("lang").alias("__l"), F.col("source").alias("__s"), F.struct(*[c for c in fence.columns if c not in ("lang", "source")]).alias("__f"))
    joined = rows.join(fence, rows["lang"].eqNullSafe(fence["__l"]) & rows["source"].eqNullSafe(fence["__s"]), "left")
    ok = ~F.col("quality.base_failed")
    for m in METRICS:
        ok &= F.col(f"quality.{m}") <= F.col(f"__f.high_{m}")
    for m in TWO_SIDED:
        ok &= F.col(f"quality.{m}") >= F.col(f"__f.low_{m}")
    return joined.withColumn("quality", F.col("quality").withField("kept", F.coalesce(ok, F.lit(False)))).drop("__l", "__s", "__f")


def quality_report(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row for each document: doc_id, the base counts, base_failed, kept and the ratios.

    Any column of ``docs`` may be null; repeated rows are judged alike, each for itself; no rows give no rows. Other
    columns of ``docs`` aren't returned, so their names can't clash.
    """
    rows = stored(measured(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judged(rows, thresholds(rows, min_docs)).select("doc_id", *(f"quality.{k}" for k in BASE), "quality.base_failed", "quality.kept", *(f"quality.{m}" for m in METRICS))


def quality_filter(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents that are kept, with their columns.

    A column named ``quality``, or any other, may be there and is returned as it was: the verdict travels in a column
    beside a struct of all the input's.
    """
    rows = stored(measured(docs.select("text", "lang", "source", F.struct(*(docs[c] for c in docs.columns)).alias("__row"))).drop("text"))
    return judged(rows, thresholds(rows.drop("__row"), min_docs)).where("quality.kept").select("__row.*")
