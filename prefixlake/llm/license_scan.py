"""License scans: a trained paragraph classifier over passages, and a comparison with templates that confirms it.

Paragraphs are what blank lines part; a notice wrapped over lines is one text. A passage is a stretch of a paragraph in
which n-grams of the classifier stand less than GAP words apart, so a notice inside a paragraph of prose is judged by its own
words. Features are the word 1- to NGRAMS-grams of the training texts that aren't made of frequent words alone. A
multinomial logistic regression over the features a passage holds, trained by gradient descent in numpy, tells families
from ``unknown``. It learns from the standard texts, notices made by rule of a lead and a name, variations of both, and
texts that speak of licences and grant none of these. Its probability counts from a bound on that lets at most WRONG of
paragraphs through that it should reject, and that it hasn't seen (other licences, sentences about licences, shuffled
and broken notices). It knows only those denials that it has learned: of a notice in other words that is denied, n-grams
still say that it is one. A family is confirmed if a template's word pairs stand in the passage: COVER of a standard text's, or
all of a name's.

Scoring is DataFrame functions alone: no Python runs on executors. Weights are whole millionths, so sums don't depend on
their order.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.common import let, stored, text_of
from prefixlake.llm.license_texts import BESIDE, BODIES, HELD_BACK, LEADS, NAMES, SHORT, UNKNOWN

NGRAMS, COVER, GAP, LEAST = 3, 0.6, 8, 2
#: The share of paragraphs to be rejected that may pass; weights below SMALL are dropped.
WRONG, SMALL = 0.01, 0.02
#: Of the training: the step, and the penalty on weights.
RATE, L1 = 2.0, 3e-6
WORD = r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"
#: Stands for any word that the classifier doesn't know.
OTHER = "~"
#: Words that make no feature alone: common ones of the training texts' languages.
FREQUENT = frozenset("the of and to a in or is it for this that with by as be are not any you may on at an from all if no was were has had which but its other such der die das und mit von zu le la les de des et un une el los las y en que her his he she we us each one two".split())


def _tokens(text: str) -> list[str]:
    return ["#" if w[0].isdigit() else w for w in re.findall(r"[^\W_]+(?:\.\d+)*", text.lower())]


def _grams(words: list[str]) -> list[tuple[str, ...]]:
    return [g for n in range(1, NGRAMS + 1) for i in range(len(words) - n + 1) if not FREQUENT.issuperset(g := tuple(words[i : i + n])) and g != ("#",) and OTHER not in g]


class Model:
    """Families (the last is unknown), features with their weights (whole millionths), bias, the least probability that counts, and templates."""

    def __init__(self, families: list[str], grams: list[tuple[str, ...]], weights: np.ndarray, bias: np.ndarray, certain: float):
        self.families, self.grams, self.certain = families, grams, certain
        self.weights, self.bias = np.rint(weights * 1e6).astype(np.int64), np.rint(bias * 1e6).astype(np.int64)
        self.templates = templates()
        #: Features that speak for a family more than for unknown.
        self.speaks = self.weights[:, :-1].max(axis=1) > self.weights[:, -1]

    def probabilities(self, found: set[tuple[str, ...]]) -> np.ndarray:
        """Of a passage that holds the features ``found``."""
        at = {g: i for i, g in enumerate(self.grams)}
        z = (self.bias + self.weights[sorted(at[g] for g in found if g in at)].sum(axis=0)) / 1e6
        e = np.exp(z - z.max())
        return e / e.sum()


def confirmed(words: list[str], known: list[tuple[str, frozenset, int]]) -> set[str]:
    """The families of which a template's word pairs stand in ``words``."""
    pairs = set(zip(words, words[1:], strict=False))
    return {f for f, p, n in known if len(p & pairs) >= n}


def templates() -> list[tuple[str, frozenset[tuple[str, ...]], int]]:
    """Family, word pairs, and how many of them a passage must hold."""
    pairs = lambda words: frozenset(zip(words, words[1:], strict=False))
    out = [(f, p, ceil(COVER * len(p))) for f, texts in BODIES.items() for t in texts if (p := pairs(_tokens(t)))]
    names = [(f, n) for f, texts in NAMES.items() for n in texts]
    names += [(f, b.format(short)) for f, short in SHORT.items() for b in BESIDE]
    for f, n in names:
        p = pairs([w if w != "#" else "#" for w in re.findall(r"[^\s]+", n)])
        out.append((f, p, len(p)))
    return list(dict.fromkeys(out))


def _notices() -> dict[str, list[list[str]]]:
    """Short notices of each family by rule: a lead and a name."""
    split = lambda t: re.findall(r"\S+", t)
    out = {f: [split(lead) + split(n) for n in names for lead in LEADS] for f, names in NAMES.items()}
    for f, short in SHORT.items():
        out[f] += [split(b.format(short)) for b in BESIDE] + [split(lead) + [short] for lead in LEADS]
        out[f] += [split(lead) + [short, w] for lead in LEADS for w in ("lizenz", "licence", "license", "licencia")]
    return out


@lru_cache(maxsize=1)
def train(rounds: int = 200, seed: int = 5, per: int = 90) -> Model:
    """The classifier; deterministic, and of a size that the texts set. ``per``: training paragraphs of a family."""
    rng = np.random.Generator(np.random.PCG64(seed))
    families = [*NAMES, "unknown"]
    none = len(families) - 1
    notices, named = _notices(), templates()
    names = [n for texts in NAMES.values() for n in texts]
    plain = sorted({w for t in UNKNOWN for w in _tokens(t)} - {w for n in names for w in n.split()})

    def varied(words: list[str]) -> list[str]:
        return [w if rng.random() > 0.04 else OTHER for w in words]

    def about(texts: tuple[str, ...], n: int = 40) -> list[list[str]]:
        out = []
        for t in texts:
            out += [_tokens(t.replace("{name}", str(n))) for n in (rng.choice(names, n, replace=False) if "{name}" in t else [""])]
        return out

    def broken(n: int) -> list[list[str]]:
        """Standard texts with their words out of order, and two words of notices among others."""
        out = []
        while len(out) < n:
            f = str(rng.choice(families[:-1]))
            if len(out) % 2:
                words = [str(w) for w in rng.permutation(_tokens(str(rng.choice(BODIES[f]))))]
            else:
                words = [*rng.choice(plain, 6), *rng.choice(notices[f][int(rng.integers(0, len(notices[f])))], 2, replace=False), *rng.choice(plain, 6)]
            if not confirmed(words, named):
                out.append([str(w) for w in words])
        return out

    rows: list[tuple[list[str], int]] = []
    for k, f in enumerate(families[:-1]):
        bodies = [_tokens(t) for t in BODIES[f]]
        rows += [(b, k) for b in bodies] + [(varied(b), k) for b in bodies for _ in range(6)]
        rows += [(b[i : i + 12], k) for b in bodies for i in range(0, len(b) - 11, 6)]  # lines of a wrapped text
        rows += [(varied(notices[f][i]), k) for i in rng.permutation(len(notices[f]))[:per]]
    rows += [(w, none) for w in about(UNKNOWN) for _ in range(2)] + [(varied(w), none) for w in about(UNKNOWN)] + [(w, none) for w in broken(400)]
    count: dict[tuple[str, ...], int] = {}
    held = [set(_grams(words)) for words, _ in rows]
    for s in held:
        for g in s:
            count[g] = count.get(g, 0) + 1
    grams = sorted(g for g, n in count.items() if n >= 3)
    at = {g: i for i, g in enumerate(grams)}
    x, y = np.zeros((len(rows), len(grams)), np.float32), np.zeros((len(rows), len(families)), np.float32)
    for i, (s, (_, k)) in enumerate(zip(held, rows, strict=True)):
        x[i, sorted(at[g] for g in s if g in at)] = 1
        y[i, k] = 1
    weights, bias, rate = np.zeros((len(grams), len(families)), np.float32), np.zeros(len(families), np.float32), np.float32(RATE)
    ahead, b_ahead, pace = weights, bias, 1.0
    for _ in range(rounds):  # accelerated proximal gradient
        z = x @ ahead + b_ahead
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - y) / np.float32(len(rows))
        new = ahead - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * np.float32(L1), 0)
        b_new = b_ahead - rate * g.sum(axis=0)
        later = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        push = np.float32((pace - 1) / later)
        ahead, b_ahead, pace = new + push * (new - weights), b_new + push * (b_new - bias), later
        weights, bias = new, b_new
    used = np.abs(weights).max(axis=1) > SMALL
    model = Model(families, [g for g, u in zip(grams, used, strict=True) if u], weights[used].astype(float), bias.astype(float), 0.0)
    # calibration: paragraphs that training hasn't seen and that grant no known licence
    back = sorted((float(model.probabilities(set(_grams(w)))[:-1].max()) for w in about(HELD_BACK) + broken(400)), reverse=True)
    model.certain = min(0.99, back[int(WRONG * len(back))] + 1e-6)
    return model


def words_of(line: Column) -> Column:
    """Lower-cased words; numbers, with their points, are one word ``#``."""
    return F.transform(F.regexp_extract_all(F.lower(line), F.lit(WORD), F.lit(0)), lambda w: F.when(w.rlike(r"^\p{N}"), "#").otherwise(w))


def _hashed(w: Column) -> Column:
    """Of each word: the hashes of the n-grams that begin there (n from 1 to NGRAMS; fewer at the end)."""
    more = lambda x, i, n: F.when(i + n <= F.size(w), F.xxhash64(x, *(F.get(w, i + k) for k in range(1, n))))
    return F.transform(w, lambda x, i: F.struct(*(more(x, i, n).alias(f"h{n}") for n in range(1, NGRAMS + 1))))


def _table(spark, model: Model) -> tuple[DataFrame, DataFrame]:
    """Features and word pairs of templates by hash: h, feature (its number or null), templates (numbers); and the hashes of words that any begins with. As large as the training texts make them."""
    known: dict[tuple[str, ...], list] = {g: [i, []] for i, g in enumerate(model.grams)}
    for t, (_, pairs, _) in enumerate(model.templates):
        for g in pairs:
            known.setdefault(g, [None, []])[1].append(t)
    rows = spark.createDataFrame([(g[0], g[1] if len(g) > 1 else None, g[2] if len(g) > 2 else None, f, sorted(t)) for g, (f, t) in known.items()], "a string, b string, c string, feature int, templates array<int>")
    h = F.when(F.col("b").isNull(), F.xxhash64("a")).when(F.col("c").isNull(), F.xxhash64("a", "b")).otherwise(F.xxhash64("a", "b", "c"))
    return rows.select(h.alias("h"), "feature", "templates"), rows.select(F.xxhash64("a").alias("first")).distinct()


KEY = ["doc_id", "digest", "para"]


def passages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, digest, para, passage, from_word, to_word, n_features, family, probability, confirmed: a row for each passage with LEAST features or more that speak for a family.

    ``digest`` is of the text; rows that are equal in doc_id and text are one document. Words, not texts, leave the scan,
    and of these only n-grams that the tables of features and templates know.
    """
    spark = docs.sparkSession
    model = model or train()
    table, firsts = _table(spark, model)
    paras = docs.select("doc_id", F.xxhash64(text_of(), F.lit(1)).alias("digest"), F.posexplode(F.split(text_of(), r"\n[ \t\r\f\x0b]*\n")).alias("para", "body"))
    begun = paras.select(*KEY, F.posexplode(let(words_of(F.col("body")), _hashed)).alias("at", "w")).join(F.broadcast(firsts), F.col("w.h1") == F.col("first"))
    all_ = begun.select(*KEY, "at", F.explode(F.array(*(F.col(f"w.h{n}") for n in range(1, NGRAMS + 1)))).alias("h"))
    hits = stored(all_.join(F.broadcast(table), "h").select(*KEY, "at", "h", "feature", "templates").distinct())
    # a passage ends where no feature begins for GAP words
    order = Window.partitionBy(*KEY).orderBy("at", "h")
    before = F.last(F.when(F.col("feature").isNotNull(), F.col("at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    far = hits.withColumn("gap", F.col("at") - before)
    new = F.col("feature").isNotNull() & (F.col("gap").isNull() | (F.col("gap") > GAP))
    numbered = far.withColumn("passage", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inside = stored(numbered.where("passage > 0 AND (feature IS NOT NULL OR gap <= %d)" % GAP).drop("gap"))
    by = [*KEY, "passage"]
    weights = spark.createDataFrame([(i, [int(v) for v in w], int(s)) for i, (w, s) in enumerate(zip(model.weights, model.speaks, strict=True))], "feature int, w array<bigint>, speaks int")
    each = inside.where("feature IS NOT NULL").groupBy(*by, "feature").agg(F.min("at").alias("from_word"), F.max("at").alias("to_word"))
    sums = each.join(F.broadcast(weights), "feature").groupBy(*by).agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"), F.sum("speaks").alias("n_features"), *(F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(len(model.families)))).where(F.col("n_features") >= LEAST)
    z = sums.withColumn("z", F.array(*(F.struct(((F.col(f"s{i}") + F.lit(int(b))) / 1e6).alias("z"), F.lit(f).alias("f")) for i, (f, b) in enumerate(zip(model.families, model.bias, strict=True))))).drop(*(f"s{i}" for i in range(len(model.families))))
    top = F.array_max("z")
    p = 1 / F.aggregate(F.col("z"), F.lit(0.0), lambda a, x: a + F.exp(x["z"] - top["z"]))
    judged = z.select(*by, "from_word", "to_word", "n_features", top["f"].alias("best"), p.alias("probability"))
    judged = judged.select(*by, "from_word", "to_word", "n_features", F.when(F.col("probability") >= model.certain, F.col("best")).otherwise("unknown").alias("family"), "probability")
    # templates whose word pairs stand in the passage
    needs = spark.createDataFrame([(t, f, n) for t, (f, _, n) in enumerate(model.templates)], "template int, t_family string, need int")
    met = inside.select(*by, "h", F.explode("templates").alias("template")).groupBy(*by, "template").agg(F.count_distinct("h").alias("n"))
    sure = met.join(F.broadcast(needs), "template").where("n >= need").select(*(F.col(c).alias(f"_{c}") for c in by), F.col("t_family").alias("_family")).distinct()
    on = judged["doc_id"].eqNullSafe(sure["_doc_id"]) & (judged["family"] == sure["_family"])
    for c in by[1:]:
        on &= judged[c] == sure[f"_{c}"]
    return judged.join(sure, on, "left").withColumn("confirmed", F.col("_family").isNotNull()).drop("_family", *(f"_{c}" for c in by))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_passages (that speak of licences), families (confirmed, sorted), license (the likeliest confirmed family, of equal ones the last by name; else ``unknown`` if a passage speaks of licences, else null), probability.

    Null and empty texts have no passage; rows equal in doc_id and text get equal results. Only doc_id and text are read.
    """
    found = passages(docs.select("doc_id", "text"), model)
    sure = F.col("confirmed") & (F.col("family") != "unknown")
    each = stored(found.groupBy("doc_id", "digest").agg(
        F.count("*").alias("n_passages"),
        F.array_sort(F.collect_set(F.when(sure, F.col("family")))).alias("families"),
        F.max(F.when(sure, F.struct("probability", "family"))).alias("best"),
    )).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_of"), "n_passages", "families", "best")
    rows = docs.select("doc_id", F.xxhash64(text_of(), F.lit(1)).alias("digest"))
    joined = rows.join(each, rows["doc_id"].eqNullSafe(each["_id"]) & (rows["digest"] == each["_of"]), "left")
    n = F.coalesce("n_passages", F.lit(0)).cast("long")
    return joined.select("doc_id", n.alias("n_passages"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), F.coalesce(F.col("best.family"), F.when(n > 0, "unknown")).alias("license"), F.col("best.probability").alias("probability"))
