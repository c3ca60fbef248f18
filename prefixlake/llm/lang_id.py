"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are its byte 3- and 4-grams inside words or over one word edge, lower-cased, hashed into BUCKETS
embeddings. Training takes at most TRAIN_DOCS documents, drawn by a hash of id and text, none longer than TRAIN_CHARS; a
fifth of them is held back to set the softmax's temperature and the score below which a prediction counts as rejected.
Prediction reads the whole text of every document; one text's subwords are the most that a task holds at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlake.llm import wordhash

BUCKETS, DIM = 1 << 15, 16
TRAIN_DOCS, TRAIN_CHARS, EPOCHS, RATE = 4000, 20_000, 3, 4.0
#: Accuracy on the held-back documents that accepted predictions must reach.
ACCEPT = 0.99
NONE = "und"


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def subwords(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """For each text: its number and the buckets of its subwords. Texts come lower-cased."""
    for first, data, offsets in wordhash.slices(texts):
        inside = wordhash.letters(data)
        b = np.where(inside, data, 32).astype(np.uint32)
        # edges of texts are edges of words: a gram may begin one byte before its text or end one after it, seen as a space
        for r in range(len(offsets) - 1):
            x = np.concatenate([[32], b[offsets[r] : offsets[r + 1]], [32]]).astype(np.uint32)
            real = x != 32
            three = (x[:-2] + x[1:-1] * 257 + x[2:] * 66049)[real[1:-1]]
            four = (x[:-3] + x[1:-2] * 257 + x[2:-1] * 66049 + x[3:] * 16974593)[real[1:-2] & real[2:-1]] if len(x) > 3 else three[:0]
            h = np.concatenate([three * np.uint32(2654435761), four * np.uint32(2246822519) + np.uint32(97)])
            yield first + r, (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


class Model:
    """Scores of each bucket for each language (the embedding times the softmax's weights), bias, temperature, least score."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, heat: float, least: float):
        self.langs, self.table, self.bias, self.heat, self.least = langs, table, bias, heat, least

    def logits(self, h: np.ndarray) -> np.ndarray:
        return self.bias + (self.table[h].mean(axis=0, dtype=np.float64) if len(h) else 0)

    def predict(self, h: np.ndarray) -> tuple[int, float]:
        p = softmax(self.logits(h) / self.heat)
        return int(p.argmax()), float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """None without labelled texts."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.Generator(np.random.PCG64(seed))
    y = np.searchsorted(names, langs)
    found = [np.unique(h, return_counts=True) for _, h in subwords(pa.array([t.lower() for t in texts], pa.string()))]
    order = rng.permutation(len(texts))
    back, seen = order[: len(order) // 5], order[len(order) // 5 :]
    emb, out = rng.normal(0, 1 / DIM, (BUCKETS, DIM)), np.zeros((len(names), DIM))
    bias = np.zeros(len(names))
    total, done = EPOCHS * len(seen), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(seen):
            at, n = found[k]
            rate, done = RATE * (1 - done / total) / 4, done + 1
            if not len(at):
                continue
            share = (n / n.sum())[:, None]
            mean = (emb[at] * share).sum(axis=0)
            g = softmax(out @ mean + bias)
            g[y[k]] -= 1
            step = out.T @ g
            out -= rate * np.outer(g, mean)
            bias -= rate * 0.1 * g
            # a mean of many subwords moves each but little: the step of an embedding grows with their number, up to 50
            emb[at] -= rate * share * step * min(len(at), 50)
    model = Model(names, (emb @ out.T).astype(np.float32), bias, 1.0, 0.0)
    if len(back) < 10:
        return model
    z = np.array([bias + (found[k][1] @ model.table[found[k][0]]) / max(1, found[k][1].sum()) for k in back])
    loss = lambda t: -np.mean([np.log(softmax(v / t)[c] + 1e-12) for v, c in zip(z, y[back], strict=True)])
    model.heat = float(min(np.geomspace(0.1, 10, 41), key=loss))
    p = np.array([softmax(v / model.heat) for v in z])
    right, score = p.argmax(axis=1) == y[back], p.max(axis=1)
    order = np.argsort(-score)
    ok = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= ACCEPT
    model.least = float(score[order][np.flatnonzero(ok)[-1]]) if ok.any() else 1.0
    return model


def sample(docs: DataFrame, most: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """Texts and languages of about ``most`` of the rows of ``docs`` (doc_id, text, lang), by a hash of id and text, so rows without an id are drawn one by one."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= TRAIN_CHARS))
    n = rows.count()
    share = min(1.0, most / max(1, n))
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("doc_id", "text").limit(2 * most).collect()
    return [r["text"] for r in some], [r["lang"] for r in some]


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of ``docs`` (doc_id, text, held_out).

    Texts that are null or have no letter are ``und`` with score 0; so is every text if there was nothing to learn from.
    ``rejected`` marks those and scores below the least score that the training accepts.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            some = batch.column("some").to_numpy(zero_copy_only=False)
            lang, score = [NONE] * batch.num_rows, np.zeros(batch.num_rows)
            for row, h in subwords(batch.column("low")) if m else ():
                if some[row]:
                    k, score[row] = m.predict(h)
                    lang[row] = m.langs[k]
            rejected = (score < m.least) | ~some if m else np.ones(batch.num_rows, bool)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score), pa.array(rejected.astype(bool))], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.lower("text").alias("low"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("some"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows of ``docs`` whose fold isn't held out, and predicts every row; repeated rows are rows of their own.

    Only doc_id, text and lang are read: doc_id for the fold, lang for learning.
    """
    rows = docs.select("doc_id", "text", "lang", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return predicted(rows, train(*sample(rows.where("NOT held_out"))))
