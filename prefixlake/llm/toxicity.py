"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Training takes at most EXAMPLES labelled documents of each label, drawn by a hash of the id, none longer than
TRAIN_CHARS. Terms are words (runs of letters, lower-cased) and their first PREFIX bytes; all terms of the examples are
the vocabulary, and all examples are in the index. Examples are vectors of their terms (1 + ln tf, times idf, length 1).
The idf is multiplied with FLOOR and the absolute log ratio of the term's shares in the two labels, so a term weighs more
the more it tells the labels apart, and none weighs nothing.

The index is an inverted one with block maxima. Terms of more than one example in COMMON stand in nearly every block, where a
maximum skips nothing: their part of all cosines is one matrix product for TOGETHER texts. For all other terms, examples
stand in blocks, and each term has its postings by block and its largest weight in each block. A text's bound for a block
is the block's largest common part plus the product of the text's other weights with these maxima; blocks are read by
falling bound, a few at a time, until the bound falls below the NEAREST-th best cosine, so the neighbours are exact, ties
by example number. Neighbours vote with weight 1 / (1.05 - cosine).

A logistic fit on votes, weighted back to the labels' true shares, gives the score. Its votes are those of examples that
chose neither terms nor neighbours: each of PARTS parts of the examples is judged by an index of the others. Texts without
any term of the vocabulary get the share of label 1 among such examples, or of all examples if there are none.

Scoring reads the whole text of every document, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm import wordhash
from prefixlake.llm.lang_id import fold

EXAMPLES, TRAIN_CHARS = 3000, 20_000
PREFIX, FLOOR = 6, 0.05
NEAREST, BLOCK, EVIDENCE = 15, 128, 3
#: Terms of more than one example in COMMON are kept dense. Texts searched together; parts of the examples for calibration.
COMMON, TOGETHER, PARTS = 16, 64, 4
#: Blocks read before the bound is looked at. Answers that a task keeps, by query.
FIRST, KEPT = 2, 50_000
_U = np.uint64


def terms(texts: pa.Array, want: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each text: its number and the hashes of its terms, with repeats. ``want``: sorted; only the places in it of terms that it has."""
    if want is not None:
        mask = np.zeros(1 << 20, bool)
        mask[(want & _U((1 << 20) - 1)).astype(np.int64)] = True
    for first, data, offsets in wordhash.slices(texts):
        starts, ends, begin = wordhash.letter_spans(data, offsets)
        words = wordhash.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, _U)
        long = np.flatnonzero(ends - starts > PREFIX)
        heads = wordhash.span_hashes(data, starts[long], starts[long] + PREFIX) ^ _U(0xB5) if len(long) else np.zeros(0, _U)
        word_at, head_at = np.arange(len(words)), long
        if want is not None:

            def kept(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                near = np.flatnonzero(mask[(h & _U((1 << 20) - 1)).astype(np.int64)])
                place = np.searchsorted(want, h[near])
                ok = want[np.minimum(place, len(want) - 1)] == h[near]
                return place[ok], at[near[ok]]

            words, word_at = kept(words, word_at)
            heads, head_at = kept(heads, head_at)
        all_, at = np.concatenate([words, heads]), np.concatenate([word_at, head_at])
        order = np.argsort(at, kind="stable")
        all_, cut = all_[order], np.searchsorted(at[order], begin)
        for r in range(len(offsets) - 1):
            yield first + r, all_[cut[r] : cut[r + 1]]


class Index:
    """Examples, vocabulary, and the inverted index: a dense matrix for common terms, postings with block maxima for the rest."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, ids: np.ndarray):
        # like examples side by side: blocks have tighter maxima
        order = sorted(range(len(rows)), key=lambda i: (int(rows[i][0][rows[i][1].argmax()]) if len(rows[i][0]) else -1, len(rows[i][0]), i))
        rows, self.label, self.ids = [rows[i] for i in order], label[order], ids[order]
        self.vocabulary, self.idf = vocabulary, idf
        term = np.concatenate([r[0] for r in rows] or [np.zeros(0, np.int64)])
        weight = np.concatenate([r[1] for r in rows] or [np.zeros(0)])
        example = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        self.blocks = -(-len(rows) // BLOCK) or 1
        common = np.flatnonzero(np.bincount(term, minlength=len(vocabulary)) * COMMON > len(rows))
        self.column = np.full(len(vocabulary), -1)
        self.column[common] = np.arange(len(common))
        often = self.column[term] >= 0
        self.often = self.column[term[often]].astype(np.int32), example[often].astype(np.int32), weight[often], len(common)
        self._dense: np.ndarray | None = None
        slot = term[~often] * self.blocks + example[~often] // BLOCK
        order = np.argsort(slot, kind="stable")
        self.example, self.weight = example[~often][order], weight[~often][order]
        # a cell is a term's postings in a block
        slot, start = np.unique(slot[order], return_index=True)
        self.block, self.start = slot % self.blocks, np.append(start, len(order))
        self.top = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.begin = np.searchsorted(slot, np.arange(len(vocabulary) + 1) * self.blocks)

    def vector(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vector(found, self.idf)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights): numbers and cosines of the ``k`` nearest examples with a cosine above 0."""
        if self._dense is None:  # made where it is used, so that it needn't be sent
            column, example, weight, n = self.often
            self._dense = np.zeros((n, self.blocks * BLOCK))
            self._dense[column, example] = weight
        often = np.zeros((len(queries), len(self._dense)))
        for row, (term, weight) in zip(often, queries, strict=True):
            at = self.column[term]
            row[at[at >= 0]] = weight[at >= 0]
        part = often @ self._dense  # what common terms give, for each example
        most = part.reshape(len(queries), self.blocks, BLOCK).max(axis=2)
        return [self._search(*q, part[i], most[i], k) for i, q in enumerate(queries)]

    def _search(self, term: np.ndarray, weight: np.ndarray, part: np.ndarray, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        cell, n = spread(self.begin, term)
        weight, block = np.repeat(weight, n), self.block[cell]
        bound = most + np.bincount(block, weight * self.top[cell], minlength=self.blocks)
        blocks = np.argsort(-bound, kind="stable")[: np.count_nonzero(bound > 0)]
        best, cosine = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, FIRST
        while at < len(blocks) and not (len(best) == k and bound[blocks[at]] < cosine[-1] - 1e-12):
            now = np.zeros(self.blocks, bool)
            now[blocks[at : at + step]] = True
            score = np.where(np.repeat(now, BLOCK), part, 0.0)
            now = now[block]
            place, n = spread(self.start, cell[now])
            score += np.bincount(self.example[place], np.repeat(weight[now], n) * self.weight[place], minlength=len(score))
            near = np.flatnonzero(score > (cosine[-1] - 1e-12 if len(best) == k else 0))
            best, cosine = np.append(best, near), np.append(cosine, np.minimum(score[near], 1.0).round(12))
            if len(best) > k:
                good = cosine >= np.partition(cosine, -k)[-k]
                best, cosine = best[good], cosine[good]
            order = np.lexsort((best, -cosine))[:k]
            best, cosine = best[order], cosine[order]
            at, step = at + step, len(blocks) if len(best) == k else 2 * step
            blocks = blocks[: np.count_nonzero(bound >= cosine[-1] - 1e-12)] if len(best) == k else blocks
        return best, cosine


def spread(begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from ``begin[k]`` to ``begin[k + 1]`` of each k of ``at``, and how many they are."""
    n = begin[at + 1] - begin[at]
    return np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def vector(found: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    term, n = np.unique(found, return_counts=True)
    weight = (1 + np.log(n)) * idf[term]
    return term, weight / (np.linalg.norm(weight) or 1)


def vote(label: np.ndarray, cosine: np.ndarray) -> tuple[float, float]:
    """The weighted share of label 1, and the largest cosine."""
    w = 1 / (1.05 - cosine)
    return float((w * label).sum() / w.sum()), float(cosine[0])


class Model:
    def __init__(self, index: Index, fit: np.ndarray, bare: float):
        self.index, self.fit, self.bare, self.known = index, fit, bare, {}

    def score(self, texts: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Of each text (its terms): the score, and the nearest examples with their cosines. Texts with equal terms have equal answers, which are kept."""
        keys = [np.sort(t).tobytes() if len(t) < 64 else bytes(16) + k.to_bytes(8, "big") for k, t in enumerate(texts)]
        new = {key: t for key, t in zip(keys, texts, strict=True) if key not in self.known and len(t)}
        found = self.index.nearest([self.index.vector(t) for t in new.values()]) if new else []
        answers = {key: (self.chance(best, cosine), best, cosine) for key, (best, cosine) in zip(new, found, strict=True)}
        none = (self.bare, np.zeros(0, np.int64), np.zeros(0))
        out = [answers.get(key) or self.known.get(key, none) if len(t) else none for key, t in zip(keys, texts, strict=True)]
        if len(self.known) >= KEPT:
            self.known.clear()
        self.known |= {key: answers[key] for key, t in new.items() if len(t) < 64}
        return out

    def chance(self, best: np.ndarray, cosine: np.ndarray) -> float:
        if not len(best):
            return self.bare
        share, top = vote(self.index.label[best], cosine)
        return float(1 / (1 + np.exp(-(self.fit @ [1.0, share, top]))))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A fit with a ridge of 0.01, by Newton's method."""
    fit = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.01 * np.eye(len(fit)), x.T @ (weight * (y - p)) - 0.01 * fit)
        fit = fit + step
        if np.abs(step).max() < 1e-9:
            break
    return fit


def train(ids: np.ndarray, texts: list[str], label: np.ndarray, weight: np.ndarray) -> Model | None:
    """``weight``: how many labelled documents an example stands for. None without examples."""
    if not len(texts):
        return None
    found = [h for _, h in terms(pa.array([t.lower() for t in texts], pa.string()))]
    bare = np.array([not len(h) for h in found])
    p = (weight[bare] @ label[bare] + weight @ label / weight.sum()) / (weight[bare].sum() + 1)
    some = np.flatnonzero(~bare)
    x, y, w = [], [], []
    part = some[np.lexsort((ids[some], label[some]))]
    for k in range(PARTS):  # each part is judged by an index that knows nothing of it
        back, rest = part[k::PARTS], np.setdiff1d(part, part[k::PARTS])
        if not len(back) or not len(rest):
            continue
        index = indexed([found[i] for i in rest], label[rest], ids[rest])
        own = [places(found[i], index.vocabulary) for i in back]
        for start in range(0, len(back), TOGETHER):
            for i, (best, cosine) in zip(back[start : start + TOGETHER], index.nearest([index.vector(t) for t in own[start : start + TOGETHER]]), strict=True):
                if len(best):
                    x.append([1.0, *vote(index.label[best], cosine)])
                    y.append(label[i])
                    w.append(weight[i])
    fit = logistic(np.array(x), np.array(y, float), np.array(w)) if x else np.array([0.0, 0.0, 0.0])
    return Model(indexed([found[i] for i in some], label[some], ids[some]), fit, float(p))


def places(found: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """The places in the vocabulary of the terms that it has."""
    at = np.minimum(np.searchsorted(vocabulary, found), max(0, len(vocabulary) - 1))
    return at[vocabulary[at] == found] if len(vocabulary) else at[:0]


def indexed(found: list[np.ndarray], label: np.ndarray, ids: np.ndarray) -> Index:
    """The index of examples (the hashes of their terms), with weights from these examples alone."""
    each = [np.unique(h) for h in found]
    owner = np.repeat(np.arange(len(each)), [len(h) for h in each])
    vocabulary, place = np.unique(np.concatenate(each or [np.zeros(0, _U)]), return_inverse=True)
    n = np.array([(label == c).sum() for c in (0, 1)], float)
    seen = np.stack([np.bincount(place[label[owner] == c], minlength=len(vocabulary)) for c in (0, 1)]).astype(float)
    tells = np.abs(np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1)))
    idf = np.log(1 + n.sum() / (1 + seen.sum(axis=0))) * (FLOOR + tells)
    return Index(vocabulary, idf, [vector(places(h, vocabulary), idf) for h in found], label, ids)


def sample(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES):
    """At most about ``most`` documents of each label: ids, texts, labels, weights. Learns only from the fold's other rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("doc_id"), 5) != 0)
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit("example")), F.lit(1 << 30))
    limit = lambda c: int(min(1.0, most / max(1, n.get(c, 0))) * (1 << 30))
    chosen = known.where(draw < F.when(F.col("toxic") == 1, limit(1)).otherwise(limit(0))).limit(4 * most)
    held = docs.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = held.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()  # of several texts of an id, the least
    label = np.array([r["toxic"] for r in rows], np.int64)
    weight = np.array([n[c] / max(1, (label == c).sum()) for c in label])
    return np.array([r["doc_id"] for r in rows], np.int64), [r["text"] for r in rows], label, weight


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence_ids, evidence_cosines for each row of ``docs`` (doc_id, text, held_out).

    Null and empty texts have no terms and get the score of such examples; with nothing to learn from every score is 0.
    The evidence is the EVIDENCE nearest examples.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            score = np.full(batch.num_rows, m.bare if m else 0.0)
            ids, cosines = [[] for _ in score], [[] for _ in score]
            texts = terms(batch.column("low"), m.index.vocabulary) if m and len(m.index.vocabulary) else iter(())
            while some := list(islice(texts, TOGETHER)):
                for (row, _), (score[row], best, cosine) in zip(some, m.score([found for _, found in some]), strict=True):
                    ids[row], cosines[row] = m.index.ids[best[:EVIDENCE]].tolist(), cosine[:EVIDENCE].tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_cosines"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.lower("text").alias("low"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence_ids array<long>, evidence_cosines array<double>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled rows that aren't held out, and scores every row of ``docs``; repeated rows are rows of their own.

    Of repeated labels of a document the larger counts. Only doc_id and text of ``docs`` are read: doc_id for the fold.
    """
    docs = docs.select("doc_id", "text", (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    return scored(docs, train(*sample(docs, labels)))
