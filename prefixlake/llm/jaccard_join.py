"""N-gram Jaccard self-join with set-relation skipping.

A text's set is its distinct word shingles (64-bit hashes). Two sets link at a Jaccard similarity of PERCENT or more.

1. Sets are named by a digest, so exact copies are one set from here on. Count-min tables over all shingles (of fixed
   size, one a task, summed in PARTS parts) tell which are common; each set is ordered by (commonness, hash), and its first n - ceil(PERCENT n) + 1
   shingles enter the inverted index with their positions. Whatever the order, two sets that link share at least
   ``_shared`` shingles of these prefixes, a bound that follows from their sizes.
2. Short index lists give their pairs, less those that size and position rule out; what pairs share is counted up over
   the lists. In long lists each set first meets only the list's head (index-level skipping): a set that links with the
   head has the head's component from then on, and of its other answers only those in other components are still open
   (answer-level skipping: the answers of highly similar sets are derived from one another).
3. Pairs that share enough are first held against sketches of the sets (parities of hashed places): the places that
   differ are no more than the shingles that do, so a sketch never rules out a pair that links. The rest is decided by
   the sets themselves, made again from the texts of these pairs only. They meet in cells, pairs of parts of the nodes,
   so that a set is sent once to each cell that needs it, not once for each of its pairs.
4. After the components of these links, long lists are read again: first, their sets try the HEADS of each list that
   stand in most long lists (what all near copies share most with), and of the list's largest components the sets
   that are nearest in size and position; then lists of several components are dealt in pairs
   of parts (no task reads a whole long list) and read in blocks by size and position, pairs of blocks that the bounds rule out and sets of one component are skipped, and what the rest shares
   is counted up as in step 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm import wordhash
from prefixlake.llm.common import joined_to, stored
from prefixlake.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Counters of the count-min table, and the parts that it is summed in.
COUNTERS, PARTS = 1 << 22, 64
#: Shingles that are looked through for repeats at once.
HELD = 6 << 20
#: Lists above this length are read by head first.
LONG = 24
BLOCK = 64
#: Sets of long lists that the others try first: HEADS of each list, and of each of its LARGEST components the NEAREST.
HEADS, LARGEST, NEAREST = 16, 4, 8
#: Bits of a sketch, at least and at most; between, a set has as many as shingles, up to the next power of two.
SKETCH = 1 << 6, 1 << 16
#: Bits of the filter of documents whose sets are made again (a false positive makes a set in vain), and the parts that it is made in.
FILTER, FILTER_PARTS = 1 << 25, 64
#: Bytes of sets that a part of the nodes holds, about, and the least number of parts.
CELL, CELLS = 16 << 20, 4
#: Entries of a list beyond which it is dealt to several tasks, in parts and pairs of parts of this size.
PART, WHOLE = 2048, 11
#: What a pair counts that is decided whatever it shares.
SURE = 1 << 30
_U = np.uint64


def digest(s: np.ndarray) -> int:
    """A name for a set: its hashes mixed and summed."""
    return int((wordhash.mixed(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(s))).astype(np.int64)) if len(s) else 0


def sketch(s: np.ndarray) -> bytes:
    """For each of a power of two of places: whether an odd number of shingles is hashed to it."""
    bits = min(max(1 << (len(s) - 1).bit_length(), SKETCH[0]), SKETCH[1])
    return np.packbits(np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles that are in one of two sets only, by their sketches."""
    if len(x) < len(y):
        x, y = y, x
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while bits > 8 * len(y):  # halves laid over each other are the sketch of half as many places
        bits //= 2
        a = (a & ((1 << bits) - 1)) ^ (a >> bits)
    return (a ^ b).bit_count()


def _needed(n):
    """Of sets whose sizes add up to ``n``: the least intersection that links."""
    return -(-PERCENT * n // (100 + PERCENT))


def _prefix(n):
    return n + (PERCENT * -n // 100) + 1


def _shared(na, nb):
    """The least number of shingles that the prefixes of two sets of these sizes share if the sets link."""
    return np.minimum(_prefix(na) - na, _prefix(nb) - nb) + _needed(na + nb)


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _members(shingle: int):
    """A row for each document, with its set's sketch; and for each task the parts of two count-min tables, of all shingles and of those that repeat among HELD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, COUNTERS), np.uint16)
        held, n = [], 0
        for batch in batches:
            size, name, sketches = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            for row, s in wordhash.shingle_sets(batch.column("text"), shingle):
                size[row], name[row] = len(s), digest(s)
                sketches[row] = sketch(s) if len(s) else b""
                held.append(s)
                n += len(s)
                if n > HELD:
                    _count(counts, held)
                    held, n = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(name), pa.nulls(batch.num_rows, pa.int32()), pa.array(sketches, pa.binary())], ["doc_id", "n", "node", "part", "counts"])
        _count(counts, held)
        if counts.any():
            parts = counts.reshape(2 * PARTS, -1)
            none = pa.nulls(2 * PARTS, pa.int64())
            # n: what a part counts
            yield pa.RecordBatch.from_arrays([none, pa.array(parts.sum(axis=1, dtype=np.int64)), none, pa.array(range(2 * PARTS), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["doc_id", "n", "node", "part", "counts"])

    return run


def _count(counts: np.ndarray, held: list[np.ndarray]) -> None:
    if not held:
        return
    all_ = np.concatenate(held)
    all_.sort()
    again = np.zeros(len(all_), bool)
    again[1:] = all_[1:] == all_[:-1]
    again[:-1] |= again[1:]
    for table, x in zip(counts, (all_, all_[again]), strict=True):
        n = np.bincount((x & _U(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        table[:] = np.minimum(table + n, 65535)


def _classes(means: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one part of both tables, in batches: the class of each of its counters."""
        total = np.zeros((2, COUNTERS // PARTS))
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                total[part // PARTS] += np.frombuffer(blob.as_buffer(), np.uint16)
        mean = np.array(means)[:, None]
        classes = np.where(total > mean + 8 * np.sqrt(mean) + 8, np.log2(total + 1), 0).max(axis=0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([part % PARTS], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["place", "classes"])

    return run


def commonness(rows: DataFrame) -> np.ndarray:
    """A class for each counter: 0 for what isn't common for sure, else the logarithm of the count. It only sets the order.

    The counters stay in tasks: the driver gets two sums, then a byte for each counter.
    """
    parts = rows.where("part IS NOT NULL")
    sums = {r["t"]: r["n"] for r in parts.groupBy(F.floor(F.col("part") / PARTS).alias("t")).agg(F.sum("n").alias("n")).collect()}
    means = [sums.get(t, 0) / COUNTERS for t in range(2)]
    out = np.zeros((PARTS, COUNTERS // PARTS), np.uint8)
    for r in parts.select("part", "counts").groupBy(F.col("part") % PARTS).applyInArrow(_classes(means), "place int, classes binary").collect():
        out[r["place"]] = np.frombuffer(r["classes"], np.uint8)
    return out.reshape(-1)


def _entries(shingle: int, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = classes.value, set()
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for _, s in wordhash.shingle_sets(batch.column("text"), shingle):
                n = len(s)
                if not n or (name := digest(s)) in seen:
                    continue
                seen.add(name)
                p = _prefix(n)
                kind = table[(s & _U(COUNTERS - 1)).astype(np.int64)]
                order = np.argsort(kind, kind="stable")[:p] if kind.any() else slice(p)
                # a list that is long by the counts is dealt in 2 ** (class - WHOLE) parts by set; -1: in one
                most = np.left_shift(1, np.maximum(kind[order].astype(np.int64) - WHOLE, 0))
                part = np.where(most > 1, (name & 0x7FFFFFFF) % most, -1).astype(np.int32)
                out.append((s[order], np.full(p, name, np.int64), (np.int64(n) << 32) + np.arange(p), part))
                held += p
                if held > 1 << 18:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return run


def _batch(out) -> pa.RecordBatch:
    token, node, at, part = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node), pa.array(at), pa.array(part)], ["token", "node", "at", "part"])


def _possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets with entries (size << 32 | position) of one shingle can link, by their sizes and what the positions leave them to share, at all and of their prefixes."""
    na, nb, ia, ib = a >> 32, b >> 32, a & 0xFFFFFFFF, b & 0xFFFFFFFF
    before = np.minimum(ia, ib)
    ok = (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * PERCENT) & (before + np.minimum(na - ia, nb - ib) >= _needed(na + nb))
    return ok & (before + np.minimum(_prefix(na) - ia, _prefix(nb) - ib) >= _shared(na, nb))


PAIR = ["a", "b", "na", "nb", "shared"]


def _counted(pairs: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Pairs (node, node, entry, entry, count) summed up."""
    x, y, ex, ey, c = (np.concatenate(v) for v in zip(*pairs, strict=True))
    swap = x > y
    x, y, ex, ey = np.where(swap, y, x), np.where(swap, x, y), np.where(swap, ey, ex), np.where(swap, ex, ey)
    order = np.lexsort((y, x))
    x, y, ex, ey, c = x[order], y[order], ex[order], ey[order], c[order]
    begin = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else np.zeros(0, np.int64)
    c = np.add.reduceat(c, begin) if len(x) else c
    for k in range(0, len(begin), 1 << 18):
        at = begin[k : k + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[at], y[at], ex[at] >> 32, ey[at] >> 32, c[k : k + (1 << 18)])], PAIR)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the index lists of one partition: pairs, and the entries (token, a, at) of long lists."""
    parts = [_columns(x, "token", "node", "at", "part") for x in batches]
    if not parts:
        return
    token, node, at, part = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.lexsort((node, part, token))
    token, node, at, part = token[order], node[order], at[order], part[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])  # copies of a set that several tasks met
    token, node, at, part = token[new], node[new], at[new], part[new]
    begin = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])]))
    length = np.diff(np.append(begin, len(token)))
    length = np.where(part[begin] >= 0, np.maximum(length, LONG + 1), length)  # parts of a list are read as long lists are
    rows = np.repeat(length > LONG, np.diff(np.append(begin, len(token))))
    found: list[tuple[np.ndarray, ...]] = []
    for n in np.unique(length[(length > 1) & (length <= LONG)]):
        i, j = np.triu_indices(n, 1)
        lists = begin[length == n]
        for some in np.array_split(lists, 1 + len(lists) * len(i) // 4_000_000):
            x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
            ok = _possible(at[x], at[y])
            x, y = x[ok], y[ok]
            found.append((node[x], node[y], at[x], at[y], np.ones(len(x), np.int64)))
    head = np.repeat(begin, np.diff(np.append(begin, len(token))))[rows]
    entry = np.flatnonzero(rows)
    ok = (head != entry) & _possible(at[head], at[entry])
    x, y = head[ok], entry[ok]
    found.append((node[x], node[y], at[x], at[y], np.full(len(x), SURE, np.int64)))
    none = lambda n: [pa.nulls(n, pa.int64())] * 2
    for batch in _counted(found):
        yield pa.RecordBatch.from_arrays([*batch.columns, *none(batch.num_rows), pa.nulls(batch.num_rows, pa.int32())], [*PAIR, "token", "at", "part"])
    for k in range(0, len(entry), 1 << 18):
        e = entry[k : k + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(node[e]), *none(len(e)), *none(len(e)), pa.array(token[e]), pa.array(at[e]), pa.array(part[e])], [*PAIR, "token", "at", "part"])


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the entries of long lists (or of their parts) with the HEADS entries there that stand in most long lists, and with the NEAREST entries there, by size and position, of each of the LARGEST components, if of another component."""
    for (token, node, at, comp, many, part), begin in _sorted(batches, "part"):
        order = np.lexsort((node, -many, part, token))
        length = np.diff(begin)
        found = []
        for k in range(HEADS):
            head = order[np.minimum(np.repeat(begin[:-1] + k, length), np.repeat(begin[1:] - 1, length))]
            x = np.flatnonzero(comp != comp[head])
            x = x[_possible(at[x], at[head[x]])]
            found.append((node[x], node[head[x]], at[x], at[head[x]], np.full(len(x), SURE, np.int64)))
        yield from _counted(found)
        found, held = [], 0
        for s, e in zip(begin[:-1], begin[1:], strict=True):
            names, of, sizes = np.unique(comp[s:e], return_inverse=True, return_counts=True)
            for c in np.argsort(-sizes, kind="stable")[:LARGEST] if len(names) > 1 else ():
                near, others = s + np.flatnonzero(of == c), s + np.flatnonzero(of != c)
                k = np.searchsorted(at[near], at[others])[:, None] + np.arange(-NEAREST // 2, NEAREST // 2)
                x, y = np.repeat(others, NEAREST), near[np.clip(k, 0, len(near) - 1)].ravel()
                ok = _possible(at[x], at[y])
                found.append((node[x[ok]], node[y[ok]], at[x[ok]], at[y[ok]], np.full(ok.sum(), SURE, np.int64)))
                held += int(ok.sum())
            if held > 2_000_000:
                yield from _counted(found)
                found, held = [], 0
        if found:
            yield from _counted(found)


def _sorted(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple[np.ndarray, ...], np.ndarray]]:
    """The entries of one partition, by shingle and ``by``, then size and position, and where each group begins (one more at the end); nothing if there are none."""
    parts = [_columns(x, "token", "a", "at", "component", "many", *by, *(["side"] if len(by) > 1 else [])) for x in batches]
    if parts:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keys = [columns[0], *columns[5 : 5 + len(by)]]
        order = np.lexsort((columns[1], columns[2], *keys[::-1]))
        keys = [k[order] for k in keys]
        new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        yield tuple(x[order] for x in columns), np.append(np.flatnonzero(np.concatenate([[True], new])), len(order))


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in long lists, or in a pair of parts of one (then of both sides only); blocks by size and position are skipped by their bounds."""
    for (_, node, at, comp, many, low, high, side), begin in _sorted(batches, "low", "high"):
        yield from _blocks(node, at, comp, many, np.where(low == high, -1, side), begin)


def _blocks(node: np.ndarray, at: np.ndarray, comp: np.ndarray, many: np.ndarray, side: np.ndarray, begin: np.ndarray) -> Iterator[pa.RecordBatch]:
    found, held = [], 0
    for s, e in zip(begin[:-1], begin[1:], strict=True):
        if (comp[s:e] == comp[s]).all():
            continue
        cuts = np.append(np.arange(s, e, BLOCK), e)
        for i in range(len(cuts) - 1):
            for j in range(i, len(cuts) - 1):
                # blocks ascend in size: from the first one that is too large for this one's largest set on, all are
                if int(at[cuts[i + 1] - 1] >> 32) * 100 < int(at[cuts[j]] >> 32) * PERCENT:
                    break
                x, y = (g.ravel() for g in np.meshgrid(np.arange(cuts[i], cuts[i + 1]), np.arange(cuts[j], cuts[j + 1]), indexing="ij"))
                ok = (x < y) & (comp[x] != comp[y]) & ((side[x] < 0) | (side[x] != side[y]))
                x, y = x[ok], y[ok]
                # what two sets share in long lists is bounded by their entries there
                ok = _possible(at[x], at[y]) & (np.minimum(many[x], many[y]) >= _shared(at[x] >> 32, at[y] >> 32))
                x, y = x[ok], y[ok]
                found.append((node[x], node[y], at[x], at[y], np.ones(len(x), np.int64)))
                held += len(x)
        if held > 2_000_000:
            yield from _counted(found)
            found, held = [], 0
    if found:
        yield from _counted(found)


def _dealt(lists: DataFrame) -> DataFrame:
    """The entries of lists that hold several components, in cells (token, low, high): a list of n entries has ceil(n / PART) parts by set, and each pair of its parts is a cell, so that no task reads a long list alone."""
    whole = lists.groupBy("token").agg(F.count("*").alias("n"), F.min("component").alias("first"), F.max("component").alias("last")).where("first <> last")
    parts = stored(whole.select("token", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    met = joined_to(lists, parts, "token", how="inner").withColumn("side", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    cells = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return cells.select("token", "a", "at", "component", "many", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))


def _sets(shingle: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the texts whose place is marked in ``wanted``, or that have none, and their names."""
        bits = wanted.value
        for batch in batches:
            place = batch.column("place").fill_null(-1).to_numpy()
            some = pa.array((place < 0) | ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0))
            out, held = [], 0
            for _, s in wordhash.shingle_sets(batch.column("text").filter(some), shingle):
                if len(s):
                    out.append((digest(s), s.tobytes()))
                    held += len(s)
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), SET_TYPES, strict=True)], SET_NAMES)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), SET_TYPES, strict=True)], SET_NAMES)

    return run


SET_NAMES, SET_TYPES = ["node", "shingles"], [pa.int64(), pa.binary()]


def _place() -> Column:
    return F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER)))


def _marks(key: tuple, rows: pa.Table) -> pa.Table:
    bits = np.zeros(FILTER // FILTER_PARTS, np.uint8)
    bits[rows.column("place").to_numpy() % len(bits)] = 1
    return pa.table({"number": pa.array([key[0].as_py()], pa.int64()), "marks": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _filter(ids: DataFrame) -> np.ndarray:
    """A bit for each place that an id of ``ids`` is hashed to. The ids stay in tasks: the driver gets FILTER bits at most."""
    out = np.zeros((FILTER_PARTS, FILTER // FILTER_PARTS // 8), np.uint8)
    places = ids.select(_place().alias("place")).where("place IS NOT NULL").distinct()
    for r in places.groupBy(F.floor(F.col("place") / (FILTER // FILTER_PARTS)).alias("number")).applyInArrow(_marks, "number long, marks binary").collect():
        out[r["number"]] = np.frombuffer(r["marks"], np.uint8)
    return out.reshape(-1)


def _marked(marks):
    """Whether a place is marked: one of an id in the filter, and of few others."""

    @F.arrow_udf("boolean")
    def run(place: pa.Array) -> pa.Array:
        at, bits = place.to_numpy(zero_copy_only=False), marks.value
        return pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

    return run


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that their sketches don't rule out: two sets that link differ in at most as many shingles as are left of both sizes without the intersection needed."""
    for batch in batches:
        na, nb = _columns(batch, "n_a", "n_b")
        most = na + nb - 2 * _needed(na + nb)
        differ = map(_differ, batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist())
        ok = pa.array(np.fromiter(differ, np.int64, batch.num_rows) <= most)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])


def _linked(pairs: pa.Table, sets: pa.Table) -> pa.Table:
    """Of the pairs of one cell: those that link."""
    held = {node: np.frombuffer(s.as_buffer(), np.uint64) for node, s in zip(sets.column("node").to_pylist(), sets.column("shingles"), strict=True)}
    ok = []
    for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
        both = np.concatenate([held[a], held[b]])
        both.sort()
        ok.append(int((both[1:] == both[:-1]).sum()) >= _needed(len(both)))
    return pairs.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _decided(pairs: DataFrame, docs: DataFrame, named: DataFrame, sketches: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) that link. Only the sets of pairs that sketches (node, n, sketch) leave are made again, each from the one document that ``named`` (node, doc_id, n; a row for each node) has for it."""
    spark = docs.sparkSession
    drawn = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    pairs = stored(pairs.select("a", "b").join(drawn("a"), "a").join(drawn("b"), "b").mapInArrow(_close, "a long, b long"))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = stored(named.join(nodes, "node", "left_semi").select("doc_id", "n"))
    parts = max(CELLS, -(-8 * (chosen.agg(F.sum("n")).first()[0] or 0) // CELL))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    cells = pairs.select("a", "b", F.least(part("a"), part("b")).alias("low"), F.greatest(part("a"), part("b")).alias("high"))
    needs = cells.select(F.explode(F.array("a", "b")).alias("node"), F.col("low").alias("of_low"), F.col("high").alias("of_high")).distinct()
    wanted = spark.sparkContext.broadcast(_filter(chosen))
    sets = docs.select("text", _place().alias("place")).mapInArrow(_sets(shingle, wanted), "node long, shingles binary")
    met = sets.join(needs, "node")
    return stored(cells.groupBy("low", "high").cogroup(met.groupBy("of_low", "of_high")).applyInArrow(_linked, "a long, b long"))


def linked_sets(docs: DataFrame, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (doc_id, n, node; a row for each document), sets (node, doc_id, n, copies; the least id and number of documents), and the components (node, component) of the sets that link with another."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = stored(docs.mapInArrow(_members(shingle), "doc_id long, n long, node long, part int, counts binary"))
    members = first.where("part IS NULL").select("doc_id", "n", "node")
    named = stored(members.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count("*").alias("copies")))
    classes = spark.sparkContext.broadcast(commonness(first))
    index = docs.select("text").mapInArrow(_entries(shingle, classes), "token long, node long, at long, part int")
    pair = "a long, b long, na long, nb long, shared long"
    lists = stored(index.repartition("token", "part").mapInArrow(_lists, f"{pair}, token long, at long, part int"))
    summed = lambda df: df.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))
    prefix = lambda n: F.floor(F.col(n) - F.ceil(F.col(n) * PERCENT / 100) + 1)
    enough = F.col("shared") >= F.least(prefix("na") - F.col("na"), prefix("nb") - F.col("nb")) + F.ceil((F.col("na") + F.col("nb")) * PERCENT / (100 + PERCENT))
    pairs = stored(summed(lists.where("token IS NULL")))
    entries = lists.where("token IS NOT NULL").select("token", "a", "at", "part")
    # sketches of the sets that met another one
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(entries.select(F.col("a").alias("node"))).distinct()
    drawn = first.where("part IS NULL").groupBy("node").agg(F.max("n").alias("n"), F.first("counts").alias("sketch"))
    sketches = stored(drawn.join(met, "node", "left_semi"))
    links = _decided(pairs.where(enough), docs, named, sketches, shingle)
    found = stored(components(links))
    if entries.limit(1).count():
        many = stored(entries.groupBy("a").agg(F.count("*").alias("many")))
        placed = lambda: entries.join(many, "a").join(found, F.col("a") == found["node"], "left").select("token", "a", "at", "part", "many", F.coalesce("component", "a").alias("component"))
        near = _decided(placed().repartition("token", "part").mapInArrow(_centres, pair).select("a", "b").distinct(), docs, named, sketches, shingle)
        if near.limit(1).count():
            links = links.unionByName(near)
            found = stored(components(links))
        # pairs that share nothing in short lists must share enough in long ones; of the others, what they can still share there is bounded
        far = summed(_dealt(stored(placed())).repartition("token", "low", "high").mapInArrow(_across, pair)).where(enough)
        both = pairs.where(~enough).join(many, "a").join(many.select(F.col("a").alias("b"), F.col("many").alias("many_b")), "b")
        more = far.unionByName(both.withColumn("shared", F.col("shared") + F.least("many", "many_b")).where(enough).select(far.columns))
        more = stored(more.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left").where("ca IS NULL OR cb IS NULL OR ca <> cb").select("a", "b").distinct())
        if more.limit(1).count():
            found = stored(components(links.unionByName(_decided(more, docs, named, sketches, shingle))))
    return members, named, found


def grouped(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    component_id is the least doc_id that links reach (null ids last: a component of null ids alone has null). Texts
    without words, and nulls, have an empty set and are alone: their component is their own id. Repeated rows have equal
    sets and one component. Columns besides doc_id and text aren't read.
    """
    members, named, found = linked_sets(docs, shingle)
    sets = stored(named.join(found, "node", "left").select("node", "doc_id", "n", "copies", F.coalesce("component", "node").alias("c")))
    least = sets.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("component_id"), F.sum("copies").alias("many"))
    several = joined_to(sets.where("n > 0").select("node", "c"), stored(least.where("many > 1").select("c", "component_id")), "c", how="inner")
    ids = joined_to(members, stored(several.select("node", "component_id")), "node")
    return ids.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group, that of the least doc_id, with its columns.

    Of rows that are equal in doc_id and text one stays; rows that share an id with different texts stay together, and
    rows without an id can't be told apart and stay. Documents with empty sets stay.
    """
    ids = grouped(docs, shingle).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("kept"))
    gone = stored(ids.where("NOT kept").select("doc_id"))
    # a row whose place isn't marked stays where it is: only rows that may go are shuffled
    named = docs.where("doc_id IS NOT NULL").withColumn("__perhaps", _marked(docs.sparkSession.sparkContext.broadcast(_filter(gone)))(_place()))
    perhaps = named.where("__perhaps").join(gone.select(F.col("doc_id").alias("__id")), F.col("doc_id") == F.col("__id"), "left_anti")
    out = named.where("NOT __perhaps").unionByName(perhaps).drop("__perhaps")
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count():
        one = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
        out = out.withColumn("__k", F.row_number().over(one)).where("__k = 1").drop("__k")
    return out.unionByName(docs.where("doc_id IS NULL"))
