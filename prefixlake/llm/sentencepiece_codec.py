"""SentencePiece encoding and decoding of whole texts, giant ones by a max-plus scan over chunks.

The public model is a BPE one: its ids come from merges in order of rank, not from a best path by summed piece scores. But
BPE ids are a path too: a sequence of pieces is what BPE makes of a text just if BPE leaves each pair of neighbours alone
(encodes the two pieces' text as these two pieces). So give an arc of the lattice of pieces the weight 0 if it follows a
piece that it may follow, else minus infinity; the text's one path of weight 0 is its encoding.

A giant text is cut every CHUNK characters, wherever that is. The state at a cut is the piece that holds the character
before it: where that piece begins and ends. Each chunk, with a piece's length of text on its two sides, gives a transfer
matrix in max-plus algebra from the states at its beginning to those at its end, independently of all others; matrices
hold only their finite entries. Products of matrices are associative: chunks are combined in blocks, blocks give the
states at their bounds, and blocks and then chunks are traced back each for itself.

No piece of the model holds its mark for a space behind another character. So a space after another character is a place
where all paths meet: there a chunk's matrix has rank one, and what lies between its first and its last such place doesn't
depend on the states. It is encoded at once by the library, as texts that aren't giant are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.llm.common import stored

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a text is split, and of a chunk.
GIANT = CHUNK = 32_768
#: Chunks whose matrices are multiplied in one task.
BLOCK = 256
#: Pairs of pieces that a task keeps. Characters or ids that it handles at once, but for a single longer text.
KEPT, AT_ONCE = 50_000, 500_000
MARK = "▁"
#: Where all paths meet: before a mark that follows another character.
_MEET = re.compile(rf"(?<=[^{MARK}])(?={MARK})")


class Codec:
    def __init__(self, model: str = MODEL):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        sp, n = self.sp, self.sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.ids, self.rank = pieces, {p: sp.get_score(i) for p, i in pieces.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, pieces), default=1)
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.pairs: dict[tuple[str, str], bool] = {}

    def encode(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text."""
        ids = self.sp.encode(texts, num_threads=1) if texts else []
        ends = np.cumsum([0, *map(len, ids)])
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])))

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The text of each list of ids; a null list is none."""
        if ids.null_count:
            ids = pa.array([x or [] for x in ids.to_pylist()], ids.type)
        at = ids.offsets.to_numpy()
        values = ids.values.to_numpy()[at[0] : at[-1]].tolist() if len(ids) else []
        at = at - at[0]
        return self.sp.decode([values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]) if len(ids) else []

    def merged(self, text: str) -> list[str]:
        """BPE of a few characters: the pair of the best score merges, the leftmost of equal ones, until none is left."""
        parts = list(text)
        while True:
            best = max(((self.rank[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def follows(self, before: str | None, piece: str) -> bool:
        """Whether BPE leaves a piece alone behind another one, or at a beginning."""
        key = (before or "", piece)
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            ok = self.pairs[key] = self.merged((before or "") + piece) == ([before, piece] if before else [piece])
        return ok

    def forward(self, text: str, begin: int, stop: int, before: str | None, runs: list[dict] | None = None) -> tuple[dict, dict]:
        """The paths of weight 0 from ``begin``, behind the piece ``before``.

        The pieces that end at each place up to ``stop`` (only one piece can, of a given path's beginning), and the exits:
        where pieces that begin before ``stop`` and end there or behind it begin, by (begin, end). A path that goes as one
        of ``runs`` for longer than a piece goes on as that one.
        """
        last: dict[int, str | None] = {begin: before}
        exits: dict[tuple[int, int], str] = {}
        like = [0] * len(runs or ())
        for at in range(begin, stop):
            for r, (other, far) in enumerate(runs or ()):
                like[r] = like[r] + 1 if last.get(at) == other.get(at) else 0
                if like[r] > 2 * self.longest:
                    last |= {k: v for k, v in other.items() if k > at}
                    return last, exits | {k: v for k, v in far.items() if k[0] >= at}
            if at not in last:
                continue
            for n in range(1, min(self.longest, len(text) - at) + 1):
                piece = text[at : at + n]
                if (n == 1 or piece in self.rank) and self.follows(last[at], piece):
                    if at + n < stop:
                        last[at + n] = piece
                    else:
                        exits[at, at + n] = piece
        return last, exits

    def back(self, last: dict, begin: int, end: int) -> list[int]:
        """The ids of the path that ``last`` holds from ``begin`` to ``end``."""
        found = []
        while end > begin:
            found.append(last[end])
            end -= len(last[end])
        return [i for p in reversed(found) for i in self.ids_of(p)]

    def ids_of(self, piece: str) -> list[int]:
        return [self.ids[piece]] if piece in self.ids else [self.bytes[b] for b in piece.encode()]

    def states(self, text: str, at: int) -> list[tuple[int, int]]:
        """The spans of pieces that hold the character before ``at``."""
        spans = [(a, b) for a in range(max(0, at - self.longest), at) for b in range(at, min(len(text), a + self.longest) + 1)]
        return [(a, b) for a, b in spans if b - a == 1 or text[a:b] in self.rank]


@lru_cache(maxsize=2)
def codec_of(model: str) -> Codec:
    return Codec(model)


def _code(before: int, behind: int) -> int:
    """A state at a cut as a number: the characters of its piece before and behind it. 0 is the text's beginning and its end."""
    return before * 4096 + behind


class Chunk:
    """A chunk and its neighbourhood under the model's spaces: its matrix, and its ids when the states at its bounds are known."""

    def __init__(self, codec: Codec, left: str, body: str, right: str, first: bool):
        self.codec = codec
        self.text = (MARK if first else "") + (left + body + right).replace(" ", MARK)
        self.first, self.final = first, not right
        self.p, self.q = len(left), len(self.text) - len(right)
        meets = [m.start() for m in _MEET.finditer(self.text, self.p, self.q) if m.start() >= self.p] if codec.cuts else []
        # a place in the last chunk's end may be one too, but needs no special care
        self.head, self.tail = (meets[0], meets[-1]) if meets else (self.q, None)

    def entries(self) -> dict[int, tuple[int, str | None]]:
        """By state: where its piece ends, and the piece."""
        if self.first:
            return {0: (0, None)}
        return {_code(self.p - a, b - self.p): (b, self.text[a:b]) for a, b in self.codec.states(self.text, self.p)}

    def _exit(self, a: int, b: int) -> int | None:
        if self.final:
            return 0 if b == self.q else None
        return _code(self.q - a, b - self.q)

    def arcs(self) -> list[tuple[int, int]]:
        """The finite entries (state before, state behind) of the matrix; each has weight 0."""
        c, out, runs = self.codec, [], []
        ends = None
        if self.tail is not None:
            ends = {self._exit(a, b) for a, b in c.forward(self.text, self.tail, self.q, None)[1]} - {None}
        for state, (at, piece) in self.entries().items():
            if at > self.head:
                continue
            if at == self.q and self.final and self.tail is None:
                out.append((state, 0))
                continue
            if ends is None:
                run = c.forward(self.text, at, self.q, piece, runs)
                runs.append(run)
                out += [(state, e) for a, b in run[1] if (e := self._exit(a, b)) is not None]
            elif at == self.head or any(b == self.head for _, b in c.forward(self.text, at, self.head, piece)[1]):
                out += [(state, e) for e in ends]
        return out

    def middle(self) -> list[int]:
        """The ids between the places where all paths meet."""
        if self.tail is None:
            return []
        return self.codec.sp.encode(self.text[self.head + 1 : self.tail].replace(MARK, " ")) if self.tail > self.head else []

    def traced(self, entry: int, exit_: int) -> tuple[list[int], list[int]]:
        """The ids of the pieces that begin in this chunk before and behind its middle, given the states at its bounds."""
        c = self.codec
        at, piece = self.entries()[entry]
        if self.tail is None:
            return (self._to(at, piece, exit_) if at < self.q else []), []
        last, ends = c.forward(self.text, at, self.head, piece)
        last |= {b: p for (_, b), p in ends.items() if b == self.head}
        return c.back(last, at, self.head), self._to(self.tail, None, exit_)

    def _to(self, begin: int, before: str | None, exit_: int) -> list[int]:
        last, exits = self.codec.forward(self.text, begin, self.q, before)
        a, piece = next((a, p) for (a, b), p in exits.items() if self._exit(a, b) == exit_)
        return self.codec.back(last, begin, a) + self.codec.ids_of(piece)


def product(a: dict[int, dict[int, float]], b: dict[int, dict[int, float]]) -> dict[int, dict[int, float]]:
    """The max-plus product of two matrices that hold their finite entries by row."""
    out: dict[int, dict[int, float]] = {}
    for i, row in a.items():
        best: dict[int, float] = {}
        for j, w in row.items():
            for k, x in b.get(j, {}).items():
                best[k] = max(best.get(k, w + x), w + x)
        if best:
            out[i] = best
    return out


def matrix(arcs) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for i, j in zip(arcs[::2], arcs[1::2], strict=True):
        out.setdefault(int(i), {})[int(j)] = 0.0
    return out


def trace(matrices: list[dict], entry: int, exit_: int) -> list[tuple[int, int]]:
    """The states before and behind each matrix on the best path from ``entry`` to ``exit_``."""
    best, came = {entry: 0.0}, []
    for m in matrices:
        now, back = {}, {}
        for i, w in best.items():
            for j, x in m.get(i, {}).items():
                if j not in now or w + x > now[j]:
                    now[j], back[j] = w + x, i
        best = now
        came.append(back)
    if exit_ not in best:
        raise ValueError("no path through the chunks' matrices")
    out = []
    for back in reversed(came):
        out.append((back[exit_], exit_))
        exit_ = back[exit_]
    return out[::-1]


def _few(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about AT_ONCE characters or items."""
    import pyarrow.compute as pc

    size = (pc.utf8_length if pa.types.is_string(batch.schema.field(column).type) else pc.list_value_length)(batch.column(column)).fill_null(0).to_pylist()
    begin, held = 0, 0
    for k, n in enumerate(size):
        if held and held + n > AT_ONCE:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    yield batch.slice(begin)


def _with(batch: pa.RecordBatch, but: str, **more: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != but] + list(more)
    return pa.RecordBatch.from_arrays([batch.column(c) for c in names if c not in more] + list(more.values()), names)


def _encoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for part in _few(batch, "__text"):
                yield _with(part, "__text", __ids=codec.encode([t or "" for t in part.column("__text").to_pylist()]))

    return run


#: What a chunk's first pass leaves: its place, matrix, middle ids, and the texts at its two ends.
_LEFT = "__id long, __k int, __arcs array<int>, __middle array<int>, __left string, __body string, __right string, __tail string"


def _matrices(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for part in _few(batch, "__body"):
                out = []
                for i, k, left, body, right in zip(*(part.column(c).to_pylist() for c in ("__id", "__k", "__left", "__body", "__right")), strict=True):
                    c = Chunk(codec, left, body, right, k == 0)
                    arcs = [x for arc in c.arcs() for x in arc]
                    if c.tail is None:  # the second pass needs all of it
                        out.append((i, k, arcs, [], left, body, right, None))
                    else:
                        own = body if k else MARK + body  # as c.text has it; marks and spaces are one to the model
                        out.append((i, k, arcs, c.middle(), left, own[: c.head - c.p], right, own[c.tail - c.p :]))
                types = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], [c.split()[0] for c in _LEFT.split(", ")])

    return run


def _traced(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        names = ("__k", "__left", "__body", "__right", "__tail", "__entry", "__exit")
        for batch in batches:
            before, behind = [], []
            for k, left, body, right, tail, entry, exit_ in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                chunk = Chunk(codec, left, body, right, k == 0) if tail is None else ends(codec, left, body, tail, right, k == 0)
                a, b = chunk.traced(entry, exit_)
                before.append(a)
                behind.append(b)
            ids = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__k"), pa.array(before, ids), batch.column("__middle"), pa.array(behind, ids)], ["__id", "__k", "__before", "__middle", "__behind"])

    return run


def ends(codec: Codec, left: str, body: str, tail: str, right: str, first: bool) -> Chunk:
    """What is left of a chunk whose middle is known: the texts before its first and behind its last meeting place, where all paths meet."""
    c = Chunk.__new__(Chunk)
    c.codec, c.text, c.first, c.final = codec, (left + body + tail + right).replace(" ", MARK), first, not right
    c.p, c.q = len(left), len(c.text) - len(right)
    c.head = c.tail = c.p + len(body)
    return c


def _products(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The product of a block's matrices, in order."""
    order = sorted(zip(rows.column("__k").to_pylist(), rows.column("__arcs").to_pylist(), strict=True))
    whole = matrix(order[0][1])
    for _, arcs in order[1:]:
        whole = product(whole, matrix(arcs))
    arcs = [x for i, row in whole.items() for j in row for x in (i, j)]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([arcs], pa.list_(pa.int32()))], ["__id", "__k", "__arcs"])


def _places(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The states at the bounds of a text's blocks, or of a block's chunks, from those of the whole (0 for a text)."""
    order = sorted(zip(rows.column("__k").to_pylist(), rows.column("__arcs").to_pylist(), strict=True))
    from_, to = (rows.column(c)[0].as_py() for c in ("__from", "__to"))
    found = trace([matrix(arcs) for _, arcs in order], from_, to)
    n = len(order)
    return pa.table([pa.array([key[0].as_py()] * n, pa.int64()), pa.array([k for k, _ in order], pa.int32()), pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32())], ["__id", "__k", "__entry", "__exit"])


def windows(text, size: int, around: int):
    """An array of chunks of ``size`` characters, with up to ``around`` characters on both sides."""
    parts = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))
    one = F.array(parts)  # split once
    beside = lambda p: F.transform(p, lambda x, k: F.struct(F.coalesce(F.right(F.get(p, k - 1), F.lit(around)), F.lit("")).alias("left"), x.alias("body"), F.coalesce(F.left(F.get(p, k + 1), F.lit(around)), F.lit("")).alias("right")))
    return F.element_at(F.transform(one, beside), 1)


def scanned(giants: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """__id and __ids of ``giants`` (__id, __text; no text empty) by the scan. A task holds some chunks, a block's matrices, or one text's ids."""
    around = codec_of(model).longest
    chunk = max(chunk, 4 * around)
    parts = giants.select("__id", F.posexplode(windows(F.col("__text"), chunk, around)).alias("__k", "w")).select("__id", "__k", F.col("w.left").alias("__left"), F.col("w.body").alias("__body"), F.col("w.right").alias("__right"))
    left = stored(parts.repartition("__id", "__k").mapInArrow(_matrices(model), _LEFT))
    arcs = left.select("__id", F.floor(F.col("__k") / BLOCK).cast("int").alias("__block"), "__k", "__arcs")
    state = "__id long, __k int, __entry int, __exit int"
    blocks = arcs.groupBy("__id", "__block").applyInArrow(_products, "__id long, __k int, __arcs array<int>")
    bounds = blocks.withColumns({"__from": F.lit(0), "__to": F.lit(0)}).groupBy("__id").applyInArrow(_places, state)
    bounds = bounds.select("__id", F.col("__k").alias("__block"), F.col("__entry").alias("__from"), F.col("__exit").alias("__to"))
    found = stored(arcs.join(bounds, ["__id", "__block"]).groupBy("__id", "__block").applyInArrow(_places, state))
    traced = left.drop("__arcs").join(found, ["__id", "__k"]).mapInArrow(_traced(model), "__id long, __k int, __before array<int>, __middle array<int>, __behind array<int>")
    ids = traced.select("__id", "__k", F.concat("__before", "__middle", "__behind").alias("__ids"))
    return ids.groupBy("__id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__ids"))), lambda x: x["__ids"])).alias("__ids"))


def encoded(docs: DataFrame, model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ids (array of int) and n_tokens (long) after its other columns; names that clash are replaced.

    Null and empty texts have no ids; repeated rows are encoded each; no rows give none. Texts longer than ``giant`` are
    stored, cut anywhere, and their chunks dealt out anew; one document's ids are the most that comes together in a task.
    """
    names = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    row = F.struct(*(docs[c] for c in names)).alias("__row")
    long = F.coalesce(F.length("text") > giant, F.lit(False))
    schema = "__row struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema if f.name in names) + ">, __ids array<int>"
    plain = docs.where(~long).select(row, F.col("text").alias("__text")).mapInArrow(_encoded(model), schema)
    giants = stored(docs.where(long).select(row).withColumn("__id", F.monotonically_increasing_id()))
    ids = scanned(giants.select("__id", F.col("__row.text").alias("__text")), model, chunk)
    both = plain.unionByName(giants.join(ids, "__id").select("__row", "__ids"))
    return both.select("__row.*", F.col("__ids").alias("ids"), F.size("__ids").cast("long").alias("n_tokens"))


def _decoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model)
        for batch in batches:
            for part in _few(batch, "__ids"):
                yield _with(part, "__ids", __text=pa.array(codec.decode(part.column("__ids")), pa.string()))

    return run


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` (with ids) and the column ``decoded``; null ids count as none. Exact for all texts but those with U+2581, which is a space to the model."""
    names = [c for c in rows.columns if c != "decoded"]
    schema = "__row struct<" + ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in rows.schema if f.name in names) + ">, __text string"
    return rows.select(F.struct(*(rows[c] for c in names)).alias("__row"), F.col("ids").alias("__ids")).mapInArrow(_decoded(model), schema).select("__row.*", F.col("__text").alias("decoded"))


def codec_report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_tokens, text_sha256 and decoded_sha256 (of the text that the ids decode to) of every document; a null text counts as empty."""
    rows = encoded(docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")), model).withColumn("text_sha256", F.sha2("text", 256)).drop("text")
    return decoded(rows, model).withColumn("decoded_sha256", F.sha2("decoded", 256)).select("doc_id", "ids", "n_tokens", "text_sha256", "decoded_sha256")
