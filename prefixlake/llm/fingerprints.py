"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A paragraph is a line; its leaves are pieces, runs of words that end after a word whose hash is 0 modulo PIECE, or at the
paragraph's end (so an edit moves no other piece's bounds). A section is a run of paragraphs that ends after a paragraph
whose digest is 0 modulo SECTION (so an edit moves no other section's bounds), or at the text's end. A paragraph's digest
is SHA-256 of its text, an inner node's that of its children's digests. Roots test equality. Where they differ, only
sections whose digests the other tree hasn't are looked into, in these only paragraphs that it hasn't, and in these only
pieces that it hasn't: they are the edit, and their places in the text its span.

A fingerprint is written ``root:section|section...`` with a section as ``digest[paragraph,paragraph]``, a paragraph as
``digest(pieces)``; digests of inner nodes have 8 hexadecimal digits, pieces 6, the root 64. All of it is DataFrame
functions: no Python runs on executors.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixlake.llm.common import let, text_of

PIECE = 4
SECTION = 8
#: Parts by digest of a range that holds one id alone (or rows without one).
SUBS = 64
#: Bits of a piece's hash; its length in characters stands below them.
BITS, LENGTH = 24, 32
#: Hexadecimal digits of the digests of sections and paragraphs.
SHORT = 8


def _part(values: Column, ends: Column, k: Column) -> Column:
    """The k-th (from 0) of the runs of ``values`` that end at ``ends``."""
    start = F.coalesce(F.get(ends, k - 1), F.lit(0))
    return F.slice(values, start + 1, F.get(ends, k) - start)


def pieces(line: Column) -> Column:
    """The pieces of a paragraph: hash << LENGTH | characters."""

    def of(w: Column) -> Column:
        ends = F.filter(F.transform(w, lambda x, i: F.when((F.pmod(F.xxhash64(x), F.lit(PIECE)) == 0) | (i == F.size(w) - 1), i + 1)), lambda e: e.isNotNull())
        hashed = lambda p: F.call_function("shiftleft", F.xxhash64(p).bitwiseAND((1 << BITS) - 1), F.lit(LENGTH)) + F.length(p)
        return let(ends, lambda c: F.transform(c, lambda e, k: let(F.array_join(_part(w, c, k), ""), hashed)))

    return let(F.regexp_extract_all(line, F.lit("[^ ]+ ?| "), F.lit(0)), of)


def tree(text: Column) -> Column:
    """Struct of root, sections and paragraphs (digests), cuts (last paragraphs of sections, from 1) and leaves (the pieces of each paragraph).

    Splitting into lines and pieces loses no character, so texts with equal roots are equal but for collisions of SHA-256.
    """

    def grown(lines: Column) -> Column:
        def of(d: Column) -> Column:
            cuts = F.filter(F.transform(d, lambda x, i: F.when((F.conv(F.substring(x, 64, 1), 16, 10).cast("int") % SECTION == 0) | (i == F.size(d) - 1), i + 1)), lambda e: e.isNotNull())
            sections = lambda c: F.transform(c, lambda e, k: F.sha2(F.array_join(_part(d, c, k), ","), 256))
            short = lambda xs: F.transform(xs, lambda x: F.substring(x, 1, SHORT))
            return let(cuts, lambda c: let(sections(c), lambda s: F.struct(F.sha2(F.array_join(s, "."), 256).alias("root"), short(s).alias("sections"), short(d).alias("paragraphs"), c.alias("cuts"), F.transform(lines, pieces).alias("leaves"))))

        return let(F.transform(lines, lambda x: F.sha2(x, 256)), of)

    return let(F.split(text, "\n", -1), grown)


def _hash(piece: Column) -> Column:
    return F.call_function("shiftright", piece, F.lit(LENGTH))


def _chars(piece: Column) -> Column:
    return piece.bitwiseAND((1 << LENGTH) - 1)


def written(t: Column) -> Column:
    """The fingerprint as a string."""
    piece = lambda h: F.lpad(F.hex(_hash(h)), BITS // 4, "0")
    paragraphs = F.transform(t["paragraphs"], lambda d, i: F.concat(d, F.lit("("), F.array_join(F.transform(F.get(t["leaves"], i), piece), ""), F.lit(")")))
    section = lambda p: F.transform(t["sections"], lambda d, k: F.concat(d, F.lit("["), F.array_join(_part(p, t["cuts"], k), ","), F.lit("]")))
    return F.lower(F.concat(t["root"], F.lit(":"), F.array_join(let(paragraphs, section), "|")))


def leaves(t: Column) -> Column:
    """The distinct hashes of a tree's pieces."""
    return F.array_distinct(F.transform(F.flatten(t["leaves"]), _hash))


def likeness(a: Column, b: Column, root_a: Column, root_b: Column) -> Column:
    """1 for equal roots; else twice the shared distinct pieces over those of both sides (0 if neither has any)."""
    both = F.size(a) + F.size(b)
    return F.when(root_a == root_b, 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _open(a: Column, b: Column) -> Column:
    """The paragraphs (from 0) of ``a`` in sections that ``b`` hasn't."""
    new = F.array_except(a["sections"], b["sections"])
    runs = F.transform(a["sections"], lambda d, k: F.when(F.array_contains(new, d), F.sequence(F.coalesce(F.get(a["cuts"], k - 1), F.lit(0)), F.get(a["cuts"], k) - 1)))
    return F.flatten(F.filter(runs, lambda r: r.isNotNull()))


def differing(a: Column, b: Column) -> Column:
    """The paragraphs (from 0) in which ``a`` differs from ``b``: those that ``b`` hasn't, in sections that it hasn't. Empty for equal roots."""
    theirs = F.transform(_open(b, a), lambda i: F.get(b["paragraphs"], i))
    hit = let(theirs, lambda t: F.filter(_open(a, b), lambda i: ~F.array_contains(t, F.get(a["paragraphs"], i))))
    return F.when(a["root"] == b["root"], F.array().cast("array<int>")).otherwise(hit)


def _first(own: Column, theirs: Column) -> Column:
    """The place (from 0) of the first of ``own`` that isn't among ``theirs``; 0 if all are. Time grows with the sum of both."""
    return let(own, lambda x: F.greatest(F.coalesce(F.array_position(x, F.get(F.array_except(x, theirs), F.lit(0))), F.lit(1)), F.lit(1)).cast("int") - 1)


def changed(a: Column, b: Column) -> Column:
    """The struct from, to: the characters of ``a``'s text from the first piece that ``b`` hasn't to the last one, by descending on both sides; null for equal roots.

    At each level only the first (the last) node that ``b`` hasn't is looked into; where it has all (they only stand in
    another order or number), the first (the last) of them is.
    """
    chars = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda x, y: x + _chars(y))
    before = lambda i: F.aggregate(F.slice(a["leaves"], F.lit(1), i), F.lit(0).cast("long"), lambda x, p: x + chars(p) + 1)  # noqa: E731  with each line's end
    hashes = lambda p: F.transform(p, _hash)

    def begin(known: Column) -> Column:
        section = _first(a["sections"], b["sections"])
        paragraph = let(section, lambda s: F.coalesce(F.get(a["cuts"], s - 1), F.lit(0)) + _first(_part(a["paragraphs"], a["cuts"], s), b["paragraphs"]))
        at = lambda i: let(F.get(a["leaves"], i), lambda p: before(i) + chars(F.slice(p, F.lit(1), _first(hashes(p), known))))
        return let(paragraph, at)

    def end(known: Column) -> Column:
        section = F.size(a["sections"]) - 1 - _first(F.reverse(a["sections"]), b["sections"])
        paragraph = let(section, lambda s: F.get(a["cuts"], s) - 1 - _first(F.reverse(_part(a["paragraphs"], a["cuts"], s)), b["paragraphs"]))
        at = lambda i: let(F.get(a["leaves"], i), lambda p: before(i) + chars(F.slice(p, F.lit(1), F.size(p) - _first(F.reverse(hashes(p)), known))))
        return let(paragraph, at)

    span = let(F.transform(F.flatten(b["leaves"]), _hash), lambda known: F.struct(begin(known).alias("from"), end(known).alias("to")))
    return F.when(a["root"] != b["root"], span)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` and the column ``fingerprint`` (replaced if there); a null text counts as empty, rows stay as they are."""
    return docs.withColumn("fingerprint", let(tree(text_of()), written))


def ranges(docs: DataFrame, parts: int) -> Column:
    """The number of the part that a row falls in; parts descend as doc_id does, null ids are in the lowest.

    Parts are about ``parts`` ranges of doc_id with as many rows each. An id that fills ranges alone, and the rows without
    an id, have SUBS parts by digest.
    """
    found = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("b")).first()["b"] or []
    often = {b for b, n in Counter(found).items() if n > 1}
    bounds, step = sorted(set(found) | {b + 1 for b in often}), 1
    while step <= len(bounds):
        step *= 2
    steps = F.array(*(F.lit(1 << k) for k in range(step.bit_length() - 1, -1, -1)))
    table = F.lit(bounds or [0])
    place = F.aggregate(steps, F.lit(0), lambda at, by: at + F.when(F.coalesce(F.get(table, at + by - 1) <= F.col("doc_id"), F.lit(False)), by).otherwise(0))  # a binary search
    alone = F.col("doc_id").isNull() | F.coalesce(F.col("doc_id").isin(sorted(often)), F.lit(False)) if often else F.col("doc_id").isNull()
    sub = F.when(alone, F.call_function("shiftrightunsigned", F.col("digest").bitwiseXOR(F.lit(-(1 << 63))), F.lit(64 - SUBS.bit_length() + 1))).otherwise(0)
    return F.coalesce(F.when(F.col("doc_id").isNotNull(), place), F.lit(-1)).cast("long") * SUBS + (SUBS - 1 - sub)


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text, digest) and ``next``, the text of the next row by doc_id descending (null last; equal ids by digest); after the last, the first.

    Rows are dealt by parts (``ranges``), of which the driver holds the bounds; within a part a window looks ahead, and
    the last row of each takes the first of the part after it (one row for each part, joined by the part's number).
    """
    parts = min(10_000, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("part", ranges(rows, parts))
    near = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("digest"))
    first = dealt.groupBy("part").agg(F.min(F.struct(-F.col("doc_id"), "digest")).alias("k")).select(F.col("part").alias("p"), F.col("k.digest").alias("d"))
    heads = dealt.join(F.broadcast(first), (F.col("part") == F.col("p")) & (F.col("digest") == F.col("d"))).groupBy("p").agg(F.min("text").alias("head"))  # equal digests: equal texts
    order = Window.orderBy(F.col("p").desc())  # over the parts' numbers alone
    after = first.select(F.col("p").alias("of"), F.coalesce(F.lead("p").over(order), F.first("p").over(order)).alias("then"))
    ends = after.join(heads, F.col("then") == F.col("p")).select(F.col("of").alias("p"), "head")
    return dealt.withColumn("next", F.lead("text").over(near)).join(ends, F.col("part") == F.col("p"), "left").withColumn("next", F.coalesce("next", "head")).drop("p", "part", "head")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, their likeness, and the span of the document that the edited text hasn't (null if they are equal).

    The edited text keeps the first half (the longer, for odd lengths) and takes the first code points of the next
    document, by doc_id descending, for the other half. Repeated rows are documents of their own; null texts are empty;
    a sole document is its own next one. Columns besides doc_id and text aren't read.
    """
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("digest", F.xxhash64("text", F.lit(1)))
    both = with_next(rows).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half), F.substring(F.col("next"), F.lit(1), half))
    both = both.withColumn("edited", edited).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), tree(F.col("text")).alias("own"), tree(F.col("edited")).alias("other"), tree(F.col("next")).alias("after"))
    own, other, after = F.col("own"), F.col("other"), F.col("after")
    out = both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        written(own).alias("fingerprint"),
        written(other).alias("edited_fingerprint"),
        likeness(leaves(own), leaves(other), own["root"], other["root"]).alias("near_edited"),
        likeness(leaves(own), leaves(after), own["root"], after["root"]).alias("near_next"),
        changed(own, other).alias("changed"),
    )
    return out.withColumns({"changed_from": F.col("changed.from"), "changed_to": F.col("changed.to")}).drop("changed")
