"""The corpus operators on a small fixture with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from prefixlake.llm import chat_format, fingerprints, jaccard_join, lang_id, license_scan, line_dedup, mixing, quality_rules, sentencepiece_codec, toxicity, wordhash
from prefixlake.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    syllables = ["ta", "ri", "mo", "len", "ku", "shi", "or", "an", "de", "vi", "pel", "so"]
    words = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(n)]
    return "".join(w + (".\n" if i % 13 == 12 else " ") for i, w in enumerate(words)).strip()


@pytest.fixture(scope="module")
def rows():
    a, b = prose(1, 300), prose(2, 200)
    w = a.split(" ")
    near = " ".join([*w[:100], "changed", *w[101:]])
    shared = "\n".join(f"this line {k} stands in many documents {k}" for k in range(6))
    out = [
        (1, a, "xx", "s1"), (2, a, "xx", "s1"), (3, near, "xx", "s1"), (4, b, "xx", "s2"), (5, b + "\n" + shared, "xx", "s2"), (6, prose(3, 80) + "\n" + shared + "\n" + prose(4, 90), None, "s2"),
        (7, None, None, None), (8, "", "xx", None), (9, "one two three", "xx", "s3"), (10, "ONE two\tthree", "yy", "s3"), (11, "a", None, None), (None, prose(5, 60), "yy", "s1"), (None, None, "yy", "s1"),
        (13, "same same same same " * 60, "xx", "s1"), (14, "$$ ## % * " * 20, "xx", "s1"), (15, prose(6, 30_000), "yy", "s2"), (16, " \n\t ", "xx", "s9"), (17, shared, "xx", "s2"), (17, shared, "xx", "s2"), (18, "\n\n\n\n", "xx", "s2"),
        (19, "x" * 40_000, "xx", "s2"), (20, "Ünïcödé ÀÉ 漢字 " * 40, "zz", "s2"), (21, "a  b   c  " * 30, "xx", "s2"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Further columns under the names that operators use."""
    return docs.selectExpr("*", "1 AS quality", "2 AS n_lines", "3 AS ids", "4 AS target", "5 AS source_size", "6 AS node", "7 AS size", "8 AS kept", "9 AS fingerprint", "10 AS h", "11 AS at", "12 AS starts")


def repeats(words):
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({p for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)})


def test_quality_counts(spark, docs, rows):
    got = sorted((tuple(r)[:7] for r in quality_rules.quality_report(docs).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        rep = repeats(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 20 or 100 * rep > 30 * len(w)))
    assert got == sorted(want, key=str)


def test_quality_keeps_clean_and_drops_junk(spark, docs):
    clean = spark.createDataFrame([(1000 + k, prose(100 + k, 120), "xx", "s1", 0) for k in range(40)], SCHEMA)
    report = quality_rules.quality_report(docs.unionByName(clean), min_docs=20).collect()
    out = {r["doc_id"]: r["kept"] for r in report if r["doc_id"] is not None}
    assert all(out[1000 + k] for k in range(40)) and out[1] and not out[13] and not out[14] and not out[7]
    kept = quality_rules.quality_filter(clashing(docs.unionByName(clean)), min_docs=20)
    assert kept.columns == clashing(docs).columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in report if r["kept"])
    assert quality_rules.quality_report(empty(spark)).count() == 0 == quality_rules.quality_filter(empty(spark)).count()


def test_each_fence_moves_with_its_source(spark):
    """Two sources that differ in every ratio have other fences, and each rejects a text that passes the base rules and the other source."""
    def text(k, long, symbols, dup, rep):
        w = [x + ("ational" if long else "") for x in prose(20_000 + k, 200).replace(".\n", " ").split()]
        w += ["$$"] * (symbols if k % 3 else symbols // 2)
        run = [f"run{k}{i}" for i in range(8)]
        w += run * (2 if rep and k % 20 == 0 else 0)  # one text in 20 has a repeat
        lines = [" ".join(w[i : i + 10]) for i in range(0, len(w), 10)]
        return "\n".join(lines + lines[: 2 if dup and k % 20 == 1 else 0])

    rows = [(k, text(k, s, 20 * s, s, s), "xx", f"s{s}", 0) for s in (0, 1) for k in range(1000 * s, 1000 * s + 300)]
    fence = {r["source"]: r for r in quality_rules.thresholds(quality_rules.measured(spark.createDataFrame(rows, SCHEMA)).drop("text")).collect()}
    for m in quality_rules.METRICS:
        assert fence["s1"][f"high_{m}"] > fence["s0"][f"high_{m}"], (m, fence)
    long = lambda t: t.replace(" ", "ational ")
    odd = [prose(30_000, 200), "\n".join((x := prose(30_001, 200).split("\n")) + x[:2]), prose(30_002, 200) + " " + "again these eight words stand here once more " * 2, long(prose(30_003, 200))]
    tail = [" $$" * 20, "", "", ""]
    both = rows + [(9000 + 10 * s + k, (long(t) if s and k < 3 else t) + tail[k], "xx", f"s{s}", 0) for k, t in enumerate(odd) for s in (0, 1)]
    kept = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in quality_rules.quality_report(spark.createDataFrame(both, SCHEMA)).where("doc_id >= 9000").collect()}
    assert not any(b for _, b in kept.values()) and [kept[9000 + k][0] for k in range(4)] == [False] * 4 and [kept[9010 + k][0] for k in range(4)] == [True] * 4, kept


def test_sketches_merge(spark, docs):
    measured = quality_rules.measured(docs).drop("text")
    whole = quality_rules.sketch(measured)
    parts = quality_rules.sketch(measured.where("doc_id % 2 = 0")).unionByName(quality_rules.sketch(measured.where("doc_id % 2 = 1 OR doc_id IS NULL")))
    merged = parts.groupBy("lang", "source", "metric", "bin").agg(F.sum("n").alias("n"))
    assert whole.exceptAll(merged).count() == 0 == merged.exceptAll(whole).count()


def dedup_plain(rows):
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            win = tuple(lines[k : k + 3])
            if WORD.search("".join(win)):
                if win in seen:
                    gone |= {k, k + 1, k + 2}
                seen.add(win)
        out[i, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_line_dedup(spark, docs, rows):
    want = dedup_plain(rows)
    got = sorted((tuple(r) for r in line_dedup.dedup_report(docs).collect()), key=str)
    assert got == sorted(((i, *(want[i, t] if t is not None else (None, 0, 0))) for i, t, *_ in rows), key=str)
    again = line_dedup.dedup(clashing(docs))
    assert again.columns == [*[c for c in clashing(docs).columns if c != "n_lines"], "n_lines", "n_removed"]
    assert line_dedup.dedup_report(empty(spark)).count() == 0


def sets_plain(rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def groups_plain(rows):
    sets = sets_plain(rows)
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(x)] = top(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def test_jaccard_join(spark, docs, rows):
    assert sorted((tuple(r) for r in jaccard_join.grouped(docs).collect()), key=str) == groups_plain(rows)
    kept = jaccard_join.deduplicated(clashing(docs))
    assert kept.columns == clashing(docs).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 1 in ids and not {2, 3, 10} & set(ids) and ids.count(17) == 1 and {7, 8, 16} <= set(ids) and ids.count(None) == 2
    assert jaccard_join.grouped(empty(spark)).count() == 0


def test_jaccard_join_classes_are_made_in_tasks(spark):
    """The classes are those of the summed tables, and the driver holds no table of numbers while they are made."""
    import tracemalloc

    rows = [(k, prose(k, 30) + " the same nine words stand in all of these", None, None, 0) for k in range(200)]
    first = jaccard_join.stored(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text").repartition(3).mapInArrow(jaccard_join._members(5), "doc_id long, n long, node long, part int, counts binary"))
    tracemalloc.start()
    got = jaccard_join.commonness(first)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.zeros((2 * jaccard_join.PARTS, jaccard_join.COUNTERS // jaccard_join.PARTS))
    for r in first.where("part IS NOT NULL").collect():
        counts[r["part"]] += np.frombuffer(r["counts"], np.uint16)
    counts = counts.reshape(2, -1)
    mean = counts.mean(axis=1, keepdims=True)
    want = np.where(counts > mean + 8 * np.sqrt(mean) + 8, np.log2(counts + 1), 0).max(axis=0)
    assert (got == want.astype(np.uint8)).all() and got.any() and peak < 8 * jaccard_join.COUNTERS


@pytest.mark.parametrize(("part", "whole"), [(2048, 11), (8, 2)])
def test_jaccard_join_of_a_large_group(spark, monkeypatch, part, whole):
    """Near copies of one text, copies of copies, and a passage that many unlike texts share: long index lists, also dealt in parts."""
    monkeypatch.setattr(jaccard_join, "PART", part)
    monkeypatch.setattr(jaccard_join, "WHOLE", whole)
    rng = np.random.default_rng(4)
    base = prose(7, 150).split()
    passage = prose(8, 60)
    rows = []
    for k in range(120):
        w = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 8))):
            w[at] = f"e{rng.integers(0, 50)}"
        rows.append((k, " ".join(w), None, None, 0))
    rows += [(200 + k, prose(300 + k, 60) + " " + passage + " " + prose(600 + k, 60), None, None, 0) for k in range(60)]
    rows += [(400 + k, prose(300 + k, 9) + " " + passage + " " + prose(900 + k // 2, 60)[: 40 + k], None, None, 0) for k in range(60)]  # mostly the passage, some alike
    rows += [(500 + k, rows[3][1], None, None, 0) for k in range(80)]  # a hot text
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(r) for r in jaccard_join.grouped(df).collect()), key=str) == groups_plain(rows)


def test_jaccard_join_stores_no_sets(spark, tmp_path):
    """A group whose texts meet in many pairs, most of them just too unlike to link, and others: the sets aren't stored, so what the join stores is small beside the texts."""
    rng = np.random.default_rng(9)
    base = prose(11, 1500).split()
    rows = []
    for k in range(160):
        w = list(base)
        for at in rng.choice(1500, int(rng.integers(5, 60)), replace=False):
            w[at] = f"e{rng.integers(0, 1 << 40)}"
        rows.append((k, " ".join(w), None, None, 0))
    rows += [(1000 + k, prose(2000 + k, 1500), None, None, 0) for k in range(100)]  # texts like no other
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    stored = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = stored()
    jaccard_join.grouped(df).write.parquet(str(tmp_path / "out"))
    assert stored() - before < 0.45 * sum(len(r[1]) for r in rows)
    assert sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == groups_plain(rows)


def test_jaccard_dedup_shuffles_only_what_may_go(spark):
    """Rows that stay for sure aren't shuffled; ids of any integer type, repeated ids and other columns are kept."""
    rows = [(k, prose(50 + k % 90, 40), None, None, 0) for k in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("int"))
    kept = jaccard_join.deduplicated(df)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == list(range(90))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "LeftSemi" not in plan and "ArrowEvalPython" in plan


def test_jaccard_join_sketches_rule_out_no_link():
    """Places that differ are at most as many as the shingles that do, also where one sketch has twice or more the places; equal sets differ in none."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 300, 1000, 4096, 5000, 70_000, 140_000):
        both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for more, less in ((0, 0), (1, 0), (n // 8, n // 9), (n, 3 * n)):
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in (more, less))
            bound = jaccard_join._differ(jaccard_join.sketch(a), jaccard_join.sketch(b))
            assert bound <= len(np.setxor1d(a, b)) and bound == jaccard_join._differ(jaccard_join.sketch(b), jaccard_join.sketch(a))
            if more + less == 0:
                assert bound == 0
    a, b = rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    assert jaccard_join._differ(jaccard_join.sketch(np.unique(a)), jaccard_join.sketch(np.unique(b))) > 112  # unlike sets are told apart


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 340)] + [(5, 5)]
    root = {}

    def top(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: top(k) for k in list(root)}


def test_word_hashes_agree_with_words():
    texts = ["one two  three", "", None, "Two\tONE", "é ü", "x" * 50]
    flat = {}
    for _, data, offsets in wordhash.slices(pa.array(texts, pa.string())):
        starts, ends, begin = wordhash.word_spans(data, offsets)
        h = wordhash.span_hashes(data, starts, ends)
        for r in range(len(offsets) - 1):
            words = WORD.findall(texts[r] or "")
            assert begin[r + 1] - begin[r] == len(words)
            for w, x in zip(words, h[begin[r] : begin[r + 1]], strict=True):
                assert flat.setdefault(w, x) == x
    assert len(set(flat.values())) == len(flat)


def test_mixing(spark, docs, rows):
    got = mixing.mixed_report(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == sorted(((i, size(t)) for i, t, *_ in rows), key=str)
    per = {}
    for _, t, _, s, _ in rows:
        per[s] = per.get(s, 0) + size(t)
    order = sorted(per, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = set()
    while True:
        share = (sum(per.values()) - sum(3 * per[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in order if s in capped or share * weight[s] > 3 * per[s]}
        if more == capped:
            break
        capped = more
    for r, (_, _, _, s, _) in zip(sorted(got, key=lambda r: str(r["doc_id"])), sorted(rows, key=lambda r: str(r[0])), strict=True):
        if r["doc_id"] not in (None, 17):
            assert r["target"] == pytest.approx(3 * per[s] if s in capped else share * weight[s]) and r["taken"] <= 3 * r["size"]
    many = spark.range(4000).selectExpr("id AS doc_id", "'one two three' AS text", "NULL AS lang", "concat('s', id % 4) AS source", "0L AS n_chars")
    taken = mixing.mixed_report(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) < 0.1 * r["target"] for r in taken)
    bare = mixing.mixed_report(many.withColumns({"doc_id": F.lit(None).cast("long"), "text": F.concat_ws(" ", "text", "doc_id")})).agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).first()
    assert abs(bare["taken"] - bare["size"]) < 0.1 * bare["size"]  # rows without an id have draws of their own
    mixed = mixing.mix(clashing(docs))
    assert mixed.columns == clashing(docs).columns and mixed.exceptAll(mixing.mix(clashing(docs))).count() == 0
    assert sum(size(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mixed_report(empty(spark)).count() == 0 == mixing.mix(empty(spark)).count()


def test_fingerprints(spark, docs, rows):
    got = sorted((r.asDict() for r in fingerprints.edit_report(docs).collect()), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["n_chars"]))
    texts = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), len(r[1])))
    named = [k for k, (i, _) in enumerate(texts) if i is not None]
    for k in named[:-1]:
        t, after = texts[k][1], texts[k + 1][1]
        half = len(t) // 2
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
    by_text = {}
    for (_, t), r in zip(texts, got, strict=True):
        assert by_text.setdefault(t, r["fingerprint"]) == r["fingerprint"] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(set(by_text.values())) == len(by_text)
    assert got[[i for i, _ in texts].index(17)]["near_next"] == 1.0
    one = fingerprints.edit_report(docs.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0 and 0.3 < one["near_edited"] < 0.8
    assert fingerprints.edit_report(empty(spark)).count() == 0
    assert "fingerprint" in fingerprints.fingerprints(clashing(docs)).columns


def test_fingerprints_keep_pieces_after_an_early_edit(spark):
    long = [prose(70 + k, 100).replace("\n", " ") for k in range(8)]
    pairs = [(t, t.split(" ", 1)[1]) for t in long] + [(t[:119], t[:119] + "tail") for t in long]  # a word less; across 120 characters
    both = spark.createDataFrame(pairs, "a string, b string").select(fingerprints.tree(F.col("a")).alias("a"), fingerprints.tree(F.col("b")).alias("b"))
    near = both.select(fingerprints.likeness(fingerprints.leaves(F.col("a")), fingerprints.leaves(F.col("b")), F.col("a.root"), F.col("b.root")).alias("x")).collect()
    assert min(r["x"] for r in near[:8]) > 0.8 and np.median([r["x"] for r in near[8:]]) > 0.5, near


def plain_tree(text):
    """root, sections (digest and paragraph numbers), paragraphs (digest, pieces with hash and length), in plain loops."""
    paragraphs, sections, part = [], [], []
    lines = text.split("\n")
    for k, line in enumerate(lines):
        pieces, run = [], ""
        for w in re.findall("[^ ]+ ?| ", line):
            run += w
            if xxhash.xxh64_intdigest(w.encode(), seed=42) % 4 == 0:
                pieces.append(run)
                run = ""
        pieces += [run] if run else []
        digest = hashlib.sha256(line.encode()).hexdigest()
        paragraphs.append((digest, [(xxhash.xxh64_intdigest(p.encode(), seed=42) & 0xFFFFFF, len(p)) for p in pieces]))
        part.append(k)
        if int(digest[-1], 16) % 8 == 0 or k == len(lines) - 1:
            sections.append((hashlib.sha256(",".join(paragraphs[n][0] for n in part).encode()).hexdigest(), part))
            part = []
    return hashlib.sha256(".".join(d for d, _ in sections).encode()).hexdigest(), sections, paragraphs


def plain_written(tree):
    root, sections, paragraphs = tree
    one = lambda n: paragraphs[n][0][:8] + "(" + "".join(f"{h:06x}" for h, _ in paragraphs[n][1]) + ")"
    return root + ":" + "|".join(d[:8] + "[" + ",".join(map(one, part)) + "]" for d, part in sections)


def plain_likeness(a, b):
    x, y = ({h for _, ps in t[2] for h, _ in ps} for t in (a, b))
    return 1.0 if a[0] == b[0] else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def plain_changed(a, b):
    if a[0] == b[0]:
        return None, None
    first = lambda own, theirs: next((k for k, x in enumerate(own) if x not in theirs), 0)
    known = {h for _, ps in b[2] for h, _ in ps}
    theirs, old = {d[:8] for d, _ in b[1]}, {d[:8] for d, _ in b[2]}
    starts = np.cumsum([0] + [sum(c for _, c in ps) + 1 for _, ps in a[2]])
    out = []
    for way in (1, -1):
        part = a[1][::way][first([d[:8] for d, _ in a[1]][::way], theirs)][1][::way]
        n = part[first([a[2][m][0][:8] for m in part], old)]
        pieces = a[2][n][1][::way]
        at = sum(c for _, c in pieces[: first([h for h, _ in pieces], known)])
        out.append(int(starts[n] + (at if way == 1 else sum(c for _, c in pieces) - at)))
    return tuple(out)


def test_fingerprints_are_the_plain_tree(spark, docs):
    """The whole report against plain loops: order of documents, edited texts, trees, likeness, located spans. Ids that are null or shared by many as well."""
    rng = np.random.default_rng(2)
    paragraphs = [f"paragraph {k} of a store, " + " ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"], 9)) for k in range(60)]
    rows = [(k, "\n".join(rng.choice(paragraphs, int(rng.integers(1, 30)))), None, None, 0) for k in range(80)]
    rows += [(40, f"shared id {k}", None, None, 0) for k in range(60)] + [(None, f"no id {k} " * 5, None, None, 0) for k in range(30)] + [(90, "é漢 \n\n  x ", None, None, 0), (91, "", None, None, 0), (92, None, None, None, 0), (93, prose(5, 20_000), None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS digest", "2 AS next", "3 AS part", "4 AS p")
    signed = lambda t: (x := xxhash.xxh64_intdigest(b"\x01\x00\x00\x00", seed=xxhash.xxh64_intdigest(t.encode(), seed=42))) - (1 << 64 if x >> 63 else 0)  # noqa: E731  of the text, then of 1
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        a, b, c = plain_tree(t), plain_tree(e), plain_tree(after)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_written(a), plain_written(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9), *plain_changed(a, b)))
    got = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in fingerprints.edit_report(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fingerprints_locate_an_edit(spark):
    text = "\n".join(f"paragraph {k} holds words of its own number {k}" for k in range(30))
    pair = spark.createDataFrame([(text, text.replace("paragraph 12 holds", "paragraph 12 held"))], "a string, b string")
    trees = pair.select("a", fingerprints.tree(F.col("a")).alias("x"), fingerprints.tree(F.col("b")).alias("y"))
    found = trees.select(fingerprints.differing(F.col("x"), F.col("y")).alias("at"), fingerprints.changed(F.col("x"), F.col("y")).alias("span")).first()
    assert found["at"] == [12]
    at = text.index("paragraph 12 holds")
    assert at <= found["span"]["from"] <= text.index("holds", at) < found["span"]["to"] <= text.index("\n", at)


TALK = [
    (1, 0, "system", "be \\kind [INST]"), (1, 1, "user", "hi </s> \\l"), (1, 2, "assistant", "<s>a[/INST]"), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "b]\\e"), (1, 6, "user", "left"),
    (2, 0, "user", "no answer"), (3, None, "assistant", "x"), (3, 1, "tool [x]", "out\nput"), (3, 2, "assistant", "y"), (4, 1, "user", "same"), (4, 1, "user", "same"), (4, 1, "assistant", "tie"), (None, 0, None, "q"), (None, 1, "assistant", "r"), (5, 0, "assistant", None),
]


def test_chat_format(spark):
    talk = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1))
    got = {r["conv_id"]: r for r in chat_format.read_report(chat_format.with_mask(chat_format.examples(talk))).collect()}
    by = collections.defaultdict(list)
    for c, turn, role, text in TALK:
        by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    ex = chat_format.examples(talk, keep_rest=False).where("conv_id = 1").orderBy("example").collect()
    assert len(ex) == 3 and ex[1]["context"].endswith("[INST][/INST]") and ex[1]["target"] == "</s>"
    assert chat_format.examples(talk.limit(0)).count() == 0


def test_sentencepiece_equals_the_library(spark, docs, rows, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    extra = [(50, "mark ▁ in ▁▁ text", None, None, 0), (51, "  lead and trail  ", None, None, 0), (52, "tab\tnew\n\nline \x00 <s> </s> <0x41>", None, None, 0)]
    nospace = prose(60, 900).replace(" ", "").replace("\n", "")
    extra += [(53, nospace, None, None, 0), (54, nospace.replace("a", "▁▁a"), None, None, 0), (55, "漢字かなTokyo=-" * 400, None, None, 0), (56, " " * 3000 + "end", None, None, 0), (57, ("aaaa" * 700) + "\U0001f600" * 300, None, None, 0)]
    both = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    monkeypatch.setattr(sentencepiece_codec, "BLOCK", 3)
    got = sentencepiece_codec.encoded(clashing(both), giant=1000, chunk=256)
    assert got.columns == [*[c for c in clashing(both).columns if c != "ids"], "ids", "n_tokens"]
    found = sorted((str(r["doc_id"]), r["text"] or "", list(r["ids"]), r["n_tokens"]) for r in got.collect())
    assert found == sorted((str(i), t or "", sp.encode(t or ""), len(sp.encode(t or ""))) for i, t, *_ in [*rows, *extra])
    same = sentencepiece_codec.codec_report(both).where("text_sha256 <> decoded_sha256").collect()
    assert sorted(r["doc_id"] for r in same) == [50, 54]
    assert sentencepiece_codec.codec_report(empty(spark)).count() == 0


def test_the_scan_cuts_anywhere():
    """Chunks with and without spaces: the product of all matrices is one entry, and the traced ids are the library's."""
    codec = sentencepiece_codec.codec_of(sentencepiece_codec.MODEL)
    rng = np.random.default_rng(8)
    texts = [prose(61, 150), prose(62, 150).replace(" ", ""), "".join(rng.choice(list("ab  eё漢\n.-=*09 tion"), 900)), "a" * 700, "0123456789" * 70]
    for text in texts:
        for size in (64, 101, 250):
            parts = [text[k : k + size] for k in range(0, len(text), size)]
            near = codec.longest
            chunks = [sentencepiece_codec.Chunk(codec, parts[k - 1][-near:] if k else "", p, parts[k + 1][:near] if k + 1 < len(parts) else "", k == 0) for k, p in enumerate(parts)]
            each = [sentencepiece_codec.matrix([x for arc in c.arcs() for x in arc]) for c in chunks]
            left, right = each[0], each[-1]
            for m in each[1:]:
                left = sentencepiece_codec.product(left, m)
            for m in each[-2::-1]:
                right = sentencepiece_codec.product(m, right)
            assert left == right == {0: {0: 0.0}}
            ids = [i for c, (a, b) in zip(chunks, sentencepiece_codec.trace(each, 0, 0), strict=True) for part in (lambda ends, c=c: (ends[0], c.middle(), ends[1]))(c.traced(a, b)) for i in part]
            assert ids == codec.sp.encode(text)


def test_language_identification(spark):
    rows = []
    for k in range(400):
        lang, syl = [("aa", ["ka", "lo", "mi"]), ("bb", ["sch", "ung", "ver"]), ("cc", ["ñe", "ció", "ra"])][k % 3]
        rng = np.random.default_rng(k)
        rows.append((k, " ".join("".join(rng.choice(syl, 3)) for _ in range(40)), lang, None, 0))
    rows += [(1000, None, "aa", None, 0), (1001, "", "aa", None, 0), (1002, "12 !! 3", None, None, 0), (None, "kalomi kalo", "aa", None, 0)]
    got = lang_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {i: lang for i, _, lang, *_ in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(held) > 50 and np.mean([r["lang_pred"] == want[r["doc_id"]] for r in held]) > 0.98
    assert all(r["lang_pred"] == "und" for r in got if (r["doc_id"] or 0) >= 1000) and all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows)
    none = lang_id.identify(spark.createDataFrame([(1, "abc", None, None, 0)], SCHEMA)).first()
    assert none["lang_pred"] == "und" and lang_id.identify(empty(spark)).count() == 0


def plain_subwords(text):
    """The buckets of a text's byte grams: 3 and 4 bytes whose inner ones are letters, with what isn't a letter as a space."""
    data, inside = text.lower().encode(), []
    for k, b in enumerate(data):
        punctuation = any(data[j : j + 2] == b"\xe2\x80" and j <= k < j + 3 and j + 2 < len(data) for j in (k - 2, k - 1, k) if j >= 0)
        inside.append((chr(b).isalpha() and b < 128 or b >= 128) and not punctuation)
    x = [32] + [b if ok else 32 for b, ok in zip(data, inside, strict=True)] + [32]
    real, m, out = [b != 32 for b in x], 1 << 32, []
    for k in range(len(x) - 2):
        if real[k + 1]:
            out.append((x[k] + x[k + 1] * 257 + x[k + 2] * 66049) * 2654435761 % m)
    for k in range(len(x) - 3):
        if real[k + 1] and real[k + 2]:
            out.append(((x[k] + x[k + 1] * 257 + x[k + 2] * 66049 + x[k + 3] * 16974593) * 2246822519 + 97) % m)
    return [h >> (32 - lang_id.BUCKETS.bit_length() + 1) for h in out]


def test_language_identification_is_the_plain_model(spark, docs, rows):
    """Predictions against loops over bytes, for the fixture's texts: long ones, repeated rows, other scripts, clashing names."""
    texts, langs = [r[1] for r in rows if r[1] and r[2]], [r[2] for r in rows if r[1] and r[2]]
    model = lang_id.train(texts, langs)
    held = clashing(docs).selectExpr("*", "false AS held_out", "1 AS low", "2 AS some", "3 AS score")
    got = lang_id.predicted(held.select("doc_id", "text", "held_out"), model).collect()
    want = []
    for i, t, *_ in rows:
        if not t or not any(c.isalpha() for c in t):
            want.append((i, "und", 0.0))
            continue
        h = plain_subwords(t)
        z = (model.bias + np.mean([model.table[k].astype(float) for k in h], axis=0)) / model.heat
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        want.append((i, model.langs[int(p.argmax())], float(p.max())))
    key = lambda r: (str(r[0]), r[1], round(r[2], 6))
    assert sorted(map(key, ((r["doc_id"], r["lang_pred"], r["score"]) for r in got))) == sorted(map(key, want))
    bare = spark.createDataFrame([(None, f"text {k} of rows without ids", "aa" if k % 2 else "bb", None, 0) for k in range(300)], SCHEMA)
    assert 60 < len(lang_id.sample(bare, most=100)[0]) < 140


def toxic_rows(n):
    bad, rows, labels = ["vilezor", "grubnak", "skeltor"], [], []
    for k in range(n):
        w, rng = prose(5000 + k, 60).split(), np.random.default_rng(k)
        if k % 5 == 0:
            for at in rng.integers(0, 60, 3):
                w[at] = str(rng.choice(bad))
        rows.append((k, " ".join(w), None, None, 0))
        labels.append((k, int(k % 5 == 0)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows(400)
    extra = [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "VILEZOR!! " * 3, None, None, 0), (None, "mild words", None, None, 0), (1, rows[1][1], None, None, 0)]
    df, known = spark.createDataFrame(rows + extra, SCHEMA), spark.createDataFrame([*labels, (3, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, known).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(rows) + 5 and len(held) > 40 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    score = {r["doc_id"]: r for r in got}
    assert score[1002]["predicted"] == 1 and score[1000]["score"] == score[1001]["score"] < 0.5 and score[1002]["evidence_ids"]
    assert toxicity.toxicity(empty(spark), known).count() == 0
    assert {r["score"] for r in toxicity.toxicity(df, known.limit(0)).collect()} == {0.0}


def plain_toxicity(rows, labels):
    """score by doc_id: dictionaries, all cosines, the same votes and the same cross-fitted calibration."""
    known = {}
    for i, c in labels:
        if i is not None and c in (0, 1):
            known[i] = max(c, known.get(i, 0))
    learn = sorted({i: t for i, t, *_ in rows if i in known and t is not None and zlib.crc32(str(i).encode()) % 5 != 0 and len(t) <= toxicity.TRAIN_CHARS}.items())
    terms = lambda t: collections.Counter(x for w in re.findall("[a-z]+", (t or "").lower()) for x in ([w, (w[:6],)] if len(w) > 6 else [w]))

    def index(part):
        n = [sum(known[i] == c for i, _ in part) for c in (0, 1)]
        seen = collections.Counter((x, known[i]) for i, t in part for x in terms(t))
        idf = {x: np.log(1 + sum(n) / (1 + seen[x, 0] + seen[x, 1])) * (toxicity.FLOOR + abs(np.log((seen[x, 1] + 0.5) / (n[1] + 1)) - np.log((seen[x, 0] + 0.5) / (n[0] + 1)))) for x, _ in seen}

        def vector(t):
            v = {x: (1 + np.log(k)) * idf[x] for x, k in terms(t).items() if x in idf}
            size = np.sqrt(sum(a * a for a in v.values())) or 1
            return {x: a / size for x, a in v.items()}

        return [(known[i], vector(t)) for i, t in part], vector

    def voted(held, v):
        near = sorted(((round(min(1.0, sum(a * e.get(x, 0) for x, a in v.items())), 12), c) for c, e in held), key=lambda p: -p[0])[: toxicity.NEAREST]
        near = [p for p in near if p[0] > 0]
        return (sum(c / (1.05 - s) for s, c in near) / sum(1 / (1.05 - s) for s, _ in near), near[0][0]) if near else None

    some = sorted((r for r in learn if terms(r[1])), key=lambda r: (known[r[0]], r[0]))
    x, y = [], []
    for k in range(toxicity.PARTS):
        held, vector = index([r for j, r in enumerate(some) if j % toxicity.PARTS != k])
        for i, t in some[k :: toxicity.PARTS]:
            if v := voted(held, vector(t)):
                x.append([1.0, *v])
                y.append(known[i])
    fit = toxicity.logistic(np.array(x), np.array(y, float), np.ones(len(x)))
    held, vector = index(some)
    bare = [known[i] for i, t in learn if not terms(t)]
    share = np.mean([known[i] for i, _ in learn])
    out = collections.defaultdict(set)
    for i, t, *_ in rows:
        v = voted(held, vector(t))
        out[i].add(round(1 / (1 + np.exp(-(fit @ [1.0, *v]))), 9) if v else round((sum(bare) + share) / (len(bare) + 1), 9))
    return out


def test_toxicity_is_the_plain_search(spark, docs):
    rows, labels = toxic_rows(150)
    rows += [(900 + k, prose(40 + k, 20) + " vilezor", None, None, 0) for k in range(5)] + [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "?? 12", None, None, 0), (1003, "vilezor", None, None, 0), (1004, prose(77, 20_000), None, None, 0)]
    rows += [rows[4], rows[4]]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS low", "2 AS score", "3 AS held_out", "0 AS toxic")
    known = spark.createDataFrame([*labels, (1001, 1), (1004, 0)], "doc_id long, toxic int").selectExpr("*", "'x' AS text")
    want = plain_toxicity(rows, [*labels, (1001, 1), (1004, 0)])
    got = toxicity.toxicity(df, known).collect()
    assert len(got) == len(rows)
    for r in got:
        assert round(r["score"], 9) in want[r["doc_id"]] or min(abs(r["score"] - w) for w in want[r["doc_id"]]) < 1e-8, (r, want[r["doc_id"]])


def test_toxicity_indexes_every_example_and_searches_every_text():
    rows, labels = toxic_rows(200)
    rows.append((200, "rarebadword beside plain talk", None, None, 0))
    model = toxicity.train(np.arange(201), [r[1] for r in rows], np.array([c for _, c in labels] + [1]), np.ones(201))
    assert sorted(model.index.ids.tolist()) == list(range(201))
    for text, nearest in (("one rarebadword here", 200), (rows[1][1], 1)):  # a word of one example; a text without a toxic word
        found = np.concatenate([h for _, h in toxicity.terms(pa.array([text]), model.index.vocabulary)])
        _, best, cosine = model.score([found])[0]
        assert model.index.ids[best[0]] == nearest and cosine[0] > 0


def test_neighbours_are_exact():
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 3, 40)
    vectors = [toxicity.vector(rng.integers(0, 40, int(rng.integers(1, 12))), idf) for _ in range(500)]
    index = toxicity.Index(np.arange(40, dtype=np.uint64), idf, vectors, rng.integers(0, 2, 500), np.arange(500))
    dense = np.zeros((500, 40))
    for row, k in enumerate(index.ids):
        dense[row, vectors[k][0]] = vectors[k][1]
    for q in vectors[:60]:
        x = np.zeros(40)
        x[q[0]] = q[1]
        cos = np.minimum(dense @ x, 1).round(12)
        want = [k for k in np.lexsort((np.arange(500), -cos)) if cos[k] > 0][:15]
        best, cosine = index.nearest([q])[0]
        assert best.tolist() == want and np.allclose(cosine, cos[want])


#: Wrapped notices, in other words and places than training has them.
WRAPPED = {
    "gpl": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "lgpl": " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.",
    "agpl": "You should have received a copy of the GNU Affero General\nPublic License along with this\nprogram.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "bsd": "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are\n// met:\n// Redistributions of source code must retain the above copyright\n// notice, this list of conditions and the following disclaimer.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n    http://www.apache.org/licenses/LICENSE-2.0",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "cc-by-sa": "This work is licensed under the Creative Commons\nAttribution-ShareAlike 4.0 International License.",
}
NOTICES = [
    ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("Released under MIT", "mit"),
    ("Veröffentlicht unter der MIT-Lizenz", "mit"), ("Licensed under CC BY-SA 4.0", "cc-by-sa"), ("Licensed under CC BY-ND 4.0", "cc-by-nd"), ("Distributed under the Boost Software License, Version 1.0", "boost"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("This code is not licensed under the MIT license.", "unknown"), ("Licensed under the Elastic License 2.0", "unknown"), ("The licensor grants you a license to use the software for one year.", "unknown"), ("Er kam mit dem Zug.", None),
]


def plain_scan(rows, model):
    """(n_passages, families, license, probability) of each row by loops over words."""
    out = []
    features, firsts = {g: i for i, g in enumerate(model.grams)}, {}
    for t, (_, pairs, _) in enumerate(model.templates):
        for g in pairs:
            firsts.setdefault(g, []).append(t)
    for i, text, *_ in rows:
        found = []
        for body in re.split("\n[ \t\r\f\v]*\n", text or ""):
            w = license_scan._tokens(body)
            groups, last = [], None
            for at in range(len(w)):
                new = [g for n in (1, 2, 3) if len(g := tuple(w[at : at + n])) == n and g in features]
                pair = tuple(w[at : at + 2])
                if new and (last is None or at - last > license_scan.GAP):
                    groups.append((set(), set()))
                if groups and (new or (last is not None and at - last <= license_scan.GAP)):
                    groups[-1][0].update(new)
                    groups[-1][1].update([pair] if pair in firsts else [])
                last = at if new else last
            found += [g for g in groups if sum(model.speaks[features[x]] for x in g[0]) >= license_scan.LEAST]
        best, families = [], set()
        for grams, pairs in found:
            p = model.probabilities(grams)
            f = model.families[max(range(len(p)), key=lambda k: (p[k], model.families[k]))]
            sure = {fam for fam, ps, n in model.templates if len(ps & pairs) >= n}
            if p.max() >= model.certain and f in sure and f != "unknown":
                families.add(f)
                best.append((p.max(), f))
        out.append((i, len(found), tuple(sorted(families)), max(best)[1] if best else "unknown" if found else None, round(max(best)[0], 9) if best else None))
    return out


def test_license_scan(spark, docs, rows):
    near = [prose(700 + k, 30) for k in range(80)]
    cases = [(1100 + k, t, want) for k, (t, want) in enumerate(NOTICES)] + [(1200 + k, t, want) for k, (want, t) in enumerate(WRAPPED.items())]
    more = [(i, f"{near[i % 80]}\n{t}\n{near[(i + 1) % 80]}", None, None, 0) for i, t, _ in cases]
    more += [(1300, f"{WRAPPED['mit']}\n\n{prose(9, 12_000)}\n \n{NOTICES[3][0]}", None, None, 0), (1301, f"{NOTICES[0][0]}\n\n{NOTICES[1][0]}", None, None, 0), more[0]]
    all_ = [*rows, *more]
    df = spark.createDataFrame(all_, SCHEMA).selectExpr("*", "1 AS digest", "2 AS para", "3 AS h", "4 AS feature", "5 AS passage", "6 AS family")
    got = [(r["doc_id"], r["n_passages"], tuple(r["families"]), r["license"], None if r["probability"] is None else round(r["probability"], 9)) for r in license_scan.scan(df).collect()]
    assert sorted(got, key=str) == sorted(plain_scan(all_, license_scan.train()), key=str)
    found = {r[0]: r for r in got}
    assert [(t, found[i][3]) for i, t, _ in cases] == [(t, want) for _, t, want in cases]
    assert found[1300][2] == ("gpl", "mit") and found[1301][2] == ("apache", "mit") and found[7][3] is None is found[8][3]
    assert license_scan.scan(empty(spark)).count() == 0


def test_pipeline_against_a_plain_version(spark, tmp_path, rows):
    import corpus_pipeline

    some = [r for r in rows if r[0] is not None and r[0] != 17] + [(2000 + k, prose(9000 + k, 90), "xx", "s1", 0) for k in range(30)]
    spark.createDataFrame(some, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r["doc_id"], r["text"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    df = spark.createDataFrame(some, SCHEMA)
    kept = {r["doc_id"] for r in quality_rules.quality_report(df).where("kept").collect()}
    left = [r for r in some if r[0] in kept]
    cut = dedup_plain(left)
    left = [(i, cut[i, t][0], lang, s, n) for i, t, lang, s, n in left]
    group = {i: c for i, _, c in groups_plain(left)}
    left = [r for r in left if group[r[0]] == r[0]]
    rate = {r["doc_id"]: r["target"] / r["source_size"] if r["source_size"] else 0 for r in mixing.mixed_report(spark.createDataFrame(left, SCHEMA)).collect()}

    def copies(i, t):  # also of documents that line dedup emptied
        draw = int(hashlib.md5(f"mix-1:{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:8], 16) / 2**32
        return int(rate[i]) + (draw < rate[i] - int(rate[i]))

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    want = sorted((i, t, tuple(sp.encode(t))) for i, t, *_ in left for _ in range(copies(i, t)))
    assert got == want and any(not t for _, t, _ in got) and len(corpus_pipeline.STAGES) == 5
