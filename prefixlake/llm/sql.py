"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
_NOWHITE = r"regexp_replace({}, '[\x20\x09-\x0D]', '', 'g')"

OP1 = f"""WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS pos FROM d WHERE len(l) >= 3),
h AS (SELECT doc_id, text, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] AS win FROM w WHERE {_NOWHITE.format("l[pos] || l[pos + 1] || l[pos + 2]")} <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS LAST, text, pos) AS k FROM h),
c AS (SELECT DISTINCT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS line FROM r WHERE k > 1),
k AS (SELECT doc_id, text, list(line) AS cov FROM c GROUP BY doc_id, text)
SELECT o.doc_id, CASE WHEN k.cov IS NULL THEN o.text ELSE array_to_string(list_filter(list_transform(range(1, len(string_split(o.text, chr(10))) + 1), lambda i: CASE WHEN list_contains(k.cov, i) THEN NULL ELSE string_split(o.text, chr(10))[i] END), lambda x: x IS NOT NULL), chr(10)) END AS text,
coalesce(len(string_split(o.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(k.cov), 0)::BIGINT AS n_removed
FROM documents o LEFT JOIN k ON k.doc_id IS NOT DISTINCT FROM o.doc_id AND k.text = o.text"""

_BIN = "((v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0))"


def _fences(level: str, keys: str, using: str) -> str:
    of = lambda m, e: f"max(CASE WHEN metric = '{m}' THEN {e} END)"
    tails = {"word_len": (900, 3, 500), "symbols": (900, 3, 20), "dup_lines": (990, 1, 20), "repeats": (990, 1, 20)}
    highs = ", ".join(f"{of(m, f'high + {k} * (high - mid) + {floor}')} AS high_{m}" for m, (_, k, floor) in tails.items())
    tail = "CASE metric " + " ".join(f"WHEN '{m}' THEN {t}" for m, (t, *_) in tails.items()) + " END"
    group = f"GROUP BY {keys}" if keys else ""
    part = f"PARTITION BY {using}"
    return f"""{level}m AS (SELECT {keys + ', ' if keys else ''}metric, bin, sum(n) AS n FROM bins GROUP BY ALL),
{level}r AS (SELECT *, sum(n) OVER ({part} ORDER BY bin) AS upto, sum(n) OVER ({part}) AS docs FROM {level}m),
{level}q AS (SELECT {keys + ', ' if keys else ''}metric, max(docs) AS docs, min(bin) FILTER (WHERE upto * 1000 >= docs * (1000 - {tail})) AS low, min(bin) FILTER (WHERE upto * 2 >= docs) AS mid, min(bin) FILTER (WHERE upto * 1000 >= docs * {tail}) AS high FROM {level}r GROUP BY ALL),
{level} AS (SELECT {keys + ', ' if keys else ''}max(docs) AS docs, {highs}, {of('word_len', 'low - 3 * (mid - low) - 500')} AS low_word_len FROM {level}q {group})"""


_HIGHS = ("high_word_len", "high_symbols", "high_dup_lines", "high_repeats", "low_word_len")

OP4 = f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS} AS w, list_filter(string_split(text, chr(10)), lambda x: {_NOWHITE.format('x')} <> '') AS l FROM t),
g AS (SELECT rid, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS g FROM w, unnest(range(1, len(w) - 6)) u(i)),
gg AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT p) AS n FROM gg, unnest(range(i, i + 8)) u(p) GROUP BY rid),
b AS (SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length({_NOWHITE.format('text')})::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(CASE WHEN len(w) > 8 THEN rw.n END, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN rw USING (rid)),
m AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words END AS word_len, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines END AS dup_lines,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words END AS repeats, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
ok AS (SELECT * FROM m WHERE NOT base_failed), x AS (SELECT lang, source, 'word_len' AS metric, word_len AS v FROM ok UNION ALL SELECT lang, source, 'symbols', symbols FROM ok UNION ALL SELECT lang, source, 'dup_lines', dup_lines FROM ok UNION ALL SELECT lang, source, 'repeats', repeats FROM ok),
bins AS (SELECT lang, source, metric, {_BIN} AS bin, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY ALL),
{_fences('own', 'lang, source', 'lang, source, metric')},
{_fences('wide', 'lang', 'lang, metric')},
{_fences('whole', '', 'metric')},
f AS (SELECT own.lang, own.source, {', '.join(f'CASE WHEN own.docs >= 200 THEN own.{c} WHEN wide.docs >= 200 THEN wide.{c} ELSE whole.{c} END AS {c}' for c in _HIGHS)} FROM own JOIN wide ON own.lang IS NOT DISTINCT FROM wide.lang, whole)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND word_len <= high_word_len AND symbols <= high_symbols AND dup_lines <= high_dup_lines AND repeats <= high_repeats AND word_len >= low_word_len, false) AS kept, word_len, symbols, dup_lines, repeats
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source"""

OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace('text', "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s), e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n"""

# the template's marks around a text of each role, and the growth of escaped characters
_ESCAPED = "(2 * length({0}) - length(regexp_replace({0}, '[\\\\<\\[\\]]', '', 'g')))"
_FORMATTED = f"""{_ESCAPED.format("coalesce(text, '')")}
  + CASE role WHEN 'assistant' THEN 4 WHEN 'user' THEN 13 WHEN 'system' THEN 31 ELSE 14 + {_ESCAPED.format("coalesce(role, '')")} END"""

OP9 = f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, count(*) OVER (PARTITION BY conv_id) AS n, {_FORMATTED} AS f FROM c),
x AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END))::BIGINT AS formatted_chars
FROM x GROUP BY conv_id"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len({_WORDS.replace('text', "coalesce(text, '')")})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS w, 3 * source_size AS lim FROM s),
tot AS (SELECT sum(source_size)::BIGINT AS t FROM s),
it AS (SELECT 0 AS i, 0::BIGINT AS capped, (SELECT sum(w) FROM k)::BIGINT AS wsum, -1::BIGINT AS before
  UNION ALL SELECT i + 1, (SELECT coalesce(sum(lim), 0) FROM k, tot WHERE w * (t - it.capped) > lim * it.wsum)::BIGINT, (SELECT coalesce(sum(w), 0) FROM k, tot WHERE NOT (w * (t - it.capped) > lim * it.wsum))::BIGINT, it.capped FROM it WHERE it.capped <> it.before AND it.wsum > 0 AND i < 60),
last AS (SELECT * FROM it ORDER BY i DESC LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN t = 0 OR wsum = 0 OR w * (t - capped) > lim * wsum THEN lim::DOUBLE ELSE (w * (t - capped))::DOUBLE / wsum::DOUBLE END AS target FROM k, tot, last),
r AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || digest), 1, 8) AS BIGINT) / 4294967296.0 AS draw FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

SQL = {"op1_line_dedup": OP1, "op4_quality_rules": OP4, "op7_jaccard_join": OP7, "op9_chat_format": OP9, "op10_mix_sources": OP10}
