"""SQL for the queries that plain SQL can express, for DuckDB."""

from __future__ import annotations

from . import quality

_SPACE = r"[\x20\x09-\x0D]"
_WORDS = f"list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '')"

SUBSTRING = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, {_WORDS} AS ws FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS rn FROM p),
c AS (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT doc_id, i, unnest(range(0, 20)) AS k FROM g WHERE rn > 1)),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
m AS (SELECT u.doc_id, u.word, u.pos, c.pos IS NOT NULL AS gone, coalesce(lag(c.pos IS NOT NULL) OVER (PARTITION BY u.doc_id ORDER BY u.pos), false) AS before FROM u LEFT JOIN c ON c.doc_id = u.doc_id AND c.pos = u.pos),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, CAST(coalesce(n_spans, 0) AS INTEGER) AS n_spans FROM d LEFT JOIN s USING (doc_id)"""


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(t, '{pattern}'))"


def _quality(min_words: int = 50, most_class: float = 0.27, most_word: float = 0.4) -> str:
    literal = {k: v.replace("'", "''") for k, v in quality.CLASSES.items()} | {"far": r"[^\x00-\x{24F}]"}
    counts = ", ".join(f"{_count(p)} AS c{i}" for i, p in enumerate(literal.values()))
    n = len(literal)
    rest = f"greatest(0, length(t) - {' - '.join(_count(p) for p in literal.values())}) AS c{n}"
    bins = len(quality.COMMON["en"])
    words = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.COMMON.items()) + " END"

    def distance(own: str, ref: str, k: int, total: str, ref_total: str) -> str:
        parts = []
        for i in range(k):
            p, q = f"({own}{i} / greatest({total}, 1)::DOUBLE)", f"({ref}{i} / greatest({ref_total}, 1)::DOUBLE)"
            m = f"(({p} + {q}) / 2)"
            parts.append("(" + " + ".join(f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / {m}) ELSE 0 END)" for x in (p, q)) + ") / 2")
        return f"sqrt(greatest(0.0::DOUBLE, {' + '.join(parts)}))"

    sums = ", ".join([f"sum(c{i}) AS rc{i}" for i in range(n + 1)] + [f"sum(w{i}) AS rw{i}" for i in range(bins + 1)])
    totals = {x: " + ".join(f"{x}{i}" for i in range(k)) for x, k in (("c", n + 1), ("rc", n + 1), ("w", bins + 1), ("rw", bins + 1))}
    judged = f"n_words >= {min_words} AND rc0 IS NOT NULL"
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, {_WORDS} AS ws, {words} AS cw FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 5)),
r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat FROM (SELECT doc_id, i + unnest(range(0, 5)) AS pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, len(ws) AS n_words, length(t) - {_count(_SPACE)} AS word_chars, {_count('[#*$%&|<>]')} AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, {counts}, {rest},
 {', '.join(f'len(list_filter(ws, lambda x: x = cw[{i + 1}])) AS w{i}' for i in range(bins))} FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - {' - '.join(f'w{i}' for i in range(bins))} AS w{bins} FROM f),
ref AS (SELECT lang, {sums} FROM b WHERE NOT base_failed AND n_words >= {min_words} AND lang IN ({', '.join(repr(k) for k in quality.COMMON)}) GROUP BY lang),
j AS (SELECT b.*, CASE WHEN {judged} THEN {distance('c', 'rc', n + 1, totals['c'], totals['rc'])} END AS class_distance, CASE WHEN {judged} THEN {distance('w', 'rw', bins + 1, totals['w'], totals['rw'])} END AS word_distance FROM b LEFT JOIN ref USING (lang))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, NOT base_failed AND NOT (coalesce(class_distance, 0) > {most_class}::DOUBLE OR coalesce(word_distance, 0) > {most_word}::DOUBLE) AS kept FROM j"""


QUALITY = _quality()


def _crc32(codes: str) -> str:
    """The CRC-32 of a list of bytes, bit by bit; 3988292384 is its polynomial."""
    bit = "xor(x >> 1, (x & 1) * 3988292384)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: {bit})), 4294967295)"


def _codes(text: str) -> str:
    """The UTF-8 bytes of a text up to U+07FF, as numbers."""
    return f"flatten(list_transform(list_transform(string_split({text}, ''), lambda l: unicode(l)::BIGINT), lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))"


PREFIX_TRIE = f"""WITH o AS (SELECT conv_id AS c, list({{'r': r, 't': t}} ORDER BY turn NULLS FIRST, r, sha256(t)) AS ts
 FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT c, ts, {_crc32(_codes('c::VARCHAR'))} % 4 AS h FROM o),
r AS (SELECT h.c, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o AS b ON b.c = h.c - h.c % 20),
p AS (SELECT c, len(ts) AS n, d, ts[1:d] AS k, ts[d] AS last FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
m AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(len({_WORDS.replace('t,', "coalesce(last.t, ''),")})) AS w,
 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY d, k),
x AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM m WHERE d > 0 GROUP BY ALL),
g AS (SELECT m.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * w AS v FROM m LEFT JOIN x ON x.d = m.d AND x.k = m.k),
s AS (SELECT a AS d, k[1:a] AS k, sum(v) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT k, v, n_children, unnest(range(0, d + 1)) AS a FROM g) GROUP BY ALL)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, g.n_convs, g.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN s ON s.d = g.d AND s.k = g.k LEFT JOIN g AS up ON up.d = g.d - 1 AND up.k = g.k[1:g.d - 1]"""

SPELLING = f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]{{6,}}')) AS run FROM documents),
h AS (SELECT run, {_crc32(_codes("coalesce(doc_id::VARCHAR, '') || ':' || run"))} AS h FROM r),
w AS (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h),
v AS (SELECT word, length(word) AS l, count(*) AS n FROM w GROUP BY word HAVING length(word) >= 6 AND count(*) >= 5),
x AS (SELECT word, l, n, i, word[1:i] || word[i + 2:] AS cut FROM (SELECT *, unnest(range(0, l)) AS i FROM v)),
e AS (SELECT a.word, b.word AS near, b.n FROM x AS a JOIN x AS b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM v AS a JOIN x AS b ON a.word = b.cut UNION SELECT b.word, a.word, a.n FROM v AS a JOIN x AS b ON a.word = b.cut),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM e GROUP BY word),
g AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
c AS (WITH RECURSIVE t(word, root) AS (SELECT word, word FROM g UNION ALL SELECT t.word, g.form FROM t JOIN g ON g.word = t.root WHERE g.form IS NOT NULL) SELECT t.word, t.root FROM t JOIN g ON g.word = t.root WHERE g.form IS NULL)
SELECT g.word, form, root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM g JOIN c USING (word)"""
