"""DuckDB twins of the operators that SQL can express."""

from __future__ import annotations

from . import license_scan as ls, line_chunks as lc, quality_divergence as qd

_CLASS_SQL = {"lower": "[a-z]+", "space": r"[ \t-\r]+", "mark": r"[.,;:!?''\"()-]+", "upper": "[A-Z]+",
              "letter": r"[\p{L}\p{M}]+", "digit": r"\p{N}+", "rest": "(?s).+"}


def _chain() -> str:
    """left1 .. left7: the text after each class is taken out, as nested selects."""
    sql = "SELECT doc_id, lang, text AS left0 FROM src"
    for i, (name, _) in enumerate(qd.CLASSES):
        sql = f"SELECT *, regexp_replace(left{i}, '{_CLASS_SQL[name]}', '', 'g') AS left{i + 1} FROM ({sql})"
    return sql


def _bits(p: str, q: str) -> str:
    def part(a, b):
        return f"CASE WHEN {a} > 0 THEN ({a}) * log2(2 * ({a}) / (({a}) + ({b}))) ELSE 0 END"
    return f"(({part(p, q)}) + ({part(q, p)})) / 2"


#: Divergence of a text without common words.
_NONE = f"(coalesce(known, 0) / 2 + {_bits('1.0', 'greatest(1 - coalesce(known, 0), 0)')})"
_NAMES = [n for n, _ in qd.CLASSES]

QUALITY = f"""
WITH src AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents),
w AS (SELECT doc_id, lang, text,
             list_filter(regexp_split_to_array(text, '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM src),
tok AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
win AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS g
        FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE g IS NOT NULL)
          WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
lin AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM src)
        WHERE regexp_matches(line, '[^ \\t-\\r]') GROUP BY doc_id),
cls AS (SELECT doc_id, lang, length(left0) AS n_chars,
               {', '.join(f"length(left{i}) - length(left{i + 1}) AS c_{n}" for i, n in enumerate(_NAMES))}
        FROM ({_chain()})),
m AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             n_chars, {', '.join(f'c_{n}' for n in _NAMES)}
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lin USING (doc_id) JOIN cls USING (doc_id, lang)),
langs AS (SELECT lang, sum(n_words) AS words, sum(n_chars) AS chars, {', '.join(f'sum(c_{n}) AS r_{n}' for n in _NAMES)}
          FROM m WHERE lang IS NOT NULL GROUP BY lang
          HAVING sum(n_words) * {qd.LANGUAGE_SHARE} >= (SELECT sum(n_words) FROM m) AND sum(n_chars) > 0),
low AS (SELECT doc_id, lang, lower(word) AS word FROM tok JOIN (SELECT doc_id, lang FROM src) USING (doc_id)),
common AS (SELECT lang, word, count(*) / any_value(words) AS q FROM low JOIN langs USING (lang)
           GROUP BY lang, word HAVING count(*) * {qd.COMMON_SHARE} >= any_value(words) AND regexp_matches(word, '\\p{{L}}')),
known AS (SELECT lang, sum(q) AS known FROM common GROUP BY lang),
hits AS (SELECT doc_id, c.lang, p, q FROM (SELECT doc_id, word, count(*) / any_value(n_words) AS p
                                           FROM low JOIN (SELECT doc_id, n_words FROM m) USING (doc_id) GROUP BY doc_id, word)
         JOIN common c USING (word)),
got AS (SELECT doc_id, lang, sum({_bits('p', 'q')}) AS f, sum(p) AS p, sum(q) AS q FROM hits GROUP BY doc_id, lang),
dist AS (SELECT m.doc_id, langs.lang, n_words,
  CASE WHEN n_chars > 0 THEN sqrt(greatest({' + '.join(f"({_bits(f'(c_{n} / n_chars)', f'(r_{n} / chars)')})" for n in _NAMES)}, 0)) ELSE 1 END AS ch,
  CASE WHEN n_words > 0 AND {_NONE} > 0 THEN sqrt(greatest(coalesce(f, 0) + (coalesce(known, 0) - coalesce(got.q, 0)) / 2
    + {_bits('greatest(1 - coalesce(got.p, 0), 0)', 'greatest(1 - coalesce(known, 0), 0)')}, 0) / ({_NONE})) ELSE 1 END AS wo
  FROM m CROSS JOIN langs LEFT JOIN known ON known.lang = langs.lang LEFT JOIN got ON got.doc_id = m.doc_id AND got.lang = langs.lang),
near AS (SELECT doc_id, min(struct_pack(a := round(greatest(ch / {qd.MAX_CHAR_DISTANCE}, wo / ({qd.MAX_WORD_DISTANCE} + {qd.WORD_NOISE} / greatest(n_words, 1))), 6),
                                        ch := round(ch, 6), wo := round(wo, 6), lang := lang)) AS x
         FROM dist GROUP BY doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {qd.MIN_WORDS} OR 100 * n_repeat_words > {qd.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {qd.MIN_WORDS} OR 100 * n_repeat_words > {qd.MAX_REPEAT_PERCENT} * n_words)
         AND coalesce((n_chars < {qd.CHAR_GUARD} OR x.ch <= {qd.MAX_CHAR_DISTANCE})
                      AND (n_words < {qd.WORD_GUARD} OR x.wo <= {qd.MAX_WORD_DISTANCE} + {qd.WORD_NOISE} / n_words), true) AS kept,
       x.lang AS nearest_lang, x.ch AS char_distance, x.wo AS word_distance
FROM m LEFT JOIN near USING (doc_id)
"""

LINES = f"""
WITH d AS (SELECT doc_id, text, coalesce(string_split(text, chr(10)), []) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i, len(ls) AS n FROM d),
h AS (SELECT *, ('0x' || md5(line)[1:8])::BIGINT AS h FROM l),
e AS (SELECT doc_id, i, line, (i + 1 = n OR (h + {lc.FACTOR} * coalesce(lag(h) OVER o, 0)) % {lc.DIVISOR} = 0) AS ends
      FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, line,
             coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
      FROM e),
ch AS (SELECT doc_id, place, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS body,
              count(*) FILTER (regexp_matches(line, '[^ \\t-\\r]')) >= 2 AS many
       FROM c GROUP BY doc_id, place),
rn AS (SELECT *, many AND row_number() OVER (PARTITION BY many, body ORDER BY doc_id, place) > 1 AS gone FROM ch)
SELECT d.doc_id, len(ls)::BIGINT AS lines, count(place)::BIGINT AS line_chunks,
       count(*) FILTER (gone)::BIGINT AS chunks_removed, coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS lines_removed,
       md5(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_md5
FROM d LEFT JOIN rn USING (doc_id) GROUP BY d.doc_id, ls
"""

#: Unsigned crc32 of a string of ASCII characters.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i::INT, 1))::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [1::UBIGINT, 1, 1, 1, 1, 1, 1, 1]),
                           lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""

TRIE = f"""
WITH o AS (SELECT conv_id, r, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, left(t, 64), md5(strlen(r) || ':' || r || t)) AS p
           FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS b, ({_CRC32.format(s='conv_id::VARCHAR')} % 9)::BIGINT AS h FROM n),
re AS (SELECT c.conv_id, p AS pos, r, t FROM c JOIN o ON o.conv_id = c.b AND o.p <= c.h
       UNION ALL
       SELECT c.conv_id, p - h + least(h, coalesce(n.n, 0)), r, t FROM c JOIN o ON o.conv_id = c.conv_id AND o.p > c.h LEFT JOIN n ON n.conv_id = c.b),
mem AS (SELECT conv_id, pos AS depth, strlen(t) AS bytes, list(struct_pack(r := r, t := t)) OVER (PARTITION BY conv_id ORDER BY pos) AS node FROM re
        UNION ALL SELECT conv_id, 0, 0, [] FROM n),
nodes AS (SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(bytes) AS bytes, count(*) AS n_convs FROM mem GROUP BY node),
kids AS (SELECT node[:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
ends AS (SELECT node, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS e
         FROM mem m JOIN (SELECT conv_id, max(depth) AS depth FROM mem GROUP BY conv_id) USING (conv_id, depth) GROUP BY node),
below AS (SELECT m.node, sum((n_convs - 1) * n.bytes) AS saved, count(*) FILTER (k.node IS NULL) AS leaves
          FROM nodes n LEFT JOIN kids k ON k.node = n.node JOIN mem m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY m.node)
SELECT a.conv_id, a.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM nodes a JOIN below USING (node) LEFT JOIN kids k ON k.node = a.node LEFT JOIN ends x ON x.node = a.node
LEFT JOIN nodes p ON a.depth > 0 AND p.node = a.node[:a.depth - 1]
"""


def _licenses() -> str:
    rules = ", ".join(f"('{w}', '{r.keyword}', '{r.regex}', {r.cls}, {r.place}, '{r.label}')" for r in ls.rules() for w in r.first)
    base = " ".join("WHEN " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split(), 1)) + f" THEN '{name}'" for p, name in ls.BASE.items())
    scores = " ".join(f"WHEN {cls} THEN {value}" for cls, value in ls.SCORES.items())
    better = "row(x.cls, x.less, x.place) < row(a.cls, a.less, a.place)"
    return f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ls.UPPER}', '{ls.LOWER}'), '{ls.BREAKS}'),
                                      lambda x: x <> '') AS w FROM documents),
tok AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
base AS (SELECT doc_id, count(*) AS n, min(i) AS lo, max(i) AS hi, list_sort(list_distinct(list(name))) AS names
         FROM (SELECT doc_id, i, CASE {base} END AS name FROM tok) WHERE name IS NOT NULL GROUP BY doc_id),
rules AS (SELECT * FROM (VALUES {rules}) r(first_word, keyword, regex, cls, place, label)),
hit AS (SELECT doc_id, i, cls, place, label, regexp_extract(snippet, regex) AS m
        FROM (SELECT doc_id, i, w[i + 1] AS first_word, ' ' || array_to_string(list_slice(w, i + 1, i + {ls.SPAN}), '  ') || ' ' AS snippet FROM tok)
        JOIN rules USING (first_word) WHERE contains(snippet, keyword)),
det AS (SELECT doc_id, i, cls, place, label, (length(m) - length(replace(m, ' ', ''))) // 2 AS n FROM hit WHERE m <> ''),
-- one list a document, folded from the left: a is the detection that stands, x the next one
folded AS (SELECT doc_id, list_reduce(list(struct_pack(start := i, cls := cls, less := -n, place := place, label := label, stop := i + n,
                                                       labels := []::VARCHAR[], best := 9) ORDER BY i, cls, -n, place),
             lambda a, x: CASE WHEN x.start >= a.stop THEN struct_pack(start := x.start, cls := x.cls, less := x.less, place := x.place, label := x.label,
                                 stop := x.stop, labels := list_append(a.labels, a.label), best := least(a.best, a.cls))
                               WHEN {better} THEN struct_pack(start := x.start, cls := x.cls, less := x.less, place := x.place, label := x.label,
                                 stop := x.stop, labels := a.labels, best := a.best)
                               ELSE a END) AS f FROM det GROUP BY doc_id),
kept AS (SELECT doc_id, list_append(f.labels, f.label) AS labels, least(f.best, f.cls) AS best FROM folded)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(names, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), coalesce(labels, [])))), ',') AS labels,
       greatest(CASE best {scores} ELSE 0 END, CASE WHEN n > 0 THEN {ls.BASE_SCORE} ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


LICENSES = _licenses()
