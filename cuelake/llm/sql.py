"""DuckDB SQL for the operators whose contract SQL can express."""

from __future__ import annotations

from .jaccard import PERCENT, SHINGLE
from .repeats import PASSAGE, PASSAGE_WORDS, WIDTH
from .seeds import WINDOW
from .spelling import DROPPED_EACH, FORM_TIMES, LEAST_COUNT, LEAST_LETTERS, LETTERS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of a word in hex, a blank after each.
HEX_WORD = "(?:(?:0[0-8EF]|1[0-9A-F]|2[1-9A-F]|[3-9A-F][0-9A-F]) )+"


def runs_sql(name: str, width: int) -> str:
    """Maximal runs of bytes that repeated strings of a width cover, as `name`; t holds the bytes."""
    return f"""w{width} AS (SELECT doc_id, s, md5(hex(array_slice(b, s + 1, s + {width}))) AS h FROM (SELECT doc_id, b, unnest(range(0, n - {width - 1})) AS s FROM t WHERE n >= {width}) x),
again{width} AS (SELECT h FROM w{width} GROUP BY h HAVING count(*) > 1),
d{width} AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM w{width} WHERE h IN (SELECT h FROM again{width})),
g{width} AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + {width} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM d{width}),
{name} AS (SELECT doc_id, run, min(s) AS low, max(s) + {width} AS high FROM g{width} GROUP BY doc_id, run)"""


REPEATS = f"""WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
{runs_sql('r', WIDTH)},
{runs_sql('q', PASSAGE)},
passages AS (SELECT q.doc_id, count(*) AS n FROM q JOIN t ON q.doc_id = t.doc_id WHERE len(regexp_extract_all(regexp_replace(hex(array_slice(t.b, q.low + 1, q.high)), '(..)', '\\1 ', 'g'), '{HEX_WORD}')) > {PASSAGE_WORDS} GROUP BY q.doc_id),
k AS (SELECT doc_id, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS low, low AS high FROM r UNION ALL SELECT t.doc_id, coalesce(max(r.high), 0), any_value(t.n) FROM t LEFT JOIN r ON t.doc_id = r.doc_id GROUP BY t.doc_id),
kept AS (SELECT k.doc_id, string_agg(hex(array_slice(t.b, k.low + 1, k.high)), '' ORDER BY k.low) AS hexed FROM k JOIN t ON k.doc_id = t.doc_id WHERE k.high > k.low GROUP BY k.doc_id),
cut AS (SELECT doc_id, CAST(sum(high - low) AS BIGINT) AS gone, count(*) AS runs FROM r GROUP BY doc_id)
SELECT t.doc_id, CAST(t.n AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(hexed, ''))) AS kept_sha256, coalesce(passages.n, 0) AS n_passages FROM t LEFT JOIN cut ON t.doc_id = cut.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id LEFT JOIN passages ON t.doc_id = passages.doc_id"""

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {SHINGLE} THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i: array_to_string(words[i:i + {SHINGLE - 1}], ' '))) END AS own FROM w),
s AS (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM sets),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met WHERE 100 * c >= {PERCENT} * (an + bn - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, CAST(any_value(len(own)) AS BIGINT) AS n_shingles, min(reach.b) AS component_id FROM sets JOIN reach ON sets.doc_id = reach.a GROUP BY sets.doc_id"""

#: crc32 by its polynomial, a table of 256 entries first.
CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
hashed AS (SELECT id, run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(id || ':' || run)) + 1), lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i - 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc)"""

SPELLING = f"""WITH RECURSIVE runs AS (SELECT id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) AS run FROM documents) x WHERE length(run) >= {LEAST_LETTERS} GROUP BY id, run),
{CRC},
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {DROPPED_EACH} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed) x WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
less AS (SELECT word, k, substr(word, 1, CAST(k AS INT) - 1) || substr(word, CAST(k AS INT) + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words) x),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word UNION SELECT less.word, rest FROM less JOIN words ON rest = words.word UNION SELECT rest, less.word FROM less JOIN words ON rest = words.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, {{'n': -o.n, 'w': other}}) AS other, max(o.n) AS other_n, any_value(w.n) AS n FROM near JOIN words o ON o.word = other JOIN words w ON w.word = near.word GROUP BY near.word),
forms AS (SELECT word, n_near, CASE WHEN other_n >= {FORM_TIMES} * n THEN other END AS form, CASE WHEN other_n >= {FORM_TIMES} * n THEN other_n END AS form_n FROM best),
follow(word, root, k) AS (SELECT word, word, 0 FROM words UNION ALL SELECT follow.word, form, k + 1 FROM follow JOIN forms ON follow.root = forms.word WHERE form IS NOT NULL)
SELECT words.word, form, arg_max(root, k) AS root, any_value(words.n) AS n, CAST(coalesce(any_value(n_near), 0) AS BIGINT) AS n_near, any_value(form_n) AS form_n FROM words JOIN follow ON follow.word = words.word LEFT JOIN forms ON forms.word = words.word GROUP BY words.word, form"""

PASSAGES = f"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM t WHERE len(words) >= {WINDOW}) x),
first_ AS (SELECT h, min(doc_id) AS least FROM w GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM w JOIN first_ USING (h) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)"""
