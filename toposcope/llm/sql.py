"""DuckDB twins of the queries that SQL can express.

The others are tested in ``tests/llm`` against brute force: DuckDB has no XXH64 (op8), counts edits in
bytes (op1), and cannot train or decode the models (op2, op10) nor search a capacity over atomic groups
(op6) or align templates (op5).
"""

from __future__ import annotations

from .mixing import MAX_EPOCHS, TOTAL_SHARE, WEIGHTS
from .quality import MAX_DOCS, MIN_LEFT, MIN_WORDS
from .substrings import LENGTH
from .urls import RULES, TRACKING

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


def quality_sql() -> str:
    norm = _ascii_lower(f"array_to_string({_WORDS.format('line')}, ' ')")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
                  md5(coalesce(text, '')) AS k FROM documents),
w AS (SELECT r, {_WORDS.format('t')} AS ws FROM d),
grams AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (
          SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams JOIN twice USING (r, g)) GROUP BY r),
raw AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM raw GROUP BY r),
lines AS (SELECT r, h, sum(n) AS words FROM (
            SELECT r, ('0x' || substr(md5({norm}), 1, 15))::BIGINT AS h, len({_WORDS.format('line')}) AS n FROM raw)
          GROUP BY r, h),
marked AS (SELECT l.r, d.source, d.k, l.h, l.words FROM lines l JOIN d USING (r)),
freq AS (SELECT source, h FROM (SELECT DISTINCT source, h, k FROM marked)
         GROUP BY source, h HAVING count(*) > {MAX_DOCS}),
lost AS (SELECT m.r, sum(m.words) AS words, count(*) AS n FROM marked m JOIN freq f
         ON m.source IS NOT DISTINCT FROM f.source AND m.h = f.h GROUP BY m.r),
counts AS (SELECT d.r, d.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(lost.n, 0) AS BIGINT) AS n_frequent_lines,
             CAST(len(w.ws) - coalesce(lost.words, 0) AS BIGINT) AS words_left
           FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)),
failed AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND words_left::DOUBLE >= {MIN_LEFT}::DOUBLE * n_words AS kept, n_frequent_lines, words_left
FROM failed"""


def url_sql() -> str:
    fits, verdicts = [], []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        site, _, start = rule.partition("/")
        cond = f"(host = '{site}' OR ends_with(host, '.{site}')) AND starts_with(path, '/{start}')"
        fits.append(f"WHEN {cond} THEN '{rule}'")
        verdicts.append(f"WHEN {cond} THEN '{verdict}'")
    dropped = ", ".join(f"'{t}'" for t in TRACKING)
    return rf"""
WITH p AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
                  THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, rest, regexp_extract(rest, '\A[^/?#]*') AS raw FROM p),
u AS (SELECT page_id, rest, {_ascii_lower('raw')} AS host,
             regexp_extract(substr(rest, length(raw) + 1), '\A[^?#]*') AS path FROM q),
k AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(regexp_replace(rest, '(?s)#.*\z', ''), '(?s)\?(.*)\z', 1), '&'),
                lambda x: x <> '' AND string_split(x, '=')[1] NOT IN ({dropped}))) AS args FROM u),
c AS (SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE
        regexp_replace(host, '\A(www|m)\.', '')
        || regexp_replace(regexp_replace(path, '/index\.html?\z', ''), '/+\z', '')
        || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical_url FROM k),
listed AS (SELECT DISTINCT canonical_url FROM c WHERE page_id % 20 = 0 AND canonical_url <> ''),
j AS (SELECT c.*, l.canonical_url IS NOT NULL AS listed FROM c LEFT JOIN listed l USING (canonical_url))
SELECT page_id, host, path, CASE {' '.join(fits)} END AS rule,
       CASE {' '.join(verdicts)} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, canonical_url, listed FROM j"""


def mixing_sql() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
                  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [{weights}][(row_number() OVER (ORDER BY source IS NULL, source) - 1)
        % {len(WEIGHTS)} + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY {MAX_EPOCHS} * n / w, source) AS k FROM s),
c AS (SELECT *, {TOTAL_SHARE} * sum(n) OVER () - {float(MAX_EPOCHS)} * coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS whole FROM o),
first AS (SELECT k, rest, whole FROM c WHERE rest * w / whole <= {MAX_EPOCHS} * n ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.n::BIGINT AS source_size, CASE WHEN o.k < f.k THEN {float(MAX_EPOCHS)} * o.n ELSE f.rest * o.w / f.whole END AS target
      FROM o CROSS JOIN first f),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN least(floor(t.target)::BIGINT // greatest(t.source_size, 1), {MAX_EPOCHS}) ELSE 0 END AS e,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CASE WHEN e >= {MAX_EPOCHS} THEN 0
        ELSE greatest(0, least(size, floor(target)::BIGINT - e * source_size - before)) END AS part FROM r)
SELECT doc_id, size, source_size, target, CAST(e * size + part AS BIGINT) AS taken,
       CAST(e + CASE WHEN part > 0 AND 2 * part >= size THEN 1 ELSE 0 END AS BIGINT) AS passes FROM x"""


def substring_sql() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i + {LENGTH - 1}], ' ') AS g
        FROM (SELECT r, ws, unnest(range(1, len(ws) - {LENGTH - 2})) AS i FROM d)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
starts AS (SELECT r, i FROM win JOIN twice USING (g)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {LENGTH})) AS i FROM starts),
w AS (SELECT r, doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
kept AS (SELECT w.r, string_agg(w.word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS n
         FROM w LEFT JOIN gone g ON g.r = w.r AND g.i = w.i GROUP BY w.r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256 FROM d LEFT JOIN kept k USING (r)"""


SQL: dict[str, str] = {"op3_quality_rules": quality_sql(), "op4_url_filter": url_sql(), "op7_mixing": mixing_sql(),
                       "op9_substring_dedup": substring_sql()}
