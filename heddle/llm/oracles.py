"""DuckDB SQL of the operators that SQL can express, written from their contracts."""

from __future__ import annotations

from . import minhash, mixing, quality_rules, url_filters

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, 'null') AS host, coalesce(text, '') AS t, {_WORDS} AS words FROM documents),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS k FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
dup AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM dup) GROUP BY r),
m AS (SELECT w.r, doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON cov.r = w.r),
q AS (SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < {quality_rules.MIN_WORDS} AS short, 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS repeats,
    100 * n_symbols > {quality_rules.MAX_SYMBOL_PERCENT} * word_chars AS symbols, 100 * (len(lines) - len(list_distinct(lines))) > {quality_rules.MAX_DUP_LINE_PERCENT} * len(lines) AS dup_lines FROM m),
f AS (SELECT r, host, rule, hit FROM q UNPIVOT (hit FOR rule IN (short, repeats, symbols, dup_lines))),
h AS (SELECT host, rule, count(*) AS n, count(*) FILTER (hit) AS k FROM f GROUP BY 1, 2),
p AS (SELECT rule, CAST(sum(k) AS DOUBLE) / sum(n) AS mean, var_samp(CAST(k AS DOUBLE) / n) AS v FROM h GROUP BY 1),
s AS (SELECT rule, mean, least(greatest(CASE WHEN v > 0 THEN mean * (1 - mean) / v - 1 ELSE {quality_rules.PRIOR_WEIGHT[1]} END, {quality_rules.PRIOR_WEIGHT[0]}), {quality_rules.PRIOR_WEIGHT[1]}) AS weight FROM p),
verdict AS (SELECT host, max((k + mean * weight) / (n + weight)) <= {quality_rules.HOST_LIMIT} AS ok FROM h JOIN s USING (rule) GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, short OR repeats AS base_failed, NOT (short OR repeats) AND ok AS kept
FROM q JOIN verdict USING (host)
"""

MIX = rf"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS key, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS hash FROM documents),
s AS (SELECT key, source, sum(size) AS source_size, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS weight FROM d GROUP BY 1, 2),
u AS (SELECT *, {mixing.SHARE[0]} * sum(source_size) OVER () - {mixing.SHARE[1] * mixing.CAP} * coalesce(sum(source_size) OVER before, 0) AS up, {mixing.SHARE[1]} * (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS down
  FROM s WINDOW before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, weight * up > {mixing.CAP} * source_size * down AS full_up FROM u),
t AS (SELECT key, source_size, CASE WHEN full_up THEN CAST({mixing.CAP} * source_size AS DOUBLE) ELSE CAST(weight * (SELECT max_by(up, down) FROM v WHERE NOT full_up) AS DOUBLE) / CAST((SELECT max(down) FROM v WHERE NOT full_up) AS DOUBLE) END AS target,
  CAST(CAST('0x' || substr(md5('{mixing.SEED}' || key), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift FROM v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected,
  row_number() OVER (PARTITION BY d.key ORDER BY size DESC, hash, doc_id) AS place FROM d JOIN t USING (key))
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST((floor(shift + expected * place) - floor(shift + expected * (place - 1))) * size AS BIGINT) AS taken FROM r
"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, array_to_string(words[i:i + 4], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {minhash.THRESHOLD} * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS other FROM w UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN comp ON comp.id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

ORACLE = {"op1_url_filters": url_filters.SQL, "op2_near_duplicates": NEAR, "op4_mix_sources": MIX, "op10_quality_rules": QUALITY}
