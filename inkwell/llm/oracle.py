"""DuckDB SQL for those queries that SQL can express. The others are tested against plain versions."""

from __future__ import annotations

from . import rules

NL = "chr(10)"
WORD = r"'[^\x20\x09-\x0D]+'"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 5"""

MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORD})) AS BIGINT) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 9) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS budget FROM s),
b AS (SELECT *, sum(weight) OVER () AS weights, coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS w_before FROM w
  WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, CAST(cap AS DOUBLE) < weight * CAST(budget - cap_before AS DOUBLE) / (weights - w_before) AS capped FROM b),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE weight * (CAST(budget AS DOUBLE) - CAST(coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS DOUBLE)) / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target FROM c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS passes FROM t),
u AS (SELECT d.*, source_size, target, passes, target - passes * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS words
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
e AS (SELECT *, min(CASE WHEN upto >= rest THEN h END) OVER (PARTITION BY source) AS edge FROM u),
x AS (SELECT *, CASE WHEN rest <= 0 THEN 0 WHEN edge IS NULL OR h < edge THEN 1 WHEN h = edge AND upto - rest < rest - (upto - words) THEN 1 ELSE 0 END AS more FROM e)
SELECT doc_id, size, source_size, target, CAST(size * least(passes + more, 3) AS BIGINT) AS taken FROM x"""

LINES = f"""
WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), {NL}) AS ls FROM documents) d, LATERAL (SELECT unnest(range(1, len(d.ls) + 1)) AS i) t),
k AS (SELECT *, translate(trim(line, {SPACES}), {UPPER}, {LOWER}) AS key FROM l),
f AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(f.holder <> k.doc_id, false) AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, {NL} ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(d.w), 2))) AS i) t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s.*, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, s.g) AS k FROM s JOIN n ON n.doc_id = s.doc_id JOIN (SELECT g, count(*) AS f FROM s GROUP BY g) c ON c.g = s.g),
p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.k <= a.n - ceil(0.8 * a.n) + 1 AND b.k <= b.n - ceil(0.8 * b.n) + 1),
i AS (SELECT p.a, p.b, count(*) AS c FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b AND y.g = x.g GROUP BY p.a, p.b),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS doc, a AS other FROM u UNION SELECT reach.doc, u.b FROM reach JOIN u ON u.a = reach.other),
c AS (SELECT doc, min(other) AS component FROM reach GROUP BY doc)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc = d.doc_id"""

_RISK = rules.Risk()
_ALPHA, _DELTA = _RISK.alpha, _RISK.delta / ((len(rules.BANDS) + 1) * len(rules.RATIOS))
_BAND = f"CASE WHEN n_words < {rules.BANDS[0]} THEN 0 WHEN n_words < {rules.BANDS[1]} THEN 1 ELSE 2 END"

RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w, string_split(coalesce(text, ''), {NL}) AS ls FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM d, LATERAL (SELECT unnest(range(1, len(d.w) - 1)) AS i) x),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) z(o) WHERE c >= 2 GROUP BY doc_id),
l AS (SELECT *, list_filter(ls, lambda x: trim(x, {SPACES}) <> '') AS tl FROM d),
m AS (SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(tl) - len(list_distinct(tl)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(tl) AS n_text_lines FROM l LEFT JOIN r ON r.doc_id = l.doc_id),
b AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_BAND} AS band FROM m),
v AS (SELECT doc_id, band, base_failed, rule, val FROM b, LATERAL (VALUES ('s', n_symbols / greatest(word_chars, 1)), ('d', n_dup_lines / greatest(n_text_lines, 1)), ('r', n_repeat_words / greatest(n_words, 1))) x(rule, val)),
a AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
h AS (SELECT band, rule, c, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 0) AS n0, count(*) FILTER (WHERE quality = 1 AND val > c) AS k, count(*) FILTER (WHERE quality = 0 AND val > c) AS k0
  FROM v JOIN a ON a.doc_id = v.doc_id, (VALUES {', '.join(f'(CAST({c} AS DOUBLE))' for c in rules.GRID)}) y(c) WHERE NOT base_failed GROUP BY band, rule, c),
o AS (SELECT *, k < {_ALPHA!r} * n AND
  list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_ALPHA!r}) + (n - j) * ln(1 - {_ALPHA!r})))) <= {_DELTA!r} AS safe FROM h),
f AS (SELECT *, bool_and(safe) OVER (PARTITION BY band, rule ORDER BY c DESC) AS passed, CASE WHEN n0 > 0 THEN k0 / n0 - k / n ELSE -c END AS gain FROM o),
q AS (SELECT band, rule, arg_max(c, (gain, c)) AS cut FROM f WHERE passed GROUP BY band, rule),
z AS (SELECT DISTINCT v.doc_id FROM v JOIN q ON q.band = v.band AND q.rule = v.rule WHERE val > cut)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND b.doc_id NOT IN (SELECT doc_id FROM z) AS kept FROM b"""

ORACLE_SQL = {"op1_exact_topk": TOPK, "op2_mix_sources": MIX, "op6_minhash_dedup": NEAR, "op8_line_dedup": LINES, "op10_quality_rules": RULES}
