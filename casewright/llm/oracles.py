"""DuckDB SQL for the queries that SQL can express.

Not expressible, and tested otherwise: op3 (token ids), op5 (image coding), op6 (compressed sizes), op7 (token ids),
op8 (language model sampled by hashes), op10 (mined rules) and op12 (token ids).
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, hex,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS BIGINT), 5))::BIGINT >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

OP2 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS words FROM documents),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
grams AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER s || ' ' || lead(word, 2) OVER s AS g FROM each WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR 100 * n_symbols > 50 * n_words) AS bad FROM f GROUP BY source),
moments AS (SELECT sum(bad) / sum(n) AS rate, greatest(0, sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) ** 2 - (sum(bad) / sum(n)) * (1 - sum(bad) / sum(n)) * count(*) / sum(n)) AS spread FROM hosts),
prior AS (SELECT rate, least(1000.0, greatest(2.0, CASE WHEN spread = 0 THEN 1000.0 ELSE rate * (1 - rate) / spread - 1 END)) AS strength FROM moments),
verdict AS (SELECT source, source IS NOT NULL AND (bad + rate * strength) / (n + strength) * (1 - rate) > 3.0 * rate * (1 - (bad + rate * strength) / (n + strength)) AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""

OP4 = r"""
WITH l AS (SELECT doc_id, length(text) AS total, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, total, line, k, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1)::BIGINT AS start FROM l),
s AS (SELECT doc_id, start, line, regexp_extract_all(line, '.*?[.!?]+[ \t\x0b\x0c\r]+|.+$') AS parts FROM p),
e AS (SELECT doc_id, start AS line_start, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM s WHERE len(parts) > 1),
o AS (SELECT doc_id, part, (line_start + sum(length(part)) OVER (PARTITION BY doc_id, line_start ORDER BY j) - length(part))::BIGINT AS start FROM e),
u AS (SELECT doc_id, start, length(line) + CASE WHEN start + length(line) < total THEN 1 ELSE 0 END AS length, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w, 4 AS least FROM p
  UNION ALL SELECT doc_id, start, length(part), regexp_extract_all(lower(part), '[^\x20\x09-\x0D]+'), 8 FROM o),
n AS (SELECT doc_id, start, length, len(w) AS words, array_to_string(w, ' ') AS unit FROM u WHERE len(w) >= least),
r AS (SELECT *, first_value(doc_id) OVER x AS kept_in, first_value(start) OVER x AS kept_at FROM n WINDOW x AS (PARTITION BY unit ORDER BY doc_id, start)),
gone AS (SELECT DISTINCT doc_id, start, length, kept_in, words FROM r WHERE doc_id <> kept_in OR start <> kept_at),
outer_spans AS (SELECT g.* FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone b WHERE b.doc_id = g.doc_id AND b.start <= g.start AND b.start + b.length >= g.start + g.length AND b.length > g.length)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM (SELECT *, CASE WHEN start = lag(start + length) OVER (PARTITION BY doc_id ORDER BY start) THEN 0 ELSE 1 END AS fresh FROM outer_spans)),
long_spans AS (SELECT * FROM (SELECT *, sum(words) OVER (PARTITION BY doc_id, run) AS run_words FROM runs) WHERE run_words >= 16),
spans AS (SELECT doc_id, count(*) AS n, sum(length)::BIGINT AS chars, string_agg(start || ':' || length || ':' || kept_in, ',' ORDER BY start) AS removed, list(start ORDER BY start) AS starts, list(length ORDER BY start) AS lengths FROM long_spans GROUP BY doc_id),
c AS (SELECT d.doc_id, n, chars, removed, CASE WHEN n IS NULL THEN d.text ELSE
  array_to_string(list_transform(range(0, n + 1), lambda i: substr(d.text, CASE WHEN i = 0 THEN 1 ELSE starts[i] + lengths[i] + 1 END, CASE WHEN i = n THEN length(d.text) ELSE starts[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE starts[i] + lengths[i] END)), '') END AS text
  FROM documents d LEFT JOIN spans s USING (doc_id))
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_removed, coalesce(chars, 0)::BIGINT AS chars_removed, coalesce(removed, '') AS removed_spans, length(text)::BIGINT AS chars_left, md5(text) AS text_md5 FROM c
"""

OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS doc_id, a AS low FROM both_ways UNION SELECT both_ways.b, reach.low FROM reach JOIN both_ways ON both_ways.a = reach.doc_id WHERE reach.low < both_ways.b),
least_of AS (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
q AS (SELECT DISTINCT r, item_id, term FROM (SELECT r, item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, * FROM benchmark))),
total AS (SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words))::BIGINT AS l FROM d),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, total GROUP BY term),
m AS (SELECT r, doc_id, 10 + (90 * len(words) * n) // l AS m FROM d, total WHERE len(words) > 0),
s AS (SELECT q.r AS query, item_id, m.doc_id, m.r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m ON m.r = t.r GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT r, lang, source, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(lang_n)::BIGINT AS lang_kept FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(n.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT c.lang, source, term, n, 1 + (1000000000 * (n + 2)) // ((sum(n) OVER (PARTITION BY c.lang, source))::BIGINT + 2 * v) AS p, 1 + (1000000000 * (lang_n + 2)) // (lang_kept + 2 * v) AS q FROM c JOIN v ON v.lang = c.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
both_parts AS (SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_salvage": OP1, "op2_quality_rules": OP2, "op4_line_dedup": OP4, "op9_jaccard_join": OP9, "op11_maxscore_search": OP11, "op13_source_divergence": OP13}
