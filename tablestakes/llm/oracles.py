"""SQL twins of the corpus queries that SQL can express."""

from __future__ import annotations

from . import decontamination, line_dedup, quality_rules, reply_trees, url_filter

_WORDS = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(len(w), {decontamination.WINDOW}) AS n FROM item WHERE len(w) > 0),
pattern AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM sized)),
place AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, p, place.n FROM place JOIN pattern ON place.n = pattern.n AND place.s = pattern.s),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP4 = f"""
WITH line AS (
  SELECT doc_id, i, l, ('0x' || substr(md5(l), 1, 7))::BIGINT AS v
  FROM (SELECT doc_id, unnest(s) AS l, unnest(range(1, len(s) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
ended AS (
  SELECT *, (v + {line_dedup.BASE} * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {line_dedup.DIVISOR} = 0 AS e FROM line),
numbered AS (
  SELECT *, coalesce(sum(CASE WHEN e THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM ended),
chunk AS (SELECT doc_id, c, count(*) AS n, string_agg(l, chr(10) ORDER BY i) AS t FROM numbered GROUP BY 1, 2),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, c) AS r FROM chunk
  WHERE n >= {line_dedup.MIN_LINES} AND length(t) >= {line_dedup.MIN_CHARS}),
marked AS (SELECT chunk.*, coalesce(r, 1) > 1 AS gone FROM chunk LEFT JOIN ranked USING (doc_id, c))
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN n ELSE 0 END) AS BIGINT) AS n_removed_lines,
  CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed_chunks,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY c) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP6 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_WORDS}') AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1),
overlap AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM overlap JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * k >= 80 * (s.n + t.n - k)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT DISTINCT x AS a, x AS b FROM both_ways UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON reach.b = both_ways.x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) ON a = doc_id
"""

OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT b, max(page_id) AS largest FROM p WHERE octet_length(b) >= 1000 GROUP BY 1)
SELECT page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, sha1(p.b) AS payload_digest,
  CASE WHEN largest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest > page_id THEN largest END AS refers_to
FROM p LEFT JOIN f ON p.b = f.b
"""

_RULES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in url_filter.RULES)
OP8 = rf"""
WITH rule(h, p, action) AS (VALUES {_RULES}),
part AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fit AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(action, length(h || p)) AS action
  FROM part JOIN rule ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM part LEFT JOIN fit USING (page_id)
"""

OP9 = rf"""
WITH doc AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
three AS (
  SELECT doc_id, p, w[p : p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM doc WHERE len(w) >= 3)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM three) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY 1),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '{_WORDS}') GROUP BY 1),
base AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM doc LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
host AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged WHERE source IS NOT NULL GROUP BY 1),
moments AS (
  SELECT sum(f)::DOUBLE / sum(n) AS m, sum(f::DOUBLE * f / n) AS squares, sum(n)::DOUBLE AS n, count(*) - 1.0::DOUBLE AS chance,
    sum(n)::DOUBLE - sum(n::DOUBLE * n) / sum(n) - (count(*) - 1) AS room FROM host),
alike AS (
  SELECT m, CASE WHEN m * (1 - m) > 0 AND room > 1e-9 THEN ((squares - n * m * m) / (m * (1 - m)) - chance) / room ELSE 0 END AS r FROM moments),
prior AS (
  SELECT m, CASE WHEN r > 1e-12 THEN least(greatest(1 / r - 1, 1e-3), {quality_rules.FLAT_PRIOR_WEIGHT})
    ELSE {quality_rules.FLAT_PRIOR_WEIGHT} END AS k FROM alike),
verdict AS (SELECT source, (f + m * k) / (n + k) > {quality_rules.MAX_HOST_RATE} AS failed FROM host, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(failed, FALSE) AS kept
FROM judged LEFT JOIN verdict USING (source)
"""

OP12 = rf"""
WITH told AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
plain AS (SELECT conv_id, turn, role AS r0, text AS t0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM told)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{reply_trees.LEARNT}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = '{reply_trees.LEARNT}'), '')) AS loss_sha256,
  CAST(sum(length(url_encode(role)) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + {len(reply_trees.START + reply_trees.END) + 2}) AS BIGINT) AS formatted_chars
FROM plain GROUP BY conv_id
"""

ORACLES = {
    "op2_decontamination": OP2,
    "op4_line_dedup": OP4,
    "op6_ngram_jaccard": OP6,
    "op7_warc": OP7,
    "op8_url_filter": OP8,
    "op9_quality_rules": OP9,
    "op12_reply_trees": OP12,
}
