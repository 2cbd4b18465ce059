"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, {_LOWER.format(f"trim(line, {_BLANK})")} AS key FROM line),
held AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND k.doc_id <> h.keeper AS gone FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM k)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_WORD = r"'[^\x20\x09-\x0D]+'"

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, {_WORD}) AS words FROM d),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(8) AS r(k) GROUP BY doc_id),
li AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM d),
counts AS (
  SELECT w.doc_id, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN li ON w.doc_id = li.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id),
base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM base GROUP BY source),
sums AS (SELECT sum(n) AS n, sum(f) / sum(n) AS m, count(*) AS k, sum(f * f / n) AS s2 FROM hosts),
var AS (SELECT m, s2 / n - m * m - m * (1 - m) * k / n AS v FROM sums),
prior AS (SELECT m, CASE WHEN v > 0 THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS ab FROM var),
rates AS (SELECT source, (f + m * ab) / (n + ab) AS rate, least(0.5, greatest(3 * m, m + 2 * sqrt(m * (1 - m) / (ab + 1)))) AS top FROM hosts, prior)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= top AS kept
FROM base b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source
"""

NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORD}) AS words FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 2, 2)), lambda i: array_to_string(words[i:i + 3], ' '))) AS grams FROM w WHERE len(words) > 0),
sizes AS (SELECT doc_id, len(grams)::BIGINT AS n, list_aggregate(list_sort(grams), 'string_agg', chr(10)) AS whole FROM s),
kinds AS (SELECT min(doc_id) AS kind, any_value(n) AS n, whole FROM sizes GROUP BY whole),
g AS (SELECT doc_id AS kind, unnest(grams) AS gram FROM s SEMI JOIN kinds ON doc_id = kind),
common AS (SELECT a.kind AS a, b.kind AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.kind < b.kind GROUP BY a.kind, b.kind),
link AS (SELECT a, b FROM common JOIN kinds x ON a = x.kind JOIN kinds y ON b = y.kind WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(kind, root) AS (SELECT kind, kind FROM kinds UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.kind WHERE r.root < l.b),
named AS (SELECT kind, min(root) AS root FROM reach GROUP BY kind)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes z ON d.doc_id = z.doc_id LEFT JOIN kinds k ON z.whole = k.whole LEFT JOIN named m ON k.kind = m.kind
"""
