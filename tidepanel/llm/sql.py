"""DuckDB SQL for the queries that SQL can express."""

URL_FILTERS = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM pages),
r AS (
  SELECT *,
    CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule,
    CASE
      WHEN regexp_matches(low, '\?utm_source=feed([^a-z0-9_.%-]|\z)') THEN '*?utm_source=feed^'
      WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?cheap-pills\.') THEN '||cheap-pills.'
      WHEN regexp_matches(low, '/wp-login\.php([^a-z0-9_.%-]|\z)') THEN '*/wp-login.php^'
      WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?casino-win\.') THEN '||casino-win.'
      WHEN regexp_matches(low, '&sessionid=') THEN '*&sessionid=*'
      WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?ads-track\.') THEN '||ads-track.'
      WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?free-bets\.') THEN '||free-bets.'
      WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?spam-farm\.') THEN '||spam-farm.'
      WHEN regexp_matches(low, '/cgi-bin/') THEN '*/cgi-bin/'
      WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?adult-x\.') THEN '||adult-x.'
      WHEN regexp_matches(low, '\.exe([^a-z0-9_.%-]|\z)') THEN '*.exe^'
    END AS hit
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN hit IS NULL OR hit = '*?utm_source=feed^' THEN 'allow' ELSE 'block' END AS verdict,
  CASE WHEN rule IS NULL THEN hit END AS pattern
FROM r
"""

MIX_SOURCES = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('mix' || coalesce(doc_id::VARCHAR, '')) AS h, coalesce('s' || source, 't') AS k
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY k) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, row_number() OVER (ORDER BY k) AS r FROM s),
f AS (
  SELECT *, coalesce(sum(3 * source_size) OVER o, 0)::BIGINT AS caps, coalesce(sum(weight) OVER o, 0)::BIGINT AS used,
    (SELECT sum(source_size) FROM w)::BIGINT AS total, (SELECT sum(weight) FROM w)::BIGINT AS all_w
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight::DOUBLE, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, (3 * source_size)::DOUBLE * (all_w - used) <= (total - caps) * weight::DOUBLE AS cut FROM f),
l AS (SELECT coalesce(sum(3 * source_size) FILTER (cut), 0)::BIGINT AS capped, coalesce(sum(weight) FILTER (NOT cut), 0)::BIGINT AS open FROM g),
t AS (SELECT k, source_size, CASE WHEN cut THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * (total - capped) / open END AS target FROM g, l),
x AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d JOIN t USING (k)),
y AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM x)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - place)))::BIGINT AS taken FROM y
"""

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS row FROM documents),
g AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS c FROM g),
v AS (SELECT row, count(DISTINCT p) AS n FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY row),
l AS (SELECT row, x FROM (SELECT row, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
m AS (SELECT row, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM l),
o AS (
  SELECT row, count(*) - count(DISTINCT x) AS dup, sum(n) FILTER (
    (NOT regexp_matches(x, '[.!?:;…。！？][\x22\x27“”’»)\]]*[\x20\x09-\x0D]*\z') AND (n < 8 OR NOT regexp_matches(x, '[.,;:!?]')))
    OR len(regexp_extract_all(x, '[\x20\x09](?:\||>|»|•)[\x20\x09]')) * 3 >= n
    OR len(regexp_extract_all(x, '(?:[#*$%&|<>]{2,}|!!+)(?:[\x20\x09-\x0D]|\z)')) * 100 > n * 30
    OR regexp_matches(x, '(?i)^[\x20\x09]*(?:all rights reserved|licensed under|released under the|this work is licensed|copyright (?:\(c\)|©|[0-9])|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|sign in|log in|click here|subscribe to|share this|skip to (?:main )?content|lorem ipsum)')
  ) AS lost FROM m GROUP BY row),
b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN v USING (row) LEFT JOIN o USING (row))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_words * 100 <= n_words * 50 AS kept
FROM b
"""

RESAMPLING = r"""
WITH RECURSIVE c(i, k, c) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM c WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM c WHERE k = 8),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'b', 0, NULL, coalesce(text, '') FROM benchmark),
f AS (
  SELECT side, row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
g AS (SELECT side, row, w, count(*)::BIGINT AS n FROM f GROUP BY ALL),
h AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::UBIGINT)),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM g), tab),
s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM g JOIN h USING (w) GROUP BY bucket),
v AS (SELECT coalesce(sum(s), 0) + 10000 AS big_s, coalesce(sum(t), 0) + 10000 AS big_t FROM s),
k AS (SELECT bucket, floor(1000 * ln((t + 1) * big_s / ((s + 1) * big_t)))::BIGINT AS gain FROM s, v),
d AS (SELECT row, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM g JOIN h USING (w) JOIN k USING (bucket) WHERE side = 'd' GROUP BY row),
e AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM texts LEFT JOIN d USING (row) WHERE side = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * (count(*) OVER (PARTITION BY n_features >= 20)) // 100 AS draws FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= draws THEN place END AS rank FROM r
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

HARD_NEGATIVES = """
WITH r AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = r.label AS own, r.vec_id, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM r AS a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.own AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""

ORACLES = {
    "op1_url_filters": URL_FILTERS, "op2_mix_sources": MIX_SOURCES, "op9_quality_rules": QUALITY_RULES, "op11_resampling": RESAMPLING,
    "op12_exact_dedup": EXACT_DEDUP, "op13_hard_negatives": HARD_NEGATIVES,
}
