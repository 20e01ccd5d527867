"""DuckDB SQL of the corpus queries that SQL can express: plain enumeration of all windows, no fingerprints or anchors.

Not here, and tested against brute force, a round trip or held-out labels instead: images (3), trained models (4, 9 and the pipeline), XXH64 fingerprints
(6), parser events (8), checksums in curve order (10).
"""

from __future__ import annotations

from ledgersift.llm.mixing import CAP, SEED, SHARE, WEIGHTS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_LOWERED} AS w FROM documents),
b AS (SELECT item_id, {_LOWERED} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dg AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns)),
h AS (SELECT doc_id, n, i, item_id FROM dg JOIN iw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op2_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
s AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f, unhex(sha1(h))::BIT::VARCHAR AS bits FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id > f THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > f THEN f END AS refers_to, url
FROM s""",
    "op5_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT t FROM g GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN again USING (t)) GROUP BY 1),
o AS (SELECT doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce((SELECT string_agg(k.x, ' ' ORDER BY k.i) FROM (SELECT unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i) k WHERE NOT list_contains(ps, k.i)), '')) AS kept_sha256
FROM o""",
    "op7_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source IS NULL, encode(coalesce(source, ''))) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS weight FROM d GROUP BY 1),
c AS (SELECT *, CAST(source_size * {CAP} AS DOUBLE) AS cap, CAST((SELECT sum(size) FROM d) * {SHARE} AS DOUBLE) AS total, row_number() OVER (ORDER BY source_size * {CAP} / weight, source) AS k FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
v AS (SELECT level FROM l WHERE weight * level <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(weight * (SELECT level FROM v), cap) AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, d.source, coalesce(t.target / nullif(CAST(t.source_size AS DOUBLE), 0), 0.0) AS rate, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || h), 1, 8) AS UBIGINT) / 4294967296.0 AS u
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, source, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""",
}
