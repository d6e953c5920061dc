"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from spanforge.llm import centroids, quality_rules

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 1], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
s AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id) AS n FROM k),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a),
m AS (SELECT node, min(c) AS component_id FROM r GROUP BY 1), z AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""

_BITS = "array_to_string(list_transform(string_split(h, ''), lambda c: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', c)]), '')"
_BIT = "CAST(substr(bits, 5 * i + {0} + 1, 1) AS INTEGER)"
_FIVE = " + ".join(f"{16 >> j} * {_BIT.format(j)}" for j in range(5))
ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS lead, {_BITS} AS bits FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead THEN lead END AS refers_to FROM f
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op5_minmax_dedup": NEAR_DUPLICATES,
    "op6_warc": ARCHIVES,
    "op7_decontamination": DECONTAMINATION,
    "op11_centroids": centroids.ORACLE,
}
