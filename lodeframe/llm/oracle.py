"""DuckDB SQL for the op queries that SQL can express."""

SQL: dict[str, str] = {
    "op9_url_verdicts": r"""
WITH cut AS (
  SELECT page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
), parts AS (
  SELECT page_id, url,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), keyed AS (
  SELECT *, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '') AS canon FROM parts
), listed AS (
  SELECT canon FROM keyed WHERE canon <> '' GROUP BY canon HAVING count(DISTINCT url) >= 2
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
)
SELECT k.page_id, k.host, k.path, r.rhost || r.rpath AS rule,
       coalesce(r.action,
                CASE WHEN k.host <> '' AND k.canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN LATERAL (
  SELECT action, rhost, rpath FROM rules
  WHERE (k.host = rhost OR ends_with(k.host, '.' || rhost)) AND starts_with(k.path, rpath)
  ORDER BY length(rhost || rpath) DESC LIMIT 1
) r ON true
""",
    "op10_warc_round_trip": r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT d.page_id, payload_bytes, d.payload_digest,
       CASE WHEN d.page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id <> first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
""",
    "op12_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS draw FROM d
), c AS (
  SELECT *, len(lines) AS n, least(draw[1] % (len(lines) + 1), draw[2] % (len(lines) + 1)) AS a,
         greatest(draw[1] % (len(lines) + 1), draw[2] % (len(lines) + 1)) AS b FROM u
), f AS (
  SELECT doc_id, text, n, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
         array_to_string(lines[b + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draw[3] % 100 >= 100 THEN 'plain'
              WHEN draw[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
""",
}
