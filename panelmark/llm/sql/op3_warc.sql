WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS html FROM pages
), sized AS (
    SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM payloads
), firsts AS (
    SELECT payload_digest, min(page_id) AS first_id FROM sized WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
       CASE WHEN f.first_id <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> s.page_id THEN f.first_id END AS refers_to
FROM sized s LEFT JOIN firsts f USING (payload_digest)
