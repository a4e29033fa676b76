WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS p
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT CAST(row_number() OVER (ORDER BY mark) - 1 AS INTEGER) AS c, p AS q
  FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS mark, p FROM kept ORDER BY mark LIMIT 16)
), a0 AS (
  SELECT vec_id, any_value(p) AS p, min([CAST(list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) * (p[i] - q[i]))) AS BIGINT), c]) AS m
  FROM kept CROSS JOIN c0 GROUP BY vec_id
), s1 AS (
  SELECT c, list(f ORDER BY i) AS q FROM (
    SELECT m[2] AS c, i, CAST((sum(p[i]) - ((sum(p[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
    FROM a0, unnest(range(1, 65)) AS u(i) GROUP BY m[2], i) GROUP BY c
), c1 AS (SELECT c0.c, coalesce(s1.q, c0.q) AS q FROM c0 LEFT JOIN s1 ON c0.c = s1.c
), a1 AS (
  SELECT vec_id, any_value(p) AS p, min([CAST(list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) * (p[i] - q[i]))) AS BIGINT), c]) AS m
  FROM kept CROSS JOIN c1 GROUP BY vec_id
), s2 AS (
  SELECT c, list(f ORDER BY i) AS q FROM (
    SELECT m[2] AS c, i, CAST((sum(p[i]) - ((sum(p[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
    FROM a1, unnest(range(1, 65)) AS u(i) GROUP BY m[2], i) GROUP BY c
), c2 AS (SELECT c1.c, coalesce(s2.q, c1.q) AS q FROM c1 LEFT JOIN s2 ON c1.c = s2.c
), a2 AS (
  SELECT vec_id, any_value(p) AS p, min([CAST(list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) * (p[i] - q[i]))) AS BIGINT), c]) AS m
  FROM kept CROSS JOIN c2 GROUP BY vec_id
), s3 AS (
  SELECT c, list(f ORDER BY i) AS q FROM (
    SELECT m[2] AS c, i, CAST((sum(p[i]) - ((sum(p[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f
    FROM a2, unnest(range(1, 65)) AS u(i) GROUP BY m[2], i) GROUP BY c
), c3 AS (SELECT c2.c, coalesce(s3.q, c2.q) AS q FROM c2 LEFT JOIN s3 ON c2.c = s3.c
), a3 AS (
  SELECT vec_id, min([CAST(list_sum(list_transform(range(1, 65), lambda i: (p[i] - q[i]) * (p[i] - q[i]))) AS BIGINT), c]) AS m
  FROM kept CROSS JOIN c3 GROUP BY vec_id
)
SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance,
  CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(m[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c3.c = m[2]
