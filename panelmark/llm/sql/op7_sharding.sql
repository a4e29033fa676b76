WITH RECURSIVE bits(i, c, step) AS (
    SELECT i, CAST(i AS UBIGINT), 0 FROM range(256) r(i)
    UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8
), crc_table AS (
    SELECT list(c ORDER BY i) AS entries FROM bits WHERE step = 8
), plain AS (
    SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), texts AS (
    SELECT DISTINCT text FROM plain
), digits AS (
    SELECT text, hex(encode(text)) AS hexed FROM texts
), bytes AS (
    SELECT text, [CAST(4294967295 AS UBIGINT)] || list_transform(range(1, length(hexed) + 1, 2),
           lambda k: CAST(16 * (instr('0123456789ABCDEF', hexed[k]) - 1) + instr('0123456789ABCDEF', hexed[k + 1]) - 1 AS UBIGINT)) AS list
    FROM digits
), checksums AS (
    SELECT text, CAST(xor(list_reduce(list, lambda a, b: xor(a >> 8, entries[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295) AS BIGINT) AS text_crc32
    FROM bytes, crc_table
), mixed AS (
    SELECT doc_id, source, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size, text_crc32,
           CASE WHEN source IS NULL THEN '-' ELSE '+' || source END AS stratum,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || text_crc32) AS mixed
    FROM plain JOIN checksums USING (text)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY mixed, doc_id) AS rank, count(*) OVER (PARTITION BY stratum) AS of_source FROM mixed
), laid AS (
    SELECT *, row_number() OVER (ORDER BY (rank - 0.5::DOUBLE) / of_source::DOUBLE, stratum, rank) - 1 AS place, count(*) OVER () AS n FROM ranked
), cut AS (
    SELECT *, CAST(place * 24 // n AS INTEGER) AS shard FROM laid
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard,
       CAST(place - (CAST(shard AS BIGINT) * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
