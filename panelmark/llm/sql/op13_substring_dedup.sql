WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(0, greatest(len(words) - 19, 0))) AS s, words FROM split
), windows AS (
  SELECT doc_id, s, array_to_string(words[s + 1:s + 20], ' ') AS content FROM starts
), copied AS (
  SELECT doc_id, s FROM (
    SELECT doc_id, s, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS turn FROM windows
  ) WHERE turn > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(s + 1, s + 21)))) AS places FROM copied GROUP BY doc_id
), kept AS (
  SELECT doc_id, words, list_filter(words, lambda w, i: places IS NULL OR NOT list_contains(places, i)) AS stays
  FROM split LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(stays) AS BIGINT) AS n_removed,
  sha256(array_to_string(stays, ' ')) AS kept_sha256
FROM kept
