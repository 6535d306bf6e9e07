"""SQL for the queries that SQL can express over whole tables.

The others need automata, merges of a vocabulary, parsers, Hamming components or byte strings; the tests
compare them with plain versions.
"""

ORACLES: dict[str, str] = {
    "op7_quality_rules": r"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
words AS (
  SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS place
  FROM (SELECT id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs)
),
windows AS (
  SELECT id, place, lead(word, 4) OVER o AS fifth,
    count(*) OVER (PARTITION BY id, word, lead1, lead2, lead3, lead4) AS times
  FROM (SELECT *, lead(word, 1) OVER o AS lead1, lead(word, 2) OVER o AS lead2, lead(word, 3) OVER o AS lead3,
          lead(word, 4) OVER o AS lead4 FROM words WINDOW o AS (PARTITION BY id ORDER BY place))
  WINDOW o AS (PARTITION BY id ORDER BY place)
),
covered AS (
  SELECT id, bool_or(fifth IS NOT NULL AND times > 1) OVER (PARTITION BY id ORDER BY place ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c
  FROM windows
),
repeated AS (SELECT id, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY id),
lines AS (
  SELECT id, line, place, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
    length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS letters,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols
  FROM (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS place FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
judged AS (
  SELECT id, letters, row_number() OVER (PARTITION BY id, line ORDER BY place) > 1 AS again,
    length(line) - length(replace(line, '|', '')) + len(list_filter(w, lambda x: x IN ('›', '»', '·', '•', '>', '/'))) AS bars,
    NOT regexp_matches(line, '\pL') OR symbols * 100 > letters * 20 AS punctuation,
    bars >= 2 AND len(w) <= 4 * (bars + 1) OR len(w) < 4
      AND NOT regexp_matches(line, '[.!?…:;。！？]["''”’»)\]]*\s*$') AS navigation,
    regexp_matches(lower(line), 'all rights reserved|cookie policy|privacy policy|terms of use|terms of service|accept cookies|subscribe to our newsletter|sign up for our newsletter|click here to|javascript is disabled|enable javascript|powered by|share this|lorem ipsum|licensed under|permission is hereby granted') AS boilerplate
  FROM lines
),
removed AS (
  SELECT id, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (again OR punctuation OR navigation OR boilerplate) AS n_removed_lines,
    CAST(coalesce(sum(letters) FILTER (again OR punctuation OR navigation OR boilerplate), 0) AS BIGINT) AS lost_chars
  FROM judged GROUP BY id
),
counted AS (
  SELECT doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_removed_lines, 0) AS n_removed_lines, coalesce(lost_chars, 0) AS lost_chars,
    n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed
  FROM docs LEFT JOIN repeated USING (id) LEFT JOIN removed USING (id)
)
SELECT *, NOT base_failed AND 100 * lost_chars <= 50 * word_chars AS kept FROM counted""",
    # every window of an item's size that shares a shingle with it, without any fingerprint
    "op10_decontamination": r"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS w FROM documents
),
items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\pL\pN]+') AS w FROM benchmark),
item_grams AS (
  SELECT item_id, size, gram, count(*) AS weight
  FROM (SELECT item_id, len(w) AS size, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM items)
  GROUP BY ALL
),
grams AS (
  SELECT id, doc_id, len(w) AS total, generate_subscripts(g, 1) AS place, unnest(g) AS gram
  FROM (SELECT *, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM texts)
),
starts AS (
  SELECT DISTINCT id, doc_id, item_id, size, least(size, total) AS own,
    unnest(range(greatest(1, place - least(size, total) + 5), least(place, total - least(size, total) + 1) + 1)) AS start
  FROM grams JOIN item_grams USING (gram)
),
shared AS (
  SELECT s.id, s.doc_id, s.item_id, s.size, s.own, s.start, g.gram, count(*) AS times
  FROM starts AS s JOIN grams AS g ON g.id = s.id AND g.place BETWEEN s.start AND s.start + s.own - 5
  GROUP BY ALL
),
alike AS (
  SELECT id, doc_id, item_id, own, start, CAST(sum(least(times, weight)) AS DOUBLE) / (own - 4 + size - 4 - sum(least(times, weight))) AS similarity
  FROM shared JOIN item_grams USING (item_id, size, gram) GROUP BY id, doc_id, item_id, size, own, start
)
(SELECT doc_id, item_id, similarity, start - 1 AS start_word, own AS n_words FROM alike WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY id, item_id ORDER BY similarity DESC, start) = 1)
UNION ALL
SELECT doc_id, item_id, CAST(1 AS DOUBLE), 0, len(items.w) FROM texts JOIN items USING (w) WHERE len(items.w) BETWEEN 1 AND 4""",
    "op6_warc_round_trip": """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
),
stored AS (SELECT payload_digest, max(page_id) AS last FROM payloads WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM payloads LEFT JOIN stored USING (payload_digest)""",
    # paths as lists of turns; the CRC-32 of an id's digits bit by bit
    "op13_prefix_trie": """
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
sums AS (
  SELECT *, xor(list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda sum, x: CASE WHEN x >= 0 THEN xor(sum, x) ELSE xor(sum >> 1, (sum & 1) * 3988292384) END), 4294967295) % 9 AS h
  FROM turns
),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(p.own[1:c.h], []), c.own[c.h + 1:]) AS path
  FROM sums AS c LEFT JOIN turns AS p ON p.conv_id = c.conv_id - c.conv_id % 5
),
prefixes AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN len(path) = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL
),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes AS n LEFT JOIN nodes AS p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]
),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT * FROM linked LEFT JOIN children USING (node)),
above AS (
  SELECT node[1:step] AS node, n_children IS NULL AS leaf,
    CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].text) ELSE 0 END AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS step FROM counted)
),
subtrees AS (SELECT node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY node)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN subtrees USING (node)""",
}
