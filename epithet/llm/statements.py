"""DuckDB statements of the queries that SQL can express."""

_PAGES = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM parts),
spam(name) AS (VALUES ('adult-'), ('ads-track.'), ('casino-'), ('cheap-pills.'), ('free-bets.'), ('spam-farm.')),
named AS (
  SELECT *, CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    (SELECT '||' || max_by(name, (length(name), name)) FROM spam
     WHERE starts_with(host, name) OR contains(host, '.' || name)) AS pattern
  FROM split)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM named
"""

_QUALITY_RULES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM docs),
grams AS (
  SELECT id, i, (w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM listed)),
starts AS (SELECT id, i FROM grams QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
covered AS (SELECT id, count(DISTINCT i + k) AS n FROM starts, range(3) AS r(k) GROUP BY id),
lines AS (
  SELECT id, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
         len(regexp_extract_all(l, '[#*$%&|<>]')) AS symbols,
         len(regexp_extract_all(l, '\p{Lu}')) AS upper, len(regexp_extract_all(l, '\p{L}')) AS letters,
         len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]'), lambda x: x IN ('|', '»', '›', '>', '·', '•', '/'))) AS seps
  FROM (SELECT id, unnest(ls) AS l FROM listed)),
lost AS (
  SELECT id, sum(n) AS n FROM lines
  WHERE NOT (regexp_matches(l, '[.!?…。？！]["''»”’)\]]*([\x20\x09-\x0D]|$)') AND 2 * symbols <= n
             AND 2 * upper <= letters AND (seps < 3 OR 5 * seps <= n)
             AND NOT regexp_matches(l, '(?i)\b(lorem ipsum|enable javascript|javascript is (disabled|required)|accept (all )?cookies|uses cookies|cookie (policy|settings)|skip to (main )?content|sign up for our newsletter)\b'))
  GROUP BY id),
measured AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
         CAST(coalesce(l.n, 0) AS BIGINT) AS lost_words
  FROM listed LEFT JOIN covered c USING (id) LEFT JOIN lost l USING (id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_words <= n_words AS kept
FROM measured
"""

_TOKEN_COUNTS = r"""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents
"""

_WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
h AS (SELECT payload_digest, max(page_id) AS holder FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM d LEFT JOIN h USING (payload_digest)
"""

_LEXICAL_SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
whole AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, whole GROUP BY term),
scored AS (
  SELECT item_id, r, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM tf JOIN w USING (term) JOIN q USING (term), whole GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

_CONVERSATION_REPAIR = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations),
summed AS (
  SELECT *, xor(list_reduce(
      list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k:
        CASE WHEN (x & 1) = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)),
    CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM source),
damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM summed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i
  FROM damaged),
rows AS (
  SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
steps AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, '' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS out
  FROM source
  UNION ALL
  SELECT c, i, state, cost, audit, out FROM (
    SELECT s.c, r.i,
           CASE edit WHEN 'D' THEN state WHEN 'K' THEN initial ELSE grown END AS state,
           cost + CASE edit WHEN 'D' THEN 2 ELSE CASE edit WHEN 'R' THEN 1 ELSE 0 END
                  + CASE fault WHEN 'truncated' THEN 5 ELSE 0 END END AS cost,
           audit || edit AS audit,
           CASE edit WHEN 'D' THEN out WHEN 'K' THEN list_append(out, role || ':' || text)
                ELSE list_append(out, CASE grown WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text) END AS out
    FROM (
      SELECT c, i, cost + 5 * n AS cost, audit || repeat('I', n) AS audit,
             CASE WHEN n = 0 THEN state WHEN state = 'u' THEN 'a' ELSE 'u' END AS state,
             CASE WHEN n = 0 THEN out WHEN state = 'u' THEN list_append(out, 'assistant:')
                  ELSE list_append(out, 'user:') END AS out
      FROM steps, (VALUES (0), (1)) AS inserted(n)) AS s
    JOIN rows AS r ON r.c = s.c AND r.i = s.i + 1
    CROSS JOIN (VALUES ('D'), ('K'), ('R')) AS edits(edit)
    CROSS JOIN LATERAL (SELECT CASE state WHEN 'u' THEN 'a' ELSE 'u' END AS grown)
    WHERE edit = 'D' OR fault NOT IN ('blank', 'duplicate')
          AND (edit = 'R' OR initial = grown OR (initial = 's' AND state = '')))
  QUALIFY row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) = 1),
ended AS (
  SELECT c, i, cost + CASE state WHEN 'u' THEN 5 WHEN 's' THEN 10 ELSE 0 END AS cost,
         audit || CASE state WHEN 'u' THEN 'I' WHEN 's' THEN 'II' ELSE '' END AS audit,
         list_concat(out, CASE state WHEN 'u' THEN ['assistant:'] WHEN 's' THEN ['user:', 'assistant:'] ELSE [] END) AS out
  FROM steps
  QUALIFY i = max(i) OVER (PARTITION BY c)),
best AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1),
counted AS (
  SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
       sha256(array_to_string(out, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM source) JOIN best USING (c) LEFT JOIN counted USING (c)
"""

STATEMENTS = {
    "op2_url_filters": _PAGES,
    "op6_quality_rules": _QUALITY_RULES,
    "op8_token_counts": _TOKEN_COUNTS,
    "op11_warc": _WARC,
    "op12_lexical_search": _LEXICAL_SEARCH,
    "op13_conversation_repair": _CONVERSATION_REPAIR,
}
