"""SQL that queries of this package must agree with, where SQL can express them."""

CONVERSATION_REPAIR = """
WITH RECURSIVE
-- CRC-32 by bytes: eight steps of the polynomial for each of 256 bytes.
bits AS (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
         FROM (SELECT CAST(range AS BIGINT) AS n FROM range(256))),
crcs AS (SELECT list(v ORDER BY n) AS t FROM bits),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
fated AS (SELECT keyed.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate FROM keyed, crcs),
copied AS (SELECT conv_id AS conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                  CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                  unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS kept FROM copied),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS times, substr(role, 1, 1) AS initial,
                lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
faulty AS (SELECT *, CASE WHEN kept = '' THEN 'blank' WHEN times > 1 THEN 'duplicate'
                          WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
rows AS (SELECT *, fault IN ('blank', 'duplicate') AS go, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM faulty),
-- States: 0 nothing yet, 1 system, 2 user, 3 assistant. Up to two inserted rows, then one row.
inserts(p, n, s, lines) AS (VALUES
    (0, 0, 0, []), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
    (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])),
steps(s, letter, initial, q, base) AS (VALUES
    (0, 'D', '', 0, 4), (1, 'D', '', 1, 4), (2, 'D', '', 2, 4), (3, 'D', '', 3, 4),
    (0, 'R', '', 2, 3), (1, 'R', '', 2, 3), (2, 'R', '', 3, 3), (3, 'R', '', 2, 3),
    (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0)),
dp AS (
    SELECT conv, CAST(0 AS BIGINT) AS i, 0 AS state, lpad('0', 9, '0') AS k, CAST([] AS VARCHAR[]) AS lines FROM rows GROUP BY conv
    UNION ALL
    SELECT conv, i, q, min(k), arg_min(lines, k) FROM (
        SELECT d.conv, r.i, t.q,
               lpad(CAST(CAST(substr(d.k, 1, 9) AS INT) + 3 * n.n + t.base + CASE WHEN t.letter = 'D' THEN 0 ELSE r.cut END AS VARCHAR), 9, '0')
                   || substr(d.k, 10) || repeat('I', n.n) || t.letter AS k,
               list_concat(d.lines, n.lines, CASE t.letter WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text]
                                             ELSE [CASE WHEN t.q = 2 THEN 'user:' ELSE 'assistant:' END || r.text] END) AS lines
        FROM dp d JOIN rows r ON r.conv IS NOT DISTINCT FROM d.conv AND r.i = d.i + 1 JOIN inserts n ON n.p = d.state
        JOIN steps t ON t.s = n.s AND (t.letter = 'D' OR NOT r.go) AND (t.letter <> 'K' OR t.initial = r.initial))
    GROUP BY conv, i, q),
endings(state, cost, letters, more) AS (VALUES (0, 0, '', []), (1, 6, 'II', ['user:', 'assistant:']), (2, 3, 'I', ['assistant:']), (3, 0, '', [])),
lasts AS (SELECT conv, max(i) AS i FROM rows GROUP BY conv),
ended AS (SELECT d.conv, lpad(CAST(CAST(substr(d.k, 1, 9) AS INT) + e.cost AS VARCHAR), 9, '0') || substr(d.k, 10) || e.letters AS k, list_concat(d.lines, e.more) AS lines
          FROM dp d JOIN lasts l ON l.conv IS NOT DISTINCT FROM d.conv AND l.i = d.i JOIN endings e ON e.state = d.state),
best AS (SELECT conv, min(k) AS k, arg_min(lines, k) AS lines FROM ended GROUP BY conv),
counts AS (SELECT conv, CASE WHEN count(turn) = 0 THEN 0 ELSE CAST(max(turn) AS HUGEINT) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
                  sum(CAST(fault = 'blank' AS INT)) AS blank, sum(CAST(fault = 'duplicate' AS INT)) AS duplicate, sum(CAST(fault = 'truncated' AS INT)) AS truncated,
                  sum(CAST(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS INT)) AS illegal FROM rows GROUP BY conv)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(CAST(substr(k, 1, 9) AS BIGINT), 0) AS BIGINT) AS cost, coalesce(substr(k, 10), '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv IS NOT DISTINCT FROM o.conv_id"""

SOURCE_MIXING = """
WITH read AS (SELECT doc_id, source, coalesce(md5(text), 'null') AS body,
              CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, body) - 1 AS n,
             CAST('0x' || substr(md5('mix-2:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || body), 1, 15) AS BIGINT) AS own FROM read),
hashed AS (SELECT * EXCLUDE (own), CASE WHEN n = 0 THEN own ELSE CAST('0x' || substr(md5(own || ':' || n), 1, 15) AS BIGINT) END AS hash FROM numbered),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM read GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM sizes),
-- Sources reach their cap in this order as the price of a unit of weight rises.
ranked AS (SELECT *, row_number() OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST) AS place FROM weighed),
steps AS (SELECT place, sum(source_size) OVER () - sum(cap) OVER upto + cap AS rest, sum(weight) OVER () - sum(weight) OVER upto + weight AS free
          FROM ranked WINDOW upto AS (ORDER BY place)),
prices AS (SELECT place, CAST(rest AS DOUBLE) / CAST(free AS DOUBLE) AS price FROM steps),
price AS (SELECT arg_min(p.price, p.place) AS price FROM prices p WHERE NOT EXISTS
          (SELECT 1 FROM ranked r WHERE r.place >= p.place AND r.weight * p.price > r.cap)),
targets AS (SELECT source, source_size, CASE WHEN weight * price > cap THEN CAST(cap AS DOUBLE) ELSE weight * price END AS target FROM ranked, price),
wanted AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-9) AS BIGINT) ELSE 0 END AS whole FROM targets),
budgets AS (SELECT *, target - whole * source_size AS budget FROM wanted),
sums AS (SELECT source, hash, sum(size) AS words FROM hashed GROUP BY source, hash),
running AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY hash) AS reached FROM sums),
crossing AS (SELECT b.source, min(hash) AS hash, arg_min(words, hash) AS words, min(reached) AS reached FROM running r
             JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source WHERE budget > 0 AND reached >= budget GROUP BY b.source),
cuts AS (SELECT b.*, c.hash + CASE WHEN c.reached - budget <= budget - (c.reached - c.words) THEN 1 ELSE 0 END AS cut
         FROM budgets b LEFT JOIN crossing c ON c.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN hash < cut THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM hashed h JOIN cuts c ON h.source IS NOT DISTINCT FROM c.source
"""
