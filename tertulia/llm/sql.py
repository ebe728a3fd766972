"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SETS = """
{name}_words AS (
  SELECT {id} AS id, regexp_extract_all(
    translate(text, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM {name}
), {name}_sets AS (
  SELECT id, CASE
    WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))
    END AS s
  FROM {name}_words
)"""


def sets(name: str, key: str) -> str:
    return _SETS.format(name=name, id=key, upper=LETTERS, lower=LETTERS.lower())


CONTAMINATION = f"""
WITH {sets("documents", "doc_id")}, {sets("benchmark", "item_id")},
items AS (SELECT b.id, s, least(len(w), 5) AS words FROM benchmark_sets b JOIN benchmark_words w USING (id)),
runs AS (
  SELECT DISTINCT id, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM documents_words, (SELECT DISTINCT words AS n FROM items WHERE words BETWEEN 1 AND 4))
),
found AS (
  SELECT d.id AS doc_id, b.id AS item_id, len(b.s) AS n, count(*) AS shared
  FROM (SELECT id, s, unnest(s) AS x FROM items WHERE words = 5) b
  JOIN (SELECT id, unnest(s) AS x FROM documents_sets) d USING (x)
  GROUP BY ALL
  UNION ALL
  SELECT r.id, b.id, 1, 1 FROM items b JOIN runs r ON r.x = b.s[1] WHERE words BETWEEN 1 AND 4
)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS item_shingles, CAST(shared AS BIGINT) AS shared,
       CAST(shared AS DOUBLE) / n AS containment
FROM found WHERE 100 * shared >= 80 * n
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE {sets("documents", "doc_id")},
flat AS (SELECT id, len(s) AS n, unnest(s) AS x FROM documents_sets),
links AS (
  SELECT a.id AS a, b.id AS b
  FROM flat a JOIN flat b ON a.x = b.x AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reached(id, other) AS (
  SELECT id, id FROM documents_sets
  UNION
  SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a
),
smallest AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT d.id AS doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, component_id,
       d.id = component_id AS kept
FROM documents_sets d JOIN smallest USING (id)
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, m, w[i:i + m - 1] AS p
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM words, (SELECT unnest(range(1, 6)) AS m))
), counts AS (
  SELECT lang, m, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT c.lang, c.m, c.p, c.a, k, l.a AS l, r.a AS r, n,
         CAST(1000 * CAST(c.a AS HUGEINT) * n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM counts WHERE m > 1) c
  JOIN counts l ON l.lang = c.lang AND l.p = c.p[1:k]
  JOIN counts r ON r.lang = c.lang AND r.p = c.p[k + 1:]
  JOIN totals t ON t.lang = c.lang
), scored AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_parts AS (
  SELECT DISTINCT lang, q, a
  FROM (SELECT lang, p, m, a, s, unnest(range(1, m - s + 2)) AS i
        FROM counts, (SELECT unnest(range(2, 5)) AS s) WHERE m > s) x,
       LATERAL (SELECT p[i:i + s - 1] AS q)
), ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC,
                            encode(array_to_string(p, ' '))) AS rank
  FROM scored s
  WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = s.lang AND i.q = s.p AND i.a >= s.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""".format(upper=LETTERS, lower=LETTERS.lower())

_CRC32 = """xor(4294967295, list_reduce([4294967295] || flatten(list_transform(
    range(1, length({0}) + 1), lambda i: list_transform(range(0, 8), lambda j:
      CAST((ascii({0}[i]) >> j) & 1 AS BIGINT)))),
    lambda c, bit: xor(c >> 1, 3988292384 * (xor(c, bit) & 1))))"""

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(struct_pack(role := role, text := text)
                       ORDER BY turn NULLS FIRST, md5(md5(role) || md5(text))) AS t
  FROM turns GROUP BY conv_id
), heads AS (
  SELECT *, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.t, [])[1:o.h], o.t[o.h + 1:]) AS t
  FROM heads o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20
), nodes AS (
  SELECT t[1:d] AS p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
                         FILTER (len(t) = d), '')) AS ends_sha256
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
  GROUP BY ALL
), children AS (
  SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), own_figures AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children,
         CASE WHEN d = 0 THEN 0
              ELSE (n_convs - 1) * len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes n LEFT JOIN children c USING (p, d)
), subtrees AS (
  SELECT p[1:k] AS p, k AS d, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM own_figures)
  GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, a.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM own_figures f JOIN subtrees s USING (p, d)
LEFT JOIN nodes a ON a.p = f.p[1:f.d - 1] AND a.d = f.d - 1
"""
