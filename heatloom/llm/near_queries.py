"""Near duplicates."""

from heatloom.llm.minhash import near_duplicates
from heatloom.llm.registry import query, table

# All pairs of sets that share a shingle, then the transitive closure.
NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
g AS (SELECT min(doc_id) AS rep, list_sort(sh) AS sh FROM s WHERE len(sh) > 0 GROUP BY list_sort(sh)),
e AS (SELECT rep, len(sh) AS n, unnest(sh) AS x FROM g),
p AS (SELECT a.rep AS u, b.rep AS v, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM e a JOIN e b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT u, v FROM p WHERE 100 * c >= 75 * (na + nb - c)),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(node, root) AS (SELECT rep, rep FROM g UNION SELECT b.v, r.root FROM r JOIN b ON r.node = b.u WHERE r.root < b.v),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(c.root, s.doc_id) AS component_id,
  s.doc_id = coalesce(c.root, s.doc_id) AS kept
FROM s LEFT JOIN g ON list_sort(s.sh) = g.sh LEFT JOIN c ON c.node = g.rep
"""


@query("op3_near_duplicates", NEAR_SQL)
def op3(spark, root):
    return near_duplicates(table(spark, root, "documents"))
