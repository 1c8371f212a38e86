"""Duplicate passages."""

from heatloom.llm.recompress import digests
from heatloom.llm.registry import query, table

# All windows of 50 words with the smallest document that has them.
PASSAGE_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT rid, doc_id, unnest(range(1, len(ws) - 48)) AS i, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS g FROM w),
m AS (SELECT g, min(doc_id) AS d FROM x GROUP BY g),
h AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM x JOIN m USING (g) WHERE m.d < x.doc_id),
r AS (SELECT rid, list(p) AS ps FROM h GROUP BY rid),
a AS (SELECT w.rid, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT a.rid, string_agg(word, ' ' ORDER BY a.p) AS kept, count(*) AS n FROM a LEFT JOIN h ON a.rid = h.rid AND a.p = h.p WHERE h.p IS NULL GROUP BY a.rid)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (rid)
"""


@query("op4_recompression", PASSAGE_SQL)
def op4(spark, root):
    return digests(table(spark, root, "documents"))
