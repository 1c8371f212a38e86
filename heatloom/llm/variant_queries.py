"""Spelling variants of the words of all documents."""

from heatloom.llm.crc_sql import TABLE, crc32
from heatloom.llm.registry import query, table
from heatloom.llm.store import Scratch
from heatloom.llm.variants import group_variants, run_counts

SLIP = 199  # of so many different runs of a document one loses a letter

# Words one apart are equal after a letter is taken out at the same place, or the longer is equal to the shorter after that.
VARIANT_SQL = rf"""
WITH RECURSIVE k AS (SELECT {TABLE} AS crc),
t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS n FROM t WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT *, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run", 'crc')} AS h FROM c, k),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
  ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
g AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM g),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.less = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.less = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
  CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM v LEFT JOIN b USING (word)),
r(word, root) AS (SELECT word, word FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r JOIN f ON r.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e USING (word)
"""


@query("op13_spelling_variants", VARIANT_SQL)
def op13(spark, root):
    counts = run_counts(table(spark, root, "documents"), slip=SLIP)
    return group_variants(Scratch(spark).table(counts, "words"))
