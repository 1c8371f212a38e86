"""Mixing of sources."""

from heatloom.llm.mixing import mix_order
from heatloom.llm.registry import query, table

# The slots of one period are filled one by one; the state is the list of blocks sent so far by each source.
OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
w AS (SELECT source, sqrt(count(*)) AS weight FROM d GROUP BY source),
q AS (SELECT source, greatest(1, round(weight * 200 / (SELECT sum(weight) FROM w)))::BIGINT AS q FROM w),
t AS (SELECT source, q, row_number() OVER (ORDER BY source) AS k, sum(q) OVER () AS n FROM q),
s(slot, pick, done) AS (
  SELECT -1::BIGINT, 0::BIGINT, (SELECT list(0::BIGINT ORDER BY k) FROM t)
  UNION ALL
  SELECT slot + 1, k, list_transform(done, lambda c, i: CASE WHEN i = k THEN c + 1 ELSE c END) FROM (
    SELECT s.slot, s.done, arg_min(t.k, (ceil((s.done[t.k] + 1) * t.n / t.q::DOUBLE), t.k)) AS k FROM s, t
    WHERE s.slot + 1 < t.n AND s.done[t.k] < t.q AND s.done[t.k] * t.n < (s.slot + 2) * t.q GROUP BY s.slot, s.done)),
p AS (SELECT t.source, t.q, t.n, s.slot, row_number() OVER (PARTITION BY t.source ORDER BY s.slot) - 1 AS turn
  FROM s JOIN t ON s.pick = t.k),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rank FROM d)
SELECT r.doc_id, r.source, (r.rank // 64)::BIGINT AS block, ((r.rank // 64) // p.q * p.n + p.slot)::BIGINT AS slot,
  (r.rank % 64)::INTEGER AS place FROM r JOIN p ON r.source = p.source AND (r.rank // 64) % p.q = p.turn
"""


@query("op7_mix_sources", OP7_SQL)
def op7(spark, root):
    return mix_order(table(spark, root, "documents"))
