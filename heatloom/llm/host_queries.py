"""URL filter."""

from heatloom.llm.hosts import filter_urls
from heatloom.llm.registry import query, table

_LEVEL = """SELECT sum(n) AS n, sum(bad) AS bad, count(*) AS k, sum(n * n) AS nn, round(sum(bad * bad / n), 6) AS b2 FROM {}"""
_STRENGTH = """SELECT p, round(greatest(1.0, least(1000.0, coalesce(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000.0 END, 1000.0))), 6) AS s FROM
  (SELECT p, (b2 - 2 * p * bad + p * p * n - p * (1 - p) * (k - 1)) / nullif(p * (1 - p) * (n - nn / nullif(n, 0) - (k - 1)), 0) AS rho
  FROM (SELECT *, (coalesce(bad, 0) + 1.0::DOUBLE) / (coalesce(n, 0) + 2.0::DOUBLE) AS p FROM ({})))"""
URL_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
seen AS (SELECT host, count(*)::DOUBLE AS n, sum((toxic = 1)::INT)::DOUBLE AS bad FROM u JOIN labels l ON l.doc_id = u.page_id
  WHERE toxic IS NOT NULL GROUP BY host),
h AS (SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad,
  string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS parts FROM (SELECT DISTINCT host FROM u) LEFT JOIN seen USING (host)),
h2 AS (SELECT host, n, bad, array_to_string(parts[-2:], '.') AS domain, parts[-1] AS suffix FROM h),
hs AS (SELECT * FROM h2 WHERE n > 0),
ds AS (SELECT domain, sum(n) AS n, sum(bad) AS bad FROM hs GROUP BY domain),
ss AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hs GROUP BY suffix),
fh AS ({_STRENGTH.format(_LEVEL.format('hs'))}), fd AS ({_STRENGTH.format(_LEVEL.format('ds'))}), fs AS ({_STRENGTH.format(_LEVEL.format('ss'))}),
q AS (SELECT h2.host, h2.n, h2.bad, fh.s AS sh, (coalesce(ds.bad, 0) + fd.s * ((coalesce(ss.bad, 0) + fs.s * fh.p) / (coalesce(ss.n, 0) + fs.s)))
  / (coalesce(ds.n, 0) + fd.s) AS prior FROM h2 LEFT JOIN ds USING (domain) LEFT JOIN ss USING (suffix), fh, fd, fs),
ab AS (SELECT host, bad + sh * prior AS a, n - bad + sh * (1 - prior) AS b FROM q),
bl AS (SELECT host FROM ab WHERE a / (a + b) - 1.645 * sqrt(a * b / (a + b + 1)) / (a + b) > 0.5),
rules(action, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action FROM u, rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.action, CASE WHEN bl.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN m USING (page_id) LEFT JOIN bl ON bl.host = u.host
"""


@query("op5_host_reputation", URL_SQL)
def op5(spark, root):
    return filter_urls(table(spark, root, "pages"), table(spark, root, "labels"))
