"""Pages through WARC archives and back."""

from pyspark.sql import functions as F

from heatloom.llm.registry import query, table
from heatloom.llm.warc import read_archives, write_archives
from heatloom.session import remove_paths, scratch_path

# The digest's hexadecimal digits are turned into bits and these, five by five, into base32 letters.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top, octet_length(encode(html))::BIGINT AS n, sha1(html) AS h FROM p GROUP BY html),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
  lpad(bin(instr('0123456789abcdef', h[i]) - 1), 4, '0')), '') AS bits FROM g),
d AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + list_sum(list_transform(range(1, 6), lambda j: bits[5 * i + j]::INTEGER * (1 << (5 - j))))::INTEGER, 1)), '') AS sha FROM b)
SELECT page_id, n AS payload_bytes, sha AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM p JOIN d USING (html)
"""


@query("op11_warc", WARC_SQL)
def op11(spark, root):
    pages = table(spark, root, "pages")
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    rows = read_archives(spark, path, with_payload=False)
    remove_paths(spark, [path])  # the records are in a table of their own by now
    kind = pages.schema["page_id"].dataType
    return rows.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_page").cast(kind).alias("refers_to"))
