"""Main text of pages."""

from heatloom.llm.html import extract
from heatloom.llm.registry import query, table


@query("op1_text_density")
def op1(spark, root):
    return extract(table(spark, root, "pages"))
