"""Repeated byte strings."""

from heatloom.llm.registry import query, table
from heatloom.llm.repeats import digests


@query("op2_run_index_dedup")
def op2(spark, root):
    return digests(table(spark, root, "documents"))
