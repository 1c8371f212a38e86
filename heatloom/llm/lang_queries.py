"""Language identification."""

from heatloom.llm.langid import identify
from heatloom.llm.registry import query, table


@query("op8_language_codes")
def op8(spark, root):
    return identify(table(spark, root, "documents")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
