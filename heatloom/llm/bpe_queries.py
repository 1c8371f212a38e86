"""Byte-level BPE."""

import public_tokenizers

from heatloom.llm.bpe import digests
from heatloom.llm.registry import query, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op6_byte_bpe")
def op6(spark, root):
    return digests(table(spark, root, "documents"), RANKS)
