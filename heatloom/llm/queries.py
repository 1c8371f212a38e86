"""The registered queries of this package; each derives its columns from one operator."""

from __future__ import annotations

from heatloom.llm import (  # noqa: F401
    bpe_queries, conversation_queries, host_queries, html_queries, lang_queries, mixing_queries, near_queries,
    passage_queries, quality_queries, repeat_queries, topk_queries, variant_queries, warc_queries,
)
from heatloom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
