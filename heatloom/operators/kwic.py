"""Keyword in context: the words around each hit of a target word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions.unnest import unnest_structs
from heatloom.operators.sequence import BLOCK_WORDS, word_blocks

# Target words of the hotel reviews.
REVIEW_TARGETS = [
    "服务", "设施", "早餐", "位置", "环境", "性价比", "装修", "价格", "房费", "卫生", "房间", "大堂",
    "娱乐", "健身", "停车场", "入住", "效率", "服务态度", "交通", "卫生间", "安静", "干净", "咖啡厅",
    "网络", "周边", "公交", "地铁", "前台", "空调", "热水",
]


def _hits(targets: list[str], radius: int, own_only: bool = False) -> Column:
    words = F.col("words")

    def hit(term: Column, i: Column) -> Column:
        left = F.slice(words, F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius)))
        right = F.slice(words, i + 2, F.lit(radius))
        marked = F.array(F.concat(F.lit("("), term, F.lit(")")))
        # the empty last entry gives the blank after the last word
        line = F.array_join(F.concat(left, marked, right, F.array(F.lit(""))), " ")
        wanted = term.isin(*targets)
        if own_only:
            wanted = wanted & (i >= F.col("own_from")) & (i < F.col("own_to"))
        return F.when(wanted, F.struct(i.alias("pos"), term.alias("word"), line.alias("context")))

    return F.array_compact(F.transform(words, hit))


def kwic(docs: DataFrame, targets: list[str] = REVIEW_TARGETS, radius: int = 3,
         doc: str = "doc_id", cross_document: bool = False,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per hit: position, word and ``left words (word) right words``.

    Contexts end at the document border. With ``cross_document`` the documents are laid end to
    end in ``doc`` order and ``pos`` counts from the first word of the corpus.
    """
    if not cross_document:
        hits = unnest_structs(docs, _hits(targets, radius), doc, required="pos")
        return hits.select(doc, "pos", "word", "context")
    blocks = word_blocks(docs, [doc], radius, radius, block_words=block_words)
    hits = unnest_structs(blocks, _hits(targets, radius, own_only=True), "start", required="pos")
    return hits.select((F.col("start") + F.col("pos")).alias("pos"), "word", "context")
