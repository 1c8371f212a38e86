"""Dictionary files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names that may open a dictionary file.
LEXICON_TYPES = [
    "CJK_WORDS", "CJK_UNITS", "STOP_WORDS", "CN_SNAME", "CN_LNAME", "CN_DNAME_1", "CN_DNAME_2",
    "CN_LNAME_ADORN", "EC_MIXED_WORD", "CE_MIXED_WORD", "EN_WORD", "EN_PUN_WORDS",
]


def load_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``(word, pos, pinyin, synonyms, freq, type, file)`` from dictionary files.

    A line is ``word[/pos/pinyin/synonyms[/freq]]``; the text ``null`` marks a missing field.
    A type name on a line of its own gives the type of its file; files without one are plain
    word lists with a NULL type. Lines that start with ``#`` are notes, a lone ``#`` is a word.
    """
    lines = spark.read.text(path).select(
        F.trim(F.regexp_replace("value", "^﻿", "")).alias("line"),
        path_file().alias("file"),
    )
    lines = lines.filter((F.col("line") != "") & ~F.col("line").rlike("^#."))
    is_type = F.col("line").isin(*LEXICON_TYPES)
    types = lines.filter(is_type).groupBy("file").agg(F.min("line").alias("type"))
    # "/" itself is a word of punctuation lists, so a leading slash does not separate fields
    cells = F.split("line", "(?<!^)/")

    def field(i: int):
        value = F.get("cells", F.lit(i))
        return F.when((value != "null") & (value != ""), value)

    return (
        lines.filter(~is_type)
        .withColumn("cells", cells)
        .select(
            F.col("cells")[0].alias("word"), field(1).alias("pos"), field(2).alias("pinyin"),
            F.split(field(3), ",").alias("synonyms"),
            field(4).try_cast("long").alias("freq"), "file",
        )
        .join(types, "file", "left")
        .select("word", "pos", "pinyin", "synonyms", "freq", "type", "file")
    )


def path_file():
    return F.element_at(F.split(F.input_file_name(), "/"), -1)
