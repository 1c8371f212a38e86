"""Words, segmentation, contexts and the order of rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from heatloom.functions.text import format_tokens, percent, safe_key, ws_words
from heatloom.operators import order, terms, weights
from heatloom.operators.kwic import kwic


def test_ws_words(spark):
    row = spark.createDataFrame([("  A b\t\nC  ",)], "t string").select(ws_words(F.col("t")).alias("w")).first()
    assert row["w"] == ["a", "b", "c"]


def test_safe_key_and_formats(spark):
    rows = spark.createDataFrame([("[汽车 a-1](x)",), ("!?",)], "k string")
    assert [r[0] for r in rows.select(safe_key(F.col("k"))).collect()] == ["汽车a1(x)", "Null"]
    line = spark.createDataFrame([(["[a", "(b c)"],)], "t array<string>").select(format_tokens(F.col("t"))).first()[0]
    assert line == "a bc"
    assert spark.range(1).select(percent(F.lit(0.123456))).first()[0] == "12.3456%"


def test_context_of_the_first_word(spark):
    docs = spark.createDataFrame([(1, list("abcddeffg"))], "doc_id int, words array<string>")
    assert kwic(docs, ["a"], 4).first()["context"] == "(a) b c d d "


@pytest.mark.parametrize("block_words", [5, 13, 1000])
def test_contexts_across_documents(spark, block_words):
    rng = random.Random(3)
    texts = [[rng.choice("abcdef") for _ in range(rng.randrange(12))] for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, words array<string>").repartition(5)
    joined = [w for t in texts for w in t]
    want = set()
    for i, w in enumerate(joined):
        if w == "a":
            left = "".join(x + " " for x in joined[max(i - 3, 0):i])
            right = "".join(x + " " for x in joined[i + 1:i + 4])
            want.add((i, f"{left}(a) {right}"))
    found = kwic(docs, ["a"], 3, cross_document=True, block_words=block_words).collect()
    assert {(r["pos"], r["context"]) for r in found} == want and len(found) == len(want)


LEXICON = ["汽车", "汽车站", "北京", "北京汽车", "站", "服务", "一二三四五六七八"]
TEXT = "北京汽车站的服务OK2 一二三四五六七八"


@pytest.mark.parametrize("max_lexicon", [1000, 2])
def test_segmentation(spark, max_lexicon):
    """The longest word first, unknown characters dropped, over-long words never matched."""
    lexicon = spark.createDataFrame([(w,) for w in LEXICON], "word string")
    stop = spark.createDataFrame([("站",)], "word string")
    docs = spark.createDataFrame([(1, TEXT), (2, ""), (3, "abc")], "doc_id int, text string")
    cut = terms.segment_corpus(docs, lexicon, stop, max_lexicon=max_lexicon)
    got = {r["doc_id"]: r["words"] for r in cut.collect()}
    assert got == {1: ["北京汽车", "服务", "ok2"], 2: [], 3: ["abc"]}


def test_synonyms(spark):
    lexicon = spark.createDataFrame([("admire", ["like", "love"]), ("x", None)], "word string, synonyms array<string>")
    tokens = spark.createDataFrame([(0, "admire"), (1, "x")], "pos int, term string")
    got = terms.expand_synonyms(tokens, lexicon).collect()
    assert {(r["pos"], r["term"]) for r in got} == {(0, "admire"), (0, "like"), (0, "love"), (1, "x")}


def test_top_terms_ties_and_short_documents(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "c"]), (2, ["a"]), (3, [])], "doc_id int, words array<string>")
    top = weights.top_terms(weights.tfidf(docs), 2).collect()
    assert {(r["doc_id"], r["rank"], r["term"]) for r in top} == {(1, 1, "b"), (1, 2, "c"), (2, 1, "a")}


def test_running_numbers_over_many_partitions(spark):
    rows = spark.range(5000, numPartitions=16).select((F.col("id") * 7919 % 5003).alias("v"))
    found = order.row_index(rows, [F.col("v")]).orderBy("v").collect()
    assert [r["index"] for r in found] == list(range(1, 5001))
    sums = order.running_total(rows, [F.col("v")], "v", "before").orderBy("v").collect()
    total = 0
    for r in sums:
        assert r["before"] == total
        total += r["v"]


def test_clean_terms(spark):
    docs = spark.createDataFrame([(1, "The cat2 sat, sat on X"), (2, "Dog. the dog's sat")], "doc_id int, text string")
    got = {(r["doc_id"], r["term"], r["tf"]) for r in terms.clean_terms(docs).collect()}
    assert got == {(1, "sat", 2), (2, "sat", 1), (2, "dog", 2)}


@pytest.mark.parametrize("chunk", [1, 2_000_000])
def test_clean_terms_in_chunks(spark, monkeypatch, chunk):
    """texts counted together settle their frequent terms; only the others meet the totals of all texts."""
    monkeypatch.setattr(terms, "CHUNK_BYTES", chunk)
    rows = [(1, "Caf\u00e9 caf tree_1 tree_ ROOT"), (2, None), (None, "root\nleaf leaf of"), (4, ""), (4, "\u0130x ab,caf \U0001f600zz"), (4, "ab")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["term"], r["tf"]) for r in terms.clean_terms(docs).collect())
    assert got == [(0, "leaf", 2), (0, "root", 1), (1, "caf", 2), (1, "root", 1), (4, "ab", 1), (4, "ab", 1), (4, "caf", 1)]
    counts = terms._news_counts(docs, ["doc_id"], "text", terms.NEWS_STOPWORDS, 2)
    open_rows = counts.filter("_near < 2").count()
    assert open_rows == (7 if chunk == 1 else 2)  # together only "tree_" and "zz" are rare


def test_segmentation_cuts_each_run_once(spark):
    """the distinct runs of a batch are cut, not every run; stop words go in the same step."""
    lexicon = spark.createDataFrame([("ab",), ("abc",), ("d",)], "word string")
    stop = spark.createDataFrame([("d",), ("\u00fc9",)], "word string")
    docs = spark.createDataFrame([(1, "ABCDx \u00fc9 abab"), (2, None), (3, "abcd 7 \u00fc9"), (None, "")], "doc_id int, text string").coalesce(1)
    frame = terms.segment_corpus(docs, lexicon, stop, dictionary_chars="a-z")
    assert {r["doc_id"]: r["words"] for r in frame.collect()} == {1: ["abc", "ab", "ab"], 2: None, 3: ["abc", "7"], None: []}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" not in plan and "lambdafunction" not in plan


@pytest.mark.parametrize("block", [1, 5, 2_000_000])
def test_tfidf_over_blocks(spark, monkeypatch, block):
    """only the different terms of a block meet their document counts; no row of all terms is shuffled or joined."""
    monkeypatch.setattr(weights, "BLOCK_WORDS", block)
    rows = [(1, "a b b"), (2, None), (None, "a café"), (4, ""), (4, "b z z z"), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(2).select("doc_id", F.lit("x").alias("lang"), ws_words(F.col("text")).alias("words"))
    frame = weights.tfidf(docs, ["lang", "doc_id"])
    assert frame.columns == ["term", "lang", "doc_id", "tf", "tfidf"]
    df = {"a": 3, "b": 3, "café": 1, "z": 1}
    want = [(r, w, t.split().count(w)) for r, t in rows if t for w in sorted(set(t.split()))]
    got = [(r["doc_id"], r["term"], r["tf"], round(r["tfidf"], 9)) for r in frame.collect()]
    assert sorted(got, key=str) == sorted(((r, w, n, round(n * math.log(7 / (df[w] + 1)), 9)) for r, w, n in want), key=str)
    assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()


def test_top_terms_cut_early(spark):
    """rows that clearly lose go before the sort; ties in nine places, null and NaN scores and documents in parts stay right."""
    rows = [(1, "d", 2.0), (1, "c", 1.0), (1, "b", 1.0 + 1e-11), (1, "a", 1.0), (1, "e", 0.5), (2, "x", None), (2, "y", float("nan")), (2, "z", 3.0),
            (1, "f", 2.5), (None, "k", 1.0), (None, "l", 2.0)]
    frame = spark.createDataFrame(rows, "doc_id int, term string, s double").coalesce(1)
    got = {(r["doc_id"], r["rank"], r["term"]) for r in weights.top_terms(frame, 2, "s").collect()}
    assert got == {(1, 1, "f"), (1, 2, "d"), (2, 1, "y"), (2, 2, "z"), (None, 1, "l"), (None, 2, "k")}
    assert {r["term"] for r in weights._leading(frame, 2, "s", ["doc_id"]).collect()} == set("dabcfxyzkl")
