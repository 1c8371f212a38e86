"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from heatloom.sources import readers, sinks
from heatloom.sources.lexicon import load_lexicon
from heatloom.session import checkpoint_root


def write(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text, encoding="utf-8")
    return str(path)


def test_delimited_readers(spark, tmp_path):
    posts = readers.read_posts(spark, write(tmp_path / "p", "a.csv", '7,"x y,2017-03-10 08:00,12\n'))
    assert posts.first().asDict() == {"index": 7, "text": '"x y', "time": "2017-03-10 08:00", "recall": 12}
    forum = readers.read_forum(spark, write(tmp_path / "f", "a.csv", "t,c,x,n,d,3,net\n"))
    assert forum.first()["recall"] == 3 and forum.columns[-1] == "net"
    reviews = readers.read_reviews(spark, write(tmp_path / "r", "a.csv", "4.5,family,good room\n"))
    assert tuple(reviews.first()) == (4.5, "good room", "family")
    cut = readers.read_segmented_reviews(spark, write(tmp_path / "s", "a.csv", "1,a b,4.5,ab,family\n"))
    assert cut.first()["splitwords"] == "a b"
    log = readers.read_search_log(spark, write(tmp_path / "l", "a.tsv", '00:00\t9\t["q"]\t1 2\thttp://x\n'))
    assert log.first()["user_id"] == 9 and log.first()["keyword"] == '["q"]'


def test_bad_field_fails(spark, tmp_path):
    posts = readers.read_posts(spark, write(tmp_path / "p", "a.csv", "seven,x,t,1\n"))
    with pytest.raises(Exception):
        posts.collect()


def test_labelled_lines(spark, tmp_path):
    line = '"u"\t"1"\t"{}"\t"news"\t"0.5"\t"?"\t"-2"\t"1"\n'
    row = readers.read_labelled_tsv(spark, write(tmp_path / "t", "a.tsv", line)).first()
    assert (row["category"], row["features"], row["label"]) == ("news", [0.5, 0.0, -2.0], 1)


def test_whole_documents(spark, tmp_path):
    write(tmp_path / "d" / "hockey", "17", "one\ntwo")
    write(tmp_path / "d" / "space", "18", "three")
    got = {tuple(r) for r in readers.read_documents_dir(spark, str(tmp_path / "d" / "*")).collect()}
    assert got == {("hockey", "17", "one\ntwo"), ("space", "18", "three")}


def test_header_and_lines(spark, tmp_path):
    path = write(tmp_path / "h", "a.csv", "x,y\n1,2\n")
    assert readers.read_header_csv(spark, path).select("y").first()[0] == "2"
    assert readers.read_lines(spark, path).count() == 2


def test_lexicon(spark, tmp_path):
    write(tmp_path / "x", "a.lex", "﻿CJK_WORDS\n#note\n人事部/nt/ren shi bu/人事,部门\n退/null/tui/null/28211\n")
    write(tmp_path / "x", "b.lex", "plain\n\n#\n/\n")
    got = {r["word"]: r for r in load_lexicon(spark, str(tmp_path / "x")).collect()}
    assert set(got) == {"人事部", "退", "plain", "#", "/"}
    assert got["人事部"]["synonyms"] == ["人事", "部门"] and got["人事部"]["type"] == "CJK_WORDS"
    assert got["退"]["pos"] is None and got["退"]["freq"] == 28211
    assert got["plain"]["type"] is None and got["plain"]["file"] == "b.lex"


def test_one_folder_per_key(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("key"))
    path = str(tmp_path / "keys")
    sinks.write_by_key(rows, "key", path, rows_per_file=10)
    assert sorted(p.name for p in (tmp_path / "keys").iterdir() if p.is_dir()) == ["folder=0", "folder=1", "folder=2"]
    assert spark.read.parquet(path).count() == 100


def test_checkpoint_folder_comes_from_the_session(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir")
