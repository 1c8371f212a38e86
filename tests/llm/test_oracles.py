"""Queries with SQL, over a test table and over awkward rows."""

import random

import pytest
from compare import canonical, connect

from heatloom.llm.queries import ORACLES, QUERIES

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    frame = QUERIES[name](spark, ROOT)
    got = canonical(frame.columns, frame.collect())
    cursor = connect(ROOT).execute(ORACLES[name])
    assert got == canonical([d[0] for d in cursor.description], cursor.fetchall())


def awkward_documents():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 5)))
    prose = lambda n, by=" ": by.join(word() for _ in range(n))
    base = prose(300).split(" ")
    texts = [None, "", " \n\t\x0b\x0c\r ", "one", "Two words", "two  WORDS", "a b c d", "a b c d e", "A b C d e", "É b c d e", "é b c d e",
             "x " * 60, "x y " * 40, "the same\nthe same\nother\n\n \nthe same", "#*$%&|<>", "a\x00b \x01", "\u00a0 \u2003", "w" * 20_000,
             prose(49), prose(50), prose(51), prose(4000), " ".join(base), " ".join(base), "\n".join(base)]
    for _ in range(30):
        copy = list(base)
        for _ in range(rng.randrange(1, 14)):
            copy[rng.randrange(len(copy))] = word() + "z"
        texts.append(" ".join(copy))
    passage = base[100:170]
    texts += [prose(30) + " " + " ".join(passage) + " " + prose(20), " ".join(passage[:50]), " ".join(passage[:49]), " ".join(passage[10:61])]
    texts += ["menu home\n" + prose(60) + "\nAll rights 2021\n" + prose(9) for _ in range(60)] + ["menu home\nAll rights 2022\n" * 30 + "only this"]
    texts += ["head one\nhead two\nhead three\n" + prose(70) + "\nfoot one\nfoot two\nfoot three" for _ in range(25)]
    texts += ["head one\nhead two\nhead three\n" * 20 + prose(8) + "\nfoot one\nfoot two\nfoot three" * 20]
    sources = [None, "", "s1", "s1", "s1", "s2"]
    rows = [(k * 3 + 1, t, "en", "s1" if k > 60 else sources[k % 6], k) for k, t in enumerate(texts)]
    return rows + rows[3:6] + [rows[22]]


def clashing(frame):
    """Columns with the names that the operators use inside."""
    return frame.selectExpr("*", "text AS id", "doc_id AS n", "text AS key", "doc_id AS t1", "'x' AS _host", "1 AS root", "text AS kept",
                            "2 AS block", "text AS _t", "text AS _id", "1 AS slot", "doc_id AS comp", "'q' AS _row", "text AS d")


DOCUMENT_QUERIES = ["op3_near_duplicates", "op4_recompression", "op7_mix_sources", "op9_quality_rules"]


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_awkward_rows(spark, both, name):
    rows = awkward_documents()
    if name == "op7_mix_sources":
        rows = rows[:-4]
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got, want = both(name, documents=docs)
    assert got == want


@pytest.mark.parametrize("name", DOCUMENT_QUERIES)
def test_empty_documents(spark, both, name):
    got, want = both(name, documents=clashing(spark.createDataFrame([], SCHEMA)))
    assert got[1] == [] and got[0] == want[0]


def test_urls(spark, both):
    urls = [None, "", "no scheme", "http://", "https://A.Com", "https://a.com/", "http://com/x", "ftp://Example.COM/en/1?q#f", "http://www.example.com/en/",
            "http://x.www.example.com/en/a", "http://notexample.com/en/", "x://a://b/c", "http://u@h.net:80/es/1", "http://h.net/es/", "http://h.net/es",
            "http://h.net?/es/", "http://h.net#/fr/", "http://ÄB.org/é", "http://a.net/fr/x#y", "https://com", "http://127.0.0.1/", "http://h.org/a b\nc"]
    urls += [f"http://bad.{k % 3}.org/{k}" for k in range(90)] + [f"http://good{k % 5}.org/{k}" for k in range(60)]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)] + [(5, urls[5], "h")], "page_id long, url string, html string")
    labels = spark.createDataFrame([(k, 1, 1 if "bad" in (u or "") else 0) for k, u in enumerate(urls) if k % 4] + [(3, 1, None), (9999, 0, 1), (None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    pages = pages.selectExpr("*", "url AS host", "'p' AS path", "page_id AS _id", "1 AS n", "'r' AS rule")
    got, want = both("op5_host_reputation", pages=pages, labels=labels)
    assert got == want
    assert {"allow", "block"} <= {row[got[0].index("verdict")].strip("'") for row in got[1]}
    none = spark.createDataFrame([], pages.schema)
    assert both("op5_host_reputation", pages=none, labels=labels)[0][1] == []
    got, want = both("op5_host_reputation", pages=pages, labels=spark.createDataFrame([], labels.schema))
    assert got == want


def test_vectors(spark, both):
    rng = random.Random(8)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    same = vec()
    rows = [(k, same if k % 3 == 0 else vec(), 1) for k in range(400)]
    rows += [(1000, None, 1), (1050, [], 1), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1150, [float("nan")] * 6, 1), (1200, [float("inf")] * 6, 1)]
    rows += [rows[50], rows[7], (None, vec(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "vec_id AS id", "embedding AS v", "1 AS block", "2 AS pivot")
    got, want = both("op10_pivot_top_k", embeddings=frame.filter("vec_id IS NOT NULL"))
    assert got == want
    assert both("op10_pivot_top_k", embeddings=frame)[0] == got
    few = frame.filter("vec_id IN (0, 50, 51)")
    got, want = both("op10_pivot_top_k", embeddings=few)
    assert got == want and len(got[1]) == 4
    assert both("op10_pivot_top_k", embeddings=frame.limit(0))[0][1] == []
