"""Operators without SQL, and what the queries do not show of the others."""

import random

import numpy as np
import pytest

from heatloom.llm import html, langid, minhash, mixing, quality, recompress


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def test_pages(spark):
    def page(inner):
        return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav>{inner}<footer>f</footer></body></html>"

    cases = [
        (None, ""), ("", ""), ("   ", ""), ("just text &amp; more", "just text & more"),
        (page("<article><h1>A&nbsp;title</h1><p>One\n two<br>three<p><b>four &lt;tag&gt;</article>"), "A title\nOne two three\nfour <tag>"),
        (page("<script>var t='</p><article>';</script><article><p>x<!-- no --></p><script>1<2</script><p>y</p></article>"), "x\ny"),
        (page("<div class='ad box'>buy</div><article><p>text</p><div id='comments'><p>nice</p></div><form><p>mail</p></form></article>"), "text"),
        (page("<aside>side</aside><header>h</header><div role=banner>b</div><main><p>m</p><ul><li>one<li>two</ul></main>"), "m\none\ntwo"),
        (page("<div class=cookie-notice>we use</div><div><div><p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p></div></div><div class=sideBar>s</div>"),
         ("word " * 40).strip() + "\n" + ("more " * 30).strip()),
        ("<article><p>unclosed <i>x", "unclosed x"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<p>a < b and c</p>", "a < b and c"), ("<article><p>" + "long " * 50_000 + "</p></article>", ("long " * 50_000).strip()),
    ]
    rows = [(k, f"u{k}", h) for k, (h, _) in enumerate(cases)] + [(0, "u0", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' AS id", "html AS text", "1 AS n_chars")
    got = html.extract(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == cases[r.page_id][1], cases[r.page_id][0]
        assert r.n_chars == len(r.text)
    assert html.extract(frame.limit(0)).collect() == []


def test_density_prefers_text_to_links():
    links = "<div>" + "".join(f"<p><a href=/{k}>some link text here</a></p>" for k in range(60)) + "</div>"
    text = "<div>" + "".join(f"<p>sentence number {k} of the main text goes here.</p>" for k in range(12)) + "</div>"
    out = html.main_text(f"<body>{links}{text}{links}</body>")
    assert out.count("sentence") == 12 and "link" not in out


def test_languages(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    extra = [(10**7 + k, t, l, "s") for k, (t, l) in enumerate([(None, "en"), ("", "en"), ("12 34 !", "de"), ("é", None), ("hello", None)])]
    frame = spark.createDataFrame([tuple(r) for r in rows] + extra + [tuple(rows[0])], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in langid.identify(frame.selectExpr("*", "lang AS lang_pred", "1 AS id", "text AS score")).collect()}
    held = [r for r in rows if got[r.doc_id].held_out]
    assert len(held) > 200
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[10**7 + k].lang_pred for k in range(3)] == ["und"] * 3
    # what is predicted does not depend on the columns that are no inputs
    other = frame.filter(langid.held_out()).selectExpr("doc_id", "text", "'xx' AS lang", "'t' AS source")
    mixed = frame.filter(~langid.held_out()).unionByName(other)
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(mixed).collect()}
    assert again == {k: (r.lang_pred, r.score) for k, r in got.items()}
    assert langid.identify(frame.limit(0)).collect() == []
    nothing = langid.identify(frame.limit(5).selectExpr("doc_id", "text", "cast(null AS string) AS lang", "source")).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 4, 9, 40])
def test_codewords(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n
    assert all(abs(c.sum()) < n for c in code.T)
    model = langid.Model([str(k) for k in range(n)], np.eye(n, langid.BUCKETS) * 50)
    if n > 1:
        best, score, close = model.decode(model.code.astype(float))
        assert list(best) == list(range(n)) and not close.any() and (score <= 1).all()
        assert model.decode(np.zeros((1, model.code.shape[1])))[2].all()


def test_pfair_windows(spark):
    rng = random.Random(1)
    weights = [(f"s{k}", rng.choice([0.5, 1.0, 3.0, 10.0])) for k in range(11)]
    plan = mixing.schedule(spark.createDataFrame(weights, "source string, weight double"), 120).collect()
    n = plan[0].period
    assert sorted(r.slot for r in plan) == list(range(n))
    for r in plan:
        assert r.turn * n // r.quota <= r.slot < -(-(r.turn + 1) * n // r.quota)
    for source in {r.source for r in plan}:
        own = sorted(r.slot for r in plan if r.source == source)
        quota = len(own)
        for t in range(n + 1):
            assert abs(sum(s < t for s in own) - t * quota / n) < 1


def test_mixture_keeps_every_row(spark):
    rows = [(k, f"t{k}", ["a", "b", None][k % 7 % 3], 2) for k in range(500)] + [(3, "t3", "b", 2), (None, None, "a", None)]
    frame = docs(spark, rows).selectExpr("*", "1 AS slot", "2 AS _at", "source AS _source")
    out = mixing.mixed(frame, block_docs=8)
    assert out.columns == frame.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, frame.collect()))
    first = [r.source or "" for r in out.limit(120).collect()]
    assert {"a", "b", ""} == set(first)
    none = mixing.mix_order(frame, spark.createDataFrame([("a", 1.0), ("b", 0.0)], "source string, weight double")).collect()
    assert len(none) == len(rows) and {r.slot is None for r in none if r.source != "a"} == {True}
    assert mixing.mixed(frame.limit(0)).collect() == []


def test_near_duplicate_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(5, text, "s", 1), (5, other, "s", 1), (2, other + " x", "s", 1), (9, text + " y", "s", 1), (None, text, "s", 1), (7, "solo text", "s", 1), (7, "solo text", "s", 1)]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect())
    assert got == [(0, None, True), (2, 2, True), (5, 2, False), (5, 2, False), (7, 7, True), (7, 7, True), (9, 2, False)]
    kept = minhash.keep_first(docs(spark, rows))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 7]


def test_large_group_of_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10_000)}" for _ in range(300)]
    rows = []
    for k in range(400):
        copy = list(base)
        for _ in range(rng.randrange(4, 12)):
            copy[rng.randrange(300)] = f"x{rng.randrange(10_000)}"
        rows.append((k, " ".join(copy), "s", 1))
    sets = [{tuple(w[i:i + 5]) for i in range(296)} for w in (r[1].split() for r in rows)]
    root = list(range(400))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(400):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for rounds in (0, 3):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), pivot_rounds=rounds).collect()}
        assert got == {k: find(k) for k in range(400)}


def test_passage_spans_and_long_runs(spark):
    rows = [(1, "a " * 200 + "b", "s", 1), (2, "c " + "a " * 120 + "d", "s", 1), (3, "a " * 49, "s", 1), (4, None, "s", 1), (None, "a " * 80, "s", 1)]
    found, heads = recompress.passages(docs(spark, rows))
    spans = [(r.n_words, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept).decode()) for r in found.collect()]
    assert spans == [(122, 120, [(1, 121)], "c d")]
    assert heads.count() == 3


def test_frequent_lines_go(spark):
    rows = [(k, f"Home 12\n{' '.join(chr(97 + k % 26) * (k // 26 + 1) + chr(97 + i // 26) + chr(97 + i % 26) for i in range(60))}\nfooter  text", "h", 999) for k in range(80)]
    rows += [(100 + k, rows[0][1], "other", 5) for k in range(300)]  # copies make no line frequent
    rows += [(500, "home 7\nFooter text\nhome 9\n" * 20 + "one", "h", 1), (501, None, "h", 1), (502, "Home 1\n" + "q " * 60, None, 1)]
    frame = docs(spark, rows)
    kept = {r.doc_id: r for r in quality.clean(frame.selectExpr("*", "text AS _text", "1 AS _left")).collect()}
    assert kept[3].text == rows[3][1].split("\n")[1] and kept[3].n_chars == len(kept[3].text)
    assert kept[150].text == rows[0][1] and kept[150].n_chars == 5
    assert 500 not in kept and 501 not in kept and 502 not in kept
    verdict = {r.doc_id: r for r in quality.judge(frame).collect()}
    assert verdict[3].kept and verdict[3].n_left == 60 and not verdict[500].kept and not verdict[501].kept


def test_blocks_of_fixed_lines_go(spark):
    head, foot = "Home\nLogin\nCart", "About us\nTerms 2021\nContact"
    body = lambda k: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(k, f"{head}\n{body(k)}\n{foot}", "h", 999) for k in range(120)]
    rows += [(200 + k, f"{head}\n{body(7)}\n{foot}", "copies", 5) for k in range(120)]  # one distinct document
    rows += [(400 + k, (head + "\n" + foot + "\n") * 9 + f"only{chr(97 + k)} this", "h", 5) for k in range(5)]
    frame = docs(spark, rows)
    assert {(r._host, r["count"]) for r in quality.frequent_lines(frame).groupBy("_host").count().collect()} == {("h", 6)}
    kept = {r.doc_id: r.text for r in quality.clean(frame).collect()}
    assert all(kept[k] == body(k) for k in range(120))
    assert not kept.keys() & set(range(400, 405))  # depleted or repeated
    verdict = {r.doc_id: r for r in quality.judge(frame).collect()}
    assert all(verdict[k].n_left == 60 for k in range(120)) and all(verdict[k].n_left == 2 for k in range(400, 405))
    assert all(verdict[k].n_left == verdict[k].n_words for k in range(200, 320))


def test_articles_in_odd_pages_stay():
    text = "<p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p>"
    want = ("word " * 40).strip() + "\n" + ("more " * 30).strip()
    for mark in ('style="overflow:hidden"', 'data-title="Hidden gems"', "data-class='nav menu'", "class=has-sidebar", 'class="with-sidebar"',
                 "class='widget-content'", "id=share-enabled", "class=post-with-comments"):
        assert html.main_text(f"<body><div {mark}><div>{text}</div></div></body>") == want, mark
        assert html.main_text(f"<body><div {mark}><article>{text}</article><div class=sidebar>s <p>t</p></div></div></body>") == want, mark
    for head in ("<head><title>T</title>", "<head><title>T</title><body>", "<head><meta charset=x><link href=y><script>1</script><body class=b>"):
        assert html.main_text(f"<html>{head}<div>{text}</div></html>") == want, head
    assert html.main_text("<head><title>T</title>bare text") == "bare text"
    # what is hidden or named after noise beside the article still goes
    assert html.main_text(f"<body><div hidden>{text}</div><div>{text}</div></body>") == want
    assert html.main_text(f"<body><div><div>{text}</div><div id=comments>{text * 3}</div></div></body>") == want
    assert html.main_text(f"<body><article>{text}</article><div class=sidebar>{text * 5}</div></body>") == want
