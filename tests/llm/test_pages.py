"""Pages: odd input, marked articles, and both ways that templates travel."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.llm import pages


def texts(spark, rows, **how):
    df = spark.createDataFrame([(i, f"https://h{h}.example/{i}", x) for i, (h, x) in enumerate(rows)], "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in pages.main_texts(df, **how).collect()}
    return [got[i] for i in range(len(rows))]


def article(name, body="", share="<p>Share this story</p>"):
    return f"<html><body><nav>Home</nav><article><h1>{name}</h1><p>{name} one<p>{name} two{body}{share}</article><footer>Rights</footer>"


def test_template_within_marked_articles(spark):
    """What all articles of a host share goes, but not what copies of an article share."""
    names = [f"story{i}" for i in range(9)]
    rows = [(1, article(n)) for n in names] + [(2, article("same", f"<p>ad {i}</p>")) for i in range(9)] + [(3, article(n, share="")) for n in names[:3]]
    rows += [(4, article(n, share="<p>Yes.</p>" if i % 2 else "<p>No.</p>")) for i, n in enumerate(names)]
    rows += [(5, "<article><p>Nothing but this</article>")] * 9
    got = texts(spark, rows)
    assert got[:9] == [f"{n}\n{n} one\n{n} two" for n in names]
    assert got[9:18] == [f"same\nsame one\nsame two\nad {i}\nShare this story" for i in range(9)]
    assert got[18:21] == [f"{n}\n{n} one\n{n} two" for n in names[:3]]
    assert got[21:30] == [f"{n}\n{n} one\n{n} two\n{'Yes.' if i % 2 else 'No.'}" for i, n in enumerate(names)]
    assert got[30:] == ["Nothing but this"] * 9


def test_long_pages_both_ways(spark):
    """Unmarked pages of over 1000 elements, with template in front of and behind what differs; no size decides."""

    def page(n, kind):
        posts = "".join(f"<div><h2>{n} title {i}</h2><ul><li>{n} item {i}</ul></div><section>{n} note {i}</section>" for i in range(260))
        return f"<body><div><p>Site name</p></div>{posts}<table><tr><td>All rights {kind}</table>" + (f"<pre>{kind}</pre>" if kind else "")

    rows = [(h, page(f"p{h}x{i}", "old" * (i % 2))) for h in range(3) for i in range(10)]
    want = ["\n".join(f"p{h}x{i} title {k}\np{h}x{i} item {k}\np{h}x{i} note {k}" for k in range(260)) for h in range(3) for i in range(10)]
    assert texts(spark, rows) == texts(spark, rows, sent_bytes=0) == want


def test_hosts_of_four_pages(spark):
    """As few pages as make a template, whatever their ids and texts."""
    rows = [(h, f"<body><div><p>Site {h}</p><div>{h} {n} text</div><p>All rights</p></div>") for h in range(60) for n in "abcd"]
    assert texts(spark, rows) == [f"{h} {n} text" for h in range(60) for n in "abcd"]


def test_layouts_that_no_reference_has(spark):
    base = lambda n, more="": f"<body><div><p>Site name</p><div>{n} text</div>{more}<p>All rights</p></div>"
    rows = [(1, base(f"n{i}")) for i in range(8)] + [(1, base("odd", "<blockquote>odd quote</blockquote>"))]
    assert texts(spark, rows, references=4, most=4) == [f"n{i} text" for i in range(8)] + ["odd text\nodd quote"]


def test_odd_rows(spark):
    """Nulls, empty and broken pages, repeated rows and ids, names that clash, faulty bytes."""
    rows = [
        (None, None, None), (1, None, "<p>a</p>"), (1, "x", ""), (2, "http://h/", "<p>b"), (2, "http://h/", "<p>b"), (2, "http://h/", "<article>c</article>"), (3, "http://h/", " \n "),
        (4, "http://h/", "<" * 2000), (5, "http://h/", "<div>" * 20_000 + "deep"), (6, "http://h/", "<!-- never closed"), (7, "http://h/", "</p></p>&amp;&#x41;<script>x"), (8, "http://h/", "word " * 100_000),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    df = df.unionByName(spark.range(1).select(F.lit(9).cast("bigint").alias("page_id"), F.lit("http://h/").alias("url"), F.unhex(F.lit("3C703E61FF62")).cast("string").alias("html")))
    df = df.withColumns({c: F.lit("kept") for c in ("host", "text", "template", "key", "layout", "_host", "n_chars", "skeleton")}).repartition(3)
    got = pages.main_texts(df).collect()
    assert Counter(r.page_id for r in got) == Counter([r[0] for r in rows] + [9]) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[None] == by[3] == by[6] == "" and by[5] == "deep" and by[7] == "&A" and by[8] == ("word " * 100_000).strip() and by[9] == "a�b"
    assert Counter(r.text for r in got if r.page_id == 2) == Counter(["b", "b", "c"])
    assert pages.main_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("source", [
    "<div>" * 8000 + "</section>" * 8000, "<b>" * 20_000 + "</i>" * 20_000 + "x", "<i>" + "<div>" * 9000 + "</i>" * 9000, "<li>" * 20_000, "<table>" + "<tr><td>" * 20_000, "<p>" * 40_000, "<div><b>" * 9000 + "</b>" * 9000,
])
def test_parser_is_linear(source):
    began = time.process_time()
    pages.extract(source + "<p>end</p>")
    assert time.process_time() - began < 3


def test_induction_counts_pages_that_differ():
    def induced(sources):
        return pages.induce([pages.json.dumps(pages._sketched(x)) for x in sources])

    page = lambda n: f"<body><div>Site</div><div>{n}</div>"
    assert induced([page(n) for n in "abc"]) == [] and induced([page("a")] * 9) == [] and induced([]) == []
    (layout, found), = induced([page(n) for n in "abcd"] * 2)
    assert [t for t in found.values()] == [[pages._hash("Site")]] and layout[0][0] == "#root"
