"""No row may hold a task: time follows a page's or text's length, and results are those of a slow reader."""

import datetime
import re
import time

import pytest
from pyspark.sql import functions as F

from cityjobs.operators import evals, ingest, markup, pages, urls
from cityjobs.plans import corpus


def seconds(run):
    """The least of a few runs."""
    out = []
    for _ in range(3):
        start = time.perf_counter()
        run()
        out.append(time.perf_counter() - start)
    return min(out)


@pytest.mark.parametrize("case", ["<h2>x", "<h1>x", "<a ", "<a x=\"", "<a <b \">", "<li>x<ul>", "<p>x<div>", "<div class='c'>x", "<nav>x", "<!-- ", "<script>", "</h2", "<b><h2>x", "<x-a heading=f>y", "&#", "<p a='"])
def test_pages_in_linear_time(case):
    profile = pages.HtmlProfile(root=("div", "c"), largest=True, folds="x-a", bogus=frozenset({"q"}))
    short, long = (seconds(lambda n=n: pages._Sections(profile).read(case * (n // len(case)))) for n in (60_000, 240_000))
    assert long < 8 * short + 0.05
    assert seconds(lambda: markup.links(case * (1_000_000 // len(case)))) < 20


def test_odd_markup():
    read = lambda html: [(k, n) for k, n, _ in markup.tokens(html)]
    start, end, text = markup.START, markup.END, markup.TEXT
    assert read("a<b>c</b>d") == [(text, "a"), (start, "b"), (text, "c"), (end, "b"), (text, "d")]
    assert read("1 < 2 <i>x") == [(text, "1 < 2 "), (start, "i"), (text, "x")]
    assert read("<!-- <a> -->x<!doctype z><?y?>") == [(text, "x")]
    assert read("x<!-- <a>") == [(text, "x")]
    assert read("<script>if (a<b) '</p>'</SCRIPT >y") == [(start, "script"), (text, "if (a<b) '</p>'"), (end, "script"), (text, "y")]
    assert read("x<a href=") == [(text, "x<a href=")]
    assert read("") == []
    assert list(markup.tokens("<A HREF='a&amp;b' x y=\"1>2\" z=3/>t"))[0] == (start, "a", [("href", "a&b"), ("x", None), ("y", "1>2"), ("z", "3/")])
    assert markup.links("<a href=x>1</a><A class=b HREF = \"y&amp;z\">2<a>3<a href>4<!--<a href=no>--><a title='<' href='v>w'>") == ["x", "y&z", "", "v>w"]


def test_parts_inside_parts():
    """Of 40 lists inside each other the 32 outermost items count; the text of deeper ones is theirs."""
    html = "".join(f"<ul><li>t{k}" for k in range(40))
    found = pages._Sections(pages.HtmlProfile()).read(html)["sections"][0]["text"].split("\n\n")
    assert len(found) == 32 and all(x.endswith("t38 t39") for x in found) and found[31].startswith("t31 t32")


def test_scrubbed_texts_in_linear_time(spark):
    slow = lambda t: re.sub(r"\+?\d[\d ()/-]{7,}\d", "[phone]", re.sub(r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "[iban]", re.sub(r"[^@\s]+@[^@\s]+\.[^@\s]+", "[email]", t)))
    texts = ["a@b.ch", "x a@b", "a@b@c.d e", "@a@b.c", "a@@b.c", "a@b.c@d.e f@g.h", "..@..", "tel +41 44 123 45 67, CH9300762011623852957", "a@b. c@d.e.", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(evals.scrub_pii(F.col("t"))).collect()] == [slow(t) for t in texts]
    for sign in ("a", "a@", "1(", "a.", "@", "AB12"):
        row = spark.createDataFrame([(sign * (1_000_000 // len(sign)),)], "t string").select(F.length(evals.scrub_pii(F.col("t"))))
        start = time.perf_counter()
        row.collect()
        assert time.perf_counter() - start < 30, sign


def test_ingest_of_a_source(spark):
    """Every hook, what is left out and why, and chunks that break a rule."""
    text = "Ein Satz mit vielen Worten steht hier. " * 20
    page = lambda title, body: f"<title>{title}</title><main><h1>{title}</h1>{body}</main>"
    rows = [
        ("https://x.ch/a/one", page("One", f"<h2>Teil</h2><p>{text}</p><h2>Links</h2><p>gone</p>")),
        ("https://x.ch/a/two", page("Two", f"<h2>Schritt 1</h2><p>{text}</p>")),
        ("https://x.ch/a/short", page("Short", "<p>too short</p>")),
        ("https://x.ch/a/none", f"<p>{text}</p>"),
        ("https://x.ch/a/null", None),
        ("https://x.ch/b/other", page("Other", f"<p>{text}</p>")),
    ]
    source = ingest.Source(
        "admin", "s", "S", "city", "de", datetime.date(2025, 1, 1), 7, link_filter=lambda url: url.contains("/a/"), title_transform=lambda title, url: F.concat(F.lower(title), F.lit("!")),
        tags_for=lambda title, text: F.array(title), subcategory_for=lambda url: urls.derive_subcategory(F.lit("admin"), url, -1), tail=("links",),
    )
    good, left_out = ingest.ingest(spark.createDataFrame(rows, "url string, html string"), source)
    found = {r["source_url"][-3:]: r for r in good.collect()}
    assert set(found) == {"one", "two"}
    one, two = found["one"], found["two"]
    assert (one["title"], one["tags"], one["subcategory"], one["doc_type"], one["ttl_days"], one["source"]) == ("one!", ["one!"], "admin/one", "article", 7, "s")
    assert "gone" not in one["display_text"] and one["heading_path"] == "S > one! > Teil" and two["doc_type"] == "procedure"
    assert sorted((r["source_url"][-5:], r["reason"]) for r in left_out.collect()) == [("/none", "no_content"), ("/null", "no_content"), ("short", "no_content")]
    summary = {(r["category"], r["source"]): r for r in pages.ingest_summary(good, left_out).collect()}
    total = summary["admin", "s"]
    assert (total["docs_written"], total["total_chunks"], total["procedures"], total["articles"], total["skipped"]) == (2, 2, 1, 1, 3) and len(summary) == 3
    bad = ingest.Source("nowhere", "s", "S", "city", "de", datetime.date(2025, 1, 1))
    good, left_out = ingest.ingest(spark.createDataFrame(rows[:1], "url string, html string"), bad)
    assert good.count() == 0 and [r["reason"] for r in left_out.collect()] == ["category"]


def test_crawl_levels(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("b", "x"), ("x", "y"), ("a", "z")]
    links = spark.createDataFrame(edges, "src string, dst string")
    seeds, failed = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("x",)], "node string")
    reach = lambda *a: sorted((r["depth"], r["node"]) for r in urls.bfs_reach(links, seeds, *a).collect())
    assert reach(3, failed) == [(0, "a"), (1, "b"), (1, "z"), (2, "c"), (3, "d")]
    assert reach(9, None, 4) == [(0, "a"), (1, "b"), (1, "z"), (2, "c")]
    assert reach(0) == [(0, "a")] and len(reach(9)) == 8


def test_registered_pages_have_what_the_slow_reader_finds(spark):
    rows = corpus.pages_of(spark, "/root/testdata/sf0.001").select("page_id", "html").collect()
    links = re.compile(r"<a\s(?:[^>]*?\s)?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
    for r in rows:
        want = [x.strip("\"'").replace("&amp;", "&") for x in links.findall(r["html"])]
        assert markup.links(r["html"]) == want
