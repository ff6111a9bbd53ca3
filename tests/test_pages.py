"""Extraction from captured pages."""

from tidemark.sources import pages as P

HTML = """<html><title> A  car </title><ul><li><b>Fuel type:</b> Diesel<li>Year: 2019</li><li>plain</li></ul><script>var t="</p>";</script>
<p>Some <i>text</i></p><a href="/list?page=3">next</a><a href="/list?page=9">last</a><a href="https://other.example/ad/1">seller</a>"""


def test_parser_takes_malformed_markup():
    page = P.parse(HTML)
    assert page.title == "A car" and len(page.links) == 3 and page.paragraphs == ["Some text"]
    assert P.parse(None).links == []


def test_next_page():
    assert P.next_page(P.parse(HTML).links, "http://x.example/list?page=2") == "http://x.example/list?page=3"
    assert P.next_page(P.parse(HTML).links, "http://x.example/list?page=9") is None


def test_cards_and_labels(spark):
    rows = spark.createDataFrame([(1, "http://x.example/list?page=2", HTML), (2, None, None)], "page_id long, url string, html string")
    cards = {r.page_id: r for r in P.cards(rows).collect()}
    assert cards[1].next_url == "http://x.example/list?page=3" and cards[1].n_external == 1 and cards[2].n_links == 0
    assert {(r.label, r.value) for r in P.labels(rows).collect()} >= {("year", "2019")}


def test_outbound_links():
    base = "https://www.portal.example/list"
    assert P.outbound("/tools/I9.html", base, "other.example") == "https://www.portal.example/tools/I9.html"
    assert P.outbound("/tools/I9.html", base, "portal.example") is None
    assert P.outbound("https://seller.example/", base, "portal.example") is None
    assert P.outbound("https://seller.example/?id=1#x", base, "portal.example") == "https://seller.example/?id=1"
    assert P.outbound("javascript:void(0)", base, "x.example") is None and P.outbound("#", base, "x.example") is None and P.outbound(None, base, "x") is None
