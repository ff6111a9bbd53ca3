"""Periodic runs, main texts and spelling variants against brute force and known answers."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import main_text, queries, runs, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Periodic runs


def plain_runs(s, exponent=4, least=6):
    out = []
    for q in range(1, len(s) // exponent + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, exponent * q) and not any(q % p == 0 and s[i : i + size - p] == s[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_all_periods():
    dice = random.Random(5)
    for _ in range(1500):
        k = dice.randint(1, 4)
        s = [dice.randrange(k) for _ in range(dice.randint(0, 60))]
        for _ in range(dice.randint(0, 3)):
            u = [dice.randrange(k) for _ in range(dice.randint(1, 7))]
            s += u * dice.randint(1, 9) + u[: dice.randint(0, len(u))] + [dice.randrange(k) for _ in range(dice.randint(0, 9))]
        assert [tuple(r) for r in runs.maximal_runs(np.array(s, np.int64)).tolist()] == plain_runs(s)


def test_runs_of_one_word_and_of_a_long_period():
    assert runs.maximal_runs(np.zeros(100_000, np.int64)).tolist() == [[0, 100_000, 1]]
    assert runs.maximal_runs(np.arange(30_000) % 7).tolist() == [[0, 30_000, 7]]
    assert runs.maximal_runs(np.arange(30_000)).tolist() == []


def plain_digest(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words) if n < 3000 else [tuple(r) for r in runs.maximal_runs(np.unique(np.array(words), return_inverse=True)[1]).tolist()]
    dropped = {i for start, size, q in found for i in range(start + q, start + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)),
        digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_op11(spark, odd, small):
    docs = odd.unionByName(spark.read.parquet(f"{small}/documents.parquet"), allowMissingColumns=True)
    looped = [(7_000 + i, " ".join((f"a{i} b c " * i + "x " * i).split())) for i in range(1, 12)]
    docs = docs.unionByName(spark.createDataFrame(looped, "doc_id long, text string"), allowMissingColumns=True)
    got = runs.digests(docs).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    expected = [plain_digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, got)) == Counter(expected)
    assert sum(1 for r in expected if r[1]) > 20
    assert runs.digests(docs.limit(0)).count() == 0


def test_runs_in_small_blocks(spark, odd):
    a = runs.periodic_runs(odd, block=1).select("doc_id", "n_words", "collapsed").collect()
    assert Counter(map(tuple, a)) == Counter(map(tuple, runs.periodic_runs(odd).select("doc_id", "n_words", "collapsed").collect()))


# Main text

LONG = " ".join(["Lorem ipsum dolor sit amet consectetur"] * 8)
PAGES = [
    (f'<html><body><header><h1>Site</h1><nav><a href=x>a</a></nav></header><div id="content"><h2>Title</h2><p>{LONG}</p><p>Be.</p><p>{LONG}</p><div class="comments"><p>{LONG}</p></div></div><div class="sidebar"><p>{LONG}</p></div><footer>x</footer></body>', f"Title {LONG} Be. {LONG}"),
    ("<body><div>Buy now our very great product cheap</div><article><h1>T</h1><p>Short.</p></article><div><a href=1>One</a><a href=2>Two</a><a href=3>Three</a></div></body>", "T Short."),
    ("<body><form id=aspnetForm><div class=menu><a>x</a></div><article><header><h1>T</h1></header><p>A&amp;B &lt;x&gt; f<b>o</b>o&nbsp;bar<br>next</p><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table><form><input value=q><button>Go</button></form></article></form>", "T A&B <x> foo bar next one two c1 c2"),
    ("plain text & more", "plain text & more"),
    ('<p>One<p>Two<script>if(a<b){"</p>"}</script><p>Three<!-- c > --><style>x</style>', "One Two Three"),
    (f'<body><div class="post"><div class="entry-header"><h1>Hello</h1></div><p>{LONG}</p></div><div class="widget"><p>{LONG} {LONG}</p></div><div id="cookie-notice">{LONG}</div></body>', f"Hello {LONG}"),
    (f'<main><h1>A</h1><p>x y z</p><section id="comments"><article class="comment"><p>{LONG}</p></article></section><aside>q</aside></main>', "A x y z"),
    ("<body><nav>only</nav></body>", ""),
    ('<p title="a>b">ok</p><p title="broken>text</p><p>more</p>', "ok text more"),
    ("<p>abc</p><foot", "abc"),
    ("a < b <3", "a < b <3"),
    ("<p><b>x<br><p>y</b></p> \t\n z", "x y z"),
    (f"<div><h2>One</h2><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div><div><a href=1>{LONG}</a></div>", f"One {LONG} {LONG} {LONG}"),
    (f'<div class="has-sidebar"><p>{LONG}</p><div class="Advert-Box2">buy</div><p hidden>no</p><p style="display: none">no</p></div>', LONG),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert main_text.main_text(page or "") == text


def test_odd_pages_end_soon():
    for page in ("<div>" * 50_000, '<a "' * 50_000, '<a href="x>' * 50_000, "<b>" * 50_000 + "<p>x</p>" * 500, "<p><span>" * 30_000 + "</p>" * 30_000, "<!--" * 50_000, "<script>" * 50_000, "<i></p>" * 30_000):
        main_text.main_text(page)


def test_density_lowers_links():
    plain, linked = main_text.composite(400, 4, 0, 0, 0.2), main_text.composite(400, 4, 350, 4, 0.2)
    assert plain > 5 * linked and main_text.composite(0, 3, 0, 0, 0.2) == 0 and main_text.composite(100, 4, 0, 0, 0.0) == 25


def test_op12(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r.page_id: r for r in queries.op12_html_extraction(spark, small).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        text = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


def test_extract_odd_tables(spark):
    rows = spark.createDataFrame([(1, "u", "<p>x</p>", "t", "r", 1), (None, None, None, None, None, None), (1, "u", "<p>x</p>", "t", "r", 1)], "page_id long, url string, html string, text string, row string, `a b:c` int")
    got = main_text.extract(rows)
    assert got.columns == ["page_id", "url", "row", "a b:c", "text", "n_chars"]
    assert Counter(map(tuple, got.collect())) == Counter({(1, "u", "r", 1, "x", 1): 2, (None, None, None, None, "", 0): 1})
    assert main_text.extract(rows.limit(0)).count() == 0
    assert main_text.extract(rows.select("html")).count() == 3


# Spelling variants


def plain_variants(words):
    near, rings = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            if less in words:
                near[w].add(less), near[less].add(w)
            rings[i, less].add(w)
    for ring in rings.values():
        for w in ring:
            near[w] |= ring - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best
    out = Counter()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None] += 1
    return out


def plain_vocabulary(rows):
    total = Counter()
    for doc, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{doc}:{w}".encode())
            total[w if h % 97 or doc is None else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_op13(spark, odd, small):
    docs = odd.unionByName(spark.read.parquet(f"{small}/documents.parquet"), allowMissingColumns=True)
    got = spelling.variants(spelling.vocabulary(docs, typos=True)).select(*COLUMNS).collect()
    expected = plain_variants(plain_vocabulary([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    assert Counter(map(tuple, got)) == expected and any(k[1] for k in expected)


def test_variants_of_few_letters_in_blocks(spark):
    """Words of two letters are near in many ways at once; lists are cut into blocks and dealt to many groups."""
    dice = random.Random(3)
    words = {"".join(dice.choice("abà") for _ in range(dice.randint(5, 8))): dice.randint(3, 500) for _ in range(900)}
    words |= {"a" * k: 3 * k for k in range(5, 40)} | {"a" * 400: 5, "a" * 401: 50, "a" * 200 + "b" + "a" * 200: 500}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    for hot, rows in ((1 << 16, 1 << 18), (50, 100)):
        near = spelling.near_words(table, hot=hot, rows=rows)
        assert near.count() == near.select("word").distinct().count()
        got = Counter((r.word, r.n_near) for r in near.collect())
        assert got == Counter({(k[0], k[4]): 1 for k in plain_variants(words) if k[4]})
    assert Counter(map(tuple, spelling.variants(table).select(*COLUMNS).collect())) == plain_variants(words)
    assert spelling.variants(table.limit(0)).count() == 0
