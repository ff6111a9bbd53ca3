"""Main text of web pages by composite text density.

A page becomes a tree of its elements. Every node gets its characters per tag, adjusted for the characters and tags of
its links (the composite density of Sun, Song and Liao, SIGIR 2011); every block gets the sum of its children's
densities. The block of the largest sum is the main one; the least density on the path from the body to it is the
threshold, and blocks beside the path that reach it give their own block of the largest sum. What names itself an
article on the path widens the main block to the whole article. Menus, headers, footers, sidebars, notices, adverts,
forms and comments are told by their elements, roles and names; they count as parts of the page, so that they lower the
density of what holds them, but are never chosen nor given out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import bound_batches, text_or_empty

VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr keygen".split())
#: Elements whose content is text up to their end tag; all of it is dropped.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold nothing of an article.
NEVER = RAW | frozenset("head nav aside form button select option optgroup input fieldset legend datalist output noscript template svg canvas object applet audio video map dialog menu menuitem progress meter".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CELLS, ROWS, SECTIONS = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("thead", "tbody", "tfoot"))
#: A start tag closes these, when they are open, up to a border.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (CELLS, ROWS | {"table"}), "th": (CELLS, ROWS | {"table"}), "tr": (ROWS, SECTIONS | {"table"}), "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "thead": (SECTIONS, frozenset(("table",))), "tbody": (SECTIONS, frozenset(("table",))), "tfoot": (SECTIONS, frozenset(("table",))), "a": (frozenset(("a",)), frozenset(("table", "td", "th"))),
}
P_BORDER = frozenset("table td th caption button object".split())

#: Words in a class, id or role by which an element is no part of an article.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising advertorial adsense adslot adbox adunit admanager dfp doubleclick banner banners sponsor sponsors sponsored promo promos promotion promotions promoted "
    "anzeige anzeigen werbung publicite publicité pub publicidad anuncio anuncios patrocinado "
    "nav navs navbar navigation menu menus submenu topbar breadcrumb breadcrumbs pagination pager paginator paging tabs toolbar skip skiplink sitemap "
    "header masthead footer foot colophon copyright legal sidebar sidebars rail aside complementary contentinfo widget widgets "
    "cookie cookies consent gdpr ccpa notice notices notification notifications alert alerts popup popover modal overlay lightbox toast paywall subscribe subscription newsletter signup login signin register "
    "comment comments commentary commentlist commenter disqus respond reply replies discussion kommentar kommentare commentaire commentaires comentario comentarios guestbook "
    "share sharing shares social socials follow sharebar addthis related recommended recommendations recirc outbrain taboola trending popular mostread "
    "search searchbox searchform form feedback survey poll rating ratings hidden".split()
)
#: A header belongs to an article if its name begins with one of these: entry-header.
HEADING_PARTS, ARTICLE_PARTS = frozenset(("header",)), frozenset("article entry post story content chapter section".split())
#: Parts before a word that turn it round: has-sidebar says what is beside an element.
TURNED = frozenset("has with without no not is hide show".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert status tablist tooltip".split())
ARTICLES = frozenset(("main", "article"))
ARTICLE_NAMES = frozenset("article article-body article-content article-text articlebody post-body post-content entry-content story-body story-content".split())

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""")
PART = re.compile(r"[A-Z]?[a-zà-ÿ]+|[A-Z]+(?![a-z])|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
BREAK, P, NOTHING, TABLE, ITEMS = (-1, ""), ("p",), frozenset(), frozenset(("table",)), frozenset(("li", "dd", "dt"))
INSIDE_P = VOID - {"hr"} | RAW - {"xmp"} | frozenset("option optgroup button select object map svg noscript".split())
PLAIN = frozenset("p b i a em strong span div br h1 h2 h3 h4 h5 h6 ul ol li table tr td".split())
FRAME = frozenset("nav aside header footer".split())
WRAPPERS = frozenset("form div section fieldset table tbody tr td center noscript".split())
LISTS = frozenset("ul ol dl div section table td center".split())

#: A list or box is a menu if this share of its letters are links, and it has this many.
MENU_SHARE, MENU_LINKS = 2 / 3, 3
#: Named articles inside the main block stand for it if they hold this share of its letters, or if there is one, with an h1.
ARTICLE_SHARE = 1 / 4


class Tree:
    """Elements in page order, so that a subtree's follow one another. For each: parent, tag, boiler (by itself no part of
    an article), article (names itself one) and linked (inside a link); pieces are (element, text), and (-1, "") between blocks."""

    def __init__(self) -> None:
        self.parent, self.tag, self.boiler, self.article, self.linked = [-1], ["body"], [False], [False], [False]
        self.pieces: list[tuple[int, str]] = []

    def add(self, parent: int, tag: str, boiler: bool, article: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.boiler.append(boiler)
        self.article.append(article)
        self.linked.append(tag == "a" or (self.linked[parent] and tag in INLINE))
        return len(self.tag) - 1


@lru_cache(1 << 14)
def _is_boilerplate(names: str, first_only: bool = False) -> bool:
    """Whether a class or an id among these says that an element is no part of an article."""
    for name in names.split():
        parts = [p.lower() for p in PART.findall(name)]
        for k, part in enumerate(parts[:1] if first_only else parts):
            if part in BOILERPLATE and not (k and parts[k - 1] in TURNED):
                if part in HEADING_PARTS and parts[0] in ARTICLE_PARTS:
                    continue
                return True
    return False


def _attributes(text: str) -> dict[str, str]:
    """Names in lower case and values; the first of equal names counts."""
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(ATTRIBUTE.finditer(text)))} if "=" in text or text.strip(" /\n\t\r") else {}


def _judge(tag: str, attributes: dict[str, str], in_article: bool, in_quote: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it names itself an article."""
    if tag == "header":
        return not in_article, False
    if tag == "footer":
        return not in_quote, False
    if tag in NEVER:
        return True, False
    if not attributes:
        return False, tag in ARTICLES
    role, names = attributes.get("role", "").lower(), f"{attributes.get('class', '')} {attributes.get('id', '')}"
    named = tag in ARTICLES or role in ARTICLES or "articlebody" in attributes.get("itemprop", "").lower() or any(n.lower() in ARTICLE_NAMES for n in names.split())
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
        return True, False
    boiler = role in ROLES or attributes.get("aria-modal") == "true" or (tag != "main" and _is_boilerplate(names, named and not in_article))
    return boiler, named and not boiler


def parse(page: str) -> Tree:
    """The elements of a page, however badly it is nested; one pass, linear in its length.

    Unclosed elements end with what holds them, a p at the next block; end tags without a start are ignored. An
    unfinished tag or comment at the end of the page is dropped. A tag whose quotes never close ends at its first >, as
    do the tags after it.
    """
    tree = Tree()
    pieces, tags, stack, count = tree.pieces, tree.tag, [0], {"body": 1, "article": 0}
    quoted, at, size, articles = True, 0, len(page), 0

    def pop() -> None:
        nonlocal articles
        node = stack.pop()
        count[tags[node]] -= 1
        articles -= tree.article[node]
        if tags[node] not in INLINE:
            pieces.append(BREAK)

    def close(names: frozenset | tuple, border: frozenset) -> None:
        """End the innermost open element of these names, unless a border comes first."""
        for name in names:
            if count.get(name):
                break
        else:
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = tags[stack[k]]
            if tag in names:
                while len(stack) > k:
                    pop()
                return
            if tag in border:
                return

    while at < size:
        start = page.find("<", at)
        if start < 0:
            pieces.append((stack[-1], page[at:]))
            break
        if start > at:
            pieces.append((stack[-1], page[at:start]))
        found = TAG.match(page, start) if quoted else None
        if found:
            name, rest, at = found[1].lower(), found[2], found.end()
        elif named := NAME.match(page, start):
            quoted = False
            end = page.find(">", start)
            if end < 0:
                break
            name, rest, at = named[1].lower(), page[named.end() : end], end + 1
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = size if end < 0 else end + 3
            continue
        elif page.startswith(("<!", "<?", "</"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        else:
            pieces.append((stack[-1], "<"))
            at = start + 1
            continue
        if name == "html" or name == "body":
            continue
        if page[start + 1] == "/":
            if count.get(name):
                close((name,), P_BORDER if name in INLINE or name == "p" else TABLE if name in ITEMS else NOTHING)
            elif name not in INLINE or name == "br":
                pieces.append(BREAK)
            continue
        if name not in INLINE:
            if name not in INSIDE_P:
                close(P, P_BORDER)
            if name in HEADINGS and tags[stack[-1]] in HEADINGS:
                pop()
            pieces.append(BREAK)
        if name in CLOSES:
            close(*CLOSES[name])
        boiler, article = _judge(name, _attributes(rest), articles > 0, count.get("blockquote", 0) > 0) if rest or name not in PLAIN else (False, False)
        node = tree.add(stack[-1], name, boiler, article)
        if name in VOID:
            continue
        if name in RAW:
            end = RAW_END[name].search(page, at)
            shut = page.find(">", end.end()) if end else -1
            at = size if shut < 0 else shut + 1
            continue
        stack.append(node)
        count[name] = count.get(name, 0) + 1
        articles += article
    return tree


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, times how far links are from making up the node. share: of letters in links, of the whole body."""
    if not chars:
        return 0.0
    density = chars / max(1, tags)
    base = log(log(chars / max(1, chars - link_chars) * link_chars + share * chars + e))
    return density * log(max(e, chars / max(1, link_chars) * max(1, tags) / max(1, link_tags))) / base if base > 0 else density


def main_blocks(tree: Tree) -> tuple[list[bool], list[bool]]:
    """For each node: whether it is in a chosen block, and whether it is boilerplate, itself or by what holds it."""
    parent, tag, size = tree.parent, tree.tag, len(tree.tag)
    own, tags, links = [0] * size, [0] * size, [0] * size
    for node, text in tree.pieces:
        if node >= 0:
            own[node] += sum(map(len, text.split()))
    chars, link_chars, ends = own.copy(), [n if k else 0 for n, k in zip(own, tree.linked)], list(range(1, size + 1))
    holds = [a or t == "h1" for a, t in zip(tree.article, tag)]
    for k in range(size - 1, 0, -1):
        up = parent[k]
        tags[up] += tags[k] + (tag[k] not in RAW)
        links[up] += links[k] + (tag[k] == "a")
        chars[up] += chars[k]
        link_chars[up] += link_chars[k]
        ends[up] = max(ends[up], ends[k])
        holds[up] = holds[up] or (holds[k] and tag[k] not in FRAME)
    out, article = list(tree.boiler), list(tree.article)
    for k in range(1, size):
        if out[k] and holds[k] and tag[k] in WRAPPERS and 2 * chars[k] > chars[0]:
            out[k] = False  # a form or box around a whole article is its wrapper, whatever its name
        if tag[k] in LISTS and links[k] >= MENU_LINKS and link_chars[k] > MENU_SHARE * chars[k]:
            out[k] = True  # a menu without a name
        out[k] = out[k] or out[parent[k]]
        article[k] = article[k] and not out[k]
    share = link_chars[0] / chars[0] if chars[0] else 0.0
    density = [composite(*x, share) for x in zip(chars, tags, link_chars, links)]
    block = [t not in INLINE and t not in VOID and not o for t, o in zip(tag, out)]
    total, kids, loose = [0.0] * size, [0] * size, own.copy()
    for k in range(size - 1, -1, -1):
        if not block[k]:
            if k and not out[k]:
                loose[parent[k]] += loose[k]  # text in elements of a line is its block's own
            continue
        if not kids[k]:
            total[k] = density[k]  # a block of text only
        elif loose[k]:
            total[k] += composite(loose[k], 1, 0, 0, share)  # text between blocks is a child, too
        if k and block[parent[k]]:
            total[parent[k]] += density[k]
            kids[parent[k]] += 1

    def best(root: int) -> int:
        return max((k for k in range(root, ends[root]) if block[k]), key=total.__getitem__, default=root)

    chosen = [False] * size
    winner = best(0)
    if not total[winner]:
        return chosen, out
    path = [winner]
    while path[-1]:
        path.append(parent[path[-1]])
    least = min(density[k] for k in path)
    around = [k for k in path if article[k]]
    within = [] if around else [k for k in range(winner, ends[winner]) if article[k] and not article[parent[k]]]
    if around:
        path = path[path.index(around[-1]) :]
    elif not (len(within) == 1 and "h1" in tag[within[0] : ends[within[0]]]) and sum(chars[k] for k in within) < ARTICLE_SHARE * sum(n for n, o in zip(own[winner : ends[winner]], out[winner : ends[winner]]) if not o):
        within = []
    if within:
        for k in within:
            chosen[k] = len(within) == 1 or density[k] >= least
        if not any(chosen):
            chosen[max(within, key=density.__getitem__)] = True
    else:
        chosen[path[0]] = True
        on_path = set(path[1:])
        for k in range(1, size):
            if parent[k] in on_path and k not in on_path and block[k] and density[k] >= least and (article[k] or not around):
                chosen[best(k)] = True
    for k in range(1, size):
        chosen[k] = chosen[k] or chosen[parent[k]]
    return chosen, out


def main_text(page: str) -> str:
    """The text of the main blocks: character references decoded, white space inside a block turned into one space, blocks
    in page order joined by one space."""
    if not page:
        return ""
    tree = parse(page)
    tree.pieces = [(node, html.unescape(text) if "&" in text else text) for node, text in tree.pieces]
    chosen, out = main_blocks(tree)
    parts = [" " if node < 0 else text for node, text in tree.pieces if node < 0 or (chosen[node] and not out[node])]
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """All columns of pages but html_col, with text (main text, empty if there is none) and n_chars (its code points).

    Null and empty pages give an empty text. Pages may repeat or be of any length; a page is one task's work. Columns
    named text or n_chars are replaced. Nothing is shuffled; an empty table gives an empty result.
    """
    bound_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(0).alias("none")).alias("row"), text_or_empty(F.col(f"`{html_col}`")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    found = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())]))
    return found.select(*[F.col(f"row.`{c}`") for c in kept], "text", "n_chars")
