"""Main text of web pages, with templates of a site removed.

Each page is parsed once into its element subtrees. A subtree's hash is made
of its tag, class and what it holds; Spark counts, per host, in how many
different pages a subtree occurs, and subtrees on at least SHARE of a host's
pages (MIN_PAGES at least) are that site's template and are deleted, inside an
article as well. Pages whose marked text (in `article` or `main`) is the same
are copies of one article and count as one page, so copies delete nothing;
where templates hold over half of a page's marked text, as among near copies
of an article, its marked text stays whole.

All blocks inside `main` or `article` are kept. Text outside is left out where
the page has a `main`, or where its articles hold most of its remaining text.
Elements that say
themselves that they are navigation, header, footer, sidebar, notice, advert,
form, script, style or comments go in either case.

Blocks are split at block elements (a `br` is white space); character
references are decoded, white space inside a block becomes one space, blocks
are joined by a line feed. Null and empty pages give an empty text. A null or
unreadable url is a host of its own (""). Rows that are alike count as one page
of their host and are all returned.
"""

from __future__ import annotations

import re
from html import unescape

import xxhash
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import batches
from plotwise.session import stage

SHARE, MIN_PAGES = 0.5, 5

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "input", "svg", "math", "canvas", "object", "audio", "video", "template", "dialog", "menu", "map", "datalist", "option", "label", "fieldset", "menuitem"} | RAW
ROLES = {"banner", "navigation", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status"}
#: Words of a class or id that name what an element is for.
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "disqus", "respond", "replies", "reply", "discussion", "share", "sharing", "social", "related", "recommended", "widget", "disclaimer", "copyright", "skip", "form"}
KEPT = {"html", "body", "main"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    __slots__ = ("tag", "dropped", "mark", "name", "parts", "blocks")

    def __init__(self, tag: str, dropped: bool, mark: int, name: str, blocks: int):
        self.tag, self.dropped, self.mark, self.name, self.parts, self.blocks = tag, dropped, mark, name, [], blocks


def purpose(tag: str, attrs: dict[str, str], inside: int) -> bool:
    """Does the element say that it is no part of the main text?"""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return tag not in KEPT
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if tag in KEPT:
        return False
    words = set(re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
    if tag == "article":
        return bool(words & {"comment", "comments", "reply", "ad", "ads", "advert", "promo", "sponsored", "related"})
    return bool(words & WORDS) or "header" in words and not inside and tag == "div" or attrs.get("role", "").lower() in ROLES


def parse(html: str) -> tuple[list[tuple[str, int, tuple[int, ...]]], bytes]:
    """Blocks of a page as (text, mark, hashes of the subtrees around it), and the page's hash.

    mark is 1 inside a main element plus 2 inside an article.
    """
    root = Node("", False, 0, "", 0)
    stack, blocks, line = [root], [], []
    pending: list[list] = []  # blocks still waiting for the hashes of open elements

    def flush():
        if line:
            text = " ".join(unescape("".join(line)).split())
            line.clear()
            if text:
                pending.append([text, stack[-1].mark, []])

    def close():
        node = stack.pop()
        h = xxhash.xxh64_digest(node.name.encode("utf-8", "replace") + b"".join(node.parts))
        stack[-1].parts.append(h)
        value = int.from_bytes(h, "big", signed=True)
        for b in pending[node.blocks :]:
            b[2].append(value)

    def text(data: str):
        if data:
            stack[-1].parts.append(xxhash.xxh64_digest(" ".join(data.split()).encode("utf-8", "replace")))
            if not stack[-1].dropped:
                line.append(data)

    at, raw = 0, None
    while True:
        if raw:
            end = re.compile(rf"</{re.escape(raw)}\s*>", re.I).search(html, at)
            at, raw = end.end() if end else len(html), None
            close()
            continue
        m = TOKEN.search(html, at)
        text(html[at : m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        tag, attributes, closing = (m[2] or m[5] or "").lower(), m[3] or m[6] or "", m[1] or m[4]
        if not tag:
            continue
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "wbr"):
            line.append(" " if tag == "br" else "")
        if closing:
            if any(n.tag == tag for n in stack[1:]):
                if tag not in BLOCKS and any(n.tag in BLOCKS for n in stack[[n.tag for n in stack].index(tag) :]):
                    continue  # an inline end tag does not close blocks
                while stack[-1].tag != tag:
                    flush()
                    close()
                close()
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and any(n.tag == "p" for n in stack):
            k = max(i for i, n in enumerate(stack) if n.tag == "p")
            if not any(n.tag in BLOCKS for n in stack[k + 1 :]):
                while len(stack) > k:
                    close()
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in SCOPE.get(tag, ()):
                break
            if stack[k].tag in CLOSES.get(tag, ()):
                while len(stack) > k:
                    close()
                break
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(attributes)}
        inside = stack[-1].mark
        dropped = stack[-1].dropped and not (tag in HEADINGS and inside and stack[-1].tag == "header") or purpose(tag, attrs, inside)
        here = 0 if dropped else 2 * (tag == "article") + (tag == "main" or attrs.get("role", "").lower() == "main")
        mark = inside | here
        stack.append(Node(tag, dropped, mark, f"{tag}|{attrs.get('class', '')}", len(pending)))
        if tag in RAW:
            raw = tag
    flush()
    while len(stack) > 1:
        close()
    blocks = [(t, m, tuple(h)) for t, m, h in pending]
    return blocks, xxhash.xxh64_digest(b"".join(root.parts))


def content(blocks, template=frozenset()) -> str:
    """The blocks of main and article, or all where these hold too little; templates are left out."""
    size = lambda some: sum(len(t) for t, *_ in some)
    rest = [b for b in blocks if not template.intersection(b[2])]
    if 2 * size(b for b in rest if b[1]) < size(b for b in blocks if b[1]):
        rest = [b for b in blocks if b[1] or not template.intersection(b[2])]
    own = [b for b in rest if b[1]]
    if any(m & 1 for _, m, _ in own) or 2 * size(own) > size(rest):
        rest = own
    return "\n".join(t for t, *_ in rest)


def identity(blocks, page: bytes) -> int:
    """What a page counts as: its marked text, which copies of an article share, or else the page."""
    own = "\n".join(t for t, m, _ in blocks if m)
    return int.from_bytes(xxhash.xxh64_digest(own.encode("utf-8", "replace")) if own else page, "big", signed=True)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame, share: float = SHARE, least: int = MIN_PAGES) -> DataFrame:
    """(host, subtree) of the subtrees that recur on a host's pages; pages need host and html."""

    def run(b):
        hosts, pages_, trees = [], [], []
        for h, html in zip(b["host"].to_pylist(), b["html"].to_pylist()):
            blocks, page = parse(html or "")
            found = {t for _, _, hs in blocks for t in hs}
            hosts += [h] * len(found)
            pages_ += [identity(blocks, page)] * len(found)
            trees += found
        return {"host": hosts, "page": pages_, "subtree": trees}

    seen = stage(batches(pages.select("host", "html"), run, "host string, page long, subtree long").distinct(), "html-subtrees")
    total = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    return seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).join(total, "host").where((F.col("n") >= least) & (F.col("n") >= share * F.col("pages"))).select("host", "subtree")


def extract(pages: DataFrame, share: float = SHARE, least: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for every row."""
    rows = pages.select("page_id", "url", "html").withColumn("host", host(F.col("url")))
    found = stage(templates(rows, share, least), "html-templates")

    def plain(b):
        text = [content(parse(h or "")[0]) for h in b["html"].to_pylist()]
        return {"page_id": b["page_id"], "url": b["url"], "text": text}

    if found.isEmpty():  # no site has a template: nothing to match, one pass over the pages
        done = batches(rows.select("page_id", "url", "html"), plain, "page_id long, url string, text string")
    else:
        key = F.xxhash64("page_id", "url", "html")
        rows = rows.withColumn("_key", key)

        def trees(b):
            keys, hosts, out = [], [], []
            for k, h, html in zip(b["_key"].to_pylist(), b["host"].to_pylist(), b["html"].to_pylist()):
                blocks, _ = parse(html or "")
                found_ = {t for _, _, hs in blocks for t in hs}
                keys += [k] * len(found_)
                hosts += [h] * len(found_)
                out += found_
            return {"_key": keys, "host": hosts, "subtree": out}

        held = batches(rows.select("_key", "host", "html"), trees, "_key long, host string, subtree long").join(found, ["host", "subtree"], "left_semi")
        per = held.groupBy("_key").agg(F.collect_set("subtree").alias("template"))

        def pruned(b):
            text = [content(parse(h or "")[0], frozenset(t or ())) for h, t in zip(b["html"].to_pylist(), b["template"].to_pylist())]
            return {"page_id": b["page_id"], "url": b["url"], "text": text}

        done = batches(rows.join(per, "_key", "left").select("page_id", "url", "html", "template"), pruned, "page_id long, url string, text string")
    return done.withColumn("n_chars", F.length("text").cast("long"))
