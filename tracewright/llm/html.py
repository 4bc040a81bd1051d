"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element and each run of text is a binary variable (content or not). Node potentials are a logistic function of
tags, class words and text shape; parent-child potentials are tables by kind of child. Sum-product messages go up and
down the tree and give exact marginals; runs whose marginal is over one half are the main text.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash32, lowest, table

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose text is never page text; they don't cut the block around them. A button within words is part of them.
SKIP = frozenset("script style noscript template head svg iframe object audio video canvas select button textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
#: A formula is part of the text around it.
INLINE |= frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction semantics annotation annotation-xml".split())
#: Start tags that leave an open head open; any other, or text, ends it.
HEAD = frozenset("html head base basefont bgsound link meta title style script noscript template".split())
#: A start tag of these ends an open p; li, dt/dd, tr, td/th and option end an open one of their own.
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOP = frozenset("ul ol dl table tbody thead div article section main body td th".split())
# Words of class, id and role attributes, by group.
WORDS = {
    "ad": "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted outbrain taboola",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager skip topbar links toolbar",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending more teaser teasers tags tagcloud",
    "foot": "footer foot copyright colophon legal bottom",
    "head": "header masthead logo branding top site-header hero-nav",
    "note": "cookie cookies consent notice notices alert gdpr popup modal overlay toast paywall disclaimer banner-notice dialog warning",
    "form": "form login signin signup register search subscribe subscription newsletter contact poll",
    "talk": "comment comments commentlist reply replies respond disqus discussion reviews review-list responses",
    "share": "share sharing social follow like likes byline meta author date",
    "main": "article content post entry main story body text page-content articlebody prose markdown primary maincontent",
    "hide": "hidden sr-only visually-hidden screen-reader invisible offscreen",
}
GROUP = {w: g for g, ws in WORDS.items() for w in ws.split()}
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: What ends a tag, or begins a quoted value in it.
IN_TAG = re.compile(r">|=[\x20\x09-\x0D]*([\"'])")
ATTR = re.compile(r"""([a-zA-Z:_-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


class Scanner:
    """The tags of a page, one after the other, in time linear in its length: a search that fails isn't tried again."""

    def __init__(self, page: str):
        self.page, self.missing, self.plain = page, {}, False

    def find(self, what: str, at: int) -> int:
        """Where `what` is next, or -1."""
        if at >= self.missing.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def end_of_tag(self, at: int) -> int:
        """Where a tag's > stands, quoted values aside; -1 if the page ends before."""
        while m := IN_TAG.search(self.page, at):
            if not m[1]:
                return m.start()
            close = self.find(m[1], m.end())
            at = close + 1 if close >= 0 else m.end()
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """(begin, end, "" or "/" or "?" or "<", name, attributes) of the next piece of markup from `at` on.

        "?" is a comment, CDATA section or declaration; "<" one that is text; begin is the page's end if there is none.
        """
        page, n = self.page, len(self.page)
        begin = self.find("<", at)
        if begin < 0:
            return n, n, "", "", ""
        for opens, closes, bare in (("<!--", "-->", True), ("<![CDATA[", "]]>", False), ("<!", ">", False), ("<?", ">", False)):
            if page.startswith(opens, begin):
                close = self.find(closes, begin + len(opens) - (opens == "<!--") * 2)
                if close >= 0:
                    return begin, close + len(closes), "?", "", ""
                if bare:
                    return begin, n, "?", "", ""
        m = NAME.match(page, begin)
        close = self.end_of_tag(m.end()) if m and not self.plain else -1
        if m and close < 0:
            # quotes that swallow the rest of the page are no quotes, here and from here on
            self.plain, close = True, self.find(">", m.end())
        if close < 0:
            return begin, begin + 1, "<", "", ""
        return begin, close + 1, m[1], m[2].lower(), page[m.end() : close]


class Node:
    __slots__ = ("attrs", "label", "link", "linked", "paras", "parent", "tag", "text", "titled", "total")

    def __init__(self, tag: str, parent: int, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.text, self.link, self.label, self.total, self.linked, self.paras, self.titled = "", 0, None, 0, 0, 0, False


def dom(page: str) -> list[Node]:
    """Block elements and text runs (tag "#") in page order; a parent stands before its children."""
    nodes = [Node("html", -1)]
    # open elements, each with the index of its block (inline ones keep that around them), whether its text is skipped and
    # whether its end cuts the text
    stack: list[tuple[str, int, bool, bool]] = [("html", 0, False, True)]
    run: list[tuple[str, bool]] = []
    skip, links, at, n = 0, 0, 0, len(page)

    scan, opened = Scanner(page), {"html": 1}  # how many of each tag are open

    def flush() -> None:
        if run:
            text = " ".join(entities.unescape("".join(t for t, _ in run)).split())
            if text:
                leaf = Node("#", stack[-1][1])
                leaf.text = text
                leaf.link = sum(len(t.strip()) for t, in_link in run if in_link)
                nodes.append(leaf)
            run.clear()

    def push(tag: str, block: int, skips: bool = False, cuts: bool = False) -> None:
        stack.append((tag, block, skips, cuts))
        opened[tag] = opened.get(tag, 0) + 1

    def close(k: int) -> None:
        """Close all open elements from the k-th on."""
        nonlocal links, skip
        if any(cuts for *_, cuts in stack[k:]):
            flush()
        for t, _, skips, _ in stack[k:]:
            links -= t == "a"
            skip -= skips
            opened[t] -= 1
        del stack[k:]

    while at < n:
        begin, end, what, tag, attrs = scan.next(at)
        if stack[-1][0] == "head" and page[at:begin].strip():
            close(len(stack) - 1)
        if begin > at and not skip:
            run.append((page[at:begin], links > 0))
        at = end
        if not tag:
            if what == "<" and not skip:
                run.append(("&lt;", links > 0))
            continue
        if what:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k][0] == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if stack[-1][0] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in ("html", "body"):
            continue
        if tag == "br":
            if not skip:
                run.append((" ", False))
            continue
        if tag in CLOSES_P or tag in OWN:
            ends = OWN.get(tag, ("p",))
            for k in range(len(stack) - 1, 0, -1) if any(opened.get(t) for t in ends) else ():
                if stack[k][0] in ends and (tag != "tr" or stack[k][0] == "tr"):
                    close(k)
                    break
                if stack[k][0] in STOP and not (tag == "tr" and stack[k][0] in ("td", "th")):
                    break
        if not skip and tag not in INLINE and (tag not in SKIP or tag == "head"):
            flush()
        if tag in RAW_END and tag != "template":
            stop = RAW_END[tag].search(page, at)
            at = stop.end() if stop else n
            continue
        if tag in VOID or attrs.endswith("/") and tag not in INLINE and tag not in CLOSES_P:
            continue
        if tag in INLINE:
            push(tag, stack[-1][1])
            links += tag == "a"
        elif not skip and tag not in SKIP:
            nodes.append(Node(tag, stack[-1][1], attrs))
            push(tag, len(nodes) - 1, cuts=True)
        else:
            skips = tag in SKIP and not (tag == "button" and any(t.strip() for t, _ in run))
            push(tag, stack[-1][1], skips, tag == "head")
            skip += skips
    close(1)
    flush()
    add_sums(nodes)
    return nodes


TAGS = "html div section article main nav header footer aside form fieldset ul ol li dl dt dd table tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details center #".split()
NAMES = ["bias", "other-tag", "hidden", *[f"t:{t}" for t in TAGS], *[f"w:{g}" for g in WORDS], *[f"len{i}" for i in range(5)], *[f"link{i}" for i in range(4)], *[f"sum-len{i}" for i in range(6)], *[f"sum-link{i}" for i in range(4)], "stop", "copy", "in-p", "in-h", "in-li", "in-cell", "bare-article", "mixed", "titled", *[f"paras{i}" for i in range(3)], *[f"part{i}" for i in range(4)]]
INDEX = {x: i for i, x in enumerate(NAMES)}
KINDS = {t: i for i, t in enumerate(["#", "p", "li", "ul", "ol", "h1", "h2", "td", "div", "section", "article", "main", "other", "marked", "mixed"])}
_MARK = re.compile(r"©|\(c\) ?\d{4}|all rights reserved", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_groups: dict[str, tuple[str, ...]] = {}


def groups(attrs: str) -> tuple[str, ...]:
    """Word groups of an element's class, id and role; hidden elements have "hidden"."""
    if not attrs or attrs.isspace():
        return ()
    got = _groups.get(attrs)
    if got is None:
        found = set()
        for k, v in ATTR.findall(attrs):
            k, v = k.lower(), v.strip("\"'").lower()
            if k in ("class", "id", "role"):
                found.update(GROUP[w] for w in {*_SPLIT.split(v), *v.split()} if w in GROUP)
            elif k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and "display:none" in v.replace(" ", ""):
                found.add("hidden")
        got = tuple(sorted(found))
        if len(_groups) > 50_000:
            _groups.clear()
        _groups[attrs] = got
    return got


def add_sums(nodes: list[Node]) -> None:
    """Characters, link characters, paragraphs and whether there is an h1 under each element."""
    for x in nodes:
        x.total, x.linked = (len(x.text), x.link) if x.tag == "#" else (0, 0)
        x.paras, x.titled = int(x.tag == "p"), x.tag == "h1"
    for x in reversed(nodes[1:]):
        up = nodes[x.parent]
        up.total += x.total
        up.linked += x.linked
        up.paras += x.paras
        up.titled = up.titled or x.titled


def _share(link: int, n: int) -> int:
    share = link / n if n else 0
    return 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3


def features(nodes: list[Node], i: int) -> list[int]:
    """Numbers of the features of node i that are on; add_sums comes first."""
    x = nodes[i]
    out = [0, INDEX.get(f"t:{x.tag}", 1)]
    if x.tag != "#":
        out += [INDEX["sum-len0"] + min(5, int(math.log(x.total + 1, 5))), INDEX["sum-link0"] + _share(x.linked, x.total)]
        said, share = groups(x.attrs), x.total / (nodes[0].total or 1)
        out += [INDEX["paras0"] + min(2, x.paras), INDEX["part0"] + (share > 0.1) + (share > 0.3) + (share > 0.6)]
        if x.titled:
            out.append(INDEX["titled"])
        if x.tag == "article" and not said:
            out.append(INDEX["bare-article"])
        if len(said) > 1 and "main" in said:
            out.append(INDEX["mixed"])
        return out + [INDEX["hidden" if g == "hidden" else f"w:{g}"] for g in said]
    n, parent = len(x.text), nodes[x.parent].tag
    out.append(INDEX["len0"] + min(4, int(math.log(n + 1, 5))))
    out.append(INDEX["link0"] + _share(x.link, n))
    if x.text[-1] in ".!?:;”\"":
        out.append(INDEX["stop"])
    if _MARK.search(x.text):
        out.append(INDEX["copy"])
    if parent in ("p", "li"):
        out.append(INDEX[f"in-{parent}"])
    elif parent in ("td", "th"):
        out.append(INDEX["in-cell"])
    elif parent[0] == "h" and parent[1:].isdigit():
        out.append(INDEX["in-h"])
    return out


def kind(x: Node) -> int:
    said = groups(x.attrs) if x.tag != "#" else ()
    if any(g != "main" for g in said):
        return KINDS["mixed" if "main" in said else "marked"]
    return KINDS.get(x.tag, KINDS["other"])


class Model:
    """weights of node features; log potentials [kind of child][parent state][child state]."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights.tolist(), pairs.tolist()

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content per node: messages to the parents, then back to the children."""
        n = len(nodes)
        w, own = self.weights, [0.0] * n
        for i in range(n):
            own[i] = sum([w[f] for f in features(nodes, i)])
        up, told, psi = own[:], [0.0] * n, [self.pairs[kind(x)] for x in nodes]
        # up[i]: log odds from i's subtree; told[i]: the log odds that i's message gives its parent
        for i in range(n - 1, 0, -1):
            a, b, u = psi[i][0], psi[i][1], up[i]
            told[i] = _add(b[0], b[1] + u) - _add(a[0], a[1] + u)
            up[nodes[i].parent] += told[i]
        belief = up[:]
        for i in range(1, n):
            rest = belief[nodes[i].parent] - told[i]
            a, b = psi[i][0], psi[i][1]
            belief[i] = up[i] + _add(a[1], b[1] + rest) - _add(a[0], b[0] + rest)
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in belief]


def _add(x: float, y: float) -> float:
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


def main_text(page: str, model: Model) -> str:
    nodes = dom(page)
    return "\n".join([x.text for x, p in zip(nodes, model.marginals(nodes), strict=True) if x.tag == "#" and p > 0.5])


def labelled_pages(n: int = 600, seed: int = 11) -> list[str]:
    """Pages of several layouts, drawn from rules: elements say data-y="1" (content) or "0", and their subtrees follow.

    Articles hold tables, lists of links and boxes in boxes; their classes, and those of what isn't content, can mislead.
    """
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ra", "ne", "to", "li", "sun", "mar", "ke", "do", "vi", "pal")) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    prose = lambda a, b: " ".join(words(3, 14).capitalize() + r.choice("....?!") for _ in range(r.randint(a, b)))
    link = lambda a=1, b=3: f'<a href="/{word()}">{words(a, b)}</a>'
    items = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"
    teaser = lambda: r.choice((f"<h3>{link(2, 6)}</h3><p>{prose(1, 2)}</p>", f"<h4>{words(2, 6)}</h4><p>{prose(1, 3)} {link(1, 2)}</p>", f"<a href='/{word()}'><h3>{words(2, 6)}</h3></a>"))
    teasers = lambda k: "".join(r.choice(('<article class="teaser">{}</article>', '<div class="card">{}</div>')).format(teaser()) for _ in range(k))
    bad = {
        "menu": lambda: r.choice(('<nav data-y="0">{}</nav>', '<div class="menu" data-y="0">{}</div>', '<div id="nav" data-y="0">{}</div>', '<ul class="breadcrumbs" data-y="0">{}</ul>', '<div data-y="0">{}</div>')).format(items(r.randint(3, 8))),
        "head": lambda: r.choice(('<header data-y="0">{}</header>', '<div class="site-header" id="masthead" data-y="0">{}</div>', '<div class="header" data-y="0">{}</div>')).format(r.choice(("<h2>{}</h2>", "<h2>{}</h2>", "<h1>{}</h1>", "<h1><a href='/'>{}</a></h1>")).format(words(1, 4)) + f"<p>{words(2, 8)}</p>" + items(r.randint(0, 4))),
        "foot": lambda: r.choice(('<footer data-y="0">{}</footer>', '<div id="footer" data-y="0">{}</div>', '<div class="copyright" data-y="0">{}</div>')).format(r.choice((f"&copy; {word()}.com &middot; {prose(1, 2)}", f"<p>{prose(1, 3)}</p><p>Copyright 20{r.randint(10, 24)} {words(1, 3)}</p>", items(4) + f"<p>{words(2, 9)}</p>"))),
        "side": lambda: r.choice(('<aside data-y="0">{}</aside>', '<div class="sidebar" data-y="0">{}</div>', '<div class="related widget" data-y="0">{}</div>', '<section class="recommended" data-y="0">{}</section>')).format(f"<h3>{words(1, 3)}</h3>" + r.choice((items(5), f"<p>{prose(1, 3)}</p>", f"<p>{words(3, 9)}</p>{items(2)}", teasers(r.randint(1, 3))))),
        "ad": lambda: r.choice(('<div class="ad" data-y="0">{}</div>', '<div class="advert banner" data-y="0">{}</div>', '<div id="sponsored-{0}" data-y="0">{0}</div>', '<section class="promo" data-y="0">{}</section>', '<div class="ads" data-y="0">{}</div>')).format(r.choice((prose(1, 3), words(2, 7), f"<p>{prose(1, 2)}</p>"))),
        "note": lambda: r.choice(('<div class="cookie-notice" data-y="0">{}</div>', '<div id="consent" data-y="0">{}</div>', '<div class="notice alert" data-y="0">{}</div>', '<div role="dialog" data-y="0">{}</div>')).format(f"<p>{prose(1, 4)}</p>"),
        "form": lambda: r.choice(('<form data-y="0">{}</form>', '<form class="newsletter" data-y="0"><p>{}</p></form>', '<div class="login subscribe" data-y="0">{}</div>', '<form id="search" data-y="0"><label>{}</label></form>')).format(r.choice((words(1, 6), prose(1, 2))) + ' <input name="q">'),
        "talk": lambda: r.choice(('<section class="comments" data-y="0">{}</section>', '<div id="comments" data-y="0">{}</div>', '<ol class="commentlist" data-y="0">{}</ol>', '<div class="discussion" data-y="0">{}</div>')).format(f"<h3>{words(1, 3)}</h3>" + "".join(r.choice(('<div class="comment"><p>{}</p></div>', '<li class="comment">{}</li>', '<article class="comment"><p>{}</p></article>', "<p>{}</p>")).format(prose(1, 5)) for _ in range(r.randint(1, 5)))),
        "share": lambda: r.choice(('<div class="share" data-y="0">{}</div>', '<ul class="social" data-y="0">{}</ul>')).format("".join(f"<li>{link(1, 2)}</li>" for _ in range(3))),
        "hide": lambda: f'<div style="display:none" data-y="0"><p>{prose(1, 3)}</p></div>',
    }
    topic = lambda: r.choice(("article", "content", "post", "entry", "story", "main", "body", "text"))
    stray = lambda: r.choice(("promoted", "promo", "sponsored", "related", "more", "header", "side", "sidebar", "top", "banner", "meta", "notice", "share", "comments", "contact", "legal", "widget", "date"))
    said = lambda a, b: r.choice(("{0} {1}-{0}", "{0}-{1}", "has-{1} {0}", "{1}-{0}", "{0} {1}")).format(a, b)
    row = lambda k, t: "<tr>" + "".join(f"<{t}>{r.choice((words(1, 4), str(r.randint(1, 9999)), link(1, 2)) if t == 'td' else (words(1, 2),))}</{t}>" for _ in range(k)) + "</tr>"
    grid = lambda k: f"<table><thead>{row(k, 'th')}</thead><tbody>" + "".join(row(k, "td") for _ in range(r.randint(2, 8))) + "</tbody></table>" if r.random() < 0.5 else "<table>" + row(k, "th") + "".join(row(k, "td") for _ in range(r.randint(1, 6))) + "</table>"
    linked = lambda bare: "<li>" + (link(1, 6) if bare else r.choice((link(1, 3) + " " + words(1, 8), words(1, 5) + " " + link()))) + "</li>"
    listed = lambda bare: "".join(linked(bare) for _ in range(r.randint(2, 9)))
    rich = (
        lambda: grid(r.randint(2, 5)),
        lambda: r.choice(("", f"<p>{words(2, 8)}:</p>", f"<h2>{words(1, 4)}</h2>")) + r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format(listed(r.random() < 0.6)),
        lambda: "<dl>" + "".join(f"<dt>{words(1, 3)}</dt><dd>{prose(1, 2)}</dd>" for _ in range(r.randint(1, 5))) + "</dl>",
        lambda: f"<div>{prose(1, 5)}</div>",
        lambda: f"<div>{words(1, 6)}</div>",
        lambda: f"<div><div><p>{prose(1, 5)}</p></div><p>{prose(1, 3)}</p></div>",
        lambda: f"<section><h2>{words(1, 6)}</h2><p>{prose(1, 5)}</p><p>{prose(1, 4)}</p></section>",
        lambda: f"<p>{prose(1, 2)} <span>{words(1, 3)}<div>{words(1, 7)}</div></span> {words(2, 6)}</p>",
        lambda: f"<p>{words(2, 8)} <button>{words(1, 2)}</button> {words(2, 6)}.</p>",
        lambda: f"<p class='{topic()}-{r.choice(('lead', 'p', 'intro'))}'>{prose(1, 5)}</p>",
        lambda: f"<div class='{topic()}'><p>{prose(1, 5)}</p><p>{prose(1, 5)}</p></div>",
        lambda: f"<p>{link(2, 8)}</p>",
        lambda: f"<ul>{listed(True)}</ul>",
        lambda: f"<p>{prose(1, 2)}</p><ul>{listed(True)}</ul><p>{prose(1, 2)}</p>",
        lambda: f"<p>{r.choice((words(1, 2), prose(1, 1)))}</p>" * r.randint(20, 200),
        lambda: f"<p>{words(1, 3).capitalize()}.</p>" * r.randint(100, 400),
        lambda: f"{words(2, 9).capitalize()}.",
    )
    astray = lambda: r.choice(("<div class='{c}' data-y='0'>{x}</div>", "<section class='{c}' data-y='0'>{x}</section>", "<aside class='{c}' data-y='0'>{x}</aside>")).format(c=said(topic(), r.choice(("ad", "share", "comments", "related", "footer", "newsletter", "tags", "promo", "cookie", "sidebar"))), x=r.choice((items(r.randint(2, 6)), f"<p>{prose(1, 2)}</p>", words(2, 8), teaser(), f"<table>{row(2, 'td')}</table>")))
    menus = lambda: f"<table data-y='0'><tr>" + "".join(f"<td>{link()}</td>" for _ in range(r.randint(3, 8))) + "</tr></table>"  # noqa: E731, F541
    wraps = ("<article data-y='1'>{}</article>",) * 4 + ("<article class='post' data-y='1'>{}</article>", "<main data-y='1'>{}</main>", "<div class='content' data-y='1'>{}</div>", "<div class='post' data-y='1'><div class='entry-content'>{}</div></div>", "<div id='article-body' data-y='1'>{}</div>", "<section class='story' data-y='1'>{}</section>", "<div role='main' data-y='1'>{}</div>", "<table><tr><td class='text' data-y='1'>{}</td></tr></table>", "<div data-y='1'>{}</div>", "<main><article data-y='1'>{}</article></main>")
    pages = []
    for _ in range(n):
        para = lambda: r.choice((f"<p>{prose(1, 9)}</p>",) * 6 + (f"<p>{prose(1, 1)[:12]}.</p>", f"<p>{word().capitalize()}.</p>", f"<p><b>{prose(1, 6)}<br>", f"<p>{prose(1, 4)} {link()} {prose(1, 3)}</p>", f"<h2>{words(2, 6)}</h2>", f"<ul><li>{prose(1, 1)}</li><li>{words(3, 9)}</li></ul>", f"<blockquote>{prose(1, 3)}</blockquote>", f"<pre>{words(4, 20)}</pre>", f"<figure><img><figcaption>{words(3, 9)}</figcaption></figure>"))
        parts = [r.choice(("<h1>{}</h1>",) * 6 + ("<h2>{}</h2>", "<header><h1>{}</h1></header>")).format(words(2, 9)), *[para() for _ in range(r.randint(0, r.choice((3, 12))))]]
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            parts.insert(r.randint(1, len(parts)), r.choice(rich)())
        for k in r.sample(("ad", "share", "talk", "side", "form", "note", "hide"), r.randint(0, 3)):
            parts.insert(len(parts) if k == "talk" else r.randint(1, len(parts)), astray() if r.random() < 0.2 else bad[k]())
        before = "".join(bad[k]() for k in r.sample(("menu", "head", "ad", "note", "form"), r.randint(0, 4)))
        after = "".join(bad[k]() for k in r.sample(("side", "talk", "ad", "foot", "note", "form", "menu"), r.randint(0, 5)))
        before, after = before + (menus() if r.random() < 0.1 else ""), (astray() if r.random() < 0.2 else "") + after
        wrap = r.choice(wraps)
        if r.random() < 0.25:
            tag = r.choice(("article", "article", "div", "section", "main"))
            wrap = f"<{tag} class='{said(topic(), stray())}' data-y='1'>{{}}</{tag}>"
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 5)}</title></head><body>{before}{wrap.format(''.join(parts))}{after}</body></html>")
    return pages


BOXES = frozenset("aside nav header footer form".split())


def labelled(page: str) -> list[Node]:
    """A page's nodes with labels from data-y; a box of both kinds is content."""
    nodes = dom(page)
    for x in nodes:
        said = re.search(r"""data-y=["']([01])""", x.attrs)
        x.attrs = re.sub(r"""\s*data-y=["'][01]["']""", "", x.attrs)
        x.label = int(said[1]) if said else nodes[x.parent].label if x.parent >= 0 else 0
    return _lean(nodes)


def weakly_labelled(page: str) -> list[Node] | None:
    """A page's nodes, content if they are in its one article that lies in no side box; None if there isn't just one."""
    nodes = dom(page)
    apart = [False] * len(nodes)
    for i, x in enumerate(nodes):
        apart[i] = x.parent >= 0 and (apart[x.parent] or nodes[x.parent].tag == "article") or x.tag in BOXES or x.tag != "#" and any(g != "main" for g in groups(x.attrs))
        x.label = int(x.tag == "article" and not apart[i])
    if sum(x.label for x in nodes) != 1:
        return None
    for x in nodes[1:]:
        x.label = x.label or nodes[x.parent].label
    return _lean(nodes)


def _lean(nodes: list[Node]) -> list[Node]:
    """An outer box that holds content leans to content, its own text aside."""
    for x in reversed(nodes):
        if x.parent >= 0 and x.label and x.tag != "#":
            nodes[x.parent].label = 1
    return nodes


def train(pages: list[list[Node]], steps: int = 300, decay: float = 2e-5) -> Model:
    """Node weights and pair potentials of greatest likelihood of all labels together, less a penalty of `decay`.

    The likelihood's slope is what the labels hold of each feature and pair less what the marginals do, which are those
    of `Model.marginals`, computed for all pages at once from depth to depth.
    """
    on, kinds, parents, y, depth = [], [], [], [], []
    for nodes in pages:
        base = len(kinds)
        for i, x in enumerate(nodes):
            on.append(features(nodes, i))
            kinds.append(kind(x))
            parents.append(base + max(0, x.parent))
            depth.append(depth[parents[-1]] + 1 if i else 0)
            y.append(x.label)
    n, width = len(y), max(map(len, on))
    f = np.array([o + [len(NAMES)] * (width - len(o)) for o in on])
    kinds, parents, y, depth = np.array(kinds), np.array(parents), np.array(y), np.array(depth)
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    below = np.concatenate(levels)
    cell = kinds[below] * 4
    flat, cells = f.ravel(), (cell[:, None] + np.arange(4)).ravel()
    held = np.bincount(cell + y[parents[below]] * 2 + y[below], minlength=4 * len(KINDS))
    v, speed, size = (np.zeros(len(NAMES) + 4 * len(KINDS)) for _ in range(3))
    for t in range(1, steps + 1):
        w, pairs = np.append(v[: len(NAMES)], 0.0), v[len(NAMES) :].reshape(-1, 2, 2)
        up, told = w[f].sum(1), np.zeros(n)
        for i in reversed(levels):
            p, u = pairs[kinds[i]], up[i]
            told[i] = np.logaddexp(p[:, 1, 0], p[:, 1, 1] + u) - np.logaddexp(p[:, 0, 0], p[:, 0, 1] + u)
            up += np.bincount(parents[i], told[i], n)
        belief = up.copy()
        for i in levels:
            p, rest = pairs[kinds[i]], belief[parents[i]] - told[i]
            belief[i] = up[i] + np.logaddexp(p[:, 0, 1], p[:, 1, 1] + rest) - np.logaddexp(p[:, 0, 0], p[:, 1, 0] + rest)
        rest = belief[parents[below]] - told[below]
        joint = pairs[kinds[below]] + up[below][:, None, None] * [0, 1] + rest[:, None, None] * [[0], [1]]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
        off = 1 / (1 + np.exp(-np.clip(belief, -500, 500))) - y
        slope = np.append(np.bincount(flat, np.repeat(off, width), len(NAMES) + 1)[:-1], np.bincount(cells, joint.ravel(), 4 * len(KINDS)) - held) / n + decay * v
        speed, size = 0.9 * speed + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        v = v - 0.1 * speed / (1 - 0.9**t) / (np.sqrt(size / (1 - 0.99**t)) + 1e-6)
    return Model(v[: len(NAMES)], v[len(NAMES) :].reshape(-1, 2, 2))


#: Of all pages one in HELD never trains, so that extraction can be measured on it.
HELD = 5


def held_out(key: str = "page_id") -> Column:
    return hash32(F.lit("held"), F.col(key)) % HELD == 0


def train_on(pages: DataFrame, most: int = 400, longest: int = 1 << 18) -> Model:
    """A model from the drawn layouts and, as weakly labelled pages, at most `most` rows that mark their article.

    Longer pages than `longest` bytes don't train, so that what the driver gets is bounded.
    """
    pages = pages.where(F.octet_length("html") <= longest)
    ids = lowest(pages.where("html like '%<article%'").where(~held_out()).select(F.col("page_id").cast("long").alias("page_id")), most)
    # at most `most` ids, so safe to broadcast; of rows that repeat one, one is taken
    near = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").join(F.broadcast(ids), "page_id", "left_semi").where("html like '%<article%'")
    own = [weakly_labelled(r["html"]) for r in near.groupBy("page_id").agg(F.max("html").alias("html")).orderBy("page_id").select("html").collect()]
    return train([labelled(p) for p in labelled_pages()] + [x for x in own if x])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html). One narrow pass, no shuffle.

    Null, empty and tag-less input: the text that the model keeps, else the empty string. Broken markup never fails: open
    elements end with the page. Repeated rows give repeated results. Other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                text = [main_text(h, model) if isinstance(h, str) else "" for h in part["html"]]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train_on(pages))
