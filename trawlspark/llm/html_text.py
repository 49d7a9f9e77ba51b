"""The main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into block elements and runs of text. Only scripts, styles, templates, the head and what browsers never
show as text (title, textarea, iframe and the like) are silent; all else, as formulas, buttons, options or noscript, is
text that the trees decide about. Trees learnt from pages that are made up here, of many layouts
and with known parts, give each node the odds that it holds article text: by densities of its subtree, tokens of its
attributes, depth, place, and what its siblings and ancestors are. Then one decision is taken for the whole page: a node
is dropped with everything in it, or left open and its children decide; the best sum of odds over all such cuts wins. So
no text is kept whose ancestor is dropped, and no ancestor is kept against all that it holds.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from ..workers import map_arrow
from .shared import as_bytes

#: What follows ``<`` of a tag, up to its attributes; and attributes in which quotes are closed, with the end of the tag.
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
#: After so many tags whose quotes are never closed, a page's tags are taken to end at the next ``>`` whatever is quoted.
UNCLOSED = 8
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never read as markup, nor as text of a page; and those that are silent with all inside.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
SILENT = frozenset("head template".split())
BLOCKS = ("body", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "blockquote", "pre", "figure", "figcaption", "address", "fieldset", "legend", "details", "summary", "hr", "center", "menu", "hgroup", "search", "html", "select", "datalist", "option", "optgroup", "dialog", "noscript")
_IS_BLOCK = frozenset(BLOCKS)
#: What can be in a head: the first other tag, or text, ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript noframes template head html".split())
_GROUP = {t: k for k, g in enumerate((("nav", "menu"), ("header", "hgroup"), ("footer", "address"), ("aside",), ("form", "fieldset", "legend", "search", "select", "datalist", "option", "optgroup", "button"), ("article", "main"), ("section",), ("div", "center"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl"), ("table", "tr", "td", "th", "tbody", "thead", "tfoot"), ("blockquote", "pre"), ("figure", "figcaption"), ("body", "html"))) for t in g}
GROUPS = 18  # the last for all others
#: Elements that hold inline text: a button in one is a word of it, elsewhere it is a block of its own.
_TEXTUAL = frozenset("p li dt dd td th h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption summary".split())
#: Open elements that a start tag ends.
_ENDS = {"option": ("option",), "optgroup": ("option", "optgroup"), "select": ("select",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPE = {"option": ("select", "datalist"), "optgroup": ("select", "datalist"), "select": ("form",), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

# Words in attributes that tell parts of a page.
TOKENS = (
    frozenset("article content main post entry story body text prose richtext".split()),
    frozenset("nav navbar menu breadcrumb breadcrumbs pagination pager tabs skip toc".split()),
    frozenset("header masthead topbar brand logo banner footer copyright legal colophon bottom".split()),
    frozenset("sidebar widget aside related recommended popular trending more tags rail".split()),
    frozenset("ad ads advert advertisement sponsor sponsored promo promotion adsense affiliate".split()),
    frozenset("comment comments reply replies disqus discussion respond reactions".split()),
    frozenset("cookie cookies consent notice alert popup modal overlay gdpr subscribe newsletter signup paywall message warning".split()),
    frozenset("share social follow login search form byline meta author date toolbar tools".split()),
)


#: Bytes of pages that are looked at together.
TOGETHER = 1 << 22


class Page:
    """Nodes of a page in document order: elements and, where ``text`` isn't None, runs of text."""

    def __init__(self, source: str):
        self.parent, self.depth, self.group, self.own, self.above = [-1], [0], [16], [0], [0]
        self.text: list[str | None] = [None]
        self.linked = [0]
        self.end = [0]
        self._parse(source)
        self.end = [end or len(self.parent) for end in self.end]

    def _add(self, parent: int, group: int, own: int, text: str | None, linked: int = 0) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.group.append(group)
        self.own.append(own)
        self.above.append(self.above[parent] | self.own[parent] | 1 << (8 + self.group[parent]))
        self.text.append(text)
        self.linked.append(linked)
        self.end.append(0 if text is None else len(self.parent))
        return len(self.parent) - 1

    def _parse(self, source: str) -> None:
        """One pass; what is open is looked up by tag, so that no tag costs a search of the stack or of the page."""
        stack: list[tuple[str, int]] = [("html", 0)]
        places: dict[str, list[int]] = {}  # for each tag where it is on the stack
        pieces: list[str] = []
        linked, links = 0, 0
        quiet: list[str] = []  # open elements of SILENT
        at, unclosed, last = 0, 0, source.rfind(">")

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                pieces.clear()
                if text:
                    holder = stack[-1][1]
                    self._add(holder, self.group[holder], 0, text, min(linked, len(text)))
            linked = 0

        def close(tag: str, scope: tuple[str, ...] = ()) -> None:
            if not places.get(tag) or any(places.get(s) and places[s][-1] > places[tag][-1] for s in scope):
                return
            flush()
            for _ in range(len(stack) - places[tag][-1]):
                name, node = stack.pop()
                places[name].pop()
                self.end[node] = len(self.parent)

        def say(piece: str) -> None:
            nonlocal linked
            if quiet and quiet[-1] == "head" and piece.strip():
                quiet.pop()
            if piece and not quiet:
                if "&" in piece:
                    piece = html.unescape(piece)
                pieces.append(piece)
                if links:
                    linked += len(piece.strip())

        while True:
            begin = source.find("<", at)
            while 0 <= begin < last and not (source[begin + 1] in "!?" or _TAG.match(source, begin + 1)):
                begin = source.find("<", begin + 1)
            if not 0 <= begin < last and not (begin >= 0 and source.startswith("<!--", begin)):
                say(source[at:])
                break
            say(source[at:begin])
            if source[begin + 1] in "!?":
                comment = source.startswith("<!--", begin)
                at = source.find("-->" if comment else ">", begin + (4 if comment else 1))
                at = len(source) if at < 0 else at + (3 if comment else 1)
                continue
            name = _TAG.match(source, begin + 1)
            end = _QUOTED.match(source, name.end()) if unclosed < UNCLOSED else None
            unclosed += end is None
            at = end.end() if end else source.find(">", name.end()) + 1
            tag, ending, attributes = name[2].lower(), name[1], source[name.end() : at]
            if quiet:
                if tag == "body":
                    quiet.clear()
                elif quiet[-1] == "head" and (tag in ("html", "br") if ending else tag not in _IN_HEAD):
                    quiet.pop()
            if tag in RAW:
                if not ending:
                    over = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                    at = source.find(">", over.end()) + 1 if over else 0
                    at = at or len(source)
                continue
            if tag in SILENT:
                if ending:  # what is open inside it ends too: only templates are inside of anything silent
                    while quiet and quiet.pop() != tag:
                        pass
                elif not attributes.endswith("/>") and (tag != "head" or not quiet):
                    quiet.append(tag)
                continue
            if quiet:
                continue
            block = tag in _IS_BLOCK or (tag == "button" and (bool(places.get(tag)) if ending else stack[-1][0] not in _TEXTUAL and not "".join(pieces[-1:]).strip()))
            if block:
                if ending:
                    close(tag)
                    continue
                flush()
                if tag in ("html", "body"):
                    continue
                for other in _ENDS.get(tag, ()):
                    close(other, _SCOPE[tag])
                if stack[-1][0] == "p" or tag == "p":
                    close("p", ("table",))
                own = 1 << 6 if tag == "dialog" else 0
                if attributes and attributes != ">":
                    for found in _ATTRIBUTE.finditer(attributes):
                        words = set(_TOKEN.findall((found[1] or found[2] or found[3] or "").lower()))
                        for k, known in enumerate(TOKENS):
                            if words & known:
                                own |= 1 << k
                    if _HIDDEN.search(attributes):
                        own |= 1 << 4
                if tag not in VOID:
                    places.setdefault(tag, []).append(len(stack))
                    stack.append((tag, self._add(stack[-1][1], _GROUP.get(tag, 17), own, None)))
                    links = 0
            elif tag == "br":
                pieces.append(" ")
            elif tag == "a":
                links = 0 if ending else 1
        flush()


def _features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parents, ends of subtrees, first node of each page): one row for each node of all pages."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate([[0], np.cumsum(sizes)])
    base = np.repeat(first[:-1], sizes)
    cat = lambda name: np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])
    parent, depth, group, own, above, linked = (cat(x) for x in ("parent", "depth", "group", "own", "above", "linked"))
    top = parent < 0
    parent = np.where(top, np.arange(len(parent)), parent + base)
    texts = [t for p in pages for t in p.text]
    run = np.array([t is not None for t in texts])
    chars = np.array([len(t) if t else 0 for t in texts])
    words = np.array([t.count(" ") + 1 if t else 0 for t in texts])
    marks = np.array([t.count(",") + t.count(".") if t else 0 for t in texts])
    n = len(parent)
    end = cat("end") + base  # nodes are in document order: a subtree is a range

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[end] - total[np.arange(n)]

    s_chars, s_linked, s_words, s_marks, s_runs = (below(x) for x in (chars, linked, words, marks, run))
    s_paragraphs, s_tags = below((group == 8) & ~run), below(~run)
    page_chars = np.maximum(s_chars[base], 1)
    order = np.lexsort((np.arange(n), parent))
    order = order[~top[order]]
    sibling = np.zeros(n, np.int64)
    starts = np.r_[True, parent[order][1:] != parent[order][:-1]] if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    sibling[order] = place
    siblings = np.bincount(parent[~top], minlength=n)[parent] * ~top
    before, after = np.zeros(n), np.zeros(n)
    if len(order) > 1:
        a, b = order[:-1][~starts[1:]], order[1:][~starts[1:]]
        before[b], after[a] = s_chars[a], s_chars[b]
    text_before = np.concatenate([[0], np.cumsum(chars)])[np.arange(n)]
    text_before = (text_before - text_before[base]) / page_chars
    flagged = ~run & ((own & 0b11111110 > 0) | (group < 5))
    heads, articles = below((group == 9) & ~run), below((group == 5) & ~run)
    share = s_chars / page_chars
    # the nearest flagged element that holds a node, itself included, and the smallest one's share of the page
    near, flags, least = [-1] * n, [0] * n, [2.0] * n
    for v, (up, f, x) in enumerate(zip(parent.tolist(), flagged.tolist(), share.tolist(), strict=True)):
        if up != v:
            near[v], flags[v], least[v] = near[up], flags[up], least[up]
        if f:
            near[v], flags[v], least[v] = v, flags[v] + 1, min(least[v], x)
    held = np.array(near)
    some, at = held >= 0, np.maximum(held, 0)
    holder = lambda x, none: np.where(some, x[at], none)
    around = [
        holder(share, 2.0), np.array(least), np.array(flags), holder(depth, -1), depth - holder(depth, -1), holder(heads, -1), holder(articles, -1), holder(np.log1p(s_paragraphs), -1),
        holder(s_linked / np.maximum(s_chars, 1), 2.0), holder(s_tags, -1), holder(below(flagged), -1), s_chars / np.maximum(holder(s_chars, page_chars), 1),
    ]
    columns = [*around, run, *((group == g) for g in range(GROUPS)), *((own >> k & 1) for k in range(len(TOKENS))), *((above >> k & 1) for k in range(len(TOKENS)))]
    columns += [above >> (8 + g) & 1 for g in range(17)]
    parts = above | own | np.where(group < 17, 1 << (8 + group), 0)
    columns += [parts & 0b11111 << 8 > 0, parts & 0b11111110 > 0, parts & (0b11111 << 8 | 0b11111110) > 0]
    columns += [
        np.log1p(s_chars), s_linked / np.maximum(s_chars, 1), np.log1p(s_chars / np.maximum(s_tags, 1)), s_words / np.maximum(s_runs, 1), s_marks / np.maximum(s_words, 1),
        depth, sibling, siblings, sibling / np.maximum(siblings, 1), text_before, s_chars / page_chars, np.log1p(s_paragraphs), s_chars / np.maximum(s_chars[parent], 1),
        np.log1p(before), np.log1p(after), s_linked[parent] / np.maximum(s_chars[parent], 1), np.log1p(s_paragraphs[parent]),
    ]
    return np.column_stack([np.asarray(c, np.float32) for c in columns]), parent, end, first


class Trees:
    """Gradient-boosted trees of one depth for the log odds of a yes, over features in quantile bins."""

    def __init__(self, rounds: int = 70, depth: int = 4, rate: float = 0.25, bins: int = 24, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])
        size = self.bins + 1
        self.start = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
        odds = np.full(n, self.start)
        inner, leaves = (1 << self.depth) - 1, 1 << self.depth
        self.feature = np.zeros((self.rounds, inner), np.int64)
        self.limit = np.full((self.rounds, inner), np.inf, np.float32)
        self.leaf = np.zeros((self.rounds, leaves))
        for r in range(self.rounds):
            p = 1 / (1 + np.exp(-odds))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(n, np.int64)
            for d in range(self.depth):
                k = 1 << d
                key = ((node[:, None] * width + np.arange(width)) * size + binned).ravel()
                gs, hs = (np.bincount(key, np.repeat(v, width), k * width * size).reshape(k, width, size).cumsum(2) for v in (g, h))
                gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < self.least) | (ht - hs < self.least)] = 0
                best = gain.reshape(k, -1).argmax(1)
                feature, place = best // size, best % size
                first = k - 1
                for i in range(k):
                    if gain[i, feature[i], place[i]] > 1e-6 and place[i] < len(cuts[feature[i]]):
                        self.feature[r, first + i], self.limit[r, first + i] = feature[i], cuts[feature[i]][place[i]]
                node = 2 * node + (x[np.arange(n), self.feature[r, first + node]] > self.limit[r, first + node])
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            self.leaf[r] = self.rate * gs / (hs + 1)
            odds += self.leaf[r][node]
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        odds, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            odds += leaf[node - len(feature)]
        return odds


# --- pages to learn from -------------------------------------------------------------------------------------------


#: First and last letters of alphabets that made-up words are drawn from.
_ALPHABETS = (("a", "z"), ("a", "z"), ("a", "z"), ("à", "ö"), ("а", "я"), ("α", "ω"), ("ぁ", "ん"), ("一", "龥"), ("ا", "ي"))


class _Maker:
    """Makes pages with known parts, in the ways that site builders, blogs, forums, papers and hand-written pages mark
    them. Article text holds the mark ``@`` in each run, nothing else does."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.letters = "etaoinshr"

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(self.letters, k=r.randint(1, 11))) + (r.choice(",.;:") if r.random() < 0.12 else "") for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize()

    def inline(self, text: str) -> str:
        tag = self.r.choice(("b", "i", "em", "strong", "span", "code", "small", "q", "sup", "font", "mark", "u", "math", "button", "abbr", "time"))
        return f"<{tag}>{text}</{tag}>" if self.r.random() < 0.9 else f"<{tag}>{text}"

    def prose(self, low: int = 3, high: int = 90) -> str:
        r = self.r
        text = "@" + self.words(low, max(low, high // r.choice((6, 30))) if r.random() < 0.35 else high)
        for _ in range(r.choice((0, 0, 0, 1, 1, 3))):
            extra = self.words(1, 6)
            text += " " + (f'<a href="/{extra[:4]}">{extra}</a>' if r.random() < 0.5 else self.inline(extra)) + " " + self.words(1, 12)
        if r.random() < 0.12:
            text = self.inline(text)
        return text.replace(". ", ".<br> ", 1) if r.random() < 0.08 else text

    def wrap(self, tag: str, tokens: tuple[str, ...], body: str) -> str:
        r, mode = self.r, self.r.random()
        if mode < 0.25 and tag not in ("div", "section", "ul", "td", "p"):
            return f"<{tag}>{body}</{tag}>"
        name = r.choice(tokens) if tokens else r.choice(("", "row", "inner", "c1 u-2", "block", "x9f", "col-md-8", "grid__cell"))
        if r.random() < 0.3 and name:
            name += r.choice(("-box", "-area", " x1", "-wrap", "_inner", "-2", " clearfix", "__list"))
        quote = r.choice(('"', '"', '"', "'", ""))
        attribute = f" {r.choice(('class', 'class', 'id'))}={quote}{name if quote else name.split(' ')[0]}{quote}" if name else ""
        return f"<{tag}{attribute}{r.choice(('', '', ' data-x=1', ' style=margin:0'))}>{body}</{tag}>"

    def link_list(self, low: int = 3, high: int = 12) -> str:
        links = [f'<a href="/{k}">{self.words(1, 4)}</a>' for k in range(self.r.randint(low, high))]
        style = self.r.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}" + self.r.choice(("</li>", "</li>", "")) for x in links) + "</ul>"
        return self.r.choice((" | ", " &middot; ", " ", "<br>", " &gt; ")).join(links) if style < 0.85 else "".join(f"<div>{x}</div>" for x in links)

    def junk(self, kind: str) -> str:
        r = self.r
        sentence = lambda low=2, high=16: self.words(low, high)
        paragraphs = lambda n, high=30: "".join(f"<p>{sentence(2, high)}</p>" for _ in range(r.randint(1, n)))
        if kind == "nav":
            return self.wrap(r.choice(("nav", "nav", "div", "ul")), ("nav", "menu", "navbar", "main-menu", "breadcrumbs", "pagination"), self.link_list())
        if kind == "header":
            title = r.choice((f"<h1>{sentence(1, 5)}</h1>", f"<div>{sentence(1, 4)}</div>", f"<h2>{sentence(1, 4)}</h2><p>{sentence(2, 9)}</p>", f'<a href="/">{sentence(1, 3)}</a>'))
            return self.wrap(r.choice(("header", "header", "div")), ("header", "masthead", "site-header", "topbar", "logo"), title + r.choice(("", self.link_list(2, 6), "<button>=</button>")))
        if kind == "footer":
            body = r.choice((f"&copy; site &middot; {sentence()}", f"<p>{sentence()}</p>", self.link_list(2, 8) + f"<p>{sentence()}</p>", f"<address>{sentence()}</address>"))
            return self.wrap(r.choice(("footer", "footer", "div")), ("footer", "site-footer", "copyright", "legal"), body)
        if kind == "sidebar":
            body = "".join(r.choice((f"<h3>{sentence(1, 4)}</h3>" + self.link_list(), f"<h3>{sentence(1, 3)}</h3>" + paragraphs(3), paragraphs(2))) for _ in range(r.randint(1, 3)))
            return self.wrap(r.choice(("aside", "aside", "div", "section")), ("sidebar", "widget", "related", "rail", "aside", "popular", "more-posts", "tags"), body)
        if kind == "ad":
            body = r.choice((sentence(3, 25), paragraphs(2, 25), f'<a href="/b">{sentence(2, 9)}</a>', f"<div>{sentence(2, 14)}</div>", f"<noscript>{sentence(1, 9)}</noscript>"))
            return self.wrap(r.choice(("div", "div", "aside", "section")), ("ad", "ads", "advert", "advertisement", "sponsored", "promo"), body)
        if kind == "notice":
            body = r.choice((sentence(4, 30), paragraphs(2), f"<p>{sentence(4, 20)}</p><button>ok</button>"))
            if r.random() < 0.25:
                return r.choice((f"<dialog open>{body}</dialog>", f"<noscript>{sentence(3, 14)}</noscript>", f'<div role="alert">{body}</div>'))
            return self.wrap(r.choice(("div", "div", "section")), ("cookie-notice", "notice", "alert", "consent", "popup", "newsletter", "subscribe", "modal"), body)
        if kind == "form":
            options = "".join(f"<option>{sentence(1, 3)}" + r.choice(("</option>", "")) for _ in range(r.randint(2, 9)))
            fields = "".join(r.choice((f"<label>{sentence(1, 3)}</label><input name=a>", f"<select>{options}</select>", "<textarea>t</textarea>")) for _ in range(r.randint(1, 4)))
            if r.random() < 0.2:
                return r.choice((f"<select>{options}</select>", f"<button>{sentence(1, 3)}</button>", f"<datalist>{options}</datalist>"))
            return self.wrap("form", ("search", "login", "signup", "form"), r.choice((fields, f"<p>{sentence(2, 14)}</p>" + fields + "<button>ok</button>")))
        if kind == "comments":
            one = lambda: self.wrap(r.choice(("div", "li", "article")), ("comment", "comment-body", "reply"), r.choice((paragraphs(3, 60), sentence(3, 40), f"<b>{sentence(1, 2)}</b>" + paragraphs(2, 40))))
            body = f"<h3>{sentence(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 6)))
            return self.wrap(r.choice(("section", "div", "div", "ol")), ("comments", "comment-list", "discussion", "replies", "respond"), body)
        return self.wrap(r.choice(("div", "ul", "p")), ("share", "social", "breadcrumb", "byline", "meta", "tags", "toolbar"), r.choice((self.link_list(2, 5), sentence(1, 7), f"<button>{sentence(1, 2)}</button>" * 2)))

    def block(self) -> str:
        r, kind = self.r, self.r.random()
        if kind < 0.6:
            return f"<p>{self.prose(1)}" + r.choice(("</p>", "</p>", "</p>", ""))
        if kind < 0.68:
            return (f"<h2>@{self.words(1, 7)}</h2>", f"<h3>@{self.words(1, 7)}</h3>", f"<h4><a name=x>@{self.words(1, 5)}</a></h4>")[r.randrange(3)]
        if kind < 0.76:
            return r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f"<li>{self.prose(2, 20)}" + r.choice(("</li>", "")) for _ in range(r.randint(2, 6))))
        if kind < 0.8:
            return self.wrap("blockquote", ("quote", ""), r.choice((self.prose(3, 40), f"<p>{self.prose(3, 40)}</p>")))
        if kind < 0.84:
            return self.wrap("div", (), self.prose())
        if kind < 0.88:
            cells = "".join("<tr>" + "".join(f"<{t}>@{self.words(1, 5)}</{t}>" for t in ("th", "td", "td")) + "</tr>" for _ in range(r.randint(1, 5)))
            return f"<table>{r.choice(('', f'<caption>@{self.words(1, 6)}</caption>'))}{cells}</table>"
        if kind < 0.91:
            return f"<pre><code>@{self.words(3, 30)}</code></pre>"
        if kind < 0.94:
            return f"<figure><img src=x><figcaption>@{self.words(2, 14)}</figcaption></figure>"
        if kind < 0.97:
            return "<dl>" + "".join(f"<dt>@{self.words(1, 3)}<dd>{self.prose(2, 20)}" for _ in range(r.randint(1, 4))) + "</dl>"
        return f"<details><summary>@{self.words(1, 5)}</summary><p>{self.prose()}</p></details>" if kind < 0.985 else f"<noscript><p>{self.prose()}</p></noscript>"

    def article(self) -> str:
        r = self.r
        title = r.choice((f"<h1>@{self.words(2, 12)}</h1>", f"<h1>@{self.words(2, 12)}</h1>", f"<h2>@{self.words(2, 12)}</h2>", f"<header><h1>@{self.words(2, 9)}</h1></header>"))
        parts = [title] if r.random() < 0.85 else []
        if r.random() < 0.2:
            return "".join(parts) + "".join(f"<p>{self.prose(1, 12)}</p>" for _ in range(r.randint(1, 2)))
        if r.random() < 0.06:  # text and line breaks, without paragraphs
            return "".join(parts) + "<br><br>".join([self.prose(9, 90), *(self.words(9, 90) for _ in range(r.randint(0, 6)))])
        for _ in range(1 if r.random() < 0.25 else r.randint(1, 14)):
            parts.append(self.block() if r.random() < 0.93 else self.junk(r.choice(("ad", "ad", "share", "notice", "sidebar", "form"))))
        return "".join(parts)

    def flagged_wrap(self, body: str) -> str:
        """A box round the page, or most of it, that says what the page has, not what the box is; or a form round it."""
        r = self.r
        if r.random() < 0.35:
            return f'<form {r.choice(("id=aspnetForm", "name=f1 method=post", "class=page-form", "id=form1", ""))} action="/x"><div><input type=hidden name=v></div>{body}</form>'
        word = r.choice(sorted(w for known in TOKENS[1:] for w in known))
        extra = r.choice(("open", "enabled", "free", "left", "right", "layout", "active", "on", "page", "closed", "visible", "wide", "fixed", "1", "default", "style"))
        name = r.choice((f"has-{word}", f"no-{word}", f"with-{word}", f"{word}-{extra}", f"{word}-{extra}", f"main-{word}-{extra}", f"page-{word}-{extra}", f"{word}_{extra}", f"is-{word}", word))
        other = r.choice(("layout", "page", "post", "story", "wrap", "site", "body", "", "", "container"))
        names = f"{other} {name}" if r.random() < 0.5 else f"{name} {other}"
        return f"<{r.choice(('div', 'div', 'div', 'section', 'main', 'article'))} {r.choice(('class', 'class', 'id'))}=\"{names.strip()}\">{body}</div>"

    def linked_article(self) -> str:
        """An article of links, or of a list, with a heading."""
        r = self.r
        link = lambda low, high: f'<a href="/{self.words(1, 1)[:4]}">@{self.words(low, high)}</a>'
        title = f"<h1>@{self.words(2, 9)}</h1>"
        if r.random() < 0.55:
            return title + "".join(f"<p>{link(6, 40)}</p>" for _ in range(r.randint(2, 10)))
        items = "".join(f"<li>{r.choice((self.prose(3, 25), link(5, 20), self.prose(5, 40)))}</li>" for _ in range(r.randint(3, 12)))
        return title + r.choice(("", f"<p>{self.prose(3, 20)}</p>")) + r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format(items)

    def page(self) -> str:
        r = self.r
        first, last = r.choice(_ALPHABETS)
        self.letters = "".join(chr(r.randint(ord(first), ord(last))) for _ in range(24))
        body = self.linked_article() if r.random() < 0.1 else self.article()
        if r.random() < 0.08:
            body = self.flagged_wrap(body)
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td", ""))
        if tag:
            body = self.wrap(tag, ("content", "post", "entry-content", "article-body", "story", "main", "post-body") if r.random() < 0.7 else (), body)
            body = f"<table><tr>{body}</tr></table>" if tag == "td" else body
        front = [self.junk(k) for k, often in (("header", 0.5), ("nav", 0.7), ("notice", 0.35), ("ad", 0.5), ("share", 0.3), ("form", 0.15)) if r.random() < often]
        back = [self.junk(k) for k, often in (("comments", 0.4), ("sidebar", 0.4), ("ad", 0.4), ("form", 0.3), ("share", 0.3), ("notice", 0.3), ("nav", 0.15), ("footer", 0.75)) if r.random() < often]
        r.shuffle(front)
        if r.random() < 0.1:  # a table for layout
            cell = lambda name, x: f"<td{r.choice((f' class={name}', f' id={name}', f' class={name}', ''))} width=100>{x}</td>"
            bar = cell("header", r.choice((f"<b>{self.words(1, 4)}</b>", self.words(1, 5), f"<h1>{self.words(1, 4)}</h1>", f"<a href=/>{self.words(1, 3)}</a>")))
            side = cell("menu", r.choice(("<br>", " ")).join(f"<a href={k}>{self.words(1, 3)}</a>" for k in range(r.randint(2, 7))))
            body = f"<table width=100%><tr>{bar}</tr><tr>{r.choice((side, ''))}{cell('content', body)}{r.choice((side, '', ''))}</tr></table>"
        for _ in range(r.choice((0, 0, 0, 1, 1, 2, 3))):
            body = self.wrap("div", ("wrapper", "container", "page", "main", "layout", "row"), "".join(front) + body + "".join(back[:2]))
            front, back = [], back[2:]
            if r.random() < 0.2:
                body = self.flagged_wrap(body)
        if r.random() < 0.15:
            body = f"<main>{body}</main>"
        if r.random() < 0.3:
            body, front, back = self.flagged_wrap("".join(front) + body + "".join(back)), [], []
            if r.random() < 0.3:
                body = self.flagged_wrap(body)
        start = r.choice(("<!DOCTYPE html><html><head><title>t</title></head><body>", "<html><head><meta charset=utf-8><title>t</title><body>", "<title>t</title>", "<HTML><BODY>"))
        return f"{start}{''.join(front)}{body}{''.join(back)}" + r.choice(("</body></html>", "</body></html>", ""))


@lru_cache(maxsize=2)
def trained(pages: int = 1100, seed: int = 5) -> Trees:
    """Trees learnt from made-up pages; the same for the same numbers."""
    maker = _Maker(seed)
    made = [Page(maker.page()) for _ in range(pages)]
    kept = np.array([t is not None and "@" in t for p in made for t in p.text])
    for p in made:
        p.text = [t and t.replace("@", "") for t in p.text]
    x, _, end, _ = _features(made)
    total = np.concatenate([[0], np.cumsum(kept)])
    holds = total[end] - total[np.arange(len(kept))] > 0
    return Trees().fit(x, holds.astype(float), np.ones(len(x)))


def _decode(odds: np.ndarray, parent: np.ndarray, page: Page, first: int) -> list[str]:
    """The runs that the best cut of the tree leaves open."""
    n = len(page.parent)
    own = [float(o) * (len(t) ** 0.5 if t else 1.0) for o, t in zip(odds, page.text, strict=True)]
    total, opened = own[:], own[:]
    for v in range(n - 1, 0, -1):
        up = page.parent[v]
        total[up] += total[v]
        opened[up] += max(opened[v], -total[v])
    live = [True] * n
    for v in range(1, n):
        live[v] = live[page.parent[v]] and opened[v] > -total[v]
    return [t for t, keep in zip(page.text, live, strict=True) if t is not None and keep]


def main_texts(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page: blocks in page order, one to a line."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x, parent, _, first = _features(pages)
    odds = trees(x)
    return ["\n".join(_decode(odds[a:b], parent[a:b], p, a)) for p, a, b in zip(pages, first, first[1:], strict=False)]


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Reads page_id, url and html; other columns are ignored. Null and empty pages, and pages without an article, have an
    empty text. Nothing is capped: pages of any length and depth are read whole, in time that grows as their length.
    Repeated rows repeat; an empty table gives no rows. The trees are learnt on the driver if none are given.
    """
    import pyarrow as pa

    trees = trees or trained()
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sources, size = [], 0
                for source in as_bytes(batch.column("html").slice(at, 64)):
                    sources.append(source.decode())
                    size += len(source)
                    if size > TOGETHER:
                        break
                some = batch.slice(at, len(sources))
                at += len(sources)
                texts = main_texts(sources, trees)
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return map_arrow(pages.select("page_id", "url", "html"), read, schema)
