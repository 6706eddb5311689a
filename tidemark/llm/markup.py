"""Raw HTML as a list of blocks and tags, tolerant of missing and stray end tags.

A page is read once, in time proportional to its length. Inline markup is transparent; a block is the text
between two tags of block elements. Every block element has a path (a hash of its ancestors' names, classes,
ids and roles, digits aside) and a label.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import xxhash

# Element names of HTML, and names that authors give to parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = set(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    select button noscript template svg canvas object audio video summary table tbody td tfoot th thead tr ul""".split()
)
PARTS = set("aside nav footer form menu dialog search select button noscript template svg canvas object audio video head".split())
PART_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
PART_NAMES = set(
    """ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsors sponsored promo promos promotion banner
    nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination toolbar tabs toc header masthead topbar footer
    colophon copyright sidebar side rail aside widget widgets related recommended recommendations trending share sharing social
    follow subscribe subscription newsletter signup signin login register search form cookie cookies consent gdpr notice notices
    notification alert popup modal overlay lightbox disclaimer skip hidden""".split()
)
COMMENT_NAMES = set("comment comments commentlist commenter reply replies respond discussion disqus reviews".split())
MAIN_NAMES = set("article articlebody content contents post entry story main maincontent".split())
#: Elements whose start leaves an open paragraph open, and those that closing passes over.
KEEP_P = set("button svg canvas object audio video noscript template select option".split())
TEXTUAL = set("p h1 h2 h3 h4 h5 h6".split())
#: An end tag or a start tag closes open elements of these kinds that can't hold it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<=\s)(hidden)(?=[\s/]|\Z)""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

#: Labels of elements. PART and COMMENT: not of the article; NAMED: a part by a name alone, unless it holds the article.
PLAIN, NAMED, PART, COMMENT, BODY, MAIN, ARTICLE = range(7)


def label(tag: str, attrs: dict[str, str]) -> int:
    names = {x.lower() for a in ("class", "id") for x in _NAME.findall(attrs.get(a, ""))}
    role, style = attrs.get("role", "").lower(), attrs.get("style", "").replace(" ", "").lower()
    if names & COMMENT_NAMES and tag not in ("html", "body"):
        return COMMENT
    if tag in PARTS or role in PART_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style:
        return PART
    if tag in ("html", "body"):
        return PLAIN
    if names & PART_NAMES or tag == "header":
        return NAMED
    if tag == "article" or role == "article" or attrs.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    if tag == "main" or role == "main":
        return MAIN
    return BODY if names & MAIN_NAMES else PLAIN


def _described(path: int, tag: str, given: str) -> tuple[int, int]:
    """Path and label of an element, by its parent's path, its name and its attributes as written."""
    attrs = {(a[1] or a[5]).lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(given)} if given else {}
    sign = re.sub(r"\d+", "#", f"{tag} {attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}") if attrs else tag
    return xxhash.xxh64_intdigest(sign.encode("utf-8", "surrogatepass"), path) >> 1, label(tag, attrs)


#: Pages of a host repeat their elements; attributes of up to so many characters are remembered.
_SHORT = 200
_remembered = lru_cache(maxsize=16384)(_described)


class Page:
    """tags: (element, is end) and blocks: (element, words, linked words), in page order as `items`;
    elements: (parent, tag, path, label), the first is the root."""

    def __init__(self, html: str):
        self.elements: list[tuple[int, str, int, int]] = [(0, "", 0, PLAIN)]
        self.items: list[tuple] = []
        elements, items = self.elements, self.items
        stack, open_ = [0], {}
        text: list[str] = []
        link, linked, at, breaks = 0, 0, 0, 0
        search = _TAG.search

        def flush() -> None:
            nonlocal linked, breaks
            if text:
                if words := "".join(text).split():
                    items.append((stack[-1], words, min(linked, len(words))))
                text.clear()
            linked = breaks = 0

        def pop_to(k: int) -> None:
            while len(stack) > k:
                e = stack.pop()
                open_[elements[e][1]] -= 1
                items.append((e, None, True))

        def close(closed: set[str]) -> None:
            k = len(stack) - 1
            while k and (name := elements[stack[k]][1]) not in closed and name in TEXTUAL:
                k -= 1
            if k and elements[stack[k]][1] in closed:
                pop_to(k)

        while True:
            m = search(html, at)
            raw = html[at : m.start()] if m else html[at:]
            if raw:
                piece = unescape(raw) if "&" in raw else raw
                if link:
                    linked += len(piece.split())
                if breaks and not piece.isspace():
                    breaks = 0
                text.append(piece)
            if not m:
                break
            at = m.end()
            end, tag, given, end_, tag_, given_ = m.groups()
            tag = (tag or tag_ or "").lower()
            if not tag:
                continue
            end = end or end_
            if tag == "br":
                # Two in a row part blocks, one is white space.
                text.append(" ")
                breaks += 1
                if breaks == 2:
                    flush()
                continue
            if tag in RAW and not end:
                stop = _END[tag].search(html, at)
                at = stop.start() if stop else len(html)
                text.append(" " if tag == "iframe" else "")
                continue
            if tag == "a":
                link = 0 if end else 1
                continue
            if tag not in BLOCKS:
                continue
            flush()
            link = 0
            if end:
                if open_.get(tag):
                    k = len(stack) - 1
                    while elements[stack[k]][1] != tag:
                        k -= 1
                    pop_to(k)
                continue
            if open_.get("p") and tag not in KEEP_P:
                close({"p"})
            if tag in CLOSES:
                close(CLOSES[tag])
            if tag == "hr":
                continue
            parent, given = stack[-1], given or given_ or ""
            path, kind = (_remembered if len(given) <= _SHORT else _described)(elements[parent][2], tag, given)
            elements.append((parent, tag, path, kind))
            stack.append(len(elements) - 1)
            open_[tag] = open_.get(tag, 0) + 1
            items.append((stack[-1], None, False))
        flush()

    def roles(self) -> tuple[list[bool], list[bool], int]:
        """For each element whether its text is of a part beside the article, whether it is in the article's
        container, and of what kind containers are (PLAIN: the page has none)."""
        n = len(self.elements)
        own = [x[3] for x in self.elements]
        inside = [False] * n  # in what only its own name makes a part, of which an article is no child
        kind, holds = PLAIN, [False] * n
        strict = [False] * n
        for e in range(1, n):
            strict[e] = strict[self.elements[e][0]] or own[e] in (PART, COMMENT)
            if own[e] in (BODY, MAIN, ARTICLE) and not strict[e]:
                inside[e] = True
        for e in range(n - 1, 0, -1):
            if own[e] in (MAIN, ARTICLE) and not strict[e] or holds[e]:
                holds[self.elements[e][0]] = True
        part = [False] * n
        for e in range(1, n):
            p = self.elements[e][0]
            named = own[e] == NAMED and not holds[e] and not (self.elements[e][1] == "header" and self._in_article(e, own))
            part[e] = part[p] or own[e] in (PART, COMMENT) or named
            if inside[e] and not part[e]:
                kind = max(kind, own[e])
        within = [False] * n
        for e in range(1, n):
            within[e] = within[self.elements[e][0]] or bool(kind) and own[e] == kind and not part[e]
        return part, within, kind

    def _in_article(self, e: int, own: list[int]) -> bool:
        while e:
            e = self.elements[e][0]
            if own[e] in (ARTICLE, MAIN):
                return True
        return False
