"""HTML extraction by equivalence classes: tokens that share their occurrence vector across the pages of a host
make up its template; what is left between them are slots, and the article is what its main slots hold.

1. Tokens of a page are start and end tags (told apart by their element's path), words (by the path of their
   element) and whole texts of blocks of FIXED_WORDS words or more, a role of their own. A token's occurrence vector says how often each page of the host holds it; the number
   of pages and the sum (XOR) of 64-bit hashes of (page, count) stand for it. Tokens of a host with one vector are a class.
2. A class counts if at least SUPPORT pages and SHARE of the host's pages hold it and it has two tokens or more.
   It is valid if its tokens come in one order, and it nests with the others, on all but TOLERANCE of its pages.
3. Valid classes, nested, are the template. A slot is what follows one of its tokens inside the innermost open
   class. Texts that the template itself holds on nearly all pages (FIXED) are no content.
4. Main slots of a host: where its pages mark an article (article, main or a container named so), those whose
   words are mostly inside; elsewhere those with much unlinked text, and headings. A page keeps what lies in its
   marked article, or else in main slots, without parts that its markup gives another role (markup.label).

A page of a host without template (too few pages, no host) is judged alike by its own elements as slots.

Spread: vectors are only shuffled for tokens that may be on SHARE of their host's pages. For that, pages are first
read some thousands at a time: among n pages of a host, a token on at most least(n) of them stays unsent, the others
send by how many pages they are above it. The sum of a host's least(n) and of what a token has sent bounds the pages
that it is on; a token on SHARE of them is above somewhere and so isn't lost. This is added up by host and, if that
has over _PART pages, part of its tokens, so that a group holds what _PART pages can send at most. Vectors of tokens whose bound is high
enough are added up inside batches and shuffled by (host, token), so a host with a third of all pages is split like
any other. A token of a template is on SHARE of its host's pages at least, so a template has at most 1 / SHARE times
the tokens of an average page, and is put together in one task. Templates are stored; Spark broadcasts them if their
size allows, else it splits a crowded host's pages (adaptive).

Defined cases: null html is an empty page, with text ''; null URL or none with a host: no template; very long
pages go through whole; repeated rows are pages of their own (an even number of equal ones leaves no mark in the sum, only in the number of pages); no pages: no rows; other columns are left out.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .markup import PLAIN, Page
from .urls import host_of

SUPPORT, SHARE, TOLERANCE = 3, 0.2, 0.1
#: Template text inside an article is dropped if it has this many words, pages and share of the host's pages.
FIXED_WORDS, FIXED_PAGES, FIXED_SHARE = 3, 8, 0.8
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers, mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tag_token(path: int, end: bool) -> int:
    """32 bits of the element's path, then 31 that are 1 for end tags, 0 for start tags, more for words."""
    return path >> 31 << 31 | end


def word_token(path: int, word: str) -> int:
    return path >> 31 << 31 | 2 + xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), path) % 0x7FFFFFFD


def text_token(path: int, words: list[str]) -> int:
    return word_token(path, "\n" + " ".join(words))


class Tokens(dict):
    """Tokens of one path's words, remembered."""

    def __init__(self, path: int):
        self.path = path

    def __missing__(self, word: str) -> int:
        t = self[word] = word_token(self.path, word)
        return t


#: Tokens of words by path.
Known = dict[int, Tokens]


def _tokens(known: Known, path: int) -> Tokens:
    mine = known.get(path)
    if mine is None:
        mine = known[path] = Tokens(path)
    return mine


def _forget(known: Known) -> None:
    """Empties what has become large."""
    if sum(map(len, known.values())) > _KNOWN:
        known.clear()


class Wanted(frozenset):
    """Tokens of a host that are asked for."""

    def __init__(self, tokens: list[int]):
        self.paths = {t >> 31 for t in tokens}


@lru_cache(maxsize=256)
def _wanted(blob: bytes) -> Wanted:
    return Wanted(np.frombuffer(blob, "<i8").tolist())


def present(page: Page, known: Known) -> set[int]:
    """The page's tokens."""
    found: set[int] = set()
    words_of: dict[int, set[str]] = {}
    for e, words, x in page.items:
        path = page.elements[e][2]
        if words is None:
            found.add(tag_token(path, x))
        else:
            if len(words) >= FIXED_WORDS:
                found.add(text_token(path, words))
            words_of.setdefault(path, set()).update(words)
    for path, words in words_of.items():
        found.update(map(_tokens(known, path).__getitem__, words))
    return found


def counted(page: Page, known: Known, wanted: Wanted | None = None) -> tuple[list[int], list[int], list[int]]:
    """The page's tokens (those wanted, if given), how often each occurs and how many tokens came first."""
    tags: dict[int, list[int]] = {}
    words_of: dict[int, tuple[Counter, list[int]]] = {}
    texts: dict[int, list[int]] = {}
    at = 0
    for e, words, x in page.items:
        path = page.elements[e][2]
        if words is None:
            t = tag_token(path, x)
            if t in tags:
                tags[t][0] += 1
            else:
                tags[t] = [1, at]
            at += 1
        elif wanted is not None and path >> 31 not in wanted.paths:
            at += len(words) + (len(words) >= FIXED_WORDS)
        else:
            if len(words) >= FIXED_WORDS:
                t = text_token(path, words)
                texts.setdefault(t, [0, at])[0] += 1
                at += 1
            counts, firsts = words_of.setdefault(path, (Counter(), []))
            counts.update(words)
            firsts.extend(range(at, at + len(counts) - len(firsts)))
            at += len(words)
    ids, times, orders = [], [], []
    for t, (n, first) in (*tags.items(), *texts.items()):
        if wanted is None or t in wanted:
            ids.append(t)
            times.append(n)
            orders.append(first)
    for path, (counts, firsts) in words_of.items():
        for t, n, first in zip(map(_tokens(known, path).__getitem__, counts), counts.values(), firsts):
            if wanted is None or t in wanted:
                ids.append(t)
                times.append(n)
                orders.append(first)
    return ids, times, orders


def least(pages: int) -> int:
    """On how many of so many pages of its host a token may stay unsent: fewer than SHARE of them."""
    return int(SHARE * (pages - 1))


def _halves(tokens: np.ndarray) -> bytes:
    """Sorted tokens as bytes, their high halves first, which tokens of one path share: they compress well."""
    return (tokens >> 32).astype("<i4").tobytes() + (tokens & 0xFFFFFFFF).astype("<u4").tobytes()


def _whole(blob: bytes) -> np.ndarray:
    n = len(blob) // 8
    return np.frombuffer(blob, "<i4", n).astype(np.int64) << 32 | np.frombuffer(blob, "<u4", n, 4 * n).astype(np.int64)


#: Pages of a host and the tokens that are present there, page by page.
Held = dict[int, tuple[list[int], array]]


def _above(held: Held, totals: dict[int, int]) -> pd.DataFrame:
    """By host, and part of its tokens, the least of these pages, and tokens on more of them and on how many more."""
    out = []
    for host, (pages, found) in held.items():
        low, parts = least(pages[0]), 1 + totals[host] // _PART
        tokens, on = np.unique(np.array(found, np.int64), return_counts=True)
        tokens, on = tokens[on > low], (on[on > low] - low).astype("<i4")
        part = (_mixed(tokens.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        tokens, on, ends = tokens[order], on[order], np.searchsorted(part[order], np.arange(parts + 1))
        out += [(host, i, totals[host], low, _halves(tokens[x:y]), on[x:y].tobytes()) for i, (x, y) in enumerate(zip(ends[:-1], ends[1:]))]
    return pd.DataFrame(out, columns=["host", "part", "total", "least", "tokens", "above"])


def _present(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What some pages at a time hold above the least."""
    known: Known = {}
    held: Held = {}
    totals: dict[int, int] = {}
    size = 0
    for f in frames:
        _forget(known)
        for host, total, html in zip(f.host, f.total, f.html):
            totals[host] = total
            pages, tokens = held.setdefault(host, ([0], array("q")))
            found = present(Page(html), known)
            pages[0] += 1
            tokens.extend(found)
            size += len(found)
            if size >= _HELD:
                yield _above(held, totals)
                held, totals, size = {}, {}, 0
    if held:
        yield _above(held, totals)


def _bounded(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one part of a host's tokens those that may be on SHARE of its pages."""
    host, _, total = key
    tokens, where = np.unique(np.concatenate([_whole(x) for x in rows.tokens]), return_inverse=True)
    above = np.bincount(where, np.concatenate([np.frombuffer(x, "<i4") for x in rows.above]), len(tokens)).astype(np.int64)
    bound = above + rows.least.sum()
    kept = tokens[(bound >= SUPPORT) & (bound >= SHARE * total)]
    return pd.DataFrame({"host": [host], "wanted": [kept.astype("<i8").tobytes()]} if len(kept) else {"host": [], "wanted": []})


def _added(parts: list[list[np.ndarray]]) -> pd.DataFrame:
    """Rows of pages' tokens added up by (host, token)."""
    host, key, token, times, first = (np.concatenate(x) for x in zip(*parts))
    sign = _mixed(_mixed(key.view(np.uint64)) + times.view(np.uint64)).view(np.int64)
    order = np.lexsort((token, host))
    host, token, sign, first = host[order], token[order], sign[order], first[order]
    starts = np.flatnonzero(np.r_[True, (host[1:] != host[:-1]) | (token[1:] != token[:-1])])
    return pd.DataFrame({
        "host": host[starts], "token": token[starts], "pages": np.diff(np.r_[starts, len(host)]),
        "sign": np.bitwise_xor.reduceat(sign, starts), "first": np.add.reduceat(first, starts),
    })


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What pages hold of the wanted tokens, added up over some pages at a time."""
    known: Known = {}
    parts: list[list[np.ndarray]] = []
    held = 0
    for f in frames:
        _forget(known)
        for host, key, html, blob in zip(f.host, f.key, f.html, f.wanted):
            columns = [np.array(x, np.int64) for x in counted(Page(html), known, _wanted(blob))]
            if n := len(columns[0]):
                parts.append([np.full(n, host, np.int64), np.full(n, key, np.int64), *columns])
                held += n
            if held >= _HELD:
                yield _added(parts)
                parts, held = [], 0
    if parts:
        yield _added(parts)


#: Token rows that a worker adds up at once, and words that it remembers.
_HELD, _KNOWN = 1_000_000, 400_000
#: The tokens of a host are bounded in a part for so many pages.
_PART = 10_000
_VECTORS = "host long, token long, pages long, sign long, first long"
#: A template is an array of such rows, as bytes.
_COLUMNS = ["token", "class", "ordinal", "fixed", "main"]


def _bytes(rows: pd.DataFrame) -> bytes:
    return np.ascontiguousarray(rows[_COLUMNS].to_numpy(np.int64)).astype("<i8").tobytes()


def _rows(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, len(_COLUMNS))


class Template:
    """Of each token its class, its ordinal there and whether it is fixed text; sizes of classes; main slots."""

    def __init__(self, rows: np.ndarray):
        rows = rows.tolist()
        self.of = {t: (c, o, bool(fixed)) for t, c, o, fixed, _ in rows}
        self.size = Counter(c for c, _, _ in self.of.values())
        self.main = {(c, o) for _, c, o, _, main in rows if main}
        self.paths = {t >> 31 for t in self.of if t & 0x7FFFFFFF > 1}


@lru_cache(maxsize=256)
def _template(blob: bytes) -> Template:
    return Template(_rows(blob))


#: Slots that are open at a place, innermost last: (class, ordinal of its last token).
Stack = tuple[tuple[int, int], ...]


def walk(page: Page, template: Template, known: Known | None = None) -> tuple[list[Stack], set[int], set[int], list[bool]]:
    """Of each item the open slots, the classes met, those out of order or not nested, and whether an item is
    fixed text only."""
    known = {} if known is None else known
    slots: list[Stack] = []
    fixed = [False] * len(page.items)
    open_: list[tuple[int, int]] = []
    seen, bad = set(), set()

    def meet(c: int, o: int) -> None:
        seen.add(c)
        depth = next((d for d in range(len(open_) - 1, -1, -1) if open_[d][0] == c), None)
        if o == 0:
            if depth is not None:
                bad.add(c)
                del open_[depth:]
            open_.append((c, 0))
        elif depth is None or open_[depth][1] != o - 1:
            bad.add(c)
            return
        else:
            # Of two that cross, the one with fewer tokens gives way.
            bad.update(min((template.size[x], x), (template.size[c], c))[1] for x, _ in open_[depth + 1 :])
            open_[depth:] = [(c, o)]
        if o == template.size[c] - 1:
            open_.pop()

    for i, (e, words, x) in enumerate(page.items):
        path = page.elements[e][2]
        if words is None:
            if at := template.of.get(tag_token(path, x)):
                meet(at[0], at[1])
            slots.append(())
        elif path >> 31 not in template.paths:
            slots.append(tuple(open_))
        else:
            free = None
            if len(words) >= FIXED_WORDS and (at := template.of.get(text_token(path, words))):
                meet(at[0], at[1])
                fixed[i] = at[2]
            for at in map(template.of.get, map(_tokens(known, path).__getitem__, words)):
                if at:
                    meet(at[0], at[1])
                elif free is None:
                    free = tuple(open_)
            slots.append(tuple(open_) if free is None else free)
    return slots, seen, bad, fixed


def _innermost(stack: Stack, gone: set[int] = frozenset()) -> tuple[int, int]:
    """The innermost slot of a class that isn't gone; outside of all: (-1, 0)."""
    return next(((c, o) for c, o in reversed(stack) if c not in gone), (-1, 0))


def _measures(page: Page, keys: list) -> dict:
    """Of each slot the words, linked words, words inside marked articles and words of headings, parts aside."""
    part, within, _ = page.roles()
    out: dict = {}
    for (e, words, linked), k in zip(page.items, keys):
        if words is None or part[e]:
            continue
        x = out.setdefault(k, [0, 0, 0, 0])
        x[0] += len(words)
        x[1] += linked
        x[2] += len(words) if within[e] else 0
        x[3] += len(words) if page.elements[e][1] in HEADINGS else 0
    return out


def main_slots(measures: dict) -> set:
    """Slots that hold an article, by their measures over one host or one page."""
    if any(x[2] for x in measures.values()):
        return {k for k, x in measures.items() if 2 * x[2] >= x[0]}
    best = max((x[0] - x[1] for x in measures.values()), default=0)
    return {k for k, x in measures.items() if 2 * x[1] < x[0] and (10 * (x[0] - x[1]) >= best or 2 * x[3] >= x[0])}


def _evidence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Added up by host: measures of slots by all that is open there, and (a, b) how many pages a class is on and contradicted by."""
    known: Known = {}
    for f in frames:
        _forget(known)
        held: dict[tuple[int, str], list[int]] = {}
        for host, html, blob in zip(f.host, f.html, f.template):
            page = Page(html)
            slots, seen, bad, _ = walk(page, _template(blob), known)
            found = {" ".join(f"{c}:{o}" for c, o in k): x for k, x in _measures(page, slots).items()}
            found |= {f"class {c}": [1, int(c in bad), 0, 0] for c in seen}
            for k, x in found.items():
                y = held.setdefault((host, k), [0, 0, 0, 0])
                for j in range(4):
                    y[j] += x[j]
        yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["host", "at", "a", "b", "c", "d"])


def article(html: str, template: Template | None, known: Known | None = None) -> str:
    """The page's main text."""
    page = Page(html)
    part, within, kind = page.roles()
    fixed = [False] * len(page.items)
    if template is None:
        slots = [page.elements[e][2] for e, _, _ in page.items]
        main = main_slots(_measures(page, slots))
    else:
        stacks, _, _, fixed = walk(page, template, known)
        slots = [_innermost(x) for x in stacks]
        main = template.main
        if kind == PLAIN and not any(s in main for s in slots):
            main = main_slots(_measures(page, slots))
    blocks, spared = [], []
    for (e, words, _), slot, same in zip(page.items, slots, fixed):
        if words is None or part[e] or not (within[e] if kind != PLAIN else slot in main):
            continue
        spared.append(" ".join(words))
        if not same:
            blocks.append(spared[-1])
    return "\n".join(blocks or spared)


def _articles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: Known = {}
    for f in frames:
        _forget(known)
        texts = [article(html, _template(b) if b else None, known) for html, b in zip(f.html, f.template)]
        yield pd.DataFrame({"page_id": f.page_id, "url": f.url, "text": texts, "templated": [bool(b) for b in f.template]})


def _packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One host's wanted tokens, of all parts."""
    return pd.DataFrame({"host": [key[0]], "wanted": [b"".join(rows.wanted)]})


def _classes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Classes of one host's frequent tokens, each in the order of its tokens' first places."""
    rows = rows.assign(mean=rows["first"] / rows.pages).sort_values(["mean", "token"], kind="stable")
    groups = rows.groupby(["pages", "sign"], sort=True)
    rows = rows.assign(**{"class": groups.ngroup(), "ordinal": groups.cumcount(), "main": 0})
    rows["fixed"] = (rows.token & 0x7FFFFFFF > 1) & (rows.pages >= FIXED_PAGES) & (rows.pages >= FIXED_SHARE * rows.total)
    rows = rows[groups["token"].transform("size") >= 2]
    return _one(key[0], rows)


def _one(host: int, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [host], "template": [_bytes(rows)]} if len(rows) else {"host": [], "template": []})


def _judged(key: tuple, known: pd.DataFrame, evidence: pd.DataFrame) -> pd.DataFrame:
    """A template without the classes that too many pages contradict, its main slots marked."""
    rows = pd.DataFrame(_rows(known.template[0]) if len(known) else [], columns=_COLUMNS)
    seen = evidence["at"].str.startswith("class ")
    gone = {int(at[6:]) for at, a, b in zip(evidence["at"][seen], evidence.a[seen], evidence.b[seen]) if b > TOLERANCE * a}
    rows = rows[~rows["class"].isin(gone)]
    measures: dict[tuple[int, int], list[int]] = {}
    for at, *x in evidence[~seen].itertuples(index=False):
        slot = _innermost(tuple(tuple(map(int, p.split(":"))) for p in at.split()), gone)
        measures[slot] = [i + j for i, j in zip(measures.get(slot, [0] * 4), x)]
    main = main_slots(measures)
    return _one(key[0], rows.assign(main=[int(x in main) for x in zip(rows["class"], rows.ordinal)]))


_TEMPLATES = "host long, template binary"


def candidates(asked: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, wanted) of the hosts with tokens that may be on SHARE of their pages, stored. asked: host, total (its pages), html."""
    above = asked.select("host", "total", "html").mapInPandas(_present, "host long, part int, total long, least int, tokens binary, above binary")
    wanted = above.groupBy("host", "part", "total").applyInPandas(_bounded, "host long, wanted binary")
    return scratch.store(wanted.groupBy("host").applyInPandas(_packed, "host long, wanted binary"), texts=True)


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, template) of the hosts that have one, stored. pages: host (a number; null: none), key, html."""
    hosted = pages.where("host is not null")
    total = scratch.store(hosted.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= SUPPORT))
    asked = hosted.join(total, "host").select("host", "total", "key", "html")
    wanted = candidates(asked, scratch)
    sums = [F.sum("pages").alias("pages"), F.bit_xor("sign").alias("sign"), F.sum("first").alias("first")]
    met = asked.join(wanted, "host").select("host", "key", "html", "wanted")
    vectors = met.mapInPandas(_vectors, _VECTORS).groupBy("host", "token").agg(*sums).where(F.col("pages") >= SUPPORT)
    frequent = vectors.join(total, "host").where(F.col("pages") >= SHARE * F.col("total"))
    classes = scratch.store(frequent.groupBy("host").applyInPandas(_classes, _TEMPLATES), texts=True)
    met = asked.join(classes, "host").select("host", "html", "template")
    evidence = met.mapInPandas(_evidence, "host long, at string, a long, b long, c long, d long").groupBy("host", "at").agg(*[F.sum(c).alias(c) for c in "abcd"])
    judged = scratch.store(classes.groupBy("host").cogroup(evidence.groupBy("host")).applyInPandas(lambda k, x, y: _judged(k, x, y.drop(columns="host")), _TEMPLATES), texts=True)
    scratch.drop(total, wanted, classes)
    return judged


def host_id(url: Column) -> Column:
    """host: the URL's host as a 64-bit hash; null where there is none."""
    host = host_of(url)
    return F.when(host != "", F.xxhash64(host)).alias("host")


def extract(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, text (blocks joined by line breaks), n_chars and templated (whether its host has a template)
    of every row of pages (page_id, url, html)."""
    scratch = scratch or Scratch(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), host_id(F.col("url")), F.xxhash64("page_id", "url", html).alias("key"))
    known = templates(rows, scratch)
    met = rows.join(known, "host", "left").select("page_id", "url", "html", "template")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = met.mapInPandas(_articles, f"page_id {types['page_id']}, url string, text string, templated boolean")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "templated")
