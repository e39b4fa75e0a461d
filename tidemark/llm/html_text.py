"""Main text of web pages by site template removal.

Each page is read into elements; every block element has the hash of its subtree (tags and text). Spark counts
on how many different pages of each host a subtree occurs; a subtree that recurs across many pages of its host
is template and is deleted. Of what is left, what markup itself declares as no article (menus, page headers and
footers, asides, forms, scripts, notices, adverts, comments by readers) goes as well, so that what differs
from page to page and hosts of one page are handled too, unless nothing of the page's article would be
left. Where a page has an article or main element its text is the result; the rest is cut into blocks.

Hosts of any size: pages meet their deletions by a key of the page, never by host; counts are aggregated
before the shuffle, the host is only part of their key, and a subtree that stands on very many pages meets them by a
broadcast of bounded size.

A subtree is template if it stands on ``least`` pages or more and on at least ``share`` of the host's pages;
inside an article or main element, where pages of one host may rightly quote the same passage, on
``article_share`` of them. Only block elements are deleted: a word in bold may recur anywhere. A class or id
declares by whole values: each of its parts must be a word of the list, one of them of the first.

The scanner only moves forward, and open elements are found by name, so the time is linear in the page's length
whatever its markup.

Edge cases: a null or empty page gives an empty text; a null url is a host of its own, named null; null
page ids are pages like others; pages of equal content and repeated rows count as one page and have equal texts;
a quote that is never closed is no quote; what follows an unfinished tag is no text; further columns don't matter.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, met

LEAST = 5
SHARE = 0.5
ARTICLE_SHARE = 0.9

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Element names of the HTML standard, by how they are handled.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_OUT = frozenset("script style noscript template head title nav footer aside form button select option textarea input label iframe svg canvas object embed applet audio video map dialog menu noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"caption", "dd", "dt", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "legend"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_LIMIT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "p": {"div", "article", "section", "main", "body", "td", "li", "blockquote", "aside", "nav", "footer", "header", "form"}}
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: What class and id values name, and words that may stand with it.
_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar menu menus nav navbar navigation breadcrumb breadcrumbs topbar toolbar masthead footer header comment comments disqus replies respond reviews share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget widgets skip".split())
_WITH = frozenset("area banner bar block bottom box btn button buttons container content first form global group inner item items last left list links main message outer page panel primary right secondary section site thread top wrap wrapper".split())
_KEEP = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset(("article", "main"))
#: these go as what they are, whatever they hold
_NEVER = _OUT - {"form", "aside", "dialog"}


def _named(value: str) -> bool:
    for token in value.split():
        parts = [x for x in re.split(r"[^a-z0-9]+", token) if x]
        if any(x in _WORDS for x in parts) and all(x in _WORDS or x in _WITH or x.isdigit() for x in parts):
            return True
    return False


def _declared_out(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _OUT or (tag == "header" and not in_article):
        return True
    if not attrs or tag in _KEEP:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            if _named(value):
                return True
        elif name == "role" and value in _ROLE or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _joined(state: int, part: int) -> int:
    return xxhash.xxh3_64_intdigest(struct.pack("<QQ", state, part))


class Page:
    """Elements as lists by index: parent, tag, subtree hash, declared (no article), article (in one)."""

    def __init__(self, html: str):
        self.parent, self.tags, self.hash, self.declared, self.article = [-1], [""], [0], [False], [False]
        self.blocks: list[list[tuple[int, str]]] = []
        self._state, self._open, self._parts = [0], [0], []
        self._depths: dict[str, list[int]] = {}
        self._read(html)
        del self._state, self._open, self._parts, self._depths

    def _text(self, raw: str) -> None:
        if raw:
            self._parts.append((self._open[-1], raw))
            if s := raw.strip():
                self._state[-1] = _joined(self._state[-1], xxhash.xxh3_64_intdigest(s))

    def _break(self) -> None:
        if self._parts:
            self.blocks.append(self._parts)
            self._parts = []

    def _push(self, tag: str, attrs: str) -> None:
        up = self._open[-1]
        self.parent.append(up)
        self.tags.append(tag)
        self.hash.append(0)
        self.article.append(self.article[up] or tag in _MAIN)
        self.declared.append(_declared_out(tag, attrs, self.article[up]))
        self._depths.setdefault(tag, []).append(len(self._open))
        self._open.append(len(self.parent) - 1)
        self._state.append(xxhash.xxh3_64_intdigest(tag))

    def _pop(self) -> None:
        i, state = self._open.pop(), self._state.pop()
        self._depths[self.tags[i]].pop()
        self.hash[i] = state
        self._state[-1] = _joined(self._state[-1], state)

    def _depth(self, tags) -> int:
        """Depth of the innermost open element of these names, 0 if there is none."""
        return max((own[-1] for t in tags if (own := self._depths.get(t))), default=0)

    def _close(self, tags, stop) -> None:
        """Close the innermost of ``tags``, unless one of ``stop`` lies within it."""
        depth = self._depth(tags)
        if depth and depth >= self._depth(stop):
            while len(self._open) > depth:
                self._pop()

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        closed = {'"': n, "'": n}  # from there on no such quote is left
        while at < n:
            start = html.find("<", at)
            m = _NAME.match(html, start + 1) if start >= 0 else None
            while start >= 0 and m is None and html[start + 1 : start + 2] not in ("!", "?"):
                start = html.find("<", start + 1)
                m = _NAME.match(html, start + 1) if start >= 0 else None
            if start < 0:
                self._text(html[at:])
                break
            self._text(html[at:start])
            if m is None:
                if html.startswith("<!--", start):
                    short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, start)), None)
                    end = start + len(short) - 1 if short else html.find("-->", start + 4)
                    end = end + 2 if end >= 0 and not short else end
                else:
                    end = html.find(">", start)
                if end < 0:
                    break
                at = end + 1
                continue
            end, look = -1, m.end()
            while (s := _STOP.search(html, look)) is not None:
                if s[0] == ">":
                    end = s.start()
                    break
                look = s.end()
                if look <= closed[s[0]] and html[max(m.end(), s.start() - 80) : s.start()].rstrip().endswith("="):
                    there = html.find(s[0], look)
                    if there < 0:
                        closed[s[0]] = look - 1
                    else:
                        look = there + 1
            if end < 0:  # the tag never ends
                break
            attrs, at = html[m.end() : end], end + 1
            name = m[0].lower()
            tag = name.lstrip("/")
            if tag in _BLOCK:
                self._break()
            if name[0] == "/":
                self._close((tag,), () if tag in _BLOCK else ("article", "td", "th", "table", "body"))
                continue
            if tag in _VOID:
                if tag == "br" and self._parts:
                    self._parts.append((self._open[-1], " "))
                continue
            if tag in _CLOSES_P:
                self._close(("p",), _LIMIT["p"])
            if tag in _SAME and tag != "p":
                self._close(_SAME[tag], _LIMIT[tag])
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = close.end() if close else n
                continue
            self._push(tag, attrs)
            if attrs.endswith("/") and tag in ("svg", "path"):
                self._pop()
        self._break()
        while len(self._open) > 1:
            self._pop()

    def _key(self, i: int) -> int:
        """The subtree's hash; its last bit tells whether the element stands in an article."""
        h = self.hash[i] & ~1 | self.article[self.parent[i]]
        return h - (1 << 64) if h >= 1 << 63 else h

    def _deletable(self, i: int) -> bool:
        return self.tags[i] in _BLOCK and self.tags[i] not in ("html", "body")

    def subtrees(self) -> set[int]:
        """Keys of the block elements that hold text."""
        full = set()
        for parts in self.blocks:
            for i, s in parts:
                if s.strip():
                    while i > 0 and i not in full:
                        full.add(i)
                        i = self.parent[i]
        return {self._key(i) for i in full if self._deletable(i)}

    def _dead(self, gone: set[int], spared: bool) -> list[bool]:
        """Which elements are deleted. Spared are those that hold an article, whatever else they are declared to be."""
        n = len(self.parent)
        holds = [False] * n
        for i in reversed(range(1, n)) if spared else ():
            if holds[i] or self.tags[i] in _MAIN:
                holds[self.parent[i]] = True
        out = [False] * n
        for i in range(1, n):
            template = bool(gone) and self._deletable(i) and self._key(i) in gone
            out[i] = out[self.parent[i]] or template or self.declared[i] and not (holds[i] and self.tags[i] not in _NEVER)
        return out

    def text(self, gone: set[int] = frozenset()) -> str:
        return self._kept(self._dead(gone, False)) or self._kept(self._dead(gone, True))

    def _kept(self, dead: list[bool]) -> str:
        only = any(a and not d for a, d in zip(self.article, dead, strict=True))
        out = []
        for parts in self.blocks:
            kept = [s for i, s in parts if not dead[i] and (not only or self.article[i])]
            if kept:
                s = "".join(kept)
                s = " ".join((unescape(s) if "&" in s else s).split())
                if s:
                    out.append(s)
        return "\n".join(out)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at, hashes = [], []
        for i, html in enumerate(b.column(3).to_pylist()):
            own = Page(html or "").subtrees()
            at += [i] * len(own)
            hashes += own
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(3)], pa.array(hashes, pa.int64())], ["key", "host", "content", "subtree"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [Page(h or "").text(set(g or ())) for h, g in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _templates(pages: DataFrame, least: int, share: float, article_share: float) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, html, key) of every row, and (key, gone): the template subtrees of the pages that have any."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("null"))
    rows = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"), F.xxhash64(host).alias("host"), F.xxhash64("html").alias("content"))
    seen = Observation()
    found = cut(rows.select("key", "host", "content", "html").mapInArrow(_subtrees, "key long, host long, content long, subtree long"), seen, F.count("*").alias("n"))
    n = seen.get["n"]
    total = rows.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    inside = F.col("subtree").bitwiseAND(F.lit(1)) == 1
    counted = found.groupBy("host", "subtree", "content").agg(F.count("*").alias("n")).groupBy("host", "subtree").agg(F.count("*").alias("on"), F.sum("n").alias("n"))
    template = counted.where(F.col("on") >= least).join(total, "host").where(F.col("on") >= F.col("pages") * F.when(inside, article_share).otherwise(share))
    at = F.struct("host", "subtree").alias("at")
    deleted = met(found.select("key", "subtree", at), template.select(at, "n", F.lit(True).alias("template")), "at", "n", n)
    # as a table its size is known when pages meet it: where little is deleted Spark broadcasts it and moves no page
    return rows.select("page_id", "url", "html", "key"), cut(deleted.groupBy("key").agg(F.collect_set("subtree").alias("gone")))


def extracted(pages: DataFrame, least: int = LEAST, share: float = SHARE, article_share: float = ARTICLE_SHARE) -> DataFrame:
    """page_id, url and text of every row."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows, gone = _templates(pages, least, share, article_share)
    return rows.join(gone, "key", "left").select("page_id", "url", "html", "gone").mapInArrow(_texts, f"page_id {kind}, url string, text string")
