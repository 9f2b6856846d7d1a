"""HTML pages as rows: elements in document order, cards around them, and visible text.

The tree walk has no native form, so it runs over Arrow batches, one page at a time; everything after it is columns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Elements without content, elements whose text is not shown, and the elements that can be a card.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template", "noscript"}
CARDS = {"article", "li", "tr", "section", "div"}
CARD_TEXT, ABOVE = 4000, 8

ELEMENTS = "doc long, pos int, last int, depth int, parent int, card int, around int, digest string, above array<int>, tag string, id string, class string, href string, datetime string, alt string, text string"


_SPACE = re.compile(r"\s+", re.ASCII)
#: One token of plain markup: text, an end, a start with its quoted attributes, a comment. Other markup is the standard parser's.
_TOKEN = re.compile(r'''([^<\x00]+)|</([a-z][a-z0-9]*)>|<([a-z][a-z0-9]*)((?:[ \n]+[a-z][a-z0-9-]*="[^"&<>\x00]*")*)[ \n]*(/?)>|<!--[^-<>&\x00]*-->|<!DOCTYPE html>''')
_ATTRIBUTE = re.compile(r'''([a-z][a-z0-9-]*)="([^"]*)"''')
#: Elements whose content the standard parser reads in a way of its own.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "svg", "math"}


class _Tree(HTMLParser):
    """Elements in document order with their whole text; each with the places of its parent, of the nearest elements above and of the last element in it.

    An element's digest is taken when it ends, of its tag and attributes, its own texts and the digests of what stands in it, in their order: equal
    digests are equal contents. Shown texts are kept once; an element's are those from its begin to its end.
    """

    def __init__(self, digests: bool = True):
        super().__init__(convert_charrefs=True)
        self.digests = digests
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.shown: list[str] = []
        self.hidden = 0

    def _end(self, at: int) -> None:
        """End the open elements from the ``at``-th on, the innermost first."""
        for i in reversed(self.open[at:]):
            r = self.rows[i]
            r["text"] = " ".join(" ".join(self.shown[r["text"] :]).split())
            self.hidden -= r["tag"] in HIDDEN
            r["last"] = max(i, r["last"])
            if self.digests:
                r["digest"] = hashlib.blake2b("\x1f".join(r.pop("parts")).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
            if r["parent"] is not None:
                up = self.rows[r["parent"]]
                up["last"] = max(up["last"], r["last"])
                if self.digests:
                    up["parts"].append("\x1e" + r["digest"])
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        r = {"tag": tag, "parent": self.open[-1] if self.open else None, "depth": len(self.open), "last": 0, "text": len(self.shown), "id": a.get("id"), "class": a.get("class"), "href": a.get("href"), "datetime": a.get("datetime"), "alt": a.get("alt")}
        if self.digests:
            r["parts"] = [tag, *[f"\x1d{k}\x1d{v}" for k, v in attrs]]
        self.rows.append(r)
        self.open.append(len(self.rows) - 1)
        self.hidden += tag in HIDDEN
        if tag in VOID:
            self._end(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[at]]["tag"] == tag:
                self._end(at)
                return

    def handle_data(self, data):
        if self.open:
            if self.digests:
                self.rows[self.open[-1]]["parts"].append(data)
            if not self.hidden:
                self.shown.append(data)

    def close(self):
        super().close()
        self._end(0)

    def plain(self, html: str) -> bool:
        """Walk markup that is all plain tokens, as the standard parser would; False if it is not."""
        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() != at:
                return False
            at, kind = m.end(), m.lastindex
            if kind == 1:
                data = m[1]
                if "&" in data:
                    if at == len(html):
                        return False
                    data = unescape(data)
                self.handle_data(data)
            elif kind == 2:
                self.handle_endtag(m[2])
            elif kind:
                tag = m[3]
                if tag in _RAW:
                    return False
                attrs = _ATTRIBUTE.findall(m[4])
                if m[5]:
                    self.handle_startendtag(tag, attrs)
                else:
                    self.handle_starttag(tag, attrs)
        return at == len(html)


def _card(rows: list[dict], i: int | None) -> int | None:
    """The element itself or the nearest around it that can be a card, if its text is short enough."""
    while i is not None:
        if rows[i]["tag"] in CARDS:
            return i if len(rows[i]["text"]) <= CARD_TEXT else None
        i = rows[i]["parent"]
    return None


def _walk(html: str | None, digests: bool = True) -> list[dict]:
    """Elements in document order with all that follows from the walk alone."""
    tree = _Tree(digests)
    if not tree.plain(html or ""):
        tree = _Tree(digests)
        tree.feed(html or "")
    tree.close()
    return tree.rows


def parse(html: str | None) -> list[dict]:
    rows = _walk(html)
    for i, r in enumerate(rows):
        r["pos"], r["card"], r["around"] = i, _card(rows, i), _card(rows, r["parent"])
        r["above"] = [] if r["parent"] is None else [r["parent"], *rows[r["parent"]]["above"][: ABOVE - 1]]
        r["digest"] = r["digest"] if r["tag"] in CARDS else None
    return rows


def _in_batches(batches: Iterator[pa.RecordBatch], one, room: int = 4_000_000) -> Iterator[tuple[list[int], list]]:
    """What ``one`` makes of each document, with the document's number once an item, for some ``room`` characters at a time."""
    docs, items, held = [], [], 0
    for batch in batches:
        for doc, html in zip(batch["doc"].to_pylist(), batch["html"].to_pylist(), strict=True):
            found = one(html)
            docs += [doc] * len(found)
            items += found
            held += len(html or "")
            if held > room:
                yield docs, items
                docs, items, held = [], [], 0
    if items:
        yield docs, items


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["pos", "last", "depth", "parent", "card", "around", "digest", "above", "tag", "id", "class", "href", "datetime", "alt", "text"]
    kinds = [pa.int32()] * 6 + [pa.string()] + [pa.list_(pa.int32())] + [pa.string()] * 7
    for docs, rows in _in_batches(batches, parse):
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *[pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]], ["doc", *names])


def elements(pages: DataFrame) -> DataFrame:
    """Pages (doc, html) to one row an element."""
    return pages.select(F.col("doc").cast("long").alias("doc"), "html").mapInArrow(_elements, ELEMENTS)


_INSIDE = ("tag", "classes", "href", "datetime", "alt", "text")


def _blocks(html: str | None, begins: Callable[[dict], bool]) -> list[tuple[int, list[dict]]]:
    """Blocks (place, elements) of a page as :func:`within` tells them."""
    out, last = [], -1
    for i, r in enumerate(_walk(html, digests=False)):
        r["classes"] = None if r["class"] is None else f" {_SPACE.sub(' ', r['class'])} "
        if begins(r):
            last = r["last"]
            out.append((i, []))
        if i <= last:
            out[-1][1].append(r)
    return out


def _begins(r: dict, class_: str | None, tag: str | None, href: str) -> bool:
    return (class_ is None or f" {class_} " in (r["classes"] or "")) and (tag is None or r["tag"] == tag) and (not href or (r["href"] or "").startswith(href))


def blocks(pages: DataFrame, class_: str | None = None, tag: str | None = None, href: str = "") -> DataFrame:
    """Pages (doc, html) to a row a block (doc, block, inside): the elements of each that has the class, the tag and the begin of a link, in order.

    Blocks are those of :func:`within`. A page's blocks are put together where it is walked, so no element is shuffled.
    """
    one = partial(_blocks, begins=partial(_begins, class_=class_, tag=tag, href=href))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, found in _in_batches(batches, one):
            ends = list(accumulate((len(x) for _, x in found), initial=0))
            inside = [r for _, x in found for r in x]
            struct = pa.StructArray.from_arrays([pa.array([r[n] for r in inside], pa.string()) for n in _INSIDE], _INSIDE)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([i for i, _ in found], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), struct)], ["doc", "block", "inside"])

    inside = ", ".join(f"{n}: string" for n in _INSIDE)
    return pages.select(F.col("doc").cast("long").alias("doc"), "html").mapInArrow(rows, f"doc long, block int, inside array<struct<{inside}>>")


def says_class(name: str) -> Callable[[Column], Column]:
    """Whether an element inside a block has the class."""
    return lambda x: F.coalesce(x["classes"].contains(f" {name} "), F.lit(False))


def all_inside(value: Callable[[Column], Column], where: Callable[[Column], Column] | None = None) -> Column:
    """The values, in order, of the elements inside a block that hold, without nulls."""
    found = F.filter("inside", where) if where else F.col("inside")
    return F.filter(F.transform(found, value), lambda v: v.isNotNull())


def first_inside(value: Callable[[Column], Column], where: Callable[[Column], Column] | None = None) -> Column:
    """As :func:`first_in`, of the elements inside a block."""
    return F.get(all_inside(value, where), F.lit(0))


def visible_text(html: Column, references: dict[str, str] | None = None) -> Column:
    """Text without markup, scripts and styles. ``references``: the only ones read, whole and in this order, by what they stand for; else all
    that a browser reads, those cut short too."""
    c = html
    for tag in ("script", "style", "template", "noscript"):
        c = F.regexp_replace(c, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    c = F.regexp_replace(F.regexp_replace(c, "(?s)<!--.*?-->", " "), "<[^>]+>", " ")
    c = T.unescape(c) if references is None else T._replace_all(c, references)
    return F.trim(F.regexp_replace(c, r"[\t\n\f\r ]+", " "))


def cards(found: DataFrame, dates_from: Column | None = None) -> DataFrame:
    """One row a card (doc, card): its text, first link, first heading, and its machine-readable days. Of cards with equal content the first stays."""
    c = found.where("card is not null").groupBy("doc", "card").agg(
        F.max_by("text", F.when(F.col("pos") == F.col("card"), 1)).alias("text"),
        F.min_by("href", F.when(F.col("href").isNotNull(), F.col("pos"))).alias("href"),
        F.min_by("text", F.when(F.col("tag").isin("h1", "h2", "h3", "h4") & (F.col("text") != ""), F.col("pos"))).alias("title"),
        F.min_by(F.substring("datetime", 1, 10), F.when(F.col("datetime").rlike(r"^\d{4}-\d{2}-\d{2}"), F.col("pos"))).alias("first_day"),
        F.max_by(F.substring("datetime", 1, 10), F.when(F.col("datetime").rlike(r"^\d{4}-\d{2}-\d{2}"), F.col("pos"))).alias("last_day"),
        F.max_by("digest", F.when(F.col("pos") == F.col("card"), 1)).alias("digest"))
    return _unlike(c).drop("digest")


def _unlike(cards: DataFrame) -> DataFrame:
    first = F.min("card").over(Window.partitionBy("doc", "digest"))
    return cards.withColumn("__first", first).where(F.col("card") == F.col("__first")).drop("__first")


def cards_around(found: DataFrame, match: Column) -> DataFrame:
    """(doc, card, text) of the nearest element around each match that can be a card, never the match itself; none where that is too
    long to be one. A card around several matches comes once, and of cards with equal content only the first.
    """
    around = found.where(match & F.col("around").isNotNull()).select("doc", F.col("around").alias("card")).distinct()
    own = found.where("digest is not null").select("doc", F.col("pos").alias("card"), "digest", "text")
    return _unlike(around.join(own, ["doc", "card"])).drop("digest")


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.split("class", r"\s+"), name), F.lit(False))


def within(found: DataFrame, block: Column) -> DataFrame:
    """Elements with the place of the block around them; of nested blocks, of the last one begun. A window over each page, no join."""
    begun = F.last(F.when(block, F.struct("pos", "last")), ignorenulls=True).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("__b", begun).withColumn("block", F.when(F.col("pos") <= F.col("__b.last"), F.col("__b.pos"))).drop("__b")


def first_in(value: Column, where: Column) -> Column:
    """The first value of a block's elements that holds."""
    return F.min_by(value, F.when(where & value.isNotNull(), F.col("pos")))


def sitemap_slugs(xml: Column, section: str) -> Column:
    """Slugs of a sitemap's locations below a section."""
    return F.regexp_extract_all(xml, F.lit(f"<loc>[^<]*/{section}/([^/<]+)/?</loc>"), F.lit(1))


def json_ld(html: Column) -> Column:
    """The texts of a page's JSON-LD scripts that can hold an event."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.filter(scripts, lambda s: s.contains("Event"))


def next_data(html: Column) -> Column:
    """The state that a server-rendered page carries for its script."""
    return F.nullif(F.regexp_extract(html, r"""(?is)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>""", 1), F.lit(""))
