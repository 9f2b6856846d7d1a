"""Adapters from landed payloads to event rows, by shape of payload, and the registry of sources.

Payloads are landed outside the engine (``raw``: source, doc, url, body); an adapter is a function of columns and rows. Rows of an
adapter carry (doc, pos), their order, from which ``extract`` makes the sequence in which sources and rows are merged.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cards as C
from ..functions import dates as D
from ..functions import fixed as X
from ..functions import text as T
from ..operators import sequences
from ..operators.sequences import carry_forward, day_list, first_of
from . import html as H
from . import ics, jsonld

FIELDS = {
    "title": "string", "start": "date", "end": "date", "time": "string", "town": "string", "venue": "string", "category": "string", "url": "string", "note": "string", "price": "string",
    "free": "boolean", "image": "string", "outdoor": "boolean", "online": "boolean", "submitted_by": "string", "approved": "boolean",
}


@dataclass(frozen=True)
class Source:
    """A named source. ``reconciles`` sources list all they have, so rows that left their listing have moved."""

    name: str
    adapter: Callable[[DataFrame, dt.date], DataFrame]
    needs_browser: bool = False
    delay: float = 1.0
    reconciles: bool = False


@dataclass
class Registry:
    """Sources in the order in which they are merged: the first to bring an event owns it."""

    sources: dict[str, Source] = field(default_factory=dict)

    def add(self, *sources: Source) -> None:
        for s in sources:
            if s.name in self.sources:
                raise ValueError(f"{s.name} is registered twice")
            self.sources[s.name] = s

    def extract(self, raw: DataFrame, as_of: dt.date, only: list[str] | None = None) -> DataFrame:
        """Event rows of all (or the named) sources with source and ``seq``."""
        unknown = set(only or ()) - set(self.sources)
        if unknown:
            raise ValueError(f"unknown sources: {sorted(unknown)}")
        parts = []
        for rank, (name, s) in enumerate(self.sources.items()):
            if only is None or name in only:
                rows = s.adapter(raw.where((F.col("source") == name) & F.col("body").isNotNull()), as_of)
                # A total order of digits, each part with room of its own: source, document, place in the document.
                seq = F.concat(F.lit(str(rank)), F.lpad(F.col("doc").cast("string"), 19, "0"), F.lpad(F.col("pos").cast("string"), 16, "0")).cast("decimal(38,0)")
                parts.append(shaped(rows).withColumn("source", F.lit(name)).withColumn("seq", seq).drop("doc", "pos"))
        out = reduce(DataFrame.unionByName, parts)
        return out.where((F.col("end") >= F.lit(as_of)) | (F.coalesce("end", "start") >= F.lit(as_of)))


def shaped(rows: DataFrame) -> DataFrame:
    """``rows`` with all event fields, those they lack as nulls."""
    have = set(rows.columns)
    return rows.select("doc", "pos", *[(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in FIELDS.items()])


def _once(rows: DataFrame, key: list[str]) -> DataFrame:
    return first_of(rows, ["doc", *key], ["pos"])


# --- HTML shapes


def _html(raw: DataFrame) -> DataFrame:
    return raw.select("doc", F.col("body").alias("html"))


def _pages(raw: DataFrame) -> DataFrame:
    return H.elements(_html(raw))


def heading_dated(raw: DataFrame, as_of: dt.date, town: str | None = None, category: str | None = None) -> DataFrame:
    """Listings under date headings: a card's day is that of the last heading before it."""
    e = _pages(raw)
    e = e.withColumn("day", F.when(F.col("tag").isin("h1", "h2", "h3", "h4", "caption"), D.parse_date(F.col("text"), F.lit(as_of))))
    e = carry_forward(e, ["doc"], ["pos"], "day")
    card = e.where(F.col("tag").isin("article", "li", "tr") & (F.col("text") != "")).select("doc", F.col("pos").alias("card"), "text", "day")
    own = H.cards(e).select("doc", "card", "title", "href")
    rows = card.join(own, ["doc", "card"]).where("day is not null and title is not null")
    out = rows.select("doc", F.col("card").alias("pos"), "title", F.col("day").alias("start"), D.parse_time(F.col("text")).alias("time"), F.col("href").alias("url"), F.lit(town).alias("town"), F.coalesce(F.lit(category), T.classify(F.col("title"))).alias("category"), T.price_from_text(F.col("text")).alias("price"))
    return _once(out, ["url", "start", "title"])


def timed_cards(raw: DataFrame, as_of: dt.date, town: str | None = None, category: str | None = None) -> DataFrame:
    """Cards with machine-readable days: the first is the start, the last the end."""
    c = H.cards(_pages(raw)).where("title is not null and first_day is not null")
    start, end = F.try_to_date("first_day"), F.try_to_date("last_day")
    return c.select("doc", F.col("card").alias("pos"), "title", start.alias("start"), F.when(end > start, end).alias("end"), F.col("href").alias("url"), F.lit(town).alias("town"), F.coalesce(F.lit(category), T.classify(F.col("title"))).alias("category"))


def text_dated(raw: DataFrame, as_of: dt.date, town: str | None = None, category: str | None = None) -> DataFrame:
    """Cards whose text holds a date; a title that is missing comes from the link's slug."""
    c = H.cards(_pages(raw))
    slug = T.title_case(F.replace(F.regexp_extract("href", r"([^/]+)/?$", 1), F.lit("-"), F.lit(" ")))
    title = F.coalesce("title", F.nullif(slug, F.lit("")))
    out = c.select("doc", F.col("card").alias("pos"), title.alias("title"), D.parse_date(F.col("text"), F.lit(as_of)).alias("start"), D.parse_time(F.col("text")).alias("time"), F.col("href").alias("url"), F.lit(town).alias("town"), F.coalesce(F.lit(category), T.classify(title)).alias("category"))
    return _once(out.where("start is not null and title is not null"), ["url", "title", "start"])


def _dates_of_line(text: Column, year: Column, season_start: Column) -> Column:
    """Every day of a line such as '30 et 31 décembre. 2 janvier', in order: days belong to the month after them, and a month that goes
    back is in the next year. The first month lies in ``year``, or where that is null in its part of the season."""
    line = T.fold(text)
    spans = F.regexp_extract_all(line, F.lit(rf"(?s)(.*?(?:{'|'.join(X.MONTHS)}))"), F.lit(1))
    table = F.create_map(*[F.lit(x) for kv in X.MONTHS.items() for x in kv])
    month = lambda s: F.try_element_at(table, F.regexp_extract(s, rf"({'|'.join(X.MONTHS)})$", 1))
    days = lambda s: day_list(F.regexp_replace(F.regexp_replace(s, r"\b1\s*er\b", "1"), r"\d{1,2}\s*h\s*\d{0,2}", " "))

    def dates(ms: Column, spans: Column) -> Column:
        years = sequences.rolled_years(ms)
        one = lambda s, i: F.transform(days(s), lambda d: D._date(F.coalesce(year, D.season_year(ms[0], season_start)) + years[i], ms[i], d))
        return F.filter(F.flatten(F.transform(spans, one)), lambda d: d.isNotNull())

    return T.let(spans, lambda sp: T.let(F.transform(sp, month), lambda ms: dates(ms, sp)))


def season_calendar(raw: DataFrame, as_of: dt.date, season_start: int, town: str | None = None, category: str | None = None) -> DataFrame:
    """Cards that name days of a month ('3, 5 et 10 au 12 octobre'): one row a day; from September on the season's first year."""
    c = H.cards(_pages(raw)).where("title is not null")
    spans = F.regexp_extract_all(F.lower("text"), F.lit(rf"((?:\d{{1,2}}(?:er)?\s*(?:,|et|au|&|-)?\s*)+(?:{'|'.join(X.MONTHS)}))"), F.lit(1))
    c = c.select("*", F.posexplode(_dates_of_line(F.array_join(spans, ". "), F.lit(None).cast("int"), F.lit(season_start))).alias("n", "start"))
    out = c.select("doc", (F.col("card").cast("long") * 1_000_000 + F.col("n")).alias("pos"), "title", "start", D.parse_time(F.regexp_extract("text", r"(\d{1,2}\s*h\s*\d{0,2})", 1)).alias("time"), F.col("href").alias("url"), F.lit(town).alias("town"), F.lit(category).alias("category"))
    return _once(out, ["title", "start"])


def season_programme(raw: DataFrame, as_of: dt.date, base: str = "", town: str | None = None, venue: str | None = None) -> DataFrame:
    """A season under headings of years: one row a day of each card's line of dates, the section in its address its type."""
    k, has = X.SEASON_CARD, H.has_class
    e = _pages(raw).withColumn("year", F.when(has(k["year"]) & F.col("text").rlike(r"^\d{4}$"), F.col("text").cast("int")))
    e = carry_forward(e, ["doc"], ["pos"], "year").withColumn("season", F.min("year").over(Window.partitionBy("doc")))
    e = H.within(e, has(k["block"])).where("block is not null")
    text = F.nullif(F.col("text"), F.lit(""))
    c = e.groupBy("doc", "block").agg(
        H.first_in(F.col("year"), F.lit(True)).alias("year"), F.first("season").alias("season"), H.first_in(text, has(k["title"])).alias("title"), H.first_in(text, has(k["dates"])).alias("dates"),
        H.first_in(text, has(k["note"])).alias("note"), H.first_in(F.col("href"), has(k["link"])).alias("href"))
    now = F.lit(as_of.year if as_of.month >= 9 else as_of.year - 1)
    c = c.where("title is not null and dates is not null").select("*", F.posexplode(_dates_of_line(F.col("dates"), F.col("year"), F.coalesce("season", now))).alias("n", "start"))
    url = _absolute(F.col("href"), base)
    section = F.replace(F.element_at(F.concat(F.array(F.lit("")), F.split(F.regexp_replace(url, "/+$", ""), "/")), -2), F.lit("-"), F.lit(" "))
    out = c.select("doc", (F.col("block").cast("long") * 1_000_000 + F.col("n")).alias("pos"), "title", "start", url.alias("url"), "note", F.lit(town).alias("town"), F.lit(venue).alias("venue"), F.coalesce(T.category_from_type(section), F.lit("scene")).alias("category"))
    return _once(out, ["title", "start"])


def _absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("http") | (href == ""), href).otherwise(F.concat(F.lit(base), href))


def sale_listing(raw: DataFrame, as_of: dt.date, base: str = "", department: str = "06") -> DataFrame:
    """Flea markets under date headings: town and identity stand in the link, venue and size in the card's line.

    A box that holds a heading of its own is a day's section and no card.
    """
    heading = D.parse_date(F.when(F.col("tag").isin("h2", "h3") & F.col("text").rlike(r"(?U)\d{1,2}(er)?\s+\p{L}+\s+\d{4}"), F.col("text")), F.lit(as_of))
    e = carry_forward(_pages(raw).withColumn("own_day", heading).withColumn("day", F.col("own_day")), ["doc"], ["pos"], "day")
    address = rf"/{department}/([a-z0-9-]+)/\d+-"
    first = lambda c, where: F.min_by(c, F.when(where, F.col("pos")))
    link = F.col("href").rlike(address) & (F.col("text") != "")
    cards = e.where("card is not null").groupBy("doc", "card").agg(first("href", link).alias("href"), first("text", link).alias("name"), first("day", link).alias("day"), first("text", F.col("pos") == F.col("card")).alias("block"), F.max("own_day").alias("own_day"))
    cards = cards.where("href is not null and day is not null and own_day is null")
    town = T.title_case(F.replace(F.regexp_extract("href", address, 1), F.lit("-"), F.lit(" ")))
    line = C.sale_card(F.col("block"))
    out = cards.select("doc", F.col("card").alias("pos"), C.without_town(F.col("name"), town).alias("title"), F.col("day").alias("start"), town.alias("town"), line["venue"].alias("venue"), F.lit("brocante").alias("category"), _absolute(F.col("href"), base).alias("url"), line["note"].alias("note"))
    return _once(out, ["url", "start"])


def place_cards(raw: DataFrame, as_of: dt.date, base: str = "", town: str = "Nice") -> DataFrame:
    """Cards with machine-readable days and hours, a line for the place and chips for festival and genre."""
    k, has, text = X.PLACE_CARD, H.says_class, lambda x: F.nullif(x["text"], F.lit(""))
    day = lambda x: F.when(x["datetime"].rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(x["datetime"], 1, 10)))
    chip = lambda x: F.nullif(F.regexp_replace(x["text"], r"[,\s]+$", ""), F.lit(""))
    c = H.blocks(_html(raw), class_=k["block"]).select("doc", "block", H.first_inside(text, has(k["title"])).alias("title"), H.first_inside(lambda x: x["href"], has(k["title"])).alias("href"), H.all_inside(day).alias("days"),
        H.first_inside(lambda x: x["datetime"], lambda x: x["datetime"].rlike(r"^\d{2}:\d{2}$")).alias("time"), H.first_inside(text, has(k["place"])).alias("place"), H.all_inside(chip, has(k["chip"])).alias("chips"))
    c = c.withColumns({"start": F.get("days", F.lit(0)), "last": F.try_element_at("days", F.lit(-1))})
    place, said = F.nullif(F.trim(F.replace("place", F.lit("Lieu :"), F.lit(""))), F.lit("")), F.lower(F.array_join("chips", " "))
    told = F.filter("chips", lambda x: ~F.lower(x).isin(X.EMPTY_CHIPS))
    out = c.where("title is not null and start is not null").select(
        "doc", F.col("block").alias("pos"), "title", "start", F.when(F.col("last") != F.col("start"), F.col("last")).alias("end"), "time", C.commune_of_place(place, town).alias("town"), place.alias("venue"), T.classify(F.col("title"), F.array_join(told, " ")).alias("category"),
        _absolute(F.col("href"), base).alias("url"), F.nullif(F.array_join(F.slice(told, 1, 2), " · "), F.lit("")).alias("note"), (said.contains("gratuit") | (said.contains("soir") & said.contains("estival"))).alias("free"))
    out = out.where(~T.is_nonevent(F.col("title"))).withColumn("__key", F.coalesce("url", F.concat_ws("|", "title", F.col("start").cast("string"))))
    return _once(out, ["__key"]).drop("__key")


def genre_cards(raw: DataFrame, as_of: dt.date, base: str = "", town: str = "Nice", path: str = "/evenement/", restricted: str | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Linked cards with dates, venue and genre in parts of their own; a link without them is a picture's. Of the ``restricted`` venue's
    rows those on the list of excluded links go, or all where that list could not be read (None)."""
    k, has, text = X.GENRE_CARD, H.says_class, lambda x: F.nullif(x["text"], F.lit(""))
    c = H.blocks(_html(raw), tag="a", href=path).where(F.exists("inside", has(k["info"]))).select("doc", "block", F.get("inside", F.lit(0))["href"].alias("href"),
        H.first_inside(lambda x: x["text"], has(k["date"])).alias("dates"), H.first_inside(lambda x: F.nullif(x["alt"], F.lit("")), lambda x: x["tag"] == "img").alias("alt"),
        H.first_inside(text, lambda x: x["tag"] == "h2").alias("head"), H.first_inside(text, has(k["venue"])).alias("venue"), H.first_inside(text, has(k["genre"])).alias("genre"))
    days = F.transform(F.regexp_extract_all("dates", F.lit(r"(\d{2}/\d{2}/\d{4})"), F.lit(1)), lambda d: F.try_to_date(d, "dd/MM/yyyy"))
    title = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("alt", "head"), r"\s+", " "), r"…+\s*$", "")), F.lit(""))
    href = F.regexp_replace(F.split_part("href", F.lit("?"), F.lit(1)), "/+$", "")
    out = c.select("doc", F.col("block").alias("pos"), title.alias("title"), F.try_element_at(days, F.lit(1)).alias("start"), F.try_element_at(days, F.lit(2)).alias("end"), F.lit(town).alias("town"), "venue", C.genre_category(F.col("genre")).alias("category"), href.alias("url"), F.col("genre").alias("note"))
    out = _once(out, ["url"]).where("title is not null and start is not null")
    if restricted is not None:
        there = F.coalesce(F.lower("venue").contains(restricted.lower()), F.lit(False))
        own = out.where(there)
        kept = own.where("false") if excluded is None else own.join(excluded.select(F.regexp_replace(F.split_part("href", F.lit("?"), F.lit(1)), "/+$", "").alias("url")).distinct(), "url", "left_anti").select(out.columns)
        out = out.where(~there).unionByName(kept)
    return out.withColumn("url", _absolute(F.col("url"), base))


def town_cards(raw: DataFrame, as_of: dt.date, path: str = "/event/", details: DataFrame | None = None, longest: int = 6000) -> DataFrame:
    """Links whose card is the nearest box around them, eight levels up at most, that holds a date and a known town."""
    e = _pages(raw)
    link = e.where((F.col("tag") == "a") & F.col("href").contains(path)).select("doc", F.col("pos").alias("at"), "href", F.col("text").alias("name"), F.posexplode("above").alias("level", "up"))
    box = e.where(F.length("text") <= longest).select("doc", F.col("pos").alias("up"), F.col("text").alias("block"), D.parse_date(F.col("text"), F.lit(as_of)).alias("start"), C.town_in_text(F.col("text")).alias("town"))
    # Every link is paired with the few boxes above it, by one equi-join.
    met = link.join(box.where("start is not null and town is not null"), ["doc", "up"])
    near = met.groupBy("doc", "at", "href", "name").agg(F.min_by(F.struct("up", "block", "start", "town"), "level").alias("c")).select("doc", "at", "href", "name", "c.*")
    heads = e.where(F.col("tag").isin("h2", "h3", "h4") & (F.col("text") != "") & F.col("card").isNotNull()).groupBy("doc", F.col("card").alias("up")).agg(F.min_by("text", "pos").alias("head"))
    title = F.coalesce(F.nullif("name", F.lit("")), "head")
    out = near.join(heads, ["doc", "up"], "left").select("doc", F.col("at").alias("pos"), title.alias("title"), "start", "town", T.classify(title).alias("category"), F.col("href").alias("url"), F.lit(None).cast("string").alias("venue"), D.parse_time(F.regexp_extract("block", r"(\d{1,2}\s*h\s*\d{0,2})", 1)).alias("time"), F.lit(None).cast("string").alias("note"))
    out = _once(out.where(F.length("title") >= 3), ["title", "start", "town"])
    return out if details is None else enrich(out, details)


def structured_pages(raw: DataFrame, as_of: dt.date, town: str | None = None, category: str | None = None) -> DataFrame:
    """Pages with JSON-LD; a page without any falls back to its machine-readable cards."""
    texts = raw.select("doc", F.posexplode(H.json_ld(F.col("body"))).alias("k", "json"))
    found = jsonld.events(texts).withColumn("pos", F.col("k").cast("long") * 10_000_000 + F.row_number().over(Window.partitionBy("doc", "k").orderBy("path")))
    found = found.withColumns({"town": F.coalesce(F.nullif("town", F.lit("Unknown")), F.lit(town)), "category": F.coalesce(F.lit(category), "category")})
    rest = raw.join(found.select("doc").distinct(), "doc", "left_anti")
    return shaped(_once(found, ["title", "start"])).unionByName(shaped(timed_cards(rest, as_of, town, category)))


def without_excluded(rows: DataFrame, venue: str, excluded: DataFrame | None) -> DataFrame:
    """Rows without those of a venue whose links are excluded. The list may be missing (None: the whole venue goes) or empty (nothing goes)."""
    there = F.coalesce(F.col("venue") == venue, F.lit(False))
    if excluded is None:
        return rows.where(~there)
    return rows.join(excluded.select(F.col("href").alias("url"), F.lit(venue).alias("venue")).distinct(), ["url", "venue"], "left_anti").select(rows.columns)


def enrich(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Rows with what their detail pages (url, venue, time, note) know better."""
    d = details.select("url", *[F.col(c).alias(f"d_{c}") for c in ("venue", "time", "note")])
    out = rows.join(d, "url", "left")
    return out.withColumns({c: F.coalesce(F.nullif(f"d_{c}", F.lit("")), c) for c in ("venue", "time", "note")}).drop("d_venue", "d_time", "d_note").select(rows.columns)


def enrichment_budget(rows: DataFrame, as_of: dt.date, days: int = 120, most: int = 200) -> DataFrame:
    """The rows whose detail pages are worth a request: single days first, then the soonest."""
    soon = rows.where(F.col("start") <= F.lit(as_of + dt.timedelta(days)))
    return soon.orderBy(F.col("end").isNotNull(), F.greatest("start", F.lit(as_of)), "url").limit(most)


# --- fixed values: what a line of a dance table says
_STREET = r"(?i)\s+\d+\s+(?:rue|av|avenue|bd|boulevard|place|chemin|quai)"
_POSTCODE_0406 = r"\b(0[46]\d{3})\b"
_DANCE_PRICE = r"(?i)(\d+\s*euros?(?:\s*/\s*\d+\s*euros?)?|au chapeau|chapeau|free|gratuit)"
_DANCE_DJ = r"(?i)DJ\s*:\s*(.+)$"
_DANCE_HOURS = r"(?i)from\s+([\d:apm.]+)\s+to\s+([\d:apm.]+)"


def dance_table(raw: DataFrame, as_of: dt.date, town: str = "Nice") -> DataFrame:
    """Tables of nights under day headings: a row's first cell has the hour, its last cell title, address, hours, price and DJ in one line."""
    e = _pages(raw)
    e = e.withColumn("day", F.when(F.col("tag").rlike("^h[1-6]$|^caption$"), D.parse_date(F.col("text"), F.lit(as_of))))
    cells = carry_forward(e, ["doc"], ["pos"], "day").where("tag = 'td'").groupBy("doc", F.col("parent").alias("pos"))
    r = cells.agg(F.min_by("text", "pos").alias("clock"), F.max_by("text", "pos").alias("body"), F.max("day").alias("start")).where("body <> '' and start is not null")
    get = lambda pattern, i=1: F.nullif(F.trim(F.regexp_extract("body", pattern, i)), F.lit(""))
    edges = lambda c: F.regexp_replace(c, r"^[ ,\-–]+|[ ,\-–]+$", "")
    head = F.split(F.col("body"), _POSTCODE_0406, 2)[0]
    title = edges(F.split(head, _STREET, 2)[0])
    address = F.nullif(edges(F.substring(head, F.instr(head, title) + F.length(title), F.length(head))), F.lit(""))
    code, price = get(_POSTCODE_0406), get(_DANCE_PRICE)
    start, end = D.parse_time(get(_DANCE_HOURS)), D.parse_time(get(_DANCE_HOURS, 2))
    hours = F.when(get(_DANCE_HOURS).isNull(), D.parse_time(F.col("clock"))).otherwise(F.concat(start, F.lit("–"), end))
    note = F.nullif(F.concat_ws(" · ", hours, price, F.concat(F.lit("DJ "), get(_DANCE_DJ))), F.lit(""))
    out = r.select("doc", "pos", title.alias("title"), "start", D.parse_time(F.col("clock")).alias("time"), F.coalesce(F.when(code.isNotNull(), T.canon_town(F.lit(town), code)), F.lit(town)).alias("town"), F.nullif(F.concat_ws(" · ", address, code), F.lit("")).alias("venue"), F.lit("danse").alias("category"), note.alias("note"), price.alias("price"), F.coalesce(price.rlike("(?i)chapeau|free|gratuit"), F.lit(False)).alias("free"))
    return _once(out.where("title <> ''"), ["title", "start"])


# --- JSON shapes

_WORDPRESS = (
    "array<struct<slug:string,link:string,title:struct<rendered:string>,excerpt:struct<rendered:string>,event_types:array<int>,acf:struct<place:int,free:boolean,pages:array<int>,"
    "external_link:struct<label:string,url:string>,event_dates:array<struct<start_date:string,end_date:string,start_time:string,ticketing:string>>>>>"
)


def best_url(ticket: Column, external: Column, permalink: Column, listed: Column, parent: Column, list_known: Column) -> Column:
    """Ticketing, else the external link, else the permalink if the sitemap lists it, else a parent page that resolves;
    with no sitemap to ask, the permalink as it is."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(ticket), some(external), F.when(listed, some(permalink)), some(parent), F.when(~list_known, some(permalink)))


def wordpress(raw: DataFrame, as_of: dt.date, places: DataFrame | None = None, types: DataFrame | None = None, slugs: DataFrame | None = None, parents: DataFrame | None = None, town: str | None = None) -> DataFrame:
    """Items of a WordPress listing, one row a date; places (id, name), types (id, label), sitemap slugs and parent pages (id, link) are looked up."""
    items = raw.select("doc", F.posexplode(F.from_json("body", _WORDPRESS)).alias("n", "i"))
    e = items.select("doc", "n", "i.*").select("doc", "n", "slug", "link", F.col("title.rendered").alias("title"), F.col("excerpt.rendered").alias("excerpt"), "event_types", "acf.place", "acf.free", "acf.pages", "acf.external_link.url", F.posexplode("acf.event_dates").alias("k", "d"))
    venue, label, listed, parent, known = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("string"), F.lit(slugs is not None)
    if places is not None:
        e, venue = e.join(places.select(F.col("id").alias("place"), F.col("name").alias("__venue")), "place", "left"), F.col("__venue")
    if types is not None:
        e, label = e.join(types.select(F.col("id").alias("__t"), F.col("label").alias("__label")), F.try_element_at("event_types", F.lit(1)) == F.col("__t"), "left"), F.col("__label")
    if slugs is not None:
        e, listed = e.join(slugs.select("slug", F.lit(True).alias("__listed")).distinct(), "slug", "left"), F.coalesce("__listed", F.lit(False))
    if parents is not None:
        up = e.select("doc", "n", "k", F.posexplode("pages").alias("r", "id")).join(parents.where("link is not null"), "id").groupBy("doc", "n", "k").agg(F.min_by("link", "r").alias("__parent"))
        e, parent = e.join(up, ["doc", "n", "k"], "left"), F.col("__parent")
    title = T.unescape(F.col("title"))
    start, end = D.parse_date(F.col("d.start_date"), F.lit(as_of)), D.parse_date(F.col("d.end_date"), F.lit(as_of))
    out = e.select(
        "doc", (F.col("n").cast("long") * 1_000_000 + F.col("k")).alias("pos"), title.alias("title"), start.alias("start"), F.when(end > start, end).alias("end"), D.parse_time(F.col("d.start_time")).alias("time"), F.lit(town).alias("town"), venue.alias("venue"),
        F.coalesce(T.category_from_type(label), T.classify(title, label)).alias("category"), best_url(F.col("d.ticketing"), F.col("url"), F.col("link"), listed, parent, known).alias("url"), T.visible_note(F.col("excerpt")).alias("note"), "free")
    return out.where(F.col("start").isNotNull() & ~F.col("title").rlike("(?iu)pause fra[îi]cheur"))


_RECORDS = (
    "struct<results:array<struct<title_fr:string,firstdate_begin:string,lastdate_end:string,location_name:string,location_city:string,location_postalcode:string,location_department:string,"
    "keywords_fr:array<string>,description_fr:string,canonicalurl:string>>>"
)


def open_data(raw: DataFrame, as_of: dt.date, department: str = "06") -> DataFrame:
    """Records of an open-data listing within the department; a postcode read as a number has lost its zero."""
    r = raw.select("doc", F.posexplode(F.from_json("body", _RECORDS)["results"]).alias("pos", "r")).select("doc", "pos", "r.*")
    code = F.lpad("location_postalcode", 5, "0")
    (start, time), (end, _) = D.iso_parts(F.col("firstdate_begin")), D.iso_parts(F.col("lastdate_end"))
    words = F.concat_ws(" ", "keywords_fr")
    out = r.select("doc", "pos", F.col("title_fr").alias("title"), start.alias("start"), F.when(end > start, end).alias("end"), time.alias("time"), T.canon_town(F.col("location_city"), code).alias("town"), F.col("location_name").alias("venue"), T.classify(F.col("title_fr"), words).alias("category"), F.col("canonicalurl").alias("url"), T.visible_note(F.col("description_fr")).alias("note"), code.alias("code"))
    out = out.where(F.col("start").isNotNull() & (F.col("code").isNull() | F.col("code").startswith(department)))
    return _once(out, ["url", "start"]).drop("code")


def state_objects(raw: DataFrame, as_of: dt.date, town: str | None = None) -> DataFrame:
    """Pages that carry their state as JSON: every object with a title or name and a time is an event, at any depth. An online event has no
    town; a page without any falls back to its dated cards."""
    texts = raw.select("doc", H.next_data(F.col("body")).alias("json")).where("json is not null")
    o = jsonld.objects(texts)
    title = F.trim(F.coalesce(F.nullif(jsonld.get("$.title"), F.lit("")), jsonld.get("$.name")))
    moment = F.coalesce(jsonld.get("$.dateTime"), jsonld.get("$.startTime"), F.when(jsonld.get("$.eventUrl").isNotNull(), jsonld.get("$.time")), F.when(jsonld.get("$.title").isNotNull(), jsonld.get("$.date")))
    day, clock = D.iso_parts(moment)
    venue, city = jsonld.get("$.venue.name"), F.coalesce(jsonld.get("$.venue.city"), jsonld.get("$.venue.area.name"))
    artists = F.transform(F.slice(F.coalesce(jsonld.get("$.artists", "array<variant>"), F.array().cast("array<variant>")), 1, 6), lambda a: F.try_variant_get(a, "$.name", "string"))
    online = T.is_online(title, venue, jsonld.get("$.eventType"), jsonld.get("$.isOnline", "boolean"))
    out = o.select(
        "doc", F.row_number().over(Window.partitionBy("doc").orderBy("path")).alias("pos"), title.alias("title"), day.alias("start"), clock.alias("time"), F.when(online, F.lit("Online")).otherwise(T.canon_town(F.coalesce(city, F.lit(town)))).alias("town"), F.coalesce(venue, F.when(online, F.lit("Online event"))).alias("venue"),
        T.classify(title, venue).alias("category"), F.coalesce(jsonld.get("$.eventUrl"), jsonld.get("$.url"), jsonld.get("$.contentUrl")).alias("url"), F.coalesce(T.visible_note(jsonld.get("$.description")), F.nullif(F.array_join(artists, ", "), F.lit(""))).alias("note"),
        F.coalesce(jsonld.get("$.isFree", "boolean"), F.lit(False)).alias("free"), online.alias("online"))
    found = _once(out.where("title is not null and start is not null"), ["title", "start"])
    rest = raw.join(found.select("doc").distinct(), "doc", "left_anti")
    return shaped(found).unionByName(shaped(text_dated(rest, as_of, town)))


_SUBMISSIONS = "array<struct<id:string,title:string,start_date:date,end_date:date,time:string,town:string,venue:string,category:string,url:string,note:string,approved:boolean>>"


def submissions(raw: DataFrame, as_of: dt.date) -> DataFrame:
    """Approved submissions; no personal column is read."""
    s = raw.select("doc", F.posexplode(F.from_json("body", _SUBMISSIONS)).alias("pos", "s")).select("doc", "pos", "s.*")
    return s.where("approved").select("doc", "pos", "title", F.col("start_date").alias("start"), F.col("end_date").alias("end"), "time", "town", "venue", "category", "url", "note", F.col("id").alias("submitted_by"), F.lit(True).alias("approved"))


# --- calendars and tables


def calendar(raw: DataFrame, as_of: dt.date, town: str | None = None, category: str | None = None, expand: bool = True, coarse: bool = False) -> DataFrame:
    """Calendar feeds; each document is a feed, in their order."""
    feeds = raw.select(F.col("doc").alias("feed"), F.col("doc").alias("feed_rank"), "source", "body", "url").withColumns({"town": F.lit(town).cast("string"), "category": F.lit(category).cast("string")})
    e = ics.events(feeds, as_of, expand, coarse, ranked=True)
    return e.withColumns({"doc": F.col("feed"), "pos": F.col("seq").cast("long") * 1_000_000 + F.least(F.greatest(F.datediff("start", F.lit(as_of)) + 300_000, F.lit(0)), F.lit(999_999))})


def table(raw: DataFrame, as_of: dt.date) -> DataFrame:
    """Curated rows, one JSON object a line; a time written in the note moves to its field."""
    t = raw.select("doc", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    schema = "start date, end date, title string, town string, venue string, category string, note string, url string, free boolean, price string"
    t = t.select("doc", "pos", F.from_json("line", schema).alias("r")).select("doc", "pos", "r.*").where("title is not null")
    return t.withColumn("time", D.parse_time(F.regexp_extract("note", r"(\d{1,2}h\d{0,2})", 1)))


def _filled_in(template: str | None, fields: Column) -> Column:
    """A template with each {name} replaced by that field; null if there is no template or one of its fields is missing."""
    if template is None:
        return F.lit(None).cast("string")
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.try_element_at(fields, F.lit(p)) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def templated_table(raw: DataFrame, as_of: dt.date, title: str = "{title}", note: str | None = None, url: str | None = None, town: str = "{town}", venue: str | None = "{venue}", category: str | None = None, free: bool | None = None) -> DataFrame:
    """A programme of nights, one JSON object a line with ``start`` and any other fields, which templates put together: a price can go into the note."""
    t = raw.select("doc", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    t = t.select("doc", "pos", F.from_json("line", "map<string,string>").alias("f")).where("f is not null")
    name, place = _filled_in(title, F.col("f")), _filled_in(venue, F.col("f"))
    out = t.select(
        "doc", "pos", name.alias("title"), F.try_to_date(F.try_element_at("f", F.lit("start"))).alias("start"), _filled_in(town, F.col("f")).alias("town"), F.nullif(place, F.lit("")).alias("venue"), F.coalesce(F.lit(category), T.classify(name)).alias("category"),
        _filled_in(url, F.col("f")).alias("url"), F.nullif(_filled_in(note, F.col("f")), F.lit("")).alias("note"), F.coalesce(F.lit(free), F.try_element_at("f", F.lit("free")) == "true", F.lit(False)).alias("free"))
    return out.where("title is not null and start is not null")


def default_registry() -> Registry:
    """A source for each shape, under its shape's name."""
    r = Registry()
    r.add(
        Source("curated", table, delay=0), Source("programmes", partial(templated_table, note="{price}", url="{url}"), delay=0), Source("heading_dated", heading_dated, delay=2.0), Source("dance_table", dance_table, delay=2.0), Source("wordpress", wordpress), Source("open_data", open_data, delay=0.5), Source("timed_cards", timed_cards, delay=1.5),
        Source("structured_pages", structured_pages), Source("text_dated", text_dated, needs_browser=True), Source("season_calendar", partial(season_calendar, season_start=2026), reconciles=True),
        Source("calendars", calendar, reconciles=True), Source("plain_calendars", partial(calendar, expand=False, coarse=True)), Source("dance_calendars", partial(calendar, expand=False, coarse=True, category="danse")),
        Source("sale_listing", sale_listing, delay=1.5), Source("place_cards", place_cards, delay=0.6), Source("genre_cards", genre_cards, needs_browser=True), Source("town_cards", town_cards, needs_browser=True),
        Source("season_programme", partial(season_programme, town="Antibes"), reconciles=True), Source("state_objects", state_objects, needs_browser=True), Source("submissions", submissions, delay=0),
    )
    return r
