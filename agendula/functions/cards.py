"""Expressions for the lines of listing cards, detail pages, flyers and feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates as D
from . import fixed as X
from . import text as T


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def town_in_text(text: Column) -> Column:
    """The known town of most words that a text names as whole words; the first named among equals."""
    longest = max(k.count("-") + 1 for k in X.TOWNS)

    def named(words: Column) -> Column:
        sizes = [F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), _gram(words, n)) for n in range(longest, 0, -1)]
        return F.try_element_at(F.filter(F.transform(F.flatten(F.array(*sizes)), lambda g: F.try_element_at(_map(X.TOWNS), g)), lambda t: t.isNotNull()), F.lit(1))

    return T.let(F.split(T.slugify(text), "-"), named)


def _gram(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), "-")


def in_scope(location: Column, postcode: Column, department: str = "06") -> Column:
    """A named foreign country or another department's postcode is out; no address is in."""
    abroad = F.coalesce(location, F.lit("")).rlike(X.ABROAD)
    return ~abroad & F.coalesce(postcode.startswith(department), F.lit(True))


def commune_of_place(place: Column, default: str) -> Column:
    """The commune of 'Commune - Venue' or of a known venue's name alone."""
    folded = T.fold(place)
    known = F.coalesce(*[F.when(folded.contains(k), F.lit(v)) for k, v in X.VENUE_COMMUNES.items()])
    return F.when(F.coalesce(F.trim(place), F.lit("")) == "", F.lit(default)).otherwise(F.coalesce(known, T.canon_town(F.trim(F.split_part(place, F.lit(" - "), F.lit(1))))))


def genre_category(genre: Column) -> Column:
    """A theatre portal's genre: music and dance go their way, the rest is the stage."""
    g = F.lower(F.coalesce(genre, F.lit("")))
    return F.when(g.rlike("concert|jazz|musique"), "concert").when(g.rlike("danse|hip-hop"), "danse").otherwise("scene")


def clean_venue(venue: Column) -> Column:
    """A place name, or null for what is too long or looks like code."""
    v = F.trim(venue)
    return F.when((v != "") & (F.length(v) <= 90) & ~v.rlike(X.NO_VENUE), v)


def sale_card(block: Column) -> dict[str, Column]:
    """Postcode, venue and note ('Brocante · ~80 exhibitors') of a flea-market card: 'code - kind - venue', size bullets."""
    text = T._squeeze(block)
    part = lambda i: F.regexp_extract(text, X.SALE_LINE, i)
    kind = F.coalesce(F.try_element_at(_map(X.SALE_KINDS), F.replace(F.lower(F.trim(part(2))), F.lit("é"), F.lit("e"))), F.nullif(F.trim(part(2)), F.lit("")), F.lit("Vide-grenier"))
    count = F.regexp_extract(F.when(part(1) != "", F.replace(text, part(1), F.lit(""))).otherwise(text), X.SALE_COUNT, 1)
    bullets = F.length(text) - F.length(F.replace(text, F.lit("•"), F.lit("")))
    size = F.concat(F.element_at(F.array(*map(F.lit, X.SALE_SIZES)), F.greatest(F.least(bullets, F.lit(4)), F.lit(1))), F.lit(" market"))
    extra = F.when(count != "", F.concat(F.lit("~"), count, F.lit(" exhibitors"))).when(bullets > 0, size)
    return {"postcode": F.nullif(part(1), F.lit("")), "venue": clean_venue(part(3)), "note": F.concat_ws(" · ", kind, extra)}


def without_town(title: Column, town: Column) -> Column:
    """A title without the town it begins with."""
    starts = (town != "") & T.fold(title).startswith(T.fold(town))
    rest = F.regexp_replace(F.substring(title, F.length(town) + F.lit(1), F.length(title)), r"^[ \-–—]+|[ \-–—]+$", "")
    return F.coalesce(F.nullif(F.when(starts, rest).otherwise(title), F.lit("")), title)


def venue_of_address(address: Column, street: Column, postcode: Column, town: Column, most: int = 120) -> Column:
    """The venue's name in an address line: what is left without street, postcode and town; else the street.

    Where a postcode is still there, the rest from the street number on goes too.
    """
    some = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("\x00"))
    rest = address
    for known in (street, postcode, town):
        rest = F.replace(rest, some(known), F.lit(" "))
    trimmed = lambda c: F.regexp_replace(T._squeeze(c), r"^[ ,\-]+|[ ,\-]+$", "")

    def cut(v: Column) -> Column:
        return F.when(v.rlike(r"\b\d{5}\b"), trimmed(F.regexp_replace(F.when(v.rlike(r"\s\d+\s+\S"), F.regexp_replace(v, r"(?s)\s+\d+\s+\S.*$", "")).otherwise(v), r"(?s)\s*\b\d{5}\b.*$", ""))).otherwise(v)

    return F.substring(F.coalesce(F.nullif(T.let(trimmed(F.coalesce(rest, F.lit(""))), cut), F.lit("")), F.nullif(F.trim(street), F.lit(""))), 1, most)


def flyer_fields(text: Column, as_of: Column) -> Column:
    """Title, date, time, town, category and note guessed from a poster's text."""
    folded = T.fold(text)
    months = _map(X.MONTHS | X.FLYER_MONTHS)
    roll = lambda m, d: F.year(as_of) + F.when((m < F.month(as_of)) | ((m == F.month(as_of)) & (d < F.day(as_of))), 1).otherwise(0)
    number = lambda c: F.nullif(c, F.lit("")).cast("int")

    def fields(f: Column) -> Column:
        named, slashed = X.FLYER_DAY_NAMED, X.FLYER_DAY_SLASHED
        get = lambda p, i: F.regexp_extract(f, p, i)
        month = F.try_element_at(months, get(named, 2))
        year = number(get(slashed, 3))
        full = F.when(year < 100, year + 2000).otherwise(year)
        m, d = number(get(slashed, 2)), number(get(slashed, 1))
        date = F.when(month.isNotNull(), D._date(F.coalesce(number(get(named, 3)), roll(month, number(get(named, 1)))), month, number(get(named, 1)))).otherwise(D._date(F.coalesce(full, roll(m, d)), m, d))
        category = F.coalesce(*[F.when(f.rlike(p), F.lit(k)) for p, k in X.FLYER_PATTERNS])
        return F.struct(date.alias("date"), D.parse_time(f).alias("time"), category.alias("category"))

    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: (F.length(s) >= 4) & ~s.rlike(X.FLYER_NO_TITLE))
    shouted = F.filter(lines, lambda s: s == F.upper(s))
    title = F.substring(F.coalesce(F.try_element_at(shouted, F.lit(1)), F.try_element_at(lines, F.lit(1))), 1, 120)
    guessed = T.let(folded, fields)
    return F.struct(title.alias("title"), guessed["date"].alias("date"), guessed["time"].alias("time"), town_in_text(text).alias("town"), guessed["category"].alias("category"), F.substring(T._squeeze(text), 1, 300).alias("note"))


def first_present(*values: Column) -> Column:
    """The first value that is there and not empty, as feeds name one field in several ways."""
    return F.coalesce(*[F.when(F.trim(v.cast("string")) != "", v.cast("string")) for v in values])
