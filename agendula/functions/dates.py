"""Date and time expressions. Nothing reads the clock: what depends on today takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import let


def _date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where there is no such day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd")


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def _month(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in X.MONTHS.items() for x in kv]), F.lower(name))


def rolling_year(month: Column, as_of: Column) -> Column:
    """A month without a year is the next to come, this month included."""
    return F.year(as_of) + F.when(month >= F.month(as_of), 0).otherwise(1)


def parse_date(text: Column, as_of: Column, default_year: Column | None = None) -> Column:
    """ISO, compact, slashed or dotted, day-month and month-day names. A shape that matches but is no date gives null."""
    s = F.trim(text.cast("string"))
    get = lambda p, i: F.regexp_extract(s, p, i)
    iso, compact, slash = X.ISO_DATE, X.COMPACT_DATE, X.SLASH_DATE
    day_first, month_first = X.DAY_FIRST, X.MONTH_FIRST

    def named(p: str, day: int, name: int) -> tuple[Column, Column]:
        m = _month(get(p, name))
        year = F.coalesce(_int(get(p, 3)), *([default_year] if default_year is not None else []), rolling_year(m, as_of))
        return m.isNotNull(), _date(year, m, _int(get(p, day)))

    known, dm = named(day_first, 1, 2)
    known2, md = named(month_first, 2, 1)
    return (
        F.when(s.rlike(iso), _date(_int(get(iso, 1)), _int(get(iso, 2)), _int(get(iso, 3))))
        .when(s.rlike(compact), _date(_int(get(compact, 1)), _int(get(compact, 2)), _int(get(compact, 3))))
        .when(s.rlike(slash), _date(_int(get(slash, 3)), _int(get(slash, 2)), _int(get(slash, 1))))
        .when(known, dm)
        .when(known2, md)
    )


def parse_time(text: Column) -> Column:
    """HH:MM of '8:30pm', '19h', '19h30' or '19:30'."""
    s = F.lower(F.trim(text.cast("string")))
    half, full = X.HALF_DAY_CLOCK, X.DAY_CLOCK
    get = lambda p, i: F.regexp_extract(s, p, i)
    minute = lambda p: F.coalesce(_int(get(p, 2)), F.lit(0))
    noon = F.when(get(half, 3) == "pm", 12).otherwise(0)
    hour = _int(get(full, 1))
    return F.when(s.rlike(half), F.format_string("%02d:%02d", _int(get(half, 1)) % 12 + noon, minute(half))).when(
        s.rlike(full) & (hour <= 23) & (minute(full) <= 59), F.format_string("%02d:%02d", hour, minute(full))
    )


def ics_moment(value: Column, zone: str = X.TIME_ZONE) -> Column:
    """Struct (day, clock), the local date and HH:MM or null, of a calendar value; UTC is converted, midnight means no time. Null for what is no value."""

    def timed(s: Column, day: Column) -> Column:
        moment = F.concat(day, F.lit(" "), F.substring(s, 10, 2), F.lit(":"), F.substring(s, 12, 2), F.lit(":00")).try_cast("timestamp_ntz")
        local = F.when(s.rlike(X.CALENDAR_UTC), F.convert_timezone(F.lit("UTC"), F.lit(zone), moment)).otherwise(moment)
        return let(local, lambda m: F.struct(F.to_date(m).alias("day"), F.nullif(F.date_format(m, "HH:mm"), F.lit("00:00")).alias("clock")))

    def whole(s: Column) -> Column:
        day = F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 5, 2), F.lit("-"), F.substring(s, 7, 2))
        return F.when(s.rlike(X.CALENDAR_CLOCK), timed(s, day)).when(s.rlike(X.CALENDAR_DAY), F.struct(day.try_cast("date").alias("day"), F.lit(None).cast("string").alias("clock")))

    return let(F.trim(value), whole)


def ics_datetime(value: Column, zone: str = X.TIME_ZONE) -> tuple[Column, Column]:
    """(local date, HH:MM or null) of a calendar value."""
    moment = ics_moment(value, zone)
    return moment["day"], moment["clock"]


def ics_end(start: Column, end: Column, zone: str = X.TIME_ZONE, coarse: bool = False) -> Column:
    """Last day to show, or null for one day. A bare end date is exclusive; an end before dawn belongs to its evening (``coarse``: any hour)."""

    def shown(first: Column, last: Column, clock: Column) -> Column:
        dawn = F.lit(True) if coarse else clock.isNull() | (clock < "06:00")
        return F.when(~F.upper(end).contains("T"), F.date_sub(last, 1)).when((F.datediff(last, first) == 1) & dawn, first).otherwise(last)

    def later(m: Column) -> Column:
        return let(shown(m["first"]["day"], m["last"]["day"], m["last"]["clock"]), lambda day: F.when(day > m["first"]["day"], day))

    # Most entries have no end.
    return F.when(end.isNotNull(), let(F.struct(ics_moment(start, zone).alias("first"), ics_moment(end, zone).alias("last")), later))


def paris_offset(day: Column, zone: str = X.TIME_ZONE) -> Column:
    """+HH:MM of the zone at noon of a day."""
    noon = F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), F.lit(12), F.lit(0), F.lit(0))
    minutes = F.timestamp_diff("MINUTE", noon, F.convert_timezone(F.lit("UTC"), F.lit(zone), noon))
    return F.concat(F.when(minutes < 0, "-").otherwise("+"), F.format_string("%02d:%02d", (F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int")))


def ld_datetime(day: Column, time: Column) -> Column:
    return F.when(F.nullif(time, F.lit("")).isNull(), day.cast("string")).otherwise(F.concat(day.cast("string"), F.lit("T"), time, F.lit(":00"), paris_offset(day)))


def short_day(day: Column) -> Column:
    return F.date_format(day, "d MMM")


def long_day(day: Column) -> Column:
    return F.date_format(day, "EEEE d MMMM")


def until(end: Column) -> Column:
    return F.when(end.isNull(), F.lit("on now")).otherwise(F.concat(F.lit("until "), short_day(end)))


def weekend(as_of: Column) -> tuple[Column, Column]:
    """The coming Saturday (today if it is one) and its Sunday."""
    saturday = F.next_day(F.date_sub(as_of, 1), "SAT")
    return saturday, F.date_add(saturday, 1)


def season_year(month: Column, season_start: Column) -> Column:
    return season_start + F.when(month >= 9, 0).otherwise(1)


def feed_moment(text: Column) -> Column:
    """A feed's own time: ISO, day first, or seconds since 1970."""
    s = F.trim(text.cast("string"))
    shapes = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]
    epoch = F.when(s.rlike(r"^\d{9,13}$"), F.timestamp_seconds(F.substring(s, 1, 10).cast("long")))
    return F.coalesce(epoch, *[F.try_to_timestamp(s, F.lit(p)) for p in shapes])


def iso_parts(text: Column) -> tuple[Column, Column]:
    """(date, HH:MM) cut from an ISO string without its offset; midnight means no time."""
    clock = F.substring(text, 12, 5)
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.when(clock.rlike(r"^\d{2}:\d{2}$") & (clock != "00:00"), clock)


def nth_weekday(month_start: Column, weekday: str, n: int) -> Column:
    """The n-th (negative: from the end) weekday of a month, null if it has none."""
    if n > 0:
        day = F.date_add(F.next_day(F.date_sub(month_start, 1), weekday), 7 * (n - 1))
    else:
        day = F.date_add(F.date_sub(F.next_day(F.last_day(month_start), weekday), 7), 7 * (n + 1))
    return F.when(F.trunc(day, "month") == F.trunc(month_start, "month"), day)
