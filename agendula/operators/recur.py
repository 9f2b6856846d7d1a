"""Recurrence rules: DAILY, WEEKLY and MONTHLY with INTERVAL, BYDAY, COUNT and UNTIL, as sequences and one window.

Each rule's candidate days are generated between its start and the window's end; COUNT is used up by days before the window and by
excluded days alike, so it is applied before either filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.text import let

_DAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]


def _part(rrule: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(F.concat(F.lit(";"), F.upper(rrule), F.lit(";")), f";{name}=([^;]*);", 1), F.lit(""))


def parse_rule(rrule: Column) -> Column:
    until = _part(rrule, "UNTIL")
    return F.struct(
        _part(rrule, "FREQ").alias("freq"),
        F.greatest(F.coalesce(_part(rrule, "INTERVAL").try_cast("int"), F.lit(1)), F.lit(1)).alias("step"),
        F.when(_part(rrule, "COUNT").rlike(r"^\d+$"), _part(rrule, "COUNT").try_cast("int")).alias("count"),
        F.try_to_date(F.substring(until, 1, 8), "yyyyMMdd").alias("until"),
        F.filter(F.split(F.coalesce(_part(rrule, "BYDAY"), F.lit("")), ","), lambda d: d != "").alias("days"),
    )


def _every(low: Column, high: Column, days: Column) -> Column:
    """low, low + days, ... up to high."""
    n = F.floor(F.datediff(high, low) / days).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.date_add(low, i * days))).otherwise(F.array().cast("array<date>"))


def _monthly(first: Column, day: Column, tokens: Column) -> Column:
    """Days of one month that BYDAY tokens (nth, wanted) name; without tokens the day of the month, if it is there."""
    plain = F.date_add(first, day - 1)
    plain = F.when(F.month(plain) == F.month(first), F.array(plain)).otherwise(F.array().cast("array<date>"))

    def one(t: Column) -> Column:
        offset = F.pmod(t["wanted"] - 1 - F.weekday(first), F.lit(7)).cast("int")
        at_day = lambda low, n: F.date_add(low, ((n - 1) * 7).cast("int"))

        def from_first(low: Column) -> Column:
            count = F.when(F.date_add(low, 28) <= F.last_day(low), 5).otherwise(4)
            at = F.when(t["nth"] < 0, count + t["nth"] + 1).otherwise(t["nth"])
            return F.when(t["nth"] == 0, F.transform(F.sequence(F.lit(1), count), lambda n: at_day(low, n))).when((at >= 1) & (at <= count), F.array(at_day(low, at))).otherwise(F.array().cast("array<date>"))

        return F.when(t["wanted"] == 0, F.array().cast("array<date>")).otherwise(let(F.date_add(first, offset), from_first))

    return F.when(F.size(tokens) == 0, plain).otherwise(F.array_sort(F.flatten(F.transform(tokens, one))))


def rule_dates(start: Column, rrule: Column, exdates: Column, low: Column, high: Column) -> Column:
    """Ascending days of a rule within [low, high], without the excluded ones. Rules of another FREQ give none."""
    return let(parse_rule(rrule), lambda r: _dates(r, start, exdates, low, high))


def _token(t: Column) -> Column:
    part = lambda i: F.regexp_extract(t, r"^(-?\d)?([A-Z]{2})$", i)
    return F.struct(F.coalesce(F.nullif(part(1), F.lit("")).cast("int"), F.lit(0)).alias("nth"), F.array_position(F.array(*map(F.lit, _DAYS)), part(2)).cast("int").alias("wanted"))


def _dates(r: Column, start: Column, exdates: Column, low: Column, high: Column) -> Column:
    end = F.least(high, F.coalesce(r["until"], high))
    monday = F.date_sub(start, F.weekday(start))
    week_days = F.when(F.size(r["days"]) > 0, F.array_sort(F.transform(r["days"], lambda d: (F.array_position(F.array(*map(F.lit, _DAYS)), F.right(d, F.lit(2))) - 1).cast("int")))).otherwise(F.array(F.weekday(start)))
    weekly = let(F.filter(week_days, lambda d: d >= 0), lambda days: F.flatten(F.transform(_every(monday, end, r["step"] * 7), lambda w: F.transform(days, lambda d: F.date_add(w, d)))))
    month = F.trunc(start, "month")
    months = F.floor(F.months_between(F.trunc(end, "month"), month) / r["step"]).cast("int")
    starts = F.when(months >= 0, F.transform(F.sequence(F.lit(0), months), lambda i: F.add_months(month, i * r["step"]))).otherwise(F.array().cast("array<date>"))
    # Tokens are read once a rule, not once a month.
    monthly = let(F.transform(r["days"], _token), lambda tokens: F.flatten(F.transform(starts, lambda m: _monthly(m, F.day(start), tokens))))
    found = F.when(r["freq"] == "DAILY", _every(start, end, r["step"])).when(r["freq"] == "WEEKLY", weekly).when(r["freq"] == "MONTHLY", monthly).otherwise(F.array().cast("array<date>"))
    found = F.filter(found, lambda d: (d >= start) & (d <= end))
    counted = F.when(r["count"].isNotNull() & (r["count"] > 0), F.slice(found, F.lit(1), F.greatest(r["count"], F.lit(1)))).otherwise(found)
    excluded = F.coalesce(exdates, F.array().cast("array<date>"))
    return F.filter(counted, lambda d: (d >= low) & ~F.array_contains(excluded, d))


def occurrence_values(dtstart: Column, rrule: Column, exdates: Column, as_of: Column, days: int = X.RRULE_DAYS) -> Column:
    """Calendar start values an entry resolves to: its own, or one for each day of its rule with the clock time carried over."""
    raw = F.try_to_date(F.substring(dtstart, 1, 8), "yyyyMMdd")
    clock = F.regexp_extract(dtstart, r"T(\d{4,6})", 1)
    tail = F.when(clock == "", F.lit("")).otherwise(F.concat(F.lit("T"), F.rpad(clock, 6, "0"), F.when(F.rtrim(dtstart).endswith("Z"), "Z").otherwise("")))
    dates = rule_dates(raw, rrule, exdates, as_of, F.date_add(as_of, days))
    many = F.transform(dates, lambda d: F.concat(F.date_format(d, "yyyyMMdd"), tail))
    single = F.when(F.nullif(dtstart, F.lit("")).isNull(), F.array().cast("array<string>")).otherwise(F.array(dtstart))
    return F.when(F.nullif(rrule, F.lit("")).isNull(), single).when(raw.isNull(), F.array().cast("array<string>")).otherwise(many)


def excluded_days(exdate: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(exdate, F.lit("")), ","), lambda t: F.try_to_date(F.substring(F.trim(t), 1, 8), "yyyyMMdd")), lambda d: d.isNotNull())


def resolve_overrides(rows: DataFrame, ranked: bool = False) -> DataFrame:
    """Rows (feed, feed_rank, seq, fingerprint, is_override): one a fingerprint. In a feed the first override, else the first row; of feeds the first.

    ``ranked``: no two feeds have one rank, so that one order says both and rows are shuffled once.
    """
    from .sequences import first_of

    if ranked:
        return first_of(rows, ["fingerprint"], ["feed_rank", F.desc("is_override"), "seq"])
    own = first_of(rows, ["feed", "fingerprint"], [F.desc("is_override"), "seq"])
    return first_of(own, ["fingerprint"], ["feed_rank", "seq"])


