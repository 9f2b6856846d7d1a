"""Operators over ordered rows: title roots, overlapping and consecutive runs, folding of recurrences, slugs, occurrences, carried headings.

Every order ends in the fingerprint, so results do not depend on how rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fixed as X
from ..functions import text as T
from ..lineage import cut
from .ranking import numbered

_PRIOR = (Window.unboundedPreceding, -1)


def prefixes(key: Column, words: int = 3, least: int = 8) -> Column:
    """The proper word prefixes of a slug with so many words and characters at least, the shortest first."""
    parts = F.split(key, "-")
    ends = F.when(F.size(parts) > words, F.sequence(F.lit(words), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(ends, lambda n: F.array_join(F.slice(parts, 1, n), "-")), lambda p: F.length(p) >= least)


def title_roots(events: DataFrame, key: str = "key", group: str = "town") -> DataFrame:
    """Distinct (group, key) with root: the shortest key of the group that the key continues, else itself.

    Each key's prefixes are joined with the keys that are there, so the work is linear in words, not quadratic in keys.
    """
    keys = events.select(group, key).distinct()
    tried = keys.select(group, key, F.explode(prefixes(F.col(key))).alias("root"))
    there = keys.select(F.col(group).alias("__g"), F.col(key).alias("__k"))
    found = tried.join(there, (F.col(group).eqNullSafe(F.col("__g"))) & (F.col("root") == F.col("__k")), "left_semi")
    best = found.groupBy(F.col(group).alias("__g"), F.col(key).alias("__k")).agg(F.min_by("root", F.length("root")).alias("root"))
    return keys.join(best, F.col(group).eqNullSafe(F.col("__g")) & (F.col(key) == F.col("__k")), "left").select(group, key, F.coalesce("root", key).alias("root"))


def islands(rows: DataFrame, by: list[str], start: Column, end: Column, tie: list[str], gap: int | None = None, name: str = "island") -> DataFrame:
    """``rows`` with the number (from 1) of their run among overlapping intervals; with ``gap``, of intervals at most so many days apart."""
    order = Window.partitionBy(*by).orderBy(start, end, *tie)
    reach = F.max(end).over(order.rowsBetween(*_PRIOR))
    apart = (F.datediff(start, reach) > gap) if gap is not None else (start > reach)
    new = F.when(reach.isNull() | apart, 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn(name, F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


#: Fields that a merged row takes from its first member that has them.
FILLED = ("venue", "note", "url", "time", "category", "image")


def merge_rows(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """One row a group: the first member's, with empty fields filled from later ones, flags of any, and the last end."""
    rows = rows.withColumn("__order", order).withColumn("__last", F.coalesce("end", "start"))
    fixed = {c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__order"))).alias(c) for c in FILLED if c in rows.columns}
    fixed |= {c: F.bool_or(c).alias(c) for c in ("free", "outdoor") if c in rows.columns}
    columns = [c for c in rows.columns if c not in (*by, "__order", "__last", "end")]
    out = rows.groupBy(*by).agg(*[fixed.get(c, F.min_by(c, "__order").alias(c)) for c in columns], F.max("__last").alias("end"), F.count(F.lit(1)).alias("members"))
    return out.withColumn("end", F.when(F.col("end") > F.col("start"), F.col("end")))


def collapse_overlaps(events: DataFrame) -> DataFrame:
    """Rows of one title root and town whose dates overlap become one row."""
    e = events.withColumn("__key", T.title_key(F.col("title")))
    roots = title_roots(e.select(F.col("town"), F.col("__key").alias("key")))
    e = e.join(roots.withColumnRenamed("town", "__town"), (F.col("__key") == F.col("key")) & F.col("town").eqNullSafe(F.col("__town"))).drop("key", "__town", "__key")
    last = F.coalesce("end", "start")
    e = islands(e.withColumnRenamed("root", "__root"), ["__root", "town"], F.col("start"), last, ["fingerprint"], name="__n")
    e = e.withColumn("__town", F.col("town"))
    merged = merge_rows(e, ["__root", "__town", "__n"], F.struct(F.col("start"), last, F.col("fingerprint")))
    return merged.select(*events.columns)


def consecutive_blocks(events: DataFrame, by: list[str], name: str = "block") -> DataFrame:
    """``events`` with the number of their block: consecutive nights under one url.

    A row goes on with the last block if it starts at most a day after the block's end and has no url or one that is in it. So all urls
    of a block are that of its first row, and a block whose first row has none ends at the next that has one.

    Nothing is gathered: a url that differs from the last one always begins a block, and between such rows gaps of dates do, both told by
    windows. Where a gap leaves a piece that begins without a url and has one later, that is cut and its dates are looked at again, until
    there is none; as a rule there is none at once.
    """
    last = F.coalesce("end", "start")
    e = islands(events, by, F.col("start"), last, ["fingerprint"], gap=1, name="__cell").withColumn("__cell", F.array(F.col("__cell").cast("int")))
    while True:
        order = Window.partitionBy(*by, "__cell").orderBy("start", last, "fingerprint")
        url = F.last("url", ignorenulls=True).over(order.rowsBetween(*_PRIOR))
        new = F.col("url").isNotNull() & (F.row_number().over(order) > 1) & (url.isNull() | (url != F.col("url")))
        e = e.withColumn("__new", new.cast("int"))
        e = e.withColumn("__part", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        e = islands(e, [*by, "__cell", "__part"], F.col("start"), last, ["fingerprint"], gap=1, name="__piece")
        e = e.withColumn("__cell", F.concat("__cell", F.array("__part", F.col("__piece").cast("int")))).drop("__new", "__part", "__piece")
        began = F.first("url").over(Window.partitionBy(*by, "__cell").orderBy("start", last, "fingerprint"))
        e = cut(e.withColumn("__again", F.col("url").isNotNull() & began.isNull()), "blocks")
        if e.where("__again").select("__again").isEmpty():
            break
        e = e.drop("__again")
    return e.withColumn(name, F.col("__cell")).drop("__cell", "__again")


def fold_recurring(events: DataFrame, as_of: Column, near: int = X.NEAR_DAYS) -> DataFrame:
    """Recurring events (title, venue, town): consecutive nights are one row; rows starting beyond ``near`` days fold into one
    that says on which other dates it is. An event that is alone in its group stays as it is, however far.
    """
    e = events.withColumns({"__k": T.title_key(F.col("title")), "__v": T.slugify(F.col("venue")), "__t": F.col("town")})
    loose = e.where(F.col("__v") == "").drop("__k", "__v", "__t").withColumn("recurring", F.lit(False))
    keyed = consecutive_blocks(e.where(F.col("__v") != ""), ["__k", "__v", "__t"], "__block")
    order = F.struct(F.col("start"), F.coalesce("end", "start"), F.col("fingerprint"))
    rows = merge_rows(keyed, ["__k", "__v", "__t", "__block"], order)
    rows = cut(rows.withColumn("__all", F.sum("members").over(Window.partitionBy("__k", "__v", "__t"))).drop("members"), "runs")
    is_near = (F.col("start") <= F.date_add(as_of, near)) | (F.col("__all") == 1)
    far = rows.where(~is_near)
    dates = F.transform(F.array_sort(F.collect_set("start")), D.short_day)
    more = far.groupBy("__k", "__v", "__t").agg(dates.alias("__dates"))
    folded = merge_rows(far.withColumn("__first_end", F.col("end")), ["__k", "__v", "__t"], order).drop("end", "members").withColumnRenamed("__first_end", "end")
    folded = folded.join(more, [c for c in ("__k", "__v", "__t")])
    others = F.size("__dates") - 1
    also = F.concat(F.lit("Also on "), F.array_join(F.slice("__dates", 2, 4), ", "), F.when(others > 4, F.format_string(" +%d more", others - 4)).otherwise(""))
    folded = folded.withColumns({"note": F.when(others > 0, F.concat_ws(" · ", F.nullif(F.col("note"), F.lit("")), also)).otherwise(F.col("note")), "recurring": F.lit(True)})
    names = [*events.columns, "recurring"]
    out = rows.where(is_near).withColumn("recurring", F.lit(False)).select(*names)
    return loose.select(*names).unionByName(out).unionByName(folded.select(*names))


def assign_slugs(events: DataFrame) -> DataFrame:
    """``events`` with a unique slug: the n-th of one base gets -n; reserved pages count as the first."""
    base = F.coalesce(F.nullif(T.card_slug(F.col("title")), F.lit("")), F.substring(F.coalesce(F.nullif(F.col("fingerprint"), F.lit("")), F.lit("event")), 1, 8))
    e = numbered(events.withColumn("__base", base), ["__base"], ["start", "title", "fingerprint"], "__n")
    e = e.withColumn("__n", F.col("__n") + F.when(F.col("__base").isin(X.RESERVED_SLUGS), 1).otherwise(0))
    return e.withColumn("slug", F.when(F.col("__n") == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", F.col("__n").cast("string")))).drop("__base", "__n")


def occurrences(start: Column, end: Column, first: Column, last: Column, as_of: Column, expand: Column, most: int = 31) -> Column:
    """Days to list an event on: its first, or when ``expand``, every day of a run up to ``last`` and ``most`` days ahead."""
    day = F.greatest(start, first)
    horizon = F.least(last, F.date_add(as_of, most), end)
    return F.when(expand & (end != start) & (day <= horizon), F.sequence(day, horizon)).otherwise(F.array(day))


def carry_forward(rows: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """The last non-null value of ``column`` so far, as headings hold for what follows them."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key, by a total order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def position(items: Column) -> Column:
    """An array's items with their places from 1."""
    return F.transform(items, lambda x, i: F.struct((i + 1).alias("position"), x.alias("item")))


def rolled_years(months: Column) -> Column:
    """For the months of one line in order, how many years after the first each lies: a month before the last one is in the next year."""
    zero = F.struct(F.lit(0).alias("year"), F.lit(0).alias("month"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        year = acc["year"] + F.when(m < acc["month"], 1).otherwise(0)
        return F.struct(year.alias("year"), m.alias("month"), F.concat(acc["out"], F.array(year)).alias("out"))

    return F.aggregate(months, zero, step)["out"]


def day_list(text: Column) -> Column:
    """Days of a line such as '3, 5 et 10 au 12': numbers and inclusive ranges."""
    spans = F.regexp_extract_all(text, F.lit(r"(\d{1,2}\s*(?:au|-)\s*\d{1,2}|\d{1,2})"), F.lit(1))

    def days(s: Column) -> Column:
        ends = F.transform(F.regexp_extract_all(s, F.lit(r"(\d{1,2})"), F.lit(1)), lambda x: x.cast("int"))
        low, high = ends[0], F.element_at(ends, -1)
        return F.when(low <= high, F.sequence(low, high)).otherwise(ends)

    return F.flatten(F.transform(spans, days))
