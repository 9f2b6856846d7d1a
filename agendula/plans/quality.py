"""Data-quality rules over events, feeds, submissions and messages: one boolean a rule, violations as an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X


def event_rules(as_of: Column) -> dict[str, Column]:
    last = F.coalesce("end", "start")
    hay = F.concat_ws(" ", "title", "note", "price")
    return {
        "false_midnight": F.col("time") == "00:00",
        "past": (F.col("start") < as_of) & (last < as_of),
        "long_range_also_on": (F.datediff("end", "start") > 10) & F.lower(F.coalesce("note", F.lit(""))).contains("also on"),
        "empty_note": F.coalesce(F.trim("note"), F.lit("")) == "",
        "free_with_price": F.col("free") & hay.rlike(r"\d+\s*(€|euros?)"),
        "price_says_free": ~F.col("free") & F.coalesce(F.col("price"), F.lit("")).rlike("(?i)gratuit|free"),
    }


def event_violations(events: DataFrame, as_of: Column) -> DataFrame:
    """(fingerprint, rule): one row for each rule that an event breaks; duplicates by title, day and venue too."""
    events = events.withColumn("__nth", F.row_number().over(Window.partitionBy("title", "start", "venue").orderBy("fingerprint")))
    named = {k: F.coalesce(c, F.lit(False)) for k, c in event_rules(as_of).items()} | {"duplicate": (F.col("__nth") > 1) & F.col("venue").isNotNull()}
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]))
    return events.select("fingerprint", F.explode(broken).alias("rule"))


def report(violations: DataFrame, shown: int = 40) -> DataFrame:
    """Count by rule, and the first so many fingerprints (they are kept while rows are counted, not gathered first)."""
    first = violations.withColumn("n", F.row_number().over(Window.partitionBy("rule").orderBy("fingerprint"))).where(F.col("n") <= shown)
    some = first.groupBy("rule").agg(F.array_sort(F.collect_list("fingerprint")).alias("examples"))
    return violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).join(some, "rule")


def stale_feed(generated: Column, now: Column, hours: int = 48) -> Column:
    # Compared as moments: a difference in whole seconds would lose what is less than one.
    return generated < now - F.make_dt_interval(hours=F.lit(hours))


def unused_columns(events: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that no row fills, on which checks say nothing."""
    counts = events.agg(*[F.count(c).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("filled")) for c in columns])).alias("x")).select("x.*").where("filled = 0")


def submission_rules() -> dict[str, Column]:
    """What a submission must keep to."""
    between = lambda c, a, z: F.length(F.trim(c)).between(a, z)
    optional = lambda c, ok: F.col(c).isNull() | ok
    return {
        "title_length": between("title", 3, 200), "town_length": between("town", 2, 80), "venue_length": optional("venue", F.length("venue") <= 160), "note_length": optional("note", F.length("note") <= 1000),
        "url_shape": optional("url", F.col("url").rlike("(?i)^https?://") & (F.length("url") <= 500)), "time_shape": optional("time", F.col("time").rlike(r"^([01]\d|2[0-3]):[0-5]\d$")),
        "category_known": F.col("category").isin(list(X.CATEGORIES)), "end_after_start": optional("end_date", F.col("end_date") >= F.col("start_date")), "email_shape": optional("email", F.col("email").rlike(X.EMAIL)),
        "not_approved": ~F.col("approved"), "not_published": ~F.col("published"),
    }


def message_rules() -> dict[str, Column]:
    return {
        "kind_known": F.col("kind").isin("hello", "correction", "source", "removal"), "body_length": F.col("body").isNull() | (F.length("body") <= 4000), "email_shape": F.col("email").isNull() | F.col("email").rlike(X.EMAIL),
        "has_content": F.col("body").isNotNull() | F.col("email").isNotNull(),
    }


def with_violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return rows.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()])))


def digest_allowed(total: int, people: int, force: bool = False) -> str | None:
    """Why a digest must not go out, or None."""
    if not total:
        return "nothing new"
    if not people:
        return "no recipients"
    if total > X.DIGEST_LIMIT and not force:
        return f"{total} rows look like a reseed"
    return None
