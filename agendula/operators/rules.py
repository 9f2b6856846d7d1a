"""Hand-kept rules as joins: suppressions, category overrides, cancellations. A null field of a rule matches anything."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .similarity import grams, own_gram

#: Rules beyond this number are not broadcast: their joins are shuffled.
MOST_RULES = 10_000


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(MOST_RULES + 1).count() <= MOST_RULES else rules


def _key(parts: list[Column]) -> Column:
    """The set ones of some fields as one text; an unset one stays apart from an empty one."""
    return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts])


def suppress(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Events without those that a rule (url, needle, town, date) names.

    A rule that sets a url, a town or a date meets events by these, all at once: an event has a key for each choice of the three. One with a
    needle alone meets the titles that hold one gram of the needle. Either way the whole rule is tried on the few events it meets.
    """
    r = rules.select("url", F.when(F.col("needle").isNotNull(), T.fold(F.col("needle"), True)).alias("needle"), "town", F.col("date").cast("date").alias("date"))
    r = r.where("coalesce(url, needle, town, cast(date as string)) is not null").distinct()
    fields = ["url", "town", "date"]
    r = r.withColumn("key", F.when(F.coalesce("url", "town", F.col("date").cast("string")).isNotNull(), _key([F.col(c) for c in fields])))
    keyed, bare = r.where("key is not null").select("key", "needle"), r.where("key is null")
    bare = bare.select(own_gram(F.split("needle", " ")).alias("key"), "needle")

    e = events.select("url", "town", F.col("start").alias("date"), T.fold(F.col("title"), True).alias("__t")).distinct()
    some = [F.when(reduce(and_, [F.col(c).isNotNull() for c in used]), _key([F.col(c) if c in used else F.lit(None) for c in fields])) for k in (1, 2, 3) for used in combinations(fields, k)]
    by_fields = e.withColumn("key", F.explode(F.filter(F.array(*some), lambda x: x.isNotNull())))
    by_gram = e.withColumn("key", F.explode(grams(F.col("__t"))))
    holds = F.col("needle").isNull() | F.col("__t").contains(F.col("needle"))
    hit = by_fields.join(_small(keyed), "key").where(holds).unionByName(by_gram.join(_small(bare), "key").where(holds))
    hit = hit.select("url", "town", "date", "__t").distinct().select(*[F.col(c).alias(f"__{c}") for c in ("url", "town", "date")], F.col("__t").alias("__title"))
    same = F.col("url").eqNullSafe(F.col("__url")) & F.col("town").eqNullSafe(F.col("__town")) & F.col("start").eqNullSafe(F.col("__date")) & (F.col("__t") == F.col("__title"))
    return events.withColumn("__t", T.fold(F.col("title"), True)).join(hit, same, "left_anti").drop("__t")


def override(category: Column, url: Column, title: Column, town: Column, rules: list[tuple]) -> Column:
    """The category of the first rule (url, needle, town, category) that matches, else the given one."""
    folded, out = T.fold(title), None
    for r_url, needle, r_town, pinned in rules:
        parts = [c for v, c in ((r_url, url == F.lit(r_url)), (needle, folded.contains(F.lit((needle or "").lower()))), (r_town, town == F.lit(r_town))) if v is not None]
        if parts:
            hit = parts[0]
            for p in parts[1:]:
                hit = hit & p
            out = F.when(hit, F.lit(pinned)) if out is None else out.when(hit, F.lit(pinned))
    return category if out is None else out.otherwise(category)


def mark_cancelled(events: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``events`` with cancelled and cancel_note: from the title's own marker, which goes, and from rules (needle, town, date, note).

    Of several rules the last one with a note, by needle and note, gives the note.
    """
    says = T.says_cancelled(F.col("title"))
    out = events.withColumns({"cancelled": says, "cancel_note": F.when(says, F.lit("Annulé")), "title": F.when(says, T.strip_marker(F.col("title"))).otherwise(F.col("title"))})
    if rules is None:
        return out
    r = rules.select(T.fold(F.col("needle"), True).alias("needle"), "town", "date", "note", F.coalesce(F.col("rank") if "rank" in rules.columns else F.lit(0), F.lit(0)).alias("rank"))
    # Town and date are equal on both sides, so only the title test is left to the join's residue.
    keyed = out.select("fingerprint", "town", "start", T.fold(F.col("title"), True).alias("t")).alias("e")
    hit = keyed.join(_small(r).alias("r"), (F.col("e.town") == F.col("r.town")) & (F.col("e.start") == F.col("r.date")) & F.col("e.t").contains(F.col("r.needle")))
    named = hit.groupBy("fingerprint").agg(F.max_by("note", F.when(F.col("note").isNotNull(), F.struct("rank", "needle", "note"))).alias("__note"))
    out = out.join(named.withColumn("__hit", F.lit(True)), "fingerprint", "left")
    return out.withColumns({"cancelled": F.col("cancelled") | F.col("__hit").isNotNull(), "cancel_note": F.coalesce("__note", "cancel_note")}).drop("__note", "__hit")
