"""The title an event keeps, as an aggregate whose parts compose.

A title wins that says cancelled where the other does not, or that has a smaller penalty: only sixteen classes matter. What a run of
titles does to the title before it is therefore a table of sixteen answers, and the tables of two neighbouring runs give that of both.
Titles are dealt by ranges of (fingerprint, seq), so one event's titles may lie in many tasks; runs of ``2^RUN`` rows become tables
there, then runs of tables, and no task holds an event's titles.

That costs several exchanges of all titles, so it is for events of very many rows; of others :func:`folded` takes the list at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Penalties by rising value; with the mark of cancelled titles they make sixteen classes.
PENALTIES = (0, 2, 5, 7, 10, 12, 15, 17)
#: Bits of the places of a run, and of a run of runs.
RUN, RUNS = 12, 24

_STATE = "struct<class:int,title:string>"


def title_class(title: Column) -> Column:
    bad = F.array_position(F.array(*map(F.lit, PENALTIES)), T.title_penalty(title)).cast("int") - 1
    return bad + F.when(T.says_cancelled(title), len(PENALTIES)).otherwise(0)


def _state(cls: Column, title: Column) -> Column:
    return F.struct(cls.cast("int").alias("class"), title.cast("string").alias("title"))


def _beaten(cls: Column) -> Column:
    """The classes that a title of a class wins over, as bits."""
    n = 2 * len(PENALTIES)
    over = [sum(1 << held for held in range(n) if (new >= n // 2 > held) or new % (n // 2) < held % (n // 2)) for new in range(n)]
    return F.get(F.array(*map(F.lit, over)), cls)


def _answers(items: Column) -> Column:
    """For each class before a run of titles, in order: the class and title after it; no title where the one before stays.

    While it runs, a state is one number: 16 times the place of the title (0: the one before), plus its class.
    """
    n = 2 * len(PENALTIES)
    start = F.array(*[F.lit(i) for i in range(n)])
    # Of neighbours of one class the first alone can win.
    changes = F.filter(items, lambda x, i: (i == 0) | (x["class"] != F.get(items, i - 1)["class"]))
    numbered = lambda xs: F.transform(xs, lambda x, i: F.struct(((i + 1) * n + x["class"]).alias("code"), _beaten(x["class"]).alias("beaten")))
    one = lambda acc, x: F.transform(acc, lambda a: F.when(x["beaten"].bitwiseAND(F.get(bits, a % n)) != 0, x["code"]).otherwise(a))
    bits = F.array(*[F.lit(1 << i) for i in range(n)])
    final = lambda xs: F.transform(F.aggregate(numbered(xs), start, one), lambda a: _state(a % n, F.get(xs, F.floor(a / n).cast("int") - 1)["title"]))
    return T.let(changes, final)


def _then(held: Column, table: Column) -> Column:
    """A state after a run."""
    return T.let(F.get(table, held["class"]), lambda after: F.when(after["title"].isNotNull(), after).otherwise(held))


def _composed(tables: Column) -> Column:
    rest = F.slice(tables, F.lit(2), F.size(tables))
    return F.aggregate(rest, F.get(tables, F.lit(0)), lambda acc, t: F.transform(acc, lambda a: _then(a, t)))


def titled(seq: Column, title: Column) -> Column:
    """What :func:`folded` asks of a title; null for none."""
    at = lambda cls: F.struct(seq.alias("seq"), F.get(F.array(*[F.lit(1 << i) for i in range(2 * len(PENALTIES))]), cls).alias("bit"), _beaten(cls).alias("beaten"), title.alias("title"))
    return F.when(title.isNotNull(), T.let(title_class(title), at))


def folded(items: Column) -> Column:
    """The title that is left of the whole list of an event's titles (:func:`titled`), taken in turn; null of none."""
    one = lambda held, x: F.when(x["beaten"].bitwiseAND(held["bit"]) != 0, x).otherwise(held)
    return T.let(F.sort_array(items), lambda xs: F.aggregate(F.slice(xs, F.lit(2), F.size(xs)), F.get(xs, F.lit(0)), one))["title"]


def kept_titles(rows: DataFrame, run: int = RUN, runs: int = RUNS) -> DataFrame:
    """(fingerprint, title) of (fingerprint, seq, title): what is left when every title in turn meets the one kept so far. Null titles take no part."""
    r = rows.where("title is not null").select("fingerprint", "seq", "title")
    # Rows lie in the order of their partitions and inside them, and so do these numbers.
    r = r.repartitionByRange("fingerprint", "seq").sortWithinPartitions("fingerprint", "seq").withColumns({"at": F.monotonically_increasing_id(), "class": title_class(F.col("title"))})
    items = F.sort_array(F.collect_list(F.struct("seq", "class", "title")))
    level = r.groupBy("fingerprint", F.shiftright("at", run).alias("run")).agg(items.alias("items"))
    level = level.select("fingerprint", "run", _state(F.col("items")[0]["class"], F.col("items")[0]["title"]).alias("first"), _answers(F.col("items")).alias("table"))
    for key in ([F.shiftright("run", runs - run).alias("run")], []):
        parts = F.sort_array(F.collect_list(F.struct("run", "first", "table")))
        level = level.groupBy("fingerprint", *key).agg(parts.alias("parts"))
        level = level.select("fingerprint", *(["run"] if key else []), F.col("parts")[0]["first"].alias("first"), _composed(F.col("parts")["table"]).alias("table"))
    return level.select("fingerprint", _then(F.col("first"), F.col("table"))["title"].alias("title"))
