"""Events in JSON documents: JSON-LD of any shape, and objects found by shape at any depth, through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..lineage import cut


def objects(texts: DataFrame, column: str = "json", most: int = 1000) -> DataFrame:
    """Rows with one JSON text each to rows (…, seq path, node): every object in it, at any depth.

    The walk is a recursive table expression over the parts of a VARIANT that ends with the deepest container, and fails beyond
    ``most`` levels, never for the number of rows; texts that are no JSON give nothing.
    """
    spark = texts.sparkSession
    keep = [c for c in texts.columns if c != column]
    name = f"walk_{abs(hash((column, tuple(keep)))) % 10**9}"
    texts.select(*keep, F.try_parse_json(column).alias("node")).where("node is not null").createOrReplaceTempView(name)
    cols = "".join(f"`{c}`, " for c in keep)
    w_cols = "".join(f"w.`{c}`, " for c in keep)
    # Read as a map or a list, a part shows what it is without a look at what it holds.
    is_object = lambda v: f"try_variant_get({v}, '$', 'map<string,variant>') is not null"
    is_list = lambda v: f"try_variant_get({v}, '$', 'array<variant>') is not null"
    return spark.sql(
        f"""with recursive w max recursion level {most} as (
              select {cols} node, '' as path, 0 as level from {name}
              union all
              select {w_cols} v.value, concat(w.path, '/', lpad(cast(v.pos as string), 5, '0')), w.level + 1
              from w, lateral variant_explode(w.node) v where ({is_object('v.value')} or {is_list('v.value')}))
            select {cols} path, node from (select * from w limit all) where {is_object('node')}"""
    )


def get(path: str, kind: str = "string", node: str = "node") -> Column:
    return F.try_variant_get(F.col(node), path, kind)


def text_of(path: str) -> Column:
    """A value that may be a text, an object with a name or text, or a list of either."""
    return F.coalesce(*[F.nullif(F.trim(get(p)), F.lit("")) for p in (f"{path}.name", f"{path}[0].name", f"{path}.text", f"{path}[0]", path)])


def is_event() -> Column:
    """@type is, or lists, a name that ends in Event."""
    types = F.coalesce(get("$['@type']", "array<string>"), F.array(get("$['@type']")))
    return F.coalesce(F.exists(types, lambda t: t.endswith("Event")), F.lit(False))


def place() -> dict[str, Column]:
    """venue, city, postcode and country of a polymorphic location."""
    where = lambda p: F.coalesce(get(f"$.location.address.{p}"), get(f"$.location[0].address.{p}"))
    return {"venue": text_of("$.location"), "city": where("addressLocality"), "postcode": where("postalCode"), "country": F.coalesce(where("addressCountry.name"), where("addressCountry"))}


def in_scope(country: Column, postcode: Column, department: str = "06") -> Column:
    """Not abroad, and no postcode of another department; without an address it is."""
    abroad = F.coalesce(~F.lower(country).isin("fr", "fra", "france", "mc", "monaco"), F.lit(False))
    return ~abroad & F.coalesce(postcode.startswith(department) | postcode.startswith("980"), F.lit(True))


def events(texts: DataFrame, column: str = "json") -> DataFrame:
    """JSON-LD texts to adapter rows, with the columns of ``texts``."""
    keep = [c for c in texts.columns if c != column]
    # Values are taken from their nodes once and written; inside text functions, which are lambdas, each use would be a look into the node.
    parts = {"name": text_of("$.name"), "type": get("$['@type']"), "from": get("$.startDate"), "to": get("$.endDate"), "price": F.coalesce(get("$.offers.price"), get("$.offers[0].price")), "mode": get("$.eventAttendanceMode"),
             "link": F.coalesce(get("$.url"), get("$['@id']")), "description": get("$.description"), "access": get("$.isAccessibleForFree", "boolean"), **place()}
    found = cut(objects(texts, column).where(is_event()).select(*keep, "path", *[c.alias(f"__{k}") for k, c in parts.items()]), "said")
    p = {k: F.col(f"__{k}") for k in parts}
    day, clock = D.iso_parts(p["from"])
    end, _ = D.iso_parts(p["to"])
    found = found.where(p["name"].isNotNull() & day.isNotNull() & in_scope(p["country"], p["postcode"]))
    return found.select(
        *keep, "path", T.unescape(p["name"]).alias("title"), day.alias("start"), F.when(end > day, end).alias("end"), clock.alias("time"), T.canon_town(p["city"], p["postcode"]).alias("town"), p["venue"].alias("venue"),
        T.classify(p["name"], p["type"]).alias("category"), p["link"].alias("url"), T.visible_note(p["description"]).alias("note"),
        (F.coalesce(p["access"], F.lit(False)) | F.coalesce(p["price"].try_cast("double") == 0, F.lit(False))).alias("free"),
        F.coalesce(p["mode"].contains("Online"), F.lit(False)).alias("online"))


def opening_time(day: Column, specs: Column) -> Column:
    """The opening hour that holds on a day, of specifications (opens, from, to)."""
    fits = F.filter(specs, lambda s: s["opens"].isNotNull() & (s["from"].isNull() | (s["from"] <= day)) & (s["to"].isNull() | (s["to"] >= day)))
    return F.substring(F.try_element_at(fits, F.lit(1))["opens"], 1, 5)
