"""Whole-snapshot and whole-difference JSON files as typed tables.

A file is one nested document whose keys are partly data (names of labs, pages, feeds and documents), so it is read as VARIANT and taken
apart by rows, never by inferred columns: :func:`records` gives one row a record of any collection, :func:`tables` types them as the
tables of a snapshot, :func:`together` several of them as one, :func:`problems` tells what doesn't fit, and :func:`difference_log` turns a stored difference
into change log rows.  Each of them reads and parses a file once, whatever the number of collections (:func:`tables`: once a table).

Cells keep the order of their columns, which VARIANT doesn't, so they are read from the text.  A file that isn't JSON has no records and one
problem; a value that can't be cast is null and a problem; unknown fields are problems and otherwise ignored; a missing collection is an
empty one; a null or missing identity leaves the record out, as the differences do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.expr import header_detail
from tidemark.plans import schema as S

CELL_TABLES = {"portal_pps": "pps", "portal_products": "products"}


@dataclass(frozen=True)
class Place:
    """Where a snapshot keeps a table's records: a list; or a map, of lists (``group`` names their column) or of single records."""

    table: str
    domain: str
    path: str
    shape: str = "list"
    group: str = ""


#: Fixed: the names that the snapshot format gives to its collections.
PLACES = (
    Place("products", "niap", "niap.pcl"), Place("profiles", "niap", "niap.pps"), Place("decisions", "niap", "niap.tds"), Place("labs_directory", "niap", "niap.cctls"),
    Place("events", "niap", "niap.events"), Place("news", "niap", "niap.news"),
    Place("portal_news", "cc_portal", "cc_portal.news"), Place("portal_pps", "cc_portal", "cc_portal.pps"), Place("portal_products", "cc_portal", "cc_portal.products"),
    Place("feed_items", "cctl_labs", "cctl_labs", "lists", "feed_name"), Place("feed_items", "csfc", "csfc.feeds", "lists", "feed_name"), Place("feed_items", "nist", "nist.feeds", "lists", "feed_name"),
    Place("page_items", "csfc", "csfc.pages", "lists", "page_key"), Place("page_items", "cc_crypto", "cc_crypto.pages", "lists", "page_key"), Place("page_items", "nist", "nist.pages", "lists", "page_key"),
    Place("doc_headers", "csfc", "csfc.capability_package_headers", "map", "doc_name"), Place("doc_headers", "cc_crypto", "cc_crypto.doc_headers", "map", "doc_name"), Place("doc_headers", "nist", "nist.doc_headers", "map", "doc_name"),
)
#: The identity that a record must have (S9's mandatory fields).
IDENTITY = {"products": "product_id", "profiles": "pp_id", "decisions": "td_id", "labs_directory": "cctl_id", "events": "id", "news": "id"}
#: Columns that come from where a record is, not from the record.
FROM_PLACE = {"pos", "domain", "feed_name", "page_key", "doc_name"}


def files(spark: SparkSession, glob: str) -> DataFrame:
    """(file, text, v) of whole files; ``v`` is null where a file isn't JSON."""
    return parsed(spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """A column that is worked out once a row; the optimizer would copy a projected one into whatever uses it."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(column)).alias(name))


def parsed(texts: DataFrame) -> DataFrame:
    """(file, text, v) of (file, text) rows."""
    return once(once(texts.select("file", "text"), F.col("text"), "text"), F.try_parse_json("text"), "v")


def envelopes(raw: DataFrame) -> DataFrame:
    """(file, schema_version, collected_at); a missing version is 1."""
    version, at = (F.try_variant_get("v", f"$.{n}", t) for n, t in (("schema_version", "int"), ("collected_at", "string")))
    return raw.filter("v IS NOT NULL").select("file", F.coalesce(version, F.lit(1)).alias("schema_version"), F.coalesce(at, F.lit("")).alias("collected_at"))


def listed(part: Column) -> Column:
    """The elements of a VARIANT list; null for any other value."""
    return F.try_variant_get(part, "$", "array<variant>")


def mapped(part: Column) -> Column:
    """The (key, value) entries of a VARIANT map; null for any other value."""
    return F.map_entries(F.try_variant_get(part, "$", "map<string,variant>"))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def row(place: Place, group: Column, pos: Column, value: Column, field: Column | None = None, problem: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    given = (F.lit(place.table), F.lit(place.domain), F.lit(place.path), group, pos, value, none if field is None else field, none if problem is None else problem)
    return F.struct(*(c.alias(n) for c, n in zip(given, ("table", "domain", "path", "group_key", "pos", "value", "field", "problem"))))


def found_at(place: Place, odd: bool) -> Column:
    """The records of a place; with ``odd`` also rows for what is no list or no map there."""
    part, nothing, nowhere = F.try_variant_get("v", f"$.{place.path}", "variant"), F.lit(None).cast("string"), F.lit(None).cast("int")
    none = F.lit(None).cast("variant")
    if place.shape == "list":
        inside = F.transform(listed(part), lambda x, i: row(place, nothing, i, x))
    elif place.shape == "map":
        inside = F.transform(mapped(part), lambda e, i: row(place, e["key"], i, e["value"]))
    else:
        wrong = lambda e: F.array(row(place, nothing, nowhere, none, F.concat_ws(".", F.lit(place.path), e["key"]), F.lit("no list")))
        items = lambda e: F.transform(listed(e["value"]), lambda x, i: row(place, e["key"], i, x))
        inside = F.flatten(F.transform(mapped(part), lambda e: F.coalesce(items(e), wrong(e) if odd else F.array().cast(ROWS))))
    wrong = F.array(row(place, nothing, nowhere, none, F.lit(place.path), F.lit("no list" if place.shape == "list" else "no map")))
    absent = part.isNull() | F.is_variant_null(part)
    return F.coalesce(inside, F.when(~absent, wrong) if odd else F.lit(None), F.array().cast(ROWS))


ROW = {"table": "string", "domain": "string", "path": "string", "group_key": "string", "pos": "int", "value": "variant", "field": "string", "problem": "string"}
ROWS = f"array<struct<{', '.join(f'{n}: {k}' for n, k in ROW.items())}>>"


def read(raw: DataFrame, places=PLACES, odd: bool = False) -> DataFrame:
    """(file, table, domain, path, group_key, pos, value, field, problem) of all records and, with ``odd``, of what doesn't have the shape of a collection."""
    rows = F.concat(*(found_at(p, odd) for p in places))
    if odd:
        no_json = F.array(F.struct(*(F.lit(None).cast(k).alias(n) for n, k in ROW.items() if n != "problem"), F.lit("corrupt").alias("problem")))
        rows = F.when(F.col("v").isNull(), no_json).otherwise(rows)
    held = once(raw.select("file", "v"), rows, "rows")
    return held.select("file", F.explode("rows").alias("r")).select("file", "r.*")


#: The type that a place is cast to.
SHAPES = {"list": "array<variant>", "lists": "map<string, array<variant>>", "map": "map<string, variant>"}


def records(raw: DataFrame, places=PLACES) -> DataFrame:
    """(file, table, domain, path, group_key, pos, value) of all records of all collections.  A place is cast once to its shape, then exploded: VARIANT writes
    a part anew whenever it is taken out of another."""
    cast = once(raw.select("file", "v"), F.struct(*(F.try_variant_get("v", f"$.{p.path}", SHAPES[p.shape]).alias(f"p{i}") for i, p in enumerate(places))), "parts")

    def entry(place: Place, part: Column) -> Column:
        lists = part if place.shape == "lists" else F.when(part.isNotNull(), F.create_map(F.lit(""), part if place.shape == "list" else F.map_values(part)))
        keys = (F.map_keys(part) if place.shape == "map" else F.lit(None)).cast("array<string>")
        given = {"table": F.lit(place.table), "domain": F.lit(place.domain), "path": F.lit(place.path), "shape": F.lit(place.shape), "lists": lists.cast(SHAPES["lists"]), "keys": keys}
        return F.struct(*(c.alias(n) for n, c in given.items()))

    entries = [entry(p, F.col("parts")[f"p{i}"]) for i, p in enumerate(places)]
    held = cast.select("file", F.explode(F.array(*entries)).alias("p")).select("file", "p.*")
    held = held.select("file", "table", "domain", "path", "shape", "keys", F.explode("lists").alias("key", "list"))
    held = held.select("file", "table", "domain", "path", "shape", "keys", "key", F.posexplode("list").alias("pos", "value"))
    group = F.when(F.col("shape") == "lists", F.col("key")).when(F.col("shape") == "map", F.get("keys", F.col("pos")))
    return held.select("file", "table", "domain", "path", group.alias("group_key"), "pos", "value")


def fields(table: str) -> dict[str, str]:
    """The typed fields that come from the record itself."""
    return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(S.SCHEMAS[table]) if f.name not in FROM_PLACE}


def typed_columns(table: str) -> dict[str, Column]:
    """The columns of a table from its records, in the snapshot's types."""
    own = fields(table)
    plain = lambda name: listed(own_field(name)).isNull() & mapped(own_field(name)).isNull()
    own_field = lambda name: F.try_variant_get("value", f"$.{name}", "variant")
    value = {name: F.try_variant_get("value", f"$.{name}", kind) if kind != "string" else F.when(plain(name), F.try_variant_get("value", f"$.{name}", kind)) for name, kind in own.items()}
    value |= {"pos": F.col("pos"), "domain": F.col("domain")} | dict.fromkeys(("feed_name", "page_key", "doc_name"), F.col("group_key"))
    return {f.name: value[f.name] for f in StructType.fromDDL(S.SCHEMAS[table])}


def typed(found: DataFrame, table: str) -> DataFrame:
    """The rows of one table with its file, in the snapshot's types."""
    out = found.filter(F.col("table") == table).select("file", *(c.alias(n) for n, c in typed_columns(table).items()))
    return out.filter(F.col(IDENTITY[table]).isNotNull()) if table in IDENTITY else out


def together(raw: DataFrame, chosen: dict[str, Callable[[dict[str, Column]], dict[str, Column]]]) -> DataFrame:
    """(file, name, columns) of some tables, but not those of cells, from one reading of the files; ``chosen`` makes a table's columns of its typed ones."""
    found = records(raw, [p for p in PLACES if p.table in chosen])
    columns = {t: typed_columns(t) for t in chosen}
    made = {t: choose(columns[t]) for t, choose in chosen.items()}
    kept = reduce(lambda a, b: a & b, [(F.col("table") != t) | columns[t][IDENTITY[t]].isNotNull() for t in chosen if t in IDENTITY], F.lit(True))
    either = lambda name: F.coalesce(*(F.when(F.col("table") == t, c[name]) for t, c in made.items()))
    return found.filter(kept).select("file", F.col("table").alias("name"), *(either(n).alias(n) for n in next(iter(made.values()))))


def cells(raw: DataFrame, table: str) -> DataFrame:
    """(file, cells, pos) with the cells in the order of their columns."""
    name = CELL_TABLES[table]
    listed = F.from_json("text", f"cc_portal struct<{name}: array<map<string,string>>>")["cc_portal"][name]
    rows = raw.filter("v IS NOT NULL").select("file", F.posexplode(listed).alias("pos", "m")).filter("m IS NOT NULL")
    return rows.select("file", F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))).alias("cells"), "pos")


def tables(raw: DataFrame, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """The typed tables of a snapshot, each with the file that its rows come from; ``found``: the records, if at hand as a table."""
    of = lambda t: records(raw, [p for p in PLACES if p.table == t]) if found is None else found
    return {t: cells(raw, t) if t in CELL_TABLES else typed(of(t), t) for t in S.SCHEMAS}


def snapshot(raw: DataFrame) -> dict[str, DataFrame]:
    """The tables of one file as the differences take them."""
    return {name: df.drop("file") for name, df in tables(raw).items()}


def problems(raw: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(file, table, field, problem, n): ``corrupt`` files; collections that are ``no list`` or ``no map``; records that are ``no record`` or have
    ``no identity``; fields that are ``unknown`` or of another ``type``.  A null value is of any type."""
    none, string = F.lit(None), lambda c: c.cast("string")
    told = read(raw, odd=True)
    if found is not None:
        told = told.filter("problem IS NOT NULL").unionByName(found.withColumns({"field": string(none), "problem": string(none)}))
    row_problem = lambda field, problem: F.struct(string(field).alias("field"), string(problem).alias("problem"))
    identity = literal_map(IDENTITY)[F.col("table")]
    nameless = F.lit(False)
    for name in sorted(set(IDENTITY.values())):
        nameless = nameless | (identity == name) & F.try_variant_get("value", f"$.{name}", "string").isNull()
    expected = {f"{t}.{name}": kind for t in S.SCHEMAS if t not in CELL_TABLES for name, kind in fields(t).items()}
    kinds = literal_map(expected)

    def strange(e: Column) -> Column:
        kind, given = kinds[F.concat_ws(".", "table", e["key"])], e["value"]
        fine = listed(given).isNull() & mapped(given).isNull()  # lists and maps have no text of their own
        for other in sorted(set(expected.values()) - {"string"}):
            fine = F.when(kind == other, F.try_variant_get(given, "$", other).isNotNull()).otherwise(fine)
        return row_problem(e["key"], F.when(F.is_variant_null(given), none).when(kind.isNull(), "unknown").when(~fine, "type"))

    inside = mapped(F.col("value"))
    odd = row_problem(none, F.when(inside.isNull(), "no record").when(F.coalesce(nameless, F.lit(False)), "no identity"))
    of_row = F.when(F.col("problem").isNotNull(), F.array(row_problem(F.col("field"), F.col("problem")))).when(
        ~F.col("table").isin(*CELL_TABLES), F.filter(F.concat(F.array(odd), F.coalesce(F.transform(inside, strange), F.array().cast("array<struct<field: string, problem: string>>"))), lambda p: p["problem"].isNotNull())
    )
    each = once(told.select("file", "table", "value", "field", "problem"), of_row, "problems").select("file", "table", F.explode("problems").alias("p")).select("file", "table", "p.*")
    return each.groupBy("file", "table", "field", "problem").agg(F.count("*").alias("n"))


# --- stored differences ---------------------------------------------------------------------------------------------

#: Fixed: the lists of a stored difference and the kind of change that each holds.
LISTS = {"added": "added", "removed": "removed", "sunset_changes": "sunset_change", "status_changes": "status_change", "newly_archived": "newly_archived"}
#: Of each keyed collection: identity, title, text, link (fields of the record).
ENTITIES = {
    "pps": ("pp_id", "pp_short_name", "pp_name", None), "tds": ("td_id", "title", "identifier", None), "cisco_ndcpp": ("product_id", "product_name", "vendor_id_name", None),
    "news": ("id", "title", "date", "link"), "events": ("id", "title", None, "link"), "cctls": ("cctl_id", "name", None, None),
}
DOCUMENTS = {"csfc": "capability_packages", "cc_crypto": "doc_headers", "nist": "doc_headers"}
PROFILE = "https://www.niap-ccevs.org/Profile/PP.cfm?id="
FEEDS = {"cctl_labs": "cctl_labs", "csfc": "csfc.feeds", "nist": "nist.feeds"}
#: The types that a stored difference is read in; a part of another shape is null.
LIST = "array<variant>"
LISTS_OF = f"map<string, map<string, {LIST}>>"
SHAPE = (
    f"struct<niap: {LISTS_OF}, cc_portal: struct<news: map<string, {LIST}>>, cctl_labs: map<string, {LIST}>, csfc: struct<feeds: map<string, {LIST}>, pages: {LISTS_OF}, capability_packages: map<string, variant>>, "
    f"cc_crypto: struct<pages: {LISTS_OF}, doc_headers: map<string, variant>>, nist: struct<feeds: map<string, {LIST}>, pages: {LISTS_OF}, doc_headers: map<string, variant>>>"
)
#: Of the other forms: title, text and link, as far as they are plain fields of the record.
TITLES, TEXTS, LINKS = {"feeds": "title"}, {"portal": "text", "feeds": "summary", "pages": "text"}, {"portal": "link", "feeds": "link", "pages": "href", "documents": "url"}


def changes(raw: DataFrame) -> DataFrame:
    """(file, run_date, form, domain, collection, group_key, kind, pos, value, cells) of stored differences.

    A file is cast once to the types of its collections: VARIANT writes a part anew whenever it is taken out of another, so going down level by level would
    write a record at each.  Then every collection is a row with its lists, (name, list, records), which are exploded."""
    dated = raw.select("file", F.to_date(F.left("file", F.lit(10))).alias("run_date"), "text", "v")
    added = lambda c: F.try_variant_get("v", f"$.cc_portal.{c}.added", LIST).isNotNull()
    in_text = lambda c: F.from_json("text", f"cc_portal struct<{c}: struct<added: array<map<string,string>>>>")["cc_portal"][c]["added"]
    cells = F.struct(*(F.when(added(c), in_text(c)).alias(c) for c in CELL_TABLES.values()))
    cast = once(once(dated, cells, "cells").drop("text"), F.try_variant_get("v", "$", SHAPE), "v")
    none, no_list = F.lit(None), F.array().cast(LIST)
    at = lambda path: reduce(lambda c, name: c[name], path.split("."), F.col("v"))

    def place(form: str, domain: str, collection: str, lists: Column, keys: Column = none, cells: Column = none) -> Column:
        given = {"form": F.lit(form), "domain": F.lit(domain), "collection": F.lit(collection), "lists": lists.cast(LISTS_OF), "keys": keys.cast("array<string>"), "cells": cells.cast("array<map<string,string>>")}
        return F.struct(*(c.alias(n) for n, c in given.items()))

    named = lambda name, lists: F.when(lists.isNotNull(), F.create_map(F.lit(name), lists))
    places = [place("entities", "niap", "", at("niap")), place("portal", "cc_portal", "news", named("news", at("cc_portal.news")))]
    places += [place("cells", "cc_portal", c, F.when(F.col("cells")[c].isNotNull(), F.create_map(F.lit(c), F.create_map(F.lit("added"), no_list))), cells=F.col("cells")[c]) for c in CELL_TABLES.values()]
    places += [place("feeds", domain, "feeds", named("added", at(path))) for domain, path in FEEDS.items()]
    places += [place("pages", domain, "pages", at(f"{domain}.pages")) for domain in DOCUMENTS]
    for domain, path in DOCUMENTS.items():
        records = at(f"{domain}.{path}")
        places.append(place("documents", domain, "documents", F.when(records.isNotNull(), F.create_map(F.lit(""), F.create_map(F.lit(""), F.map_values(records)))), F.map_keys(records)))
    held = cast.select("file", "run_date", F.explode(F.array(*places)).alias("p")).select("file", "run_date", "p.*")
    held = held.select("file", "run_date", "form", "domain", "collection", "keys", "cells", F.explode("lists").alias("name", "lists"))
    form, name, key, value = F.col("form"), F.col("name"), F.col("key"), F.col("value")
    held = held.filter((form != "entities") | name.isin(*ENTITIES)).select("*", F.explode("lists").alias("key", "list"))
    kind = F.when(form == "feeds", name).when(form == "documents", "header_changed").otherwise(literal_map(LISTS)[key])
    rows = F.arrays_zip(F.coalesce("list", no_list).alias("value"), F.coalesce("cells", F.array().cast("array<map<string,string>>")).alias("cells"))
    each = once(held, kind, "kind").filter("kind IS NOT NULL").select("file", "run_date", "form", "domain", "collection", "name", "key", "kind", "keys", F.posexplode(rows).alias("pos", "r"))
    each = each.withColumns({"value": F.col("r")["value"], "cells": F.col("r")["cells"]})
    changed = mapped(value).isNotNull() & F.coalesce(F.try_variant_get(value, "$.changed", "boolean"), F.lit(False))
    own = {
        "form": F.when(form == "entities", name).otherwise(form), "domain": F.col("domain"), "collection": F.when(form == "entities", name).otherwise(F.col("collection")),
        "group_key": F.when(form == "feeds", key).when(form == "pages", name).when(form == "documents", F.get("keys", F.col("pos"))), "kind": F.col("kind"),
        "pos": F.when(form == "documents", 0).otherwise(F.col("pos")), "value": value, "cells": F.col("cells"),
    }
    return each.filter((form != "documents") | changed).select("file", "run_date", *(c.alias(n) for n, c in own.items()))


def difference_log(raw: DataFrame) -> DataFrame:
    """(file, run_date, change log columns) of stored differences; ``run_date`` is the date that the file's name starts with."""
    held = once(changes(raw), F.try_variant_get("value", "$", "map<string,string>"), "fields")
    form, kind, fields = F.col("form"), F.col("kind"), F.col("fields")
    of_form = lambda names: fields[literal_map(names)[form]]
    entities = lambda place: {c: names[place] for c, names in ENTITIES.items() if names[place]}
    of_entity, get = form.isin(*ENTITIES), lambda name: fields[name]
    headers = {f"{side}_{f}": F.coalesce(get(f"{side}_{f}"), F.lit("")) for side in ("old", "new") for f in ("last_modified", "etag", "content_length", "partial_hash")}
    columns = {
        "entity_key": F.when(form == "documents", F.col("group_key")).when(form == "feeds", F.coalesce(get("id"), get("title"), get("link"))).otherwise(of_form(entities(0))),
        "title": of_form(entities(1) | TITLES),
        "text": F.when(form == "cells", F.array_join(F.map_values("cells"), " | ")).when(form == "documents", header_detail()).otherwise(of_form(entities(2) | TEXTS)),
        "link": F.when(form == "pps", F.concat(F.lit(PROFILE), get(ENTITIES["pps"][0]))).when(form == "news", F.coalesce(F.nullif(get("link"), F.lit("")), get("url"))).otherwise(of_form(entities(3) | LINKS)),
        "category": F.when(of_entity | (form == "feeds"), get("_category")),
        "old_value": F.when(of_entity, F.when(kind == "sunset_change", get("old_sunset")).when(kind == "status_change", get("old_status")).when(kind == "newly_archived", F.lit("Certified"))),
        "new_value": F.when(of_entity, F.when(kind == "sunset_change", get("new_sunset")).when(kind == "status_change", get("new_status")).when(kind == "newly_archived", F.lit("Archived"))),
        "payload": F.when(form == "cells", F.to_json("cells")).otherwise(F.to_json("value")),
    }
    own = lambda n, k: (columns[n] if n in columns else F.col(n)).cast(k).alias(n)
    return held.withColumns(headers).select("file", "run_date", *(own(n, k) for n, k in S.CHANGE_FIELDS.items()))
