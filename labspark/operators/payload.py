"""Generation payloads: removal of raw data at any depth, its audit, and assembly.

Typed payloads are scrubbed by a column expression built from the schema.  JSON text of unknown schema is merged
into one first, with variants where rows differ; what that expression cannot tell is scrubbed level by level, and
what is nested deeper than one expression reaches goes on as rows of its own.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labspark.operators.report import selected_block_lists
from labspark.session import cut_lineage
from labspark.sources.tables import variant_type

# Keys that hold raw data.
RAW_KEYS = ["raw_csv", "csv", "file_content"]
# Warning text per removed field.
REMOVED = "Rohdatenfeld ignoriert: "
DEFAULT_SYSTEM = (
    "Erstelle ein LaTeX-Protokoll ausschliesslich aus summary_for_generation, "
    "selected_analysis_blocks, Metadaten, lab_notes und generation_rules. "
    "Rohdaten duerfen nicht verwendet werden."
)
NOT_JSON = "Payload ist kein gültiges JSON."
TOO_DEEP = "Payload ist zu tief verschachtelt."
#: Objects and lists inside each other that one expression scrubs, and those a round takes of deeper ones; the time to
#: plan an expression grows fast with them.
LEVELS, ROUND = 8, 2
#: Payloads whose merged schema has more fields on the way to raw ones are all taken the long way.
MOST_FIELDS = 2000
REJECTED = "messages oder bevorzugter Generate-Payload erforderlich."
# Fields of the preferred payload and what stands in for an absent one.
PREFERRED_FIELDS = {
    "experiment_title": None,
    "experiment_type": None,
    "lab_notes": None,
    "metadata": "{}",
    "summary_for_generation": None,
    "selected_analysis_blocks": "[]",
    "generation_rules": "{}",
}


def scrub(value: Column, kind: T.DataType, raw_keys: Sequence[str] = RAW_KEYS) -> Column:
    """The same value without raw-data fields, rebuilt only where the type contains any."""
    if not _holds_raw(kind, raw_keys):
        return value
    if isinstance(kind, T.StructType):
        kept = [
            scrub(value[field.name], field.dataType, raw_keys).alias(field.name)
            for field in kind.fields
            if field.name not in raw_keys
        ]
        rebuilt = F.struct(*kept) if kept else F.lit(None).cast("struct<>")
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: scrub(item, kind.elementType, raw_keys))
    if isinstance(kind, T.MapType):
        named = F.map_filter(value, lambda key, _: ~key.isin(list(raw_keys)))
        return F.transform_values(named, lambda _, item: scrub(item, kind.valueType, raw_keys))
    return value


def _holds_raw(kind: T.DataType, raw_keys: Sequence[str]) -> bool:
    if isinstance(kind, T.StructType):
        return any(f.name in raw_keys or _holds_raw(f.dataType, raw_keys) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds_raw(kind.elementType, raw_keys)
    return isinstance(kind, T.MapType)


def removed_paths(
    value: Column,
    kind: T.DataType,
    raw_keys: Sequence[str] = RAW_KEYS,
    path: Column | None = None,
) -> Column:
    """Array with the path of every removed field that holds a value, once per list element."""
    empty = F.array().cast("array<string>")

    def below(name: Column) -> Column:
        return name if path is None else F.concat(path, F.lit("."), name)

    if not _holds_raw(kind, raw_keys):
        return empty
    if isinstance(kind, T.ArrayType):
        here = F.lit("[]") if path is None else F.concat(path, F.lit("[]"))
        inner = F.transform(value, lambda item: removed_paths(item, kind.elementType, raw_keys, here))
        return F.coalesce(F.flatten(inner), empty)
    if isinstance(kind, T.MapType):
        own = F.filter(F.map_keys(value), lambda key: key.isin(list(raw_keys)))
        kept = F.map_filter(value, lambda key, _: ~key.isin(list(raw_keys)))
        inner = F.transform(
            F.map_entries(kept),
            lambda e: removed_paths(e["value"], kind.valueType, raw_keys, below(e["key"])),
        )
        found = F.concat(F.transform(own, lambda key: below(key)), F.flatten(inner))
        return F.coalesce(found, empty)
    parts = []
    for field in kind.fields:
        name = below(F.lit(field.name))
        if field.name in raw_keys:
            parts.append(F.when(value[field.name].isNotNull(), F.array(name)).otherwise(empty))
        else:
            parts.append(removed_paths(value[field.name], field.dataType, raw_keys, name))
    return F.coalesce(F.concat(*parts), empty)


def scrub_payloads(
    df: DataFrame, column: str, schema: T.StructType, raw_keys: Sequence[str] = RAW_KEYS
) -> DataFrame:
    """JSON text in, JSON text without raw fields out, under a known schema; null fields are kept."""
    parsed = F.from_json(F.col(column), schema)
    clean = F.to_json(scrub(parsed, schema, raw_keys), {"ignoreNullFields": "false"})
    return df.withColumn(column, clean)


def audit(
    df: DataFrame, id_column: str, value: Column, kind: T.DataType, raw_keys: Sequence[str] = RAW_KEYS
) -> DataFrame:
    """``id, path, n``: removed fields per payload and path."""
    found = df.select(id_column, F.explode(removed_paths(value, kind, raw_keys)).alias("path"))
    return found.groupBy(id_column, "path").agg(F.count(F.lit(1)).alias("n"))


_PART = "struct<value:variant,removed:array<string>>"
_REST = "array<struct<pos:string,path:string,value:variant>>"


def _scrubbed(value: Column, raw_keys: Sequence[str], levels: int, path: Column, pos: Column | None = None, parts: Column | None = None) -> Column:
    """``struct<value, removed, deep>``: a variant without raw fields, their paths, and whether levels ran out.

    Objects and lists are seen alike, as children with a key or with none.  With ``pos``, the place of the value,
    ``rest`` stands for ``deep`` and has place (numbers of the children that lead there), path and value of each
    object or list below the last level; where ``parts``, a map from place to value and removed paths, is given,
    these stand in for them instead.
    """
    fields, items = value.try_cast("map<string,variant>"), value.try_cast("array<variant>")
    nothing, no_rest = F.array().cast("array<string>"), F.array().cast(_REST)
    children = F.coalesce(
        F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))),
        F.transform(items, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value"))),
    )
    if levels == 0:
        nested = F.coalesce(F.size(children), F.lit(0)) > 0
        if parts is not None:
            part = F.element_at(parts, pos)
            return F.struct(
                F.when(nested, part["value"]).otherwise(value).alias("value"),
                F.when(nested, part["removed"]).otherwise(nothing).alias("removed"),
                no_rest.alias("rest"),
            )
        if pos is None:
            return F.struct(value.alias("value"), nothing.alias("removed"), nested.alias("deep"))
        rest = F.array(F.struct(pos.alias("pos"), path.alias("path"), value.alias("value"))).cast(_REST)
        return F.struct(value.alias("value"), nothing.alias("removed"), F.when(nested, rest).otherwise(no_rest).alias("rest"))

    def placed(child: Column, at: Column) -> Column:
        key = child["key"]
        here = F.when(key.isNull(), F.concat(path, F.lit("[]"))).when(path == "", key)
        raw = F.coalesce(key.isin(list(raw_keys)), F.lit(False))
        return F.struct(
            key.alias("key"),
            raw.alias("raw"),
            here.otherwise(F.concat(path, F.lit("."), key)).alias("path"),
            *([] if pos is None else [F.concat(pos, F.lit("/"), at.cast("string")).alias("pos")]),
            F.when(~raw, child["value"]).alias("value"),
        )

    def visit(child: Column) -> Column:
        below = _scrubbed(child["value"], raw_keys, levels - 1, child["path"], pos if pos is None else child["pos"], parts)
        return F.struct(child["key"].alias("key"), child["raw"].alias("raw"), child["path"].alias("path"), below.alias("below"))

    def rebuilt(seen: Column) -> Column:
        kept = F.transform(F.filter(seen, lambda c: ~c["raw"]), lambda c: F.struct(c["key"], c["below"]["value"]))
        removed = F.transform(seen, lambda c: F.when(c["raw"], F.array(c["path"])).otherwise(c["below"]["removed"]))
        if pos is None:
            left = F.coalesce(F.exists(seen, lambda c: ~c["raw"] & c["below"]["deep"]), F.lit(False)).alias("deep")
        else:
            left = F.coalesce(F.flatten(F.transform(seen, lambda c: c["below"]["rest"])), no_rest).alias("rest")
        return F.struct(
            F.when(fields.isNotNull(), F.to_variant_object(F.map_from_entries(kept)))
            .when(items.isNotNull(), F.transform(seen, lambda c: c["below"]["value"]).cast("variant"))
            .otherwise(value)
            .alias("value"),
            F.coalesce(F.flatten(removed), nothing).alias("removed"),
            left,
        )

    # The children are bound to a variable, so that they are visited once.
    return F.get(F.transform(F.array(F.transform(F.transform(children, placed), visit)), rebuilt), F.lit(0))


def _scrubbed_text(text: Column, raw_keys: Sequence[str], levels: int = LEVELS) -> Column:
    """``struct<value: variant, removed, error>`` of JSON text of any shape, as deep as one expression reaches."""
    parsed = F.try_parse_json(text)
    found = _scrubbed(parsed, raw_keys, levels, F.lit(""))
    error = F.when(text.isNotNull() & parsed.isNull(), NOT_JSON).when(found["deep"], TOO_DEEP)
    return F.struct(
        F.when(error.isNull(), found["value"]).alias("value"), found["removed"].alias("removed"), error.alias("error")
    )


def _scrub_rows(values: DataFrame, raw_keys: Sequence[str]) -> DataFrame:
    """``node, value, removed`` of ``values(node, path, value)``, variants nested to any depth.

    Each round scrubs ``ROUND`` levels and hands what is nested deeper to the next one as rows; then the parts
    are put back in, from the last round to the first.
    """
    rounds = [cut_lineage(values)]
    while True:
        rest = _scrubbed(F.col("value"), raw_keys, ROUND, F.col("path"), F.lit(""))["rest"]
        below = rounds[-1].select("node", F.explode(rest).alias("r")).select(
            F.concat("node", F.lit("|"), "r.pos").alias("node"), F.col("node").alias("parent"), "r.pos", "r.path", "r.value"
        )
        below = cut_lineage(below)
        if below.isEmpty():
            break
        rounds.append(below)
    parts = None
    for nodes in reversed(rounds):
        if parts is None:
            given = F.map_from_entries(F.array().cast(f"array<struct<pos:string,part:{_PART}>>"))
        else:
            nodes, given = nodes.join(parts, nodes["node"] == parts["of"], "left"), F.col("parts")
        clean = _scrubbed(F.col("value"), raw_keys, ROUND, F.col("path"), F.lit(""), given)
        kept = [c for c in ("parent", "pos") if c in nodes.columns]
        done = nodes.select("node", *kept, clean.alias("c")).select("node", *kept, "c.value", "c.removed")
        done = cut_lineage(done)
        if kept:
            part = F.struct("pos", F.struct("value", "removed").alias("part"))
            parts = done.groupBy(F.col("parent").alias("of")).agg(F.map_from_entries(F.collect_list(part)).alias("parts"))
    return done


def _scrub_any(df: DataFrame, column: str, name: str, raw_keys: Sequence[str]) -> DataFrame:
    """``df`` with ``name``, a struct of JSON, removed paths and error, by visiting every object and list.

    What is nested deeper than one expression reaches goes on as rows.
    """
    once = cut_lineage(df.withColumn(name, _as_json(_scrubbed_text(F.col(column), raw_keys))))
    deep = F.coalesce(F.col(name)["error"] == TOO_DEEP, F.lit(False))
    found = once.where(deep).drop(name)
    if found.isEmpty():
        return once
    values = found.select(F.sha2(column, 256).alias("node"), F.col(column).alias("_text")).dropDuplicates(["node"])
    values = values.select("node", F.lit("").alias("path"), F.try_parse_json(F.col("_text")).alias("value"))
    whole = F.struct("value", "removed", F.lit(None).cast("string").alias("error"))
    done = _scrub_rows(values, raw_keys).select("node", _as_json(whole).alias(name))
    rest = found.withColumn("node", F.sha2(column, 256)).join(done, "node").select(*df.columns, name)
    return once.where(~deep).unionByName(rest)


def _as_json(clean: Column) -> Column:
    text = F.to_json(clean["value"])
    return F.struct(text.alias("json"), clean["removed"].alias("removed"), clean["error"].alias("error"))


def _open_type(kind: T.DataType, raw_keys: Sequence[str]) -> T.DataType:
    """The type by which values of ``kind`` are taken apart: only what leads to raw fields, the rest as variants."""
    if not _holds_raw(kind, raw_keys):
        return T.VariantType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_open_type(kind.elementType, raw_keys))
    return T.StructType(
        [T.StructField(f.name, T.VariantType() if f.name in raw_keys else _open_type(f.dataType, raw_keys)) for f in kind.fields]
    )


def _kept(value: Column, kind: T.DataType, raw_keys: Sequence[str]) -> Column:
    """``value`` of an open type without its raw fields; an object that loses all is an empty one."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _kept(item, kind.elementType, raw_keys))
    if not isinstance(kind, T.StructType):
        return value
    kept = [_kept(value[f.name], f.dataType, raw_keys).alias(f.name) for f in kind.fields if f.name not in raw_keys]
    return F.when(value.isNotNull(), F.struct(*kept) if kept else F.parse_json(F.lit("{}")))


def _n_fields(kind: T.DataType) -> int:
    if isinstance(kind, T.ArrayType):
        return _n_fields(kind.elementType)
    return sum(1 + _n_fields(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 0


def _inner_keys(kind: T.DataType) -> set[str]:
    """The keys of an open type whose values are taken apart."""
    if isinstance(kind, T.ArrayType):
        return _inner_keys(kind.elementType)
    if not isinstance(kind, T.StructType):
        return set()
    inner = {f.name for f in kind.fields if not isinstance(f.dataType, T.VariantType)}
    return inner.union(*(_inner_keys(f.dataType) for f in kind.fields))


def scrub_open(df: DataFrame, column: str, name: str = "clean", raw_keys: Sequence[str] = RAW_KEYS) -> DataFrame:
    """``df`` with ``name``: ``struct<json, warnings, error>`` of the JSON text ``column``, of any shape and depth.

    A field counts as raw by its key alone, also where it holds null.  Keys of an object are written in their
    order by name.  Text that is no JSON has an error and no value; a null text has neither.

    One aggregate merges the schemas of all objects, and of all lists, at the top.  From them one expression
    is built that takes apart only what leads to raw fields.  A row where it does not tell all goes the long way,
    through every object and list: where a null stands instead of an object or list, where the text names more raw
    fields than were found (inside a field of several types), or where keys may be written with escapes.
    """
    text, nothing = F.col(column), F.array().cast("array<string>")
    first = F.substr(F.ltrim(F.translate(text, "\t\r\n", "   ")), F.lit(1), F.lit(1))
    tops = {"{": "object", "[": "list"}
    parsed = F.try_parse_json(text)
    merged = df.agg(*[F.schema_of_variant_agg(F.when(first == c, parsed)).alias(top) for c, top in tops.items()]).first()
    kinds = {c: variant_type(merged[top]) for c, top in tops.items()}
    opened = {c: _open_type(kind, raw_keys) for c, kind in kinds.items()}
    # Each step is a projection of its own, whose columns the next one uses more than once.
    steps = df.withColumns({"_whole": parsed, "_first": first})
    taken = {c: F.when(F.col("_first") == c, F.col("_whole")).try_cast(opened[c]) for c in tops}
    steps = steps.withColumns({f"_{tops[c]}": taken[c] for c in tops})
    value = F.when(~F.col("_first").isin(*tops), F.to_json("_whole"))
    removed, long_way = F.when(F.lit(False), nothing), F.lit(False)
    for c, top in tops.items():
        parts, here = F.col(f"_{top}"), F.col("_first") == c
        if _n_fields(opened[c]) > MOST_FIELDS:
            long_way = long_way | here
            continue
        if isinstance(opened[c], T.VariantType):
            value, removed = value.when(here, F.to_json("_whole")), removed.when(here, nothing)
        else:
            value = value.when(here, F.to_json(_kept(parts, opened[c], raw_keys)))
            removed = removed.when(here, removed_paths(parts, opened[c], raw_keys))
        keys = _inner_keys(opened[c])
        if keys:
            # A null instead of an object or list would be taken for an absent one.
            named = "|".join(map(re.escape, sorted(keys)))
            long_way = long_way | (here & text.rlike(rf'"(?:{named})"\s*:\s*null'))
        # Keys written with escapes are not seen by the patterns; those of ASCII letters have these.
        odd = any(not k.isascii() or re.search(r'["\\\x00-\x1f/]', k) for k in {*keys, *raw_keys})
        long_way = long_way | (here & text.rlike(r"\\" if odd else r"\\u00[2-7]"))
    steps = steps.withColumns({"_value": value, "_removed": F.coalesce(removed, nothing), "_differs": long_way})
    names = "|".join(map(re.escape, raw_keys))
    named = F.regexp_count(text, F.lit(rf'"(?:{names})"\s*:')) > F.size("_removed")
    known = F.col("_whole").isNotNull()
    error = F.when(text.isNotNull() & ~known, NOT_JSON)
    clean = F.struct(
        F.when(known, F.col("_value")).alias("json"), F.when(known, F.col("_removed")).otherwise(nothing).alias("removed"), error.alias("error")
    )
    long_way = F.coalesce(known & F.col("_first").isin(*tops) & (F.col("_differs") | named), F.lit(False))
    # Written once, so that neither the merge nor the parsing is repeated for the rows that go on.
    once = cut_lineage(steps.select(*df.columns, clean.alias(name), long_way.alias("_long")))
    rest = once.where("_long").drop("_long", name)
    out = once.where("not _long").drop("_long")
    if not rest.isEmpty():
        out = out.unionByName(_scrub_any(rest, column, name, raw_keys))
    warnings = F.transform(F.col(name)["removed"], lambda path: F.concat(F.lit(REMOVED), path))
    return out.withColumn(name, F.struct(F.col(name)["json"].alias("json"), warnings.alias("warnings"), F.col(name)["error"].alias("error")))


def _truthy(text: Column) -> Column:
    """A JSON value other than null, false, zero and the empty string, list or object."""
    return text.isNotNull() & ~F.trim(text).isin("", "null", "false", "0", "0.0", '""', "[]", "{}")


def with_selected_blocks(requests: DataFrame, blocks: DataFrame, selection: DataFrame) -> DataFrame:
    """``requests`` with ``selected_analysis_blocks`` made of the blocks that ``selection`` names for each.

    ``blocks`` are preview blocks of any number of datasets, ``selection(request_id, dataset_id, id)`` chooses
    among them.  A request without any has an empty list.
    """
    lists = selected_block_lists(blocks, selection, ["request_id"])
    joined = requests.drop("selected_analysis_blocks").join(lists, "request_id", "left")
    return joined.withColumn("selected_analysis_blocks", F.coalesce("selected_analysis_blocks", F.lit("[]")))


def assemble_payloads(requests: DataFrame) -> DataFrame:
    """Payload per request: the preferred fields if any is filled, else the plain messages, else a rejection.

    ``requests(request_id, system, messages, <preferred fields>, raw_csv, csv, file_content)``: all text;
    title, type and notes are plain text, the other fields JSON.  Raw fields are never read,
    only reported.
    """
    plain = {"experiment_title", "experiment_type", "lab_notes"}
    filled = F.lit(False)
    entries = []
    for name, default in PREFERRED_FIELDS.items():
        column = F.col(name)
        if name in plain:
            filled = filled | F.coalesce(column != "", F.lit(False))
            shown = F.coalesce(F.to_json(F.struct(column.alias("v"))), F.lit("{}"))
            shown = F.regexp_extract(shown, r'(?s)^\{"v":(.*)\}$', 1)
            shown = F.when(column.isNull(), F.lit("null")).otherwise(shown)
        else:
            filled = filled | _truthy(column)
            shown = column if default is None else F.when(_truthy(column), column)
            shown = F.coalesce(shown, F.lit(default or "null"))
        entries.append(F.concat(F.lit(f'"{name}": '), shown))
    preferred = F.concat(F.lit("{"), F.concat_ws(", ", *entries), F.lit("}"))
    source = F.when(filled, preferred).when(_truthy(F.col("messages")), F.col("messages"))
    top = F.array_compact(
        F.array(*[F.when(F.col(k).isNotNull(), F.lit(REMOVED + k)) for k in RAW_KEYS])
    )
    built = requests.select(
        "request_id",
        F.coalesce(F.nullif("system", F.lit("")), F.lit(DEFAULT_SYSTEM)).alias("system"),
        F.when(filled, "preferred").when(source.isNotNull(), "messages").alias("kind"),
        top.alias("_top"),
        source.alias("_source"),
    )
    built = scrub_open(built, "_source", "_clean").withColumn("_value", F.try_parse_json(F.col("_clean.json")))
    value = F.col("_value")
    fields = [
        F.concat(F.lit(f'"{name}":'), F.coalesce(F.to_json(F.variant_get(value, f"$.{name}", "variant")), F.lit("null")))
        for name in PREFERRED_FIELDS
    ]
    ordered = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    return built.select(
        "request_id",
        F.when(F.col("kind").isNotNull(), F.col("system")).alias("system"),
        "kind",
        F.when(value.isNotNull(), F.when(F.col("kind") == "preferred", ordered).otherwise(F.col("_clean.json"))).alias("payload"),
        F.concat("_top", "_clean.warnings").alias("warnings"),
        F.when(F.col("kind").isNull(), REJECTED).otherwise(F.col("_clean.error")).alias("error"),
    )
