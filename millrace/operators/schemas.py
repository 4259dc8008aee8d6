"""Untrusted JSON against a nested schema: a compiler from the schema to columns that tell every violation and where it is.

Documents are parsed once, as VARIANT. A schema is a dict with the usual words: type (a name or a list of names), required,
properties, additionalProperties (False), items, enum, minimum, maximum, minLength, maxLength, pattern, minItems and maxItems.
Paths are `$.a.b[2].c`. Nothing leaves the JVM; nested arrays are higher-order functions.
"""

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog import Catalog
from millrace.io import load

catalog = Catalog()
QUERIES, ORACLE_SQL = catalog.queries, catalog.sql

VIOLATION = "array<struct<path: string, problem: string>>"


def kind_of(value: Column) -> Column:
    """The JSON type of a variant: null, boolean, integer, number, string, array or object."""
    whole = F.try_variant_get(value, "$", "double") % 1 == 0
    of = lambda s: (
        F.when(s.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "boolean").when(s == "BIGINT", "integer").when(s == "STRING", "string").when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object").when(whole, "integer").otherwise("number")
    )
    return let(F.schema_of_variant(value), of)


def problem(path: Column, name: str, cond: Column) -> Column:
    """The violation, if cond holds (null counts as no)."""
    one = F.array(F.struct(path.alias("path"), F.lit(name).alias("problem")))
    return F.when(F.coalesce(cond, F.lit(False)), one).otherwise(F.array().cast(VIOLATION))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def checked(value: Column, schema: dict[str, Any], path: Column) -> Column:
    """Violations of a variant that is there, in the order of the schema."""
    parts = {"kind": kind_of, "text": lambda v: F.try_variant_get(v, "$", "string"), "number": lambda v: F.try_variant_get(v, "$", "double"), "flag": lambda v: F.try_variant_get(v, "$", "boolean")}
    if "required" in schema or "properties" in schema or schema.get("additionalProperties") is False:
        parts["members"] = lambda v: F.try_variant_get(v, "$", "map<string, variant>")
    if any(w in schema for w in ("items", "minItems", "maxItems")):
        parts["elements"] = lambda v: F.try_variant_get(v, "$", "array<variant>")
    return let(value, lambda v: let(F.struct(*(f(v).alias(k) for k, f in parts.items())), lambda x: rules(x, schema, path)))


def rules(x: Column, schema: dict[str, Any], path: Column) -> Column:
    """The same for a value as a struct of kind, text, number, flag and, where the schema asks, members and elements."""
    kind, text, number = x["kind"], x["text"], x["number"]
    found = []
    types = schema.get("type")
    if types:
        names = [types] if isinstance(types, str) else list(types)
        if "number" in names:
            names.append("integer")
        found.append(problem(path, "type", ~kind.isin(*names)))
    is_text, is_number = kind == "string", kind.isin("integer", "number")
    if "enum" in schema:
        options = schema["enum"]
        same = F.lit(False)
        for o in options:
            if o is None:
                same = same | (kind == "null")
            elif isinstance(o, bool):
                same = same | ((kind == "boolean") & (x["flag"] == o))
            elif isinstance(o, int | float):
                same = same | (is_number & (number == float(o)))
            else:
                same = same | (is_text & (text == o))
        found.append(problem(path, "enum", ~F.coalesce(same, F.lit(False))))
    for word, bad in (("minimum", number < schema.get("minimum", 0)), ("maximum", number > schema.get("maximum", 0))):
        if word in schema:
            found.append(problem(path, word, is_number & bad))
    for word, bad in (("minLength", F.char_length(text) < schema.get("minLength", 0)), ("maxLength", F.char_length(text) > schema.get("maxLength", 0)), ("pattern", ~text.rlike(schema.get("pattern", "")))):
        if word in schema:
            found.append(problem(path, word, is_text & bad))
    if "required" in schema or "properties" in schema or schema.get("additionalProperties") is False:
        members = x["members"]
        is_object = kind == "object"
        names = F.map_keys(members)
        for key in schema.get("required", ()):
            found.append(problem(F.concat(path, F.lit(f".{key}")), "required", is_object & ~F.array_contains(names, key)))
        for key, own in schema.get("properties", {}).items():
            there = is_object & F.array_contains(names, key)
            inner = checked(F.element_at(members, F.lit(key)), own, F.concat(path, F.lit(f".{key}")))
            found.append(F.when(F.coalesce(there, F.lit(False)), inner).otherwise(F.array().cast(VIOLATION)))
        if schema.get("additionalProperties") is False:
            known = F.array(*(F.lit(k) for k in schema.get("properties", {}))).cast("array<string>")
            extra = F.transform(F.array_sort(F.array_except(names, known)), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("additional").alias("problem")))
            found.append(F.when(is_object, extra).otherwise(F.array().cast(VIOLATION)))
    if any(w in schema for w in ("items", "minItems", "maxItems")):
        elements, is_array = x["elements"], kind == "array"
        for word, bad in (("minItems", F.size(elements) < schema.get("minItems", 0)), ("maxItems", F.size(elements) > schema.get("maxItems", 0))):
            if word in schema:
                found.append(problem(path, word, is_array & bad))
        if "items" in schema:
            inner = F.flatten(F.transform(elements, lambda e, i: checked(e, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
            found.append(F.when(is_array, inner).otherwise(F.array().cast(VIOLATION)))
    return F.concat(*found) if found else F.array().cast(VIOLATION)


def violations(raw: Column, schema: dict[str, Any]) -> Column:
    """All violations of JSON text, an array of path and problem; text that is no JSON, or null, has the problem `json`."""
    # the parser stops after the first value; what follows shows inside of brackets and braces
    inside = lambda left, right: F.try_parse_json(F.concat(F.lit(left), raw, F.lit(right)))
    alone = F.when(inside('{"v": ', "}").isNotNull(), F.try_variant_get(inside("[", "]"), "$", "array<variant>"))
    unread = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("problem")))
    return let(alone, lambda v: F.when(F.coalesce(F.size(v) == 1, F.lit(False)), checked(F.get(v, F.lit(0)), schema, F.lit("$"))).otherwise(unread))


#: What an event must look like.
EVENT_SCHEMA = {
    "type": "object", "required": ["user", "value", "kind"], "additionalProperties": False,
    "properties": {
        "kind": {"enum": ["view", "click", "signup", "purchase"]},
        "value": {"type": "number", "minimum": 0, "maximum": 90},
        "user": {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer", "minimum": 1}, "name": {"type": "string", "pattern": "^u[0-9]+$", "maxLength": 3}}},
        "seen": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"type": "object", "properties": {"k": {"type": ["integer", "null"], "maximum": 50}}}},
    },
}


@catalog.query("schema_check", """
WITH e AS (SELECT event_id, user_id AS u, event_type AS t, value AS v, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CASE WHEN v >= 97 THEN '$:json' ELSE array_to_string(list_filter([CASE WHEN t = 'signup' THEN '$.value:required' END, CASE WHEN t = 'error' THEN '$.kind:enum' END, CASE WHEN t = 'click' THEN '$.value:type' END, CASE WHEN t NOT IN ('signup', 'click') AND v > 90 THEN '$.value:maximum' END,
  CASE WHEN t = 'purchase' THEN '$.user.id:required' END, CASE WHEN t <> 'purchase' AND u < 1 THEN '$.user.id:minimum' END, CASE WHEN length(u::VARCHAR) > 2 THEN '$.user.name:maxLength' END,
  CASE WHEN k % 5 = 0 THEN '$.seen:minItems' END, CASE WHEN k % 5 = 4 THEN '$.seen:maxItems' END, CASE WHEN k % 5 >= 1 AND k > 50 THEN '$.seen[0].k:maximum' END, CASE WHEN k % 5 >= 2 THEN '$.seen[1].k:type' END, CASE WHEN k > 70 THEN '$.k:additional' END], lambda x: x IS NOT NULL), ',') END AS problems FROM e""")
def schema_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents made of events, with what is wrong with them and where."""
    k, t = F.get_json_object("props", "$.k").cast("long"), F.col("event_type")
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    value = F.when(t == "signup", F.lit(None)).when(t == "click", F.concat(F.lit('"value": '), quoted(F.col("value")))).otherwise(F.concat(F.lit('"value": '), F.col("value").cast("string")))
    ident = F.when(t != "purchase", F.concat(F.lit('"id": '), F.col("user_id").cast("string")))
    user = F.concat(F.lit('"user": {'), F.concat_ws(", ", ident, F.concat(F.lit('"name": "u'), F.col("user_id").cast("string"), F.lit('"'))), F.lit("}"))
    one = F.array(F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}")), F.lit('{"k": true}'), F.lit('{"k": null}'), F.lit("{}"))
    seen = F.concat(F.lit('"seen": ['), F.concat_ws(", ", F.slice(one, F.lit(1), (k % 5).cast("int"))), F.lit("]"))
    extra = F.when(k > 70, F.concat(F.lit('"k": '), k.cast("string")))
    raw = F.concat(F.lit("{"), F.concat_ws(", ", F.concat(F.lit('"kind": '), quoted(t)), value, user, seen, extra), F.when(F.col("value") >= 97, "").otherwise("}"))
    found = load(spark, d, "events").select("event_id", violations(raw, EVENT_SCHEMA).alias("v"))
    return found.select("event_id", F.concat_ws(",", F.transform("v", lambda x: F.concat_ws(":", x["path"], x["problem"]))).alias("problems"))
