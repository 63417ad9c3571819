"""A JSON-Schema subset compiled to one column: the list of `path: message` of a raw JSON text.

Values are looked at as variants, so a missing key and a null stay apart. Keywords that are not known fail when the
column is made, and `forbidden` lists keys whose mere presence is an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_KINDS = {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID", "array": "ARRAY", "object": "OBJECT", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE"}
_KNOWN = {"type", "enum", "const", "pattern", "minLength", "maxLength", "minimum", "maximum", "items", "minItems", "maxItems", "properties", "required", "additionalProperties", "forbidden"}
_IGNORED = {"$schema", "$id", "title", "description", "default", "examples"}


def _say(path: Column, text: str) -> Column:
    return F.concat(path, F.lit(": " + text))


def _checks(schema: dict, v: Column, path: Column) -> Column:
    """An array of messages on the variant v (which is there)."""
    unknown = set(schema) - _KNOWN - _IGNORED
    if unknown:
        raise ValueError(f"schema keywords that are not known: {sorted(unknown)}")
    kind = F.schema_of_variant(v)
    is_ = lambda name: kind.rlike(f"^({_KINDS[name]})")
    text, number = F.when(is_("string"), F.try_variant_get(v, "$", "string")), F.when(is_("number"), F.try_variant_get(v, "$", "double"))
    out: list[Column] = []
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok = F.lit(False)
        for n in names:
            ok |= is_(n)
        out.append(F.when(~ok, _say(path, "is not of type " + "|".join(names))))
    if "enum" in schema:
        values = [x for x in schema["enum"] if x is not None]
        null_ok = F.lit(len(values) < len(schema["enum"])) & is_("null")
        out.append(F.when(~(F.coalesce(F.try_variant_get(v, "$", "string").isin(*[str(x) for x in values]), F.lit(False)) | null_ok), _say(path, "is outside its closed set")))
    if "const" in schema:
        out.append(F.when(~F.coalesce(F.try_variant_get(v, "$", "string") == F.lit(str(schema["const"])), F.lit(False)), _say(path, f"is not {schema['const']}")))
    if "pattern" in schema:
        out.append(F.when(~text.rlike(schema["pattern"]), _say(path, "does not match its pattern")))
    for key, column, less in (("minLength", F.length(text), True), ("maxLength", F.length(text), False), ("minimum", number, True), ("maximum", number, False)):
        if key in schema:
            out.append(F.when(column < schema[key] if less else column > schema[key], _say(path, f"breaks {key} {schema[key]}")))
    parts = [F.array_compact(F.array(*out))] if out else []
    if {"items", "minItems", "maxItems"} & set(schema):
        items = F.when(is_("array"), F.try_variant_get(v, "$", "array<variant>"))
        size = F.size(items)
        bounds = [F.when(is_("array") & (size < schema[k] if k == "minItems" else size > schema[k]), _say(path, f"breaks {k} {schema[k]}")) for k in ("minItems", "maxItems") if k in schema]
        parts += [F.array_compact(F.array(*bounds))] if bounds else []
        if "items" in schema:
            each = F.transform(items, lambda x, i: _checks(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            parts.append(F.coalesce(F.flatten(each), F.array().cast("array<string>")))
    if {"properties", "required", "additionalProperties", "forbidden"} & set(schema):
        keys = F.coalesce(F.when(is_("object"), F.json_object_keys(F.to_json(v))), F.array().cast("array<string>"))
        rows = [F.when(is_("object") & ~F.array_contains(keys, k), _say(path, f"lacks {k}")) for k in schema.get("required", [])]
        rows += [F.when(F.array_contains(keys, k), _say(path, f"has the forbidden {k}")) for k in schema.get("forbidden", [])]
        parts += [F.array_compact(F.array(*rows))] if rows else []
        if schema.get("additionalProperties") is False:
            extra = F.array_except(keys, F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>"))
            parts.append(F.transform(extra, lambda k: F.concat(path, F.lit(": has the unknown "), k)))
        for name, sub in schema.get("properties", {}).items():
            inner = _checks(sub, F.try_variant_get(v, f"$.{name}", "variant"), F.concat(path, F.lit("." + name)))
            parts.append(F.when(F.array_contains(keys, name), inner).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts) if parts else F.array().cast("array<string>")


def schema_faults(raw: Column, schema: dict) -> Column:
    """Messages on a JSON text; text that is no JSON has one."""
    v = F.try_parse_json(raw)
    return F.when(v.isNull(), F.array(F.lit("$: is not JSON"))).otherwise(_checks(schema, v, F.lit("$")))
