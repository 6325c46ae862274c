"""A subset of JSON Schema as expressions on VARIANT values: type, required, properties, additionalProperties, items."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NONE = "array<string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _is(name: Column, kind: str) -> Column:
    """Whether a value whose schema has that name is of a kind."""
    whole = name.rlike("^(BIGINT|DECIMAL\\(\\d+,0\\))$")
    tests = {
        "object": name.startswith("OBJECT"), "array": name.startswith("ARRAY"), "string": name == "STRING", "boolean": name == "BOOLEAN", "integer": whole,
        "number": whole | name.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "null": name == "VOID",
    }
    return tests.get(kind, F.lit(True))


def errors(value: Column, schema: dict, path: Column | str = "$") -> Column:
    """array<string> of what is wrong with a VARIANT; below a value of a wrong type nothing is looked at.

    The expression is built once from the schema, so it is as large as the schema and not as the values."""
    path = F.lit(path) if isinstance(path, str) else path
    return _let(value, lambda v: _let(F.schema_of_variant(v), lambda name: _let(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), lambda fields: _errors(v, name, fields, schema, path))))


def _errors(value: Column, name: Column, fields: Column, schema: dict, path: Column) -> Column:
    empty = F.array().cast(_NONE)
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    fits = F.lit(True)
    if kinds:
        fits = _is(name, kinds[0])
        for kind in kinds[1:]:
            fits = fits | _is(name, kind)
    found = []
    properties = schema.get("properties", {})
    if properties or schema.get("required") or "additionalProperties" in schema:
        inside = [F.when(~F.array_contains(fields, key), F.concat(path, F.lit(f".{key} missing"))) for key in schema.get("required", [])]
        parts = [F.filter(F.array(*inside), lambda x: x.isNotNull())] if inside else []
        for key, sub in properties.items():
            there = F.array_contains(fields, key)
            parts.append(F.when(there, errors(F.try_variant_get(value, f"$.{key}", "variant"), sub, F.concat(path, F.lit(f".{key}")))).otherwise(empty))
        if schema.get("additionalProperties") is False:
            parts.append(F.transform(F.filter(fields, lambda x: ~x.isin(*properties) if properties else F.lit(True)), lambda x: F.concat(path, F.lit("."), x, F.lit(" undefined"))))
        if parts:
            found.append(F.when(_is(name, "object"), F.concat(*parts)).otherwise(empty))
    if "items" in schema:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: errors(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        found.append(F.when(_is(name, "array"), F.flatten(each)).otherwise(empty))
    wrong = F.array(F.concat(path, F.lit(f" is not {'/'.join(kinds)}")))
    return F.when(~fits, wrong).otherwise(F.concat(*found) if found else empty)


def json_errors(text: Column, schema: dict) -> Column:
    """errors of a JSON text whose top level must be an object."""

    def found(value):
        return F.when(value.isNull(), F.array(F.lit("$ is not JSON"))).when(~_is(F.schema_of_variant(value), "object"), F.array(F.lit("$ is not an object"))).otherwise(errors(value, schema))

    return _let(F.try_parse_json(text), found)
