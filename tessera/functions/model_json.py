"""Strict checks of JSON that a model has written: VARIANT values against a schema, extra keys refused, every problem with its path.

A schema is a dict of keys (a key ending in ? may be missing), a list of one schema for all elements, or a name: string, integer, number,
boolean, any; ``string?`` and the like may be null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Schema = dict | list | str

# How VARIANT names kinds of values.
KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"]}
_NONE = "cast(array() as array<string>)"


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), "^[A-Z]*", 0)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, not wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _problem(path: Column, what: str) -> Column:
    return F.array(F.concat(path, F.lit(f": {what}")))


def _inside(schema: Schema, path: Column) -> Callable[[Column], Column]:
    return lambda v: _problems(v, schema, path)


def _problems(v: Column, schema: Schema, path: Column) -> Column:
    none = F.expr(_NONE)
    if isinstance(schema, dict):
        wanted = {k.removesuffix("?"): (s, k.endswith("?")) for k, s in schema.items()}

        def of(m: Column) -> Column:
            inner, keys = m["inner"], F.array_sort(F.map_keys(m["inner"]))
            extra = F.transform(F.array_except(keys, F.array(*(F.lit(k) for k in wanted)).cast("array<string>")), lambda k: F.concat(path, F.lit("."), k, F.lit(": extra")))
            parts = [extra]
            for k, (s, optional) in wanted.items():
                at = F.concat(path, F.lit(f".{k}"))
                own = _once(F.element_at(inner, k), _inside(s, at))
                parts.append(F.when(F.map_contains_key(inner, F.lit(k)), own).otherwise(none if optional else _problem(at, "missing")))
            return F.concat(*parts)

        return F.when(_kind(v) == "OBJECT", _once(F.struct(F.try_variant_get(v, "$", "map<string,variant>").alias("inner")), of)).otherwise(_problem(path, "no object"))
    if isinstance(schema, list):
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _problems(x, schema[0], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(_kind(v) == "ARRAY", F.flatten(each)).otherwise(_problem(path, "no list"))
    name, nullable = schema.removesuffix("?"), schema.endswith("?")
    if name == "any":
        return none
    good = _kind(v).isin(KINDS[name])
    if nullable:
        good = good | F.is_variant_null(v)
    return F.when(good, none).otherwise(_problem(path, f"no {name}"))


def json_problems(text: Column, schema: Schema) -> Column:
    """array<string>: what keeps a text from being JSON of that schema, in the schema's order, extra keys first; empty if nothing does.

    Texts that are no JSON, null ones too, have one problem. Of keys given twice in one object the whole text is refused.
    """
    return _once(F.try_parse_json(text), lambda v: F.when(v.isNull(), _problem(F.lit("$"), "no JSON")).otherwise(_problems(v, schema, F.lit("$"))))
