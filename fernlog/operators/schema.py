"""JSON Schemas as column rules: what a schema says of JSON records, keyword by keyword, nested arrays and objects included."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlog.operators.audit import check_constraints

Rule = Callable[[Column], Column]
_IGNORED = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format"}


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _is(v: Column, name: str) -> Column:
    kind = _kind(v)
    numeric = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return {
        "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"),
        "number": numeric, "integer": numeric & (_number(v) == F.floor(_number(v))),
    }[name]


def _items(v: Column) -> Column:
    return F.when(_is(v, "array"), v.cast("array<variant>"))


def _fields(v: Column) -> Column:
    return F.when(_is(v, "object"), v.cast("map<string,variant>"))


def compile_schema(schema: dict | bool, path: str = "$") -> dict[str, Rule]:
    """Rules of a schema by ``path: keyword``: functions from a variant to whether it holds. Null means that the keyword doesn't apply.

    Known are type, enum, const, minLength, maxLength, pattern, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minItems, maxItems,
    items, required, properties, additionalProperties (false or a schema). ValueError for any other keyword, so that none is passed over.
    """
    if schema is True:
        return {}
    if schema is False:
        return {f"{path}: false": lambda v: v.isNull()}
    out: dict[str, Rule] = {}
    text = lambda v: F.when(_is(v, "string"), F.try_variant_get(v, "$", "string"))
    number = lambda v: F.when(_is(v, "number"), _number(v))
    known = schema.get("properties", {})
    simple: dict[str, Callable[[object], Rule]] = {
        "type": lambda x: lambda v: _any([_is(v, t) for t in ([x] if isinstance(x, str) else x)]),
        "enum": lambda x: lambda v: F.to_json(v).isin([json.dumps(e, separators=(",", ":"), ensure_ascii=False) for e in x]),
        "const": lambda x: lambda v: F.to_json(v) == json.dumps(x, separators=(",", ":"), ensure_ascii=False),
        "minLength": lambda x: lambda v: F.length(text(v)) >= x,
        "maxLength": lambda x: lambda v: F.length(text(v)) <= x,
        "pattern": lambda x: lambda v: text(v).rlike(x),
        "minimum": lambda x: lambda v: number(v) >= x,
        "maximum": lambda x: lambda v: number(v) <= x,
        "exclusiveMinimum": lambda x: lambda v: number(v) > x,
        "exclusiveMaximum": lambda x: lambda v: number(v) < x,
        "multipleOf": lambda x: lambda v: F.pmod(number(v), F.lit(float(x))) == 0,
        "minItems": lambda x: lambda v: F.size(_items(v)) >= x,
        "maxItems": lambda x: lambda v: F.size(_items(v)) <= x,
    }
    for word, x in schema.items():
        if word in simple:
            out[f"{path}: {word}"] = simple[word](x)
        elif word == "required":
            for k in x:
                out[f"{path}: required {k}"] = lambda v, k=k: F.map_contains_key(_fields(v), k)
        elif word == "properties":
            for k, sub in x.items():
                for name, rule in compile_schema(sub, f"{path}.{k}").items():
                    out[name] = lambda v, k=k, rule=rule: rule(F.try_element_at(_fields(v), F.lit(k)))
        elif word == "items":
            for name, rule in compile_schema(x, f"{path}[*]").items():
                out[name] = lambda v, rule=rule: F.forall(_items(v), _held(rule))
        elif word == "additionalProperties":
            others = lambda v: F.map_filter(_fields(v), lambda k, _: ~k.isin(list(known)) if known else F.lit(True))
            if x is False:
                out[f"{path}: additionalProperties"] = lambda v, others=others: F.size(others(v)) == 0
            elif x is not True:
                for name, rule in compile_schema(x, f"{path}.*").items():
                    out[name] = lambda v, rule=rule, others=others: F.forall(F.map_values(others(v)), _held(rule))
        elif word not in _IGNORED:
            raise ValueError(f"{path}: keyword {word} is not known")
    return out


def _held(rule: Rule) -> Rule:
    """Of an element: nothing to say counts as held."""
    return lambda e: F.coalesce(rule(e), F.lit(True))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def check_json(records: DataFrame, column: str, schema: dict | str) -> DataFrame:
    """JSON texts of ``column`` against a schema: rule, checked, broken (records that break it), in one pass. ``$: json`` counts what is no JSON.

    A null text is no record. The schema is a dict or JSON text.
    """
    rules = compile_schema(json.loads(schema) if isinstance(schema, str) else schema)
    parsed = records.where(F.col(column).isNotNull()).select(F.try_parse_json(column).alias("v"))
    return check_constraints(parsed, {"$: json": F.col("v").isNotNull()} | {name: rule(F.col("v")) for name, rule in rules.items()})


def broken_json(records: DataFrame, column: str, schema: dict | str) -> DataFrame:
    """``records`` that break a schema, with ``broken``: the names of the rules."""
    rules = compile_schema(json.loads(schema) if isinstance(schema, str) else schema)
    v = F.col("_v")
    tests = {"$: json": v.isNotNull()} | {name: rule(v) for name, rule in rules.items()}
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(n)) for n, ok in tests.items()]))
    rows = records.where(F.col(column).isNotNull()).withColumn("_v", F.try_parse_json(column))
    return rows.select(*records.columns, names.alias("broken")).where(F.size("broken") > 0)
