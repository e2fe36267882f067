"""Rules of schemas against single records."""

import json

import pytest

from fernlog.operators import schema

RULES = {
    "type": "object", "required": ["a"], "additionalProperties": {"type": "boolean"},
    "properties": {
        "a": {"type": ["string", "null"], "minLength": 2, "maxLength": 3, "pattern": "^[a-zé]+$"}, "n": {"type": "integer", "minimum": 1, "exclusiveMaximum": 10, "multipleOf": 2}, "c": {"const": {"k": [1, 2]}}, "e": {"enum": ["é", 1, None, False]},
        "list": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {"x": {"maximum": 5}}, "additionalProperties": False}}},
    },
}
CASES = {
    '{"a": "ab"}': [], '{"a": null, "n": 4.0, "e": null, "z": true}': [], '{"a": "éé", "e": "é", "c": {"k": [1, 2]}, "list": [[], [{"x": 5}, {"x": "text"}]]}': [],
    "[1]": ["$: type"], '"a"': ["$: type"], "{": ["$: json"], "": ["$: json"], "{}": ["$: required a"], '{"a": 5}': ["$.a: type"],
    '{"a": "a"}': ["$.a: minLength"], '{"a": "ABCD"}': ["$.a: maxLength", "$.a: pattern"], '{"a": "ab", "n": 0}': ["$.n: minimum"], '{"a": "ab", "n": 10}': ["$.n: exclusiveMaximum"], '{"a": "ab", "n": 3}': ["$.n: multipleOf"], '{"a": "ab", "n": 2.5}': ["$.n: multipleOf", "$.n: type"],
    '{"a": "ab", "c": {"k": [2, 1]}}': ["$.c: const"], '{"a": "ab", "e": "1"}': ["$.e: enum"], '{"a": "ab", "e": true}': ["$.e: enum"], '{"a": "ab", "z": 1, "y": false}': ["$.*: type"],
    '{"a": "ab", "list": []}': ["$.list: minItems"], '{"a": "ab", "list": [[], [], []]}': ["$.list: maxItems"], '{"a": "ab", "list": [1]}': ["$.list[*]: type"], '{"a": "ab", "list": [[{}]]}': ["$.list[*][*]: required x"], '{"a": "ab", "list": [[{"x": 6, "y": 1}], [{"x": 1}]]}': ["$.list[*][*].x: maximum", "$.list[*][*]: additionalProperties"], '{"a": "ab", "list": "no"}': ["$.list: type"],
}


def test_keywords(spark):
    df = spark.createDataFrame([(t,) for t in [*CASES, None]], "record string")
    got = {r.record: sorted(r.broken) for r in schema.broken_json(df, "record", RULES).collect()}
    assert got == {t: sorted(b) for t, b in CASES.items() if b}
    counts = {r.rule: (r.checked, r.broken) for r in schema.check_json(df, "record", json.dumps(RULES)).collect()}
    assert all(counts[rule] == (len(CASES), sum(rule in b for b in CASES.values())) for rule in counts) and counts.keys() >= {r for b in CASES.values() for r in b}


def test_unknown_keywords_are_refused():
    with pytest.raises(ValueError, match=r"\$\.a: keyword oneOf"):
        schema.compile_schema({"properties": {"a": {"oneOf": []}}})
    assert schema.compile_schema(True) == {} and list(schema.compile_schema(False)) == ["$: false"]
