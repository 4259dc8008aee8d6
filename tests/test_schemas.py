"""The schema compiler against a loop over parsed JSON."""

import json
import random
import re

from pyspark.sql import functions as F

from millrace.operators import schemas

SCHEMA = {
    "type": "object", "required": ["a", "b"], "additionalProperties": False,
    "properties": {
        "a": {"type": "integer", "minimum": 0, "maximum": 9},
        "b": {"type": ["string", "null"], "minLength": 1, "maxLength": 3, "pattern": "^[a-z]*$"},
        "c": {"enum": ["x", 1, None, True]},
        "d": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number", "minimum": 0.5}, "m": {"type": "array", "items": {"type": "boolean"}}}}},
        "e": {"type": "object", "properties": {"f": {"type": "object", "required": ["g"], "additionalProperties": False, "properties": {"g": {}}}}},
    },
}


def kind(v):
    return "null" if v is None else "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "integer" if v == int(v) else "number"


def by_hand(v, s, path="$"):
    out, k = [], kind(v)
    types = [s["type"]] if isinstance(s.get("type"), str) else s.get("type", [])
    if types and k not in types and not (k == "integer" and "number" in types):
        out.append((path, "type"))
    if "enum" in s and not any(kind(v) in (kind(o), "integer" if kind(o) == "number" else kind(o)) and v == o for o in s["enum"]):
        out.append((path, "enum"))
    if k in ("integer", "number"):
        out += [(path, w) for w, bad in (("minimum", lambda m: v < m), ("maximum", lambda m: v > m)) if w in s and bad(s[w])]
    if k == "string":
        out += [(path, w) for w, bad in (("minLength", lambda m: len(v) < m), ("maxLength", lambda m: len(v) > m), ("pattern", lambda m: not re.search(m, v))) if w in s and bad(s[w])]
    if k == "object":
        out += [(f"{path}.{r}", "required") for r in s.get("required", ()) if r not in v]
        for name, own in s.get("properties", {}).items():
            if name in v:
                out += by_hand(v[name], own, f"{path}.{name}")
        if s.get("additionalProperties") is False:
            out += [(f"{path}.{x}", "additional") for x in sorted(v) if x not in s.get("properties", {})]
    if k == "array":
        out += [(path, w) for w, bad in (("minItems", lambda m: len(v) < m), ("maxItems", lambda m: len(v) > m)) if w in s and bad(s[w])]
        for i, x in enumerate(v if "items" in s else []):
            out += by_hand(x, s["items"], f"{path}[{i}]")
    return out


def value(rnd, depth=0):
    simple = [None, True, False, 0, 1, 5, 12, -3, 0.25, 2.5, 3.0, "", "x", "abc", "abcd", "A1"]
    if depth > 3 or rnd.random() < 0.5:
        return rnd.choice(simple)
    if rnd.random() < 0.4:
        return [value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return {k: value(rnd, depth + 1) for k in rnd.sample("abcdefgnm", rnd.randint(0, 5))}


def test_violations_against_a_loop(spark):
    rnd = random.Random(12)
    good = {"a": 3, "b": "ab", "c": "x", "d": [{"n": 1, "m": [True]}], "e": {"f": {"g": 1}}}
    docs = [good, {**good, "b": None, "c": None}]
    for _ in range(300):
        doc = dict(good)
        for k in rnd.sample("abcdex", rnd.randint(0, 4)):
            doc[k] = value(rnd)
        if rnd.random() < 0.3:
            doc.pop(rnd.choice("ab"), None)
        if rnd.random() < 0.5:
            doc["d"] = [{"n": value(rnd), "m": [value(rnd, 4) for _ in range(2)]} for _ in range(rnd.randint(0, 3))]
        docs.append(doc if rnd.random() < 0.95 else value(rnd))
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, raw string")
    got = {r.i: [tuple(x) for x in r.v] for r in df.select("i", schemas.violations(F.col("raw"), SCHEMA).alias("v")).collect()}
    for i, d in enumerate(docs):
        assert got[i] == by_hand(d, SCHEMA), (d, got[i])
    assert got[0] == got[1] == [] and len({x[1] for v in got.values() for x in v}) == 11


def test_what_is_no_json(spark):
    rows = [(0, None), (1, ""), (2, "{"), (3, '{"a": 1} x'), (4, "[1, 2]"), (5, "null"), (6, "1], [2"), (7, "1, 2"), (8, "1}, {2")]
    got = {r.i: [tuple(x) for x in r.v] for r in spark.createDataFrame(rows, "i int, raw string").select("i", schemas.violations(F.col("raw"), SCHEMA).alias("v")).collect()}
    assert all(got[i] == [("$", "json")] for i in (0, 1, 2, 3, 6, 7, 8)) and got[4] == got[5] == [("$", "type")]
    assert spark.createDataFrame([(1, "{}")], "i int, raw string").select(schemas.violations(F.col("raw"), {}).alias("v")).first().v == []
