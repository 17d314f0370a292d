"""Model answers: JSON recovery and JSON Schema checks as columns."""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

_MARK = "\u2063end-of-answer\u2063"
# What stands between two fences; white space around it is stripped afterwards.
_FENCE = r"(?s)`{3}(?:json)?(.*?)`{3}"

# Characters of a raw answer kept as a last resort.
RAW_ANSWER_CHARS = 2000


def is_json(text: Column) -> Column:
    """True when the whole text is one JSON value.

    The text is put into an array before a mark: trailing text either breaks the array or changes
    what follows the first element. NaN and Infinity are not accepted.
    """
    boxed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f', "{_MARK}"]')))
    fits = let(
        boxed.try_cast("array<variant>"),
        lambda a: (F.size(a) == 2) & (F.get(a, F.lit(1)).try_cast("string") == _MARK),
    )
    return F.coalesce(fits, F.lit(False))


def balanced(text: Column, opening: str, closing: str) -> Column:
    """Text from the first ``opening`` to its matching ``closing``; NULL without a match.

    Quotes do not count. The text is cut at the brackets, so the scan takes one step per bracket.
    """
    start = F.instr(text, F.lit(opening))
    pieces = F.regexp_extract_all(
        F.substr(text, F.greatest(start, F.lit(1))),
        F.lit(rf"[\{opening}\{closing}][^\{opening}\{closing}]*"),
        F.lit(0),
    )
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("used"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + F.when(piece.startswith(opening), 1).otherwise(-1)
        closed = (acc["end"] == 0) & (depth == 0)
        return F.struct(
            F.when(acc["end"] > 0, acc["depth"]).otherwise(depth).alias("depth"),
            (acc["used"] + F.char_length(piece)).alias("used"),
            F.when(closed, acc["used"] + 1).otherwise(acc["end"]).alias("end"),
        )

    end = F.aggregate(pieces, zero, step)["end"]
    return F.when(
        start > 0, let(end, lambda n: F.when(n > 0, F.substr(text, start, n)))
    )


def recover_json(raw: Column) -> Column:
    """JSON text inside an answer: whole, in a code fence, or the first balanced object or array."""

    def checked(candidate: Column) -> Column:
        return let(candidate, lambda c: F.when(is_json(c), c))

    def search(text: Column) -> Column:
        return (
            F.when(is_json(text), text)
            .otherwise(
                F.coalesce(
                    F.when(text.rlike(_FENCE), checked(strip(F.regexp_extract(text, _FENCE, 1)))),
                    checked(balanced(text, "{", "}")),
                    checked(balanced(text, "[", "]")),
                )
            )
        )

    return let(strip(raw), search)


_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
_BOUNDS = ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum")
_SIZES = ("minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties", "minContains", "maxContains")
# Where schemas stand in a schema: alone, in a list, by name.
_ONE = ("items", "not", "additionalProperties", "propertyNames", "contains", "if", "then", "else")
_LISTED = ("anyOf", "allOf", "oneOf", "prefixItems")
_NAMED = ("properties", "patternProperties", "dependentSchemas")
_KEYWORDS = {"type", "required", "enum", "const", "pattern", "multipleOf", "uniqueItems", "dependentRequired", *_BOUNDS, *_SIZES, *_ONE, *_LISTED, *_NAMED}
_NOTES = {"$schema", "$id", "title", "description", "default", "examples", "$comment", "format", "definitions", "$defs"}
_TYPES = {"object", "array", "string", "number", "integer", "boolean", "null"}


class SchemaError(ValueError):
    """The JSON Schema itself is wrong or uses a keyword that is not supported."""


def _target(root, ref):
    """What a reference inside the schema points to."""
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        raise SchemaError(f"reference outside the schema: {ref}")
    at = root
    for step in unquote(ref).split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(at, dict) and step in at:
            at = at[step]
        elif isinstance(at, list) and step.isdigit() and int(step) < len(at):
            at = at[int(step)]
        else:
            raise SchemaError(f"reference to nothing: {ref}")
    return at


def _parts(schema, make):
    """The schema with ``make`` applied to each schema directly inside it."""
    out = dict(schema)
    for name in _ONE:
        if name in out:
            out[name] = make(out[name])
    for name in _LISTED:
        if isinstance(out.get(name), list):
            out[name] = [make(sub) for sub in out[name]]
        elif name in out:
            raise SchemaError(f"{name} must be a list")
    for name in _NAMED:
        if isinstance(out.get(name), dict):
            out[name] = {key: make(sub) for key, sub in out[name].items()}
        elif name in out:
            raise SchemaError(f"{name} must be an object")
    return out


def resolve_schema(schema):
    """The schema with its references (``#`` and ``#/...``) replaced by what they point to.

    A reference joins the keywords beside it (drafts up to 7: it stands alone). ``dependencies`` counts in those drafts only, where ``$schema``
    names one. A schema that contains itself raises ``SchemaError``: an expression cannot be endless.
    """
    old = isinstance(schema, dict) and "draft-0" in str(schema.get("$schema", ""))

    def walk(node, inside):
        if isinstance(node, bool):
            return node
        if not isinstance(node, dict):
            raise SchemaError("a schema must be an object")
        out = dict(node)
        needed = out.pop("dependencies", {})
        if old and needed:
            if not isinstance(needed, dict):
                raise SchemaError("dependencies must be an object")
            lists = {k: v for k, v in needed.items() if isinstance(v, list)}
            out["dependentRequired"] = {**lists, **out.get("dependentRequired", {})}
            out["dependentSchemas"] = {**{k: v for k, v in needed.items() if k not in lists}, **out.get("dependentSchemas", {})}
        if "$ref" not in out:
            return _parts(out, lambda sub: walk(sub, inside))
        ref = out.pop("$ref")
        if ref in inside:
            raise SchemaError(f"a schema that contains itself: {ref}")
        target = walk(_target(schema, ref), (*inside, ref))
        if old:
            return target
        out = _parts(out, lambda sub: walk(sub, inside))
        return {**out, "allOf": [target, *out.get("allOf", [])]}

    # The whole schema is "#": a reference back to it from inside never ends.
    return walk(schema, ("#",))


def _is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _check_pattern(pattern) -> None:
    try:
        re.compile(pattern)
    except (re.error, TypeError, OverflowError) as error:
        raise SchemaError(f"not a pattern: {pattern}") from error


def check_schema(schema) -> None:
    """Raise ``SchemaError`` unless the schema can be turned into a column. Patterns must be valid in both Python and Java."""
    _check(resolve_schema(schema))


def _check(schema):
    if isinstance(schema, bool):
        return schema
    unknown = set(schema) - _KEYWORDS - _NOTES
    if unknown:
        raise SchemaError(f"unsupported keyword: {', '.join(sorted(unknown))}")
    types = schema.get("type", [])
    for name in [types] if isinstance(types, str) else types:
        if name not in _TYPES:
            raise SchemaError(f"unknown type: {name}")
    for name in ("required", "enum"):
        if not isinstance(schema.get(name, []), list):
            raise SchemaError(f"{name} must be a list")
    if not all(isinstance(key, str) for key in schema.get("required", [])):
        raise SchemaError("required must list names")
    for name in _BOUNDS:
        if name in schema and not _is_number(schema[name]):
            raise SchemaError(f"{name} must be a number")
    for name in _SIZES:
        size = schema.get(name, 0)
        if not _is_number(size) or size < 0 or size != int(size):
            raise SchemaError(f"{name} must be a whole number from 0")
    if "multipleOf" in schema and not (_is_number(schema["multipleOf"]) and schema["multipleOf"] > 0):
        raise SchemaError("multipleOf must be a number above 0")
    if not isinstance(schema.get("uniqueItems", False), bool):
        raise SchemaError("uniqueItems must be true or false")
    needed = schema.get("dependentRequired", {})
    if not isinstance(needed, dict) or not all(isinstance(names, list) for names in needed.values()):
        raise SchemaError("dependentRequired must hold lists by name")
    for pattern in [*([schema["pattern"]] if "pattern" in schema else []), *schema.get("patternProperties", {})]:
        _check_pattern(pattern)
    return _parts(schema, _check)


def _is_type(value: Column, name: str) -> Column:
    kind = F.schema_of_variant(value)
    number = kind.rlike(rf"\A(?:{'|'.join(_NUMBERS)})")
    if name == "integer":
        as_double = value.try_cast("double")
        return (kind == "BIGINT") | (number & (as_double == F.floor(as_double)))
    return {
        "object": kind.startswith("OBJECT"),
        "array": kind.startswith("ARRAY"),
        "string": kind == "STRING",
        "number": number,
        "boolean": kind == "BOOLEAN",
        "null": kind == "VOID",
    }[name]


def _text_of(value: Column) -> Column:
    """JSON text with the keys of objects in order, for comparisons."""
    return F.to_json(value)


def _member(value: Column, name: str) -> Column:
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise SchemaError(f"property name with both kinds of quotes: {name}")
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def matches_schema(value: Column, schema) -> Column:
    """True when the VARIANT value satisfies the schema; the schema becomes one expression."""
    whole = resolve_schema(schema)
    _check(whole)
    return F.coalesce(_matches(value, whole), F.lit(False))


def _fits(value: Column, schema) -> Column:
    return F.coalesce(_matches(value, schema), F.lit(False))


def _absent_or_matching(schema):
    return lambda member: member.isNull() | _fits(member, schema)


def _matches(value: Column, schema) -> Column:
    if isinstance(schema, bool):
        return F.lit(schema)
    ok = F.lit(True)
    types = schema.get("type")
    if types is not None:
        hit = F.lit(False)
        for name in [types] if isinstance(types, str) else types:
            hit = hit | _is_type(value, name)
        ok = ok & hit
    is_object, is_array = _is_type(value, "object"), _is_type(value, "array")
    is_string, is_number = _is_type(value, "string"), _is_type(value, "number")

    def only_for(kind: Column, rule: Column) -> Column:
        return ~kind | F.coalesce(rule, F.lit(False))

    for name in schema.get("required", []):
        ok = ok & only_for(is_object, _member(value, name).isNotNull())
    for name, sub in schema.get("properties", {}).items():
        ok = ok & only_for(is_object, let(_member(value, name), _absent_or_matching(sub)))
    keys = F.json_object_keys(F.to_json(value))
    members = F.map_entries(value.try_cast("map<string,variant>"))

    def all_match(entries: Column, sub) -> Column:
        return F.forall(entries, lambda e: _fits(e["value"], sub))

    for pattern, sub in schema.get("patternProperties", {}).items():
        ok = ok & only_for(is_object, all_match(F.filter(members, lambda e: e["key"].rlike(pattern)), sub))
    if "additionalProperties" in schema:
        named, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))

        def is_extra(entry: Column) -> Column:
            known = entry["key"].isin(named) if named else F.lit(False)
            for pattern in patterns:
                known = known | entry["key"].rlike(pattern)
            return ~known

        ok = ok & only_for(is_object, all_match(F.filter(members, is_extra), schema["additionalProperties"]))
    if "propertyNames" in schema:
        as_value = lambda k: F.parse_json(F.to_json(F.array(k)))
        named_ok = F.forall(keys, lambda k: _fits(F.variant_get(as_value(k), "$[0]", "variant"), schema["propertyNames"]))
        ok = ok & only_for(is_object, named_ok)
    for name, others in schema.get("dependentRequired", {}).items():
        for other in others:
            ok = ok & only_for(is_object, _member(value, name).isNull() | _member(value, other).isNotNull())
    for name, sub in schema.get("dependentSchemas", {}).items():
        ok = ok & only_for(is_object, _member(value, name).isNull() | _fits(value, sub))
    if "minProperties" in schema:
        ok = ok & only_for(is_object, F.size(keys) >= schema["minProperties"])
    if "maxProperties" in schema:
        ok = ok & only_for(is_object, F.size(keys) <= schema["maxProperties"])
    items = value.try_cast("array<variant>")
    first = schema.get("prefixItems", [])
    for place, sub in enumerate(first):
        ok = ok & only_for(is_array, (F.size(items) <= place) | _fits(F.get(items, F.lit(place)), sub))
    if "items" in schema:
        rest = F.slice(items, len(first) + 1, F.greatest(F.size(items), F.lit(1))) if first else items
        ok = ok & only_for(is_array, F.forall(rest, lambda v: _fits(v, schema["items"])))
    if "contains" in schema:
        hits = F.size(F.filter(items, lambda v: _fits(v, schema["contains"])))
        enough = hits >= schema.get("minContains", 1)
        ok = ok & only_for(is_array, enough & (hits <= schema["maxContains"]) if "maxContains" in schema else enough)
    if "minItems" in schema:
        ok = ok & only_for(is_array, F.size(items) >= schema["minItems"])
    if "maxItems" in schema:
        ok = ok & only_for(is_array, F.size(items) <= schema["maxItems"])
    if schema.get("uniqueItems"):
        texts = F.transform(items, _text_of)
        ok = ok & only_for(is_array, F.size(F.array_distinct(texts)) == F.size(texts))
    if "enum" in schema:
        texts = [F.to_json(F.parse_json(F.lit(json.dumps(v)))) for v in schema["enum"]]
        ok = ok & (_text_of(value).isin(*texts) if texts else F.lit(False))
    if "const" in schema:
        ok = ok & (_text_of(value) == F.to_json(F.parse_json(F.lit(json.dumps(schema["const"])))))
    number = value.try_cast("double")
    for name, rule in (
        ("minimum", lambda b: number >= b),
        ("maximum", lambda b: number <= b),
        ("exclusiveMinimum", lambda b: number > b),
        ("exclusiveMaximum", lambda b: number < b),
        ("multipleOf", lambda b: number / F.lit(float(b)) == F.floor(number / F.lit(float(b)))),
    ):
        if name in schema:
            ok = ok & only_for(is_number, rule(schema[name]))
    text = value.try_cast("string")
    if "minLength" in schema:
        ok = ok & only_for(is_string, F.char_length(text) >= schema["minLength"])
    if "maxLength" in schema:
        ok = ok & only_for(is_string, F.char_length(text) <= schema["maxLength"])
    if "pattern" in schema:
        ok = ok & only_for(is_string, text.rlike(schema["pattern"]))
    for sub in schema.get("allOf", []):
        ok = ok & F.coalesce(_matches(value, sub), F.lit(False))
    if "anyOf" in schema:
        hit = F.lit(False)
        for sub in schema["anyOf"]:
            hit = hit | F.coalesce(_matches(value, sub), F.lit(False))
        ok = ok & hit
    if "oneOf" in schema:
        hits = F.lit(0)
        for sub in schema["oneOf"]:
            hits = hits + F.coalesce(_matches(value, sub), F.lit(False)).cast("int")
        ok = ok & (hits == 1)
    if "not" in schema:
        ok = ok & ~_fits(value, schema["not"])
    if "if" in schema:
        ok = ok & F.when(_fits(value, schema["if"]), _fits(value, schema.get("then", True))).otherwise(_fits(value, schema.get("else", True)))
    return ok
