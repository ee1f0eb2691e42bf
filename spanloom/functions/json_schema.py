"""JSON Schema (Draft 7) over parsed values: what a schema's columns can't express runs here, in Arrow batches."""

from __future__ import annotations

import ipaddress
import re
from datetime import date, datetime
from functools import lru_cache
from urllib.parse import urlsplit


def _same(a, b) -> bool:
    """Equal as JSON: true is no 1, and 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


_IS = {
    "null": lambda x: x is None, "boolean": lambda x: isinstance(x, bool), "string": lambda x: isinstance(x, str), "array": lambda x: isinstance(x, list), "object": lambda x: isinstance(x, dict),
    "number": _number, "integer": lambda x: _number(x) and float(x).is_integer(),
}


@lru_cache(maxsize=1024)
def _pattern(p: str) -> re.Pattern:
    return re.compile(p)


def _parses(f):
    def ok(s: str) -> bool:
        try:
            f(s)
        except ValueError:
            return False
        return True

    return ok


_FORMATS = {
    "date": _parses(date.fromisoformat), "date-time": _parses(lambda s: datetime.fromisoformat(s.replace("Z", "+00:00"))), "ipv4": _parses(ipaddress.IPv4Address), "ipv6": _parses(ipaddress.IPv6Address),
    "email": lambda s: re.fullmatch(r"[^@\s]+@[^@\s]+", s) is not None, "uri": lambda s: bool(urlsplit(s).scheme), "uuid": lambda s: re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s) is not None,
    "regex": _parses(lambda s: re.compile(s) if _compiles(s) else (_ for _ in ()).throw(ValueError(s))),
}


def _compiles(s: str) -> bool:
    try:
        re.compile(s)
    except re.error:
        return False
    return True


def _target(root, ref: str):
    """What a local reference points at; None where there is nothing."""
    if not ref.startswith("#"):
        return None
    at = root
    for part in ref[1:].split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        at = at[int(part)] if isinstance(at, list) and part.isdigit() and int(part) < len(at) else at.get(part) if isinstance(at, dict) else None
        if at is None:
            return None
    return at


def errors(value, schema, root=None, path: str = "$", depth: int = 0):
    """(path, keyword) of each rule that a value breaks."""
    root = schema if root is None else root
    if schema is True or schema == {} or depth > 64:
        return
    if schema is False:
        yield path, "false"
        return
    if "$ref" in schema:
        target = _target(root, schema["$ref"])
        if target is None:
            yield path, "$ref"
        else:
            yield from errors(value, target, root, path, depth + 1)
        return
    fits = lambda s: not any(True for _ in errors(value, s, root, path, depth + 1))
    kinds = schema.get("type")
    if kinds is not None and not any(_IS[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield path, "type"
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        yield path, "enum"
    if "const" in schema and not _same(value, schema["const"]):
        yield path, "const"
    for word, holds in (("allOf", all), ("anyOf", any), ("oneOf", lambda x: sum(x) == 1)):
        if word in schema and not holds([fits(s) for s in schema[word]]):
            yield path, word
    if "not" in schema and fits(schema["not"]):
        yield path, "not"
    if "if" in schema:
        branch = "then" if fits(schema["if"]) else "else"
        if branch in schema:
            yield from errors(value, schema[branch], root, path, depth + 1)
    if _number(value):
        tests = {"minimum": lambda m: value >= m, "maximum": lambda m: value <= m, "exclusiveMinimum": lambda m: value > m, "exclusiveMaximum": lambda m: value < m, "multipleOf": lambda m: abs(value / m - round(value / m)) < 1e-9}
        yield from ((path, k) for k, ok in tests.items() if k in schema and not ok(schema[k]))
    elif isinstance(value, str):
        tests = {"minLength": lambda n: len(value) >= n, "maxLength": lambda n: len(value) <= n, "pattern": lambda p: _pattern(p).search(value), "format": lambda f: _FORMATS.get(f, lambda _: True)(value)}
        yield from ((path, k) for k, ok in tests.items() if k in schema and not ok(schema[k]))
    elif isinstance(value, list):
        yield from _in_array(value, schema, root, path, depth)
    elif isinstance(value, dict):
        yield from _in_object(value, schema, root, path, depth)


def _in_array(value: list, schema: dict, root, path: str, depth: int):
    items = schema.get("items", True)
    tuple_ = items if isinstance(items, list) else []
    rest = schema.get("additionalItems", True) if isinstance(items, list) else items
    for i, x in enumerate(value):
        yield from errors(x, tuple_[i] if i < len(tuple_) else rest, root, f"{path}[{i}]", depth + 1)
    if len(value) < schema.get("minItems", 0):
        yield path, "minItems"
    if "maxItems" in schema and len(value) > schema["maxItems"]:
        yield path, "maxItems"
    if schema.get("uniqueItems") and any(_same(a, b) for i, a in enumerate(value) for b in value[:i]):
        yield path, "uniqueItems"
    if "contains" in schema and not any(not any(True for _ in errors(x, schema["contains"], root, path, depth + 1)) for x in value):
        yield path, "contains"


def _in_object(value: dict, schema: dict, root, path: str, depth: int):
    own, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
    yield from ((f"{path}.{k}", "required") for k in schema.get("required", ()) if k not in value)
    for k, x in value.items():
        rules = [own[k]] if k in own else []
        rules += [s for p, s in patterns.items() if _pattern(p).search(k)]
        for s in rules or [schema.get("additionalProperties", True)]:
            yield from errors(x, s, root, f"{path}.{k}", depth + 1)
        if "propertyNames" in schema:
            yield from errors(k, schema["propertyNames"], root, f"{path}.{k}", depth + 1)
    if len(value) < schema.get("minProperties", 0):
        yield path, "minProperties"
    if "maxProperties" in schema and len(value) > schema["maxProperties"]:
        yield path, "maxProperties"
    for k, needs in schema.get("dependencies", {}).items():
        if k in value and isinstance(needs, list):
            yield from ((f"{path}.{n}", "dependencies") for n in needs if n not in value)
        elif k in value:
            yield from errors(value, needs, root, path, depth + 1)


#: Keywords that the column form of a schema covers; a schema with any other is validated here.
PLAIN = frozenset("type required properties enum const minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength pattern title description default examples $schema $id $comment".split())


def is_plain(schema) -> bool:
    """Whether a schema and all below it use plain keywords and one type each."""
    return isinstance(schema, dict) and set(schema) <= PLAIN and isinstance(schema.get("type", ""), str) and schema.get("type") != "null" and all(map(is_plain, schema.get("properties", {}).values()))
