"""Texts in a format (JSON, YAML, TOML, XML) against required parts and a schema, in Arrow batches."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, functions as F

from ..functions import json_schema

FORMATS = ("json", "yaml", "xml", "toml")


def _yaml(text: str):
    import yaml

    return yaml.safe_load(text)


def _xml(text: str):
    if re.search(r"<!(?:DOCTYPE|ENTITY)", text, re.I):  # entities could grow without bound
        raise ValueError("document types are not read")
    return ElementTree.fromstring(text)


_PARSE = {"json": json.loads, "yaml": _yaml, "xml": _xml, "toml": tomllib.loads}


def fenced(text: str, fmt: str) -> str:
    """The first code block of the format or of none, else the whole text."""
    m = re.search(rf"```(?:{fmt})?\s*(.*?)```", text, re.S | re.I)
    return m[1].strip() if m else text


def problems(text: str | None, fmt: str, keys: Sequence[str] = (), elements: Sequence[str] = (), schema: Mapping | None = None, extract: bool = True) -> list[str]:
    """What is wrong with a text: that it doesn't parse, a missing key or element, up to five broken rules."""
    body = fenced(text or "", fmt) if extract else text or ""
    if not body.strip():
        return ["empty"]
    try:
        data = _PARSE[fmt](body)
    except Exception as e:  # each parser has its own kinds of error
        return [f"parse: {type(e).__name__}"]
    out = [f"key: {k}" for k in keys if isinstance(data, dict) and k not in data]
    if fmt == "xml":
        out += [f"element: {e}" for e in elements if data.find(f".//{e}") is None]
    elif schema and fmt in ("json", "yaml"):
        out += [f"schema: {path} {word}" for path, word in list(json_schema.errors(data, schema))[:5]]
    return out


def structure(text: Column, fmt: str, required: Sequence[str] = (), elements: Sequence[str] = (), schema: Mapping | None = None, extract: bool = True) -> Column:
    """Whether a text parses in a format and holds the required keys, elements and schema: 1 or 0."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([problems(t, fmt, required, elements, schema, extract) for t in texts])

    return F.transform(F.array(run(text)), lambda e: F.struct((F.size(e) == 0).cast("double").alias("score"), (F.size(e) == 0).alias("passed"), e.alias("problems")))[0]


def schema_share(text: str | None, schema: Mapping, additional: bool = True) -> float:
    """1 where a JSON text fits its schema; else the weighted share of the named fields that do, required ones twice."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return 0.0
    if not additional:
        schema = {"additionalProperties": False, **schema}
    broken = {path for path, _ in json_schema.errors(data, schema)}
    if not broken:
        return 1.0
    fields: dict[str, float] = {}

    def walk(s, path: str) -> None:
        for k, sub in (s.get("properties") or {}).items() if isinstance(s, Mapping) else ():
            fields[f"{path}.{k}"] = 2.0 if k in s.get("required", ()) else 1.0
            walk(sub, f"{path}.{k}")

    walk(schema, "$")
    total = sum(fields.values())
    good = sum(w for f, w in fields.items() if not any(b == f or b.startswith((f + ".", f + "[")) for b in broken))
    return min(good / total, 1.0 - 1e-9) if total else 0.0


def schema_udf(schema: Mapping, additional: bool = True):
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([schema_share(t, schema, additional) for t in texts], dtype="float64")

    return run
