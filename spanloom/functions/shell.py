"""Shell lines as data: an Arrow UDF turns a line into commands; everything after that is columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F, types as T

_TEXTS = T.ArrayType(T.StringType())
COMMANDS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("word", T.StringType()), T.StructField("args", _TEXTS), T.StructField("redirects", _TEXTS), T.StructField("piped", T.BooleanType()),
]))
_SET = re.compile(r"([A-Za-z_]\w*)=(.*)\Z", re.S)
_VAR = re.compile(r"\$(?:\{(\w+)\}|(\w+))")
_EXPORTS = ("export", "declare", "local", "readonly", "env")


def lex(line: str) -> list[tuple[str, str]] | None:
    """(kind, text) tokens, kind one of word, op, redirect; None for an unclosed quote.

    Quotes and backslashes are taken as a POSIX shell does; substitutions are not run.
    """
    out: list[tuple[str, str]] = []
    word: list[str] | None = None
    i, n = 0, len(line)

    def close() -> None:
        nonlocal word
        if word is not None:
            out.append(("word", "".join(word)))
        word = None

    while i < n:
        c = line[i]
        if c == "'":
            j = line.find("'", i + 1)
            if j < 0:
                return None
            word = (word or []) + [line[i + 1 : j]]
            i = j + 1
        elif c == '"':
            word, i = word or [], i + 1
            while i < n and line[i] != '"':
                if line[i] == "\\" and i + 1 < n and line[i + 1] in '"\\$`':
                    i += 1
                word.append(line[i])
                i += 1
            if i >= n:
                return None
            i += 1
        elif c == "\\" and i + 1 < n:
            word = (word or []) + [line[i + 1]]
            i += 2
        elif c in " \t\r":
            close()
            i += 1
        elif c in ";|&\n()":
            close()
            j = i + 1
            while j < n and line[j] == c and c in ";|&":
                j += 1
            out.append(("op", line[i:j]))
            i = j
        elif c in "<>":
            if word is not None and "".join(word).isdigit():
                word = None
            close()
            j = i
            while j < n and line[j] in "<>&|":
                j += 1
            out.append(("redirect", line[i:j]))
            i = j
        else:
            word = (word or []) + [c]
            i += 1
    close()
    return out


def parse(line: str | None) -> list[dict]:
    """The commands that a line runs, variables that it sets put in; none for a line that can't be read."""
    tokens, values, out, now = lex(line or ""), {}, [], None
    piped, target, setting = False, False, True
    for kind, text in tokens or []:
        if kind == "op":
            now, piped, target, setting = None, text == "|", False, True
            continue
        if kind == "redirect":
            target = True
            continue
        text = _VAR.sub(lambda m: values.get(m[1] or m[2], m[0]), text)
        m = _SET.match(text) if setting and not target else None
        if m:
            values[m[1]] = m[2]
        elif target:
            target = False
            if now is not None:
                now["redirects"].append(text)
        elif now is None:
            now = {"name": text.rsplit("/", 1)[-1].lower(), "word": text, "args": [], "redirects": [], "piped": piped}
            out.append(now)
            setting = now["name"] in _EXPORTS
        else:
            now["args"].append(text)
    return out


@F.pandas_udf(COMMANDS)
def shell_commands(lines: pd.Series) -> pd.Series:
    return lines.map(parse)


@F.pandas_udf(T.ArrayType(COMMANDS))
def shell_commands_each(lines: pd.Series) -> pd.Series:
    """The commands of each of an array of lines."""
    return lines.map(lambda xs: [] if xs is None else [parse(x) for x in xs])
