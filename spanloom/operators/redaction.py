"""Redaction of secrets in any text, by patterns and by known values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

PLACEHOLDER = "[REDACTED]"
_NAME = r"(?:[A-Za-z0-9_.-]*(?:api[_-]?key|secret|token|passw(?:or)?d|credential)[A-Za-z0-9_.-]*)"
_SECRET = ("key", "secret", "token", "passw", "credential")

# Labels with their patterns, what replaces a match ($1 keeps a leading group), and texts in
# lower case of which every match holds one (a cheap test, made first).
PATTERNS: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("openai_key", r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{16,}", "sk-" + PLACEHOLDER, ("sk-",)),
    ("nvidia_key", r"(?<![A-Za-z0-9])nvapi-[A-Za-z0-9_-]{16,}", "nvapi-" + PLACEHOLDER, ("nvapi-",)),
    ("github_token", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})", PLACEHOLDER, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    ("aws_access_key", r"(?<![A-Z0-9])(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{16}(?![A-Z0-9])", PLACEHOLDER, ("akia", "asia", "aroa", "aida")),
    ("google_key", r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}", PLACEHOLDER, ("aiza",)),
    ("slack_token", r"(?<![A-Za-z0-9])xox[abporsu]-[A-Za-z0-9-]{10,}", PLACEHOLDER, ("xox",)),
    ("jwt", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", PLACEHOLDER, ("eyj",)),
    ("openshift_token", r"(?<![A-Za-z0-9])sha256~[A-Za-z0-9._~-]{16,}", PLACEHOLDER, ("sha256~",)),
    ("bearer_token", r"\b([Bb]earer\s+)[A-Za-z0-9._~+/=-]{20,}", "$1" + PLACEHOLDER, ("earer",)),
    ("secret_assignment", rf"(?i)({_NAME}\s*=\s*[\"']?)[A-Za-z0-9._~+/=-]{{8,}}", "$1" + PLACEHOLDER, _SECRET),
    ("secret_field", rf"(?im)((?:^[ \t-]*|[\"'{{,]\s*)[\"']?{_NAME}[\"']?\s*:\s*[\"']?)[A-Za-z0-9._~+/=-]{{8,}}", "$1" + PLACEHOLDER, _SECRET),
)


def redact(text: Column, known: Sequence[str] = ()) -> Column:
    """The text with every known value and every match replaced, longest known values first."""
    for value in sorted((k for k in known if k), key=len, reverse=True):
        text = F.replace(text, F.lit(value), F.lit(PLACEHOLDER))
    return _let(F.lower(text), lambda low: _chain(text, low, list(PATTERNS)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _hinted(low: Column, hints: Sequence[str]) -> Column:
    out = F.contains(low, F.lit(hints[0]))
    for h in hints[1:]:
        out = out | F.contains(low, F.lit(h))
    return out


def _chain(text: Column, low: Column, left: list) -> Column:
    """The text after all replacements."""
    if not left:
        return text
    (_, pattern, into, hints), *rest = left
    return _let(F.when(_hinted(low, hints), F.regexp_replace(text, pattern, into)).otherwise(text), lambda t: _chain(t, low, rest))


def counts(text: Column) -> Column:
    """How often each pattern matches, by label; a match is counted by the first pattern that takes it."""

    def step(t: Column, low: Column, left: list, found: list[Column]) -> Column:
        if not left:
            return F.create_map(*found)
        (label, pattern, into, hints), *rest = left
        there = _hinted(low, hints)
        n = F.coalesce(F.when(there, F.regexp_count(t, F.lit(pattern))), F.lit(0))
        both = F.struct(n.alias("n"), F.when(there, F.regexp_replace(t, pattern, into)).otherwise(t).alias("t"))
        return _let(both, lambda s: step(s["t"], low, rest, [*found, F.lit(label), s["n"]]))

    return _let(F.lower(text), lambda low: step(text, low, list(PATTERNS), []))


def redact_table(df: DataFrame, known: Sequence[str] = ()) -> DataFrame:
    """Every string column redacted; columns of other types go through JSON only where they hold strings."""
    return df.withColumns({c: redact(F.col(c), known) for c, kind in df.dtypes if kind == "string"})
