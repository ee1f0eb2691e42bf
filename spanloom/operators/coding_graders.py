"""Graders of code an agent wrote, on captured output: exit codes, tests, linters, scanners and diffs."""

from __future__ import annotations

import ast
import difflib
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType

from ..functions.scalars import diff_counts, test_counts


def _grade(score: Column, passed: Column, **more: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), passed.alias("passed"), *[c.alias(n) for n, c in more.items()])


def exit_code(code: Column, expected: int = 0) -> Column:
    ok = F.coalesce(code == expected, F.lit(False))
    return _grade(ok.cast("double"), ok)


def output_patterns(stdout: Column, must: Sequence[str] = (), must_not: Sequence[str] = ()) -> Column:
    """Whether captured output matches all of ``must`` and none of ``must_not``."""
    ok = F.lit(True)
    for p in must:
        ok = ok & stdout.rlike(p)
    for p in must_not:
        ok = ok & ~stdout.rlike(p)
    ok = F.coalesce(ok, F.lit(False))
    return _grade(ok.cast("double"), ok)


def integration_test(stdout: Column, code: Column, threshold: float = 1.0) -> Column:
    """Share of tests passed; without counts in the output the exit code decides."""
    n = test_counts(stdout)
    score = F.when(n["total"] > 0, n["passed"] / n["total"].cast("double")).otherwise((code == 0).cast("double"))
    return _grade(F.coalesce(score, F.lit(0.0)), F.coalesce(score >= threshold, F.lit(False)), tests=F.coalesce(n["total"], F.lit(0)))


def lint(stdout: Column, max_errors: int = 0, weights: Mapping[str, float] = {"E": 1.0, "F": 1.0, "W": 0.3, "C": 0.3}) -> Column:  # noqa: B006
    """``path:line:col: CODE text`` lines: the weighted count against the limit."""
    codes = F.regexp_extract_all(F.coalesce(stdout, F.lit("")), F.lit(r"(?m)^[^\s:]+:\d+:\d+:? ([A-Z])\d+"), F.lit(1))
    weight = F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(w))])
    total = F.aggregate(codes, F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(weight, c), F.lit(0.0)))
    errors = F.size(F.filter(codes, lambda c: c.isin("E", "F")))
    return _grade(1.0 - F.least(F.lit(1.0), total / (max_errors + 1)), errors <= max_errors, errors=errors, warnings=F.size(codes) - errors)


def type_check(stdout: Column, max_errors: int = 0) -> Column:
    """``path:line: error: text`` lines against a limit; beyond it the share of errors within it."""
    n = F.regexp_count(F.coalesce(stdout, F.lit("")), F.lit(r"(?m)^[^\s:]+:\d+(:\d+)?: error:"))
    return _grade(F.when(n <= max_errors, 1.0).otherwise(1.0 - (n - max_errors) / n.cast("double")), n <= max_errors, errors=n)


# Code that a scan reports as HIGH.
BLOCKED_CODE = (r"\beval\s*\(", r"\bexec\s*\(", r"os\.system\s*\(", r"subprocess\.[a-z_]+\([^)]*shell\s*=\s*True", r"pickle\.loads?\s*\(", r"yaml\.load\s*\((?![^)]*Safe)")


def security_scan(code: Column, bandit: Column | None = None, fail_at: str = "HIGH", blocked: Sequence[str] = BLOCKED_CODE) -> Column:
    """Lines that match a blocked pattern, and a scanner's JSON report, at a severity or worse."""
    lines = F.split(F.coalesce(code, F.lit("")), "\n")
    own = F.size(F.filter(lines, lambda x: x.rlike("|".join(f"(?:{p})" for p in blocked))))
    levels = ("LOW", "MEDIUM", "HIGH")
    listed = F.from_json(F.get_json_object(bandit, "$.results"), "array<struct<issue_severity:string>>") if bandit is not None else F.array().cast("array<struct<issue_severity:string>>")
    more = F.size(F.filter(F.coalesce(listed, F.array()), lambda r: r["issue_severity"].isin(*levels[levels.index(fail_at) :])))
    n = own + more
    return _grade((n == 0).cast("double"), n == 0, issues=n)


def diff_size(diff: Column, max_added: int | None = None, max_removed: int | None = None, max_total: int | None = None) -> Column:
    """The least of limit / size over the limits; passes where none is broken."""
    d = diff_counts(F.coalesce(diff, F.lit("")))
    parts = [(d["added"], max_added), (d["removed"], max_removed), (d["added"] + d["removed"], max_total)]
    ratios = [F.when(n <= limit, 1.0).otherwise(F.lit(float(limit)) / n) for n, limit in parts if limit is not None]
    score = F.least(*ratios) if len(ratios) > 1 else ratios[0] if ratios else F.lit(1.0)
    return _grade(score, score == 1.0, added=d["added"], removed=d["removed"])


def _tree(text: str) -> str | None:
    try:
        return ast.dump(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError):
        return None


def likeness(a: str | None, b: str | None, how: str = "sequence") -> float:
    """Likeness of two texts from 0 to 1: whole, without spacing, by sequence, or 1 for equal Python trees."""
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    if how == "exact":
        return 0.0
    if how == "normalized":
        return float(re.sub(r"\s+", " ", a).strip() == re.sub(r"\s+", " ", b).strip())
    if how == "ast" and _tree(a) is not None and _tree(a) == _tree(b):
        return 1.0
    return difflib.SequenceMatcher(None, a, b).ratio()


def likeness_udf(how: str = "sequence"):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y, how) for x, y in zip(a, b)], dtype="float64")

    return run


@F.pandas_udf(StringType())
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(["".join(difflib.unified_diff((x or "").splitlines(True), (y or "").splitlines(True), "a", "b")) for x, y in zip(a, b)])


def diff_accuracy(expected: DataFrame, generated: DataFrame, how: str = "sequence", threshold: float = 0.9, by: str = "trial_id") -> DataFrame:
    """Mean likeness, by weight, of expected ``(by, path, content, weight)`` to generated files; a missing file is empty."""
    d = expected.join(generated.select(by, "path", F.col("content").alias("_got")), [by, "path"], "left")
    d = d.withColumn("_like", likeness_udf(how)(F.col("content"), F.coalesce("_got", F.lit("")))).groupBy(by).agg((F.sum(F.col("_like") * F.col("weight")) / F.sum("weight")).alias("score"))
    return d.withColumn("passed", F.col("score") >= threshold)


def file_union(expected: DataFrame, generated: DataFrame, by: str = "trial_id") -> DataFrame:
    """(by, path, before, after) of every path on either side of two tables ``(by, path, content)``; absent files are empty."""
    sides = [d.select(by, "path", F.col("content").alias(n)) for d, n in ((expected, "before"), (generated, "after"))]
    both = sides[0].join(sides[1], [by, "path"], "full_outer")
    return both.select(by, "path", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))


def named_tests(results: DataFrame, expected: DataFrame, by: str = "trial_id") -> DataFrame:
    """Verdicts where every expected ``(by, test, kind)`` passed in ``(by, stdout)``; a test that didn't run failed."""
    line = r"(?m)^(PASSED|FAILED|ERROR)\s+(\S+)"
    ran = results.select(by, F.explode(F.arrays_zip(F.regexp_extract_all("stdout", F.lit(line), F.lit(1)).alias("s"), F.regexp_extract_all("stdout", F.lit(line), F.lit(2)).alias("t"))).alias("x"))
    ran = ran.groupBy(by, F.col("x.t").alias("test")).agg(F.bool_and(F.col("x.s") == "PASSED").alias("ok"))
    d = expected.join(ran, [by, "test"], "left").groupBy(by).agg(F.avg(F.coalesce(F.col("ok"), F.lit(False)).cast("double")).alias("score"))
    return d.withColumn("passed", F.col("score") == 1.0)
