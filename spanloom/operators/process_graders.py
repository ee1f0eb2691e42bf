"""Graders of how an agent worked: columns over a transcript's nested ``tool_calls``.

A call is a struct with tool_name, status (ok, error, blocked), duration_ms, input, output (JSON texts), cost_usd,
tokens, cached_tokens, tool_type and state_delta.  Each grader is a Column of (score, passed, ...); none shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def _count(calls: Column, test) -> Column:
    return F.size(F.filter(calls, test))


def _share(checks: Sequence[Column]) -> tuple[Column, Column]:
    """(share of checks that hold, whether all hold); no check: (1, true)."""
    if not checks:
        return F.lit(1.0), F.lit(True)
    total = sum((c.cast("int") for c in checks[1:]), checks[0].cast("int"))
    return total / F.lit(float(len(checks))), total == len(checks)


def _grade(score: Column, passed: Column, **more: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), passed.alias("passed"), *[c.alias(n) for n, c in more.items()])


def canonical(json_text: Column, limit: int | None = None) -> Column:
    """JSON with sorted keys, cut to ``limit`` characters; text that isn't JSON stays as it is.

    The limit counts JSON written with a space after each comma and colon, as it usually is.
    """
    out = F.coalesce(F.to_json(F.try_parse_json(json_text)), json_text)
    if not limit:
        return out
    spaced = F.regexp_replace(F.left(out, F.lit(limit)), _UP_TO_MARK, "$1$2 ")
    return F.left(F.when(F.try_parse_json(json_text).isNotNull(), spaced).otherwise(out), F.lit(limit))


#: Strings and other text up to a comma or colon outside strings; the text may be cut within a string.
_UP_TO_MARK = r'\G((?:"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|$)|[^",:])*+)([,:])'


def most_repeated(keys: Column) -> Column:
    """How often the commonest element of an array occurs; 0 for an empty one."""
    runs = F.aggregate(
        F.array_sort(keys),
        F.struct(F.lit(None).cast("string").alias("key"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda a, k: F.struct(
            k.alias("key"),
            F.when(a["key"].eqNullSafe(k), a["run"] + 1).otherwise(1).alias("run"),
            F.greatest(a["most"], F.when(a["key"].eqNullSafe(k), a["run"] + 1).otherwise(1)).alias("most"),
        ),
    )
    return runs["most"]


def tool_usage(calls: Column, required: Sequence[str] = (), forbidden: Sequence[str] = (), max_calls: int = 50, max_retries: int = 3) -> Column:
    """Required tools called, forbidden ones not, not too many calls, no failing call repeated too often."""
    names = F.transform(calls, lambda c: c["tool_name"])
    failed = F.transform(F.filter(calls, lambda c: c["status"] == "error"), lambda c: F.concat(c["tool_name"], F.lit(":"), F.coalesce(c["input"], F.lit(""))))
    checks = [F.array_contains(names, t) for t in required] + [~F.array_contains(names, t) for t in forbidden]
    score, passed = _share([*checks, F.size(calls) <= max_calls, most_repeated(failed) <= max_retries])
    return _grade(score, passed, tool_calls=F.size(calls), distinct_tools=F.size(F.array_distinct(names)))


def cost_budget(calls: Column, max_usd: float = 1.0, max_tokens: int = 100_000, price: Mapping[str, float] | None = None, count_cached: bool = False) -> Column:
    """Cost and fresh tokens within budget; the score falls to a half as the cost nears its limit, 0 beyond."""
    listed = F.create_map(*[x for t, p in (price or {"": 0.0}).items() for x in (F.lit(t), F.lit(float(p)))])
    cost = F.aggregate(calls, F.lit(0.0), lambda a, c: a + F.coalesce(c["cost_usd"], F.try_element_at(listed, c["tool_name"]), F.lit(0.0)))
    tokens = F.aggregate(calls, F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c["tokens"], F.lit(0)) - (F.lit(0) if count_cached else F.coalesce(c["cached_tokens"], F.lit(0))))
    passed = cost <= max_usd
    if max_tokens:
        passed = passed & (tokens <= max_tokens)
    used = 1.0 - 0.5 * F.least(F.lit(1.0), cost / max_usd) if max_usd > 0 else F.lit(1.0)
    return _grade(F.when(passed, used).otherwise(0.0), passed, cost_usd=cost, budgeted_tokens=tokens)


def latency_budget(calls: Column, total_ms: Column | None = None, max_total_ms: float = 30_000, max_call_ms: float = 10_000) -> Column:
    """The whole within its budget and no call over its own."""
    total = F.coalesce(total_ms if total_ms is not None else F.lit(None).cast("double"), F.aggregate(calls, F.lit(0.0), lambda a, c: a + F.coalesce(c["duration_ms"], F.lit(0.0))))
    slow = _count(calls, lambda c: c["duration_ms"] > max_call_ms)
    passed = (total <= max_total_ms) & (slow == 0)
    return _grade(F.when(passed, 1.0 - 0.5 * F.least(F.lit(1.0), total / max_total_ms)).otherwise(0.0), passed, total_ms=total, slow_calls=slow)


def efficiency(calls: Column, has_output: Column, expected_calls: int | None = None) -> Column:
    """Output at all, few errors, and a number of calls near the expected one."""
    n, errors = F.size(calls), _count(calls, lambda c: c["status"] == "error")
    parts = [has_output.cast("double"), F.when(n > 0, F.greatest(F.lit(0.0), 1.0 - F.try_divide(errors.cast("double"), n))).otherwise(0.5)]
    if expected_calls:
        ratio = n / F.lit(float(expected_calls))
        parts.append(F.when(ratio <= 1.5, 1.0).when(ratio <= 3.0, 0.5).otherwise(0.0))
    score = sum(parts[1:], parts[0]) / len(parts)
    return _grade(score, score >= 0.5, tool_count=n, error_count=errors)


def turn_count(calls: Column, max_turns: int = 10, min_turns: int = 1, scoring: str = "budget", count: str = "all", threshold: float = 0.7) -> Column:
    """A score of the number of turns: flat then falling (budget), straight (linear) or logarithmic."""
    turns = {"all": F.size(calls), "llm": _count(calls, lambda c: c["tool_type"] == "llm"), "non_error": _count(calls, lambda c: c["status"] != "error")}[count]
    t = turns.cast("double")
    if scoring == "linear":
        span = max_turns - min_turns
        score = F.when(turns <= min_turns, 1.0).when(turns >= max_turns, 0.0).otherwise(1.0 - (t - min_turns) / span if span > 0 else F.lit(0.0))
    elif scoring == "logarithmic":
        ideal = float(min_turns or 1)
        score = F.when(turns <= ideal, 1.0).when(turns >= max_turns, 0.0)
        score = score.otherwise(F.greatest(F.lit(0.0), 1.0 - F.ln(t / ideal) / F.ln(F.lit(max_turns / ideal))) if max_turns > ideal else F.lit(1.0))
    elif scoring == "budget":
        score = F.when(turns <= max_turns, 1.0).otherwise(F.try_divide(F.lit(float(max_turns)), t))
    else:
        raise ValueError(f"unknown scoring {scoring!r}")
    score = F.when(turns == 0, 0.0).otherwise(score)
    return _grade(score, score >= threshold, turns=turns)


def longest_sequence_run(names: Column, length: int) -> Column:
    """The most repeats in a row of one sequence of ``length`` names, counted from the sequence's first repeated start.

    Repeats at a start are 1 + the number of further blocks equal to it: runs of positions equal to the one
    ``length`` later, in whole blocks.
    """
    n = F.size(names)
    # walking back, run = how many positions from here on equal their partner one block later
    places = F.when(n >= 2 * length, F.reverse(F.sequence(F.lit(0), n - length - 1))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0).alias("run"), F.array().cast("array<struct<pattern:string,repeats:int>>").alias("found"))

    def step(a, i):
        same = F.get(names, i) == F.get(names, i + length)
        run = F.when(same, a["run"] + 1).otherwise(0)
        repeats = (1 + F.floor(run / length)).cast("int")
        pattern = F.array_join(F.slice(names, i + 1, F.lit(length)), "→")
        hit = F.array(F.struct(pattern.alias("pattern"), repeats.alias("repeats")))
        return F.struct(run.alias("run"), F.when(repeats >= 2, F.concat(hit, a["found"])).otherwise(a["found"]).alias("found"))

    found = F.aggregate(places, start, step)["found"]
    # of each pattern only its first start counts
    firsts = F.aggregate(
        found,
        F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("most")),
        lambda a, p: F.when(F.array_contains(a["seen"], p["pattern"]), a).otherwise(
            F.struct(F.concat(a["seen"], F.array(p["pattern"])).alias("seen"), F.greatest(a["most"], p["repeats"]).alias("most"))
        ),
    )
    return firsts["most"]


def loop_detection(calls: Column, max_single: int = 10, max_exact: int = 3, max_sequence: int = 3, ignore: Sequence[str] = (), lengths: tuple[int, int] = (2, 5), check_output: bool = True, include_llm: bool = False) -> Column:
    """The mean of four checks: one tool too often, one exact call too often, repeating sequences, repeated outputs."""
    calls = F.filter(calls, lambda c: ~c["tool_name"].isin(*ignore) & (F.lit(include_llm) | ~F.coalesce(c["tool_type"] == "llm", F.lit(False))))
    names = F.transform(calls, lambda c: c["tool_name"])
    single = most_repeated(names)
    exact = most_repeated(F.transform(calls, lambda c: F.concat(c["tool_name"], F.lit(":"), F.coalesce(canonical(c["input"], 100), F.lit("")))))
    sequence = F.greatest(*[longest_sequence_run(names, k) for k in range(lengths[0], lengths[1] + 1)])
    output = most_repeated(F.transform(F.filter(calls, lambda c: c["output"].isNotNull()), lambda c: F.concat(c["tool_name"], F.lit(":"), canonical(c["output"], 200))))

    def over(n: Column, limit: int, slope: float) -> Column:
        return F.when(n > limit, F.greatest(F.lit(0.0), 1.0 - (n / F.lit(float(limit)) - 1.0) * slope)).otherwise(1.0)

    parts = [over(single, max_single, 0.5), over(exact, max_exact, 0.5), over(sequence, max_sequence, 0.3)]
    if check_output:
        parts.append(F.when(output > 1, 0.7).otherwise(1.0))
    score = F.when(F.size(calls) == 0, 1.0).otherwise(sum(parts[1:], parts[0]) / len(parts))
    bad = (single > max_single) | (exact > max_exact) | (sequence > max_sequence)
    return _grade(score, ~bad & (score >= 0.5), single_repeats=single, exact_repeats=exact, sequence_repeats=sequence, output_repeats=output)


# Words in the call after an error by which an agent shows that it has seen it.
EXPLAINING = ("error", "fix", "retry", "adjust")


def self_correction(calls: Column, max_retries: int = 3, require_recovery: bool = False) -> Column:
    """Errors recovered from by the next call, success in the end, and few immediate repeats of a tool."""
    error = lambda c: c["status"] == "error"
    n, pairs = F.size(calls), F.arrays_zip(F.slice(calls, 1, F.greatest(F.size(calls) - 1, F.lit(0))).alias("a"), F.slice(calls, 2, F.greatest(F.size(calls) - 1, F.lit(0))).alias("b"))
    errors = _count(calls, error)
    recovered = F.size(F.filter(pairs, lambda p: error(p["a"]) & ~error(p["b"])))
    retries = F.size(F.filter(pairs, lambda p: p["a"]["tool_name"] == p["b"]["tool_name"]))
    explained = F.size(F.filter(pairs, lambda p: error(p["a"]) & F.lower(F.coalesce(p["b"]["input"], F.lit(""))).rlike("|".join(EXPLAINING))))
    final = F.when(n > 0, ~error(F.element_at(calls, -1))).otherwise(False)
    patience = F.when(retries <= max_retries, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (retries - max_retries) / F.lit(float(max_retries))))
    score = (F.when(errors > 0, recovered / errors.cast("double")).otherwise(1.0) + final.cast("double") + patience) / 3
    passed = F.when(F.lit(require_recovery) & (errors > 0), final & (recovered > 0)).otherwise(score >= 0.6)
    return _grade(score, passed, errors=errors, recoveries=recovered, retries=retries, explained=explained)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a shell-style pattern; ``*`` crosses every character."""
    return "^(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def matches_tool(name: Column, pattern: str) -> Column:
    """Tool-name patterns: ``*``, ``prefix.*``, ``*.suffix``, or the name."""
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith(".*"):
        return name.startswith(pattern[:-1])
    return name.endswith(pattern[1:]) if pattern.startswith("*.") else name == pattern


def matches_change(change: Column, matcher: Mapping[str, str]) -> Column:
    """Whether a state change has the matcher's kind, op and target (a glob); only mappings are matchers."""
    if not isinstance(matcher, Mapping) or set(matcher) - {"kind", "op", "target"}:
        raise ValueError(f"not a matcher: {matcher!r}")
    ok = F.lit(True)
    for key in ("kind", "op"):
        if key in matcher:
            ok = ok & (change[key] == matcher[key])
    return ok & change["target"].rlike(glob_regex(matcher["target"])) if "target" in matcher else ok


def state_delta(calls: Column, readonly: bool = False, forbid: Sequence[Mapping] = (), require: Sequence[Mapping] = (), max_changes: int | None = None) -> Column:
    """The share of rules on recorded state changes that hold."""
    changes = F.flatten(F.transform(calls, lambda c: F.coalesce(c["state_delta"], F.array())))
    checks = [F.size(changes) == 0] if readonly else []
    checks += [~_any_change(changes, m) for m in forbid]
    checks += [_any_change(changes, m) for m in require]
    if max_changes is not None:
        checks.append(F.size(changes) <= max_changes)
    score, passed = _share(checks)
    return _grade(score, passed, changes=F.size(changes))


def _any_change(changes: Column, matcher: Mapping) -> Column:
    return F.exists(changes, lambda s: matches_change(s, matcher))


def leaks(text: Column, markers: Sequence[str], invalidate: bool = True) -> Column:
    """The markers that occur in the text; any makes the trial fail, with score 0 if it invalidates."""
    found = F.filter(F.array(*[F.lit(m) for m in markers]).cast("array<string>"), lambda m: F.contains(F.coalesce(text, F.lit("")), m))
    clean = F.size(found) == 0
    return _grade(F.when(clean, 1.0).otherwise(0.0 if invalidate else 0.5), clean, leaked=found)
