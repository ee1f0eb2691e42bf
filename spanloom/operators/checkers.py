"""Graders by a program of the user's own: one process for each trace, on the executor that holds it.

A program is run only where ``allow_programs`` was called; it gets the trace as JSON on its standard input and its
configuration as environment variables.  Exit code 0 passes; JSON on standard output may set score, tags and unscored.
A program that is missing, dies of a signal or takes too long leaves the grade unscored, with the reason.
"""

from __future__ import annotations

import json
import subprocess
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, functions as F

TIMEOUT, MOST_OUTPUT = 60.0, 1 << 20
_ALLOWED = [False]


def allow_programs(yes: bool = True) -> None:
    """Let scenarios run programs; they come from whoever wrote the scenario."""
    _ALLOWED[0] = yes


def check(command: list[str], payload: str, env: Mapping[str, str], timeout: float = TIMEOUT) -> dict:
    """The outcome of one run as (score, passed, tags, error)."""
    unscored = {"score": None, "passed": False, "tags": []}
    try:
        done = subprocess.run(command, input=payload.encode(), capture_output=True, timeout=timeout, env={"PATH": "/usr/local/bin:/usr/bin:/bin", **env}, check=False)
    except FileNotFoundError:
        return unscored | {"error": "the program is missing", "tags": ["checker_missing"]}
    except subprocess.TimeoutExpired:
        return unscored | {"error": f"the program took more than {timeout:g} s", "tags": ["checker_timeout"]}
    except OSError as e:
        return unscored | {"error": f"the program can't run: {e.strerror}", "tags": ["checker_unavailable"]}
    if done.returncode < 0:
        return unscored | {"error": f"the program died of signal {-done.returncode}", "tags": ["checker_crashed"]}
    try:
        told = json.loads(done.stdout[:MOST_OUTPUT].decode("utf-8", "replace"))
    except ValueError:
        told = {}
    told = told if isinstance(told, dict) else {}
    passed = done.returncode == 0
    if told.get("unscored"):
        return unscored | {"error": str(told.get("error") or "unscored"), "tags": [str(t) for t in told.get("tags") or []]}
    score = told.get("score")
    score = min(1.0, max(0.0, float(score))) if isinstance(score, int | float) and not isinstance(score, bool) else float(passed)
    return {"score": score, "passed": passed, "tags": [str(t) for t in told.get("tags") or []], "error": None if passed else done.stderr[:500].decode("utf-8", "replace") or None}


def external_checker(trace: Column, config: Mapping) -> Column:
    """Grade ``trace`` (JSON) by the program of config's ``command``."""
    command = config.get("command")
    if not _ALLOWED[0] or not command:
        raise ValueError("external_checker runs a program: it needs a command, and allow_programs() to be called first")
    command = [command] if isinstance(command, str) else list(command)
    env = {f"CONFIG_{k.upper()}": v if isinstance(v, str) else json.dumps(v) for k, v in config.items() if k not in ("command", "timeout")}
    timeout = float(config.get("timeout", TIMEOUT))

    @F.pandas_udf("score double, passed boolean, tags array<string>, error string")
    def run(traces: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([check(command, t or "", env, timeout) for t in traces], columns=["score", "passed", "tags", "error"])

    return run(trace)
