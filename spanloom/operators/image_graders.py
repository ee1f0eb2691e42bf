"""Graders of images, in Arrow batches over their bytes, and of scores that external models gave."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..functions.images import decode, gray, resized

GRADE = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("passed", T.BooleanType()), T.StructField("failed", T.StringType())])


def _graded(checks: dict[str, bool] | None, score: float | None = None) -> tuple:
    if checks is None:
        return None, False, "unreadable"
    bad = [k for k, ok in checks.items() if not ok]
    return (1.0 - len(bad) / len(checks) if score is None and checks else 1.0 if score is None else score), not bad, ",".join(bad)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["score", "passed", "failed"]).astype({"score": "float64"})


def image_assertions(image: Column, size: tuple[int, int] | None = None, min_size: tuple[int, int] | None = None, max_size: tuple[int, int] | None = None, fmt: str | None = None, not_blank: bool = False, aspect: float | None = None, aspect_tolerance: float = 0.05) -> Column:
    """Size (width, height), format, blankness and aspect ratio."""

    def one(data) -> tuple:
        got = decode(data)
        if got is None:
            return _graded(None)
        kind, p = got
        h, w = p.shape[:2]
        checks = {}
        if size:
            checks["size"] = (w, h) == tuple(size)
        if min_size:
            checks["min_size"] = w >= min_size[0] and h >= min_size[1]
        if max_size:
            checks["max_size"] = w <= max_size[0] and h <= max_size[1]
        if fmt:
            checks["format"] = kind == fmt.upper()
        if not_blank:
            checks["not_blank"] = bool(p.std() > 1.0)
        if aspect:
            checks["aspect"] = abs(w / h - aspect) <= aspect_tolerance
        return _graded(checks)

    @F.pandas_udf(GRADE)
    def run(images: pd.Series) -> pd.DataFrame:
        return _frame([one(x) for x in images])

    return run(image)


def measures(p: np.ndarray) -> dict[str, float]:
    """Sharpness (variance of the Laplacian), noise (median variance of 8 x 8 blocks), contrast and brightness."""
    g = gray(p)
    edge = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1] if min(g.shape) > 2 else np.zeros((1, 1))
    h, w = g.shape[0] // 8 * 8, g.shape[1] // 8 * 8
    blocks = g[:h, :w].reshape(h // 8, 8, w // 8, 8).var(axis=(1, 3)) if h and w else np.array([g.var()])
    return {"sharpness": float(edge.var()), "noise": float(np.median(blocks)), "contrast": float(g.std()), "brightness": float(g.mean())}


def technical_quality(image: Column, min_side: int = 256, min_sharpness: float = 100.0, max_noise: float = 500.0, min_contrast: float = 20.0, brightness: tuple[float, float] = (30.0, 225.0)) -> Column:
    """Resolution and four measures within their bounds."""

    def one(data) -> tuple:
        got = decode(data)
        if got is None:
            return _graded(None)
        m = measures(got[1])
        return _graded({
            "resolution": min(got[1].shape[:2]) >= min_side, "sharpness": m["sharpness"] >= min_sharpness, "noise": m["noise"] <= max_noise, "contrast": m["contrast"] >= min_contrast, "brightness": brightness[0] <= m["brightness"] <= brightness[1],
        })

    @F.pandas_udf(GRADE)
    def run(images: pd.Series) -> pd.DataFrame:
        return _frame([one(x) for x in images])

    return run(image)


def _pair(a, b):
    x, y = decode(a), decode(b)
    return None if x is None or y is None else (x[1], resized(y[1], *x[1].shape[:2]))


def edit_locality(original: Column, edited: Column, mask: Column | None = None, pixel_threshold: int = 30, min_score: float = 0.7) -> Column:
    """The share of changed pixels that lie inside the mask; without a mask 1 less the changed share over 0.3."""

    def one(a, b, m) -> tuple:
        both = _pair(a, b)
        if both is None:
            return _graded(None)
        changed = np.abs(both[0].astype(int) - both[1].astype(int)).max(axis=2) > pixel_threshold
        area = decode(m)
        if area is not None:
            inside = resized(gray(area[1]), *changed.shape) > 127
            score = float((changed & inside).sum() / changed.sum()) if changed.any() else 1.0
        else:
            score = max(0.0, 1.0 - float(changed.mean()) / 0.3)
        return _graded({"locality": score >= min_score}, score)

    @F.pandas_udf(GRADE)
    def run(a: pd.Series, b: pd.Series, m: pd.Series) -> pd.DataFrame:
        return _frame([one(*x) for x in zip(a, b, m)])

    return run(original, edited, mask if mask is not None else F.lit(None).cast("binary"))


def edit_preservation(original: Column, edited: Column, min_score: float = 0.85) -> Column:
    """0.7 of pixel likeness and 0.3 of histogram correlation."""

    def one(a, b) -> tuple:
        both = _pair(a, b)
        if both is None:
            return _graded(None)
        x, y = (p.astype(np.float64) for p in both)
        pixel = 1.0 - float(((x - y) ** 2).mean()) / 255**2
        ha, hb = (np.concatenate([np.histogram(p[:, :, c], 32, (0, 256))[0] for c in range(3)]).astype(float) for p in (x, y))
        ha, hb = ha - ha.mean(), hb - hb.mean()
        size = np.sqrt((ha**2).sum() * (hb**2).sum())
        score = 0.7 * pixel + 0.3 * (max(0.0, float((ha * hb).sum() / size)) if size else 1.0)
        return _graded({"preservation": score >= min_score}, score)

    @F.pandas_udf(GRADE)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return _frame([one(*x) for x in zip(a, b)])

    return run(original, edited)


# --- scores given by models and people -----------------------------------------------------------------------------


def _grade(score: Column, passed: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), F.coalesce(passed, F.lit(False)).alias("passed"))


def aesthetic_score(raw: Column, top: float = 10.0, least: float = 5.0) -> Column:
    """A model's raw score from 1 to ``top``; unscored where there is none."""
    return _grade((raw - 1) / (top - 1), raw >= least)


def safety_check(scores: Column, thresholds: dict[str, float], blocked: Column | None = None, expect_blocked: bool = False) -> Column:
    """A map of risk scores against thresholds; or, where a block is expected, whether it came."""
    if expect_blocked:
        ok = F.coalesce(blocked, F.lit(False)) if blocked is not None else F.lit(False)
        return _grade(ok.cast("double"), ok)
    over = [F.coalesce(F.try_element_at(scores, F.lit(k)) > t, F.lit(False)).cast("int") for k, t in thresholds.items()]
    n = sum(over[1:], over[0])
    return _grade(1.0 - n / F.lit(float(len(over))), n == 0)


def human_review(scores: Column, criteria: Sequence[str], low: float = 1.0, high: float = 5.0, threshold: float = 0.7) -> Column:
    """Mean of a reviewer's scores on a scale, brought to 0..1; a pending review is 0 and fails."""
    values = [F.try_element_at(scores, F.lit(c)) for c in criteria]
    mean = F.coalesce(sum((F.coalesce(x, F.lit(low)) for x in values[1:]), F.coalesce(values[0], F.lit(low))) / len(values), F.lit(low))
    score = F.when(scores.isNull(), 0.0).otherwise((mean - low) / (high - low))
    return _grade(score, score >= threshold)


def pairwise_comparison(preference: Column, confidence: Column, expected: str = "any") -> Column:
    """A preference (a, b, tie) with its confidence, against the one expected."""
    conf = F.coalesce(confidence, F.lit(1.0))
    if expected == "any":
        return _grade(conf, preference.isNotNull())
    match = preference == expected
    return _grade(F.when(preference == "tie", F.when(F.lit(expected == "tie"), conf).otherwise(0.5)).when(match, conf).otherwise(1.0 - conf), match)
