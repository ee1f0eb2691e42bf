"""Claims about a run held against its facts, and reviewers held against anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lookups import bounded

# The severities that each type of claim may have.
SEVERITIES = {
    "failure_pattern": ("low", "medium", "high"), "regression": ("medium", "high"), "improvement": ("info",),
    "process_defect": ("low", "medium", "high"), "harness_error": ("low", "medium", "high"), "coverage": ("info", "low"),
}
NEEDS_COMPARISON = ("regression", "improvement")
MAX_CLAIMS, MAX_TITLE, MAX_MESSAGE = 6, 120, 600


def _holds() -> Column:
    kind = F.col("claim_type")
    return (
        F.when(kind == "failure_pattern", ~F.col("passed") & ~F.col("errored"))
        .when(kind == "regression", F.col("flip") == "regressed")
        .when(kind == "improvement", F.col("flip") == "improved")
        .when(kind == "process_defect", F.col("process_failed") | (F.size("failure_tags") > 0))
        .when(kind == "harness_error", F.col("errored"))
        .otherwise(False)
    )


def ground(claims: DataFrame, facts: DataFrame, has_comparison: bool = False, max_claims: int = MAX_CLAIMS) -> DataFrame:
    """``claims(pos, claim_type, severity, title, message, case_ids)`` with kept and the reason where not.

    A claim is kept if its form is right and every case that it cites exists and supports it; the first of equal
    claims counts; the first ``max_claims`` are kept (that limit is the report's feature).
    """
    c = claims.withColumn("case_ids", F.array_distinct(F.filter(F.coalesce("case_ids", F.array()), lambda x: x.isNotNull() & (x != ""))))
    cited = c.select("pos", "claim_type", F.explode("case_ids").alias("case_id")).join(facts, "case_id", "left")
    known = F.col("passed").isNotNull()
    support = cited.groupBy("pos").agg(F.count_if(~known).alias("_unknown"), F.count_if(known & ~F.coalesce(_holds(), F.lit(False))).alias("_against"))
    allowed = F.create_map(*[x for k, s in SEVERITIES.items() for x in (F.lit(k), F.array(*map(F.lit, s)))])
    severities = F.try_element_at(allowed, F.col("claim_type"))
    cites = F.size("case_ids") > 0
    reason = (
        F.when(severities.isNull(), "unknown claim type")
        .when((F.coalesce(F.trim("title"), F.lit("")) == "") | (F.coalesce(F.trim("message"), F.lit("")) == ""), "no title or message")
        .when((F.length("title") > MAX_TITLE) | (F.length("message") > MAX_MESSAGE), "too long")
        .when(~F.coalesce(F.array_contains(severities, F.col("severity")), F.lit(False)), "severity not allowed")
        .when(F.col("claim_type").isin(*NEEDS_COMPARISON) & F.lit(not has_comparison), "needs a comparison")
        .when((F.col("claim_type") == "coverage") & cites, "a coverage claim cites cases")
        .when((F.col("claim_type") != "coverage") & ~cites, "cites no case")
        .when(F.coalesce("_unknown", F.lit(0)) > 0, "cites unknown cases")
        .when((F.col("claim_type") != "coverage") & (F.coalesce("_against", F.lit(0)) > 0), "not supported")
    )
    d = c.join(support, "pos", "left").withColumn("reason", reason)
    good = F.col("reason").isNull()
    key = F.concat_ws("|", F.col("claim_type"), F.array_join(F.array_sort("case_ids"), ","))
    first = F.row_number().over(Window.partitionBy(key, good).orderBy("pos"))
    d = d.withColumn("reason", F.when(good & (first > 1), "duplicate").otherwise(F.col("reason")))
    place = F.row_number().over(Window.partitionBy(F.col("reason").isNull()).orderBy("pos"))
    d = d.withColumn("reason", F.when(F.col("reason").isNull() & (place > max_claims), "over the limit").otherwise(F.col("reason")))
    return d.select("pos", "claim_type", "title", "case_ids", F.col("reason").isNull().alias("kept"), "reason")


def calibration(anchors: DataFrame, responses: DataFrame, max_drift: float = 0.15, min_anchors: int = 3) -> DataFrame:
    """Reviewers' mean absolute drift from ``anchors(anchor, criterion, expected)`` in ``responses(reviewer, anchor, criterion, score)``."""
    d = responses.join(anchors, ["anchor", "criterion"]).withColumn("drift", F.abs(F.col("score") - F.col("expected")))
    out = d.groupBy("reviewer").agg(F.countDistinct("anchor").alias("anchors"), F.avg("drift").alias("mean_drift"), F.max("drift").alias("worst_drift"))
    return out.withColumn("passed", (F.col("mean_drift") <= max_drift) & (F.col("anchors") >= min_anchors))


#: Cases that a prompt shows at most: the report's feature.
PROMPT_CASES = 80


def ranked_facts(facts: DataFrame, most: int = PROMPT_CASES) -> DataFrame:
    """The cases that a judge is shown: flips first, then errors, failures, tagged ones, the rest; by id within each."""
    rank = F.when(F.col("flip").isNotNull(), 0).when(F.col("errored"), 1).when(~F.col("passed"), 2).when(F.size("failure_tags") > 0, 3).otherwise(4)
    return facts.withColumn("rank", rank).orderBy("rank", "case_id").limit(most)


def claim_types(has_comparison: bool) -> list[str]:
    return [k for k in SEVERITIES if has_comparison or k not in NEEDS_COMPARISON]


def insights_schema(has_comparison: bool = False) -> dict:
    """The JSON schema of a judge's claims; types that need a comparison only where there is one."""
    text = lambda n: {"type": "string", "minLength": 1, "maxLength": n}
    claim = {"type": {"enum": claim_types(has_comparison)}, "severity": {"enum": ["info", "low", "medium", "high"]}, "title": text(MAX_TITLE), "message": text(MAX_MESSAGE), "case_ids": {"type": "array", "items": {"type": "string"}}}
    item = {"type": "object", "required": list(claim), "properties": claim, "additionalProperties": False}
    return {"type": "object", "required": ["claims"], "properties": {"claims": {"type": "array", "items": item, "maxItems": MAX_CLAIMS}}}


def insights_prompt(facts: DataFrame, has_comparison: bool = False, most: int = PROMPT_CASES) -> str:
    """The question to a judge: what may be claimed, and one line for each case shown."""
    shown = ranked_facts(facts, most).select("case_id", "passed", "errored", "flip", F.array_join("failure_tags", ",").alias("tags")).collect()  # at most ``most`` rows
    total = facts.count()
    lines = [f"{r['case_id']}: {'error' if r['errored'] else 'passed' if r['passed'] else 'failed'}" + (f", {r['flip']}" if r["flip"] else "") + (f" [{r['tags']}]" if r["tags"] else "") for r in shown]
    rules = "\n".join(f"- {k}: severity {' or '.join(SEVERITIES[k])}" for k in claim_types(has_comparison))
    more = f"\n({total - len(shown)} more cases not shown)" if total > len(shown) else ""
    return f"Make at most {MAX_CLAIMS} claims about this run, each supported by every case it cites.\n\nCLAIM TYPES\n{rules}\n\nCASES\n" + "\n".join(lines) + more


def insights(facts: DataFrame, ask, has_comparison: bool = False) -> DataFrame:
    """A judge's claims about the facts, held against them: ``ask(prompt, schema)`` returns {"claims": [...]}."""
    answer = ask(insights_prompt(facts, has_comparison), insights_schema(has_comparison)) or {}
    rows = [(i, c.get("type"), c.get("severity"), c.get("title"), c.get("message"), [str(x) for x in c.get("case_ids") or []]) for i, c in enumerate(answer.get("claims") or [])]
    ddl = "pos int, claim_type string, severity string, title string, message string, case_ids array<string>"
    return ground(facts.sparkSession.createDataFrame(rows, ddl), facts, has_comparison)


def grounded_rate(grounded: DataFrame) -> DataFrame:
    """(kept, dropped, rate) of grounded claims; without claims the rate is null."""
    kept, n = F.count_if("kept"), F.count(F.lit(1))
    return grounded.agg(kept.alias("kept"), (n - kept).alias("dropped"), F.try_divide(kept, n).alias("rate"))


def known_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(pos, case_id) for each id of ``ids(case_id)`` that ``texts(pos, text)`` names: the longest at each place, as a whole word."""
    word = F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_][A-Za-z0-9_./:-]*[A-Za-z0-9_]|[A-Za-z0-9_])"), F.lit(1)))
    return texts.select("pos", word.alias("case_id")).distinct().join(ids.select("case_id").distinct(), "case_id", "left_semi").select("pos", "case_id")


# --- reviewers -------------------------------------------------------------------------------------------------------


def next_anchors(anchors: DataFrame, responses: DataFrame, reviewers: DataFrame) -> DataFrame:
    """(reviewer, anchor): the first anchor, by name, that each of ``reviewers(reviewer)`` has not scored yet."""
    names = anchors.select("anchor").distinct()
    todo = reviewers.select("reviewer").distinct().join(bounded(names)).join(responses.select("reviewer", "anchor").distinct(), ["reviewer", "anchor"], "left_anti")
    return todo.groupBy("reviewer").agg(F.min("anchor").alias("anchor"))


def submit(responses: DataFrame, new: DataFrame) -> DataFrame:
    """Responses with new ones ``(reviewer, anchor, criterion, score, at)``: of repeated scores the latest counts."""
    return responses.unionByName(new).groupBy("reviewer", "anchor", "criterion").agg(F.max_by("score", "at").alias("score"), F.max("at").alias("at"))


def needs_recalibration(calibrated: DataFrame, reviews: DataFrame, every: int = 50) -> DataFrame:
    """(reviewer, due): whoever never passed, or has made ``every`` reviews since ``calibrated(reviewer, passed, at)``."""
    last = calibrated.groupBy("reviewer").agg(F.max_by("passed", "at").alias("passed"), F.max("at").alias("since"))
    d = reviews.join(last, "reviewer", "left").groupBy("reviewer").agg(F.coalesce(F.first("passed"), F.lit(False)).alias("passed"), F.count_if(F.col("since").isNull() | (F.col("at") > F.col("since"))).alias("n"))
    return d.select("reviewer", (~F.col("passed") | (F.col("n") >= every)).alias("due"))
