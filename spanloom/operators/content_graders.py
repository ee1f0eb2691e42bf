"""Graders of what an agent answered: text, structure, SQL and data, as columns of (score, passed, ...)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import json_schema as schema_rules
from ..functions.scalars import lines, plain_sql, same_value, words
from .text_formats import schema_udf, structure  # noqa: F401  structure is one of the graders here


def _grade(score: Column, passed: Column, **more: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), passed.alias("passed"), *[c.alias(n) for n, c in more.items()])


def _share(checks: Mapping[str, Column]) -> Column:
    """Share of named checks that hold; passes where all do; names of those that don't."""
    if not checks:
        return _grade(F.lit(1.0), F.lit(True), violations=F.lit(0))
    bad = sum(((~F.coalesce(c, F.lit(False))).cast("int") for c in checks.values()), F.lit(0))
    return _grade(1.0 - bad / F.lit(float(len(checks))), bad == 0, violations=bad)


def exact_match(text: Column, expected: Column, fold: bool = False, as_json: bool = False) -> Column:
    """Equal after trimming (and case folding); as JSON: equal values whatever the key order and spacing."""
    if as_json:
        same = F.coalesce(F.to_json(F.try_parse_json(text)) == F.to_json(F.try_parse_json(expected)), F.lit(False))
    else:
        clean = lambda c: F.lower(F.trim(c)) if fold else F.trim(c)
        same = F.coalesce(clean(text) == clean(expected), F.lit(False))
    return _grade(same.cast("double"), same)


def expected_block(text: Column, contains: Sequence[str] = (), not_contains: Sequence[str] = (), matches: Sequence[str] = (), not_matches: Sequence[str] = (), min_words: int | None = None, max_words: int | None = None, min_length: int | None = None, max_length: int | None = None) -> Column:
    """The checks of a case's ``expected`` block."""
    t = F.coalesce(text, F.lit(""))
    checks = {f"contains:{x}": F.contains(t, F.lit(x)) for x in contains} | {f"not_contains:{x}": ~F.contains(t, F.lit(x)) for x in not_contains}
    checks |= {f"matches:{x}": t.rlike(x) for x in matches} | {f"not_matches:{x}": ~t.rlike(x) for x in not_matches}
    for name, limit, size in (("words", min_words, words(t)), ("length", min_length, F.length(t))):
        if limit is not None:
            checks[f"min_{name}"] = size >= limit
    for name, limit, size in (("words", max_words, words(t)), ("length", max_length, F.length(t))):
        if limit is not None:
            checks[f"max_{name}"] = size <= limit
    return _share(checks)


# Naming conventions, and where the names of each kind stand in code.
CONVENTIONS = {"snake_case": "^[a-z][a-z0-9]*(_[a-z0-9]+)*$", "camelCase": "^[a-z][a-zA-Z0-9]*$", "PascalCase": "^[A-Z][a-zA-Z0-9]*$", "UPPER_SNAKE_CASE": "^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"}
_NAMED = {
    "functions": (r"(?:\bdef|\bfunction)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(", "^_"), "variables": (r"(?m)^([a-zA-Z_][a-zA-Z0-9_]*)\s*=", "^_|^[^a-z]*[A-Z][^a-z]*$"),
    "classes": (r"\bclass\s+([a-zA-Z_][a-zA-Z0-9_]*)", None), "constants": (r"(?m)^([A-Z][A-Z0-9_]*)\s*=", None),
}


def misnamed(text: Column, kind: str, convention: str) -> Column:
    """The names of a kind in code that break a convention; private ones may, and constants are no variables."""
    pattern, spared = _NAMED[kind]
    names = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.filter(names, lambda n: ~n.rlike(CONVENTIONS[convention]) & (~n.rlike(spared) if spared else F.lit(True)))


def markdown_habits(text: Column, require_code_blocks: bool = False, max_heading_level: int = 0, require_lists: bool = False, no_bare_urls: bool = False, consistent_headings: bool = True) -> list[Column]:
    """Checks of Markdown: code blocks, depth of headings, lists, links in link form, one style of headings."""
    out = [text.rlike(r"(?s)```.*?```")] if require_code_blocks else []
    out += [~text.rlike(r"(?m)^#{%d,6}\s" % (max_heading_level + 1))] if 0 < max_heading_level < 6 else []
    out += [text.rlike(r"(?m)^\s*(?:[-*+]|\d+\.)\s")] if require_lists else []
    out += [~text.rlike(r"(?<!\]\()(?<!<)https?://[^\s)>\]]+(?![>\]])")] if no_bare_urls else []
    return out + ([~(text.rlike(r"(?m)^#{1,6}\s") & text.rlike(r"(?m)^[^\n]+\n[=-]{3,}[ \t]*$"))] if consistent_headings else [])


def style(text: Column, max_words: int | None = None, min_words: int | None = None, max_lines: int | None = None, required_phrases: Sequence[str] = (), forbidden_phrases: Sequence[str] = (), required_sections: Sequence[str] = (), markdown: bool = False,
          min_lines: int | None = None, min_length: int | None = None, max_length: int | None = None, section_order: bool = False, case_sensitive: bool = False, required_patterns: Sequence[str] = (), forbidden_patterns: Sequence[str] = (),
          markdown_checks: Mapping | None = None, naming_conventions: Mapping[str, str] | None = None) -> Column:
    """Eight check groups of style; the share of groups without a violation."""
    t = F.coalesce(text, F.lit(""))
    fold = (lambda c: c) if case_sensitive else F.lower
    phrase = lambda p: F.contains(fold(t), F.lit(p if case_sensitive else p.lower()))
    found = lambda p: t.rlike(f"(?m){p}")
    titles = F.transform(sections(t), lambda x: F.lower(x))
    places = [F.array_position(titles, F.lit(p.lower())) for p in required_sections]
    ordered = [a < b for a, b in zip(places, places[1:])] if section_order else []
    length = [size >= n for size, n in ((words(t), min_words), (lines(t), min_lines), (F.length(t), min_length)) if n]
    length += [size <= n for size, n in ((words(t), max_words), (lines(t), max_lines), (F.length(t), max_length)) if n]
    habits = [~skips_heading_level(t), F.regexp_count(t, F.lit("```")) % 2 == 0] if markdown else []
    groups: dict[str, Column] = {}
    for name, checks in (
        ("length", length),
        ("required_phrases", [phrase(p) for p in required_phrases]),
        ("forbidden_phrases", [~phrase(p) for p in forbidden_phrases]),
        ("required_patterns", [found(p) for p in required_patterns]),
        ("forbidden_patterns", [~found(p) for p in forbidden_patterns]),
        ("sections", [p > 0 for p in places] + ordered),
        ("markdown", habits + (markdown_habits(t, **markdown_checks) if markdown_checks else [])),
        ("naming", [F.size(misnamed(t, kind, how)) == 0 for kind, how in (naming_conventions or {}).items()]),
    ):
        if checks:
            ok = checks[0]
            for c in checks[1:]:
                ok = ok & c
            groups[name] = ok
    return _share(groups)


def sections(text: Column) -> Column:
    """The titles of Markdown headings."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), F.lit(1)), lambda s: F.trim(s))


def skips_heading_level(text: Column) -> Column:
    """Whether a heading is more than one level below the one before it."""
    levels = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6})[ \t]+\S"), F.lit(1)), lambda h: F.length(h))
    jump = F.aggregate(levels, F.struct(F.lit(9).alias("last"), F.lit(False).alias("bad")), lambda a, x: F.struct(x.alias("last"), (a["bad"] | (x > a["last"] + 1)).alias("bad")))
    return jump["bad"]


# --- JSON ----------------------------------------------------------------------------------------------------------

_JSON_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT"}


def json_schema(text: Column, schema: Mapping, strict: bool = True, threshold: float = 0.7, allow_additional: bool = True) -> Column:
    """JSON Schema, Draft 7.  Strict: all or nothing.  Else the weighted share of fields that hold, required ones twice.

    Schemas of type, required, properties, enum, const, bounds, lengths and pattern are columns; others (items, $ref,
    combinations, formats, ...) run in Arrow batches.
    """
    if not (schema_rules.is_plain(schema) and allow_additional):
        share = schema_udf(schema, allow_additional)(text)
        return F.transform(F.array(share), lambda x: _grade((x == 1.0).cast("double"), x == 1.0) if strict else _grade(x, x >= threshold))[0]
    checks: list[tuple[float, Column]] = []

    # the text is parsed once: what follows is the body of a function of its variant
    def body(doc: Column) -> Column:
        checks.clear()
        walk(doc, "$", schema, True)
        total = sum(w for w, _ in checks) or 1.0
        share = sum((F.when(c, w).otherwise(0.0) for w, c in checks), F.lit(0.0)) / total
        return F.when(doc.isNotNull(), share if checks else F.lit(1.0)).otherwise(0.0)

    def walk(doc: Column, path: str, s: Mapping, must: bool) -> None:
        value = F.try_variant_get(doc, path, "string")
        kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
        number, ok, wanted = value.try_cast("double"), F.lit(True), s.get("type")
        if wanted in ("number", "integer"):
            ok = ok & kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
            ok = ok & (number == F.floor(number)) if wanted == "integer" else ok
        elif wanted:
            ok = ok & kind.startswith(_JSON_TYPES[wanted])
        if "enum" in s:
            ok = ok & value.isin(*[x if isinstance(x, str) else json.dumps(x) for x in s["enum"]])
        if "const" in s:
            ok = ok & (value == (s["const"] if isinstance(s["const"], str) else json.dumps(s["const"])))
        for key, test in (("minimum", lambda m: number >= m), ("maximum", lambda m: number <= m), ("exclusiveMinimum", lambda m: number > m), ("exclusiveMaximum", lambda m: number < m),
                          ("minLength", lambda m: F.length(value) >= m), ("maxLength", lambda m: F.length(value) <= m), ("pattern", lambda p: value.rlike(p))):
            if key in s:
                ok = ok & test(s[key])
        ok = F.coalesce(ok, F.lit(False))
        if path != "$":
            checks.append((2.0 if must else 1.0, ok if must else F.when(value.isNull(), True).otherwise(ok)))
        elif wanted:
            checks.append((1.0, ok))
        for name, sub in s.get("properties", {}).items():
            walk(doc, f"{path}.{name}", sub, name in s.get("required", ()))
        for name in s.get("required", ()):
            if name not in s.get("properties", {}):
                checks.append((2.0, F.try_variant_get(doc, f"{path}.{name}", "variant").isNotNull()))

    share = F.transform(F.array(F.try_parse_json(text)), body)[0]
    return F.transform(F.array(share), lambda x: _grade((x == 1.0).cast("double"), x == 1.0) if strict else _grade(x, x >= threshold))[0]


# --- SQL -----------------------------------------------------------------------------------------------------------

# The weight of each finding.
QUERY_WEIGHTS = {"select_star": 0.3, "cartesian_join": 1.0, "missing_where": 0.5, "aggregation_without_group": 1.0, "suboptimal_join": 0.7}


def query_quality(sql: Column, weights: Mapping[str, float] = QUERY_WEIGHTS, threshold: float = 0.7) -> Column:
    """Five findings by pattern; the score is 1 less their weights; one of weight 1 or more fails."""
    s = F.upper(plain_sql(sql))
    where = F.contains(s, F.lit("WHERE"))
    found = {
        "select_star": s.rlike(r"SELECT\s+\*"),
        "cartesian_join": s.rlike(r"JOIN\s+\w+\s*(,|JOIN)") | (F.contains(s, F.lit(",")) & ~F.contains(s, F.lit("JOIN")) & ~where),
        "missing_where": s.rlike(r"(UPDATE|DELETE)\s+") & ~where,
        "aggregation_without_group": s.rlike(r"SELECT\s+\w+\s*,.*\b(COUNT|SUM|AVG|MIN|MAX)\s*\(") & ~F.contains(s, F.lit("GROUP BY")),
        "suboptimal_join": s.rlike(r"\bIN\s*\(\s*SELECT"),
    }
    loss = sum((F.when(c, weights[n]).otherwise(0.0) for n, c in found.items()), F.lit(0.0))
    severe = F.lit(False)
    for n, c in found.items():
        severe = severe | (c if weights[n] >= 1.0 else F.lit(False))
    score = F.greatest(F.lit(0.0), 1.0 - loss)
    return _grade(score, (score >= threshold) & ~severe, issues=sum((c.cast("int") for c in found.values()), F.lit(0)))


def sql_syntax(sql: Column, allowed: Sequence[str] = ("SELECT", "WITH"), forbidden: Sequence[str] = ("DROP", "TRUNCATE", "ALTER")) -> Column:
    """Statement type, forbidden keywords and a missing final semicolon (score 0.8) by pattern."""
    s = F.upper(plain_sql(sql))
    kind = s.rlike(r"^\s*(" + "|".join(allowed) + r")\b")
    bad = s.rlike(r"\b(" + "|".join(forbidden) + r")\b") if forbidden else F.lit(False)
    balanced = F.regexp_count(s, F.lit(r"\(")) == F.regexp_count(s, F.lit(r"\)"))
    ok = kind & ~bad & balanced
    return _grade(F.when(~ok, 0.0).when(s.endswith(";"), 1.0).otherwise(0.8), ok)


def reasoning_trace(text: Column, indicators: Sequence[str], threshold: float = 0.5) -> Column:
    """The share of indicators that a text mentions, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((F.contains(low, F.lit(i.lower())).cast("int") for i in indicators), F.lit(0))
    score = hits / F.lit(float(max(1, len(indicators))))
    return _grade(score, score >= threshold, hits=hits)


# --- rows ----------------------------------------------------------------------------------------------------------


def compare_keyed(actual: DataFrame, expected: DataFrame, keys: Sequence[str], tolerance: float = 1e-6, order: str | None = None) -> DataFrame:
    """Differences of two tables by key: (keys..., column, kind, actual, expected), kind missing, extra or mismatch.

    Null keys match each other.  Of the rows of a repeated key one counts on each side: the last by ``order``, a column
    of both tables, or where none is given the greatest by its values.
    """
    columns = [c for c in expected.columns if c not in (*keys, order)]
    kept = [c for c in columns if c in actual.columns]

    def side(d: DataFrame, cols: Sequence[str], mark: str) -> DataFrame:
        texts = [F.col(c).cast("string").alias(f"{mark}_{c}") for c in cols]
        last = F.struct(*([F.col(order)] if order else []), *[F.col(c).cast("string") for c in cols], F.lit(0))
        d = d.groupBy(*[F.col(k).alias(f"{mark}_key{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(*texts, F.lit(True).alias(f"_{mark}")), last).alias("x"))
        return d.select(*[f"{mark}_key{i}" for i in range(len(keys))], "x.*")

    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"a_key{i}").eqNullSafe(F.col(f"e_key{i}"))
    d = side(actual, kept, "a").join(side(expected, columns, "e"), on, "full_outer")
    key = [F.when(F.col("_e").isNull(), F.col(f"a_key{i}")).otherwise(F.col(f"e_key{i}")).alias(k) for i, k in enumerate(keys)]
    gone = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra")
    whole = F.array(F.struct(F.lit("*").alias("column"), gone.alias("kind"), F.lit(None).cast("string").alias("actual"), F.lit(None).cast("string").alias("expected")))
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.when(~same_value(F.col(f"a_{c}"), F.col(f"e_{c}"), tolerance), "mismatch").alias("kind"), F.col(f"a_{c}").alias("actual"), F.col(f"e_{c}").alias("expected"))
        for c in kept
    ]) if kept else F.filter(whole, lambda _: F.lit(False))
    out = d.select(*key, F.explode(F.when(gone.isNotNull(), whole).otherwise(F.filter(cells, lambda c: c["kind"].isNotNull()))).alias("x"))
    return out.select(*keys, "x.*")


#: About so many keys are sampled to cut a table into ranges, whatever its size.
RANGE_SAMPLE = 2_000


def with_row_number(d: DataFrame, by: Sequence[Column], n_ranges: int | None = None) -> DataFrame:
    """``d`` with row_number from 1 in the order of ``by``, ties by all columns as texts, without a global sort.

    Equal rows are one row with a count until the end.  The others are cut into ranges by bounds from a sample drawn
    by hash, so every evaluation cuts alike; a range is ranked on its own and shifted by the sizes of earlier ones.
    """
    columns = d.columns
    text = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]
    rows = d.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_key", F.concat(F.array(*by), F.array(*text)))
    n_ranges = n_ranges or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, rows.count() // RANGE_SAMPLE)
    drawn = sorted(r[0] for r in rows.where(F.pmod(F.xxhash64(F.lit("range"), "_key"), F.lit(every)) == 0).select("_key").collect())
    bounds = drawn[:: max(1, len(drawn) // n_ranges)][1:]
    at = F.lit(0)
    if bounds:
        cuts = d.sparkSession.createDataFrame([(bounds,)], "_cuts array<array<string>>")
        rows = rows.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col("_key")))).drop("_cuts")
    else:
        rows = rows.withColumn("_range", at)
    sizes = rows.groupBy("_range").agg(F.sum("_n").alias("_size"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    before = Window.partitionBy("_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_shift") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    placed = rows.join(F.broadcast(sizes), "_range").withColumn("_first", first)
    return placed.select(*columns, F.explode(F.sequence(F.col("_first") + 1, F.col("_first") + F.col("_n"))).alias("row_number"))


def compare_ranked(actual: DataFrame, expected: DataFrame, by: Sequence[str] | None = None, tolerance: float = 1e-6, n_ranges: int | None = None) -> DataFrame:
    """Differences of two tables without a key: rows are paired by rank.

    The order is that of ``by`` as texts; without it, that of each row's values as texts, sorted within the row.
    """

    def ranked(d: DataFrame) -> DataFrame:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
        order = [text(c) for c in by] if by else [F.array_join(F.array_sort(F.array(*[text(c) for c in d.columns])), "\u0000")]
        return with_row_number(d, order, n_ranges)

    return compare_keyed(ranked(actual), ranked(expected), ["row_number"], tolerance)


def compare_positions(actual: DataFrame, expected: DataFrame, position: str, tolerance: float = 1e-6) -> DataFrame:
    """Differences of two tables in their own order: the n-th rows by the column ``position`` are paired."""

    def placed(d: DataFrame) -> DataFrame:
        width = F.lpad(F.col(position).cast("decimal(38,0)").cast("string"), 39, "0")
        return with_row_number(d, [width]).drop(position)

    return compare_keyed(placed(actual), placed(expected), ["row_number"], tolerance)


def bag_difference(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(side, rows) with how many rows each table has beyond the other, repeats counted."""
    a = actual.exceptAll(expected).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("actual").alias("side"), "rows")
    return a.unionByName(expected.exceptAll(actual).agg(F.count(F.lit(1)).alias("rows")).select(F.lit("expected").alias("side"), "rows"))


def semantic_match(a: Column, b: Column, threshold: float = 0.25) -> Column:
    """Cosine of two vectors against a threshold."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    score = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return _grade(score, F.coalesce(score >= threshold, F.lit(False)))
