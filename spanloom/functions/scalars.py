"""Column functions: tool names, tags, values, texts and formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def tool_parts(name: Column) -> Column:
    """adapter[.resource].action as a struct; a name of one part is the action of adapter 'custom'."""
    p = F.split(name, r"\.")
    n = F.size(p)
    resource = F.when(n > 2, F.array_join(F.slice(p, 2, F.greatest(n - 2, F.lit(1))), "."))
    return F.struct(F.when(n == 1, "custom").otherwise(F.get(p, F.lit(0))).alias("adapter"), resource.alias("resource"), F.element_at(p, -1).alias("action"))


def tool_name(adapter: Column, action: Column, resource: Column | None = None) -> Column:
    return F.concat_ws(".", adapter, *([resource] if resource is not None else []), action)


def last_segment(name: Column) -> Column:
    """The last part of a tool name whose parts are set off by dots, colons or double underscores, in lower case."""
    return F.lower(F.trim(F.element_at(F.split(F.regexp_replace(name, "__|:", "."), r"\."), -1)))


def tool_warnings(name: Column) -> Column:
    """What is unusual about a tool name, as an array."""
    checks = [
        (F.coalesce(F.trim(name), F.lit("")) == "", "empty"), (name.rlike(r"\s"), "white space"), (name != F.lower(name), "upper case"),
        (~name.contains("."), "no adapter"), (name.rlike(r"^\.|\.$|\.\."), "empty part"), (F.size(F.split(name, r"\.")) > 4, "too many parts"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(says)) for c, says in checks]), lambda x: x.isNotNull())


def tag(x: Column) -> Column:
    """A tag in lower case with everything but letters and digits as single underscores inside."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def slug(x: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("run"))


def safe_filename(x: Column) -> Column:
    return F.regexp_replace(x, r'[/\\:*?"<>|\s]', "_")


def plain_sql(sql: Column) -> Column:
    """SQL without comments and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(sql, r"--[^\n]*", " "), r"(?s)/\*.*?\*/", " "), r"\s+", " "))


def sql_in_text(text: Column) -> Column:
    """The first fenced SQL block, else the text where it begins like a statement, else null."""
    fenced = F.nullif(F.trim(F.regexp_extract(text, r"(?is)```(?:sql)?\s*\n(.*?)```", 1)), F.lit(""))
    return F.coalesce(fenced, F.when(text.rlike(r"(?i)^\s*(select|with|insert|update|delete|create|alter|drop)\b"), F.trim(text)))


def json_in_text(text: Column) -> Column:
    """The first fenced JSON block, else the widest braces or brackets, else the text."""
    fenced = F.nullif(F.trim(F.regexp_extract(text, r"(?s)```(?:json)?\s*\n(.*?)```", 1)), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1), F.lit("")), text)


def same_value(actual: Column, expected: Column, tolerance: float = 1e-6) -> Column:
    """Equal values: null with null, numbers within a relative tolerance (absolute at 0), else trimmed texts."""
    a, e = actual.try_cast("double"), expected.try_cast("double")
    close = F.when(e == 0, F.abs(a) <= tolerance).otherwise(F.abs(a - e) <= F.abs(e) * tolerance)
    text = F.trim(actual.cast("string")) == F.trim(expected.cast("string"))
    return F.when(actual.isNull() | expected.isNull(), actual.isNull() & expected.isNull()).when(a.isNotNull() & e.isNotNull(), close).otherwise(text)


def words(text: Column) -> Column:
    """How many words a text has; Unicode white space sets them off."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def lines(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.size(F.split(text, "\n"))).otherwise(0)


def is_empty_result(x: Column) -> Column:
    """Null, blank, and the texts of empty JSON values."""
    return x.isNull() | F.lower(F.trim(x)).isin("", "[]", "{}", "null", "none")


def to_seconds(x: Column) -> Column:
    """Epoch seconds from a number whose unit its size tells: nano-, micro- or milliseconds, else seconds."""
    return F.when(x > 1e17, x / 1e9).when(x > 1e14, x / 1e6).when(x > 1e11, x / 1e3).otherwise(x).cast("double")


def compact(x: Column, limit: int = 200) -> Column:
    """White space as single spaces, cut to ``limit`` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))).otherwise(flat)


def diff_counts(diff: Column) -> Column:
    """(added, removed) lines of a unified diff."""
    rows = F.split(diff, "\n")
    count = lambda sign, head: F.size(F.filter(rows, lambda r: r.startswith(sign) & ~r.startswith(head)))
    return F.struct(count("+", "+++").alias("added"), count("-", "---").alias("removed"))


def test_counts(stdout: Column) -> Column:
    """(passed, total) from the output of pytest, rspec, go test or a plain 'n passed, m failed' line; null if none."""
    n = lambda pattern: F.regexp_extract(stdout, pattern, 1).try_cast("int")
    passed, failed, errors = n(r"(\d+) passed"), n(r"(\d+) failed"), n(r"(\d+) errors?\b")
    examples, failures = n(r"(\d+) examples?,"), n(r"examples?, (\d+) failures?")
    go_pass, go_fail = F.regexp_count(stdout, F.lit(r"(?m)^\s*--- PASS")), F.regexp_count(stdout, F.lit(r"(?m)^\s*--- FAIL"))
    pair = lambda a, b: F.struct(a.alias("passed"), b.alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (
        F.when(examples.isNotNull(), pair(examples - zero(failures), examples))
        .when(passed.isNotNull() | failed.isNotNull(), pair(zero(passed), zero(passed) + zero(failed) + zero(errors)))
        .when(go_pass + go_fail > 0, pair(go_pass, go_pass + go_fail))
    )


def usage_tokens(response: Column) -> Column:
    """(input, output, cached) tokens of a provider's response, whichever of the usual names it uses."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(response, p).try_cast("long") for p in paths])
    return F.struct(
        get("$.usage.prompt_tokens", "$.usage.input_tokens", "$.usageMetadata.promptTokenCount", "$.usage_metadata.prompt_token_count").alias("input_tokens"),
        get("$.usage.completion_tokens", "$.usage.output_tokens", "$.usageMetadata.candidatesTokenCount", "$.usage_metadata.candidates_token_count").alias("output_tokens"),
        F.coalesce(get("$.usage.prompt_tokens_details.cached_tokens", "$.usage.cache_read_input_tokens", "$.usageMetadata.cachedContentTokenCount"), F.lit(0).cast("long")).alias("cached_tokens"),
    )


def cost(input_tokens: Column, output_tokens: Column, cached_tokens: Column, price: Mapping[str, Column]) -> Column:
    """US dollars at prices per million tokens; null where the price is unknown."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return zero(input_tokens) / 1e6 * price["input"] + zero(output_tokens) / 1e6 * price["output"] + zero(cached_tokens) / 1e6 * F.coalesce(price["cached"], F.lit(0.0))


# --- sweeps --------------------------------------------------------------------------------------------------------


def sweep_id(base: Column, names: Sequence[str], values: Sequence[Column]) -> Column:
    """base__sweep__k=v__k=v with the names in order."""
    pairs = sorted(zip(names, values), key=lambda p: p[0])
    return F.concat_ws("__", base, F.lit("sweep"), *[F.concat(F.lit(f"{n}="), x.cast("string")) for n, x in pairs])


def sweep_base(case_id: Column) -> Column:
    return F.substring_index(case_id, "__sweep__", 1)


def sweep_params(case_id: Column) -> Column:
    """The parameters of a sweep id as a map of texts; empty for another id."""
    tail = F.when(F.instr(case_id, "__sweep__") > 0, F.substring_index(case_id, "__sweep__", -1))
    return F.coalesce(F.when(tail.isNotNull(), F.str_to_map(tail, F.lit("__"), F.lit("="))), F.create_map().cast("map<string,string>"))


def input_strings(json_text: Column, depth: int = 4) -> Column:
    """All texts in a JSON value down to ``depth`` levels, in the order of their paths' walk by level."""
    none = F.array().cast("array<string>")
    values, out = F.array(F.try_parse_json(json_text)), none
    empty = F.array().cast("array<variant>")
    for level in range(depth + 1):
        out = F.concat(out, F.filter(F.transform(values, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda s: s.isNotNull()))
        if level < depth:
            values = F.flatten(F.transform(values, lambda v: F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"), empty)))
    return F.coalesce(out, none)


# What a tool's name says of its type.
TOOL_TYPES = {"shell": ("bash", "shell", "terminal", "exec", "run_command", "execute_bash"), "file": ("read", "write", "edit", "multiedit", "str_replace", "create", "notebookedit"), "search": ("grep", "glob", "search", "web_search", "websearch"), "web": ("webfetch", "fetch", "browser")}


def tool_type(name: Column) -> Column:
    """The type of a tool by its name: shell, file, search, web, mcp (a server's), llm, else tool."""
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.when(low.startswith("llm."), "llm").when(low.startswith("mcp__") | low.startswith("mcp."), "mcp")
    for kind, names in TOOL_TYPES.items():
        out = out.when(low.isin(*names), kind)
    return out.otherwise("tool")


def front_matter(text: Column, key: str) -> Column:
    """A key's value in the front matter of a Markdown text, without quotes; null where there is none."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\A\uFEFF?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    return F.nullif(F.trim(F.regexp_extract(head, rf"""(?m)^{key}[ \t]*:[ \t]*["']?(.*?)["']?[ \t]*$""", 1)), F.lit(""))


def skill_name(text: Column, folder: Column) -> Column:
    """The name that a skill's file gives itself, else its folder's."""
    return F.coalesce(front_matter(text, "name"), F.regexp_extract(F.regexp_replace(folder, "/+$", ""), "([^/]+)$", 1))


def leak_marker(prefix: str, seed: Column) -> Column:
    """A marker of a prefix and twelve hex digits that the seed decides; a uuid as seed makes it unguessable."""
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(seed.cast("string"), 256), F.lit(12)))


def billable_input(input_tokens: Column, cache_read: Column, cache_creation: Column) -> Column:
    """Input tokens with those read from and written to a cache; null where none is known."""
    parts = (input_tokens, cache_read, cache_creation)
    return F.when(F.coalesce(*parts).isNotNull(), sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))))


def common_value(value: Column) -> Column:
    """An aggregate: the one value that all non-empty values share, null where there are several or none."""
    v = F.nullif(value, F.lit(""))
    return F.when(F.min(v) == F.max(v), F.max(v))
