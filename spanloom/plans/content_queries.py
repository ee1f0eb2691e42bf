"""Queries over answers: texts, JSON, SQL, rows, markers, prices, sweeps, claims, trees, vectors and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..functions.partitions import spread
from ..operators import content_graders as c, insights, lookups, redaction
from ..operators.process_graders import matches_tool
from ..streaming.windows import sessions, sliding, tumbling
from . import views as v
from .registry import query
from .rollup_queries import rounded


def _documents(spark, sf_dir):
    return spread(v.read(spark, sf_dir, "documents").select("doc_id", "text"))


@query("q34_leak_detection", "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0")
def q34(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return lookups.find_markers(docs, v.read(spark, sf_dir, "benchmark"), marker_id="item_id", marker="text")


@query("q35_style_lengths", r"""SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(len(regexp_extract_all(text, '\S+')) AS INTEGER) AS words, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines,
  len(regexp_extract_all(text, '\S+')) BETWEEN 20 AND 400 AS fits FROM documents""")
def q35(spark, sf_dir):
    t = F.col("text")
    grade = c.expected_block(t, min_words=20, max_words=400)
    return _documents(spark, sf_dir).select("doc_id", F.length(t).alias("chars"), s.words(t).alias("words"), s.lines(t).alias("lines"), grade["passed"].alias("fits"))


@query("q36_style_phrases", r"""WITH d AS (SELECT doc_id, contains(lower(text), 'the') AS wanted, NOT contains(lower(text), 'licensed') AS unwanted, len(regexp_extract_all(text, '\S+')) <= 300 AND len(string_split(text, chr(10))) <= 12 AS length FROM documents)
  SELECT doc_id, round((wanted::INT + unwanted::INT + length::INT) / 3, 6) AS score, wanted AND unwanted AND length AS passed FROM d""")
def q36(spark, sf_dir):
    g = c.style(F.col("text"), max_words=300, max_lines=12, required_phrases=["The"], forbidden_phrases=["Licensed"])
    return rounded(_documents(spark, sf_dir).select("doc_id", g.alias("g")).select("doc_id", "g.score", "g.passed"), "score")


_MARKDOWN = "'# ' || p_name || chr(10) || 'body' || chr(10) || CASE WHEN p_size % 3 = 0 THEN '### ' ELSE '## ' END || p_brand || chr(10) || CASE WHEN p_size % 5 = 0 THEN '```' || chr(10) ELSE '' END || p_type"


def _markdown(spark, sf_dir):
    nl = F.lit("\n")
    size = F.col("p_size")
    text = F.concat(F.lit("# "), "p_name", nl, F.lit("body"), nl, F.when(size % 3 == 0, "### ").otherwise("## "), F.col("p_brand"), nl, F.when(size % 5 == 0, F.lit("```\n")).otherwise(""), F.col("p_type"))
    return v.read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query("q37_style_sections", f"SELECT p_partkey, string_agg(trim(t), '|') AS titles, bool_or(lower(trim(t)) = 'brand#7') AS has_section FROM (SELECT p_partkey, unnest(regexp_extract_all({_MARKDOWN}, '(?m)^#{{1,6}}[ \\t]+(.+?)[ \\t]*$', 1)) AS t FROM part) GROUP BY 1")
def q37(spark, sf_dir):
    g = c.style(F.col("text"), required_sections=["brand#7"])
    return _markdown(spark, sf_dir).select("p_partkey", F.array_join(c.sections(F.col("text")), "|").alias("titles"), g["passed"].alias("has_section"))


@query("q38_markdown", "SELECT p_partkey, p_size % 3 <> 0 AND p_size % 5 <> 0 AS passed FROM part")
def q38(spark, sf_dir):
    return _markdown(spark, sf_dir).select("p_partkey", c.style(F.col("text"), markdown=True)["passed"].alias("passed"))


@query("q39_exact_match", """SELECT event_id, props = '{"k": ' || (event_id % 97) || '}' AS json_equal, lower(event_type) = 'view' AS text_equal FROM events""")
def q39(spark, sf_dir):
    want = F.concat(F.lit('{ "k" :'), (F.col("event_id") % 97).cast("string"), F.lit("}"))
    return v.read(spark, sf_dir, "events").select(
        "event_id", c.exact_match(F.col("props"), want, as_json=True)["passed"].alias("json_equal"), c.exact_match(F.concat(F.lit(" "), F.upper("event_type")), F.lit("View "), fold=True)["passed"].alias("text_equal")
    )


_SCHEMA = {"type": "object", "required": ["k", "name"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 50}, "name": {"type": "string", "maxLength": 5}, "tag": {"enum": ["a", "b"]}}}


@query("q40_json_checks", """WITH d AS (SELECT event_id, event_id % 3 <> 0 AS has_name, length(event_type) <= 5 AS short, CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 50 AS fits, event_id % 4 AS t FROM events),
  w AS (SELECT event_id, (1 + CASE WHEN fits THEN 2 ELSE 0 END + CASE WHEN has_name AND short THEN 2 ELSE 0 END + CASE WHEN t <> 1 THEN 1 ELSE 0 END) / 6 AS score FROM d)
  SELECT event_id, round(score, 6) AS score, score >= 0.7 AS passed, score = 1 AS strict_passed FROM w""")
def q40(spark, sf_dir):
    e = v.read(spark, sf_dir, "events")
    extra = F.when(F.col("event_id") % 4 == 1, ', "tag": "z"').when(F.col("event_id") % 4 == 2, ', "tag": "a"').otherwise("")
    name = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(', "name": "'), "event_type", F.lit('"'))).otherwise("")
    text = F.concat(F.rtrim(F.regexp_replace("props", r"\}\s*$", "")), name, extra, F.lit("}"))
    d = e.select("event_id", c.json_schema(text, _SCHEMA, strict=False).alias("g"), c.json_schema(text, _SCHEMA)["passed"].alias("strict_passed"))
    return rounded(d.select("event_id", "g.score", "g.passed", "strict_passed"), "score")


def _two_suppliers(spark, sf_dir):
    d = v.read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    actual = d.where("s_suppkey % 13 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal") * (1 + 1e-9)))
    return actual, d.where("s_suppkey % 17 <> 0")


@query("q41_compare_rows_keyed", """SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN 'missing' WHEN s_suppkey % 17 = 0 THEN 'extra' ELSE 'mismatch' END AS kind,
  CASE WHEN s_suppkey % 13 = 0 OR s_suppkey % 17 = 0 THEN '*' ELSE 's_acctbal' END AS "column" FROM supplier
  WHERE (s_suppkey % 13 = 0) <> (s_suppkey % 17 = 0) OR (s_suppkey % 7 = 0 AND s_suppkey % 13 <> 0 AND s_suppkey % 17 <> 0)""")
def q41(spark, sf_dir):
    return c.compare_keyed(*_two_suppliers(spark, sf_dir), ["s_suppkey"]).select("s_suppkey", "kind", "column")


@query("q42_compare_rows_ranked", """WITH e AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS t, p_size AS x FROM part), r AS (SELECT *, row_number() OVER (ORDER BY t) AS row_number FROM e)
  SELECT row_number, 'x' AS "column", CAST(CASE WHEN k % 11 = 0 THEN x + 1 ELSE x END AS VARCHAR) AS actual, CAST(x AS VARCHAR) AS expected FROM r WHERE k % 11 = 0""")
def q42(spark, sf_dir):
    e = v.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("x"))
    a = e.withColumn("x", F.when(F.col("k") % 11 == 0, F.col("x") + 1).otherwise(F.col("x")))
    return c.compare_ranked(a, e, ["k"]).select(F.col("row_number").cast("long").alias("row_number"), "column", "actual", "expected")


@query("q43_data_correctness", """SELECT n_nationkey, n_name = 'NATION_' || (n_nationkey - n_nationkey % 3) AS name_ok, abs(n_regionkey * 1.0001 - n_regionkey) <= CASE WHEN n_regionkey = 0 THEN 0.001 ELSE 0.001 * n_regionkey END AS region_ok FROM nation""")
def q43(spark, sf_dir):
    n = F.col("n_nationkey")
    return v.read(spark, sf_dir, "nation").select(
        "n_nationkey", s.same_value(F.concat(F.lit(" "), "n_name"), F.concat(F.lit("NATION_"), (n - n % 3).cast("string")), 1e-3).alias("name_ok"), s.same_value(F.col("n_regionkey") * 1.0001, F.col("n_regionkey"), 1e-3).alias("region_ok")
    )


_SQLS = ("SELECT * FROM t WHERE a = 1;", "select a -- note\n from t, u", "DELETE FROM t", "SELECT a, COUNT(b) FROM t WHERE c > 1", "SELECT a FROM t WHERE a IN (SELECT b FROM u);", "SELECT a FROM t JOIN u ON t.a = u.a WHERE b = 2")


@query("q44_query_quality", """SELECT p_partkey, [0.7, 0.0, 0.5, 0.0, 0.3, 1.0][p_partkey % 6 + 1]::DOUBLE AS score, [TRUE, FALSE, FALSE, FALSE, FALSE, TRUE][p_partkey % 6 + 1] AS passed,
  [1, 1, 1, 1, 1, 0][p_partkey % 6 + 1] AS issues, [1.0, 0.8, 0.0, 0.8, 1.0, 0.8][p_partkey % 6 + 1]::DOUBLE AS syntax FROM part""")
def q44(spark, sf_dir):
    sql = F.element_at(F.array(*map(F.lit, _SQLS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    d = v.read(spark, sf_dir, "part").select("p_partkey", c.query_quality(sql).alias("g"), c.sql_syntax(sql)["score"].alias("syntax"))
    return rounded(d.select("p_partkey", "g.score", "g.passed", "g.issues", "syntax"), "score", "syntax")


@query("q45_sql_equivalence", """WITH a AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1), b AS (SELECT CAST(n_nationkey % 5 AS INTEGER) AS n_regionkey, count(*) AS n FROM nation GROUP BY 1)
  SELECT 'actual' AS side, count(*) AS rows FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'expected', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def q45(spark, sf_dir):
    nation = v.read(spark, sf_dir, "nation")
    a = spark.sql("SELECT n_regionkey, count(*) AS n FROM {t} GROUP BY 1", t=nation)
    return c.bag_difference(a, spark.sql("SELECT CAST(n_nationkey % 5 AS INT) AS n_regionkey, count(*) AS n FROM {t} GROUP BY 1", t=nation))


_TOOL = "CASE p_size % 4 WHEN 0 THEN 'Fs.Read' WHEN 1 THEN 'mcp__db.tables:Query' WHEN 2 THEN 'shell' ELSE 'git.repo.main.push' END"


@query("q47_tool_name_parse", """SELECT p_partkey, ['Fs', 'mcp__db', 'custom', 'git'][p_size % 4 + 1] AS adapter, [NULL, NULL, NULL, 'repo.main'][p_size % 4 + 1] AS resource, ['Read', 'tables:Query', 'shell', 'push'][p_size % 4 + 1] AS action,
  ['read', 'query', 'shell', 'push'][p_size % 4 + 1] AS last, ['upper case', 'upper case', 'no adapter', ''][p_size % 4 + 1] AS warnings, [FALSE, FALSE, FALSE, TRUE][p_size % 4 + 1] AS is_git FROM part""")
def q47(spark, sf_dir):
    t = v.read(spark, sf_dir, "part").select("p_partkey", F.expr(_TOOL).alias("t"))
    name = F.col("t")
    return t.select("p_partkey", s.tool_parts(name).alias("p"), s.last_segment(name).alias("last"), F.array_join(s.tool_warnings(name), ",").alias("warnings"), matches_tool(name, "git.*").alias("is_git")).select("p_partkey", "p.*", "last", "warnings", "is_git")


@query("q48_pricing_longest_prefix", """WITH p AS (SELECT * FROM (VALUES ('small', 1.0), ('small ring', 2.0), ('red', 3.0), ('red widget', 4.0), ('blue b', 5.0)) t(price_key, price)),
  m AS (SELECT part.p_partkey, p_name, p.*, row_number() OVER (PARTITION BY part.p_partkey ORDER BY p_name = price_key DESC, length(price_key) DESC) AS i FROM part LEFT JOIN p ON starts_with(p_name, price_key))
  SELECT p_partkey, price_key, round(p_partkey / 1e6 * price::DOUBLE + 10 / 1e6 * price::DOUBLE * 2, 9) AS cost FROM m WHERE i = 1""")
def q48(spark, sf_dir):
    prices = spark.createDataFrame([("small", 1.0), ("small ring", 2.0), ("red", 3.0), ("red widget", 4.0), ("blue b", 5.0)], "model string, price double")
    d = lookups.price_models(v.read(spark, sf_dir, "part").select("p_partkey", "p_name"), prices, "p_name")
    usd = s.cost(F.col("p_partkey"), F.lit(10), F.lit(0), {"input": F.col("price"), "output": F.col("price") * 2, "cached": F.lit(0.0)})
    return rounded(d.select("p_partkey", "price_key", usd.alias("cost")), "cost", digits=9)


@query("q49_sweep_expand", """SELECT n_name || '__sweep__depth=' || d || '__temp=' || t AS case_id FROM nation, (VALUES (1), (2), (3)) x(d), (VALUES ('0.1'), ('0.5')) y(t)""")
def q49(spark, sf_dir):
    d = v.read(spark, sf_dir, "nation").select("n_name", F.explode(F.array(F.lit("0.1"), F.lit("0.5"))).alias("temp"))
    d = d.select("n_name", "temp", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("depth"))
    return d.select(s.sweep_id(F.col("n_name"), ["temp", "depth"], [F.col("temp"), F.col("depth")]).alias("case_id"))


@query("q50_sweep_summary", """WITH r AS (SELECT c_mktsegment AS base, c_nationkey % 3 AS d, c_nationkey % 2 AS t, avg(c_acctbal) / 10000 AS score FROM customer GROUP BY ALL)
  SELECT base, count(*) AS total, count(*) FILTER (score >= 0.5) AS passed, round(count(*) FILTER (score >= 0.5) / count(*), 6) AS pass_rate, arg_max('d=' || d || '__t=' || t, score) AS best, arg_min('d=' || d || '__t=' || t, score) AS worst FROM r GROUP BY 1""")
def q50(spark, sf_dir):
    r = v.read(spark, sf_dir, "customer")
    r = r.groupBy("c_mktsegment", (F.col("c_nationkey") % 3).alias("d"), (F.col("c_nationkey") % 2).alias("t")).agg((F.avg("c_acctbal") / 10000).alias("score"))
    r = r.select(s.sweep_id(F.col("c_mktsegment"), ["d", "t"], [F.col("d"), F.col("t")]).alias("case_id"), "score", F.lit(0).alias("pos"))
    return rounded(sweep_summary(r.withColumn("passed", F.col("score") >= 0.5)), "pass_rate").select("base", "total", "passed", "pass_rate", "best", "worst")


def sweep_summary(results):
    """Totals and the best and worst combination of each sweep in ``results(case_id, score, passed)``."""
    combo = F.substring_index("case_id", "__sweep__", -1)
    d = results.where(F.instr("case_id", "__sweep__") > 0).withColumns({"base": s.sweep_base(F.col("case_id")), "combo": combo})
    return d.groupBy("base").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("score").alias("mean_score"),
        F.max_by("combo", F.struct("score", "combo")).alias("best"), F.min_by("combo", F.struct("score", "combo")).alias("worst"),
    )


@query("q51_redact_counts", r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)[A-Za-z0-9_.-]*(?:api[_-]?key|secret|token|passw(?:or)?d|credential)[A-Za-z0-9_.-]*\s*=\s*["'']?[A-Za-z0-9._~+/=-]{8,}')) AS INTEGER) AS secrets,
  CAST(len(regexp_extract_all(text, 'AKIA[A-Z0-9]{16}')) AS INTEGER) AS aws FROM documents""")
def q51(spark, sf_dir):
    n = redaction.counts(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", n["secret_assignment"].alias("secrets"), n["aws_access_key"].alias("aws"))


@query("q52_reviewer_drift", """WITH d AS (SELECT l_suppkey AS reviewer, l_partkey % 50 AS anchor, CAST(l_linenumber % 2 AS VARCHAR) AS criterion, abs(l_discount * 10 - (l_partkey % 50) / 50) AS drift FROM lineitem)
  SELECT reviewer, count(DISTINCT anchor) AS anchors, round(avg(drift), 6) AS mean_drift, round(max(drift), 6) AS worst_drift, avg(drift) <= 0.34 AND count(DISTINCT anchor) >= 3 AS passed FROM d GROUP BY 1""")
def q52(spark, sf_dir):
    li = v.read(spark, sf_dir, "lineitem")
    responses = li.select(F.col("l_suppkey").alias("reviewer"), (F.col("l_partkey") % 50).alias("anchor"), (F.col("l_linenumber") % 2).cast("string").alias("criterion"), (F.col("l_discount") * 10).alias("score"))
    anchors = spark.range(50).select(F.col("id").alias("anchor"), F.explode(F.array(F.lit("0"), F.lit("1"))).alias("criterion"), (F.col("id") / 50).alias("expected"))
    return rounded(insights.calibration(anchors, responses, 0.34), "mean_drift", "worst_drift")


@query("q53_claim_grounding", f"""WITH {v.CASES}, f AS (SELECT CAST(case_id AS VARCHAR) AS case_id, status FROM cases), c AS (SELECT CAST(p_partkey AS BIGINT) AS pos, CASE p_partkey % 4 WHEN 0 THEN 'failure_pattern' WHEN 1 THEN 'harness_error' WHEN 2 THEN 'regression' ELSE 'gossip' END AS kind,
    CASE WHEN p_partkey % 9 = 0 THEN 'info' ELSE 'high' END AS severity, CAST(p_partkey AS VARCHAR) AS cite FROM part),
  r AS (SELECT pos, CASE WHEN kind = 'gossip' THEN 'unknown claim type' WHEN severity = 'info' THEN 'severity not allowed' WHEN kind = 'regression' THEN 'needs a comparison' WHEN status IS NULL THEN 'cites unknown cases'
    WHEN kind = 'failure_pattern' AND status <> 'failed' OR kind = 'harness_error' AND status <> 'error' THEN 'not supported' END AS reason FROM c LEFT JOIN f ON cite = case_id),
  k AS (SELECT pos, reason, row_number() OVER (PARTITION BY reason IS NULL ORDER BY pos) AS i FROM r)
  SELECT pos, CASE WHEN reason IS NULL AND i > 6 THEN 'over the limit' ELSE reason END AS reason, reason IS NULL AND i <= 6 AS kept FROM k""")
def q53(spark, sf_dir):
    facts = v.cases(spark, sf_dir).select(
        F.col("case_id").cast("string").alias("case_id"), "passed", (F.col("status") == "error").alias("errored"), F.lit(None).cast("string").alias("flip"), F.lit(False).alias("process_failed"), F.array().cast("array<string>").alias("failure_tags")
    )
    k = F.col("p_partkey")
    claims = v.read(spark, sf_dir, "part").select(
        k.alias("pos"), F.when(k % 4 == 0, "failure_pattern").when(k % 4 == 1, "harness_error").when(k % 4 == 2, "regression").otherwise("gossip").alias("claim_type"),
        F.when(k % 9 == 0, "info").otherwise("high").alias("severity"), F.lit("title").alias("title"), F.lit("message").alias("message"), F.array(k.cast("string")).alias("case_ids"),
    )
    return insights.ground(claims, facts).select("pos", "reason", "kept")


@query("q54_parent_chain", """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN (p_partkey - 1) // 3 END AS parent, p_size % 10 = 0 AS hit FROM part),
  w AS (SELECT id, parent AS at FROM n UNION ALL SELECT w.id, n.parent FROM w JOIN n ON w.at = n.id WHERE NOT n.hit)
  SELECT n0.id, a.at AS ancestor FROM n n0 LEFT JOIN (SELECT w.id, w.at FROM w JOIN n ON w.at = n.id WHERE n.hit) a ON a.id = n0.id""")
def q54(spark, sf_dir):
    k = F.col("p_partkey")
    nodes = v.read(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 0, F.floor((k - 1) / 3)).alias("parent"), (F.col("p_size") % 10 == 0).alias("hit"))
    return lookups.nearest_ancestor(nodes, F.col("hit"))


@query("q57_semantic_match", """WITH c AS (SELECT label, embedding AS centre FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings) WHERE i = 1)
  SELECT vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(c.centre AS DOUBLE[])), 5) AS score, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(c.centre AS DOUBLE[])) >= 0.25 AS passed FROM embeddings e JOIN c USING (label)""")
def q57(spark, sf_dir):
    e = v.read(spark, sf_dir, "embeddings")
    centre = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("centre"))
    d = e.join(centre, "label").select("vec_id", c.semantic_match(F.col("embedding"), F.col("centre")).alias("g"))
    return rounded(d.select("vec_id", "g.score", "g.passed"), "score", digits=5)


@query("q58_session_window_ext", """WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS started, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def q58(spark, sf_dir):
    d = sessions(v.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "6 hours", "user_id")
    return rounded(d.select("user_id", F.unix_timestamp("started").alias("started"), "events", "total"), "total", digits=4)


@query("q59_tumbling_ext", """SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS started, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def q59(spark, sf_dir):
    d = tumbling(v.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "event_type")
    return rounded(d.select(F.unix_timestamp("started").alias("started"), "event_type", "events", "total"), "total", digits=4)


@query("q59b_sliding_ext", """WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS started, value FROM events, (VALUES (0), (1)) x(k))
  SELECT CAST(epoch(started) AS BIGINT) AS started, count(*) AS events, round(sum(value), 4) AS total FROM w GROUP BY 1""")
def q59b(spark, sf_dir):
    d = sliding(v.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "30 minutes")
    return rounded(d.select(F.unix_timestamp("started").alias("started"), "events", "total"), "total", digits=4)


@query("q60_approx_distinct_ext")
def q60(spark, sf_dir):
    return v.read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.approx_percentile("l_quantity", F.lit(0.5)).alias("median_quantity"))
