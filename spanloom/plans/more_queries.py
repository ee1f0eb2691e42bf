"""Queries of small functions, sidecars, insights and reviewers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import coding_graders, insights, text_formats
from ..operators.judges import criteria_of, verdict
from ..sources import sidecars
from . import views as v
from .registry import query


@query("q97_tool_types", """SELECT n_nationkey, ['shell', 'file', 'search', 'web', 'mcp', 'llm', 'tool'][n_nationkey % 7 + 1] AS kind FROM nation""")
def q97(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("Bash", "str_replace", "Grep", "WebFetch", "mcp__db__q", "llm.generation", "purchase")])
    return v.read(spark, sf_dir, "nation").select("n_nationkey", s.tool_type(F.element_at(names, (F.col("n_nationkey") % 7 + 1).cast("int"))).alias("kind"))


@query("q98_input_strings", """SELECT o_orderkey, o_orderstatus || '|' || o_orderkey || '|deep' AS strings FROM orders""")
def q98(spark, sf_dir):
    """Texts down to four levels: numbers are none, and what lies deeper is left out."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(F.lit('{"a":"'), F.col("o_orderstatus"), F.lit('","b":{"c":["'), k, F.lit('",7,{"d":"deep","e":{"f":"too deep"}}]}}'))
    return v.read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(s.input_strings(text), "|").alias("strings"))


@query("q99_skill_names", """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'f' || s_suppkey END AS skill FROM supplier""")
def q99(spark, sf_dir):
    even, key = F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")
    text = F.when(even, F.concat(F.lit('---\ndescription: x\nname: "'), F.col("s_name"), F.lit('"\n---\nbody\nname: no'))).otherwise("# no front matter\nname: no")
    d = v.read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("/r/f"), key, F.lit("/SKILL.md")).alias("file"), text.alias("content"))
    return d.select(F.regexp_extract("file", "f([0-9]+)/", 1).cast("long").alias("s_suppkey"), s.skill_name(F.col("content"), sidecars.folder(F.col("file"))).alias("skill"))


@query("q100_common_values", """SELECT o_custkey, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN max(o_orderstatus) END AS status FROM orders GROUP BY 1""")
def q100(spark, sf_dir):
    return v.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(s.common_value(F.col("o_orderstatus")).alias("status"))


@query("q101_harness_results", """SELECT '/runs/' || (c_custkey % 5) || '/a/' || c_custkey || '/t.json#0' AS trace_id, CASE WHEN c_custkey % 5 < 3 THEN 'task' || (c_custkey % 5) ELSE 'own' END AS task_id,
  CASE WHEN c_custkey % 5 < 3 THEN 'trial' || (c_custkey % 5) ELSE 'me' END AS trial_id, CASE WHEN c_custkey % 5 < 3 THEN '{"reward":' || (c_custkey % 5) || '}' END AS rewards FROM customer""")
def q101(spark, sf_dir):
    """A harness's results two folders above a trajectory give it its names; rewards go to its metadata."""
    c = v.read(spark, sf_dir, "customer")
    run = F.concat(F.lit("/runs/"), (F.col("c_custkey") % 5).cast("string"))
    traces = c.select(F.concat(run, F.lit("/a/"), F.col("c_custkey").cast("string"), F.lit("/t.json#0")).alias("trace_id"), F.lit("own").alias("task_id"), F.lit("me").alias("trial_id"), F.lit(None).cast("string").alias("metadata"))
    n = F.col("id").cast("string")
    told = spark.range(3).select(F.concat(F.lit("/runs/"), n, F.lit("/results.json")).alias("file"), F.concat(F.lit('{"task_name":"task'), n, F.lit('","trial_name":"trial'), n, F.lit('","rewards":{"reward":'), n, F.lit("}}")).alias("content"))
    return sidecars.with_harness(traces, told).select("trace_id", "task_id", "trial_id", F.get_json_object("metadata", "$.harness_rewards").alias("rewards"))


@query("q102_benchmark_tests", """SELECT 'i' || o_orderkey AS instance_id, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 3 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score, o_orderkey % 3 = 0 AS passed FROM orders""")
def q102(spark, sf_dir):
    """Instances as JSON lines; a test that failed or never ran fails its instance."""
    o = v.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("instance_id"))
    line = F.concat(F.lit('{"instance_id":"'), "instance_id", F.lit('","FAIL_TO_PASS":"[\\"t::a\\"]","PASS_TO_PASS":["t::b"]}'))
    files = o.groupBy((F.col("k") % 50).alias("g")).agg(F.array_join(F.collect_list(line), "\n").alias("content")).select(F.col("g").cast("string").alias("file"), "content")
    ran = o.select("instance_id", F.when(F.col("k") % 3 == 0, "PASSED t::a\nPASSED t::b").when(F.col("k") % 3 == 1, "PASSED t::a\nFAILED t::b").otherwise("FAILED t::a").alias("stdout"))
    return coding_graders.named_tests(ran, sidecars.expected_tests(sidecars.instances(files)), "instance_id").select("instance_id", "score", "passed")


@query("q103_file_union", """SELECT coalesce(a.o_orderkey, b.o_orderkey) AS trial_id, CASE WHEN a.o_orderkey IS NULL THEN '' ELSE a.o_orderstatus END AS before, CASE WHEN b.o_orderkey IS NULL THEN '' ELSE b.o_orderstatus END AS after
  FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 5 <> 0) b USING (o_orderkey)""")
def q103(spark, sf_dir):
    o = v.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trial_id"), F.lit("f.py").alias("path"), F.col("o_orderstatus").alias("content"))
    return coding_graders.file_union(o.where("trial_id % 3 <> 0"), o.where("trial_id % 5 <> 0")).select("trial_id", "before", "after")


@query("q104_structured_formats", """SELECT p_partkey, p_partkey % 4 <> 3 AS yaml, p_partkey % 4 = 0 AS keyed, p_partkey % 4 <> 2 AS xml FROM part""")
def q104(spark, sf_dir):
    k = F.col("p_partkey") % 4
    body = F.when(k == 0, "name: x\nsize: 3").when(k == 3, "a: [1, 2").otherwise("other: 1")
    page = F.when(k == 2, "<a><b></a>").otherwise("<a><b>1</b></a>")
    d = v.read(spark, sf_dir, "part").select("p_partkey", body.alias("t"), page.alias("x"))
    return d.select("p_partkey", *[text_formats.structure(F.col(c), fmt, keys, tags)["passed"].alias(n) for n, c, fmt, keys, tags in (("yaml", "t", "yaml", (), ()), ("keyed", "t", "yaml", ["name", "size"], ()), ("xml", "x", "xml", (), ["b"]))])


@query("q105_schema_in_batches", """SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 / 3 ELSE 0 END, 6)::DOUBLE AS score FROM orders""")
def q105(spark, sf_dir):
    """Items, references and closed objects: the weighted share of the named fields that hold, 0 for broken JSON."""
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}, "l": {"type": "array", "items": {"$ref": "#/definitions/i"}}}, "definitions": {"i": {"type": "object", "required": ["n"], "additionalProperties": False}}}
    schema["definitions"]["i"]["properties"] = {"n": {"type": "integer", "minimum": 0}}
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, '{"k": 1, "l": [{"n": 2}, {"n": 0}]}').when(k % 3 == 1, '{"k": 1, "l": [{"n": -2}]}').otherwise("{broken")
    return v.read(spark, sf_dir, "orders").select("o_orderkey", F.round(text_formats.schema_udf(schema)(text), 6).alias("score"))


_FACTS = """f AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, c_acctbal > 0 AS passed, c_custkey % 17 = 0 AS errored, CASE WHEN c_custkey % 29 = 0 THEN 'regressed' END AS flip, c_custkey % 3 = 0 AS tagged FROM customer)"""


def _facts(spark, sf_dir):
    k = F.col("c_custkey")
    return v.read(spark, sf_dir, "customer").select(
        k.cast("string").alias("case_id"), (F.col("c_acctbal") > 0).alias("passed"), (k % 17 == 0).alias("errored"), F.when(k % 29 == 0, "regressed").alias("flip"), F.when(k % 3 == 0, F.array(F.lit("t"))).otherwise(F.array().cast("array<string>")).alias("failure_tags"), F.lit(False).alias("process_failed"),
    )


@query("q106_prompt_cases", f"""WITH {_FACTS} SELECT case_id, rank FROM (SELECT case_id, CASE WHEN flip IS NOT NULL THEN 0 WHEN errored THEN 1 WHEN NOT passed THEN 2 WHEN tagged THEN 3 ELSE 4 END AS rank FROM f) ORDER BY rank, case_id LIMIT 80""")
def q106(spark, sf_dir):
    return insights.ranked_facts(_facts(spark, sf_dir)).select("case_id", "rank")


@query("q107_grounded_rate", f"""WITH {_FACTS} SELECT count(*) FILTER (NOT passed AND NOT errored) AS kept, count(*) FILTER (passed OR errored) AS dropped, count(*) FILTER (NOT passed AND NOT errored) / count(*) AS rate FROM f""")
def q107(spark, sf_dir):
    """One claim of failure for each case: kept where the case did fail."""
    facts = _facts(spark, sf_dir)
    claims = facts.select(F.col("case_id").cast("int").alias("pos"), F.lit("failure_pattern").alias("claim_type"), F.lit("low").alias("severity"), F.lit("t").alias("title"), F.lit("m").alias("message"), F.array("case_id").alias("case_ids"))
    return insights.grounded_rate(insights.ground(claims, facts, max_claims=1 << 30))


@query("q108_known_ids", """SELECT doc_id AS pos, 'src' || k AS case_id FROM documents, unnest(range(3)) t(k) WHERE k = 0 OR (k = 1 AND doc_id % 2 = 0) OR (k = 2 AND doc_id % 3 = 0)""")
def q108(spark, sf_dir):
    d = v.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.concat(F.lit("see src0, src0x and (src00); "), F.when(F.col("pos") % 2 == 0, "src1. ").otherwise("xsrc1 "), F.when(F.col("pos") % 3 == 0, "src2").otherwise("src2-b")).alias("text"))
    ids = spark.createDataFrame([("src0",), ("src1",), ("src2",)], "case_id string")
    return insights.known_ids(d, ids)


@query("q109_next_anchors", """SELECT o_custkey AS reviewer, min(a) AS anchor FROM (SELECT DISTINCT o_custkey FROM orders), unnest(['P', 'F', 'O']) t(a) WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = orders.o_custkey AND o.o_orderstatus = a) GROUP BY 1""".replace("(SELECT DISTINCT o_custkey FROM orders)", "(SELECT DISTINCT o_custkey FROM orders) orders"))
def q109(spark, sf_dir):
    """Reviewers have scored the anchors of their orders' states; the next is the first that they haven't."""
    r = v.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reviewer"), F.col("o_orderstatus").alias("anchor"))
    return insights.next_anchors(spark.createDataFrame([("P",), ("F",), ("O",)], "anchor string"), r, r)


@query("q110_recalibration", """SELECT o_custkey AS reviewer, count(*) FILTER (o_orderkey > o_custkey) >= 5 OR o_custkey % 2 = 1 AS due FROM orders GROUP BY 1""")
def q110(spark, sf_dir):
    r = v.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reviewer"), F.col("o_orderkey").alias("at"))
    done = r.select("reviewer").distinct().select("reviewer", (F.col("reviewer") % 2 == 0).alias("passed"), F.col("reviewer").alias("at"))
    return insights.needs_recalibration(done, r, 5)


@query("q111_verdicts", """SELECT n_nationkey, round((0.5 * (n_nationkey % 3) + CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END) / 2, 6)::DOUBLE AS score FROM nation""")
def q111(spark, sf_dir):
    """Structured answers of a judge: the mean of its criteria, 0 for one that an answer leaves out."""
    criteria = criteria_of("rubric", {"criteria": ["a", "b"]})
    n = F.col("n_nationkey")
    text = F.concat(F.lit('{"criteria_scores":{"a":{"score":'), (n % 3 * 0.5).cast("string"), F.lit("}"), F.when(n % 2 == 0, ',"b":1').otherwise(""), F.lit("}}"))

    @F.pandas_udf("double")
    def score(answers):
        return answers.map(lambda a: verdict(a, criteria)["score"])

    return v.read(spark, sf_dir, "nation").select("n_nationkey", F.round(score(text), 6).alias("score"))


@query("q112_billable_tokens", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber > 2 THEN 5 ELSE 0 END END AS tokens FROM lineitem""")
def q112(spark, sf_dir):
    n = F.col("l_linenumber")
    t = s.billable_input(F.when(n != 7, F.col("l_quantity").cast("long")), F.when((n > 2) & (n != 7), F.lit(5)), F.lit(None).cast("long"))
    return v.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", t.alias("tokens"))
