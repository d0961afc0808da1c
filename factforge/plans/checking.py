"""Queries of section 2.7: rule checks and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from factforge.operators import fuse, prep, rules
from factforge.plans.base import dealt, query, table, view

FIELDS = ["wire_diameter", "outer_diameter", "free_length", "total_coils"]
LIMITS = {"wire_diameter": (0.3, 4.0), "outer_diameter": (18.5, 30.0), "free_length": (25.0, 90.0)}
BASE = "CASE force_unit WHEN 'N' THEN 1.0::DOUBLE WHEN 'kN' THEN 1000.0 ELSE 9.80665 END"
RANKSQL = "CASE status WHEN 'pass' THEN 0 WHEN 'warning' THEN 1 WHEN 'need_review' THEN 2 WHEN 'missing' THEN 3 WHEN 'fail' THEN 4 END"


@query("rule_required_fields", "SELECT r.review_id, f.field, 'missing' AS status FROM (SELECT DISTINCT review_id FROM v_cand) r, (VALUES ('wire_diameter'), ('outer_diameter'), ('free_length')) f(field) WHERE NOT EXISTS (SELECT 1 FROM v_cand c WHERE c.review_id = r.review_id AND c.field = f.field)")
def rule_required_fields(spark, d):
    return rules.required_fields(view(spark, d, "v_cand"), FIELDS[:3])


RANGE = "SELECT review_id, concat_ws(', ', CASE WHEN NOT wire_diameter BETWEEN 0.3 AND 4.0 THEN 'wire_diameter' END, CASE WHEN NOT outer_diameter BETWEEN 18.5 AND 30.0 THEN 'outer_diameter' END, CASE WHEN NOT free_length BETWEEN 25.0 AND 90.0 THEN 'free_length' END) AS message FROM v_param"


@query("rule_capability_range", f"WITH r AS ({RANGE}) SELECT review_id, CASE WHEN message = '' THEN 'pass' ELSE 'fail' END AS status, message FROM r")
def rule_capability_range(spark, d):
    return rules.capability_range(view(spark, d, "v_param"), LIMITS)


@query("rule_height_vs_free", "SELECT review_id, CASE WHEN bool_or(height >= free_length) THEN 'fail' ELSE 'pass' END AS status FROM v_point GROUP BY 1")
def rule_height_vs_free(spark, d):
    return rules.height_vs_free(view(spark, d, "v_point"))


MONO = f"m AS (SELECT review_id, force * {BASE} < lag(force * {BASE}) OVER (PARTITION BY review_id ORDER BY height DESC, seq) - 1e-9 AS falls FROM v_point)"


@query("rule_monotonic", f"WITH {MONO} SELECT review_id, CASE WHEN coalesce(bool_or(falls), false) THEN 'fail' ELSE 'pass' END AS status FROM m GROUP BY 1")
def rule_monotonic(spark, d):
    return rules.monotonic(view(spark, d, "v_point"), prep.to_base(F.col("force"), F.col("force_unit"), "force"))


@query("rule_tolerance_band", "SELECT review_id, CASE WHEN round(tol_upper - tol_lower, 9) > 0 AND round(tol_upper - tol_lower, 9) < 0.3 THEN 'warning' ELSE 'pass' END AS status FROM v_param")
def rule_tolerance_band(spark, d):
    return rules.tolerance_band(view(spark, d, "v_param"), 0.3)


@query("rule_policy_flags", "SELECT page_id, CASE WHEN contains(url, '#') THEN 'warning' ELSE 'pass' END AS scan_status, CASE WHEN contains(html, '<p>') THEN 'pass' ELSE 'need_review' END AS notes_status FROM pages")
def rule_policy_flags(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.when(F.contains("url", F.lit("#")), "warning").otherwise("pass").alias("scan_status"), F.when(F.contains("html", F.lit("<p>")), "pass").otherwise("need_review").alias("notes_status"))


def _all_results(spark, d):
    p, q = view(spark, d, "v_param"), view(spark, d, "v_point")
    name = lambda df, rule: df.select("review_id", F.lit(rule).alias("rule_id"), "status")
    out = name(rule_capability_range(spark, d), "range")
    for df, rule in ((rules.tolerance_band(p, 0.3), "band"), (rules.height_vs_free(q), "height"), (rule_monotonic(spark, d), "monotonic")):
        out = out.unionByName(name(df, rule))
    return out


ALL = f"""a AS (SELECT review_id, 'range' AS rule_id, CASE WHEN message = '' THEN 'pass' ELSE 'fail' END AS status FROM ({RANGE}) UNION ALL SELECT review_id, 'band', CASE WHEN round(tol_upper - tol_lower, 9) > 0 AND round(tol_upper - tol_lower, 9) < 0.3 THEN 'warning' ELSE 'pass' END FROM v_param
  UNION ALL SELECT review_id, 'height', CASE WHEN bool_or(height >= free_length) THEN 'fail' ELSE 'pass' END FROM v_point GROUP BY 1 UNION ALL SELECT review_id, 'monotonic', CASE WHEN coalesce(bool_or(falls), false) THEN 'fail' ELSE 'pass' END FROM m GROUP BY 1)"""


@query("rule_union", f"WITH {MONO}, {ALL} SELECT * FROM a")
def rule_union(spark, d):
    return _all_results(spark, d)


@query("rule_overall_status", f"SELECT owner_id, arg_max(status, {RANKSQL}) AS status, count(*) AS n FROM v_review GROUP BY 1")
def rule_overall_status(spark, d):
    return rules.overall_status(view(spark, d, "v_review"), "owner_id")


@query("rule_review_required", f"WITH {MONO}, {ALL}, f AS (SELECT review_id, status <> 'pass' AS flag FROM a UNION ALL SELECT review_id, confidence < 0.6 FROM v_cand) SELECT review_id, bool_or(flag) AS human_review_required FROM f GROUP BY 1")
def rule_review_required(spark, d):
    flags = _all_results(spark, d).select("review_id", (F.col("status") != "pass").alias("flag")).union(view(spark, d, "v_cand").select("review_id", F.col("confidence") < 0.6))
    return flags.groupBy("review_id").agg(F.bool_or("flag").alias("human_review_required"))


@query("rule_release_gate", "WITH g AS (SELECT owner_id, min(job_id) FILTER (status = 'fail') AS first_block, bool_or(status = 'need_review') AS r FROM v_review GROUP BY 1) SELECT owner_id, first_block, CASE WHEN first_block IS NOT NULL THEN 'blocked' WHEN r THEN 'review' ELSE 'ready' END AS gate FROM g")
def rule_release_gate(spark, d):
    return rules.release_gate(view(spark, d, "v_review"), "owner_id", "job_id", ["fail", "missing"])


@query("rule_status_by_field", f"WITH e AS (SELECT owner_id AS review_id, unnest(['f' || job_id % 3, 'f' || job_id % 5]) AS field, status FROM v_review) SELECT review_id, field, arg_max(status, {RANKSQL}) AS status FROM e GROUP BY 1, 2")
def rule_status_by_field(spark, d):
    f = lambda n: F.concat(F.lit("f"), (F.col("job_id") % n).cast("string"))
    r = view(spark, d, "v_review").select(F.col("owner_id").alias("review_id"), F.array(f(3), f(5)).alias("fields"), "status")
    return rules.status_by_field(r, "fields")


@query("rule_markers", f"""WITH s AS (SELECT review_id, CASE WHEN bool_or(height >= free_length) THEN 'fail' ELSE 'pass' END AS status FROM v_point GROUP BY 1),
  u AS (SELECT review_id, 1 AS kind, 0::BIGINT AS seq, field AS name, bool_or(confidence < 0.6) AS need FROM v_cand WHERE value IS NOT NULL GROUP BY review_id, field
    UNION ALL SELECT review_id, 2, seq, label, force_tol IS NULL FROM v_point UNION ALL SELECT doc_id, 3, line_no, text, true FROM v_note)
  SELECT u.review_id, kind, name, coalesce(s.status, CASE WHEN need THEN 'need_review' ELSE 'pass' END) AS status,
    CASE WHEN kind = 2 THEN '{rules.CHECK_POINT}' WHEN kind = 3 THEN '{rules.PASS_ON}' WHEN need THEN '{rules.CONFIRM}' ELSE '{rules.RECOGNIZED}' END AS message,
    row_number() OVER (PARTITION BY u.review_id ORDER BY kind, seq, name) AS number FROM u LEFT JOIN s ON s.review_id = u.review_id AND kind = 1 AND name = 'free_length'""")
def rule_markers(spark, d):
    points = view(spark, d, "v_point")
    fields = view(spark, d, "v_cand").where("value is not null").groupBy("review_id", F.col("field").alias("name")).agg(F.bool_or(F.col("confidence") < 0.6).alias("need"))
    notes = view(spark, d, "v_note").select(F.col("doc_id").alias("review_id"), F.col("line_no").alias("at"), F.col("text").alias("name"), F.lit(True).alias("need"))
    notes = dealt(notes, spark, d, "lineitem", "review_id")
    # of the results that relate to fields only this one names a field that has a marker
    statuses = rules.status_by_field(rules.height_vs_free(points).withColumn("fields", F.array(F.lit("free_length"))), "fields")
    return rules.markers(fields, points.select("review_id", F.col("seq").alias("at"), F.col("label").alias("name"), F.col("force_tol").isNull().alias("need")), notes, statuses)


GEOM = """g AS (SELECT review_id, CASE WHEN review_id % 31 > 0 THEN wire_diameter ELSE 0 - wire_diameter END AS d, outer_diameter AS o,
  CASE WHEN review_id % 4 = 0 THEN outer_diameter - 2 * wire_diameter + 0.5::DOUBLE WHEN review_id % 4 = 1 THEN outer_diameter - 2 * wire_diameter END AS i, CASE WHEN review_id % 37 = 0 THEN 0.0::DOUBLE END AS m,
  free_length AS f, total_coils AS t, CASE WHEN review_id % 9 = 0 THEN total_coils + 1 WHEN review_id % 9 < 6 THEN total_coils - 2 END AS a, CASE WHEN review_id % 5 = 0 THEN 1.0::DOUBLE WHEN review_id % 5 = 1 THEN 2.0 END AS s,
  CASE WHEN review_id % 6 = 0 THEN 30.0::DOUBLE END AS h, tol_upper AS u, end_mode AS e, review_id % 2 = 0 AS p, review_id % 3 > 0 AS cold FROM v_param),
k AS (SELECT *, coalesce(m, o - d, i + d) AS mm, coalesce(h, CASE e WHEN 'ground' THEN t * (d + greatest(0.0, u)) WHEN 'not_ground' THEN (t + 1.5::DOUBLE) * (d + greatest(0.0, u)) END) AS lowest FROM g)"""
GEOM_CHECKS = (
    ("SPRING-GEO-WIRE_DIAMETER", "blocked", "d <= 0"), ("SPRING-GEO-OUTER_DIAMETER", "blocked", "o <= 0"), ("SPRING-GEO-INNER_DIAMETER", "blocked", "i <= 0"), ("SPRING-GEO-MEAN_DIAMETER", "blocked", "m <= 0"),
    ("SPRING-GEO-FREE_LENGTH", "blocked", "f <= 0"), ("SPRING-GEO-TOTAL_COILS", "blocked", "t <= 0"), ("SPRING-GEO-ACTIVE_COILS", "blocked", "a <= 0"), ("SPRING-GEO-OUTER-INNER", "blocked", "o - 2 * d <= 0"),
    ("SPRING-GEO-DIAMETER-CONSISTENCY", "warning", "abs(i - (o - 2 * d)) > greatest(0.02, d * 0.02::DOUBLE)"), ("SPRING-GEO-COIL-COUNT", "blocked", "a > t"), ("SPRING-GEO-SUPPORT-COILS", "warning", "abs(s - (t - a) / 2) > 1e-9"),
    ("SPRING-CONTEXT-ACTIVE-COILS", "needs_input", "t > 0 AND a IS NULL AND e IS NULL"), ("GBT1239.2-SCOPE-SPRING-INDEX", "warning", "cold AND NOT mm / nullif(d, 0) BETWEEN 3 AND 22"),
    ("GBT1239.2-SCOPE-TOTAL-COILS", "warning", "cold AND t > 50"), ("GBT1239.2-SLENDERNESS", "warning", "cold AND f / nullif(mm, 0) >= 5"),
    ("SPRING-CONTEXT-END-CONDITION", "needs_input", "p AND h IS NULL AND e IS NULL AND d IS NOT NULL AND t IS NOT NULL"), ("SPRING-LOAD-FREE-OVER-SOLID", "blocked", "f <= lowest"),
)


def geometry_rows(spark, d):
    k, wire, outer, total = F.col("review_id"), F.col("wire_diameter"), F.col("outer_diameter"), F.col("total_coils")
    return view(spark, d, "v_param").select(
        "review_id", F.when(k % 31 > 0, wire).otherwise(-wire).alias("wire_diameter"), "outer_diameter", F.when(k % 4 == 0, outer - 2 * wire + 0.5).when(k % 4 == 1, outer - 2 * wire).alias("inner_diameter"),
        F.when(k % 37 == 0, 0.0).alias("mean_diameter"), "free_length", "total_coils", F.when(k % 9 == 0, total + 1).when(k % 9 < 6, total - 2).alias("active_coils"), F.when(k % 5 == 0, 1.0).when(k % 5 == 1, 2.0).alias("support_coils"),
        F.when(k % 6 == 0, 30.0).alias("solid_height"), F.col("tol_upper").alias("wire_upper"), "end_mode", (k % 2 == 0).alias("has_points"), (k % 3 > 0).alias("cold"),
    )


@query("rule_geometry_issues", f"WITH {GEOM} " + " UNION ALL ".join(f"SELECT review_id, '{r}' AS rule_id, '{s}' AS severity FROM k WHERE {c}" for r, s, c in GEOM_CHECKS))
def rule_geometry_issues(spark, d):
    return rules.issues(geometry_rows(spark, d), ["review_id"], rules.geometry_checks(F.col("cold")))


POINT_ROWS = """q AS (SELECT review_id, seq, CASE WHEN seq = 6 THEN 0 - height ELSE height END AS height, CASE WHEN l7 = 0 THEN 0 - force ELSE force END AS force, CASE WHEN l7 = 1 THEN 'inch?' ELSE height_unit END AS hu, CASE WHEN l7 = 2 THEN 'stone' ELSE force_unit END AS fu,
  free_length, CASE WHEN review_id % 3 > 0 THEN 51.0::DOUBLE + review_id % 10 END AS lowest FROM (SELECT *, (review_id + seq) % 7 AS l7 FROM v_point) AS x)"""
POINT = """SELECT review_id, seq, 'SPRING-LOAD-HEIGHT-UNIT' AS rule_id, 'warning' AS severity FROM q WHERE hu = 'inch?' UNION ALL SELECT review_id, seq, 'SPRING-LOAD-FORCE-UNIT', 'warning' FROM q WHERE fu = 'stone'
  UNION ALL SELECT review_id, seq, 'SPRING-LOAD-HEIGHT-POSITIVE', 'blocked' FROM q WHERE height <= 0 AND hu = 'mm' UNION ALL SELECT review_id, seq, 'SPRING-LOAD-FORCE-POSITIVE', 'blocked' FROM q WHERE force < 0 AND fu <> 'stone'
  UNION ALL SELECT review_id, seq, 'SPRING-LOAD-HEIGHT-OVER-FREE', 'blocked' FROM q WHERE height > free_length AND hu = 'mm' UNION ALL SELECT review_id, seq, 'SPRING-LOAD-HEIGHT-UNDER-SOLID', 'blocked' FROM q WHERE height < lowest AND hu = 'mm'"""


def _point_issues(spark, d):
    k, odd = F.col("review_id"), (F.col("review_id") + F.col("seq")) % 7
    rows = view(spark, d, "v_point").select(
        "review_id", "seq", F.when(F.col("seq") == 6, -F.col("height")).otherwise(F.col("height")).alias("height"), F.when(odd == 0, -F.col("force")).otherwise(F.col("force")).alias("force"),
        F.when(odd == 1, "inch?").otherwise(F.col("height_unit")).alias("height_unit"), F.when(odd == 2, "stone").otherwise(F.col("force_unit")).alias("force_unit"), "free_length", F.when(k % 3 > 0, 51.0 + k % 10).alias("least_free_length"),
    )
    return rules.issues(rows, ["review_id", "seq"], rules.point_checks(prep.to_base(F.col("height"), F.col("height_unit"), "length"), prep.to_base(F.col("force"), F.col("force_unit"), "force")))


@query("rule_point_issues", f"WITH {POINT_ROWS} {POINT}")
def rule_point_issues(spark, d):
    return _point_issues(spark, d)


@query("rule_pairwise_points", """WITH p AS (SELECT a.review_id, a.seq, b.seq AS other_seq, CASE WHEN abs(a.height - b.height) < 1e-9 AND abs(a.force - b.force) > 1e-9 THEN 'same_height' WHEN (a.height - b.height) * (a.force - b.force) > 0 THEN 'same_direction' END AS rule_id
  FROM v_point a JOIN v_point b ON a.review_id = b.review_id AND a.seq < b.seq AND a.test_type = b.test_type AND a.force_unit = b.force_unit) SELECT * FROM p WHERE rule_id IS NOT NULL""")
def rule_pairwise_points(spark, d):
    return rules.pairwise_points(view(spark, d, "v_point"))


@query("rule_issue_dedupe", f"WITH {POINT_ROWS}, i AS ({POINT}) SELECT review_id, min(seq) AS seq, rule_id, any_value(severity) AS severity FROM i GROUP BY review_id, rule_id")
def rule_issue_dedupe(spark, d):
    return rules.first_of(_point_issues(spark, d), ["review_id", "rule_id"], ["seq"])


@query("rule_std_diagnostics", "SELECT review_id, CASE WHEN end_mode IS NULL THEN 'need_context' ELSE 'not_applicable' END AS rule_id, CASE WHEN end_mode IS NULL THEN 'warning' ELSE 'info' END AS severity FROM v_param WHERE end_mode IS NULL OR wire_diameter >= 4")
def rule_std_diagnostics(spark, d):
    p = view(spark, d, "v_param")
    return rules.issues(p, ["review_id"], [("need_context", "warning", F.col("end_mode").isNull()), ("not_applicable", "info", F.col("end_mode").isNotNull() & (F.col("wire_diameter") >= 4))])


VARIANT = """v AS (SELECT l_orderkey AS parent_id, l_linenumber AS variant, CASE WHEN l_suppkey % 9 = 0 THEN 0 WHEN l_suppkey % 9 = 1 THEN NULL ELSE l_linenumber END AS page, l_partkey % 7 AS w, l_suppkey % 6 AS m, l_partkey % 11 = 0 AS r FROM lineitem),
  s AS (SELECT o_orderkey AS parent_id, 1 + o_orderkey % 7 AS declared, CASE WHEN o_orderkey % 5 > 0 THEN 4 END AS pages FROM orders), n AS (SELECT parent_id, count(*) AS n FROM v GROUP BY 1), j AS (SELECT v.*, pages FROM v JOIN s USING (parent_id))"""


@query("rule_variant_validation", f"""WITH {VARIANT} SELECT parent_id, NULL::BIGINT AS variant, 'count' AS issue FROM s LEFT JOIN n USING (parent_id) WHERE coalesce(n, 0) NOT BETWEEN 2 AND 50 OR coalesce(n, 0) <> declared
  UNION ALL SELECT parent_id, variant, 'page' FROM j WHERE page IS NULL OR page < 1 OR page > pages UNION ALL SELECT parent_id, variant, 'missing:wire_diameter' FROM j WHERE w = 0 UNION ALL SELECT parent_id, variant, 'missing:active_coils' FROM j WHERE w = 1
  UNION ALL SELECT parent_id, variant, 'missing:diameter' FROM j WHERE m < 2 UNION ALL SELECT parent_id, variant, 'region' FROM j WHERE r""")
def rule_variant_validation(spark, d):
    k = F.col("o_orderkey")
    parents = table(spark, d, "orders").select(k.alias("parent_id"), (1 + k % 7).alias("declared"), F.when(k % 5 > 0, 4).alias("page_count"))
    w, m, none = F.col("l_partkey") % 7, F.col("l_suppkey") % 6, F.lit(None).cast("double")
    children = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("variant"), F.when(F.col("l_suppkey") % 9 == 0, 0).when(F.col("l_suppkey") % 9 == 1, F.lit(None)).otherwise(F.col("l_linenumber")).alias("page"),
        F.when(w != 0, 2.0).alias("wire_diameter"), F.lit(40.0).alias("free_length"), F.lit(9.0).alias("total_coils"), F.when(w != 1, 7.0).alias("active_coils"),
        F.when(m == 0, 0.0).when(m == 2, 12.0).alias("inner_diameter"), F.when(m == 3, 16.0).alias("outer_diameter"), F.when(m > 3, 14.0).alias("mean_diameter"), F.when(F.col("l_partkey") % 11 != 0, "box").alias("region"),
    )
    return rules.variant_validation(parents, children)


@query("rule_constraint_check", "WITH b AS (SELECT review_id, field, max(value) AS value FROM v_cand GROUP BY 1, 2), k AS (SELECT * FROM (VALUES ('wire_diameter', 'max', 30.0::DOUBLE), ('outer_diameter', 'min', 25.0::DOUBLE), ('free_length', 'equal', 40.0::DOUBLE)) AS k(field, operator, lim)) SELECT review_id, field, operator, CASE operator WHEN 'equal' THEN abs(value - lim) <= 0.02 WHEN 'min' THEN value >= lim OR abs(value - lim) <= 0.02 ELSE value <= lim OR abs(value - lim) <= 0.02 END AS satisfied FROM b JOIN k USING (field)")
def rule_constraint_check(spark, d):
    values = view(spark, d, "v_cand").groupBy("review_id", "field").agg(F.max("value").alias("value"))
    limits = spark.createDataFrame([("wire_diameter", "max", 30.0), ("outer_diameter", "min", 25.0), ("free_length", "equal", 40.0)], "field string, operator string, limit double")
    return rules.constraint_check(values, limits)
