"""Queries of sections 2.11 to 2.13: change sets, releases, history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factforge.operators import fuse, history, impact, prep, release, rules
from factforge.plans.base import query, table, view
from factforge.plans.checking import GEOM, GEOM_CHECKS, geometry_rows

ORDER = "ts, event_id"
EV = ["ts", "event_id"]


@query("hist_latest_n", "SELECT job_id, owner_id, status, n FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, job_id DESC) AS n FROM v_review) r WHERE n <= 20")
def hist_latest_n(spark, d):
    return history.newest(view(spark, d, "v_review"), 20, [F.desc("updated_at"), F.desc("job_id")], "owner_id", 100).select("job_id", "owner_id", "status", "n")


@query("hist_events_n", "SELECT event_id, job_id, status, n FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n FROM v_event) e WHERE n <= 50 AND job_id IN (SELECT c_custkey FROM customer)")
def hist_events_n(spark, d):
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("job_id"))
    return history.newest(view(spark, d, "v_event").join(owners, "job_id"), 50, [F.desc("ts"), F.desc("event_id")], "job_id").select("event_id", "job_id", "status", "n")


@query("hist_sequence", f"SELECT event_id, job_id, row_number() OVER w AS sequence, row_number() OVER w - 1 AS revision_before, row_number() OVER w AS revision_after FROM v_event WINDOW w AS (PARTITION BY job_id ORDER BY {ORDER})")
def hist_sequence(spark, d):
    return history.sequenced(view(spark, d, "v_event"), "job_id", EV).select("event_id", "job_id", "sequence", "revision_before", "revision_after")


@query("hist_latest_decision", "SELECT job_id, arg_max(status, (ts, event_id)) AS decision FROM v_event WHERE status IN ('completed', 'failed') GROUP BY 1")
def hist_latest_decision(spark, d):
    return view(spark, d, "v_event").where("status in ('completed', 'failed')").groupBy("job_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("decision"))


@query("hist_reviews_with_jobs", "WITH r AS (SELECT owner_id, count(*) AS n, max(updated_at) AS u FROM v_review GROUP BY 1), j AS (SELECT job_id AS owner_id, count(*) AS n, max(ts) AS t FROM v_event GROUP BY 1) SELECT coalesce(r.owner_id, j.owner_id) AS owner_id, coalesce(r.n, 0) AS n_reviews, coalesce(j.n, 0) AS n_jobs, CAST(coalesce(u, t) AS VARCHAR)[:19] AS updated_at FROM r FULL JOIN j ON r.owner_id = j.owner_id")
def hist_reviews_with_jobs(spark, d):
    r = view(spark, d, "v_review").groupBy("owner_id").agg(F.count("*").alias("n_reviews"), F.max("updated_at").alias("updated_at"))
    j = view(spark, d, "v_event").groupBy(F.col("job_id").alias("owner_id")).agg(F.count("*").alias("n_jobs"), F.max("ts").alias("job_at"))
    return history.with_jobs(r, j).withColumn("updated_at", F.substring(F.col("updated_at").cast("string"), 1, 19))


CHILD = "c AS (SELECT l_orderkey AS parent_id, CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'running' ELSE 'completed' END AS state, l_quantity AS progress, l_linenumber AS updated FROM lineitem)"


def _children(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.when(F.col("l_returnflag") == "A", "failed").when(F.col("l_returnflag") == "R", "running").otherwise("completed").alias("state"), F.col("l_quantity").alias("progress"), F.col("l_linenumber").alias("updated"))


@query("hist_family_rollup", f"WITH {CHILD} SELECT parent_id, count(*) AS n, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'failed') AS failed, round(avg(progress), 6) AS progress, max(updated) AS updated, CASE WHEN bool_or(state = 'running') THEN 'running' WHEN bool_or(state = 'failed') THEN 'failed' ELSE 'completed' END AS state FROM c GROUP BY 1")
def hist_family_rollup(spark, d):
    return history.family_rollup(_children(spark, d), "parent_id")


@query("hist_variant_status", "WITH m AS (SELECT o_orderkey AS parent_id, unnest([1, 2, 3]) AS variant FROM orders), c AS (SELECT DISTINCT l_orderkey AS parent_id, l_linenumber AS variant FROM lineitem) SELECT m.parent_id, m.variant, CASE WHEN c.parent_id IS NOT NULL THEN 'created' WHEN (m.parent_id + m.variant) % 4 = 0 THEN 'deleted' ELSE 'not_created' END AS state FROM m LEFT JOIN c USING (parent_id, variant)")
def hist_variant_status(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("parent_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("variant"))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id"), F.col("l_linenumber").alias("variant")).distinct()
    return history.variant_status(m, c, m.where("(parent_id + variant) % 4 = 0"), ["parent_id", "variant"])


@query("hist_queue_position", "WITH q AS (SELECT *, rank() OVER (ORDER BY ts) AS position FROM v_event WHERE status = 'queued') SELECT event_id AS job_id, position FROM q")
def hist_queue_position(spark, d):
    return history.queue_position(view(spark, d, "v_event").drop("job_id").withColumnRenamed("event_id", "job_id"), "ts")


@query("hist_expired_leases", "SELECT job_id, event_id, CASE WHEN value > 50 THEN 'cancelled' ELSE 'requeue' END AS action FROM v_job WHERE status IN ('generating_2d', 'generating_3d') AND ts < (SELECT max(ts) FROM v_event) - INTERVAL 900 SECOND")
def hist_expired_leases(spark, d):
    now = view(spark, d, "v_event").agg(F.max("ts").alias("now"))
    j = view(spark, d, "v_job").where("status in ('generating_2d', 'generating_3d')").join(F.broadcast(now)).where("ts < now - interval 900 seconds")  # one row
    return j.select("job_id", "event_id", F.when(F.col("value") > 50, "cancelled").otherwise("requeue").alias("action"))


@query("hist_job_list", "SELECT event_id, job_id, status FROM v_event WHERE coalesce(CAST(json_extract_string(props, '$.k') AS INT) <> 7, true)")
def hist_job_list(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return view(spark, d, "v_event").where(F.coalesce(k != 7, F.lit(True))).select("event_id", "job_id", "status")


@query("hist_generation_lists", "SELECT job_id, event_id, status, n FROM (SELECT *, row_number() OVER (PARTITION BY job_id, status ORDER BY ts DESC, event_id DESC) AS n FROM v_event) e WHERE n <= 5")
def hist_generation_lists(spark, d):
    e = view(spark, d, "v_event")
    return e.withColumn("n", F.row_number().over(Window.partitionBy("job_id", "status").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long")).where("n <= 5").select("job_id", "event_id", "status", "n")


@query("hist_transition_audit", f"WITH s AS (SELECT event_id, job_id, lag(status) OVER (PARTITION BY job_id ORDER BY {ORDER}) AS before, status FROM v_event), a AS (SELECT * FROM (VALUES ('queued', 'generating_3d'), ('generating_3d', 'generating_2d'), ('generating_2d', 'completed'), ('generating_3d', 'failed'), ('generating_2d', 'failed'), ('failed', 'queued')) AS a(b, s)) SELECT event_id, job_id, before, status FROM s WHERE before <> status AND NOT EXISTS (SELECT 1 FROM a WHERE a.b = s.before AND a.s = s.status)")
def hist_transition_audit(spark, d):
    pairs = [("queued", "generating_3d"), ("generating_3d", "generating_2d"), ("generating_2d", "completed"), ("generating_3d", "failed"), ("generating_2d", "failed"), ("failed", "queued")]
    return history.transition_audit(view(spark, d, "v_event"), spark.createDataFrame(pairs, "before string, status string"), "job_id", EV).select("event_id", "job_id", "before", "status")


@query("hist_final_unique", "SELECT job_id, count(*) FILTER (status = 'completed' AND value > 20) AS n_final FROM v_event GROUP BY 1 HAVING count(*) FILTER (status = 'completed' AND value > 20) > 1")
def hist_final_unique(spark, d):
    return history.final_unique(view(spark, d, "v_event").withColumn("final", (F.col("status") == "completed") & (F.col("value") > 20)), "job_id")


@query("hist_artifact_check", "SELECT job_id, status, count(*) AS n, CASE WHEN count(DISTINCT sha256(props)) > 1 THEN 'conflict' ELSE 'replay' END AS state FROM v_event GROUP BY 1, 2 HAVING count(*) > 1")
def hist_artifact_check(spark, d):
    return history.artifact_check(view(spark, d, "v_event").withColumn("digest", F.sha2("props", 256)), ["job_id", "status"])


@query("hist_cascade_orphans", "SELECT l_orderkey AS parent_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 > 0) GROUP BY 1")
def hist_cascade_orphans(spark, d):
    parents = table(spark, d, "orders").where("o_orderkey % 9 > 0").select(F.col("o_orderkey").alias("parent_id"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_id")).join(parents, "parent_id", "left_anti").groupBy("parent_id").agg(F.count("*").alias("n"))


WRITES = f"w AS (SELECT event_id, job_id, ts, row_number() OVER (PARTITION BY job_id ORDER BY {ORDER}) AS revision, row_number() OVER (PARTITION BY job_id ORDER BY {ORDER}) - 1 - (event_id % 10 = 0)::INT AS expected FROM v_event)"


@query("hist_revision_conflicts", f"WITH {WRITES}, c AS (SELECT *, coalesce(lag(revision) OVER (PARTITION BY job_id ORDER BY {ORDER}), 0) AS current FROM w) SELECT event_id, job_id, expected::BIGINT AS expected, current FROM c WHERE expected <> current")
def hist_revision_conflicts(spark, d):
    w = history.sequenced(view(spark, d, "v_event"), "job_id", EV).withColumn("revision", F.col("sequence")).withColumn("expected", F.col("sequence") - 1 - (F.col("event_id") % 10 == 0).cast("long"))
    return history.revision_conflicts(w, "job_id", EV).select("event_id", "job_id", "expected", "current")


def _snap(spark, d, column):
    return view(spark, d, "v_snap").select("id", F.col(column).alias("value"))


@query("diff_fields", "SELECT id, before_value, after_value, CASE WHEN after_value IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM v_snap WHERE before_value IS DISTINCT FROM after_value")
def diff_fields(spark, d):
    return history.changed(_snap(spark, d, "before_value"), _snap(spark, d, "after_value"), "id")


@query("diff_issues", "SELECT id, CASE WHEN before_value < 150000 AND coalesce(after_value, 0) < 150000 THEN 'unchanged' WHEN before_value < 150000 THEN 'resolved' ELSE 'introduced' END AS change FROM v_snap WHERE before_value < 150000 OR coalesce(after_value, 0) < 150000")
def diff_issues(spark, d):
    s = view(spark, d, "v_snap")
    return history.issue_diff(s.where("before_value < 150000"), s.where("coalesce(after_value, 0) < 150000"), ["id"])


TYPE = "CASE WHEN review_id % 3 = 2 THEN 'torsion_spring' ELSE 'compression_spring' END"
PATCHED = ("wire_diameter", "d"), ("outer_diameter", "o"), ("inner_diameter", "i"), ("mean_diameter", "m"), ("free_length", "f"), ("total_coils", "t"), ("active_coils", "a"), ("support_coils", "s"), ("solid_height", "h"), ("wire_upper", "u")
DERIVED = ("mean_diameter", "mm"), ("outer_diameter", "mm + d"), ("inner_diameter", "mm - d"), ("spring_index", "mm / nullif(d, 0)"), ("slenderness_ratio", "f / nullif(mm, 0)"), ("solid_height", "lowest")


def _all_issues(frame):
    """All rules on all rows of a frame."""
    own = " UNION ALL ".join(f"SELECT review_id, NULL::BIGINT AS seq, '{r}' AS name, '{s}' AS severity FROM {frame} WHERE {c}" for r, s, c in GEOM_CHECKS)
    return own + "".join(f" UNION ALL SELECT k.review_id, p.seq, 'SPRING-LOAD-HEIGHT-{r}', 'blocked' FROM {frame} k JOIN v_point p ON p.review_id = k.review_id WHERE {c}" for r, c in (("OVER-FREE", "p.height > k.f"), ("UNDER-SOLID", "p.height < k.lowest"), ("POSITIVE", "p.height <= 0")))


LOWEST = "coalesce(h, CASE e WHEN 'ground' THEN t * (d + greatest(0.0, coalesce(u, 0))) WHEN 'not_ground' THEN (t + 1.5::DOUBLE) * (d + greatest(0.0, coalesce(u, 0))) END) AS lowest"
SIMULATED = f"""{GEOM},
  lp AS (SELECT review_id, {", ".join(f"arg_max(number, seq) FILTER (field = '{f}' AND number IS NOT NULL) AS {c}1" for f, c in PATCHED)}, max(word) FILTER (field = 'end_mode' AND word <> '') AS e1 FROM v_patch GROUP BY 1),
  ok AS (SELECT * FROM lp WHERE coalesce({", ".join(f"{c}1" for _, c in PATCHED)}) IS NOT NULL OR e1 IS NOT NULL),
  x AS (SELECT review_id, {", ".join(f"coalesce({c}1, {c}) AS {c}" for _, c in PATCHED)}, coalesce(e1, e) AS e, p, cold, o1, i1, m1, {TYPE} = 'compression_spring' AND (d1 IS NULL) AND (o1 IS NOT NULL)::INT + (i1 IS NOT NULL)::INT + (m1 IS NOT NULL)::INT = 1 AS alone FROM g JOIN ok USING (review_id)),
  y AS (SELECT *, CASE WHEN alone THEN CASE WHEN o1 IS NOT NULL THEN o1 - d WHEN i1 IS NOT NULL THEN i1 + d ELSE m1 END END AS lm FROM x),
  z AS (SELECT *, coalesce(alone AND d > 0 AND round(lm, 4) > 0 AND round(lm - d, 4) > 0 AND round(lm + d, 4) > 0, false) AS linked FROM y),
  w AS (SELECT review_id, d, CASE WHEN linked AND o1 IS NULL THEN round(lm + d, 4) ELSE o END AS o, CASE WHEN linked AND i1 IS NULL THEN round(lm - d, 4) ELSE i END AS i, CASE WHEN linked AND m1 IS NULL THEN round(lm, 4) ELSE m END AS m, f, t, a, s, h, u, e, p, cold FROM z),
  kb AS (SELECT * FROM k WHERE review_id IN (SELECT review_id FROM ok)), ka AS (SELECT *, coalesce(m, o - d, i + d) AS mm, {LOWEST} FROM w),
  ib AS ({_all_issues("kb")}), ia AS ({_all_issues("ka")}),
  iss AS (SELECT review_id, CASE WHEN b.x IS NULL THEN 'introduced' WHEN a.x IS NULL THEN 'resolved' ELSE 'unchanged' END AS kind, name, nullif(seq, -1) AS seq, severity
    FROM (SELECT review_id, name, coalesce(seq, -1) AS seq, severity, 1 AS x FROM ib) b(review_id, name, seq, severity, x) FULL JOIN (SELECT review_id, name, coalesce(seq, -1) AS seq, severity, 1 AS x FROM ia) a(review_id, name, seq, severity, x) USING (review_id, name, seq, severity)),
  dir AS ({" UNION ALL ".join(f"SELECT review_id, 'direct' AS kind, '{f}' AS name, kb.{c} AS before, ka.{c} AS after, NULL AS before_word, NULL AS after_word FROM kb JOIN ka USING (review_id) WHERE kb.{c} IS DISTINCT FROM ka.{c}" for f, c in PATCHED)}
    UNION ALL SELECT review_id, 'direct', 'end_mode', NULL, NULL, kb.e, ka.e FROM kb JOIN ka USING (review_id) WHERE kb.e IS DISTINCT FROM ka.e),
  vb AS ({" UNION ALL ".join(f"SELECT review_id, '{n}' AS name, round({x}, 9) AS v FROM kb" for n, x in DERIVED)}), va AS ({" UNION ALL ".join(f"SELECT review_id, '{n}' AS name, round({x}, 9) AS v FROM ka" for n, x in DERIVED)}),
  new AS (SELECT review_id, bool_or(severity = 'blocked') AS stops FROM iss WHERE kind = 'introduced' GROUP BY 1)"""


@query("diff_simulate", f"""WITH {SIMULATED} SELECT review_id, kind, name, NULL::BIGINT AS seq, NULL::VARCHAR AS severity, before, after, before_word, after_word FROM dir
  UNION ALL SELECT review_id, 'derived', name, NULL, NULL, vb.v, va.v, NULL, NULL FROM vb JOIN va USING (review_id, name) WHERE vb.v IS DISTINCT FROM va.v
  UNION ALL SELECT review_id, kind, name, seq, severity, NULL, NULL, NULL, NULL FROM iss
  UNION ALL SELECT review_id, 'status', CASE WHEN ok.review_id IS NULL THEN 'not_applicable' WHEN stops THEN 'blocked' WHEN stops IS NOT NULL THEN 'warning' ELSE 'ready' END, NULL, NULL, NULL, NULL, NULL, NULL FROM lp LEFT JOIN ok USING (review_id) LEFT JOIN new USING (review_id)""")
def diff_simulate(spark, d):
    reviews = geometry_rows(spark, d).withColumn("spring_type", F.expr(TYPE))
    points, height = view(spark, d, "v_point").select("review_id", "seq", "height", "force"), F.col("height")
    own = rules.issues(reviews, ["review_id"], rules.geometry_checks(F.col("cold"))).withColumn("seq", F.lit(None).cast("long"))
    bounds = reviews.select("review_id", "free_length", rules.least_free_length().alias("least_free_length"))
    stored = own.unionByName(rules.issues(points.join(impact.merged(bounds), "review_id"), ["review_id", "seq"], rules.point_checks(height, F.lit(0.0))))
    return impact.simulate(reviews, view(spark, d, "v_patch"), points, stored, F.col("cold"), height)


@query("diff_package_fields", "SELECT CASE WHEN after_value IS NULL THEN 'removed' ELSE 'changed' END AS kind, count(*) AS n FROM v_snap WHERE before_value IS DISTINCT FROM after_value GROUP BY 1")
def diff_package_fields(spark, d):
    return diff_fields(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


BATCH = "b AS (SELECT review_id, seq, field, value AS suggested, CASE WHEN seq % 3 = 0 THEN value ELSE value + 1 END AS current, count(*) OVER (PARTITION BY review_id, field) AS n FROM v_cand WHERE confidence > 0.7)"


def _batch(spark, d):
    return view(spark, d, "v_cand").where("confidence > 0.7").select("review_id", "seq", "field", F.col("value").alias("suggested"), F.when(F.col("seq") % 3 == 0, F.col("value")).otherwise(F.col("value") + 1).alias("current"))


@query("chg_batch", f"WITH {BATCH} SELECT review_id, seq, field, CASE WHEN n > 1 THEN 'conflict' WHEN suggested IS NULL THEN 'no_value' WHEN abs(suggested - current) <= 1e-9 THEN 'no_effect' ELSE 'apply' END AS reason FROM b")
def chg_batch(spark, d):
    return history.batch_changes(_batch(spark, d), ["review_id", "field"]).select("review_id", "seq", "field", "reason")


@query("chg_suggestions", "SELECT review_id, 'outer_diameter' AS target, 'formula' AS source, round(outer_diameter + 0.1, 6) AS suggested FROM v_param WHERE review_id % 2 = 0 UNION ALL SELECT review_id, 'grade', 'standard', 2.0::DOUBLE FROM v_param WHERE grade <> 2")
def chg_suggestions(spark, d):
    p = view(spark, d, "v_param")
    a = p.where("review_id % 2 = 0").select("review_id", F.lit("outer_diameter").alias("target"), F.lit("formula").alias("source"), F.round(F.col("outer_diameter") + 0.1, 6).alias("suggested"), F.col("outer_diameter").alias("current"))
    b = p.select("review_id", F.lit("grade").alias("target"), F.lit("standard").alias("source"), F.lit(2.0).alias("suggested"), F.col("grade").cast("double").alias("current"))
    return a.unionByName(b).where(F.abs(F.col("suggested") - F.col("current")) > 1e-9).drop("current")


@query("chg_formula_candidates", "SELECT review_id, round(outer_diameter - wire_diameter, 6) AS result, CASE WHEN review_id % 3 > 0 THEN 'keep' WHEN review_id % 2 = 0 THEN 'candidate' ELSE 'overwrite' END AS action FROM v_param")
def chg_formula_candidates(spark, d):
    p = view(spark, d, "v_param").withColumn("recorded", F.when(F.col("review_id") % 3 == 0, F.col("wire_diameter") + 1).otherwise(F.col("wire_diameter"))).withColumn("human", F.col("review_id") % 2 == 0)
    action = F.when(F.col("recorded").eqNullSafe(F.col("wire_diameter")), "keep").when(F.col("human"), "candidate").otherwise("overwrite")
    return p.select("review_id", F.round(F.col("outer_diameter") - F.col("wire_diameter"), 6).alias("result"), action.alias("action"))


@query("chg_suggestion_dedupe", "SELECT review_id, field, value, min(seq) AS first, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(CASE WHEN confidence > 0.7 THEN 1 ELSE 0 END) AS available, count(*) AS n FROM v_cand GROUP BY 1, 2, 3")
def chg_suggestion_dedupe(spark, d):
    return history.suggestion_dedupe(view(spark, d, "v_cand").withColumn("available", (F.col("confidence") > 0.7).cast("int")), ["review_id", "field", "value"], "seq")


@query("chg_conflicts", "SELECT review_id, field, count(*) AS n FROM v_cand WHERE confidence > 0.7 GROUP BY 1, 2 HAVING count(*) > 1")
def chg_conflicts(spark, d):
    n = F.count("*").over(Window.partitionBy("review_id", "field"))
    return view(spark, d, "v_cand").where("confidence > 0.7").withColumn("n", n).where("n > 1").select("review_id", "field", "n").distinct()


CANON = """CONCAT('.features.ends="closed"', chr(10), '.features.n=', c, chr(10), '.points[000000000].force=', {f}, chr(10), '.points[000000000].label="F1"', chr(10), '.points[000000001].label="F2"', chr(10), '.points[000000001].tags=[]', chr(10), '.type="c"')"""
STATES = f"WITH o AS (SELECT o_orderkey AS id, o_custkey AS c FROM orders), t AS (SELECT id, {CANON.format(f='c % 50')} AS was, {CANON.format(f='c % 50 + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END')} AS now FROM o)"


@query("chg_fingerprint", f"""{STATES} SELECT id, sha256(was) AS state_hash, 'fnv1a32:' || lower(lpad(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(was, ''), lambda ch: ascii(ch)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)), 8, '0')) AS token FROM t""")
def chg_fingerprint(spark, d):
    return history.canonical_hashes(view(spark, d, "v_state"), ["id"], "before_doc")


@query("chg_stale_open", f"{STATES} SELECT id, id % 3 = 0 AS open, id % 3 = 0 AND was <> now AS stale FROM t")
def chg_stale_open(spark, d):
    """An open proposal is stale if the state that it was made from has another fingerprint now."""
    v = view(spark, d, "v_state")
    both = v.select("id", F.lit("was").alias("at"), F.col("before_doc").alias("doc")).unionByName(v.select("id", F.lit("now"), "after_doc").toDF("id", "at", "doc"))
    found = history.canonical_hashes(both, ["id", "at"], "doc").groupBy("id").agg((F.countDistinct("state_hash") > 1).alias("changed"))
    return found.select("id", (F.col("id") % 3 == 0).alias("open"), ((F.col("id") % 3 == 0) & F.col("changed")).alias("stale"))


@query("chg_actions_last_wins", "SELECT job_id, event_id % 3 AS target, arg_max(status, event_id) AS action, min(event_id) AS first_at FROM v_event GROUP BY 1, 2")
def chg_actions_last_wins(spark, d):
    e = view(spark, d, "v_event").select("job_id", (F.col("event_id") % 3).alias("target"), F.col("status").alias("action"), "event_id")
    return history.last_wins(e, ["job_id", "target"], "event_id")


@query("chg_recover_missing", "WITH del AS (SELECT job_id, arg_max(status, (ts, event_id)) AS s FROM v_event GROUP BY 1) SELECT DISTINCT v.doc_id, v.line_no FROM v_note v LEFT JOIN del ON del.job_id = v.doc_id WHERE coalesce(s, '') <> 'failed' AND NOT EXISTS (SELECT 1 FROM v_note w WHERE w.doc_id = v.doc_id AND w.line_no = v.line_no AND w.l_partkey % 2 = 0)")
def chg_recover_missing(spark, d):
    n = view(spark, d, "v_note").select("doc_id", "line_no", "l_partkey")
    current = n.where("l_partkey % 2 = 0").select("doc_id", "line_no").distinct()
    deleted = view(spark, d, "v_event").groupBy(F.col("job_id").alias("doc_id")).agg(F.max_by("status", F.struct("ts", "event_id")).alias("s")).where("s = 'failed'").select("doc_id")
    return n.select("doc_id", "line_no").distinct().join(current, ["doc_id", "line_no"], "left_anti").join(deleted, "doc_id", "left_anti")


@query("chg_recover_translation", "WITH s AS (SELECT doc_id, line_no, count(DISTINCT l_partkey) FILTER (l_suppkey % 3 > 0) AS n, min(l_partkey) FILTER (l_suppkey % 3 > 0) AS evidence FROM v_note GROUP BY 1, 2) SELECT doc_id, line_no, CASE WHEN n = 1 THEN evidence END AS evidence, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM s")
def chg_recover_translation(spark, d):
    translated = F.when(F.col("l_suppkey") % 3 > 0, F.col("l_partkey"))
    g = view(spark, d, "v_note").groupBy("doc_id", "line_no").agg(F.countDistinct(translated).alias("n"), F.min(translated).alias("evidence"))
    return g.select("doc_id", "line_no", F.when(F.col("n") == 1, F.col("evidence")).alias("evidence"), F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("status"))


@query("chg_reconcile_points", """WITH o AS (SELECT review_id, label, min(height) AS h, review_id % 2 = 0 AS human, review_id % 13 = 0 AS deleted FROM v_point WHERE seq % 4 > 0 GROUP BY 1, 2), n AS (SELECT review_id, label, max(height) AS h FROM v_point WHERE seq % 5 > 0 GROUP BY 1, 2),
  b AS (SELECT coalesce(o.review_id, n.review_id) AS review_id, coalesce(o.label, n.label) AS label, o.h AS old, n.h AS new, human, deleted FROM o FULL JOIN n ON o.review_id = n.review_id AND o.label = n.label), a AS (SELECT *, CASE WHEN deleted THEN 'skip' WHEN old IS NULL THEN 'insert' WHEN new IS NULL OR abs(old - new) <= 1e-9 THEN 'keep' WHEN human THEN 'candidate' ELSE 'update' END AS action FROM b)
  SELECT review_id, label, action, CASE WHEN action IN ('insert', 'update') THEN new ELSE old END AS height FROM a""")
def chg_reconcile_points(spark, d):
    p = view(spark, d, "v_point")
    stored = p.where("seq % 4 > 0").groupBy("review_id", "label").agg(F.min("height").alias("height")).withColumn("human", F.col("review_id") % 2 == 0).withColumn("deleted", F.col("review_id") % 13 == 0)
    return history.reconcile_points(stored, p.where("seq % 5 > 0").groupBy("review_id", "label").agg(F.max("height").alias("height")), ["review_id", "label"])


@query("chg_output_choices", "SELECT id, id % 2 = 0 AS chosen, id % 2 = 0 AND before_value IS NOT DISTINCT FROM after_value AS hidden FROM v_snap")
def chg_output_choices(spark, d):
    chosen = F.col("id") % 2 == 0
    return view(spark, d, "v_snap").select("id", chosen.alias("chosen"), (chosen & F.col("before_value").eqNullSafe(F.col("after_value"))).alias("hidden"))


@query("chg_revoke_confirmations", "SELECT id, id % 4 > 0 AS was_confirmed, id % 4 > 0 AND before_value IS NOT DISTINCT FROM after_value AS confirmed FROM v_snap")
def chg_revoke_confirmations(spark, d):
    was = view(spark, d, "v_snap").select("id", (F.col("id") % 4 > 0).alias("was_confirmed"))
    changed = diff_fields(spark, d).select("id", F.lit(True).alias("changed"))
    return was.join(changed, "id", "left").select("id", "was_confirmed", (F.col("was_confirmed") & F.col("changed").isNull()).alias("confirmed"))


@query("chg_validate_external", "SELECT review_id, seq, field, CASE WHEN field IN ('wire_diameter', 'outer_diameter') THEN 'accepted' ELSE 'unknown_target' END AS status FROM v_cand")
def chg_validate_external(spark, d):
    template = spark.createDataFrame([("wire_diameter",), ("outer_diameter",)], "field string").withColumn("known", F.lit(True))
    return view(spark, d, "v_cand").join(template, "field", "left").select("review_id", "seq", "field", F.when(F.col("known"), "accepted").otherwise("unknown_target").alias("status"))


@query("chg_apply_external", "WITH r AS (SELECT l_orderkey AS id, count(*) AS n, max(l_linenumber) AS result FROM lineitem GROUP BY 1) SELECT s.id, CASE WHEN n = 1 AND before_value IS NOT DISTINCT FROM after_value THEN result END AS applied FROM v_snap s JOIN r USING (id)")
def chg_apply_external(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"), F.max("l_linenumber").alias("result"))
    return view(spark, d, "v_snap").join(r, "id").select("id", F.when((F.col("n") == 1) & F.col("before_value").eqNullSafe(F.col("after_value")), F.col("result")).alias("applied"))


@query("chg_validate_selection", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'unchanged' WHEN lower(p_name) IN (SELECT lower(alias) FROM v_dict) THEN 'valid' ELSE 'rejected' END AS status FROM part")
def chg_validate_selection(spark, d):
    known = view(spark, d, "v_dict").select(F.lower("alias").alias("k")).distinct()
    p = table(spark, d, "part").join(known, F.lower("p_name") == F.col("k"), "left")
    return p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "unchanged").when(F.col("k").isNotNull(), "valid").otherwise("rejected").alias("status"))


READY = """f AS (SELECT review_id, field, bool_or(source = 'manual') AS confirmed, max(confidence) AS c FROM v_cand GROUP BY 1, 2), g AS (SELECT review_id, 4 - count(*) AS n_missing, count(*) FILTER (NOT confirmed) AS n_pending, count(*) FILTER (confirmed) AS n_confirmed, count(*) FILTER (c < 0.6) AS n_warnings FROM f GROUP BY 1)"""


@query("rel_readiness", f"WITH {READY} SELECT *, CASE WHEN n_missing > 0 THEN 'missing' WHEN n_pending > 0 THEN 'pending' WHEN n_warnings > 0 THEN 'warning' ELSE 'ready' END AS state FROM g")
def rel_readiness(spark, d):
    return release.readiness(view(spark, d, "v_cand"), 4)


@query("rel_defaults", "SELECT review_id, coalesce(end_mode, 'ground') AS end_mode, end_mode IS NULL AS pending FROM v_param")
def rel_defaults(spark, d):
    return release.defaults(view(spark, d, "v_param"), {"end_mode": "ground"}).select("review_id", "end_mode", F.col("end_mode_pending").alias("pending"))


CONTRACT = """p AS (SELECT review_id, CASE WHEN review_id % 11 = 3 THEN 0 - wire_diameter ELSE wire_diameter END AS w, CASE WHEN review_id % 11 = 7 THEN wire_diameter + 0.0004::DOUBLE ELSE outer_diameter - wire_diameter END AS m,
  free_length AS f, total_coils AS t, CASE review_id % 5 WHEN 0 THEN total_coils + 1 WHEN 1 THEN total_coils + 1.5::DOUBLE WHEN 2 THEN 0 ELSE total_coils - 2 END AS a, review_id % 6 = 0 AS open_mean, review_id % 10 = 0 AS open_active FROM v_param),
  s AS (SELECT review_id, w, CASE WHEN NOT open_mean THEN m END AS m, f, t, CASE WHEN NOT open_active THEN a END AS a FROM p)"""


@query("rel_contract_checks", f"""WITH {CONTRACT} SELECT review_id, 'wire_diameter' AS field, 'not_positive' AS reason FROM s WHERE NOT w > 0 UNION ALL SELECT review_id, 'mean_diameter', 'not_positive' FROM s WHERE NOT m > 0
  UNION ALL SELECT review_id, 'free_length', 'not_positive' FROM s WHERE NOT f > 0 UNION ALL SELECT review_id, 'total_coils', 'not_positive' FROM s WHERE NOT t > 0 UNION ALL SELECT review_id, 'active_coils', 'not_positive' FROM s WHERE NOT a > 0
  UNION ALL SELECT review_id, 'mean_diameter', 'not_above_wire' FROM s WHERE w > 0 AND m > 0 AND round(m, 3) <= round(w, 3)
  UNION ALL SELECT review_id, 'active_coils', 'above_total' FROM s WHERE a > 0 AND t > 0 AND a = floor(a) AND t = floor(t) AND a > t""")
def rel_contract_checks(spark, d):
    c, k = F.col, F.col("review_id")
    active = F.when(k % 5 == 0, c("total_coils") + 1).when(k % 5 == 1, c("total_coils") + 1.5).when(k % 5 == 2, 0.0).otherwise(c("total_coils") - 2)
    shown = {"wire_diameter": F.when(k % 11 == 3, 0 - c("wire_diameter")).otherwise(c("wire_diameter")), "mean_diameter": F.when(k % 11 == 7, c("wire_diameter") + 0.0004).otherwise(c("outer_diameter") - c("wire_diameter")), "free_length": c("free_length"), "total_coils": c("total_coils"), "active_coils": active}
    under = {"mean_diameter": k % 6 == 0, "active_coils": k % 10 == 0}
    wide = view(spark, d, "v_param").select("review_id", *(x.alias(f) for f, x in shown.items()), *(under.get(f, F.lit(False)).alias(f"{f}_review") for f in shown))
    return release.contract_issues(wide)


@query("rel_point_state", "SELECT review_id, seq, CASE WHEN row_number() OVER (PARTITION BY review_id, lower(label) ORDER BY seq) > 1 THEN 'duplicate' WHEN force_tol IS NULL THEN 'incomplete' ELSE 'ok' END AS state FROM v_point")
def rel_point_state(spark, d):
    return release.point_state(view(spark, d, "v_point"))


@query("rel_export_confirmed", "WITH f AS (SELECT *, row_number() OVER (PARTITION BY review_id, label ORDER BY seq) AS n FROM v_point WHERE height < free_length) SELECT review_id, label, height, round_even(force * CASE force_unit WHEN 'N' THEN 1.0::DOUBLE WHEN 'kN' THEN 1000.0 ELSE 9.80665 END, 3) AS force_n FROM f WHERE n = 1")
def rel_export_confirmed(spark, d):
    p = view(spark, d, "v_point").where("height < free_length")
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("review_id", "label").orderBy("seq"))).where("n = 1")
    return first.select("review_id", "label", "height", F.bround(prep.to_base(F.col("force"), F.col("force_unit"), "force"), 3).alias("force_n"))


@query("rel_symmetric_tolerance", "SELECT review_id, tol_upper AS tolerance FROM v_param WHERE tol_upper = 0 - tol_lower AND tol_upper >= 0")
def rel_symmetric_tolerance(spark, d):
    return view(spark, d, "v_param").where("tol_upper = 0 - tol_lower and tol_upper >= 0").select("review_id", F.col("tol_upper").alias("tolerance"))


@query("rel_model_parameters", "SELECT review_id, max(value) FILTER (field = 'wire_diameter') AS wire_diameter, max(value) FILTER (field = 'outer_diameter') AS outer_diameter, max(value) FILTER (field = 'free_length') AS free_length FROM v_cand WHERE source = 'manual' GROUP BY 1")
def rel_model_parameters(spark, d):
    return view(spark, d, "v_cand").where("source = 'manual'").groupBy("review_id").pivot("field", ["wire_diameter", "outer_diameter", "free_length"]).agg(F.max("value"))


@query("rel_note_text", r"WITH k AS (SELECT doc_id, regexp_replace(text, '^[^;]*; ', '') AS body, min(line_no) AS at_line FROM v_note GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY at_line, body) AS n FROM k) SELECT doc_id, string_agg(n || '. ' || body, chr(10) ORDER BY n) AS text FROM n GROUP BY 1")
def rel_note_text(spark, d):
    body = view(spark, d, "v_note").select("doc_id", "line_no", F.regexp_replace("text", "^[^;]*; ", "").alias("body"))
    return release.note_text(body)


TMPL = """x AS (SELECT review_id, spring_type, CASE WHEN review_id % 19 = 0 THEN 't/b' END AS requested, wire_diameter, free_length, total_coils, drawn_active, CASE WHEN review_id % 8 = 0 THEN '' ELSE end_mode END AS end_mode FROM v_coil),
  v AS (SELECT review_id, 'wire_diameter' AS field, NULL::VARCHAR AS word, wire_diameter AS number FROM x UNION ALL SELECT review_id, 'free_length', NULL, free_length FROM x UNION ALL SELECT review_id, 'total_coils', NULL, total_coils FROM x
    UNION ALL SELECT review_id, 'drawn_active', NULL, drawn_active FROM x UNION ALL SELECT review_id, 'end_mode', end_mode, NULL FROM x),
  held AS (SELECT v.review_id, c.code, c.version, count(DISTINCT (c.kind, c.field)) FILTER (c.kind <> 'required') AS n, count(DISTINCT c.field) FILTER (c.kind = 'required') AS needed FROM v JOIN v_cond c ON v.field = c.field
    AND (c.kind = 'required' AND (v.number IS NOT NULL OR v.word <> '') OR c.kind = 'in' AND (v.word = c.word OR v.number = c.number) OR c.kind = 'range' AND v.number BETWEEN c.low AND c.high) GROUP BY 1, 2, 3),
  size AS (SELECT t.code, t.version, count(DISTINCT (c.kind, c.field)) FILTER (c.kind <> 'required') AS n, count(DISTINCT c.field) FILTER (c.kind = 'required') AS needed FROM v_tmpl t LEFT JOIN v_cond c ON c.code = t.code AND c.version = t.version GROUP BY 1, 2),
  m AS (SELECT x.review_id, x.requested, t.code, t.version, t.priority * 1000 + s.n AS score FROM x JOIN v_tmpl t ON t.enabled AND t.drawing_type = x.spring_type AND coalesce(x.requested = t.code, true) JOIN size s ON s.code = t.code AND s.version = t.version
    LEFT JOIN held h ON h.review_id = x.review_id AND h.code = t.code AND h.version = t.version WHERE coalesce(h.n, 0) = s.n AND coalesce(h.needed, 0) = s.needed),
  r AS (SELECT *, max(score) OVER (PARTITION BY review_id) AS best, row_number() OVER (PARTITION BY review_id ORDER BY score DESC, code, version) AS k FROM m),
  g AS (SELECT review_id, count(*) FILTER (score = best) > 1 AND bool_and(requested IS NULL) AS tie, max(best) AS score, max(code) FILTER (k = 1) AS code, max(version) FILTER (k = 1) AS version, string_agg(code || '@' || version, ',' ORDER BY k) AS every, string_agg(code || '@' || version, ',' ORDER BY k) FILTER (score = best) AS top FROM r GROUP BY 1)"""


@query("rel_template_match", f"WITH {TMPL} SELECT x.review_id, CASE WHEN g.review_id IS NULL THEN 'template_not_found' WHEN tie THEN 'template_selection_required' ELSE 'selected' END AS status, CASE WHEN NOT tie THEN code END AS code, CASE WHEN NOT tie THEN version END AS version, score, CASE WHEN g.review_id IS NULL THEN '' WHEN tie THEN top ELSE every END AS candidates FROM x LEFT JOIN g ON g.review_id = x.review_id")
def rel_template_match(spark, d):
    x = view(spark, d, "v_coil").withColumn("end_mode", F.when(F.col("review_id") % 8 == 0, "").otherwise(F.col("end_mode")))
    numbers = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(None).cast("string").alias("word"), F.col(f).alias("number")) for f in ("wire_diameter", "free_length", "total_coils", "drawn_active")), F.struct(F.lit("end_mode").alias("field"), F.col("end_mode").alias("word"), F.lit(None).cast("double").alias("number")))
    subjects = x.select("review_id", F.col("spring_type").alias("drawing_type"), F.when(F.col("review_id") % 19 == 0, "t/b").alias("requested"))
    return release.template_match(subjects, x.select("review_id", F.inline(numbers)), view(spark, d, "v_tmpl"), view(spark, d, "v_cond"))


@query("rel_request_dedupe", "SELECT job_id, status AS request_key, min(event_id) AS first_event, count(DISTINCT sha256(props)) > 1 AS conflict FROM v_event GROUP BY 1, 2")
def rel_request_dedupe(spark, d):
    return view(spark, d, "v_event").groupBy("job_id", F.col("status").alias("request_key")).agg(F.min("event_id").alias("first_event"), (F.countDistinct(F.sha2("props", 256)) > 1).alias("conflict"))
