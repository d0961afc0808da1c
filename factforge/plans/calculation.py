"""Queries of sections 2.8 and 2.9: derived metrics, tolerances, standards, recursion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factforge.operators import calc, prep, recursive
from factforge.plans.base import SEQ, dealt, query, table, view
from factforge.sources.tables import durable

#: Coils by end condition: derived, and those of the drawing before them.
COILS = """q AS (SELECT *, CASE WHEN spring_type = 'compression_spring' THEN CASE WHEN end_type = 'closed' AND support_coils > 0 THEN total_coils - 2 * support_coils WHEN end_type = 'open' AND end_mode = 'ground' THEN total_coils - 1
    WHEN end_type = 'open' AND end_mode = 'not_ground' THEN total_coils END WHEN spring_type IN ('extension_spring', 'torsion_spring') THEN total_coils END AS d0 FROM v_coil), k AS (SELECT *, CASE WHEN d0 > 0 THEN d0 END AS derived, coalesce(drawn_active, CASE WHEN d0 > 0 THEN d0 END) AS n FROM q)"""
ACTIVE = "n"
G = "CASE WHEN contains(lower(material_raw), 'ring') THEN 78500.0::DOUBLE WHEN contains(lower(material_raw), 'gear') THEN 71000.0 WHEN contains(lower(material_raw), 'bolt') AND review_id % 2 = 0 THEN NULL ELSE 79000.0 END"
MEAN = "(outer_diameter - wire_diameter)"
RATE = f"round({G} * pow(CASE WHEN wire_diameter > 0 THEN wire_diameter END, 4) / (8 * pow(CASE WHEN {MEAN} > 0 THEN {MEAN} END, 3) * CASE WHEN {ACTIVE} > 0 THEN {ACTIVE} END), 9)"


def _diam(spark, d):
    p = view(spark, d, "v_param")
    k = F.col("review_id") % 3
    return p.select("review_id", "wire_diameter", F.when(k == 0, F.col("outer_diameter")).alias("outer_diameter"), F.when(k == 1, F.col("outer_diameter") - 2 * F.col("wire_diameter")).alias("inner_diameter"), F.when(k == 2, F.col("outer_diameter") - F.col("wire_diameter")).alias("mean_diameter"))


@query("calc_diameters", "SELECT review_id, round(outer_diameter, 6) AS outer_diameter, round(outer_diameter - 2 * wire_diameter, 6) AS inner_diameter, round(outer_diameter - wire_diameter, 6) AS mean_diameter FROM v_param")
def calc_diameters(spark, d):
    return calc.diameters(_diam(spark, d)).select("review_id", *(F.round(c, 6).alias(c) for c in ("outer_diameter", "inner_diameter", "mean_diameter")))


@query("calc_diameter_link", "SELECT review_id, CASE review_id % 3 WHEN 0 THEN 'outer' WHEN 1 THEN 'inner' ELSE 'mean' END AS driver, round(outer_diameter, 6) AS outer_diameter, round(outer_diameter - wire_diameter, 6) AS mean_diameter, round(outer_diameter - 2 * wire_diameter, 6) AS inner_diameter, outer_diameter - 2 * wire_diameter <= 0 AS stale FROM v_param")
def calc_diameter_link(spark, d):
    k = F.col("review_id") % 3
    out = calc.diameter_link(_diam(spark, d), F.when(k == 0, "outer").when(k == 1, "inner").otherwise("mean"))
    return out.select("review_id", "driver", *(F.round(c, 6).alias(c) for c in ("outer_diameter", "mean_diameter", "inner_diameter")), "stale")


@query("calc_derived", f"SELECT review_id, {MEAN} AS mean_diameter, round({MEAN} / wire_diameter, 9) AS spring_index, round(free_length / {MEAN}, 9) AS slenderness FROM v_param")
def calc_derived(spark, d):
    return calc.derived(view(spark, d, "v_param"))


@query("calc_active_coils", f"WITH {COILS} SELECT review_id, derived, n AS active_coils FROM k")
def calc_active_coils(spark, d):
    return view(spark, d, "v_coil").select("review_id", calc.derived_active().alias("derived"), calc.active_coils().alias("active_coils"))


@query("calc_support_coils", """WITH r AS (SELECT *, CASE WHEN uneven THEN 'asymmetric' WHEN end_type IS NULL OR end_type <> 'closed' THEN 'end_type' WHEN drawn_active IS NULL THEN 'not_independent' WHEN drawn_active >= total_coils THEN 'not_positive' ELSE '' END AS reason FROM v_coil)
  SELECT review_id, CASE WHEN reason = '' THEN (total_coils - drawn_active) / 2 END AS support_coils, reason FROM r""")
def calc_support_coils(spark, d):
    return calc.support_coils(view(spark, d, "v_coil"))


def _materials(p):
    """The stand-in's words as materials of the library's table."""
    raw = F.lower("material_raw")
    return p.withColumn("material", F.when(raw.contains("ring"), "Inconel 718").when(raw.contains("gear"), " sus304").when(raw.contains("bolt") & (F.col("review_id") % 2 == 0), "brass").otherwise("Inconel X-750"))


@query("calc_stiffness", f"WITH {COILS} SELECT review_id, {RATE} AS rate, CASE WHEN {ACTIVE} > 0 AND {MEAN} > 0 AND wire_diameter > 0 THEN CASE WHEN {G} IS NULL THEN 'material_not_configured' ELSE 'calculated' END ELSE 'missing_context' END AS status FROM k")
def calc_stiffness(spark, d):
    return _materials(view(spark, d, "v_coil")).select("review_id", calc.stiffness().alias("rate"), calc.stiffness_status().alias("status"))


@query("calc_stale_stiffness", f"WITH {COILS}, o AS (SELECT p.review_id AS id, max(8 * p.force / nullif(p.free_length - p.height, 0)) AS recorded FROM v_point p GROUP BY 1) SELECT review_id, recorded, {RATE} AS rate, CASE WHEN recorded IS NULL THEN 'absent' WHEN {RATE} IS NULL THEN 'inputs_missing' WHEN abs(recorded - {RATE}) > 1e-6 * greatest(abs(recorded), abs({RATE})) THEN 'stale' ELSE 'current' END AS state FROM k LEFT JOIN o ON o.id = k.review_id")
def calc_stale_stiffness(spark, d):
    recorded = view(spark, d, "v_point").groupBy("review_id").agg(F.max(8 * F.col("force") / F.nullif(F.col("free_length") - F.col("height"), F.lit(0.0))).alias("recorded"))
    return calc.stale_rate(calc_stiffness(spark, d), recorded)


@query("calc_reconcile_formula", """WITH o AS (SELECT id, before_value AS v, id % 2 = 0 AS h FROM v_snap WHERE id % 11 > 0), n AS (SELECT id, after_value AS v FROM v_snap WHERE after_value IS NOT NULL),
  b AS (SELECT coalesce(o.id, n.id) AS id, o.v AS ov, n.v AS nv, h FROM o FULL JOIN n ON o.id = n.id), a AS (SELECT *, CASE WHEN ov IS NULL THEN 'insert' WHEN nv IS NULL THEN 'stale' WHEN abs(ov - nv) <= 1e-9 THEN 'keep' WHEN h THEN 'candidate' ELSE 'overwrite' END AS action FROM b)
  SELECT id, action, CASE WHEN action IN ('insert', 'overwrite') THEN nv ELSE ov END AS value FROM a""")
def calc_reconcile_formula(spark, d):
    s = view(spark, d, "v_snap")
    old = s.where("id % 11 > 0").select("id", F.col("before_value").alias("value"), (F.col("id") % 2 == 0).alias("human"))
    return calc.reconciled(old, s.where("after_value is not null").select("id", F.col("after_value").alias("value")), "id")


@query("calc_solid_reference", "SELECT review_id, round(CASE end_mode WHEN 'ground' THEN total_coils * (wire_diameter + tol_upper / 100) WHEN 'not_ground' THEN (total_coils + 1.5) * (wire_diameter + tol_upper / 100) END, 6) AS solid_height FROM v_param")
def calc_solid_reference(spark, d):
    return view(spark, d, "v_param").select("review_id", F.round(calc.solid_height(), 6).alias("solid_height"))


GEOMETRY = COILS + """, g AS (SELECT *, CASE WHEN end_type IN ('closed', 'open') THEN end_type ELSE 'unknown' END AS model, CASE WHEN end_type = 'closed' AND end_mode = 'ground' THEN CASE support_coils WHEN 0.75 THEN 1.0::DOUBLE WHEN 1 THEN 1.5 WHEN 1.25 THEN 2.0 END WHEN end_type = 'closed' AND end_mode = 'not_ground' THEN CASE support_coils WHEN 1 THEN 3.0::DOUBLE WHEN 1.25 THEN 3.5 END END AS a FROM k),
  e AS (SELECT *, CASE WHEN model = 'unknown' OR end_mode IS NULL THEN 'end_condition' WHEN model = 'closed' AND a IS NULL THEN 'support_coils' WHEN model = 'closed' AND abs(total_coils - n - 2 * support_coils) > 1e-4 THEN 'counts_disagree' WHEN model = 'open' AND n IS NULL THEN 'counts_missing'
    WHEN model = 'open' AND abs(n - CASE end_mode WHEN 'ground' THEN total_coils - 1 ELSE total_coils END) > 1e-4 THEN 'counts_disagree' ELSE '' END AS reason FROM g),
  t AS (SELECT *, CASE WHEN reason = '' THEN CASE WHEN model = 'closed' THEN (free_length - a * wire_diameter) / CASE WHEN n > 0 THEN n END WHEN end_mode = 'ground' THEN free_length / total_coils ELSE (free_length - wire_diameter) / total_coils END END AS p0,
    round(CASE WHEN reason = '' THEN CASE WHEN model = 'closed' THEN wire_diameter * (n + a) WHEN end_mode = 'ground' THEN wire_diameter * total_coils ELSE wire_diameter * (total_coils + 1) END END, 9) AS nominal_solid FROM e)"""


@query("calc_solid_nominal_pitch", f"WITH {GEOMETRY} SELECT review_id, model, CASE WHEN p0 <= wire_diameter THEN 'pitch_not_above_wire' ELSE reason END AS reason, round(CASE WHEN p0 > wire_diameter THEN p0 END, 9) AS pitch, nominal_solid FROM t")
def calc_solid_nominal_pitch(spark, d):
    return calc.end_geometry(view(spark, d, "v_coil")).select("review_id", "model", F.col("pitch_reason").alias("reason"), "pitch", "nominal_solid")


K = f"((4 * ({MEAN} / wire_diameter) - 1) / (4 * ({MEAN} / wire_diameter) - 4) + 0.615::DOUBLE / ({MEAN} / wire_diameter))"


@query("calc_design_metrics", f"SELECT review_id, round({MEAN} / wire_diameter, 6) AS spring_index, round({K}, 6) AS curvature, round(pi() * {MEAN} * total_coils, 6) AS wire_length, round(pi() * {MEAN} * total_coils * pi() * wire_diameter * wire_diameter / 4 * 7.85e-6, 9) AS mass FROM v_param")
def calc_design_metrics(spark, d):
    length = F.pi() * calc.col_mean() * calc.col_coils()
    return view(spark, d, "v_param").select("review_id", F.round(calc.col_mean() / calc.col_wire(), 6).alias("spring_index"), F.round(calc.curvature(calc.col_mean() / calc.col_wire()), 6).alias("curvature"), F.round(length, 6).alias("wire_length"), F.round(length * F.pi() * calc.col_wire() * calc.col_wire() / 4 * 7.85e-6, 9).alias("mass"))


STRESS = GEOMETRY + f""", tr AS (SELECT *, {MEAN} AS mean, {RATE} AS rate FROM t), p AS (SELECT tr.review_id, tr.free_length, tr.wire_diameter, tr.outer_diameter, tr.nominal_solid, tr.mean, tr.rate, q.seq, coalesce(q.seq % 4 = 0 OR q.review_id % 9 = 0 AND q.seq = 1, false) AS solid, CASE WHEN q.seq % 2 = 0 THEN CASE WHEN q.review_id % 17 = 0 THEN 0 - q.force ELSE q.force END END AS force,
    CASE WHEN q.review_id % 23 = 0 THEN 'lbf' ELSE q.force_unit END AS force_unit, CASE WHEN q.force_unit = 'kgf' THEN q.height / 10 ELSE q.height END AS height, CASE WHEN q.force_unit = 'kgf' THEN 'cm' ELSE 'mm' END AS height_unit FROM tr JOIN v_point q ON q.review_id = tr.review_id),
  h AS (SELECT *, CASE WHEN solid THEN nominal_solid WHEN height_unit = 'cm' THEN height * 10 ELSE height END AS mm, CASE force_unit WHEN 'N' THEN force WHEN 'kN' THEN force * 1000 WHEN 'kgf' THEN force * 9.80665::DOUBLE END AS own, sum(solid::INT) OVER (PARTITION BY review_id) AS n_solid FROM p),
  w AS (SELECT *, CASE WHEN solid AND n_solid > 1 THEN 'ambiguous' WHEN force < 0 THEN 'negative_force' WHEN force IS NOT NULL AND own IS NULL THEN 'unknown_unit' WHEN force IS NOT NULL THEN '' WHEN mm IS NULL THEN 'no_height'
    WHEN mm > free_length OR coalesce(mm < nominal_solid, false) OR solid AND mm >= free_length THEN 'height_out_of_range' WHEN rate IS NULL OR free_length IS NULL THEN 'no_rate' ELSE '' END AS why FROM h),
  f AS (SELECT *, CASE WHEN why = '' THEN CASE WHEN force IS NOT NULL THEN own ELSE rate * (free_length - mm) END END AS fn FROM w),
  z AS (SELECT *, CASE WHEN mean > 0 AND wire_diameter > 0 AND mean / wire_diameter > 1 THEN 8 * fn * mean * {K} / (pi() * pow(wire_diameter, 3)) END AS tau FROM f)"""


@query("calc_work_stress", f"WITH {STRESS} SELECT review_id, seq, solid, force IS NULL AS estimated, round(fn, 6) AS force_n, round(tau, 4) AS stress, CASE WHEN why = '' AND tau IS NULL THEN 'no_geometry' ELSE why END AS reason FROM z")
def calc_work_stress(spark, d):
    k, s, kgf = F.col("review_id"), F.col("seq"), F.col("force_unit") == "kgf"
    wide = calc.end_geometry(_materials(view(spark, d, "v_coil"))).select("review_id", "free_length", "wire_diameter", F.col("nominal_solid").alias("solid_height"), calc.col_mean().alias("mean"), calc.stiffness().alias("rate"))
    force = F.when(s % 2 == 0, F.when(k % 17 == 0, 0 - F.col("force")).otherwise(F.col("force")))
    points = view(spark, d, "v_point").select("review_id", "seq", ((s % 4 == 0) | (k % 9 == 0) & (s == 1)).alias("solid"), force.alias("force"), F.when(k % 23 == 0, "lbf").otherwise(F.col("force_unit")).alias("force_unit"),
        F.when(kgf, F.col("height") / 10).otherwise(F.col("height")).alias("height"), F.when(kgf, "cm").otherwise("mm").alias("height_unit"))
    return calc.work_stress(points.join(wide, "review_id")).withColumns({"force_n": F.round("force_n", 6), "stress": F.round("stress", 4)})


INDEXED = f"i AS (SELECT *, round({MEAN} / wire_diameter, 9) AS c, {MEAN} AS mean FROM v_param)"


def _indexed(spark, d):
    return view(spark, d, "v_param").withColumn("c", F.round(calc.col_mean() / calc.col_wire(), 9)).withColumn("mean", calc.col_mean())


@query("tol_band_lookup", f"WITH {INDEXED} SELECT review_id, i.grade, c, round(greatest(factor * mean, minimum), 9) AS tolerance FROM i LEFT JOIN v_band b ON b.grade = i.grade AND (c > c_min OR (include_min AND c = c_min)) AND c <= c_max")
def tol_band_lookup(spark, d):
    out = calc.band_lookup(_indexed(spark, d).select("review_id", "grade", "c", "mean"), view(spark, d, "v_band"), "c", "mean")
    return out.select("review_id", "grade", "c", "tolerance")


@query("tol_coil_bands", "SELECT review_id, CASE WHEN total_coils > 0 AND total_coils <= 10 THEN 0.25::DOUBLE WHEN total_coils > 10 AND total_coils <= 20 THEN 0.5 WHEN total_coils > 20 AND total_coils <= 50 THEN 1.0 END AS tolerance FROM v_param")
def tol_coil_bands(spark, d):
    return calc.steps_lookup(view(spark, d, "v_param"), [(0, 10, 0.25), (10, 20, 0.5), (20, 50, 1.0)], "total_coils").select("review_id", "tolerance")


@query("tol_active_ratio", f"WITH {COILS} SELECT review_id, CASE WHEN n >= 3 AND n <= 10 THEN [0.05, 0.1, 0.15][grade]::DOUBLE WHEN n > 10 THEN [0.04, 0.08, 0.12][grade]::DOUBLE END AS ratio FROM k")
def tol_active_ratio(spark, d):
    p = view(spark, d, "v_coil").withColumn("a", calc.active_coils())
    of = lambda *x: F.element_at(F.array(*map(F.lit, x)), F.col("grade"))
    return p.select("review_id", F.when(F.col("a").between(3, 10), of(0.05, 0.1, 0.15)).when(F.col("a") > 10, of(0.04, 0.08, 0.12)).alias("ratio"))


@query("tol_form_limits", f"SELECT review_id, round([0.02::DOUBLE, 0.05, 0.08][grade] * free_length, 4) AS perpendicularity, CASE WHEN slim THEN round([0.02::DOUBLE, 0.05, 0.08][grade] * free_length / 2, 4) END AS straightness, round(0.003::DOUBLE * free_length, 4) AS permanent_set, slim AS review FROM (SELECT *, coalesce(free_length / CASE WHEN {MEAN} > 0 THEN {MEAN} END >= 5, false) AS slim FROM v_param) AS f")
def tol_form_limits(spark, d):
    return calc.form_limits(view(spark, d, "v_param"))


#: Large springs of the stand-in, some of them without a pitch or active coils.
HOT = """b AS (SELECT review_id, wire_diameter * 12 AS d, (outer_diameter - wire_diameter) * 3 AS mean, free_length * 6 AS free, CASE WHEN review_id % 6 > 0 THEN total_coils / 5 END AS active, CASE WHEN review_id % 7 > 0 THEN free_length * 6 / (3 + total_coils / 3) END AS pitch FROM v_param),
  s AS (SELECT *, concat_ws(',', CASE WHEN NOT d BETWEEN 8 AND 60 THEN 'wire' END, CASE WHEN NOT (mean > 0 AND mean <= 460) THEN 'mean' END, CASE WHEN NOT (free > 0 AND free <= 9000) THEN 'height' END, CASE WHEN d > 0 AND NOT mean / d BETWEEN 3 AND 12 THEN 'index' END,
    CASE WHEN mean > 0 AND NOT free / mean BETWEEN 0.8 AND 4 THEN 'slenderness' END, CASE WHEN active < 3 THEN 'active' END, CASE WHEN NOT (pitch > 0 AND pitch <= 0.5 * mean) THEN 'pitch' END) AS violations,
    concat_ws(',', CASE WHEN active IS NULL THEN 'active' END, CASE WHEN pitch IS NULL THEN 'pitch' END) AS missing FROM b),
  a AS (SELECT *, CASE WHEN violations <> '' THEN 'outside_scope' WHEN missing <> '' THEN 'missing_context' ELSE 'applicable' END AS scope FROM s)"""


def _hot(spark, d):
    c, k = F.col, F.col("review_id")
    p = view(spark, d, "v_param").select("review_id", (c("wire_diameter") * 12).alias("wire_diameter"), ((c("outer_diameter") - c("wire_diameter")) * 3).alias("mean"), (c("free_length") * 6).alias("free_length"),
        F.when(k % 6 > 0, c("total_coils") / 5).alias("active"), F.when(k % 7 > 0, c("free_length") * 6 / (3 + c("total_coils") / 3)).alias("pitch"))
    return calc.hot_scope(p)


@query("tol_hot_scope", f"WITH {HOT} SELECT review_id, missing, violations, scope FROM a")
def tol_hot_scope(spark, d):
    return _hot(spark, d).select("review_id", "missing", "violations", "scope")


@query("tol_hot_limits", f"""WITH {HOT}, g AS (SELECT * FROM (VALUES ('T', 0.008::DOUBLE, 0.8::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE, 0.01::DOUBLE, 1.5::DOUBLE, 0.03::DOUBLE, 1.5::DOUBLE), ('1', 0.01, 1.0, 1.5, 2.0, 0.015, 2.0, 0.05, 2.5), ('2', 0.015, 1.5, 2.0, 2.5, 0.02, 3.0, 0.1, 5.0), ('3', 0.02, 2.0, 2.5, 3.0, 0.03, 4.0, 0.15, 7.5))
    AS g(grade, df, d250, d500, dmore, ff, fm, lf, ld))
  SELECT review_id, 'diameter' AS kind, grade AS limit_grade, round(greatest(df * mean, CASE WHEN free <= 250 THEN d250 WHEN free <= 500 THEN d500 ELSE dmore END), 4) AS limit_mm FROM a, g WHERE scope = 'applicable'
  UNION ALL SELECT review_id, 'free_length', grade, round(greatest(ff * free, fm), 4) FROM a, g WHERE scope = 'applicable'
  UNION ALL SELECT review_id, 'load', grade, round(greatest(lf * (free * 2), ld * (active * 10)), 4) FROM a, g WHERE scope = 'applicable' AND review_id % 3 > 0""")
def tol_hot_limits(spark, d):
    kinds = F.explode(F.array(*map(F.lit, ("diameter", "free_length", "load"))))
    items = _hot(spark, d).withColumn("kind", kinds).withColumn("nominal", F.when(F.col("review_id") % 3 > 0, F.col("free_length") * 2)).withColumn("rate", F.col("active") * 10)
    return calc.hot_limits(items, calc.hot_table(spark)).select("review_id", "kind", "limit_grade", "limit_mm")


@query("tol_std_results", f"WITH {INDEXED}, t AS (SELECT review_id, end_mode, round(greatest(factor * mean, minimum), 9) AS v FROM i LEFT JOIN v_band b ON b.grade = i.grade AND (c > c_min OR (include_min AND c = c_min)) AND c <= c_max) SELECT review_id, 'outer_diameter' AS target, v AS tolerance, CASE WHEN v IS NULL THEN 'not_applicable' ELSE 'suggested' END AS status FROM t UNION ALL SELECT review_id, 'pitch', NULL, CASE WHEN end_mode IS NULL THEN 'need_context' ELSE 'suggested' END FROM t")
def tol_std_results(spark, d):
    t = calc.band_lookup(_indexed(spark, d).select("review_id", "grade", "c", "mean", "end_mode"), view(spark, d, "v_band"), "c", "mean")
    outer = t.select("review_id", F.lit("outer_diameter").alias("target"), "tolerance", F.when(F.col("tolerance").isNull(), "not_applicable").otherwise("suggested").alias("status"))
    return outer.unionByName(t.select("review_id", F.lit("pitch").alias("target"), F.lit(None).cast("double").alias("tolerance"), F.when(F.col("end_mode").isNull(), "need_context").otherwise("suggested").alias("status")))


@query("tol_default_grade", "SELECT review_id, coalesce(CASE WHEN review_id % 4 > 0 THEN grade END, 2) AS grade, review_id % 4 = 0 AS is_default FROM v_param")
def tol_default_grade(spark, d):
    given = F.when(F.col("review_id") % 4 > 0, F.col("grade"))
    return view(spark, d, "v_param").select("review_id", F.coalesce(given, F.lit(2)).alias("grade"), given.isNull().alias("is_default"))


#: Items of each spring: diameter, free length, load (by percent), stiffness; tolerances, explicit grades and gaps by the id.
GRADE = COILS + f""", i AS (SELECT review_id, end_mode, n AS active, round({MEAN} / wire_diameter, 4) AS c, outer_diameter, free_length, tol_upper, tol_lower, review_id AS r FROM k),
  l AS (SELECT * FROM (VALUES (3.0::DOUBLE, true, 8.0::DOUBLE, '1', 0.01::DOUBLE, 0.15::DOUBLE, 0.01::DOUBLE, 0.2::DOUBLE), (3, true, 8, '2', 0.015, 0.2, 0.02, 0.5), (3, true, 8, '3', 0.025, 0.4, 0.03, 0.7), (8, false, 15, '1', 0.015, 0.2, 0.015, 0.5), (8, false, 15, '2', 0.02, 0.3, 0.03, 0.7), (8, false, 15, '3', 0.03, 0.5, 0.04, 0.8),
    (15, false, 22, '1', 0.02, 0.3, 0.02, 0.6), (15, false, 22, '2', 0.03, 0.5, 0.04, 0.8), (15, false, 22, '3', 0.04, 0.7, 0.06, 1.0)) AS l(lo, closed, hi, g, df, dm, ff, fm)),
  items AS (SELECT r AS review_id, 'diameter' AS kind, outer_diameter AS nominal, CASE WHEN r % 5 < 4 THEN tol_upper / 2 END AS upper, CASE WHEN r % 5 < 3 THEN tol_lower / 2 END AS lower, NULL::DOUBLE AS percent, CASE WHEN r % 16 = 0 THEN '3' END AS explicit, r % 21 = 0 AS generated, c, active FROM i
    UNION ALL SELECT r, 'free_length', CASE WHEN r % 9 > 0 THEN free_length END, tol_upper, tol_lower, NULL, NULL, false, c, active FROM i
    UNION ALL SELECT r, 'load', free_length * 3, NULL, NULL, (r % 20)::DOUBLE, NULL, false, c, active FROM i
    UNION ALL SELECT r, 'stiffness', free_length / 4, CASE WHEN r % 2 = 0 THEN tol_upper * 2 ELSE tol_lower END, CASE WHEN r % 2 = 0 THEN tol_lower * 2 ELSE tol_upper END, NULL, NULL, false, c, active FROM i),
  t AS (SELECT *, CASE WHEN kind = 'load' THEN nominal * percent / 100 ELSE upper END AS hi_, CASE WHEN kind = 'load' THEN 0 - nominal * percent / 100 ELSE lower END AS lo_ FROM items),
  x AS (SELECT t.review_id, t.kind, l.g, round(greatest(CASE kind WHEN 'diameter' THEN df ELSE ff END * nominal, CASE kind WHEN 'diameter' THEN dm ELSE fm END), 4) AS v FROM t JOIN l ON kind IN ('diameter', 'free_length') AND (c > lo OR closed AND c = lo) AND c <= hi
    UNION ALL SELECT review_id, kind, g, round(nominal * CASE WHEN active <= 10 THEN [0.05::DOUBLE, 0.1, 0.15][g::INT] ELSE [0.04::DOUBLE, 0.08, 0.12][g::INT] END, 4) FROM t, (VALUES ('1'), ('2'), ('3')) AS q(g) WHERE kind IN ('load', 'stiffness') AND active >= 3),
  m AS (SELECT t.review_id, t.kind, min(g) FILTER (round(hi_ - v, 9) <= 0 AND round(lo_ + v, 9) >= 0) AS held, count(*) AS n, max(v) FILTER (g = '1') AS first FROM t JOIN x USING (review_id, kind) GROUP BY 1, 2),
  w AS (SELECT t.*, held, first, CASE WHEN explicit IS NOT NULL THEN 'drawing_grade' WHEN generated THEN 'generated_tolerance' WHEN upper IS NULL AND lower IS NULL AND percent IS NULL THEN 'missing_tolerance' WHEN nominal IS NULL THEN 'missing_context'
    WHEN hi_ IS NULL OR lo_ IS NULL OR lo_ > hi_ THEN 'invalid_tolerance' WHEN held IS NOT NULL THEN 'matched' WHEN n > 0 THEN 'outside_grades' ELSE 'missing_context' END AS status FROM t LEFT JOIN m USING (review_id, kind)),
  o AS (SELECT review_id, kind, CASE status WHEN 'drawing_grade' THEN explicit WHEN 'matched' THEN held END AS grade, status, coalesce(status = 'matched' AND held = '1' AND hi_ < first AND lo_ > 0 - first, false) AS stricter_than_first FROM w)"""


def _graded(spark, d):
    c, k, none = F.col, F.col("review_id"), F.lit(None)
    p = view(spark, d, "v_coil").withColumn("active", calc.active_coils()).withColumn("spring_index", F.round(calc.col_mean() / calc.col_wire(), 4))
    item = lambda kind, nominal, upper, lower, percent=none, explicit=none, generated=F.lit(False): F.struct(F.lit(kind).alias("kind"), nominal.alias("nominal"), upper.cast("double").alias("upper"), lower.cast("double").alias("lower"), percent.cast("double").alias("percent"), explicit.cast("string").alias("explicit"), generated.alias("generated"))
    even, up, low = k % 2 == 0, c("tol_upper"), c("tol_lower")
    items = p.select("review_id", "active", "spring_index", F.inline(F.array(
        item("diameter", c("outer_diameter"), F.when(k % 5 < 4, up / 2), F.when(k % 5 < 3, low / 2), none, F.when(k % 16 == 0, "3"), k % 21 == 0), item("free_length", F.when(k % 9 > 0, c("free_length")), up, low),
        item("load", c("free_length") * 3, none, none, (k % 20)), item("stiffness", c("free_length") / 4, F.when(even, up * 2).otherwise(low), F.when(even, low * 2).otherwise(up)))))
    items = dealt(items, spark, d, "part", "review_id", "kind")
    return calc.grade_inference(items, calc.cold_limits(items, spark).select("review_id", "kind", "limit_grade", "limit_mm"), ["review_id", "kind"])


@query("tol_grade_inference", f"WITH {GRADE} SELECT * FROM o")
def tol_grade_inference(spark, d):
    return _graded(spark, d)


@query("tol_grade_overall", f"WITH {GRADE} SELECT review_id, coalesce(min(grade), '2') AS grade, count(grade) = 0 AS is_default, count(grade) AS n_graded, count(grade) = count(*) AS complete FROM o GROUP BY 1")
def tol_grade_overall(spark, d):
    return calc.grade_overall(_graded(spark, d), ["review_id"])


@query("tol_input_snapshot", "SELECT event_id, job_id, last_value(CASE WHEN status NOT IN ('completed', 'failed') THEN value END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS independent FROM v_event")
def tol_input_snapshot(spark, d):
    return calc.input_snapshot(view(spark, d, "v_event"), "job_id", ["ts", "event_id"], F.col("status").isin("completed", "failed")).select("event_id", "job_id", "independent")


STD = """c AS (SELECT review_id, review_id % 97 = 0 AS other, CASE WHEN review_id % 23 = 0 THEN 'spring_features.spring_shape' WHEN review_id % 29 = 0 THEN 'spring_features.pitch_type' END AS odd,
  CASE WHEN review_id % 34 = 0 THEN NULL WHEN review_id % 11 = 0 THEN 'cold_coiled' WHEN review_id % 13 = 0 THEN 'hot_coiled' END AS own, review_id % 17 = 0 AND review_id % 34 > 0 AND review_id % 11 > 0 AND review_id % 13 > 0 AS foreign_no,
  CASE WHEN review_id % 5 = 0 THEN NULL WHEN wire_diameter * 4 >= 8 THEN 'hot_coiled' ELSE 'cold_coiled' END AS wire, 0.6::DOUBLE + (review_id % 4) / 10.0::DOUBLE AS wc, review_id % 19 = 0 OR 0.6::DOUBLE + (review_id % 4) / 10.0::DOUBLE < 0.75 AS unsure,
  CASE review_id % 7 WHEN 1 THEN 'cold_coiled' WHEN 2 THEN 'hot_coiled' END AS m, CASE WHEN review_id % 2 = 0 THEN 0.85::DOUBLE ELSE 0.7 END AS mc, CASE review_id % 3 WHEN 1 THEN 'hot_coiled' WHEN 2 THEN 'cold_coiled' END AS g FROM v_param),
a AS (SELECT *, CASE WHEN own IS NOT NULL THEN (coalesce((m <> own)::INT, 0) | coalesce((g <> own)::INT, 0)) + coalesce((wire <> own)::INT, 0) ELSE coalesce((m <> wire)::INT, 0) | coalesce((g <> wire)::INT, 0) END AS clash, coalesce(m = wire, false) OR coalesce(g = wire, false) AS backed FROM c),
w AS (SELECT *, least(0.95, CASE WHEN unsure THEN least(wc, 0.74) ELSE wc END + CASE WHEN backed THEN 0.05 ELSE 0 END) AS wconf,
  CASE WHEN other THEN 1 WHEN odd IS NOT NULL THEN 2 WHEN own IS NOT NULL THEN 3 WHEN foreign_no THEN 4 WHEN wire IS NOT NULL THEN 5 WHEN m IS NOT NULL THEN 6 WHEN g IS NOT NULL THEN 7 ELSE 8 END AS k FROM a),
r AS (SELECT *, CASE k WHEN 1 THEN false WHEN 3 THEN clash > 0 WHEN 5 THEN unsure OR clash > 0 WHEN 6 THEN mc < 0.78 WHEN 7 THEN review_id % 4 = 0 OR review_id % 8 = 1 ELSE true END AS review, CASE k WHEN 3 THEN own WHEN 5 THEN wire WHEN 6 THEN m WHEN 7 THEN g END AS method FROM w)"""


@query("std_select", f"""WITH {STD} SELECT review_id, CASE WHEN k = 4 THEN 'DIN 2095' WHEN method = 'hot_coiled' THEN 'GB/T 23934-2015' WHEN method = 'cold_coiled' THEN 'GB/T 1239.2-2009' END AS standard,
  CASE WHEN k IN (1, 2, 4) THEN 'not_applicable' WHEN review THEN 'need_review' ELSE 'applicable' END AS status, round(CASE k WHEN 2 THEN 0.78 WHEN 3 THEN 0.96 WHEN 4 THEN 0.88 WHEN 5 THEN wconf WHEN 6 THEN mc WHEN 7 THEN 0.8 ELSE 0 END::DOUBLE, 3) AS confidence,
  CASE k WHEN 1 THEN 'spring_type' WHEN 2 THEN odd WHEN 3 THEN 'drawing_standard_no' WHEN 4 THEN 'drawing_standard_no' WHEN 5 THEN 'wire_diameter_threshold' WHEN 6 THEN 'recognized_feature' WHEN 7 THEN 'llm_inference' ELSE 'insufficient_context' END AS source,
  review AS need_review, CASE WHEN k IN (3, 5) THEN clash ELSE 0 END::BIGINT AS n_conflicts FROM r""")
def std_select(spark, d):
    k, none = F.col("review_id"), F.lit(None).cast("string")
    number = F.when(k % 11 == 0, "GB/T 1239.2-2009").when(k % 13 == 0, "gbt 23934").when(k % 17 == 0, "DIN 2095")
    rows = view(spark, d, "v_param").select(
        "review_id", F.when(k % 97 == 0, "torsion_spring").otherwise("compression_spring").alias("spring_type"), none.alias("spring_family"), F.when(k % 23 == 0, "Conical").alias("spring_shape"), none.alias("wire_section"), F.when(k % 29 == 0, "variable").alias("pitch_type"),
        F.lit(0.78).alias("feature_confidence"), F.when(k % 34 == 0, "GB/T 4357").otherwise(number).alias("standard_no"), (k % 34 == 0).alias("standard_is_material"), F.when(k % 5 != 0, F.col("wire_diameter") * 4).alias("wire_diameter"),
        (0.6 + (k % 4) / 10.0).alias("wire_confidence"), (k % 19 == 0).alias("wire_review"), F.when(k % 7 == 1, "cold_coiled").when(k % 7 == 2, "hot_coiled").alias("method"), F.when(k % 2 == 0, 0.85).otherwise(0.7).alias("method_confidence"),
        F.when(k % 3 == 1, "hot_coiled").when(k % 3 == 2, "cold_coiled").alias("inferred_method"), F.lit(0.8).alias("inferred_confidence"), (k % 4 == 0).alias("inferred_review"), (k % 8 != 1).alias("inferred_evidence"), none.alias("text_method"),
    )
    return calc.select_standard(rows)


@query("std_ignore_material_ref", r"SELECT doc_id, line_no, l_partkey, l_suppkey, regexp_extract(text, 'GB/T ([0-9]+)', 1) AS standard FROM v_note WHERE contains(text, 'GB/T') AND NOT contains(text, 'material')")
def std_ignore_material_ref(spark, d):
    n = view(spark, d, "v_note")
    return n.where(F.col("text").rlike("GB/T [0-9]+") & ~F.col("text").contains("material")).select("doc_id", "line_no", "l_partkey", "l_suppkey", F.regexp_extract("text", "GB/T ([0-9]+)", 1).alias("standard"))


#: Load points whose heights depend on each other, with every way in which that fails.
CHAIN = """p AS (SELECT review_id, seq, CASE WHEN review_id % 3 = 0 THEN page ELSE 1 END AS page, CASE WHEN review_id % 9 = 0 AND seq >= 3 THEN 'b' ELSE 'a' END AS scope, lower(trim(label)) AS label, height, force, free_length,
    CASE WHEN seq = 1 THEN CASE review_id % 4 WHEN 1 THEN NULL WHEN 2 THEN 'free_deflection' ELSE 'absolute_height' END WHEN seq = 3 AND review_id % 5 = 0 THEN 'free_deflection' WHEN seq = 6 AND review_id % 7 = 0 THEN 'unknown' ELSE 'incremental_deflection' END AS kind,
    CASE WHEN seq = 1 THEN CASE WHEN review_id % 4 = 2 THEN 5 ELSE height END WHEN review_id % 11 = 0 AND seq = 2 THEN -1 WHEN review_id % 13 = 0 AND seq = 4 THEN 3 ELSE 0.1::DOUBLE * (1 + seq % 3) END * CASE WHEN review_id % 13 = 0 AND seq = 4 THEN 10 ELSE 1 END AS mm,
    review_id % 6 < 5 OR seq <> 2 AS verified, CASE WHEN review_id % 17 = 0 AND seq IN (2, 3) THEN 5 - seq WHEN review_id % 2 = 0 THEN seq - 1 END AS base_seq, 'f' || (seq - 1) AS base_label FROM v_point),
  b AS (SELECT p.review_id, p.seq, min(q.seq) AS base FROM p JOIN p q ON q.review_id = p.review_id AND (p.base_seq = q.seq OR p.base_seq IS NULL AND p.base_label = q.label) AND q.page = p.page AND q.scope = p.scope WHERE p.kind = 'incremental_deflection' GROUP BY 1, 2 HAVING count(*) = 1),
  e AS (SELECT p.*, b.base, CASE WHEN kind IS NULL THEN height WHEN kind = 'absolute_height' THEN mm WHEN kind = 'free_deflection' THEN free_length - mm END AS own FROM p LEFT JOIN b USING (review_id, seq)),
  f AS (SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN own > 0 THEN 'ok' ELSE 'no_height' END WHEN NOT verified OR kind = 'unknown' THEN 'unverified' WHEN mm < 0 THEN 'invalid_distance' WHEN kind = 'incremental_deflection' THEN CASE WHEN base IS NULL THEN 'base_not_unique' ELSE 'open' END WHEN own <= 0 THEN 'out_of_range' ELSE 'ok' END AS early FROM e),
  r AS (SELECT review_id, seq, own AS h FROM f WHERE early = 'ok' UNION ALL SELECT f.review_id, f.seq, r.h - f.mm FROM f JOIN r ON r.review_id = f.review_id AND r.seq = f.base WHERE f.early = 'open' AND r.h - f.mm > 1e-9 AND r.h - f.mm <= f.free_length),
  g AS (SELECT f.*, r.h, CASE WHEN early <> 'open' THEN early WHEN r.h IS NOT NULL THEN 'ok' WHEN EXISTS (SELECT 1 FROM r q WHERE q.review_id = f.review_id AND q.seq = f.base) THEN 'out_of_range' ELSE 'base_unresolved' END AS reason FROM f LEFT JOIN r ON r.review_id = f.review_id AND r.seq = f.seq)"""


def _chain(spark, d):
    c, k, s = F.col, F.col("review_id"), F.col("seq")
    kind = F.when(s == 1, F.when(k % 4 == 1, None).when(k % 4 == 2, "free_deflection").otherwise("absolute_height")).when((s == 3) & (k % 5 == 0), "free_deflection").when((s == 6) & (k % 7 == 0), "unknown").otherwise("incremental_deflection")
    tall = (k % 13 == 0) & (s == 4)
    value = F.when(s == 1, F.when(k % 4 == 2, 5.0).otherwise(c("height"))).when((k % 11 == 0) & (s == 2), -1.0).when(tall, 3.0).otherwise(F.lit(0.1) * (1 + s % 3))
    base = F.when((k % 17 == 0) & s.isin(2, 3), 5 - s).when(k % 2 == 0, s - 1)
    points = view(spark, d, "v_point").select("review_id", "seq", F.when(k % 3 == 0, c("page")).otherwise(1).alias("page"), F.when((k % 9 == 0) & (s >= 3), "b").otherwise("a").alias("scope"), "label", kind.alias("kind"), value.alias("value"), F.when(tall, "cm").otherwise("mm").alias("unit"),
        ((k % 6 < 5) | (s != 2)).alias("verified"), base.alias("base_seq"), F.concat(F.lit(" F"), (s - 1).cast("string")).alias("base_label"), "height", "height_unit", "free_length", "force")
    return durable(points)  # read four to seven times


@query("rec_height_chain", f"WITH RECURSIVE {CHAIN} SELECT review_id, seq, base, round(h, 6) AS resolved, reason FROM g")
def rec_height_chain(spark, d):
    return recursive.height_chain(_chain(spark, d)).withColumn("resolved", F.round("resolved", 6))


@query("rec_secant_rate", f"WITH RECURSIVE {CHAIN}, s AS (SELECT g.review_id, g.seq, round((g.force - q.force) / g.mm, 8) AS rate FROM g JOIN p q ON q.review_id = g.review_id AND q.seq = g.base WHERE g.reason = 'ok' AND g.mm > 0) SELECT review_id, seq, round(rate, 6) AS rate, CASE WHEN review_id % 3 > 0 AND NOT rate BETWEEN 0 - 20.0 - 1e-9 AND 30 + 1e-9 THEN 'outside_band' WHEN rate <= 0 THEN 'not_increasing' ELSE '' END AS warning FROM s")
def rec_secant_rate(spark, d):
    p = _chain(spark, d)
    points = p.select("review_id", "seq", "force", F.when(F.col("unit") == "cm", F.col("value") * 10).otherwise(F.col("value")).alias("distance"))
    declared = p.select("review_id").distinct().where("review_id % 3 > 0").select("review_id", F.lit(5.0).alias("rate_value"), F.lit(25.0).alias("rate_upper"), F.lit(-25.0).alias("rate_lower"))
    return recursive.secant_rate(recursive.height_chain(p), points, declared).withColumn("rate", F.round("rate", 6))


@query("rec_dependents", f"""WITH RECURSIVE e AS (SELECT DISTINCT review_id, src, src + step AS dst FROM (SELECT l_orderkey AS review_id, {SEQ} AS src, 1 + l_suppkey % 3 AS step, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) AS s WHERE src + step <= n),
  r AS (SELECT review_id, src AS root, dst AS field, 1 AS depth FROM e UNION SELECT r.review_id, r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.review_id = r.review_id AND e.src = r.field) SELECT review_id, root, field, min(depth) AS depth FROM r GROUP BY 1, 2, 3""")
def rec_dependents(spark, d):
    lines = table(spark, d, "lineitem").withColumn("src", F.expr(SEQ)).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    edges = lines.select(F.col("l_orderkey").alias("review_id"), "src", (F.col("src") + 1 + F.col("l_suppkey") % 3).alias("dst"), "n").where("dst <= n")
    return recursive.dependents(edges, ["review_id"]).select("review_id", F.col("root").cast("long"), F.col("field").cast("long"), "depth")


@query("rec_deflection_adopt", "SELECT review_id, seq, round(CASE WHEN seq % 2 = 0 THEN height WHEN force_unit <> 'kgf' THEN free_length - height / 2 END, 6) AS height, CASE WHEN seq % 2 = 0 THEN 'given' WHEN force_unit <> 'kgf' THEN 'adopted' ELSE 'unit_mismatch' END AS origin FROM v_point")
def rec_deflection_adopt(spark, d):
    p = view(spark, d, "v_point")
    return recursive.deflection_adopt(p.withColumn("deflection", F.when(F.col("seq") % 2 == 1, F.col("height") / 2)).withColumn("height", F.when(F.col("seq") % 2 == 0, F.col("height"))), F.col("force_unit") != "kgf")
