"""Queries of section 2.5: fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from factforge.operators import fuse
from factforge.plans.base import query, table, view

# Trust in a source by a part of its name, in order of precedence.
WEIGHTS = [
    ("local_load_evidence", 0.995), ("human", 1.0), ("manual", 0.98), ("cad", 0.95), ("dxf", 0.95), ("dwg", 0.95), ("dimension_role_ranker", 0.94), ("werk24", 0.86), ("qwen_vision", 0.88), ("baidu_paddleocr_vl", 0.84),
    ("baidu_ocr", 0.82), ("pdf_text_layer", 0.8), ("rapidocr", 0.78), ("ocr", 0.78), ("azure", 0.78), ("paddle", 0.78), ("vision", 0.62), ("openai", 0.62), ("inference", 0.45),
]
WEIGHT = "CASE " + " ".join(f"WHEN contains(lower(source), '{name}') THEN {weight}::DOUBLE" for name, weight in WEIGHTS) + " ELSE 0.5 END"
SCORED = f"""s AS (SELECT *, {WEIGHT} AS weight, round(confidence * ({WEIGHT}), 12) AS score FROM v_cand),
r AS (SELECT *, row_number() OVER (PARTITION BY review_id, field ORDER BY score DESC, seq) AS rank FROM s)"""
JOINT = "round(round(least(0.99, CASE WHEN count(*) = 1 THEN max(confidence) ELSE greatest(arg_min(confidence, rank), 1 - product(1 - least(0.95, score)) FILTER (rank <= 3)) END), 9), 3)"
NOTE_KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '\s*(\+/-|\+-|±)\s*', '±', 'g'), '\s+', ' ', 'g'), '[ .;]+$', '')"


@query("fuse_source_weight", f"SELECT source, max({WEIGHT})::DOUBLE AS weight, count(*) AS n FROM v_cand GROUP BY source")
def fuse_source_weight(spark, d):
    return view(spark, d, "v_cand").groupBy("source").agg(F.max(fuse.source_weight("source")).alias("weight"), F.count("*").alias("n"))


@query("fuse_top1", f"WITH {SCORED} SELECT review_id, field, seq, source, value, score FROM r WHERE rank = 1")
def fuse_top1(spark, d):
    return fuse.top1(view(spark, d, "v_cand"))


@query("fuse_confidence", f"WITH {SCORED} SELECT review_id, field, {JOINT} AS confidence FROM r GROUP BY 1, 2")
def fuse_confidence(spark, d):
    return fuse.confidence(view(spark, d, "v_cand"))


query("udaf_noisy_or", f"WITH {SCORED} SELECT review_id, field, {JOINT} AS confidence FROM r GROUP BY 1, 2")(fuse_confidence)


@query("fuse_collect_evidence", f"WITH {SCORED}, p AS (SELECT review_id, field, source, min(rank) AS rank, count(*) AS n FROM r GROUP BY ALL) SELECT review_id, field, string_agg(source, ' | ' ORDER BY rank) AS sources, sum(n)::BIGINT AS n_candidates FROM p GROUP BY 1, 2")
def fuse_collect_evidence(spark, d):
    return fuse.collect_evidence(view(spark, d, "v_cand"))


@query("fuse_conflicts", f"WITH {SCORED}, b AS (SELECT review_id, field, value AS best_value FROM r WHERE rank = 1) SELECT review_id, field, max(best_value) AS best_value, count(*) FILTER (abs(value - best_value) > 1e-6) AS n_differing FROM r JOIN b USING (review_id, field) GROUP BY 1, 2 HAVING count(*) FILTER (abs(value - best_value) > 1e-6) > 0")
def fuse_conflicts(spark, d):
    return fuse.conflicts(view(spark, d, "v_cand"))


@query("fuse_review_flag", f"""WITH {SCORED}, g AS (SELECT review_id, field, arg_min(value, rank) AS value, {JOINT} AS confidence, count(*) AS n_candidates,
  arg_min(weight, rank) AS w, arg_min(confidence, rank) AS own FROM r GROUP BY 1, 2)
  SELECT review_id, field, value, confidence, n_candidates, CASE WHEN w >= 0.98 AND own >= 0.95 THEN false WHEN n_candidates < 2 THEN true ELSE own < 0.9 END AS needs_review FROM g""")
def fuse_review_flag(spark, d):
    return fuse.review_flag(view(spark, d, "v_cand"))


@query("fuse_load_points", """WITH p AS (SELECT *, upper(trim(label)) AS name, CASE test_type WHEN 'A' THEN 3 WHEN 'R' THEN 2 ELSE 1 END AS w FROM v_point)
  SELECT review_id, page, name, arg_min(height, (0 - w, seq)) AS height, arg_min(force, (0 - w, seq)) AS force, arg_min(force_unit, (0 - w, seq)) AS force_unit,
  arg_min(force_tol, (0 - w, seq)) FILTER (force_tol IS NOT NULL) AS force_tol, count(*) AS n_merged FROM p GROUP BY 1, 2, 3""")
def fuse_load_points(spark, d):
    weight = F.when(F.col("test_type") == "A", 3).when(F.col("test_type") == "R", 2).otherwise(1)
    return fuse.load_points(view(spark, d, "v_point"), weight)


#: Points of one label with forces that are often equal in other units, and relations of heights.
LOADS = """p AS (SELECT review_id, CASE WHEN seq % 2 = 0 THEN 'F1' ELSE 'F2' END AS label, seq AS rank, CASE WHEN seq % 3 = 0 THEN height ELSE 40 END AS height, 'mm' AS height_unit, CASE WHEN seq % 5 = 0 THEN NULL WHEN review_id % 3 = 0 THEN force WHEN seq % 3 = 0 THEN 0.1::DOUBLE ELSE 100 END AS force,
  CASE WHEN review_id % 3 = 0 THEN force_unit WHEN seq % 3 = 0 THEN 'kN' WHEN review_id % 7 = 0 THEN 'lbf' ELSE 'N' END AS force_unit, CASE WHEN seq > 2 THEN force_tol END AS tol_upper, CASE WHEN seq > 2 THEN 0 - force_tol END AS tol_lower, CASE WHEN seq = 4 AND review_id % 4 = 0 THEN 10.0::DOUBLE END AS tol_percent,
  CASE WHEN seq % 3 = 1 THEN 'absolute_height' ELSE 'free_deflection' END AS kind, CASE WHEN review_id % 2 = 0 THEN 20.0::DOUBLE ELSE seq END AS rel, seq % 4 > 0 AND review_id % 5 = 0 AS verified FROM v_point),
  q AS (SELECT *, force * CASE lower(force_unit) WHEN 'n' THEN 1 WHEN 'kn' THEN 1000 WHEN 'kgf' THEN 9.80665::DOUBLE END AS n, coalesce(tol_upper, tol_lower, tol_percent) IS NOT NULL AS given FROM p)"""


def _loads(spark, d):
    c, k, s = F.col, F.col("review_id"), F.col("seq")
    force = F.when(s % 5 == 0, None).when(k % 3 == 0, c("force")).when(s % 3 == 0, 0.1).otherwise(100.0)
    unit = F.when(k % 3 == 0, c("force_unit")).when(s % 3 == 0, "kN").when(k % 7 == 0, "lbf").otherwise("N")
    return view(spark, d, "v_point").select("review_id", F.when(s % 2 == 0, "F1").otherwise("F2").alias("label"), s.alias("rank"), F.when(s % 3 == 0, c("height")).otherwise(40.0).alias("height"), "height_unit", force.alias("force"), unit.alias("force_unit"),
        F.when(s > 2, c("force_tol")).alias("tol_upper"), F.when(s > 2, 0 - c("force_tol")).alias("tol_lower"), F.when((s == 4) & (k % 4 == 0), 10.0).alias("tol_percent"), F.when(s % 3 == 1, "absolute_height").otherwise("free_deflection").alias("relation_kind"),
        F.when(k % 2 == 0, 20.0).otherwise(s.cast("double")).alias("relation_value"), F.lit("mm").alias("relation_unit"), F.lit(None).cast("string").alias("relation_base"), ((s % 4 > 0) & (k % 5 == 0)).alias("relation_verified"))


@query("fuse_force_bundle", f"""WITH {LOADS}, f AS (SELECT review_id, label, arg_min(n, rank) AS n0, arg_min(given, rank) AS given0, min(rank) AS first FROM (SELECT review_id, label, rank, struct_pack(v := n) AS n, given FROM q WHERE force IS NOT NULL) AS z GROUP BY 1, 2),
  d AS (SELECT f.review_id, f.label, min(q.rank) AS donor FROM f JOIN q ON q.review_id = f.review_id AND q.label = f.label AND q.force IS NOT NULL AND q.given AND NOT f.given0 AND abs(q.n - f.n0.v) <= 1e-9 GROUP BY 1, 2)
  SELECT q.review_id, q.label, q.rank, q.force, q.force_unit, q.tol_upper, q.tol_lower, q.tol_percent FROM q JOIN f USING (review_id, label) LEFT JOIN d USING (review_id, label) WHERE q.rank = coalesce(donor, first)""")
def fuse_force_bundle(spark, d):
    return fuse.force_bundle(_loads(spark, d), ["review_id", "label"])


@query("fuse_load_conflicts", f"""WITH {LOADS}, v AS (SELECT review_id, label, rank, height, coalesce(n, force) AS force, CASE WHEN given THEN (tol_upper, tol_lower, tol_percent) END AS t, CASE WHEN verified THEN (kind, rel) END AS r FROM q),
  w AS (SELECT *, first_value(height IGNORE NULLS) OVER o AS h0, first_value(force IGNORE NULLS) OVER o AS f0, first_value(t IGNORE NULLS) OVER o AS t0, first_value(r IGNORE NULLS) OVER o AS r0 FROM v WINDOW o AS (PARTITION BY review_id, label ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  g AS (SELECT review_id, label, count(*) FILTER (abs(height - h0) > 1e-6) AS h, count(*) FILTER (abs(force - f0) > 1e-6) AS f, count(*) FILTER (t IS NOT NULL AND t IS DISTINCT FROM t0) AS t, count(*) FILTER (r IS NOT NULL AND r IS DISTINCT FROM r0) AS r FROM w GROUP BY 1, 2)
  SELECT review_id, label, 'height' AS attribute, h AS n_rows FROM g WHERE h > 0 UNION ALL SELECT review_id, label, 'force', f FROM g WHERE f > 0 UNION ALL SELECT review_id, label, 'tolerance', t FROM g WHERE t > 0 UNION ALL SELECT review_id, label, 'relation', r FROM g WHERE r > 0""")
def fuse_load_conflicts(spark, d):
    return fuse.point_conflicts(_loads(spark, d), ["review_id", "label"])


@query("fuse_enrich_missing", """WITH have AS (SELECT DISTINCT review_id, field FROM v_cand), inf AS (SELECT review_id, 'wire_diameter' AS field, max(value) / 10 AS value FROM v_cand WHERE field = 'outer_diameter' GROUP BY 1)
  SELECT review_id, field, value FROM v_cand UNION ALL SELECT review_id, field, value FROM inf WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.review_id = inf.review_id AND h.field = inf.field)""")
def fuse_enrich_missing(spark, d):
    c = view(spark, d, "v_cand").select("review_id", "field", "value")
    inferred = c.where("field = 'outer_diameter'").groupBy("review_id").agg((F.max("value") / 10).alias("value")).withColumn("field", F.lit("wire_diameter"))
    return fuse.enrich_missing(c, inferred)


@query("fuse_dimension_pick", """WITH p AS (SELECT review_id, coalesce(arg_max(seq, (value, 0 - seq)) FILTER (tol_upper IS NOT NULL), arg_max(seq, (value, 0 - seq)) FILTER (value >= 20)) AS o FROM v_cand GROUP BY 1)
  SELECT c.review_id, max(value) FILTER (seq = o) AS outer_diameter, max(value) FILTER (seq IS DISTINCT FROM o) AS free_length FROM v_cand c JOIN p ON c.review_id = p.review_id GROUP BY 1""")
def fuse_dimension_pick(spark, d):
    return fuse.dimension_pick(view(spark, d, "v_cand"))


ROLE = """WITH h AS (SELECT review_id, max(height) AS max_height FROM v_point GROUP BY 1),
  s AS (SELECT c.review_id, c.seq, c.value, round(confidence * 0.6 + CASE WHEN {a} THEN {pa}::DOUBLE ELSE 0 END + CASE WHEN {b} THEN {pb}::DOUBLE ELSE 0 END, 9) AS role_score FROM v_cand c LEFT JOIN h ON h.review_id = c.review_id WHERE field = '{f}' {w}),
  b AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY role_score DESC, seq) AS n FROM s) SELECT review_id, seq, value, role_score FROM b WHERE n = 1 AND role_score >= {t}"""


@query("fuse_role_rank", ROLE.format(a="tol_upper IS NOT NULL", pa=0.3, b="value < max_height", pb=0.2, f="outer_diameter", w="", t=0.86))
def fuse_role_rank(spark, d):
    c = view(spark, d, "v_cand").where("field = 'outer_diameter'")
    return fuse.role_rank(c, view(spark, d, "v_point"), [(F.col("tol_upper").isNotNull(), 0.3), (F.col("value") < F.col("max_height"), 0.2)], 0.86)


@query("fuse_role_rank_length", ROLE.format(a="value >= 20", pa=0.3, b="source = 'manual'", pb=0.25, f="free_length", w="AND (max_height IS NULL OR value > max_height)", t=0.82))
def fuse_role_rank_length(spark, d):
    c = view(spark, d, "v_cand").where("field = 'free_length'")
    return fuse.role_rank(c, view(spark, d, "v_point"), [(F.col("value") >= 20, 0.3), (F.col("source") == "manual", 0.25)], 0.82, above_height=True)


RULES = [("compression", "mm", 0.3), ("compression", "kn", 0.4), ("extension", "salt", 0.7), ("extension", "ra 1", 0.5), ("torsion", "hrc", 0.9), ("torsion", "cold", 0.35)]
_POINTS = {c: " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {p}::DOUBLE ELSE 0 END" for k, w, p in RULES if k == c) for c in sorted({k for k, _, _ in RULES})}


@query("fuse_classify", "WITH p AS (SELECT doc_id * 10 + line_no AS doc_id, " + ", ".join(f"round({x}, 9) AS {c}" for c, x in _POINTS.items()) + """ FROM v_note),
  l AS (SELECT doc_id, list_sort([{'p': compression, 'n': 'compression'}, {'p': extension, 'n': 'extension'}, {'p': torsion, 'n': 'torsion'}], 'DESC') AS r FROM p)
  SELECT doc_id, CASE WHEN r[1].p < 0.45 OR round(r[1].p - r[2].p, 9) < 0.12 THEN 'unknown' ELSE r[1].n END AS class, round(least(0.98, r[1].p / 1.4), 9) AS confidence FROM l""")
def fuse_classify(spark, d):
    notes = view(spark, d, "v_note").select((F.col("doc_id") * 10 + F.col("line_no")).alias("doc_id"), "text")
    return fuse.classify(notes, RULES)


@query("fuse_fields_pivot", f"WITH {SCORED} SELECT review_id, max(value) FILTER (field = 'wire_diameter') AS wire_diameter, max(value) FILTER (field = 'outer_diameter') AS outer_diameter, max(value) FILTER (field = 'free_length') AS free_length, max(value) FILTER (field = 'total_coils') AS total_coils FROM r WHERE rank = 1 GROUP BY 1")
def fuse_fields_pivot(spark, d):
    return fuse.fields_pivot(fuse.top1(view(spark, d, "v_cand")), ["wire_diameter", "outer_diameter", "free_length", "total_coils"])


@query("fuse_exact_dedupe", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY page_id, text, round(x, 1), round(y, 1) ORDER BY block_no) AS n FROM v_block)
  SELECT page_id, block_no, text, row_number() OVER (PARTITION BY page_id ORDER BY block_no) AS number FROM f WHERE n = 1""")
def fuse_exact_dedupe(spark, d):
    b = view(spark, d, "v_block")
    return fuse.exact_dedupe(b, ["page_id"], [F.col("text"), F.round("x", 1), F.round("y", 1)], ["block_no"]).select("page_id", "block_no", "text", "number")


@query("fuse_note_occurrences", f"""WITH k AS (SELECT doc_id, line_no, l_partkey, l_suppkey, text, substr({NOTE_KEY}, strpos({NOTE_KEY}, ';')) AS key FROM v_note)
  SELECT doc_id, key, arg_min(text, (NOT contains(text, 'required'), line_no, l_partkey, l_suppkey, text)) AS content, count(*) - 1 AS n_aliases FROM k GROUP BY 1, 2""")
def fuse_note_occurrences(spark, d):
    key = fuse.equivalence_key(F.col("text"))
    return fuse.note_occurrences(view(spark, d, "v_note"), key.substr(F.greatest(F.instr(key, ";"), F.lit(0)), F.length(key)), F.col("text").contains("required"))


@query("fuse_equivalent_notes", f"""WITH k AS (SELECT doc_id, line_no, text, {NOTE_KEY} AS key, row_number() OVER (PARTITION BY doc_id, {NOTE_KEY} ORDER BY line_no, l_partkey, l_suppkey) AS n FROM v_note)
  SELECT doc_id, line_no, key FROM k WHERE n = 1""")
def fuse_equivalent_notes(spark, d):
    notes = view(spark, d, "v_note").withColumn("key", fuse.equivalence_key(F.col("text")))
    return fuse.exact_dedupe(notes, ["doc_id"], [F.col("key")], ["line_no", "l_partkey", "l_suppkey"]).select("doc_id", "line_no", "key")


@query("fuse_source_links", """WITH c AS (SELECT doc_id, line_no, count(DISTINCT l_partkey) AS n, min(l_partkey) AS grp FROM v_note WHERE contains(text, 'Ra ') GROUP BY 1, 2)
  SELECT v.doc_id, v.line_no, v.text, c.grp AS "group" FROM v_note v JOIN c USING (doc_id, line_no) WHERE c.n = 1""")
def fuse_source_links(spark, d):
    notes = view(spark, d, "v_note").select("doc_id", "line_no", "text", F.col("l_partkey").alias("group"))
    return fuse.source_links(notes.drop("group"), notes.where(F.col("text").contains("Ra ")), ["doc_id", "line_no"])


OVERLAP = "greatest(least(p.x + p.width, q.x + q.width) - greatest(p.x, q.x), 0) * greatest(least(p.y + p.height, q.y + q.height) - greatest(p.y, q.y), 0) / least(p.width * p.height, q.width * q.height)"


@query("fuse_measure_merge", f"""WITH RECURSIVE b AS (SELECT page_id, mark_no, value, unit, status, trim(evidence) AS evidence, source, place, x, y, width, height FROM v_mark WHERE value > 0),
  e AS (SELECT p.page_id, p.mark_no AS a, q.mark_no AS b FROM b p JOIN b q ON p.page_id = q.page_id AND p.value = q.value AND p.unit = q.unit AND p.status = q.status WHERE CASE WHEN p.status = 'direct' THEN coalesce(p.place = q.place, true)
    AND ({OVERLAP} > 0.65 OR {OVERLAP} > 0.4 AND abs(p.x + p.width / 2 - q.x - q.width / 2) < greatest(p.width, q.width) * 0.35::DOUBLE AND abs(p.y + p.height / 2 - q.y - q.height / 2) < greatest(p.height, q.height) * 0.35::DOUBLE)
    ELSE p.evidence = q.evidence AND p.x = q.x AND p.y = q.y AND p.width = q.width AND p.height = q.height END),
  reach AS (SELECT page_id, mark_no AS a, mark_no AS b FROM b UNION SELECT r.page_id, r.a, e.b FROM reach r JOIN e ON e.page_id = r.page_id AND e.a = r.b), g AS (SELECT page_id, a AS mark_no, min(b) AS grp FROM reach GROUP BY 1, 2),
  s AS (SELECT page_id, grp, max(value) AS value, max(unit) AS unit, max(status) AS status, count(*) AS n_merged, string_agg(DISTINCT evidence, '|' ORDER BY evidence) AS evidence, string_agg(DISTINCT source, '|' ORDER BY source) AS sources, count(DISTINCT place) AS k, bool_or(place = '外圆') AS round, min(place) AS one,
    string_agg(DISTINCT place, '|' ORDER BY place) AS places, min(x) AS x, max(x + width) AS "right" FROM b JOIN g USING (page_id, mark_no) GROUP BY 1, 2)
  SELECT page_id, grp AS "group", value, unit, status, n_merged, evidence, sources, CASE WHEN k = 2 AND NOT round THEN '两端面' WHEN k < 2 THEN one END AS place, k > 1 AND round AS place_conflict, CASE WHEN k > 1 AND round THEN places ELSE '' END AS candidates, x, "right" FROM s""")
def fuse_measure_merge(spark, d):
    out = fuse.measure_merge(view(spark, d, "v_mark"))
    joined = lambda c: F.array_join(c, "|")
    return out.select("page_id", "group", "value", "unit", "status", "n_merged", joined("evidence").alias("evidence"), joined("sources").alias("sources"), "place", "place_conflict", joined("place_candidates").alias("candidates"), "x", "right")


@query("fuse_measure_select", """WITH b AS (SELECT page_id, x, CAST(text AS DOUBLE) AS value FROM v_block), s AS (SELECT page_id, count(DISTINCT value) AS v, count(DISTINCT floor(x * 4)) AS z, min(value) AS value FROM b GROUP BY 1)
  SELECT page_id, CASE WHEN v > 1 THEN 'failed' WHEN z > 1 THEN 'needs_location' ELSE 'located' END AS state, CASE WHEN v = 1 THEN value END AS value FROM s""")
def fuse_measure_select(spark, d):
    return fuse.measure_select(view(spark, d, "v_block").select("page_id", F.floor(F.col("x") * 4).alias("zone"), F.col("text").cast("double").alias("value")))


@query("fuse_promote_mentions", r"""WITH m AS (SELECT doc_id, CAST(regexp_extract(text, 'Ra ([0-9.]+)', 1) AS DOUBLE) AS value, CASE WHEN contains(text, 'inner') THEN 'inner' ELSE 'surface' END AS place FROM v_note WHERE contains(text, 'Ra ')),
  g AS (SELECT doc_id, count(DISTINCT (value, place)) AS n, min(value) AS v FROM m GROUP BY 1) SELECT doc_id, CASE WHEN n = 1 THEN 'filled' ELSE 'conflict' END AS action, CASE WHEN n = 1 THEN v END AS value FROM g""")
def fuse_promote_mentions(spark, d):
    notes = view(spark, d, "v_note").where(F.col("text").contains("Ra "))
    place = F.when(F.col("text").contains("inner"), "inner").otherwise("surface")
    return fuse.promote_mentions(notes.select("doc_id", F.regexp_extract("text", r"Ra ([0-9.]+)", 1).cast("double").alias("value"), place.alias("place")))


@query("fuse_variant_merge", """WITH c AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 3 > 0), l AS (SELECT l_orderkey AS id, max(l_extendedprice) AS v FROM lineitem WHERE l_orderkey % 5 > 0 GROUP BY 1)
  SELECT coalesce(c.id, l.id) AS id, coalesce(l.v, c.v) AS value, CASE WHEN l.v IS NOT NULL THEN 'local' ELSE 'common' END AS origin, coalesce(l.v <> c.v, false) AS conflict FROM c FULL JOIN l ON c.id = l.id""")
def fuse_variant_merge(spark, d):
    common = table(spark, d, "orders").where("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    local = table(spark, d, "lineitem").where("l_orderkey % 5 > 0").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_extendedprice").alias("value"))
    return fuse.variant_merge(common, local, ["id"])


@query("fuse_variant_rows", """WITH m AS (SELECT o_orderkey AS parent_id, o_custkey AS owner_id, unnest(range(0, 1 + o_orderkey % 3)) AS variant FROM orders),
  c AS (SELECT substr(sha256(concat_ws(':', parent_id, variant, variant + 1)), 1, 24) AS child_id, parent_id, owner_id, variant, variant + 1 AS page FROM m) SELECT * FROM c WHERE parent_id % 4 <> 0 OR variant <> 0""")
def fuse_variant_rows(spark, d):
    o = table(spark, d, "orders")
    manifest = o.select(F.col("o_orderkey").alias("parent_id"), F.col("o_custkey").alias("owner_id"), F.sequence(F.lit(1).cast("long"), (1 + F.col("o_orderkey") % 3).cast("long")).alias("pages"))
    existing = manifest.where("parent_id % 4 = 0").select(F.substring(F.sha2(F.concat_ws(":", "parent_id", F.lit(0), F.lit(1)), 256), 1, 24).alias("child_id"))
    return fuse.variant_rows(manifest, existing)
