"""Queries of sections 2.2 to 2.4: preparation, extraction, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from factforge.operators import dictionary, extract, prep
from factforge.plans.base import query, table, view

WORD = "(SELECT DISTINCT p_name FROM part)"
KEY = r"regexp_replace(upper({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
NAMES = "names AS (SELECT term, alias AS name FROM v_dict UNION SELECT term, term FROM v_dict)"


@query("prep_unify_candidates", """SELECT review_id, seq, field, source, value, confidence, tol_upper, tol_lower, 'machine' AS channel FROM v_cand WHERE source <> 'manual'
  UNION ALL SELECT review_id, seq, field, 'manual', value, 1.0::DOUBLE, NULL, NULL, 'human' FROM v_cand WHERE source = 'manual'""")
def prep_unify_candidates(spark, d):
    c = view(spark, d, "v_cand")
    same = {x: F.col(x) for x in prep.CANDIDATE}
    human = {"review_id": F.col("review_id"), "seq": F.col("seq"), "field": F.col("field"), "source": F.lit("manual"), "value": F.col("value"), "confidence": F.lit(1.0), "tol_upper": F.lit(None).cast("double"), "tol_lower": F.lit(None).cast("double")}
    return prep.unify({"machine": (c.where("source <> 'manual'"), same), "human": (c.where("source = 'manual'"), human)})


@query("prep_drop_unusable", "SELECT review_id, seq, field, value FROM v_cand WHERE NOT (source = 'page_ocr' AND value < 3)")
def prep_drop_unusable(spark, d):
    c = view(spark, d, "v_cand")
    return prep.drop_unusable(c, (F.col("source") == "page_ocr") & (F.col("value") < 3)).select("review_id", "seq", "field", "value")


@query("prep_typed_values", r"""WITH n AS (SELECT l_suppkey % 5 AS grp, CASE WHEN l_partkey % 11 = 0 THEN 'NaN' WHEN l_partkey % 7 = 0 THEN ' ' ELSE regexp_extract(text, '=([0-9]+m?)', 1) END AS raw FROM v_note),
  t AS (SELECT grp, nullif(trim(raw), '') AS g, CASE WHEN regexp_matches(raw, '^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$') THEN try_cast(trim(raw) AS DOUBLE) END AS v FROM n)
  SELECT grp, count(g) AS n_given, count(*) FILTER (g IS NOT NULL AND v IS NULL) AS n_rejected, round(sum(v), 4) AS total FROM t GROUP BY grp""")
def prep_typed_values(spark, d):
    raw = F.when(F.col("l_partkey") % 11 == 0, "NaN").when(F.col("l_partkey") % 7 == 0, " ").otherwise(F.regexp_extract("text", "=([0-9]+m?)", 1))
    return prep.reject_report(view(spark, d, "v_note").select((F.col("l_suppkey") % 5).alias("grp"), raw.alias("raw")), "raw", ["grp"])


@query("prep_unit_convert", "SELECT review_id, seq, force * CASE force_unit WHEN 'N' THEN 1.0::DOUBLE WHEN 'kN' THEN 1000.0 WHEN 'kgf' THEN 9.80665 END AS force_n, height * 1.0::DOUBLE AS height_mm FROM v_point")
def prep_unit_convert(spark, d):
    return view(spark, d, "v_point").select("review_id", "seq", prep.to_base(F.col("force"), F.col("force_unit"), "force").alias("force_n"), prep.to_base(F.col("height"), F.col("height_unit"), "length", explicit=True).alias("height_mm"))


@query("prep_enum_normalize", "SELECT p_partkey, CASE WHEN contains(p_type, 'ECONOMY') THEN 'not_ground' WHEN contains(p_type, 'PROMO') THEN 'ground' WHEN regexp_matches(p_type, 'SMALL|LARGE') THEN 'closed' END AS code, CASE WHEN contains(p_type, 'ECONOMY') OR contains(p_type, 'PROMO') OR regexp_matches(p_type, 'SMALL|LARGE') THEN false ELSE true END AS needs_confirmation FROM part")
def prep_enum_normalize(spark, d):
    code = prep.enum_code(F.col("p_type"), [("ECONOMY", "not_ground"), ("PROMO", "ground"), ("SMALL|LARGE", "closed")])
    return table(spark, d, "part").select("p_partkey", code.alias("code"), code.isNull().alias("needs_confirmation"))


@query("prep_text_key", f"SELECT {KEY.format('p_name || p_brand')} AS key, count(DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END || p_brand) AS n_terms FROM part GROUP BY 1 HAVING count(DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' END || p_brand) > 1")
def prep_text_key(spark, d):
    terms = table(spark, d, "part").select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(" "), "p_brand").alias("term"))
    return prep.key_collisions(terms, "term")


@query("udf_nfkc", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name")
def udf_nfkc(spark, d):
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", "".join(chr(0xFF41 + i) for i in range(26)))
    return table(spark, d, "part").select(prep.nfkc(wide).alias("p_name")).groupBy("p_name").agg(F.count("*").alias("n"))


@query("prep_position_normalize", """WITH b AS (SELECT page_id, block_no, CASE WHEN block_no % 2 = 0 THEN x - width / 2 ELSE x END AS x, CASE WHEN block_no % 2 = 0 THEN y - height / 2 ELSE y END AS y, width, height FROM v_block)
  SELECT page_id, block_no, x, y, width, height FROM b WHERE x >= 0 AND y >= 0 AND x + width <= 1 AND y + height <= 1 AND width > 0""")
def prep_position_normalize(spark, d):
    b = view(spark, d, "v_block")
    box = prep.normalized_box(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.col("block_no") % 2 == 0)
    return b.select("page_id", "block_no", box.alias("box")).where("box is not null").select("page_id", "block_no", "box.*")


@query("prep_provenance_flags", """SELECT review_id, field, bool_or(source = 'manual') AS human, bool_or(regexp_matches(source, 'ocr|vision|reader')) AS recognized, bool_or(source = 'inference') AS formula, bool_or(source = 'manual') AS protected FROM v_cand GROUP BY 1, 2""")
def prep_provenance_flags(spark, d):
    grouped = view(spark, d, "v_cand").groupBy("review_id", "field").agg(F.collect_set("source").alias("source"))
    return grouped.select("review_id", "field", *(c.alias(n) for n, c in prep.provenance(F.col("source")).items()))


@query("prep_stable_ids", """WITH b AS (SELECT review_id, seq, substr(sha256(concat_ws('|', label, CAST(floor(height) AS BIGINT))), 1, 24) AS base FROM v_point), n AS (SELECT *, row_number() OVER (PARTITION BY review_id, base ORDER BY seq) AS n FROM b)
  SELECT review_id, seq, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS id FROM n""")
def prep_stable_ids(spark, d):
    return prep.stable_ids(view(spark, d, "v_point"), ["review_id"], [F.col("label"), F.floor("height").cast("string")], ["seq"]).select("review_id", "seq", "id")


#: What each field derives from, for the lineage check: a chain and, in every seventh review, a cycle.
EDGES = "e AS (SELECT DISTINCT review_id, 'outer_diameter' AS field, 'wire_diameter' AS input FROM v_cand UNION SELECT DISTINCT review_id, 'total_coils', 'outer_diameter' FROM v_cand UNION SELECT DISTINCT review_id, 'wire_diameter', 'total_coils' FROM v_cand WHERE review_id % 7 = 0)"


@query("prep_stale_lineage", f"""WITH {EDGES}, v AS (SELECT DISTINCT review_id, field FROM v_cand), h AS (SELECT review_id, bool_or(field = 'wire_diameter') AS w, bool_or(field = 'outer_diameter') AS o, bool_or(field = 'total_coils') AS t, review_id % 7 = 0 AS cyc FROM v GROUP BY 1)
  SELECT v.review_id, v.field, CASE v.field WHEN 'free_length' THEN true WHEN 'wire_diameter' THEN NOT cyc WHEN 'outer_diameter' THEN w AND NOT cyc ELSE o AND w AND NOT cyc END AS current FROM v JOIN h USING (review_id)""")
def prep_stale_lineage(spark, d):
    values = view(spark, d, "v_cand").select("review_id", "field").distinct()
    reviews = values.select("review_id").distinct()
    pair = lambda rows, a, b: rows.select("review_id", F.lit(a).alias("field"), F.lit(b).alias("input"))
    edges = pair(reviews, "outer_diameter", "wire_diameter").union(pair(reviews, "total_coils", "outer_diameter")).union(pair(reviews.where("review_id % 7 = 0"), "wire_diameter", "total_coils"))
    return prep.stale_lineage(values, edges, ["review_id"])


NOTE = "doc_id, line_no, l_partkey, l_suppkey"


@query("ext_page_text", r"""WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  SELECT doc_id, left(string_agg(line, chr(10) ORDER BY n), 12000) AS text, 0.74::DOUBLE AS confidence FROM t GROUP BY 1""")
def ext_page_text(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return extract.page_text(lines)


def _rules(rows) -> str:
    """Rule tuples as rows of SQL."""
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"{v}::DOUBLE" if isinstance(v, float) else f"'{v}'" for v in r) + ")" for r in rows) + ")"


KEYS = ["doc_id", "line_no", "l_partkey", "l_suppkey"]


@query("ext_labeled_numbers", f"SELECT {NOTE}, field, CAST(regexp_extract(text, p, 1, 'i') AS DOUBLE) AS value, unit, confidence FROM v_label JOIN {_rules(extract.LABELED)} AS r(field, p, unit, confidence) ON regexp_matches(text, p, 'i')")
def ext_labeled_numbers(spark, d):
    return extract.labeled_numbers(view(spark, d, "v_label"), KEYS)


@query("ext_title_fields", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name, regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages")
def ext_title_fields(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("name"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"))


@query("ext_context_features", f"SELECT {NOTE}, feature, coalesce(v, concat(regexp_extract(text, p, 1, 'i'), '级')) AS value, confidence FROM v_label JOIN {_rules(extract.CONTEXT)} AS r(feature, p, v, confidence, absent) ON regexp_matches(text, p, 'i') AND (absent IS NULL OR NOT regexp_matches(text, absent, 'i'))")
def ext_context_features(spark, d):
    return extract.context_features(view(spark, d, "v_label"), KEYS)


@query("ext_value_tolerance", rf"""SELECT {NOTE}, 'wire' AS field, CAST(regexp_extract(text, 'wire ([0-9.]+) \+/-([0-9.]+)', 1) AS DOUBLE) AS value, CAST(regexp_extract(text, 'wire ([0-9.]+) \+/-([0-9.]+)', 2) AS DOUBLE) AS upper, 0 - CAST(regexp_extract(text, 'wire ([0-9.]+) \+/-([0-9.]+)', 2) AS DOUBLE) AS lower FROM v_note WHERE contains(text, 'wire ')
  UNION ALL SELECT {NOTE}, 'outer', CAST(regexp_extract(text, 'outer ([0-9.]+) 0/-([0-9.]+)', 1) AS DOUBLE), 0.0::DOUBLE, 0 - CAST(regexp_extract(text, 'outer ([0-9.]+) 0/-([0-9.]+)', 2) AS DOUBLE) FROM v_note WHERE contains(text, 'outer ')""")
def ext_value_tolerance(spark, d):
    n = view(spark, d, "v_note")
    found = F.array(*(F.struct(F.lit(x).alias("field"), extract.value_tolerance(F.col("text"), x).alias("f")) for x in ("wire", "outer")))
    return n.select("doc_id", "line_no", "l_partkey", "l_suppkey", F.inline(found)).where("f is not null").select("doc_id", "line_no", "l_partkey", "l_suppkey", "field", "f.*")


FORCES = rf"""SELECT {NOTE}, unnest(regexp_extract_all(text, '(F[0-9]+)=([0-9.]+)(kgf|kN|N)?(?:\+/-([0-9.]+)%)?', 1)) AS label, CAST(unnest(regexp_extract_all(text, '(F[0-9]+)=([0-9.]+)(kgf|kN|N)?(?:\+/-([0-9.]+)%)?', 2)) AS DOUBLE) AS force,
  nullif(unnest(regexp_extract_all(text, '(F[0-9]+)=([0-9.]+)(kgf|kN|N)?(?:\+/-([0-9.]+)%)?', 3)), '') AS unit, CAST(nullif(unnest(regexp_extract_all(text, '(F[0-9]+)=([0-9.]+)(kgf|kN|N)?(?:\+/-([0-9.]+)%)?', 4)), '') AS DOUBLE) AS pct FROM v_note"""


#: Written forms of a force by l_suppkey % 13: text behind the number, and what it says (unit, upper, lower, percent, state).
FORMS = [
    ("N", "N", None, None, None, "not_specified"), ("N±5", "N", 5.0, -5.0, None, "specified"), (" kN+/-10%", "kN", None, None, 10.0, "specified"), ("N +10/-5", "N", 10.0, -5.0, None, "specified"), ("N +10N / -5N", "N", 10.0, -5.0, None, "specified"),
    ("kN ±50N", "kN", 0.05, -0.05, None, "specified"), ("N +8", "N", 8.0, None, None, "specified"), ("N -8", "N", None, -8.0, None, "specified"), ("N +5%", "N", None, None, None, "uncertain"), (" N/mm", None, None, None, None, None),
    ("N±5MPa", "N", None, None, None, "uncertain"), ("", None, None, None, None, None), ("kgf 士0.5kgf", "kgf", 0.5, -0.5, None, "specified"),
]


def _forced(spark, d):
    form = F.element_at(F.array(*(F.lit(f[0]) for f in FORMS)), (F.col("l_suppkey") % 13 + 1).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("F"), F.col("l_linenumber").cast("string"), F.lit("＝"), F.floor("l_extendedprice").cast("string"), form).alias("text"))


SAID = ", ".join("(%d, %s)" % (i, ", ".join("NULL" if x is None else repr(x) for x in f[1:])) for i, f in enumerate(FORMS))


@query("ext_force_annotations", f"WITH f AS (SELECT * FROM (VALUES {SAID}) AS f(k, unit, tol_upper, tol_lower, tol_percent, state)) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'F' || l_linenumber AS label, floor(l_extendedprice) AS force, unit, tol_upper::DOUBLE AS tol_upper, tol_lower::DOUBLE AS tol_lower, tol_percent::DOUBLE AS tol_percent, state FROM lineitem JOIN f ON k = l_suppkey % 13 WHERE state IS NOT NULL")
def ext_force_annotations(spark, d):
    return extract.force_annotations(_forced(spark, d), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("ext_load_heights", rf"SELECT {NOTE}, regexp_extract(text, 'H([0-9]+)=([0-9.]+)mm', 1) AS label, CAST(regexp_extract(text, 'H([0-9]+)=([0-9.]+)mm', 2) AS DOUBLE) AS height FROM v_note")
def ext_load_heights(spark, d):
    return extract.load_heights(view(spark, d, "v_note"))


@query("ext_load_point_pairs", f"""WITH f AS ({FORCES}), h AS (SELECT doc_id, regexp_extract(text, 'H([0-9]+)=', 1) AS label, CAST(regexp_extract(text, 'H[0-9]+=([0-9.]+)mm', 1) AS DOUBLE) AS height FROM v_note),
  hh AS (SELECT doc_id, label, count(DISTINCT height) AS n, min(height) AS height FROM h GROUP BY 1, 2), ff AS (SELECT doc_id, substr(label, 2) AS label, count(DISTINCT force) AS n_forces, min(force) AS force FROM f GROUP BY 1, 2)
  SELECT doc_id, label, n_forces, force, CASE WHEN n = 1 THEN height END AS height FROM ff LEFT JOIN hh USING (doc_id, label)""")
def ext_load_point_pairs(spark, d):
    n = view(spark, d, "v_note")
    return extract.load_point_pairs(extract.force_annotations(n, ["doc_id", "line_no", "l_partkey", "l_suppkey"]), extract.load_heights(n))


@query("ext_technical_notes", f"SELECT {NOTE}, 'heat_treatment' AS feature, 'temper' AS value FROM v_note WHERE contains(text, 'temper') UNION ALL SELECT {NOTE}, 'hardness', 'HRC' FROM v_note WHERE contains(text, 'HRC') UNION ALL SELECT {NOTE}, 'environment', 'salt spray' FROM v_note WHERE contains(text, 'salt spray')")
def ext_technical_notes(spark, d):
    return extract.keyword_features(view(spark, d, "v_note"), [("heat_treatment", "temper", "temper"), ("hardness", "HRC", "HRC"), ("environment", "salt spray", "salt spray")])


#: Clauses, and in them the pieces that begin at each mention; what stands left of a mention and right of it.
CLAUSES = r"""c AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ';'), ';')) AS clause FROM v_rough), m AS (SELECT doc_id, clause, string_split(regexp_replace(clause, '(Ra [0-9.]+)', chr(1) || '\1', 'g'), chr(1)) AS p FROM c WHERE regexp_matches(clause, 'Ra [0-9.]+')),
  e AS (SELECT doc_id, clause, p, unnest(range(2, len(p) + 1)) AS i FROM m)"""


@query("ext_roughness_mentions", rf"""WITH {CLAUSES} SELECT DISTINCT doc_id, CAST(regexp_extract(p[i], 'Ra ([0-9.]+)', 1) AS DOUBLE) AS value,
  coalesce(nullif(regexp_extract(array_to_string(p[1:i - 1], ''), '.*(surface|face|bore)', 1), ''), nullif(regexp_extract(array_to_string(p[i:], ''), '(surface|face|bore)', 1), ''), 'unknown') AS place FROM e""")
def ext_roughness_mentions(spark, d):
    return extract.roughness_mentions(view(spark, d, "v_rough"))


@query("ext_evidence_quality", rf"""WITH {CLAUSES}, r AS (SELECT doc_id, CAST(regexp_extract(p[i], 'Ra ([0-9.]+)', 1) AS DOUBLE) AS value, min(CASE WHEN regexp_matches(clause, '\b(no|not|without)\b') THEN 2 WHEN regexp_matches(clause, '\b(maybe|about|possibly)\b') OR length(clause) > 200 THEN 1 ELSE 0 END) AS r FROM e GROUP BY 1, 2)
  SELECT doc_id, value, ['direct', 'unverified', 'excluded'][r + 1] AS status FROM r""")
def ext_evidence_quality(spark, d):
    return extract.evidence_quality(view(spark, d, "v_rough"))


@query("ext_load_evidence_class", f"SELECT {NOTE}, CASE WHEN contains(text, 'kN') OR NOT regexp_matches(text, '\\+/-[0-9]+%') THEN 'pending' ELSE 'accept' END AS action, CASE WHEN contains(text, 'kN') THEN 'large_unit' WHEN NOT regexp_matches(text, '\\+/-[0-9]+%') THEN 'no_tolerance' ELSE 'complete' END AS reason, substr(sha256(text), 1, 16) AS diagnostic_id FROM v_note")
def ext_load_evidence_class(spark, d):
    return extract.load_evidence_class(view(spark, d, "v_note"))


@query("ext_catalog_mentions", r"""WITH w AS (SELECT * FROM (VALUES ('the'), ('ther'), ('mentre'), ('tion'), ('eit'), ('ing')) AS c(word)), t AS (SELECT doc_id, lower(text) AS text FROM documents),
  x AS (SELECT doc_id, word, string_split(text, word) AS p FROM t JOIN w ON contains(text, word)), y AS (SELECT doc_id, word, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n FROM x),
  z AS (SELECT doc_id, word, i, n, 1 + sum(length(piece)) OVER (PARTITION BY doc_id, word ORDER BY i) + (i - 1) * length(word) AS pos FROM y),
  h AS (SELECT z.doc_id, word, pos::BIGINT AS pos, pos::BIGINT + length(word) AS fin, substr(text, greatest(pos - 12, 1)::BIGINT, least(pos - 1, 12)::BIGINT) AS prior FROM z JOIN t USING (doc_id) WHERE i < n),
  v AS (SELECT *, max(fin) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_fin, max(fin) OVER (PARTITION BY doc_id, pos) AS here_fin FROM h),
  k AS (SELECT doc_id, word, min(pos) AS pos FROM v WHERE NOT (coalesce(before_fin >= fin, false) OR here_fin > fin) AND NOT regexp_matches(prior, '\b(no|not|without)\b') GROUP BY 1, 2)
  SELECT doc_id, word, pos AS at, row_number() OVER (PARTITION BY doc_id ORDER BY pos, word) AS n FROM k""")
def ext_catalog_mentions(spark, d):
    words = spark.createDataFrame([(w,) for w in ("the", "ther", "mentre", "tion", "eit", "ing")], "word string")
    return extract.catalog_mentions(table(spark, d, "documents").select("doc_id", "text"), words, "doc_id", "text", "word")


#: Wordings by l_partkey % 8 and the grades that each permits: catalog words are RING, PLATE and BOLT.
WORDINGS = [
    ("may be replaced by RING, PLATE or so, BOLT", ["RING"]), ("material X, allowed substitutes: RING, or PLATE, BOLT", ["RING", "PLATE", "BOLT"]), ("BOLT, alternative material ring, Plate, see note, BOLT", ["ring", "Plate"]), ("may not be replaced by RING, PLATE", []),
    ("can be substituted with Q 235, RING; PLATE, BOLT", ["Q 235", "RING"]), ("允许换用RING，或PLATE，不允许换用BOLT，RING", ["RING", "PLATE"]), ("RING, PLATE allowed", []), ("alternative material PLATE, RING. BOLT, substitute material 1,5 mm", ["PLATE", "RING", "1,5 mm"]),
]


def _permits(spark, d):
    text = F.element_at(F.array(*(F.lit(w[0]) for w in WORDINGS)), (F.col("l_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text"))


GRADES = ", ".join(f"({i}, '{g}', {'NULL' if g.upper() not in ('RING', 'PLATE', 'BOLT') else repr(g.upper())})" for i, w in enumerate(WORDINGS) for g in w[1])


@query("ext_allowed_substitutes", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, grade, term FROM lineitem JOIN (VALUES {GRADES}) AS g(k, grade, term) ON k = l_partkey % 8")
def ext_allowed_substitutes(spark, d):
    found = extract.allowed_substitutes(_permits(spark, d), spark.createDataFrame([("RING",), ("PLATE",), ("BOLT",)], "word string"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "word")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "grade", "term")


@query("ext_support_origin", f"SELECT {NOTE}, CASE WHEN contains(text, 'each') THEN 'per_end' ELSE 'unknown' END AS origin FROM v_note")
def ext_support_origin(spark, d):
    return view(spark, d, "v_note").select("doc_id", "line_no", "l_partkey", "l_suppkey", extract.support_origin(F.col("text")).alias("origin"))


@query("ext_foreign_text", r"SELECT doc_id, line_no, l_partkey, l_suppkey, regexp_matches(regexp_replace(text, '[A-Z]{1,4}[0-9/.-]*|[0-9.]+\s*(mm|kN|N|C|h)\b|\w+=\S+', ' ', 'g'), '[a-z]{3,}') AS needs_translation FROM v_note")
def ext_foreign_text(spark, d):
    return view(spark, d, "v_note").select("doc_id", "line_no", "l_partkey", "l_suppkey", extract.foreign_text(F.col("text")).alias("needs_translation"))


EXACT = f"""{NAMES}, e AS (SELECT name, min(term) AS exact_term FROM names GROUP BY 1), k AS (SELECT {KEY.format('name')} AS key, count(DISTINCT term) AS n, min(term) AS key_term FROM names GROUP BY 1),
  x AS (SELECT p_name, exact_term, n, key_term FROM {WORD} p LEFT JOIN e ON e.name = p_name LEFT JOIN k ON k.key = {KEY.format('p_name')}),
  matched AS (SELECT p_name, coalesce(exact_term, CASE WHEN n = 1 THEN key_term END, p_name) AS term, CASE WHEN exact_term IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'key' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status FROM x)"""


def _names(spark, d):
    return table(spark, d, "part").select("p_name").distinct()


@query("dict_exact_then_key", f"WITH {EXACT} SELECT p_name, term, CASE status WHEN 'exact' THEN 1.0::DOUBLE WHEN 'key' THEN 0.98 ELSE 0.0 END AS confidence, status FROM matched")
def dict_exact_then_key(spark, d):
    return dictionary.exact_then_key(_names(spark, d), "p_name", view(spark, d, "v_dict"))


CONTAINS = f"m AS (SELECT p_name, id, term FROM {WORD} p JOIN v_dict ON regexp_matches(lower(p_name), '(^|[^a-z0-9])' || lower(alias) || '($|[^a-z0-9])'))"


@query("dict_contains_grade", f"WITH {CONTAINS} SELECT * FROM m")
def dict_contains_grade(spark, d):
    return dictionary.contains_grade(_names(spark, d), "p_name", view(spark, d, "v_dict"))


@query("dict_unique_match", f"WITH {CONTAINS}, g AS (SELECT p_name, count(DISTINCT id) AS n, min(term) AS t FROM m GROUP BY 1) SELECT p.p_name, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'conflict' ELSE 'unmatched' END AS status, CASE WHEN n = 1 THEN t END AS term FROM {WORD} p LEFT JOIN g ON g.p_name = p.p_name")
def dict_unique_match(spark, d):
    names = _names(spark, d)
    return dictionary.unique_match(dictionary.contains_grade(names, "p_name", view(spark, d, "v_dict")), names, "p_name")


@query("dict_alias_cascade", f"""WITH a AS (SELECT lower(alias) AS a, min(term) AS alt FROM v_dict GROUP BY 1), k AS (SELECT {KEY.format('term')} AS k, min(term) AS kt FROM v_dict GROUP BY 1 HAVING count(DISTINCT term) = 1),
  x AS (SELECT p.p_name, alt, (SELECT min(term) FROM v_dict WHERE term = p.p_name) AS t, kt, regexp_matches(p_name, 'old|hot') AS veto FROM {WORD} p LEFT JOIN a ON a.a = lower(p.p_name) LEFT JOIN k ON k.k = {KEY.format('p.p_name')}),
  s AS (SELECT *, CASE WHEN alt IS NOT NULL THEN 'alias' WHEN t IS NOT NULL THEN 'exact' WHEN kt IS NOT NULL AND NOT veto THEN 'key' WHEN veto THEN 'confirm' ELSE 'suggest' END AS status FROM x)
  SELECT p_name, status, coalesce(alt, t, CASE WHEN status = 'key' THEN kt END) AS term, CASE status WHEN 'alias' THEN 0.96::DOUBLE WHEN 'exact' THEN 0.98 WHEN 'key' THEN 0.94 ELSE 0.0 END AS confidence FROM s""")
def dict_alias_cascade(spark, d):
    return dictionary.alias_cascade(_names(spark, d), "p_name", view(spark, d, "v_dict"), "old|hot")


FUZZY = f"""k AS (SELECT p_name, term, {KEY.format('p_name')} AS a, {KEY.format('term')} AS b FROM {WORD} p, (SELECT DISTINCT term FROM v_dict)),
  j AS (SELECT *, len(list_intersect(string_split(a, ''), string_split(b, '')))::DOUBLE / len(list_distinct(list_concat(string_split(a, ''), string_split(b, '')))) AS jac, CASE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)) ELSE 0 END AS inc FROM k),
  s AS (SELECT p_name, term, round(greatest(jac, inc), 9) AS score FROM j), f AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, term) AS n FROM s WHERE score >= 0.45)"""


@query("dict_fuzzy_topk", f"WITH {FUZZY} SELECT p_name, term, score, n FROM f WHERE n <= 8")
def dict_fuzzy_topk(spark, d):
    return dictionary.fuzzy_topk(_names(spark, d), "p_name", view(spark, d, "v_dict"))


@query("dict_decision_accept", f"WITH {FUZZY}, dc AS (SELECT p.p_name, t.term, CASE WHEN length(p.p_name) % 3 = 0 THEN 'skip' ELSE 'choose' END AS action, 0.8 + (length(p.p_name) % 4)::DOUBLE / 20 AS confidence FROM {WORD} p, (SELECT DISTINCT term FROM v_dict) t) SELECT p_name, term, action, confidence FROM dc WHERE action = 'choose' AND confidence >= 0.85 AND EXISTS (SELECT 1 FROM f WHERE f.n <= 8 AND f.p_name = dc.p_name AND f.term = dc.term)")
def dict_decision_accept(spark, d):
    names, terms = _names(spark, d), view(spark, d, "v_dict")
    suggested = dictionary.fuzzy_topk(names, "p_name", terms)
    decisions = suggested.select("p_name", "term", F.when(F.length("p_name") % 3 == 0, "skip").otherwise("choose").alias("action"), (F.lit(0.8) + (F.length("p_name") % 4).cast("double") / 20).alias("confidence"))
    decisions = decisions.unionByName(decisions.withColumn("term", F.lit("NO SUCH TERM")))  # one that nobody suggested
    return dictionary.decision_accept(decisions, suggested, "p_name")


query("udf_decider", f"WITH {FUZZY}, dc AS (SELECT p.p_name, t.term, CASE WHEN length(p.p_name) % 3 = 0 THEN 'skip' ELSE 'choose' END AS action, 0.8 + (length(p.p_name) % 4)::DOUBLE / 20 AS confidence FROM {WORD} p, (SELECT DISTINCT term FROM v_dict) t) SELECT p_name, term, action, confidence FROM dc WHERE action = 'choose' AND confidence >= 0.85 AND EXISTS (SELECT 1 FROM f WHERE f.n <= 8 AND f.p_name = dc.p_name AND f.term = dc.term)")(dict_decision_accept)


@query("dict_primary_conflict", f"SELECT p_brand, count(DISTINCT {KEY.format('p_name')}) AS n_primary, count(DISTINCT {KEY.format('p_name')}) > 1 AS conflict FROM part GROUP BY 1")
def dict_primary_conflict(spark, d):
    return dictionary.primary_conflict(table(spark, d, "part"), "p_brand", prep.text_key(F.col("p_name")))


@query("dict_substitute_pick", "WITH s AS (SELECT doc_id, count(DISTINCT l_partkey % 2) AS n, min(CASE WHEN l_partkey % 2 = 0 THEN 'PLATE' ELSE 'RING' END) AS term FROM v_note WHERE contains(text, 'HRC') OR contains(text, 'allowed') GROUP BY 1) SELECT doc_id, CASE WHEN n = 1 THEN 'substituted' ELSE 'conflict' END AS status, CASE WHEN n = 1 THEN term END AS term FROM s WHERE doc_id % 2 = 0")
def dict_substitute_pick(spark, d):
    n = view(spark, d, "v_note")
    primary = n.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "unmatched").otherwise("exact").alias("status"))
    subs = n.where(F.col("text").contains("HRC") | F.col("text").contains("allowed")).select("doc_id", F.when(F.col("l_partkey") % 2 == 0, "PLATE").otherwise("RING").alias("term"))
    return dictionary.substitute_pick(primary, subs, "doc_id")


@query("dict_membership_check", f"SELECT p_name, CASE WHEN lower(p_name) IN (SELECT lower(alias) FROM v_dict) OR p_name IN ('small ring') THEN 'pass' ELSE 'warning' END AS status FROM {WORD}")
def dict_membership_check(spark, d):
    return dictionary.membership_check(_names(spark, d), "p_name", view(spark, d, "v_dict"), ["small ring"])


@query("dict_mapping_validity", """WITH c AS (SELECT p_partkey, p_name, unnest([p_partkey % 8, (p_partkey // 8) % 8]) AS id FROM part), e AS (SELECT c.*, v.alias FROM c LEFT JOIN v_dict v ON v.id = c.id),
  g AS (SELECT p_partkey, count(*) FILTER (alias IS NULL) AS u, count(*) - count(DISTINCT id) AS r, count(*) FILTER (NOT contains(lower(p_name), lower(alias))) AS a FROM e GROUP BY 1) SELECT p_partkey, CASE WHEN u > 0 THEN 'unknown_id' WHEN r > 0 THEN 'repeated_id' WHEN a > 0 THEN 'not_in_text' ELSE 'ok' END AS reason FROM g""")
def dict_mapping_validity(spark, d):
    chosen = table(spark, d, "part").withColumn("ids", F.array((F.col("p_partkey") % 8).cast("int"), (F.floor(F.col("p_partkey") / 8) % 8).cast("int")))
    return dictionary.mapping_validity(chosen, view(spark, d, "v_dict"), "p_partkey", "ids", "p_name")
