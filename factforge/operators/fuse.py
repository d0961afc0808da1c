"""Fusion: several candidates of one fact become one value with a confidence, its evidence and its conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from factforge.operators.calc import millimetres, newtons
from factforge.operators.components import connected
from factforge.operators.geo import overlap_ratio
from factforge.operators.grid import meeting_boxes

# Trust in a source by a part of its name, in order of precedence, and of all other sources.
SOURCE_WEIGHTS = (
    ("local_load_evidence", 0.995), ("human", 1.0), ("manual", 0.98), ("cad", 0.95), ("dxf", 0.95), ("dwg", 0.95), ("dimension_role_ranker", 0.94),
    ("werk24", 0.86), ("qwen_vision", 0.88), ("baidu_paddleocr_vl", 0.84), ("baidu_ocr", 0.82), ("pdf_text_layer", 0.8), ("rapidocr", 0.78),
    ("ocr", 0.78), ("azure", 0.78), ("paddle", 0.78), ("vision", 0.62), ("openai", 0.62), ("inference", 0.45),
)
DEFAULT_WEIGHT = 0.5
#: Candidates that are multiplied up at most; what a single one may contribute; the highest confidence.
JOINED, MOST_EACH, MOST = 3, 0.95, 0.99


def source_weight(source: Column | str, weights: tuple[tuple[str, float], ...] = SOURCE_WEIGHTS) -> Column:
    """Weight of the first name of the table that the source name contains; a null source has the default."""
    source = F.lower(F.col(source) if isinstance(source, str) else source)
    out = F.lit(None).cast("double")
    for word, weight in reversed(weights):
        out = F.when(source.contains(word), F.lit(weight)).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_WEIGHT))


def scored(candidates: DataFrame, weights: tuple[tuple[str, float], ...] = SOURCE_WEIGHTS) -> DataFrame:
    """Adds weight (the best one where `source` is an array), score and the rank within (review_id, field): best score first, then
    input order. Support coils whose `support_coils_origin` is drawing_single_end come before all others. A null confidence is 0."""
    several = isinstance(candidates.schema["source"].dataType, ArrayType)
    weight = F.coalesce(F.array_max(F.transform("source", lambda s: source_weight(s, weights))), F.lit(DEFAULT_WEIGHT)) if several else source_weight("source", weights)
    out = candidates.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn("weight", weight).withColumn("score", F.round(F.col("confidence") * F.col("weight"), 12))
    first = [F.desc((F.col("field") == "support_coils") & F.col("support_coils_origin").eqNullSafe("drawing_single_end"))] if "support_coils_origin" in candidates.columns else []
    order = Window.partitionBy("review_id", "field").orderBy(*first, F.desc("score"), "seq")
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


def top1(candidates: DataFrame) -> DataFrame:
    """The best candidate of each field."""
    return scored(candidates).where("rank = 1").select("review_id", "field", "seq", "source", "value", "score")


def joint_confidence() -> Column:
    """Of ranked rows of one field: the noisy-or of the best scores, a lone candidate's own confidence; at least the best
    candidate's own confidence, at most MOST; three decimals."""
    joint = 1 - F.product(F.when(F.col("rank") <= JOINED, 1 - F.least(F.lit(MOST_EACH), "score")))
    own = F.min_by("confidence", "rank")
    return F.round(F.round(F.least(F.lit(MOST), F.when(F.count("*") > 1, F.greatest(own, joint)).otherwise(own)), 9), 3)


def confidence(candidates: DataFrame) -> DataFrame:
    """The fused confidence of each field."""
    return scored(candidates).groupBy("review_id", "field").agg(joint_confidence().alias("confidence"))


def collect_evidence(candidates: DataFrame) -> DataFrame:
    """Distinct sources in order of rank, and how many candidates stand behind the field."""
    per_source = scored(candidates).groupBy("review_id", "field", "source").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    grouped = per_source.groupBy("review_id", "field").agg(F.array_sort(F.collect_list(F.struct("rank", "source"))).alias("all"), F.sum("n").alias("n_candidates"))
    return grouped.select("review_id", "field", F.array_join("all.source", " | ").alias("sources"), "n_candidates")


def values_close(left: Column, right: Column, numbers: bool, tolerance: float = 1e-6) -> Column:
    """Numbers within the tolerance, texts equal without outer blanks; a missing value is close to another one alone."""
    close = F.abs(left - right) <= tolerance if numbers else F.trim(left) == F.trim(right)
    return F.coalesce(close, left.isNull() & right.isNull())


def conflicts(candidates: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Fields in which any candidate's value is not the best one's."""
    numbers = isinstance(candidates.schema["value"].dataType, NumericType)
    order = Window.partitionBy("review_id", "field").orderBy("rank")
    first = scored(candidates).withColumn("best_value", F.first("value").over(order))
    differs = ~values_close(F.col("value"), F.col("best_value"), numbers, tolerance)
    return first.groupBy("review_id", "field").agg(F.max("best_value").alias("best_value"), F.count_if(differs).alias("n_differing")).where("n_differing > 0")


def review_flag(candidates: DataFrame) -> DataFrame:
    """Chosen value, fused confidence and whether a human must look: not if the best candidate's weight is .98 or more and its own
    confidence .95 or more; else unless there are two candidates and its own confidence is .9 or more."""
    out = scored(candidates).groupBy("review_id", "field").agg(
        F.min_by("value", "rank").alias("value"), joint_confidence().alias("confidence"), F.count("*").alias("n_candidates"), F.min_by(F.struct("weight", "confidence"), "rank").alias("best")
    )
    sure = ((F.col("best.weight") >= 0.98) & (F.col("best.confidence") >= 0.95)) | ((F.col("n_candidates") >= 2) & (F.col("best.confidence") >= 0.9))
    return out.select("review_id", "field", "value", "confidence", "n_candidates", (~sure).alias("needs_review"))


def load_points(points: DataFrame, weight: Column) -> DataFrame:
    """Points merge by (review, page, label in upper case); unnamed points never merge. Each attribute is the first non-null by weight, then input order."""
    named = F.when(F.trim("label") != "", F.upper(F.trim("label")))
    keyed = points.withColumn("name", F.coalesce(named, F.concat(F.lit("#"), F.col("seq").cast("string")))).withColumn("order", F.struct((-weight).alias("w"), F.col("seq")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(c)
    return keyed.groupBy("review_id", "page", "name").agg(*(first(c) for c in ("height", "force", "force_unit", "force_tol")), F.count("*").alias("n_merged"))


TOLERANCES = ("tol_upper", "tol_lower", "tol_percent")


def force_bundle(points: DataFrame, keys: list[str]) -> DataFrame:
    """Force, unit and tolerances as one bundle of the first row (by rank) with a force; if it has no tolerance, of the first later row that
    has one and states the same force in newtons (within 1e-9; an unknown unit is equal to none)."""
    bundle = F.struct("rank", "force", "force_unit", *TOLERANCES)
    base = points.where("force is not null").withColumn("n", newtons(F.col("force"), F.coalesce("force_unit", F.lit("")))).withColumn("given", F.coalesce(*(F.col(t) for t in TOLERANCES)).isNotNull())
    base = base.withColumn("first", F.min(F.struct("rank", "n", "given")).over(Window.partitionBy(*keys)))
    donor = F.col("given") & ~F.col("first.given") & (F.abs(F.col("n") - F.col("first.n")) <= 1e-9)
    out = base.groupBy(*keys).agg(F.min(bundle).alias("own"), F.min(F.when(donor, bundle)).alias("donor"))
    return out.select(*keys, F.inline(F.array(F.coalesce("donor", "own"))))


def point_conflicts(points: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """keys, attribute, n_rows: attributes of one load point in which its rows differ from the first (by rank): height in mm, force in newtons
    (a value in an unknown unit as it stands), the tolerance bundle of the rows that have any, and the signature (kind, mm, base) of
    verified height relations.
    points: keys, rank, height, height_unit, force, force_unit, tol_upper, tol_lower, tol_percent, relation_kind, relation_value, relation_unit,
    relation_base, relation_verified."""
    c = F.col
    order = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mm = F.coalesce(millimetres(c("height"), c("height_unit")), c("height"))
    n = F.coalesce(newtons(c("force"), c("force_unit")), c("force"))
    given = F.when(F.coalesce(*(c(t) for t in TOLERANCES)).isNotNull(), F.struct(*TOLERANCES))
    signature = F.when(c("relation_verified"), F.struct("relation_kind", millimetres(c("relation_value"), c("relation_unit")).alias("mm"), F.coalesce("relation_base", F.lit("")).alias("base")))
    rows = points.select(*keys, "rank", mm.alias("height"), n.alias("force"), given.alias("tolerance"), signature.alias("relation"))
    first = lambda x: F.first(x, ignorenulls=True).over(order)
    far = lambda x: F.abs(c(x) - first(x)) > tolerance
    other = lambda x: ~c(x).eqNullSafe(first(x)) & c(x).isNotNull()
    rows = rows.select(*keys, *(t.alias(x) for x, t in (("height", far("height")), ("force", far("force")), ("tolerance", other("tolerance")), ("relation", other("relation")))))
    found = rows.groupBy(*keys).agg(*(F.count_if(x).alias(x) for x in ("height", "force", "tolerance", "relation")))
    long = found.select(*keys, F.expr("stack(4, 'height', height, 'force', force, 'tolerance', tolerance, 'relation', relation) as (attribute, n_rows)"))
    return long.where("n_rows > 0")


def enrich_missing(candidates: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred candidates join only for fields that the review lacks."""
    new = inferred.join(candidates.select("review_id", "field").distinct(), ["review_id", "field"], "left_anti")
    return candidates.unionByName(new, allowMissingColumns=True)


def dimension_pick(dimensions: DataFrame) -> DataFrame:
    """Of untyped dimensions: outer diameter is the largest with a tolerance, else the largest of at least 20; free length the largest of the rest."""
    order = F.struct("value", (-F.col("seq")).alias("s"))
    outer = dimensions.groupBy("review_id").agg(
        F.coalesce(F.max_by("seq", F.when(F.col("tol_upper").isNotNull(), order)), F.max_by("seq", F.when(F.col("value") >= 20, order))).alias("outer_seq")
    )
    rest = dimensions.join(outer, "review_id").withColumn("free", ~F.col("seq").eqNullSafe(F.col("outer_seq")))
    return rest.groupBy("review_id").agg(F.max(F.when(~F.col("free"), F.col("value"))).alias("outer_diameter"), F.max(F.when(F.col("free"), F.col("value"))).alias("free_length"))


def role_rank(candidates: DataFrame, points: DataFrame, bonus: list[tuple[Column, float]], least: float, above_height: bool = False) -> DataFrame:
    """Re-scores candidates with additive features and the review's greatest load height; the best one counts if it reaches `least`."""
    heights = points.groupBy("review_id").agg(F.max("height").alias("max_height"))
    joined = candidates.join(heights, "review_id", "left")
    if above_height:
        joined = joined.where("max_height is null or value > max_height")
    total = F.col("confidence") * 0.6
    for test, points_ in bonus:
        total = total + F.when(test, F.lit(points_)).otherwise(F.lit(0.0))
    best = joined.withColumn("role_score", F.round(total, 9)).groupBy("review_id").agg(F.max_by(F.struct("seq", "value", "role_score"), F.struct("role_score", (-F.col("seq")).alias("s"))).alias("best"))
    return best.select("review_id", "best.seq", "best.value", "best.role_score").where(F.col("role_score") >= least)


def classify(texts: DataFrame, rules: list[tuple[str, str, float]], least: float = 0.45, margin: float = 0.12) -> DataFrame:
    """Class by summed rule points; unknown if the best is under `least` or too near to the second; confidence min(.98, best / 1.4)."""
    classes = sorted({c for c, _, _ in rules})
    points = {c: sum((F.when(F.lower("text").contains(word), F.lit(p)).otherwise(F.lit(0.0)) for k, word, p in rules if k == c), F.lit(0.0)) for c in classes}
    ranked = F.sort_array(F.array(*(F.struct(F.round(points[c], 9).alias("points"), F.lit(c).alias("name")) for c in classes)), asc=False)
    out = texts.withColumn("ranked", ranked).select("doc_id", F.col("ranked")[0]["name"].alias("first"), F.col("ranked")[0]["points"].alias("best"), F.col("ranked")[1]["points"].alias("second"))
    unknown = (F.col("best") < least) | (F.round(F.col("best") - F.col("second"), 9) < margin)
    return out.select("doc_id", F.when(unknown, F.lit("unknown")).otherwise(F.col("first")).alias("class"), F.round(F.least(F.lit(0.98), F.col("best") / 1.4), 9).alias("confidence"))


def fields_pivot(chosen: DataFrame, fields: list[str]) -> DataFrame:
    """Long chosen values as the template's wide columns."""
    return chosen.groupBy("review_id").pivot("field", fields).agg(F.first("value"))


def exact_dedupe(rows: DataFrame, group: list[str], key: list[Column], order: list[str]) -> DataFrame:
    """The first row of each rounded key, numbered anew."""
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy(*group, *key).orderBy(*order))).where("n = 1").drop("n")
    return first.withColumn("number", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))


def note_occurrences(notes: DataFrame, key: Column, explicit: Column) -> DataFrame:
    """Notes of several channels by equivalence key: explicit ones first, then input order; one row a key, with the number of aliases."""
    order = F.struct((~explicit).alias("late"), F.col("line_no"), F.col("l_partkey"), F.col("l_suppkey"), F.col("text"))
    return notes.withColumn("key", key).groupBy("doc_id", "key").agg(F.min_by("text", order).alias("content"), (F.count("*") - 1).alias("n_aliases"))


def equivalence_key(text: Column) -> Column:
    """Engineering-normalised text: lower case, spellings of plus-minus and spaces unified, trailing stops dropped."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"\s*(\+/-|\+-|±)\s*", "±"), r"\s+", " "), r"[ .;]+$", "")


def source_links(raw: DataFrame, converted: DataFrame, keys: list[str]) -> DataFrame:
    """Raw rows that exactly one converted group supersedes by equal keys."""
    groups = converted.groupBy(*keys).agg(F.countDistinct("group").alias("groups"), F.min("group").alias("group"))
    return raw.join(groups.where("groups = 1").drop("groups"), keys)


# Places that lie on an end of the spring, and the pair that is one mark on both.
END_PLACES, BOTH_ENDS, LEFT_END, RIGHT_END = ("两端面", "端面", "左端面", "右端面"), "两端面", "左端面", "右端面"


def same_text_box() -> Column:
    """Two boxes (the other's columns prefixed o_) of one printed text: most of the smaller one shared, or some of it and centres close."""
    c = F.col
    shared = overlap_ratio()
    middle = lambda at, size: F.abs(c(at) + c(size) / 2 - c(f"o_{at}") - c(f"o_{size}") / 2) < F.greatest(size, f"o_{size}") * 0.35
    return (shared > 0.65) | ((shared > 0.4) & middle("x", "width") & middle("y", "height"))


def measure_merge(marks: DataFrame, rounds: list | None = None) -> DataFrame:
    """One row for each measurement of a page: page_id, group (its least mark), value, unit, status, n_merged, evidence and sources (distinct,
    in order), place, place_conflict, place_candidates, and the box around its marks.

    Direct marks are one where value and unit are equal, their boxes are one text's and no two places contradict each other; unverified
    ones where page, evidence, value, unit and box are equal. A group that a mark without a place links over several places has no
    place and lists them, unless they are the ends together.
    marks: page_id, mark_no, value, unit, status (direct, unverified), evidence, source, place, x, y, width, height."""
    marks = marks.where("value > 0").withColumn("evidence", F.trim(F.coalesce("evidence", F.lit(""))))
    direct = marks.where("status = 'direct'")
    box = ["page_id", "mark_no", "value", "unit", "place", "x", "y", "width", "height"]
    met = meeting_boxes(direct.select(*box), direct.select(*box), ["value", "unit"]).where((F.col("mark_no") != F.col("o_mark_no")) & same_text_box())
    edges = met.where(F.col("place").isNull() | F.col("o_place").isNull() | (F.col("place") == F.col("o_place"))).select("page_id", "mark_no", F.col("o_mark_no").alias("other"))
    equal = Window.partitionBy("page_id", "evidence", "value", "unit", "x", "y", "width", "height")
    alike = marks.where("status <> 'direct'").select("page_id", "mark_no", F.min("mark_no").over(equal).alias("other"))
    grouped = marks.join(connected(edges.unionByName(alike), marks, ["page_id"], "mark_no", rounds), ["page_id", "mark_no"])
    listed = lambda x: F.array_sort(F.collect_set(x))
    out = grouped.groupBy("page_id", "group").agg(
        F.min("value").alias("value"), F.min("unit").alias("unit"), F.min("status").alias("status"), F.count("*").alias("n_merged"), listed("evidence").alias("evidence"), listed("source").alias("sources"), listed("place").alias("places"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"),
    )
    has = lambda p: F.array_contains("places", p)
    ends = (F.size(F.array_except("places", F.array(*map(F.lit, END_PLACES)))) == 0) & (has(BOTH_ENDS) | has(LEFT_END) & has(RIGHT_END))
    several = ~ends & (F.size("places") > 1)
    place = F.when(ends, F.lit(BOTH_ENDS)).when(~several, F.get("places", F.lit(0)))
    candidates = F.when(several, F.col("places")).otherwise(F.array().cast("array<string>"))
    return out.withColumns({"place": place, "place_conflict": several, "place_candidates": candidates}).drop("places")


def measure_select(merged: DataFrame) -> DataFrame:
    """Accepted value of each review, or the conflict: several values, or one value in several places."""
    out = merged.groupBy("page_id").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("zone").alias("n_zones"), F.min("value").alias("value"))
    state = F.when(F.col("n_values") > 1, "failed").when(F.col("n_zones") > 1, "needs_location").otherwise("located")
    return out.select("page_id", state.alias("state"), F.when(F.col("n_values") == 1, F.col("value")).alias("value"))


def promote_mentions(mentions: DataFrame) -> DataFrame:
    """Stand-alone mentions fill a blank parameter if all agree on value and place; else they conflict."""
    out = mentions.groupBy("doc_id").agg(F.countDistinct(F.struct("value", "place")).alias("n"), F.min("value").alias("value"))
    return out.select("doc_id", F.when(F.col("n") == 1, "filled").otherwise("conflict").alias("action"), F.when(F.col("n") == 1, F.col("value")).alias("value"))


def variant_merge(common: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Common values with a variant's own in front; where the value is from, and whether both differ."""
    both = common.select(*keys, F.col("value").alias("common_value")).join(local.select(*keys, F.col("value").alias("local_value")), keys, "full")
    origin = F.when(F.col("local_value").isNotNull(), "local").otherwise("common")
    clash = F.coalesce(F.col("local_value") != F.col("common_value"), F.lit(False))
    return both.select(*keys, F.coalesce("local_value", "common_value").alias("value"), origin.alias("origin"), clash.alias("conflict"))


def variant_rows(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """A child row for each variant of the manifest that isn't there yet, under a deterministic id."""
    child = manifest.select("parent_id", "owner_id", F.posexplode("pages").alias("variant", "page"))
    child = child.withColumn("child_id", F.substring(F.sha2(F.concat_ws(":", "parent_id", "variant", "page"), 256), 1, 24))
    return child.join(existing, "child_id", "left_anti").select("child_id", "parent_id", "owner_id", F.col("variant").cast("long").alias("variant"), "page")
