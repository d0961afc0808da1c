"""Rule checks as rows: (review_id, rule_id, status, message), and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity of a status; fixed values.
RANK = {"pass": 0, "warning": 1, "need_review": 2, "missing": 3, "fail": 4}


def severity(status: str | Column) -> Column:
    column = F.col(status) if isinstance(status, str) else status
    return F.coalesce(*(F.when(column == name, F.lit(n)) for name, n in RANK.items()))


def required_fields(values: DataFrame, required: list[str]) -> DataFrame:
    """A missing row for each required field that a review lacks."""
    template = values.select("review_id").distinct().withColumn("field", F.explode(F.array(*map(F.lit, required))))
    return template.join(values.where("value is not null").select("review_id", "field").distinct(), ["review_id", "field"], "left_anti").withColumn("status", F.lit("missing"))


def capability_range(wide: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """fail with the fields outside their limits, in the limits' order; pass without any."""
    outside = F.array_compact(F.array(*(F.when(~F.col(f).between(lo, hi), F.lit(f)) for f, (lo, hi) in limits.items())))
    return wide.select("review_id", F.when(F.size(outside) > 0, "fail").otherwise("pass").alias("status"), F.array_join(outside, ", ").alias("message"))


def height_vs_free(points: DataFrame) -> DataFrame:
    """fail if any test height reaches the free length; need_review without one."""
    out = points.groupBy("review_id").agg(F.bool_or(F.col("height") >= F.col("free_length")).alias("bad"))
    return out.select("review_id", F.when(F.col("bad"), "fail").when(F.col("bad").isNull(), "need_review").otherwise("pass").alias("status"))


def monotonic(points: DataFrame, force: Column) -> DataFrame:
    """fail if force falls as compression rises; points in order of height downwards, then input order."""
    order = Window.partitionBy("review_id").orderBy(F.desc("height"), "seq")
    steps = points.withColumn("base", force).withColumn("falls", F.col("base") < F.lag("base").over(order) - 1e-9)
    return steps.groupBy("review_id").agg(F.when(F.coalesce(F.bool_or("falls"), F.lit(False)), "fail").otherwise("pass").alias("status"))


def tolerance_band(wide: DataFrame, least: float) -> DataFrame:
    """warning if the band is narrower than can be made."""
    width = F.round(F.col("tol_upper") - F.col("tol_lower"), 9)
    return wide.select("review_id", F.when((width > 0) & (width < least), "warning").otherwise("pass").alias("status"))


def overall_status(results: DataFrame, key: str) -> DataFrame:
    """The most severe status: fail, then missing, need_review, warning, pass."""
    return results.groupBy(key).agg(F.max_by("status", severity("status")).alias("status"), F.count("*").alias("n"))


def release_gate(results: DataFrame, key: str, order: str, blocking: list[str]) -> DataFrame:
    """Blocked by the first blocking result, else by a result that needs review, else ready."""
    blocks = F.col("status").isin(blocking)
    out = results.groupBy(key).agg(F.min(F.when(blocks, F.col(order))).alias("first_block"), F.bool_or(F.col("status") == "need_review").alias("review"))
    return out.select(key, "first_block", F.when(F.col("first_block").isNotNull(), "blocked").when(F.col("review"), "review").otherwise("ready").alias("gate"))


def status_by_field(results: DataFrame, fields: str) -> DataFrame:
    """Most severe status of each related field."""
    return results.select("review_id", F.explode(fields).alias("field"), "status").groupBy("review_id", "field").agg(F.max_by("status", severity("status")).alias("status"))


#: What a marker says; fixed values.
CONFIRM, RECOGNIZED, CHECK_POINT, PASS_ON = "需要人工确认", "识别结果可作为审查候选", "载荷测试点需与原图和检验标准复核", "技术要求需进入工艺/质量流转"


def numbered(parts: list[DataFrame], group: str, order: list[str]) -> DataFrame:
    """Rows of several kinds as one numbered list of each review."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def markers(fields: DataFrame, points: DataFrame, notes: DataFrame, statuses: DataFrame) -> DataFrame:
    """review_id, kind (1 field, 2 point, 3 note), name, status, message, number: a review's fields that have a value, then all its points and
    all its notes. A field has the most severe status of the results that relate to it; without one, as a point or note, need_review or pass.

    fields: review_id, name, need (is a person to look at it?), a row for each field; points, notes: review_id, at (their order), name, need,
    a row for each one; statuses: review_id, field, status, of few fields a review."""
    f = fields.select("review_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("at"), "name", "need", F.when(F.col("need"), CONFIRM).otherwise(RECOGNIZED).alias("message"))
    p, n = (x.select("review_id", F.lit(kind).alias("kind"), "at", "name", "need", F.lit(says).alias("message")) for x, kind, says in ((points, 2, CHECK_POINT), (notes, 3, PASS_ON)))
    # one row a review, so that the join takes the partitioning by review over
    found = statuses.groupBy("review_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "status"))).alias("found"))
    status = F.coalesce(F.when(F.col("kind") == 1, F.col("found")[F.col("name")]), F.when(F.col("need"), "need_review").otherwise("pass"))
    return numbered([f.join(found, "review_id", "left"), *(x.withColumn("found", F.lit(None).cast("map<string,string>")) for x in (p, n))], "review_id", ["kind", "at", "name"]).select("review_id", "kind", "name", status.alias("status"), "message", "number")


def issues(rows: DataFrame, keys: list[str], checks: list[tuple[str, str, Column]]) -> DataFrame:
    """A row for each check (rule_id, severity, failing condition) that a row fails; null conditions don't."""
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, bad in checks)))
    return rows.select(*keys, F.inline(found))


#: Fields that must be positive, and bounds of the cold standard's scope; fixed values.
POSITIVE = ("wire_diameter", "outer_diameter", "inner_diameter", "mean_diameter", "free_length", "total_coils", "active_coils")
INDEX, MOST_COILS, SLENDER = (3, 22), 50, 5


def least_free_length() -> Column:
    """The drawing's solid height, else n * dmax for ground ends and (n + 1.5) * dmax for others."""
    thick = F.col("wire_diameter") + F.greatest(F.lit(0.0), F.coalesce("wire_upper", F.lit(0.0)))
    return F.coalesce("solid_height", F.when(F.col("end_mode") == "ground", F.col("total_coils") * thick).when(F.col("end_mode") == "not_ground", (F.col("total_coils") + 1.5) * thick))


def geometry_checks(cold: Column) -> list[tuple[str, str, Column]]:
    """Checks over wire_diameter, outer_diameter, inner_diameter, mean_diameter, free_length, total_coils, active_coils, support_coils,
    solid_height, wire_upper, end_mode and has_points, of which any may be null; cold: is the cold standard selected?"""
    wire, outer, inner, free, total, active, support = (F.col(c) for c in ("wire_diameter", "outer_diameter", "inner_diameter", "free_length", "total_coils", "active_coils", "support_coils"))
    mean = F.coalesce("mean_diameter", outer - wire, inner + wire)
    index, slender = mean / F.nullif(wire, F.lit(0.0)), free / F.nullif(mean, F.lit(0.0))
    open_end = F.col("end_mode").isNull()
    return [
        *((f"SPRING-GEO-{f.upper()}", "blocked", F.col(f) <= 0) for f in POSITIVE),
        ("SPRING-GEO-OUTER-INNER", "blocked", outer - 2 * wire <= 0),
        ("SPRING-GEO-DIAMETER-CONSISTENCY", "warning", F.abs(inner - (outer - 2 * wire)) > F.greatest(F.lit(0.02), wire * 0.02)),
        ("SPRING-GEO-COIL-COUNT", "blocked", active > total),
        ("SPRING-GEO-SUPPORT-COILS", "warning", F.abs(support - (total - active) / 2) > 1e-9),
        ("SPRING-CONTEXT-ACTIVE-COILS", "needs_input", (total > 0) & active.isNull() & open_end),
        ("GBT1239.2-SCOPE-SPRING-INDEX", "warning", cold & ~index.between(*INDEX)),
        ("GBT1239.2-SCOPE-TOTAL-COILS", "warning", cold & (total > MOST_COILS)),
        ("GBT1239.2-SLENDERNESS", "warning", cold & (slender >= SLENDER)),
        ("SPRING-CONTEXT-END-CONDITION", "needs_input", F.col("has_points") & F.col("solid_height").isNull() & open_end & wire.isNotNull() & total.isNotNull()),
        ("SPRING-LOAD-FREE-OVER-SOLID", "blocked", free <= least_free_length()),
    ]


def point_checks(height: Column, force: Column) -> list[tuple[str, str, Column]]:
    """Checks of a test point; height and force: its values in mm and N, null where number or unit can't be read. The point's row has
    the raw height and force, and free_length and least_free_length of its review."""
    return [
        ("SPRING-LOAD-HEIGHT-UNIT", "warning", F.col("height").isNotNull() & height.isNull()),
        ("SPRING-LOAD-FORCE-UNIT", "warning", F.col("force").isNotNull() & force.isNull()),
        ("SPRING-LOAD-HEIGHT-POSITIVE", "blocked", height <= 0),
        ("SPRING-LOAD-FORCE-POSITIVE", "blocked", force < 0),
        ("SPRING-LOAD-HEIGHT-OVER-FREE", "blocked", height > F.col("free_length")),
        ("SPRING-LOAD-HEIGHT-UNDER-SOLID", "blocked", height < F.col("least_free_length")),
    ]


def pairwise_points(points: DataFrame) -> DataFrame:
    """Pairs of one review that contradict: same height and other force, or lower height with lower force, for tests of one type.

    A review has a handful of points; the pair join is on the review."""
    b = points.toDF(*(f"b_{c}" for c in points.columns))
    pairs = points.join(b, (points.review_id == b.b_review_id) & (points.seq < b.b_seq) & (points.test_type == b.b_test_type) & (points.force_unit == b.b_force_unit))
    same = (F.abs(F.col("height") - F.col("b_height")) < 1e-9) & (F.abs(F.col("force") - F.col("b_force")) > 1e-9)
    against = (F.col("height") - F.col("b_height")) * (F.col("force") - F.col("b_force")) > 0
    return pairs.select("review_id", "seq", F.col("b_seq").alias("other_seq"), F.when(same, "same_height").when(against, "same_direction").alias("rule_id")).where("rule_id is not null")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


#: Parameters that each variant needs; fixed values.
VARIANT_NEEDS = ("wire_diameter", "free_length", "total_coils", "active_coils")
DIAMETERS = ("inner_diameter", "outer_diameter", "mean_diameter")


def variant_validation(parents: DataFrame, children: DataFrame) -> DataFrame:
    """parent_id, variant, issue. Of a set (variant null): `count` unless it has 2 to 50 variants and as many as declared. Of a variant:
    `page` outside the document, `missing:field`, `missing:diameter` without any of the three (0 doesn't count), `region` without one.

    parents: parent_id, declared, page_count (null: any page). children: parent_id, variant, page, region and the parameters."""
    n = children.groupBy("parent_id").agg(F.count("*").alias("n"))
    sets = parents.join(n, "parent_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = sets.where(~F.col("n").between(2, 50) | ~F.col("n").eqNullSafe(F.col("declared"))).select("parent_id", F.lit(None).cast("long").alias("variant"), F.lit("count").alias("issue"))
    outside = F.coalesce(F.col("page") < 1, F.lit(True)) | F.coalesce(F.col("page") > F.col("page_count"), F.lit(False))
    without = F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.lit(False)) for c in DIAMETERS), F.lit(True))
    tests = [("page", outside), *((f"missing:{c}", F.col(c).isNull()) for c in VARIANT_NEEDS), ("missing:diameter", without), ("region", F.col("region").isNull())]
    each = children.join(parents.select("parent_id", "page_count"), "parent_id")
    found = F.array_compact(F.array(*(F.when(t, F.lit(name)) for name, t in tests)))
    return bad.unionByName(each.select("parent_id", F.col("variant").cast("long").alias("variant"), F.explode(found).alias("issue")))


def constraint_check(values: DataFrame, constraints: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Each constraint (operator equal, min or max; limit) against the current value."""
    near = F.abs(F.col("value") - F.col("limit")) <= tolerance
    ok = F.when(F.col("operator") == "equal", near).when(F.col("operator") == "min", (F.col("value") >= F.col("limit")) | near).otherwise((F.col("value") <= F.col("limit")) | near)
    return values.join(constraints, "field").select("review_id", "field", "operator", ok.alias("satisfied"))
