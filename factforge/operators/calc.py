"""Rule tables, derived metrics and tolerances: arithmetic columns and range joins to small band tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factforge.operators.intervals import interval_join


def col_wire() -> Column:
    return F.col("wire_diameter")


def col_outer() -> Column:
    return F.col("outer_diameter")


def col_free() -> Column:
    return F.col("free_length")


def col_coils() -> Column:
    return F.col("total_coils")


def col_mean() -> Column:
    return col_outer() - col_wire()


# Shear modulus in MPa by standard name of the material.
MODULUS = {"SUS304": 71000.0, "SUS316": 71000.0, "17-7PH": 78000.0, "Inconel X750": 79000.0, "Inconel X-750": 79000.0, "Inconel 718": 78500.0}
# Offset a of the closed-end formulas by grinding and support coils of both ends together.
END_OFFSETS = {"ground": {1.5: 1.0, 2.0: 1.5, 2.5: 2.0}, "not_ground": {2.0: 3.0, 2.5: 3.5}}
# Newtons in a unit of force, millimetres in a unit of length.
FORCE_UNITS = {"n": 1.0, "kn": 1000.0, "kgf": 9.80665}
LENGTH_UNITS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "um": 0.001, "μm": 0.001}
# Share of the free height by accuracy grade (perpendicularity); the least slenderness for straightness; permanent set.
PERPENDICULARITY, STRAIGHT_FROM, PERMANENT_SET = {1: 0.02, 2: 0.05, 3: 0.08}, 5.0, 0.003
# Scope of the hot-coiled standard.
HOT_SCOPE = {"wire_min": 8.0, "wire_max": 60.0, "mean_max": 460.0, "height_max": 9000.0, "index_min": 3.0, "index_max": 12.0, "slenderness_min": 0.8, "slenderness_max": 4.0, "active_min": 3.0, "pitch_mean_max": 0.5}
# Hot-coiled limits as (kind, least free height, open, greatest, grade, factor, minimum); a load's minimum is a deflection.
HOT_LIMITS = [
    ("diameter", None, 250.0, "T", 0.008, 0.8), ("diameter", None, 250.0, "1", 0.01, 1.0), ("diameter", None, 250.0, "2", 0.015, 1.5), ("diameter", None, 250.0, "3", 0.02, 2.0),
    ("diameter", 250.0, 500.0, "T", 0.008, 1.0), ("diameter", 250.0, 500.0, "1", 0.01, 1.5), ("diameter", 250.0, 500.0, "2", 0.015, 2.0), ("diameter", 250.0, 500.0, "3", 0.02, 2.5),
    ("diameter", 500.0, None, "T", 0.008, 1.5), ("diameter", 500.0, None, "1", 0.01, 2.0), ("diameter", 500.0, None, "2", 0.015, 2.5), ("diameter", 500.0, None, "3", 0.02, 3.0),
    ("free_length", None, None, "T", 0.01, 1.5), ("free_length", None, None, "1", 0.015, 2.0), ("free_length", None, None, "2", 0.02, 3.0), ("free_length", None, None, "3", 0.03, 4.0),
    ("load", None, None, "T", 0.03, 1.5), ("load", None, None, "1", 0.05, 2.5), ("load", None, None, "2", 0.1, 5.0), ("load", None, None, "3", 0.15, 7.5),
]
# Cold-coiled limits as (kind, least spring index, closed, greatest, grade, factor, minimum).
COLD_LIMITS = [
    ("diameter", 3.0, True, 8.0, "1", 0.01, 0.15), ("diameter", 3.0, True, 8.0, "2", 0.015, 0.2), ("diameter", 3.0, True, 8.0, "3", 0.025, 0.4),
    ("diameter", 8.0, False, 15.0, "1", 0.015, 0.2), ("diameter", 8.0, False, 15.0, "2", 0.02, 0.3), ("diameter", 8.0, False, 15.0, "3", 0.03, 0.5),
    ("diameter", 15.0, False, 22.0, "1", 0.02, 0.3), ("diameter", 15.0, False, 22.0, "2", 0.03, 0.5), ("diameter", 15.0, False, 22.0, "3", 0.04, 0.7),
    ("free_length", 3.0, True, 8.0, "1", 0.01, 0.2), ("free_length", 3.0, True, 8.0, "2", 0.02, 0.5), ("free_length", 3.0, True, 8.0, "3", 0.03, 0.7),
    ("free_length", 8.0, False, 15.0, "1", 0.015, 0.5), ("free_length", 8.0, False, 15.0, "2", 0.03, 0.7), ("free_length", 8.0, False, 15.0, "3", 0.04, 0.8),
    ("free_length", 15.0, False, 22.0, "1", 0.02, 0.6), ("free_length", 15.0, False, 22.0, "2", 0.04, 0.8), ("free_length", 15.0, False, 22.0, "3", 0.06, 1.0),
]
# Cold-coiled load and stiffness limits as (least active coils, open, greatest, grade, share).
COIL_RATIOS = [(3.0, False, 10.0, "1", 0.05), (3.0, False, 10.0, "2", 0.1), (3.0, False, 10.0, "3", 0.15), (10.0, True, None, "1", 0.04), (10.0, True, None, "2", 0.08), (10.0, True, None, "3", 0.12)]
GRADE_ORDER = ("T", "1", "2", "3")
#: Wire of this many mm and more is coiled hot.
WIRE_THRESHOLD = 8.0
COLD_STANDARD, HOT_STANDARD = "GB/T 1239.2-2009", "GB/T 23934-2015"


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def diameters(wide: DataFrame) -> DataFrame:
    """Outer, inner and mean from whichever pair is there; given values stay."""
    inner = F.coalesce("inner_diameter", col_outer() - 2 * col_wire(), 2 * F.col("mean_diameter") - col_outer())
    out = wide.withColumn("outer_diameter", F.coalesce(col_outer(), F.col("inner_diameter") + 2 * col_wire(), F.col("mean_diameter") + col_wire()))
    return out.withColumn("inner_diameter", inner).withColumn("mean_diameter", F.coalesce("mean_diameter", (F.col("outer_diameter") + F.col("inner_diameter")) / 2))


def diameter_link(wide: DataFrame, driver: Column) -> DataFrame:
    """The other diameters recomputed from the driver (outer, inner or mean) and the wire; stale if that is not positive."""
    outer = F.when(driver == "outer", col_outer()).when(driver == "inner", F.col("inner_diameter") + 2 * col_wire()).otherwise(F.col("mean_diameter") + col_wire())
    return wide.select("review_id", driver.alias("driver"), F.round(outer, 9).alias("outer_diameter"), F.round(outer - col_wire(), 9).alias("mean_diameter"), F.round(outer - 2 * col_wire(), 9).alias("inner_diameter"), (F.coalesce(outer - 2 * col_wire(), F.lit(0.0)) <= 0).alias("stale"))


def derived(wide: DataFrame) -> DataFrame:
    return wide.select("review_id", col_mean().alias("mean_diameter"), F.round(col_mean() / col_wire(), 9).alias("spring_index"), F.round(col_free() / col_mean(), 9).alias("slenderness"))


def derived_active() -> Column:
    """Active coils by type and end condition, null where they would be guessed: compression springs with closed ends lose the support
    coils of both ends, with open ends one coil if ground and none if not; extension and torsion springs lose none.

    Columns: spring_type, total_coils, end_type (closed, open), end_mode (ground, not_ground), support_coils (of one end)."""
    support = F.when(F.col("support_coils") > 0, F.col("support_coils"))
    opened = F.when(F.col("end_mode") == "ground", col_coils() - 1).when(F.col("end_mode") == "not_ground", col_coils())
    compression = F.when(F.col("end_type") == "closed", col_coils() - 2 * support).when(F.col("end_type") == "open", opened)
    return positive(F.when(F.col("spring_type") == "compression_spring", compression).when(F.col("spring_type").isin("extension_spring", "torsion_spring"), col_coils()))


def active_coils() -> Column:
    """Those of the drawing (`drawn_active`) where there are any, else derived ones."""
    return F.coalesce("drawn_active", derived_active())


def support_coils(wide: DataFrame) -> DataFrame:
    """review_id, support_coils of one end = (total - active) / 2, reason: from independent counts of closed, symmetric ends alone, so
    that a count derived from support coils never gives these back. Columns besides: drawn_active, uneven (ends differ; may be null)."""
    value = (col_coils() - F.col("drawn_active")) / 2
    reason = (
        F.when(F.coalesce("uneven", F.lit(False)), "asymmetric").when(~F.coalesce(F.col("end_type") == "closed", F.lit(False)), "end_type")
        .when(F.col("drawn_active").isNull() | col_coils().isNull(), "not_independent").when(value <= 0, "not_positive").otherwise("")
    )
    return wide.select("review_id", F.when(reason == "", value).alias("support_coils"), reason.alias("reason"))


def end_geometry(wide: DataFrame, tolerance: float = 1e-9, agreement: float = 1e-4) -> DataFrame:
    """wide with model (closed, open, unknown), offset (of closed ends), reason (empty if pitch and solid height can be told),
    pitch and nominal_solid. Columns besides derived_active()'s: free_length, wire_diameter, drawn_active."""
    c, none = F.col, F.lit(None).cast("double")
    both = 2 * c("support_coils")
    offset = none
    for grinding, table in END_OFFSETS.items():
        for count, a in table.items():
            offset = F.when((c("end_mode") == grinding) & (F.abs(both - count) <= tolerance), F.lit(a)).otherwise(offset)
    model = F.when(c("end_type") == "closed", "closed").when(c("end_type") == "open", "open").otherwise("unknown")
    wide = wide.withColumn("n", active_coils()).withColumn("model", model).withColumn("offset", F.when(model == "closed", offset))
    ground = c("end_mode") == "ground"
    reason = (
        F.when((c("model") == "unknown") | c("end_mode").isNull(), "end_condition")
        .when((c("model") == "closed") & c("offset").isNull(), "support_coils")
        .when((c("model") == "closed") & (F.abs(col_coils() - c("n") - both) > agreement), "counts_disagree")
        .when((c("model") == "open") & (col_coils().isNull() | c("n").isNull()), "counts_missing")
        .when((c("model") == "open") & (F.abs(c("n") - col_coils() + F.when(ground, 1).otherwise(0)) > agreement), "counts_disagree")
        .otherwise("")
    )
    wide = wide.withColumn("reason", reason)
    told = c("reason") == ""
    closed = c("model") == "closed"
    raised = F.when(closed, (col_free() - c("offset") * col_wire()) / positive(c("n"))).otherwise(F.when(ground, col_free()).otherwise(col_free() - col_wire()) / positive(col_coils()))
    solid = F.when(closed, col_wire() * (c("n") + c("offset"))).otherwise(col_wire() * (col_coils() + F.when(ground, 0).otherwise(1)))
    pitch = F.when(told, raised)
    wide = wide.withColumn("pitch", pitch).withColumn("nominal_solid", F.round(F.when(told, solid), 9))
    flat = c("pitch") <= col_wire()  # coils would lie in each other
    return wide.withColumn("pitch_reason", F.when(flat, "pitch_not_above_wire").otherwise(c("reason"))).withColumn("pitch", F.round(F.when(~flat, c("pitch")), 9))


def newtons(force: Column, unit: Column) -> Column:
    """A force in newtons, null for an unknown unit; no unit is N."""
    name = F.lower(F.trim(F.coalesce(unit, F.lit("N"))))
    return force * F.coalesce(*(F.when(name == k, F.lit(v)) for k, v in FORCE_UNITS.items()))


def millimetres(length: Column, unit: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(unit, F.lit("mm"))))
    return length * F.coalesce(*(F.when(name == k, F.lit(v)) for k, v in LENGTH_UNITS.items()))


def work_stress(points: DataFrame) -> DataFrame:
    """review_id, seq, solid, force_n, stress = 8 P D K / (pi d^3), estimated, reason of each load point, one row a point.

    A given force counts in its unit; a point without one is estimated from rate * (free length - height), where the height must lie
    between the solid height and the free length. Several solid points of a review are ambiguous.
    points: review_id, seq, solid, force, force_unit, height, height_unit, and of the review free_length, solid_height, rate, mean, wire_diameter."""
    c = F.col
    given = c("force").isNotNull()
    own = newtons(c("force"), c("force_unit"))
    height = F.when(c("solid"), c("solid_height")).otherwise(millimetres(c("height"), c("height_unit")))
    outside = (height > col_free()) | F.coalesce(height < c("solid_height"), F.lit(False)) | (c("solid") & (height >= col_free()))
    several = c("solid") & (F.sum(c("solid").cast("int")).over(Window.partitionBy("review_id")) > 1)
    reason = (
        F.when(several, "ambiguous").when(given & (c("force") < 0), "negative_force").when(given & own.isNull(), "unknown_unit").when(given, "")
        .when(height.isNull(), "no_height").when(outside, "height_out_of_range").when(c("rate").isNull() | col_free().isNull(), "no_rate").otherwise("")
    )
    index = c("mean") / positive(col_wire())
    force = F.when(reason == "", F.when(given, own).otherwise(c("rate") * (col_free() - height)))
    stress = 8 * force * positive(c("mean")) * curvature(F.when(index > 1, index)) / (F.pi() * F.pow(positive(col_wire()), F.lit(3)))
    out = points.select("review_id", "seq", "solid", (~given).alias("estimated"), force.alias("force_n"), stress.alias("stress"), reason.alias("reason"))
    return out.withColumn("reason", F.when((c("reason") == "") & c("stress").isNull(), "no_geometry").otherwise(c("reason")))


def modulus(material: str = "material", table: dict[str, float] = MODULUS) -> Column:
    """Of a material by its standard name, whatever its case; null for one that the table lacks."""
    return F.coalesce(*(F.when(F.lower(F.trim(F.col(material))) == name.lower(), F.lit(g)) for name, g in table.items()))


def stiffness(table: dict[str, float] = MODULUS) -> Column:
    """G d^4 / (8 D^3 n) of positive inputs, else null."""
    return F.round(modulus(table=table) * F.pow(positive(col_wire()), F.lit(4)) / (8 * F.pow(positive(col_mean()), F.lit(3)) * positive(active_coils())), 9)


def stiffness_status(table: dict[str, float] = MODULUS) -> Column:
    """calculated, missing_context, or material_not_configured if all but the modulus is there."""
    blank = F.coalesce(F.trim("material") == "", F.lit(True))
    missing = positive(col_wire()).isNull() | positive(col_mean()).isNull() | positive(active_coils()).isNull() | blank
    return F.when(missing, "missing_context").when(modulus(table=table).isNull(), "material_not_configured").otherwise("calculated")


def stale_rate(rates: DataFrame, recorded: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """review_id, recorded, rate, state of a recorded rate against the one calculated now: absent, inputs_missing, stale or current."""
    c = F.col
    far = F.abs(c("recorded") - c("rate")) > tolerance * F.greatest(F.abs("recorded"), F.abs("rate"))
    state = F.when(c("recorded").isNull(), "absent").when(c("rate").isNull(), "inputs_missing").when(far, "stale").otherwise("current")
    return rates.select("review_id", "rate").join(recorded, "review_id", "left").select("review_id", "recorded", "rate", state.alias("state"))


def solid_height() -> Column:
    """n * dmax for ground ends, (n + 1.5) * dmax otherwise."""
    thick = col_wire() + F.col("tol_upper") / 100
    return F.round(F.when(F.col("end_mode") == "ground", col_coils() * thick).when(F.col("end_mode") == "not_ground", (col_coils() + 1.5) * thick), 9)


def curvature(index: Column) -> Column:
    """(4C - 1) / (4C - 4) + 0.615 / C."""
    return (4 * index - 1) / (4 * index - 4) + F.lit(0.615) / index


def reconciled(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """overwrite automatic rows, keep human rows and store a candidate if inputs differ, keep what is equal, insert what is new."""
    o = old.select(key, F.col("value").alias("old_value"), "human")
    both = o.join(new.select(key, F.col("value").alias("new_value")), key, "full")
    same = F.abs(F.col("old_value") - F.col("new_value")) <= 1e-9
    action = F.when(F.col("old_value").isNull(), "insert").when(F.col("new_value").isNull(), "stale").when(same, "keep").when(F.col("human"), "candidate").otherwise("overwrite")
    return both.select(key, action.alias("action"), F.when(action.isin("insert", "overwrite"), F.col("new_value")).otherwise(F.col("old_value")).alias("value"))


def band_lookup(rows: DataFrame, bands: DataFrame, at: str, base: str, key: str = "review_id") -> DataFrame:
    """rows (unique by key) with tolerance = max(factor * base, minimum) of the band of the row's grade that holds `at`, null without one."""
    found = interval_join(rows.select(key, "grade", at, base), bands, at, "c_min", "c_max", ["grade"], low_open=~F.col("include_min"))
    tolerance = F.round(F.greatest(F.col("factor") * F.col(base), "minimum"), 9)
    return rows.join(found.select(key, tolerance.alias("tolerance")), key, "left").select(*rows.columns, "tolerance")


def steps_lookup(rows: DataFrame, steps: list[tuple[float, float, float]], at: str) -> DataFrame:
    """The tolerance of the step (least, most] that holds `at`."""
    out = F.lit(None).cast("double")
    for lo, hi, t in reversed(steps):
        out = F.when((F.col(at) > lo) & (F.col(at) <= hi), F.lit(t)).otherwise(out)
    return rows.withColumn("tolerance", out)


def violations(checks: list[tuple[str, Column]]) -> Column:
    """Names of the failing checks, joined; empty if none. A null check is missing."""
    return F.array_join(F.array_compact(F.array(*(F.when(c.isNull(), F.lit(f"missing:{n}")).when(~c, F.lit(n)) for n, c in checks))), ",")


def form_limits(wide: DataFrame, shares: dict[int, float] = PERPENDICULARITY, straight_from: float = STRAIGHT_FROM, set_share: float = PERMANENT_SET) -> DataFrame:
    """review_id, perpendicularity (by grade), straightness (half of it, for slender springs alone), permanent_set, review (the parties
    agree on perpendicularity of slender springs)."""
    share = F.coalesce(*(F.when(F.col("grade") == g, F.lit(x)) for g, x in shares.items()))
    slender = F.coalesce(col_free() / positive(col_mean()) >= straight_from, F.lit(False))
    lean = share * col_free()
    return wide.select("review_id", F.round(lean, 4).alias("perpendicularity"), F.when(slender, F.round(lean / 2, 4)).alias("straightness"), F.round(col_free() * set_share, 4).alias("permanent_set"), slender.alias("review"))


def hot_scope(wide: DataFrame, limits: dict[str, float] = HOT_SCOPE) -> DataFrame:
    """wide with missing (fields), violations (of seven checks, each only where its inputs are there) and scope: outside_scope,
    missing_context or applicable. Columns: wire_diameter, mean, free_length, active, pitch."""
    d, mean, free, n, pitch, r = col_wire(), F.col("mean"), col_free(), F.col("active"), F.col("pitch"), limits
    checks = [
        ("wire", ~d.between(r["wire_min"], r["wire_max"])), ("mean", ~((mean > 0) & (mean <= r["mean_max"]))), ("height", ~((free > 0) & (free <= r["height_max"]))),
        ("index", (d > 0) & ~(mean / d).between(r["index_min"], r["index_max"])), ("slenderness", (mean > 0) & ~(free / mean).between(r["slenderness_min"], r["slenderness_max"])),
        ("active", n < r["active_min"]), ("pitch", ~((pitch > 0) & (pitch <= r["pitch_mean_max"] * mean))),
    ]
    listed = lambda pairs: F.array_join(F.array_compact(F.array(*(F.when(x, F.lit(name)) for name, x in pairs))), ",")
    missing = listed([(name, F.col(name).isNull()) for name in ("wire_diameter", "mean", "free_length", "active", "pitch")])
    out = wide.withColumn("violations", listed(checks)).withColumn("missing", missing)
    return out.withColumn("scope", F.when(F.col("violations") != "", "outside_scope").when(F.col("missing") != "", "missing_context").otherwise("applicable"))


def hot_table(spark, limits: list[tuple] = HOT_LIMITS) -> DataFrame:
    return spark.createDataFrame(limits, "kind string, height_min double, height_max double, limit_grade string, factor double, minimum double")


def hot_limits(items: DataFrame, table: DataFrame) -> DataFrame:
    """items with limit_grade and limit_mm of every grade: max(factor * base, minimum), base the mean diameter, the free length or the
    load's nominal, a load's minimum a deflection times the rate. Items out of the standard's scope have none.
    items: kind, free_length, mean, nominal, rate, scope."""
    fits = items.where((F.col("scope") == "applicable") & ((F.col("kind") != "load") | ((F.col("nominal") > 0) & (F.col("rate") > 0))))
    found = interval_join(fits, table, "free_length", "height_min", "height_max", ["kind"], low_open=F.lit(True))
    base = F.when(F.col("kind") == "diameter", F.col("mean")).when(F.col("kind") == "free_length", col_free()).otherwise(F.col("nominal"))
    least = F.col("minimum") * F.when(F.col("kind") == "load", F.col("rate")).otherwise(1.0)
    return found.withColumn("limit_mm", F.round(F.greatest(F.col("factor") * base, least), 4)).drop("height_min", "height_max", "factor", "minimum")


def cold_limits(items: DataFrame, spark) -> DataFrame:
    """items with limit_grade and limit_mm of every cold-coiled grade: diameters and lengths by the spring index, loads and stiffness by
    the active coils. items: kind, spring_index, active, nominal."""
    bands = spark.createDataFrame(COLD_LIMITS, "kind string, c_min double, closed boolean, c_max double, limit_grade string, factor double, minimum double")
    by_index = interval_join(items.where(F.col("kind").isin("diameter", "free_length")), bands, "spring_index", "c_min", "c_max", ["kind"], low_open=~F.col("closed"))
    by_index = by_index.withColumn("limit_mm", F.round(F.greatest(F.col("factor") * F.col("nominal"), "minimum"), 4)).drop("c_min", "c_max", "closed", "factor", "minimum")
    ratios = spark.createDataFrame(COIL_RATIOS, "n_min double, n_open boolean, n_max double, limit_grade string, share double")
    by_coils = interval_join(items.where(F.col("kind").isin("load", "stiffness")), ratios, "active", "n_min", "n_max", [], low_open=F.col("n_open"))
    by_coils = by_coils.withColumn("limit_mm", F.round(F.col("nominal") * F.col("share"), 4)).drop("n_min", "n_open", "n_max", "share")
    return by_index.unionByName(by_coils)


def grade_inference(items: DataFrame, limits: DataFrame, key: list[str]) -> DataFrame:
    """items with grade, status and stricter_than_first: the strictest grade whose limits hold the item's upper and lower deviation, at
    nine digits. Statuses in order: drawing_grade (explicit), generated_tolerance, missing_tolerance, missing_context (no nominal),
    invalid_tolerance (half of one, or upside down), matched, outside_grades, missing_context (no limits).

    items (unique by key): nominal, upper, lower, percent (of loads alone), explicit, generated; limits: key, limit_grade, limit_mm."""
    c = F.col
    by_percent = (c("kind") == "load") & c("upper").isNull() & c("lower").isNull() & (c("percent") >= 0)
    part = c("nominal") * c("percent") / 100
    items = items.withColumn("hi", F.when(by_percent, part).otherwise(c("upper"))).withColumn("lo", F.when(by_percent, 0 - part).otherwise(c("lower")))
    order = F.array_position(F.array(*map(F.lit, GRADE_ORDER)), c("limit_grade"))
    holds = (F.round(c("hi") - c("limit_mm"), 9) <= 0) & (F.round(c("lo") + c("limit_mm"), 9) >= 0)
    met = limits.join(items.select(*key, "hi", "lo"), key).groupBy(*key).agg(
        F.min_by(F.when(holds, c("limit_grade")), F.when(holds, order)).alias("held"), F.count("*").alias("n_limits"), F.max(F.when(c("limit_grade") == "1", c("limit_mm"))).alias("first")
    )
    out = items.join(met, key, "left")
    none = c("upper").isNull() & c("lower").isNull() & c("percent").isNull()
    invalid = c("hi").isNull() | c("lo").isNull() | (c("lo") > c("hi"))
    status = (
        F.when(c("explicit").isNotNull(), "drawing_grade").when(F.coalesce("generated", F.lit(False)), "generated_tolerance").when(none, "missing_tolerance").when(c("nominal").isNull(), "missing_context")
        .when(invalid, "invalid_tolerance").when(c("held").isNotNull(), "matched").when(c("n_limits") > 0, "outside_grades").otherwise("missing_context")
    )
    grade = F.when(status == "drawing_grade", c("explicit")).when(status == "matched", c("held"))
    strict = (grade == "1") & (status == "matched") & (c("hi") < c("first")) & (c("lo") > 0 - c("first"))
    return out.select(*key, grade.alias("grade"), status.alias("status"), F.coalesce(strict, F.lit(False)).alias("stricter_than_first"))


def grade_overall(inferred: DataFrame, group: list[str], default: str = "2") -> DataFrame:
    """The strictest grade of a group's items (the default where none has one), whether it was found, and whether every item has one."""
    order = F.array_position(F.array(*map(F.lit, GRADE_ORDER)), F.col("grade"))
    out = inferred.groupBy(*group).agg(F.min_by("grade", F.when(F.col("grade").isNotNull(), order)).alias("g"), F.count("grade").alias("n_graded"), F.count("*").alias("n_items"))
    return out.select(*group, F.coalesce("g", F.lit(default)).alias("grade"), F.col("g").isNull().alias("is_default"), "n_graded", (F.col("n_graded") == F.col("n_items")).alias("complete"))


def input_snapshot(rows: DataFrame, key: str, order: list[str], system: Column) -> DataFrame:
    """At each revision the last value that no system wrote."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("independent", F.last(F.when(~system, F.col("value")), ignorenulls=True).over(w))


# Feature values that no supported standard covers, in order of precedence.
UNSUPPORTED = (("spring_family", ("disc", "wave", "rubber", "gas")), ("spring_shape", ("conical", "barrel", "hourglass")), ("wire_section", ("rectangular", "square")), ("pitch_type", ("variable",)))


def select_standard(rows: DataFrame) -> DataFrame:
    """review_id, standard, status, confidence, source, need_review, n_conflicts: the first of what decides: spring type, a feature out of
    scope, the drawing's standard number (not a material's), the wire, a recognized method, an inferred one. Methods of other evidence
    that disagree lower the choice to review.

    rows: review_id, spring_type, spring_family, spring_shape, wire_section, pitch_type, feature_confidence, standard_no, standard_is_material,
    wire_diameter (mm), wire_confidence, wire_review, method, method_confidence, inferred_method, inferred_confidence, inferred_review,
    inferred_evidence, text_method; all but the first may be null."""
    number = F.when(~F.coalesce("standard_is_material", F.lit(False)), F.nullif(F.trim("standard_no"), F.lit("")))
    cold, hot = number.rlike(r"(?i)GB\s*/?\s*T\s*1239\.?2"), number.rlike(r"(?i)GB\s*/?\s*T\s*23934")
    wire = F.when(col_wire() >= WIRE_THRESHOLD, "hot_coiled").when(col_wire() > 0, "cold_coiled")
    known = lambda c: F.when(F.col(c).isin("cold_coiled", "hot_coiled"), F.col(c))
    others = F.array_distinct(F.array_compact(F.array(known("method"), known("inferred_method"), known("text_method"))))
    against = lambda m: F.size(F.filter(others, lambda x: x != m))
    standard = lambda m: F.when(m == "hot_coiled", HOT_STANDARD).otherwise(COLD_STANDARD)

    def choice(standard_: Column, status: Column | str, confidence: Column | float, source: Column | str, review: Column | bool, conflicts: Column | int = 0) -> Column:
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        given = F.coalesce(as_column(confidence).cast("double"), F.lit(0.0))
        return F.struct(standard_.alias("standard"), as_column(status).alias("status"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(0.99), given)), 3).alias("confidence"), as_column(source).alias("source"), as_column(review).alias("need_review"), as_column(conflicts).cast("long").alias("n_conflicts"))

    none = F.lit(None).cast("string")
    outside = F.coalesce(*(F.when(F.lower(F.trim(f)).isin(*values), F.lit(f"spring_features.{f}")) for f, values in UNSUPPORTED))
    own = F.when(cold, "cold_coiled").otherwise("hot_coiled")
    by_number = against(own) + F.when(wire.isNotNull() & (wire != own), 1).otherwise(0)
    given = F.coalesce("wire_confidence", F.lit(0.84))
    unsure = F.coalesce("wire_review", F.lit(False)) | (given < 0.75)
    wire_confidence = F.least(F.lit(0.95), F.when(unsure, F.least(given, F.lit(0.74))).otherwise(given) + F.when(F.array_contains(others, wire), 0.05).otherwise(0.0))
    wire_review = unsure | (against(wire) > 0)
    status = lambda review: F.when(review, "need_review").otherwise("applicable")
    recognized = F.coalesce("method_confidence", F.lit(0.7))
    guessed = F.coalesce("inferred_confidence", F.lit(0.0))
    guess_review = F.coalesce("inferred_review", F.lit(False)) | (guessed < 0.78) | ~F.coalesce("inferred_evidence", F.lit(False))
    out = (
        F.when(F.coalesce(F.col("spring_type") != "compression_spring", F.lit(True)), choice(none, "not_applicable", 0.0, "spring_type", False))
        .when(outside.isNotNull(), choice(none, "not_applicable", F.coalesce("feature_confidence", F.lit(0.7)), outside, True))
        .when(cold | hot, choice(standard(own), status(by_number > 0), 0.96, "drawing_standard_no", by_number > 0, by_number))
        .when(number.isNotNull(), choice(number, "not_applicable", 0.88, "drawing_standard_no", True))
        .when(wire.isNotNull(), choice(standard(wire), status(wire_review), wire_confidence, "wire_diameter_threshold", wire_review, against(wire)))
        .when(known("method").isNotNull(), choice(standard(F.col("method")), status(recognized < 0.78), recognized, "recognized_feature", recognized < 0.78))
        .when(known("inferred_method").isNotNull(), choice(standard(F.col("inferred_method")), status(guess_review), guessed, "llm_inference", guess_review))
        .otherwise(choice(none, "need_review", 0.0, "insufficient_context", True))
    )
    return rows.select("review_id", out.alias("s")).select("review_id", "s.*")
