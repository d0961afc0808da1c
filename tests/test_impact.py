"""Simulated changes, worked by hand."""

from pyspark.sql import functions as F

from factforge.operators import impact

REVIEW = "review_id long, spring_type string, wire_diameter double, outer_diameter double, inner_diameter double, mean_diameter double, free_length double, total_coils double, active_coils double, support_coils double, solid_height double, wire_upper double, end_mode string, has_points boolean"
PATCH = "review_id long, seq long, field string, number double, word string"
SPRING = ("compression_spring", 2.0, 22.0, 18.0, 20.0, 50.0, 10.0, 8.0, 1.0, None, None, "ground", True)


def run(spark, patches, stored=(), points=(), spring=SPRING):
    ids = sorted({p[0] for p in patches} | {99})
    reviews = spark.createDataFrame([(i, *spring) for i in ids], REVIEW)
    stored = spark.createDataFrame(list(stored), "review_id long, seq long, rule_id string, severity string")
    points = spark.createDataFrame(list(points), "review_id long, seq long, height double, force double")
    out = impact.simulate(reviews, spark.createDataFrame(patches, PATCH), points, stored, F.lit(True), F.col("height"))
    got = {}
    for r in out.collect():
        got.setdefault(r.review_id, set()).add((r.kind, r.name, r.seq) if r.before is None and r.after is None and r.before_word is None and r.after_word is None else (r.kind, r.name, r.before, r.after) if r.before_word is None and r.after_word is None else (r.kind, r.name, r.before_word, r.after_word))
    return got


def test_changes_issues_and_status(spark):
    patches = [
        (1, 1, "outer_diameter", 24.0, None),  # linked: mean 22, inner 20
        (2, 1, "outer_diameter", 24.0, None), (2, 2, "wire_diameter", 2.5, None),  # two of the group: nothing linked
        (3, 1, "free_length", 19.0, None),  # not above 10 coils of 2 mm; below the point's height
        (4, 1, "free_length", 60.0, None), (4, 2, "free_length", 50.0, None),  # the last one changes nothing
        (5, 1, "colour", 1.0, None), (5, 2, "free_length", None, None), (5, 3, "end_mode", None, " "),
        (6, 1, "end_mode", None, "not_ground"), (7, 1, "total_coils", 60.0, None), (8, 1, "inner_diameter", -5.0, None),
    ]
    stored = [(3, None, "SPRING-GEO-COIL-COUNT", "blocked"), (3, None, "GBT1239.2-SLENDERNESS", "warning"), (7, None, "SPRING-GEO-COIL-COUNT", "blocked"), (99, None, "GBT1239.2-SLENDERNESS", "warning")]
    got = run(spark, patches, stored, [(3, 1, 30.0, 5.0), (3, 2, 19.0, 5.0), (1, 1, 30.0, 5.0)])
    assert got[1] == {("direct", "outer_diameter", 22.0, 24.0), ("direct", "inner_diameter", 18.0, 20.0), ("direct", "mean_diameter", 20.0, 22.0), ("derived", "outer_diameter", 22.0, 24.0), ("derived", "inner_diameter", 18.0, 20.0), ("derived", "mean_diameter", 20.0, 22.0), ("derived", "spring_index", 10.0, 11.0), ("derived", "slenderness_ratio", 2.5, round(50 / 22, 9)), ("status", "ready", None)}
    assert ("direct", "inner_diameter", 18.0, 20.0) not in got[2] and ("introduced", "SPRING-GEO-DIAMETER-CONSISTENCY", None) in got[2] and ("status", "warning", None) in got[2]
    assert ("derived", "solid_height", 20.0, 25.0) in got[2]
    assert got[3] == {("direct", "free_length", 50.0, 19.0), ("derived", "slenderness_ratio", 2.5, 0.95), ("introduced", "SPRING-LOAD-FREE-OVER-SOLID", None), ("introduced", "SPRING-LOAD-HEIGHT-OVER-FREE", 1), ("unchanged", "SPRING-GEO-COIL-COUNT", None), ("resolved", "GBT1239.2-SLENDERNESS", None), ("status", "blocked", None)}
    assert got[4] == {("status", "ready", None)} and got[5] == {("status", "not_applicable", None)}
    assert got[6] == {("direct", "end_mode", "ground", "not_ground"), ("derived", "solid_height", 20.0, 23.0), ("status", "ready", None)}
    assert {("resolved", "SPRING-GEO-COIL-COUNT", None), ("introduced", "GBT1239.2-SCOPE-TOTAL-COILS", None), ("status", "blocked", None)} <= got[7]  # 60 coils stand higher than 50 mm
    assert ("direct", "inner_diameter", 18.0, -5.0) in got[8] and ("direct", "outer_diameter", 22.0, -3.0) not in got[8] and ("introduced", "SPRING-GEO-INNER_DIAMETER", None) in got[8]
    assert 99 not in got
    assert run(spark, [(1, 1, "mean_diameter", 10.0, None)], spring=("torsion_spring", *SPRING[1:]))[1] >= {("direct", "mean_diameter", 20.0, 10.0), ("derived", "outer_diameter", 22.0, 12.0)}


def test_every_rule_names_all_that_it_reads(spark):
    """Each field changed alone, and all pairs of states, give the issues of a full run."""
    from factforge.operators import rules

    values = {"wire_diameter": (2.0, -1.0, 9.0), "outer_diameter": (22.0, 3.0), "inner_diameter": (18.0, None, -2.0), "mean_diameter": (20.0, None, 0.0), "free_length": (50.0, 150.0, 5.0), "total_coils": (10.0, 60.0, -1.0), "active_coils": (8.0, None, 12.0, 0.0), "support_coils": (1.0, 2.0), "solid_height": (None, 55.0), "wire_upper": (None, 4.0), "end_mode": ("ground", "not_ground", None)}
    fields, base = list(values), dict(zip(REVIEW.replace(",", "").split()[2::2], SPRING))
    states = [{**base, f: v, **extra} for f in fields for v in values[f] for extra in ({}, {"end_mode": None}, {"mean_diameter": None, "inner_diameter": None})]
    before = spark.createDataFrame([(i, *(s[c] for c in base)) for i, s in enumerate(states * len(fields))], REVIEW)
    n = len(states)
    patches = [(i, 1, f, *((None, v) if f == "end_mode" else (v, None))) for i, f, v in ((k * n + j, f, values[f][(j + 1) % len(values[f])]) for k, f in enumerate(fields) for j in range(n)) if v is not None]
    patches = spark.createDataFrame(patches, PATCH)
    points = before.selectExpr("review_id", "explode(array(1L, 2L)) AS seq").selectExpr("*", "30D * seq - 10 AS height", "5D AS force")

    def every(reviews):
        own = rules.issues(reviews, ["review_id"], rules.geometry_checks(F.lit(True))).withColumn("seq", F.lit(None).cast("long"))
        at = points.join(reviews.select("review_id", "free_length", rules.least_free_length().alias("least_free_length")), "review_id")
        return own.unionByName(rules.issues(at, ["review_id", "seq"], rules.point_checks(F.col("height"), F.col("force"))))

    rows = lambda df: {(r.review_id, r.seq, r.rule_id, r.severity) for r in df.collect()}
    after = impact.patched(before, patches).select("new.*")
    old, new = rows(every(before.join(patches.select("review_id"), "review_id", "left_semi"))), rows(every(after))
    got = {k: set() for k in ("introduced", "resolved", "unchanged")}
    for r in impact.simulate(before, patches, points, every(before), F.lit(True), F.col("height")).where("kind in ('introduced', 'resolved', 'unchanged')").collect():
        got[r.kind].add((r.review_id, r.seq, r.name, r.severity))
    assert got == {"introduced": new - old, "resolved": old - new, "unchanged": old & new} and all(got.values())


def test_simulation_sends_no_growing_table_to_every_task(spark):
    reviews, patches = spark.createDataFrame([(1, *SPRING)], REVIEW), spark.createDataFrame([(1, 1, "free_length", 19.0, None)], PATCH)
    stored, points = spark.createDataFrame([], "review_id long, seq long, rule_id string, severity string"), spark.createDataFrame([(1, 1, 30.0, 5.0)], "review_id long, seq long, height double, force double")
    df = impact.simulate(reviews, patches, points, stored, F.lit(True), F.col("height"))
    assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in impact.patched(reviews, patches)._jdf.queryExecution().sparkPlan().toString()
