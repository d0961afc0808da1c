"""Chains and closures as rounds of joins up to a fixed point. The state of each round is written to the shared folder, so plans don't grow with the rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factforge.operators.calc import millimetres
from factforge.sources.tables import durable


def with_bases(points: DataFrame) -> DataFrame:
    """points with base, the one base point of each incremental point: that of base_seq, else the only one of base_label (letter case and
    outer blanks aside); of the same page and scope, or none."""
    c, key = F.col, lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    own = points.select("review_id", c("seq").alias("b_seq"), c("page").alias("b_page"), c("scope").alias("b_scope"), key("label").alias("b_label"))
    open_ = points.where("kind = 'incremental_deflection'").select("review_id", "seq", "page", "scope", "base_seq", key("base_label").alias("b_label"))
    by_seq = open_.where("base_seq is not null").withColumn("b_seq", c("base_seq")).drop("b_label").join(own, ["review_id", "b_seq"])
    by_label = open_.where("base_seq is null").join(own, ["review_id", "b_label"])
    same = c("page").eqNullSafe(c("b_page")) & c("scope").eqNullSafe(c("b_scope"))
    found = by_seq.where(same).select("review_id", "seq", "b_seq").unionByName(by_label.where(same).select("review_id", "seq", "b_seq"))
    found = found.groupBy("review_id", "seq").agg(F.count("*").alias("n"), F.min("b_seq").alias("base")).where("n = 1").drop("n")
    return points.join(found, ["review_id", "seq"], "left")


def height_chain(points: DataFrame) -> DataFrame:
    """review_id, seq, base, resolved (mm), reason (ok, unverified, invalid_distance, no_height, no_free_length, base_not_unique,
    base_unresolved, out_of_range) of each load point: a height of its own (no kind), the drawing's (absolute_height), free length less a
    deflection (free_deflection), or a base point's height less a further one (incremental_deflection). Heights are positive, and none but
    an own or absolute one exceeds the free length. Points in or behind a cycle, or behind a point without a height, have none.

    points: review_id, seq (unique in a review), page, scope, label, kind, value, unit, verified, base_seq, base_label, height, height_unit,
    free_length (of the review, mm). Every point doubles the way to its base in each round, so a chain of n points takes log2(n)
    rounds; what is open after that many is behind a cycle. Distances are not negative, so heights fall along a chain: its points are
    in range if the first is not above the free length and this one is positive."""
    c = F.col
    kind, given = c("kind"), c("kind").isNull()
    distance, step = millimetres(c("value"), c("unit")), F.coalesce(c("kind") == "incremental_deflection", F.lit(False))
    own = F.when(given, millimetres(c("height"), c("height_unit"))).when(kind == "absolute_height", distance).when(kind == "free_deflection", c("free_length") - distance)
    known = kind.isin("absolute_height", "free_deflection", "incremental_deflection")
    early = (
        F.when(given, F.when(F.coalesce(own > 0, F.lit(False)), "ok").otherwise("no_height")).when(~F.coalesce("verified", F.lit(False)) | ~known, "unverified")
        .when(distance.isNull() | (distance < 0), "invalid_distance").when((kind == "free_deflection") & ~F.coalesce(c("free_length") > 0, F.lit(False)), "no_free_length")
        .when(step & c("base").isNull(), "base_not_unique").when(step, "open").when(own <= 0, "out_of_range").otherwise("ok")
    )
    p = with_bases(points).withColumn("early", early)
    root = c("early") != "open"
    none = F.lit(None).cast("double")
    state = durable(p.select("review_id", "seq", "base", "free_length", "early", F.when(~root, distance).alias("own"), F.when(root, c("seq")).otherwise(c("base")).alias("at"), F.when(root, 0.0).otherwise(distance).alias("down"),
        F.when(root, none).otherwise(distance).alias("first"), F.when(root, 0).otherwise(1).cast("long").alias("hops"), F.when(c("early") == "ok", own).alias("height"), root.alias("done")))
    most = state.groupBy("review_id").count().agg(F.max("count").alias("n")).first().n or 0
    ended, going = state.where("done"), state.where("not done")  # a round writes only the points that were open before it
    for _ in range(most.bit_length()):
        if going.isEmpty():
            break
        up = ended.unionByName(going).select("review_id", c("seq").alias("at"), c("at").alias("next"), c("down").alias("more"), c("first").alias("nearer"), c("hops").alias("steps"), c("height").alias("top"), c("done").alias("ends"))
        moved = going.drop("height", "done").join(up, ["review_id", "at"])
        moved = durable(moved.select("review_id", "seq", "base", "free_length", "early", "own", c("next").alias("at"), (c("down") + c("more")).alias("down"), F.coalesce("nearer", "first").alias("first"), (c("hops") + c("steps")).alias("hops"), c("top").alias("height"), c("ends").alias("done")))
        ended, going = ended.unionByName(moved.where("done")), moved.where("not done")
    state = ended.unionByName(going)
    value = F.round(c("height") - c("down"), 12)
    above = (c("free_length") > 0) & (F.round(c("height") - c("first"), 12) > c("free_length"))
    reason = (
        F.when(c("early") != "open", c("early")).when(~c("done") | c("height").isNull(), "base_unresolved").when(above & (c("hops") > 1), "base_unresolved").when(above, "out_of_range")
        .when(value > 0, "ok").when((c("hops") == 1) | (F.round(value + c("own"), 9) > 0), "out_of_range").otherwise("base_unresolved")
    )
    return state.select("review_id", "seq", "base", F.when(reason == "ok", value).alias("resolved"), reason.alias("reason"))


def secant_rate(heights: DataFrame, points: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """review_id, seq, rate, warning: force over the further deflection between a point and its base, both in N. not_increasing unless it is
    positive, outside_band if it leaves the drawing's own rate and its deviations, by more than 1e-9; else empty.

    heights: review_id, seq, base, resolved; points: review_id, seq, force (N) and distance (mm); declared: review_id, rate_value, rate_upper,
    rate_lower, where the drawing states all three in N/mm."""
    c = F.col
    base = points.select("review_id", c("seq").alias("base"), c("force").alias("base_force"))
    both = heights.where("resolved is not null and base is not null").join(points, ["review_id", "seq"]).join(base, ["review_id", "base"]).where("distance > 0 and force is not null and base_force is not null")
    rate = F.round((c("force") - c("base_force")) / c("distance"), 8)
    if declared is None:
        return both.select("review_id", "seq", rate.alias("rate"), F.when(rate <= 0, "not_increasing").otherwise("").alias("warning"))
    both = both.join(declared, "review_id", "left")
    outside = ~rate.between(c("rate_value") + c("rate_lower") - 1e-9, c("rate_value") + c("rate_upper") + 1e-9)
    return both.select("review_id", "seq", rate.alias("rate"), F.when(F.coalesce(outside, F.lit(False)), "outside_band").when(rate <= 0, "not_increasing").otherwise("").alias("warning"))


def dependents(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, root, field, depth: what follows from a change of root over any number of edges (src, dst) of one key, by the shortest way.

    A round joins ways with ways, so ways of twice the length are known after it, and keeps the shortest of each pair; it is written, and
    read once by the next one. Rounds end when nothing is new or shorter: about log2 of the longest way, cycles or not."""
    best = lambda ways: ways.groupBy(*keys, "root", "field").agg(F.min("depth").alias("depth"))
    same = lambda ways: tuple(ways.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "root", "field", "depth"))).first())
    reach = durable(best(edges.select(*keys, F.col("src").alias("root"), F.col("dst").alias("field"), F.lit(1).alias("depth"))))
    before = same(reach)
    while before[0]:
        on = reach.select(*keys, F.col("root").alias("mid"), F.col("field").alias("end"), F.col("depth").alias("more"))
        longer = reach.withColumnRenamed("field", "mid").join(on, [*keys, "mid"]).select(*keys, "root", F.col("end").alias("field"), (F.col("depth") + F.col("more")).alias("depth"))
        reach = durable(best(reach.unionByName(longer)))
        now = same(reach)
        if now == before:
            break
        before = now
    return reach


def deflection_adopt(points: DataFrame, consistent: Column) -> DataFrame:
    """Points with a deflection alone get height = free length - deflection, if their units are consistent."""
    adopted = F.when(consistent, F.col("free_length") - F.col("deflection"))
    origin = F.when(F.col("height").isNotNull(), "given").when(consistent, "adopted").otherwise("unit_mismatch")
    return points.select("review_id", "seq", F.round(F.coalesce("height", adopted), 6).alias("height"), origin.alias("origin"))
