"""What a change of parameters leads to, without running everything anew: the fields that it touches, what follows from them by the graph
of formulas and rules, and only those formulas and rules again, compared with the issues that are stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factforge.operators import rules
from factforge.sources.tables import durable

DIAMETERS = ("outer_diameter", "inner_diameter", "mean_diameter")
NUMBERS = ("wire_diameter", *DIAMETERS, "free_length", "total_coils", "active_coils", "support_coils", "solid_height", "wire_upper")
WORDS = ("end_mode",)
D = "derived:"
#: What each derived value and each rule reads, a field or a derived value.
INPUTS = {
    f"{D}mean_diameter": ("mean_diameter", "outer_diameter", "inner_diameter", "wire_diameter"), f"{D}outer_diameter": (f"{D}mean_diameter", "wire_diameter"), f"{D}inner_diameter": (f"{D}mean_diameter", "wire_diameter"),
    f"{D}spring_index": (f"{D}mean_diameter", "wire_diameter"), f"{D}slenderness_ratio": ("free_length", f"{D}mean_diameter"), f"{D}solid_height": ("solid_height", "end_mode", "total_coils", "wire_diameter", "wire_upper"),
    **{f"SPRING-GEO-{f.upper()}": (f,) for f in rules.POSITIVE},
    "SPRING-GEO-OUTER-INNER": ("outer_diameter", "wire_diameter"), "SPRING-GEO-DIAMETER-CONSISTENCY": ("inner_diameter", "outer_diameter", "wire_diameter"),
    "SPRING-GEO-COIL-COUNT": ("active_coils", "total_coils"), "SPRING-GEO-SUPPORT-COILS": ("support_coils", "total_coils", "active_coils"), "SPRING-CONTEXT-ACTIVE-COILS": ("total_coils", "active_coils", "end_mode"),
    "GBT1239.2-SCOPE-SPRING-INDEX": (f"{D}spring_index",), "GBT1239.2-SCOPE-TOTAL-COILS": ("total_coils",), "GBT1239.2-SLENDERNESS": (f"{D}slenderness_ratio",),
    "SPRING-CONTEXT-END-CONDITION": ("solid_height", "end_mode", "wire_diameter", "total_coils"), "SPRING-LOAD-FREE-OVER-SOLID": ("free_length", f"{D}solid_height"),
    "SPRING-LOAD-HEIGHT-OVER-FREE": ("free_length",), "SPRING-LOAD-HEIGHT-UNDER-SOLID": (f"{D}solid_height",),
}


def followers() -> dict[str, list[str]]:
    """For each field all that follows from it over the graph of INPUTS: a few dozen fixed rows, walked here."""
    out = {}
    for field in (*NUMBERS, *WORDS):
        found, size = {field}, 0
        while len(found) > size:
            size = len(found)
            found |= {node for node, inputs in INPUTS.items() if found & set(inputs)}
        out[field] = sorted(found - {field})
    return out


def merged(rows: DataFrame) -> DataFrame:
    """Rows that grow with the reviews: joined by shuffle, never sent to every task, however few bytes they take in compressed files."""
    return rows.hint("merge")


def derived_values() -> dict[str, Column]:
    wire, outer, inner, free = (F.col(c) for c in ("wire_diameter", "outer_diameter", "inner_diameter", "free_length"))
    mean = F.coalesce("mean_diameter", outer - wire, inner + wire)
    values = {"mean_diameter": mean, "outer_diameter": mean + wire, "inner_diameter": mean - wire, "spring_index": mean / F.nullif(wire, F.lit(0.0)), "slenderness_ratio": free / F.nullif(mean, F.lit(0.0)), "solid_height": rules.least_free_length()}
    return {name: F.round(x, 9) for name, x in values.items()}


def patched(reviews: DataFrame, patches: DataFrame) -> DataFrame:
    """Reviews with an applicable patch: review_id, old (their row), new (the row after it), changed (fields whose value differs).

    Of several patches of a field the last one (greatest seq) holds; patches of unknown fields, or without a value, don't. If of wire and
    diameters one diameter alone is patched, the others of a compression spring follow from it and the wire, if all come out positive."""
    c = F.col
    value = (c("field").isin(*NUMBERS) & c("number").isNotNull()) | (c("field").isin(*WORDS) & (F.trim("word") != ""))
    last = patches.where(value).groupBy("review_id", "field").agg(F.max_by(F.struct("number", "word"), "seq").alias("to"))
    last = last.groupBy("review_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "to"))).alias("patch"))
    rows = reviews.join(merged(last), "review_id").withColumn("old", F.struct(*(c(n) for n in reviews.columns)))
    has = lambda f: F.map_contains_key("patch", f)
    rows = rows.withColumns({**{f: F.when(has(f), c("patch")[f]["number"]).otherwise(c(f)) for f in NUMBERS}, **{f: F.when(has(f), c("patch")[f]["word"]).otherwise(c(f)) for f in WORDS}})
    wire = c("wire_diameter")
    one = F.size(F.filter(F.map_keys("patch"), lambda f: f.isin("wire_diameter", *DIAMETERS))) == 1
    mean = F.when(has("outer_diameter"), c("outer_diameter") - wire).when(has("inner_diameter"), c("inner_diameter") + wire).when(has("mean_diameter"), c("mean_diameter"))
    linked = {"outer_diameter": mean + wire, "inner_diameter": mean - wire, "mean_diameter": mean}
    valid = one & (c("spring_type") == "compression_spring") & (wire > 0) & reduce(lambda a, b: a & b, (F.round(x, 4) > 0 for x in linked.values()))
    valid = F.coalesce(valid, F.lit(False))
    rows = rows.withColumns({f: F.when(valid & ~has(f), F.round(x, 4)).otherwise(c(f)) for f, x in linked.items()})
    rows = rows.select("review_id", "old", F.struct(*(c(n) for n in reviews.columns)).alias("new"))
    changed = F.array_compact(F.array(*(F.when(~c("old")[f].eqNullSafe(c("new")[f]), F.lit(f)) for f in (*NUMBERS, *WORDS))))
    return rows.withColumn("changed", changed)


def simulate(reviews: DataFrame, patches: DataFrame, points: DataFrame, stored: DataFrame, cold: Column, height: Column) -> DataFrame:
    """review_id, kind, name, seq, severity, before, after, before_word, after_word of each patched review: direct and derived changes, issues
    introduced, resolved and unchanged, and the status of the change: blocked or warning by the issues that it introduces, ready, or
    not_applicable if no patch of the review has a known field and a value.

    reviews: review_id, spring_type, NUMBERS, WORDS, has_points and what `cold` reads; patches: review_id, seq, field, number, word; points: review_id, seq and
    what `height` (in mm) reads; stored: review_id, seq (null for rules of the review), rule_id, severity: the issues of the rows as they are. Rules that
    a change doesn't reach are not run; their stored issues stay. Reviews without a patch are not read beyond the join."""
    c = F.col
    graph = F.create_map(*(x for f, all_ in followers().items() for x in (F.lit(f), F.array(*(F.lit(n) for n in all_)))))
    rows = patched(reviews, patches)
    rows = durable(rows.withColumn("nodes", F.array_distinct(F.flatten(F.transform("changed", lambda f: graph[f])))))
    none, no_word = F.lit(None).cast("double"), F.lit(None).cast("string")

    def change(kind: str, name: Column | str, before: Column, after: Column, words: tuple[Column, Column] = (no_word, no_word)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), before.alias("before"), after.alias("after"), words[0].alias("before_word"), words[1].alias("after_word"))

    old = lambda f: c("old")[f]
    direct = [(f, change("direct", f, old(f), c("new")[f])) for f in NUMBERS] + [(f, change("direct", f, none, none, (old(f), c("new")[f]))) for f in WORDS]
    direct = [F.when(F.array_contains("changed", f), x) for f, x in direct]
    held = list(derived_values())
    wide = rows.select("review_id", "old", "new", "changed", "nodes", *(c("old")[f].alias(f) for f in (*NUMBERS, *WORDS)))
    wide = wide.select("review_id", "old", "new", "changed", "nodes", *(F.when(F.array_contains("nodes", D + n), x).alias(f"b_{n}") for n, x in derived_values().items()), *(c("new")[f].alias(f) for f in (*NUMBERS, *WORDS)))
    wide = wide.withColumns({f"a_{n}": F.when(F.array_contains("nodes", D + n), x) for n, x in derived_values().items()})
    moved = [F.when(~c(f"b_{n}").eqNullSafe(c(f"a_{n}")), change("derived", n, c(f"b_{n}"), c(f"a_{n}"))) for n in held]
    changes = wide.select("review_id", F.inline(F.array_compact(F.array(*direct, *moved)))).withColumn("seq", F.lit(None).cast("long")).withColumn("severity", no_word)
    after = rows.select("review_id", "nodes", *(c("new")[n].alias(n) for n in reviews.columns if n != "review_id"))
    touched = lambda checks: [(r, s, F.array_contains("nodes", r) & bad) for r, s, bad in checks if r in INPUTS]
    own = rules.issues(after, ["review_id"], touched(rules.geometry_checks(cold))).withColumn("seq", F.lit(-1).cast("long"))
    bounds = after.where(F.arrays_overlap("nodes", F.array(F.lit("SPRING-LOAD-HEIGHT-OVER-FREE"), F.lit("SPRING-LOAD-HEIGHT-UNDER-SOLID")))).select("review_id", "nodes", "free_length", rules.least_free_length().alias("least_free_length"))
    per_point = rules.issues(points.drop("free_length", "least_free_length").join(merged(bounds), "review_id"), ["review_id", "seq"], touched(rules.point_checks(height, c("force"))))
    key = ["review_id", "seq", "rule_id", "severity"]
    now = own.select(*key).unionByName(per_point.select(*key)).withColumn("now", F.lit(True))
    was = stored.join(merged(rows.select("review_id", "nodes")), "review_id").select("review_id", F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), "rule_id", "severity", F.array_contains("nodes", F.col("rule_id")).alias("touched"))
    kind = F.when(c("touched").isNull(), "introduced").when(c("touched") & c("now").isNull(), "resolved").otherwise("unchanged")
    issues = was.dropDuplicates(key).join(merged(now), key, "full").withColumn("kind", kind)
    issues = issues.select("review_id", "kind", c("rule_id").alias("name"), F.when(c("seq") >= 0, c("seq")).alias("seq"), "severity", none.alias("before"), none.alias("after"), no_word.alias("before_word"), no_word.alias("after_word"))
    new = issues.where("kind = 'introduced'").groupBy("review_id").agg(F.bool_or(c("severity") == "blocked").alias("stops"))
    state = patches.select("review_id").distinct().join(merged(reviews.select("review_id").distinct()), "review_id")
    state = state.join(merged(rows.select("review_id", F.lit(True).alias("applies"))), "review_id", "left").join(merged(new), "review_id", "left")
    name = F.when(c("applies").isNull(), "not_applicable").when(c("stops"), "blocked").when(c("stops").isNotNull(), "warning").otherwise("ready")
    state = state.select("review_id", F.lit("status").alias("kind"), name.alias("name"))
    return changes.unionByName(issues).unionByName(state, allowMissingColumns=True)
