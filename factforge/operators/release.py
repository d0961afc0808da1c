"""Readiness and release packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factforge.operators.intervals import interval_join


def readiness(candidates: DataFrame, required: int) -> DataFrame:
    """Missing, pending, confirmed and doubtful fields of each review, and its state in this order."""
    fields = candidates.groupBy("review_id", "field").agg(F.bool_or(F.col("source") == "manual").alias("confirmed"), F.max("confidence").alias("c"))
    out = fields.groupBy("review_id").agg((F.lit(required) - F.count("*")).alias("n_missing"), F.count_if(~F.col("confirmed")).alias("n_pending"), F.count_if("confirmed").alias("n_confirmed"), F.count_if(F.col("c") < 0.6).alias("n_warnings"))
    return out.withColumn("state", F.when(F.col("n_missing") > 0, "missing").when(F.col("n_pending") > 0, "pending").when(F.col("n_warnings") > 0, "warning").otherwise("ready"))


def defaults(wide: DataFrame, values: dict[str, str]) -> DataFrame:
    """Missing export fields with their default, marked pending."""
    return wide.select("*", *(F.col(c).isNull().alias(f"{c}_pending") for c in values)).withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def point_state(points: DataFrame) -> DataFrame:
    """duplicate (a later row of a label, letter case aside), incomplete or ok."""
    n = F.row_number().over(Window.partitionBy("review_id", F.lower("label")).orderBy("seq"))
    return points.select("review_id", "seq", F.when(n > 1, "duplicate").when(F.col("force_tol").isNull(), "incomplete").otherwise("ok").alias("state"))


def note_text(notes: DataFrame) -> DataFrame:
    """Distinct notes of a review in order of first appearance, numbered, as one text."""
    first = notes.groupBy("doc_id", "body").agg(F.min("line_no").alias("line_no"))
    order = F.array_sort(F.collect_list(F.struct("line_no", "body")))
    text = F.array_join(F.transform("all", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["body"])), "\n")
    return first.groupBy("doc_id").agg(order.alias("all")).select("doc_id", text.alias("text"))


def template_match(subjects: DataFrame, values: DataFrame, templates: DataFrame, conditions: DataFrame) -> DataFrame:
    """The templates of each subject by relational division: one fits if it is enabled, of the subject's type, has all its required
    fields, and as many of its conditions hold as it has. The score is priority * 1000 + that number; several best ones ask for a
    selection, unless the subject names a code.

    subjects: review_id, drawing_type, requested (a code or null); values: review_id, field, word, number (one of both); templates:
    code, version, priority, enabled, drawing_type; conditions: code, version, kind (required, in, range), field, word or number (one
    row for each allowed value), low, high. A range without both bounds never holds. Result: review_id, status (selected,
    template_selection_required, template_not_found), code, version, score, candidates (code@version, best first; of a tie the best alone).

    Values meet conditions by equal field and word or number, or by the pieces of the ranges; so the pairs are those that hold."""
    one = ["code", "version"]
    live = templates.where("enabled").select(*one, "priority", "drawing_type")
    needs = conditions.join(live.select(*one, "drawing_type"), one)
    rules = needs.where("kind in ('in', 'range')")
    present = values.where((F.col("word") != "") | F.col("number").isNotNull()).join(subjects.select("review_id", "drawing_type"), "review_id")
    at = ["drawing_type", "field"]
    allowed = rules.where("kind = 'in'").select(*at, *one, "kind", "word", "number")
    by_word = present.select("review_id", *at, "word").join(allowed.drop("number"), [*at, "word"])
    by_number = present.select("review_id", *at, "number").join(allowed.drop("word"), [*at, "number"])
    ranges = rules.where("kind = 'range' and low is not null and high is not null").select(*at, *one, "kind", "low", "high")
    in_range = interval_join(present.select("review_id", *at, "number"), ranges, "number", "low", "high", at)
    met = [x.select("review_id", *one, "kind", "field") for x in (by_word, by_number, in_range)]
    met = met[0].unionByName(met[1]).unionByName(met[2]).groupBy("review_id", *one).agg(F.countDistinct("kind", "field").alias("n_met"))
    of = needs.groupBy(*one).agg(F.countDistinct(F.when(F.col("kind") != "required", F.struct("kind", "field"))).alias("n_rules"), F.collect_set(F.when(F.col("kind") == "required", F.col("field"))).alias("required"))
    of = live.join(of, one, "left").withColumn("n_rules", F.coalesce("n_rules", F.lit(0))).withColumn("required", F.coalesce("required", F.array().cast("array<string>")))
    ruled = met.join(of.where("n_rules > 0"), one).where("n_met = n_rules").select("review_id", *one)
    free = subjects.join(of.where("n_rules = 0").select("drawing_type", *one), "drawing_type").select("review_id", *one)
    fields = present.groupBy("review_id").agg(F.collect_set("field").alias("fields"))
    fits = ruled.unionByName(free).join(of.drop("drawing_type"), one).join(subjects.select("review_id", "requested"), "review_id").where(F.col("requested").isNull() | (F.col("requested") == F.col("code")))
    fits = fits.join(fields, "review_id", "left").where(F.size(F.array_except("required", F.coalesce("fields", F.array().cast("array<string>")))) == 0)
    each = F.struct((0 - F.col("priority") * 1000 - F.col("n_rules")).alias("order"), *one)
    found = fits.groupBy("review_id").agg(F.array_sort(F.collect_list(each)).alias("all")).withColumn("best", F.filter("all", lambda x: x["order"] == F.col("all")[0]["order"]))
    out = subjects.select("review_id", "requested").join(found, "review_id", "left")
    status = F.when(F.col("all").isNull(), "template_not_found").when((F.size("best") > 1) & F.col("requested").isNull(), "template_selection_required").otherwise("selected")
    chosen = lambda c: F.when(F.col("status") == "selected", F.col("all")[0][c])
    shown = F.when(F.col("status") == "selected", F.col("all")).when(F.col("status") == "template_selection_required", F.col("best")).otherwise(F.array())
    out = out.withColumn("status", status).withColumn("shown", shown)
    names = F.array_join(F.transform("shown", lambda x: F.concat(x["code"], F.lit("@"), x["version"].cast("string"))), ",")
    return out.select("review_id", "status", chosen("code").alias("code"), chosen("version").alias("version"), (0 - F.col("all")[0]["order"]).alias("score"), names.alias("candidates"))


def contract_issues(wide: DataFrame) -> DataFrame:
    """review_id, field, reason: parameters that no model can be built from. Those still under review (`<field>_review`) are left
    out; lengths and coils must be positive, the mean diameter greater than the wire's (at three digits), whole active coils no more than
    the total."""
    c, sizes = F.col, ("wire_diameter", "mean_diameter", "free_length", "total_coils", "active_coils")
    shown = wide.select("review_id", *(F.when(~F.coalesce(f"{f}_review", F.lit(False)), c(f)).alias(f) for f in sizes))
    good = {f: F.when(c(f) > 0, F.round(c(f), 3) if f in sizes[:3] else c(f)) for f in sizes}
    whole = lambda f: F.when(good[f] == F.floor(good[f]), good[f])
    issues = [(f, "not_positive", ~(c(f) > 0) | F.isnan(c(f))) for f in sizes]
    issues += [("mean_diameter", "not_above_wire", good["mean_diameter"] <= good["wire_diameter"]), ("active_coils", "above_total", whole("active_coils") > whole("total_coils"))]
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(r).alias("reason"))) for f, r, bad in issues)))
    return shown.select("review_id", F.inline(found))
