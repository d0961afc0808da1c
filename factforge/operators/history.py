"""History, jobs and change sets: newest rows, sequences, roll-ups, diffs, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factforge.sources.tables import durable


def newest(rows: DataFrame, n: int, order: list[Column], per: str | None = None, most: int = 500) -> DataFrame:
    """The newest n rows (clamped to 1..most), of all or of each `per`."""
    n = max(1, min(n, most))
    if per is None:
        return rows.orderBy(*order).limit(n)
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(per).orderBy(*order)).cast("long")).where(F.col("n") <= n)


def sequenced(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Gap-free numbers of each entity's events, with the revision before and after."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    return events.withColumn("sequence", n).withColumn("revision_before", n - 1).withColumn("revision_after", n)


def with_jobs(reviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """Reviews and jobs of each owner side by side; owners with jobs alone get a row as well."""
    both = reviews.join(jobs, "owner_id", "full")
    return both.select("owner_id", F.coalesce("n_reviews", F.lit(0)).alias("n_reviews"), F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"), F.coalesce("updated_at", "job_at").alias("updated_at"))


def family_rollup(children: DataFrame, key: str) -> DataFrame:
    """A parent's state from its children: running before failed before completed."""
    out = children.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "failed").alias("failed"), F.round(F.avg("progress"), 6).alias("progress"), F.max("updated").alias("updated"))
    return out.withColumn("state", F.when(F.col("running") > 0, "running").when(F.col("failed") > 0, "failed").otherwise("completed"))


def variant_status(manifest: DataFrame, children: DataFrame, receipts: DataFrame, keys: list[str]) -> DataFrame:
    """created, deleted (a receipt but no child) or not_created."""
    out = manifest.join(children.select(*keys, F.lit(True).alias("child")), keys, "left").join(receipts.select(*keys, F.lit(True).alias("receipt")), keys, "left")
    return out.select(*keys, F.when(F.col("child"), "created").when(F.col("receipt"), "deleted").otherwise("not_created").alias("state"))


def queue_position(jobs: DataFrame, order: str, rows: int = 50_000) -> DataFrame:
    """1 + earlier queued jobs; ties share a position. Positions come from counts of ranges of time, of about so many rows if jobs
    come evenly, so no task sorts the whole queue."""
    queued = jobs.where("status = 'queued'").withColumn("slot", F.unix_micros(F.col(order).cast("timestamp")))
    bounds = queued.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.greatest(F.lit(64), F.floor(F.count("*") / rows)).alias("parts"))
    ranged = queued.join(F.broadcast(bounds)).withColumn("bucket", F.floor((F.col("slot") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1) * F.col("parts")))  # one row
    before = ranged.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    return ranged.withColumn("inside", F.rank().over(Window.partitionBy("bucket").orderBy("slot"))).join(before.select("bucket", "earlier"), "bucket").select("job_id", (F.col("earlier") + F.col("inside")).alias("position"))


def transition_audit(events: DataFrame, allowed: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Status changes that the table of allowed pairs lacks."""
    steps = events.withColumn("before", F.lag("status").over(Window.partitionBy(key).orderBy(*order))).where("before is not null and before <> status")
    return steps.join(allowed, ["before", "status"], "left_anti")


def final_unique(jobs: DataFrame, key: str) -> DataFrame:
    """Keys with more than one final job."""
    return jobs.groupBy(key).agg(F.count_if("final").alias("n_final")).where("n_final > 1")


def artifact_check(artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """A second callback with the same digest is a replay, with another one a conflict."""
    out = artifacts.groupBy(*keys).agg(F.countDistinct("digest").alias("digests"), F.count("*").alias("n")).where("n > 1")
    return out.select(*keys, "n", F.when(F.col("digests") > 1, "conflict").otherwise("replay").alias("state"))


def revision_conflicts(writes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Writes whose expected revision is not the one that the write before left."""
    current = F.coalesce(F.lag("revision").over(Window.partitionBy(key).orderBy(*order)), F.lit(0))
    return writes.withColumn("current", current).where(F.col("expected") != F.col("current"))


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose value differs, null-safe, with what kind of change it is."""
    both = before.select(key, F.col("value").alias("before_value")).join(after.select(key, F.col("value").alias("after_value")), key, "full").where(~F.col("before_value").eqNullSafe(F.col("after_value")))
    kind = F.when(F.col("before_value").isNull(), "created").when(F.col("after_value").isNull(), "removed").otherwise("changed")
    return both.withColumn("kind", kind)


def issue_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """introduced, resolved or unchanged issue keys."""
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    tag = lambda rows, name: rows.withColumn("change", F.lit(name))
    return tag(a.join(b, keys, "left_anti"), "introduced").unionByName(tag(b.join(a, keys, "left_anti"), "resolved")).unionByName(tag(b.join(a, keys, "left_semi"), "unchanged"))


def batch_changes(results: DataFrame, keys: list[str]) -> DataFrame:
    """apply, or why not: several results of one target, no value, no effect."""
    n = F.count("*").over(Window.partitionBy(*keys))
    reason = F.when(n > 1, "conflict").when(F.col("suggested").isNull(), "no_value").when(F.abs(F.col("suggested") - F.col("current")) <= 1e-9, "no_effect").otherwise("apply")
    return results.withColumn("reason", reason)


def suggestion_dedupe(suggestions: DataFrame, signature: list[str], order: str) -> DataFrame:
    """One row a signature with the distinct sources that support it, in order, and the best status."""
    out = suggestions.groupBy(*signature).agg(F.min(order).alias("first"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("available").alias("available"), F.count("*").alias("n"))
    return out


def fingerprint(columns: list[Column]) -> Column:
    """sha256 of the canonical text of a state: columns in name order, nulls as such."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns)), 256)


# Keys of a state that say where a value is from, not what it is.
VOLATILE = ("confidence", "evidence", "formula", "formula_calculation_kind", "formula_calculation_status", "page", "position", "source", "source_fields", "suggested_region", "confirmed_at", "created_at", "updated_at")


def canonical_leaves(states: DataFrame, keys: list[str], document: str, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """keys, leaf: `path=value` of each scalar and each empty list or object of a JSON document, volatile keys left out at any depth.

    A round opens one level of all documents by variant_explode and is written; there are as many as the deepest document has levels. A
    document that isn't JSON is one leaf, its text."""
    spark = states.sparkSession
    value = F.coalesce(F.try_parse_json(document), F.expr(f"CAST({document} AS VARIANT)"))
    level = states.select(*keys, F.lit("").alias("path"), value.alias("v"))
    out = None
    while True:
        nested, maybe_empty = F.col("kind").rlike("^(OBJECT|ARRAY)<"), F.col("kind").isin("OBJECT<>", "ARRAY<VOID>")
        text = F.when(nested & ~maybe_empty, F.lit(None)).otherwise(F.to_json("v"))  # what opens is never written out as text
        opens = F.coalesce(nested & (~maybe_empty | ~F.col("text").isin("{}", "[]")), F.lit(False))
        level = level.withColumn("kind", F.schema_of_variant("v")).withColumn("text", text).withColumn("opens", opens)
        level = durable(level.select(*keys, "path", "text", "opens", F.when(F.col("opens"), F.col("v")).alias("v")))
        opens = F.col("opens")
        leaves = level.where(~opens).select(*keys, F.concat("path", F.lit("="), F.coalesce("text", F.lit("null"))).alias("leaf"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = level.where(opens)
        if inner.isEmpty():
            return out
        named = ", ".join(f"l.`{k}`" for k in keys)
        each = spark.sql(f"SELECT {named}, l.path, e.pos, e.key, e.value FROM {{l}} l, LATERAL variant_explode(l.v) e", l=inner.select(*keys, "path", "v"))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), F.replace("key", F.lit("."), F.lit("\\.")))).otherwise(F.concat(F.lit("["), F.lpad(F.col("pos").cast("string"), 9, "0"), F.lit("]")))
        level = each.where(F.col("key").isNull() | ~F.col("key").isin(*volatile)).select(*keys, F.concat("path", step).alias("path"), F.col("value").alias("v"))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over a text's UTF-8, as eight hexadecimal digits."""
    each = F.split(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), "")  # a character for each byte, in one pass
    each = F.when(F.length(text) > 0, each).otherwise(F.array().cast("array<string>"))
    folded = F.aggregate(each, F.lit(2166136261).cast("long"), lambda h, b: (h.bitwiseXOR(F.ascii(b).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def canonical_hashes(states: DataFrame, keys: list[str], document: str, volatile: tuple[str, ...] = VOLATILE) -> DataFrame:
    """keys, state_hash (sha256) and token (FNV-1a) of the sorted leaves of each document: the order of an object's keys and volatile
    keys change nothing, any other change does. keys tell documents apart."""
    text = F.array_join(F.array_sort(F.collect_list("leaf")), "\n")
    found = canonical_leaves(states, keys, document, volatile).groupBy(*keys).agg(text.alias("text"))
    every = states.select(*keys).join(found, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))
    return every.select(*keys, F.sha2(F.encode("text", "UTF-8"), 256).alias("state_hash"), F.concat(F.lit("fnv1a32:"), fnv1a(F.col("text"))).alias("token"))


def last_wins(actions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last action of each target, in the order in which targets first appear."""
    return actions.groupBy(*keys).agg(F.max_by("action", order).alias("action"), F.min(order).alias("first_at"))


def reconcile_points(stored: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """insert new points, update automatic ones, keep human ones and note a differing candidate, leave out deleted ones."""
    both = stored.select(*keys, F.col("height").alias("old"), "human", "deleted").join(found.select(*keys, F.col("height").alias("new")), keys, "full")
    same = F.abs(F.col("old") - F.col("new")) <= 1e-9
    action = F.when(F.col("deleted"), "skip").when(F.col("old").isNull(), "insert").when(F.col("new").isNull() | same, "keep").when(F.col("human"), "candidate").otherwise("update")
    return both.select(*keys, action.alias("action"), F.when(action.isin("insert", "update"), F.col("new")).otherwise(F.col("old")).alias("height"))
