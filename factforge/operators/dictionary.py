"""Dictionary joins: terms of a text against small versioned dictionaries, run on distinct values and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factforge.operators.prep import text_key
from factforge.sources.tables import blocks


def exact_then_key(values: DataFrame, value: str, terms: DataFrame) -> DataFrame:
    """value, term, confidence, status: exact term or alias (1.0), else a unique key match (0.98), else unmatched with the raw value kept.

    terms: term, alias. Values are distinct."""
    names = terms.select("term", F.col("alias").alias("name")).union(terms.select("term", F.col("term"))).distinct()
    exact = names.groupBy(F.col("name").alias(value)).agg(F.min("term").alias("exact_term"))
    by_key = names.groupBy(text_key(F.col("name")).alias("key")).agg(F.countDistinct("term").alias("n"), F.min("term").alias("key_term"))
    out = values.join(exact, value, "left").withColumn("key", text_key(F.col(value))).join(by_key, "key", "left")
    status = F.when(F.col("exact_term").isNotNull(), "exact").when(F.col("n") == 1, "key").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    term = F.coalesce("exact_term", F.when(F.col("n") == 1, F.col("key_term")), F.col(value))
    return out.select(value, term.alias("term"), F.when(status == "exact", 1.0).when(status == "key", 0.98).otherwise(0.0).alias("confidence"), status.alias("status"))


WORD = "[a-z0-9]+"


def contains_grade(values: DataFrame, value: str, terms: DataFrame) -> DataFrame:
    """Whole-word containment of an alias in a value: no prefix matches; bare digits don't count as an alias. Both meet on the
    alias's first word, which the value must have as a word of its own; an alias without any is in no value."""
    usable = terms.where(~F.col("alias").rlike("^[0-9]+$")).withColumn("word", F.regexp_extract(F.lower("alias"), WORD, 0)).where("word <> ''")
    words = values.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(WORD), F.lit(0)))))
    whole = F.regexp(F.lower(value), F.concat(F.lit("(^|[^a-z0-9])"), F.regexp_replace(F.lower("alias"), r"([^a-z0-9 ])", r"\\$1"), F.lit("($|[^a-z0-9])")))
    return words.join(usable, "word").where(whole).select(value, "id", "term")


def unique_match(matches: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """matched if exactly one catalog entry matches, conflict if several, unmatched if none."""
    found = matches.groupBy(value).agg(F.countDistinct("id").alias("n"), F.min("term").alias("term"))
    out = values.join(found, value, "left")
    status = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "conflict").otherwise("unmatched")
    return out.select(value, status.alias("status"), F.when(F.col("n") == 1, F.col("term")).alias("term"))


def alias_cascade(values: DataFrame, value: str, terms: DataFrame, risky: str) -> DataFrame:
    """Alias (.96), then exact term (.98), then key (.94); risky wording vetoes a key match and asks for confirmation."""
    alias = terms.groupBy(F.lower("alias").alias("a")).agg(F.min("term").alias("alias_term"))
    exact = terms.select(F.col("term").alias("t")).distinct()
    keys = terms.groupBy(text_key(F.col("term")).alias("k")).agg(F.min("term").alias("key_term"), F.countDistinct("term").alias("n")).where("n = 1").drop("n")
    out = values.join(alias, F.lower(value) == F.col("a"), "left").join(exact, F.col(value) == F.col("t"), "left").join(keys, text_key(F.col(value)) == F.col("k"), "left")
    veto = F.col(value).rlike(risky)
    status = F.when(F.col("alias_term").isNotNull(), "alias").when(F.col("t").isNotNull(), "exact").when(F.col("key_term").isNotNull() & ~veto, "key").when(veto, "confirm").otherwise("suggest")
    score = F.when(status == "alias", 0.96).when(status == "exact", 0.98).when(status == "key", 0.94).otherwise(0.0)
    return out.select(value, status.alias("status"), F.coalesce("alias_term", "t", F.when(status == "key", F.col("key_term"))).alias("term"), score.alias("confidence"))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of the character sets of two keys, or the length ratio if one contains the other; the larger."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    within = F.when(F.contains(a, b) | F.contains(b, a), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.greatest(jaccard, within)).otherwise(F.lit(0.0))


def fuzzy_topk(values: DataFrame, value: str, terms: DataFrame, k: int = 8, least: float = 0.45) -> DataFrame:
    """The k most similar terms of each distinct value, at least `least` alike; ties by term. A value is held against blocks of
    the dictionary, of which it keeps the best k each, so no row for a pair is made."""
    key = text_key(F.col(value))
    near = F.transform("block", lambda t: F.struct((-F.round(similarity(key, text_key(t)), 9)).alias("score"), t.alias("term")))
    best = F.slice(F.array_sort(F.filter(near, lambda x: x["score"] <= -least)), 1, k)
    found = values.select(value).distinct().join(blocks(terms.select("term"), "term")).select(value, F.inline(best)).withColumn("score", -F.col("score"))
    return found.select(value, "term", "score", F.row_number().over(Window.partitionBy(value).orderBy(F.desc("score"), "term")).cast("long").alias("n")).where(F.col("n") <= k)


def decision_accept(decisions: DataFrame, suggestions: DataFrame, value: str, least: float = 0.85) -> DataFrame:
    """External decisions that choose one of the value's own suggestions with enough confidence."""
    return decisions.where((F.col("action") == "choose") & (F.col("confidence") >= least)).join(suggestions.select(value, "term"), [value, "term"], "left_semi")


def primary_conflict(values: DataFrame, key: str, term: Column) -> DataFrame:
    """Keys whose primary values normalise to more than one catalog entry."""
    return values.groupBy(key).agg(F.countDistinct(term).alias("n_primary")).withColumn("conflict", F.col("n_primary") > 1)


def substitute_pick(primary: DataFrame, substitutes: DataFrame, key: str) -> DataFrame:
    """Unmatched primaries take the single permitted substitute; several are a conflict."""
    found = substitutes.groupBy(key).agg(F.countDistinct("term").alias("n"), F.min("term").alias("term"))
    out = primary.where("status = 'unmatched'").select(key).distinct().join(found, key)
    return out.select(key, F.when(F.col("n") == 1, "substituted").otherwise("conflict").alias("status"), F.when(F.col("n") == 1, F.col("term")).alias("term"))


def membership_check(values: DataFrame, value: str, catalog: DataFrame, allowed: list[str]) -> DataFrame:
    """pass if the value is a catalog alias or on the allow-list, else warning."""
    known = catalog.select(F.lower("alias").alias("known")).distinct()
    out = values.join(known, F.lower(value) == F.col("known"), "left")
    return out.select(value, F.when(F.col("known").isNotNull() | F.col(value).isin(allowed), "pass").otherwise("warning").alias("status"))


def mapping_validity(chosen: DataFrame, catalog: DataFrame, key: str, ids: str, text: str) -> DataFrame:
    """Reason for each chosen id set: unknown id, repeated id, name not in the text, or ok."""
    each = chosen.select(key, text, F.posexplode(ids).alias("n", "id")).join(catalog.select("id", "alias"), "id", "left")
    out = each.groupBy(key).agg(F.count_if(F.col("alias").isNull()).alias("unknown"), (F.count("*") - F.countDistinct("id")).alias("repeated"), F.count_if(~F.contains(F.lower(text), F.lower("alias"))).alias("absent"))
    return out.select(key, F.when(F.col("unknown") > 0, "unknown_id").when(F.col("repeated") > 0, "repeated_id").when(F.col("absent") > 0, "not_in_text").otherwise("ok").alias("reason"))
