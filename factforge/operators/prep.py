"""Projection, typing and normalisation of candidate tables."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factforge.sources.tables import durable

CANDIDATE = ["review_id", "seq", "field", "source", "value", "confidence", "tol_upper", "tol_lower"]
#: Factors to mm, N and N/mm; an absent unit is the base unit, an unknown one gives null. Fixed values.
UNITS = {"length": {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4}, "force": {"N": 1.0, "kN": 1000.0, "kgf": 9.80665}, "rate": {"N/mm": 1.0, "N/cm": 0.1, "kN/m": 1.0, "N/m": 0.001}}
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def unify(channels: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Every channel's rows under one schema: a channel names its own columns, what it lacks is null."""
    out = None
    for name, (rows, columns) in channels.items():
        one = rows.select(*(columns.get(c, F.lit(None)).alias(c) for c in CANDIDATE), F.lit(name).alias("channel"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def drop_unusable(candidates: DataFrame, fragment: Column) -> DataFrame:
    """Rows with a field, a value and no fragment of a vertical dimension."""
    return candidates.where(F.col("field").isNotNull() & (F.trim("field") != "") & F.col("value").isNotNull() & ~F.coalesce(fragment, F.lit(False)))


def strict_number(raw: Column) -> Column:
    """A double where the text is strictly a finite number; blank, boolean, NaN and infinite texts are null."""
    value = F.when(raw.rlike(NUMBER), raw.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def reject_report(rows: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """How many non-blank values of each group are no numbers."""
    text = F.nullif(F.trim(raw), F.lit(""))
    return rows.groupBy(*keys).agg(F.count(text).alias("n_given"), F.count_if(text.isNotNull() & strict_number(F.col(raw)).isNull()).alias("n_rejected"), F.round(F.sum(strict_number(F.col(raw))), 4).alias("total"))


def to_base(value: Column, unit: Column, kind: str, explicit: bool = False) -> Column:
    """value in the base unit of a kind; without a unit it counts as base unless `explicit`."""
    factor = F.lit(None).cast("double")
    for name, x in UNITS[kind].items():
        factor = F.when(F.trim(unit) == name, F.lit(x)).otherwise(factor)
    if not explicit:
        factor = F.when(unit.isNull() | (F.trim(unit) == ""), F.lit(1.0)).otherwise(factor)
    return value * factor


def enum_code(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Code of the first pattern that matches; rules come in order, negative wording first."""
    out = F.lit(None).cast("string")
    for pattern, code in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(code)).otherwise(out)
    return out


def text_key(text: Column) -> Column:
    """Upper case, letters and digits alone."""
    return F.regexp_replace(F.upper(text), r"[^\p{L}\p{N}]", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Width and compatibility folding, which Spark has no function for; in Arrow batches."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def key_collisions(terms: DataFrame, term: str) -> DataFrame:
    """Keys that several distinct terms share."""
    return terms.groupBy(text_key(F.col(term)).alias("key")).agg(F.countDistinct(term).alias("n_terms")).where("n_terms > 1")


def normalized_box(x: Column, y: Column, width: Column, height: Column, center: Column, page_width: float = 1.0, page_height: float = 1.0) -> Column:
    """Top-left box in page fractions, null if it leaves the page."""
    left = F.when(center, x - width / 2).otherwise(x) / page_width
    top = F.when(center, y - height / 2).otherwise(y) / page_height
    w, h = width / page_width, height / page_height
    inside = (left >= 0) & (top >= 0) & (left + w <= 1) & (top + h <= 1) & (w > 0) & (h > 0)
    return F.when(inside, F.struct(left.alias("x"), top.alias("y"), w.alias("width"), h.alias("height")))


def provenance(sources: Column) -> dict[str, Column]:
    """Flags by the wording of any source: human, recognized, formula, protected."""
    has = lambda pattern: F.exists(sources, lambda s: s.rlike(pattern))
    human = has("manual|human|confirmed")
    return {"human": human, "recognized": has("ocr|vision|reader"), "formula": has("formula|inference"), "protected": human & ~has("stale")}


def stable_ids(rows: DataFrame, group: list[str], parts: list[Column], order: list[str], length: int = 24) -> DataFrame:
    """A deterministic id of the parts; equal ids of a group get an ordinal suffix in input order."""
    base = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)
    n = F.row_number().over(Window.partitionBy(*group, "base").orderBy(*order))
    return rows.withColumn("base", base).withColumn("n", n).withColumn("id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))).drop("base", "n")


def stale_lineage(values: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, current: a derived value is current if all it derives from is present and current; those in or behind a cycle aren't.

    A round settles the fields whose inputs were all settled before it, and is written to the shared folder; rounds end when none
    settles, so there are as many as the longest chain has fields, each over what is still open."""
    field = [*keys, "field"]
    inputs = edges.select(*field, "input").distinct()
    there = values.select(*keys, F.col("field").alias("input"), F.lit(True).alias("there"))
    needs = inputs.join(there, [*keys, "input"], "left").groupBy(*field).agg(F.count("there").alias("open"), F.bool_and(F.col("there").isNotNull()).alias("current"))
    state = values.select(*field).join(needs, field, "left").select(*field, F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("current", F.lit(True)).alias("current"))
    state, inputs = durable(state), durable(inputs)
    out = settled = state.where("open = 0").drop("open")
    state = state.where("open > 0")
    while not settled.isEmpty():
        news = inputs.join(settled.withColumnRenamed("field", "input"), [*keys, "input"]).groupBy(*field).agg(F.count("*").alias("n"), F.bool_and("current").alias("now"))
        step = durable(state.join(news, field, "left").select(*field, (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), (F.col("current") & F.coalesce("now", F.lit(True))).alias("current")))
        settled, state = step.where("open = 0").drop("open"), step.where("open > 0")
        out = out.unionByName(settled)
    return out.unionByName(state.select(*field, F.lit(False).alias("current")))
