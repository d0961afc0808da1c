"""Rows joined with the intervals that hold their value, by equal keys alone.

The end points of all intervals of a key, sorted, cut the line into elementary pieces: code 2k - 1 is the k-th point
itself, 2k the open piece after it. A value has one code, an interval a range of codes, whichever of its ends are open.
Ranges are cut into pieces of a binary tree over the codes (two for each level at most), a value looks at the pieces
above its code, one for each level, and meets every interval that holds it once. So neither long nor nested intervals
multiply rows, and no plan holds a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factforge.sources.tables import small

#: Points of a key lie in blocks of so many; a value looks through the first points of blocks and then through one block.
FENCE = 256


def points_of(bands: DataFrame, on: list[str], low: str, high: str) -> DataFrame:
    """on, points (blocks of sorted end points), fences (the first point of each block)."""
    ends = bands.select(*on, F.explode(F.array(F.col(low).cast("double"), F.col(high).cast("double"))).alias("p")).groupBy(*on).agg(F.array_sort(F.collect_set("p")).alias("all"))
    block = lambda i: F.slice("all", i * FENCE + 1, FENCE)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("all"), F.lit(1)) - 1) / FENCE).cast("int")), block)
    ends = ends.withColumn("points", blocks)
    return ends.select(*on, "points", F.transform(F.filter("points", lambda b: F.size(b) > 0), lambda b: b[0]).alias("fences"), F.size("all").alias("n_points"))


def code_of(value: Column) -> Column:
    """The elementary piece of a value among `points` and `fences`: points below it plus points not above it."""
    block = F.greatest(F.size(F.filter("fences", lambda f: f <= value)), F.lit(1))
    own = F.element_at("points", block)
    return 2 * FENCE * (block - 1) + F.size(F.filter(own, lambda p: p < value)) + F.size(F.filter(own, lambda p: p <= value))


def interval_join(rows: DataFrame, bands: DataFrame, value: str, low: str, high: str, on: list[str], low_open: Column | None = None, high_open: Column | None = None) -> DataFrame:
    """rows with the columns of each band of equal `on` that holds `value`; a null bound is none, ends are closed unless said to be open.
    A null value or NaN is in no band. Bands are a rule table, whose rows are counted first."""
    keys, key = [*on, "_one"], F.lit(1).alias("_one")
    low_open, high_open = (F.coalesce(x, F.lit(False)) if x is not None else F.lit(False) for x in (low_open, high_open))
    bands = bands.select("*", key, low_open.alias("_low_open"), high_open.alias("_high_open"))
    small(bands)
    points = points_of(bands, keys, low, high)
    levels = F.sequence(F.lit(0), F.lit((2 * (points.agg(F.max("n_points")).first()[0] or 0) + 1).bit_length()))
    coded = bands.join(F.broadcast(points), keys)
    a = F.when(F.col(low).isNull(), 0).otherwise(code_of(F.col(low)) + F.col("_low_open").cast("int"))
    b = F.when(F.col(high).isNull(), 2 * F.col("n_points")).otherwise(code_of(F.col(high)) - F.col("_high_open").cast("int"))
    first, last = F.expr("shiftright(_a + shiftleft(1, _level) - 1, _level)"), F.expr("shiftright(_b + 1, _level) - 1")
    pieces = coded.withColumn("_a", a).withColumn("_b", b).withColumn("_level", F.explode(levels)).withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
    pieces = pieces.withColumn("_node", F.explode(F.array_compact(F.array(F.when(F.col("_first") % 2 == 1, F.col("_first")), F.when(F.col("_last") % 2 == 0, F.col("_last"))))))
    pieces = pieces.drop("points", "fences", "n_points", "_a", "_b", "_first", "_last", "_low_open", "_high_open")
    value_ = F.col(value)
    probe = rows.select("*", key).where(value_.isNotNull() & ~F.isnan(value_.cast("double"))).join(F.broadcast(points), keys)
    probe = probe.withColumn("_code", code_of(value_)).drop("points", "fences", "n_points").withColumn("_level", F.explode(levels))
    probe = probe.withColumn("_node", F.expr("shiftright(_code, _level)")).drop("_code")
    return probe.join(F.broadcast(pieces), [*keys, "_level", "_node"]).drop("_one", "_level", "_node")
