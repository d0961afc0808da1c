"""Joins of boxes on pages: by the cells of a grid where a page may hold very many, else by the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factforge.operators.grid import meeting_boxes, nearest, points_in_windows

__all__ = ["nearest"]


def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.toDF(*(f"{prefix}{c}" for c in rows.columns))


def overlap_ratio() -> Column:
    """Shared area over the smaller area, for columns x, y, width, height and o_x, o_y, o_width, o_height."""
    c = F.col
    wide = F.greatest(F.least(c("x") + c("width"), c("o_x") + c("o_width")) - F.greatest("x", "o_x"), F.lit(0.0))
    high = F.greatest(F.least(c("y") + c("height"), c("o_y") + c("o_height")) - F.greatest("y", "o_y"), F.lit(0.0))
    return wide * high / F.least(c("width") * c("height"), c("o_width") * c("o_height"))


def pairs(blocks: DataFrame, others: DataFrame, condition: Column | None = None, page: str = "page_id") -> DataFrame:
    """blocks joined with others of the same page, whose columns get the prefix o_."""
    o = prefixed(others, "o_")
    on = blocks[page] == o[f"o_{page}"]
    return blocks.join(o, on if condition is None else on & condition)


def in_region(blocks: DataFrame, regions: DataFrame, by_center: bool = False) -> DataFrame:
    """Blocks that lie in a region of their page, whole or by their center."""
    c = F.col
    if by_center:
        x, y = c("x") + c("width") / 2, c("y") + c("height") / 2
        inside = x.between(c("o_x"), c("o_x") + c("o_width")) & y.between(c("o_y"), c("o_y") + c("o_height"))
    else:
        inside = (c("x") >= c("o_x")) & (c("y") >= c("o_y")) & (c("x") + c("width") <= c("o_x") + c("o_width")) & (c("y") + c("height") <= c("o_y") + c("o_height"))
    return pairs(blocks, regions, inside)


def region_exclusive(blocks: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """Blocks in the own region that overlap no other region."""
    keys = ["page_id", "block_no"]
    mine = in_region(blocks, own, True).select(*keys).distinct()
    theirs = in_region(blocks, other, True).select(*keys).distinct()
    return blocks.join(mine, keys, "left_semi").join(theirs, keys, "left_anti")


def overlap_edges(blocks: DataFrame, least: float) -> DataFrame:
    """(page_id, block_no, other): blocks of equal text whose boxes overlap by the ratio."""
    b = blocks.select("page_id", "block_no", "text", "x", "y", "width", "height")
    return meeting_boxes(b, b, ["text"]).where((F.col("block_no") != F.col("o_block_no")) & (overlap_ratio() >= least)).select("page_id", "block_no", F.col("o_block_no").alias("other"))


# A label ends at most so far right of a cell's left edge and so far left of it; its middle lies so near to the cell's,
# in page heights or in heights of the smaller box; another box between them, on the cell's line, blocks.
LABEL_GAP, LABEL_SLACK, LABEL_SHARE, BLOCK_EDGE, BLOCK_SLACK = (-0.005, 0.18), 0.003, 0.6, 0.003, 0.004


def row_label(cells: DataFrame, labels: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nearest label left of a cell in its row (of equal gaps the least number), unless another of the blocks stands between them."""
    c = F.col
    least, most = LABEL_GAP
    middle, slack = c("y") + c("height") / 2, F.greatest(F.lit(LABEL_SLACK), c("height") * LABEL_SHARE)
    label = labels.select("page_id", "block_no", "x", "y", "width", "height")
    window = (c("x") - most - 1e-9, c("x") - least + 1e-9, middle - slack, middle + slack)
    near = points_in_windows(cells.select("page_id", "block_no", "x", "y", "height"), label, window, (c("x") + c("width"), c("y") + c("height") / 2), (most - least, 0.02))
    gap = F.round(c("x") - c("o_x") - c("o_width"), 9)
    off = F.abs(middle - c("o_y") - c("o_height") / 2) <= F.greatest(F.lit(LABEL_SLACK), F.least("height", "o_height") * LABEL_SHARE)
    near = near.withColumn("gap", gap).where(off & c("gap").between(least, most) & (c("block_no") != c("o_block_no")))
    best = near.groupBy("page_id", "block_no").agg(F.min(F.struct("gap", "o_block_no", (c("o_x") + c("o_width")).alias("edge"), "x", middle.alias("middle"))).alias("b"))
    best = best.select("page_id", "block_no", "b.*").withColumnRenamed("o_block_no", "label_no")
    between = (c("edge") + BLOCK_EDGE, c("x") - BLOCK_EDGE, c("middle") - BLOCK_SLACK, c("middle") + BLOCK_SLACK)
    there = points_in_windows(best, blocks.select("page_id", "block_no", "x", "y", "height"), between, (c("x"), c("y") + c("height") / 2), (most - least, 0.02))
    inside = (c("o_x") > c("edge") + BLOCK_EDGE) & (c("o_x") < c("x") - BLOCK_EDGE) & (F.abs(c("middle") - c("o_y") - c("o_height") / 2) < BLOCK_SLACK)
    blocked = there.where(inside & (c("block_no") != c("o_block_no"))).select("page_id", "block_no").distinct()
    return best.join(blocked, ["page_id", "block_no"], "left_anti").select("page_id", "block_no", "label_no", "gap")


def column_label(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """The header above a cell that shares at least half of the smaller width; only if the headers found lie in one column."""
    shared = F.least(F.col("x") + F.col("width"), F.col("o_x") + F.col("o_width")) - F.greatest("x", "o_x")
    over = (shared >= 0.5 * F.least("width", "o_width")) & (F.col("o_y") < F.col("y"))
    found = pairs(cells, headers, over).groupBy("page_id", "block_no").agg(F.max_by("o_block_no", F.struct("o_y", "o_block_no")).alias("header_no"), (F.max("o_x") - F.min("o_x")).alias("spread"))
    return found.where(F.col("spread") < 0.02).select("page_id", "block_no", "header_no")


def nominal_with_tolerance(blocks: DataFrame) -> DataFrame:
    """page_id, block_no, value, lower: the vertical nominal size of a page that a negative tolerance stands beside. Fragments inside the
    box of a larger choice with decimals don't count, those of the file's own text go before recognized ones, and pages whose
    choices differ in value have none.
    blocks: page_id, block_no, x, y, width, height, text, value (its number or null), source, reading_angle."""
    c = F.col
    upright = (c("height") > c("width") * 0.8) | c("reading_angle").isin(90, 270)
    nominal = blocks.where((c("value") > 0) & F.coalesce(upright, F.lit(False)) & ~c("text").rlike("(?i)Ra|粗糙|▽|√"))
    below = blocks.where("value < 0").select("page_id", "block_no", "x", "y", "value")
    across, down = F.greatest(F.lit(0.015), c("width") * 0.65), F.greatest(F.lit(0.065), c("height") * 2)
    window = (c("x") - across, c("x") + across, c("y") - down, c("y") + down)
    near = points_in_windows(nominal, below, window, (c("x"), c("y")), (0.05, 0.15)).where((F.abs(c("o_x") - c("x")) < across) & (F.abs(c("o_y") - c("y")) < down))
    lower = near.groupBy("page_id", "block_no").agg(F.min_by("o_value", "o_block_no").alias("lower"))
    choices = nominal.join(lower, ["page_id", "block_no"])
    box = ["page_id", "block_no", "x", "y", "width", "height"]
    larger = (overlap_ratio() > 0.7) & (c("o_width") * c("o_height") > c("width") * c("height") * 1.5)
    inside = meeting_boxes(choices.select(*box), choices.where(c("text").contains(".")).select(*box)).where(larger & (c("block_no") != c("o_block_no"))).select("page_id", "block_no").distinct()
    whole = choices.join(inside, ["page_id", "block_no"], "left_anti").withColumn("own", c("source") == "pdf_text")
    some = whole.withColumn("any", F.max("own").over(Window.partitionBy("page_id"))).where("own or not any")
    found = some.groupBy("page_id").agg(F.countDistinct("value").alias("n"), F.min(F.struct("block_no", "value", "lower")).alias("b"))
    return found.where("n = 1").select("page_id", "b.*")


def gap_cluster(blocks: DataFrame, value: str, epsilon: float, group: list[str], order: list[str]) -> DataFrame:
    """One-dimensional clusters: a new one where the gap to the value before exceeds epsilon."""
    w = Window.partitionBy(*group).orderBy(value, *order)
    new = (F.col(value) - F.lag(value).over(w) > epsilon).cast("long")
    return blocks.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def glyph_runs(blocks: DataFrame, lane: Column, gap: float) -> DataFrame:
    """Single digits stacked in a lane, read downwards, joined into numbers where the gap is small."""
    digits = blocks.where(F.length("text") == 1).withColumn("lane", lane)
    runs = gap_cluster(digits, "y", gap, ["page_id", "lane"], ["block_no"])
    out = runs.groupBy("page_id", "lane", "cluster").agg(F.array_sort(F.collect_list(F.struct("y", "block_no", "text"))).alias("all"))
    return out.select("page_id", "lane", "cluster", F.array_join("all.text", "").alias("number"), F.size("all").cast("long").alias("n"))


def layout_hint(blocks: DataFrame, least: int = 3) -> DataFrame:
    """Pages that repeat a label in at least so many places."""
    repeated = blocks.groupBy("page_id", "text").agg(F.countDistinct(F.round("x", 2)).alias("places"))
    return repeated.groupBy("page_id").agg(F.max("places").alias("places")).select("page_id", "places", (F.col("places") >= least).alias("multi"))


def row_regions(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Bands between the midpoints of neighbouring anchors, with the extent of the blocks in them."""
    w = Window.partitionBy("page_id").orderBy("y")
    bands = anchors.select("page_id", "y").distinct().select("page_id", "y", F.coalesce((F.lag("y").over(w) + F.col("y")) / 2, F.lit(-1e9)).alias("top"), F.coalesce((F.lead("y").over(w) + F.col("y")) / 2, F.lit(1e9)).alias("bottom"))
    b = prefixed(blocks.select("page_id", "x", "y", "width"), "o_")
    found = bands.join(b, (bands.page_id == b.o_page_id) & (b.o_y >= bands.top) & (b.o_y < bands.bottom))
    return found.groupBy("page_id", "y").agg(F.count("*").alias("n"), F.round(F.min("o_x"), 9).alias("left"), F.round(F.max(F.col("o_x") + F.col("o_width")), 9).alias("right"))


def locate_field(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The block with the best score for each key, or none if several share it."""
    best = scored.groupBy(*keys).agg(F.max("score").alias("best"))
    n = scored.join(best, keys).where("score = best").groupBy(*keys, "best").agg(F.count("*").alias("n"), F.min("block_no").alias("block"))
    return n.select(*keys, "best", F.when(F.col("n") == 1, F.col("block")).alias("block_no"), F.when(F.col("n") == 1, "located").otherwise("ambiguous").alias("state"))


def support_value(claims: DataFrame, blocks: DataFrame, within: float) -> DataFrame:
    """Whether exactly one independent number stands at the place of a claim, and whether it is the claimed one."""
    near = (F.abs(F.col("x") - F.col("o_x")) <= within) & (F.abs(F.col("y") - F.col("o_y")) <= within)
    found = pairs(claims, blocks, near & (F.col("block_no") != F.col("o_block_no"))).groupBy("page_id", "block_no", "text").agg(F.countDistinct("o_text").alias("n"), F.min("o_text").alias("only"))
    return found.select("page_id", "block_no", F.when((F.col("n") == 1) & (F.col("only") == F.col("text")), "supported").when(F.col("n") == 1, "contradicted").otherwise("ambiguous").alias("state"))


def annotation_merge(old: DataFrame, rebuilt: DataFrame, most: float) -> DataFrame:
    """Rebuilt locations take the id of the old one that is nearest, where each is the other's nearest; others are new."""
    d = F.round(F.abs(F.col("x") - F.col("o_x")) + F.abs(F.col("y") - F.col("o_y")), 9)
    both = pairs(rebuilt, old).withColumn("d", d).where(F.col("d") <= most)
    forward = F.row_number().over(Window.partitionBy("page_id", "block_no").orderBy("d", "o_block_no"))
    back = F.row_number().over(Window.partitionBy("page_id", "o_block_no").orderBy("d", "block_no"))
    mutual = both.withColumn("f", forward).withColumn("b", back).where("f = 1 and b = 1").select("page_id", "block_no", F.col("o_block_no").alias("old_no"))
    return rebuilt.join(mutual, ["page_id", "block_no"], "left").select("page_id", "block_no", "old_no", F.when(F.col("old_no").isNull(), "new").otherwise("kept").alias("state"))


def apply_patch(blocks: DataFrame, patch: DataFrame) -> DataFrame:
    """Position edits: known block, one edit a block, coordinates in 0..1; others are rejected with a reason."""
    n = patch.groupBy("page_id", "block_no").agg(F.count("*").alias("edits"), F.min("new_x").alias("new_x"))
    out = n.join(blocks.select("page_id", "block_no", "x"), ["page_id", "block_no"], "left")
    reason = F.when(F.col("x").isNull(), "unknown").when(F.col("edits") > 1, "repeated").when(~F.col("new_x").between(0, 1), "range").otherwise("ok")
    return out.select("page_id", "block_no", reason.alias("reason"), F.when(reason == "ok", F.col("new_x")).otherwise(F.col("x")).alias("x"))
