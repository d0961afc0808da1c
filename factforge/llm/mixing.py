"""Mixing sources to target weights, in DataFrame operations only.

Documents of a source, in order of a hash, form one run of words that is cut into blocks of fixed length. Weights
become a target of words for each source, capped at a multiple of its size, and so a number of slots (one a block taken).
For each output shard the counts of all sources are drawn: a source's slots are halved by binomial draws down a tree of the
shards, which makes the shards' counts a multinomial draw whose totals hold exactly. The counts number the slots, and slot i
takes block permutation(i): a per-source affine bijection that passes over all blocks before any is taken again. The
last slot takes the part of a block that is left to the target. Blocks and slots meet by index.

Null and empty texts have size 0, are in no block and are taken 0 times. A null source is a source, after all others.
Rows that repeat are taken each on its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factforge.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block.
BLOCK = 128
#: Rows of a group that a source's documents are dealt into on average, so that no source's run of words is summed in one task; bits of the least number of groups.
GROUP_ROWS, GROUP_BITS = 50_000, 10
#: Most sources whose row is sent to all tasks; more are joined by source and salt.
SENT_SOURCES, SALTS = 100_000, 64
#: Draws of more slots are made by the normal distribution.
EXACT_DRAW = 256
#: Levels of the tree of shards after which its nodes are dealt over tasks, and the shards of a task.
DEALT_LEVEL, TASK_SHARDS = 8, 64
#: Slots of a task: so many while there are few tasks, at most so many.
TASK_SLOTS, MOST_SLOTS = 1 << 18, 1 << 24
#: Blocks that one output shard holds on average.
SHARD_BLOCKS = 4096
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 42


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target. sizes: a row for each source (its number is small and known: one row for each).

    A target is min(most * size, level * weight). The level is found from the running sums over the sources in order of
    size / weight: those before are capped, those after share what is left by weight."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (n % len(weights) + 1).cast("int")))
    full = weighed.withColumn("cap", F.col("source_size") * most)
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, every = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # The level of the first source that stays under its cap is the one; those computed after it are lower.
    found = full.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return found.select("source", "source_size", target.alias("target"))


def beside_source(rows: DataFrame, sources: DataFrame, number: int) -> DataFrame:
    """rows with the columns of their source's row. A hot source's rows never meet in one task."""
    t = sources.withColumnRenamed("source", "s")
    if number <= SENT_SOURCES:
        return rows.join(F.broadcast(t), rows.source.eqNullSafe(t.s)).drop("s")
    t = t.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("own", F.pmod("uid", F.lit(SALTS))).join(t.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("own") == F.col("salt"))).drop("s", "own", "salt")


def placed(docs: DataFrame, source_col: str, seed: int, bits: int = GROUP_BITS) -> DataFrame:
    """docs with `start`: the words of its source before it, summed in groups of a hash's range and then over the groups."""
    row = docs.withColumn("h", F.xxhash64(F.lit(seed), "uid")).withColumn("g", F.shiftrightunsigned("h", 64 - bits).cast("int"))
    groups = row.groupBy(source_col, "g").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(source_col).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).select(F.col(source_col).alias("s"), F.col("g").alias("gg"), "base")
    inside = Window.partitionBy(source_col, "g").orderBy("h", "uid", "dup").rowsBetween(Window.unboundedPreceding, -1)
    row = row.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return row.join(groups, row[source_col].eqNullSafe(groups.s) & (row.g == groups.gg)).withColumn("start", F.col("base") + F.col("inside")).drop("s", "gg", "g", "h", "base", "inside")


def times(a: Column, b: Column, n: Column) -> Column:
    """a * b modulo n, of any longs."""
    return (a.cast("decimal(19,0)") * b.cast("decimal(19,0)") % n.cast("decimal(19,0)")).cast("long")


def stride(n: Column, source: Column, seed: int) -> Column:
    """A prime that n isn't a multiple of, by a hash of the source."""
    primes = (1000003, 998244353, 715827883, 536870909, 402653189)
    at = F.pmod(F.xxhash64(source, F.lit(seed)), F.lit(len(primes)))
    a = F.lit(2147483647)
    for k, p in enumerate(primes):
        a = F.when((at == k) & (n % p != 0), F.lit(p)).otherwise(a)
    return a.cast("long")


def uniform(*what: Column) -> Column:
    """A number above 0 and below 1 from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*what), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def binomial(n: Column, p: Column, *what: Column) -> Column:
    """How many of n slots fall to a side of probability p, from a hash: counted one by one, or beyond EXACT_DRAW by the normal distribution."""
    each = F.size(F.filter(F.sequence(F.lit(1).cast("long"), F.least(n, F.lit(EXACT_DRAW))), lambda j: uniform(*what, j) < p)).cast("long")
    z = F.sqrt(-2 * F.ln(uniform(*what, F.lit(-1)))) * F.cos(2 * F.pi() * uniform(*what, F.lit(-2)))
    drawn = F.greatest(F.lit(0).cast("long"), F.least(n, F.round(n * p + z * F.sqrt(n * p * (1 - p))).cast("long")))
    return F.when(n == 0, F.lit(0).cast("long")).when(n <= EXACT_DRAW, each).otherwise(drawn)


def shard_counts(slots: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """source, shard, first, count: how many of a source's n slots each shard draws, and the number of the first of them.
    A level of the tree of shards is one projection; sides without slots leave. A large tree starts in the few tasks of its sources and is
    dealt over all tasks by source and node after DEALT_LEVEL levels, so that no task draws all shards of a source."""
    tree = slots.select("source", F.col("n").alias("count"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high")).where("count > 0")
    for level in range((shards - 1).bit_length()):
        if level == DEALT_LEVEL:
            # A number of its own: adaptive execution would join these few rows, of which each becomes very many.
            tree = tree.repartition(min(1 << DEALT_LEVEL, -(-shards // TASK_SHARDS)), "source", "low")
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        left = binomial(F.col("count"), (middle - F.col("low")) / (F.col("high") - F.col("low")), F.lit(seed + 2), F.col("source"), F.col("low"), F.col("high"))
        tree = tree.withColumn("left", F.when(F.col("high") - F.col("low") == 1, F.col("count")).otherwise(left)).withColumn("middle", F.greatest(middle, F.col("low") + 1))
        sides = F.array(F.struct(F.col("left").alias("count"), F.col("first"), F.col("low"), F.col("middle").alias("high")), F.struct((F.col("count") - F.col("left")).alias("count"), (F.col("first") + F.col("left")).alias("first"), F.col("middle").alias("low"), F.col("high")))
        tree = tree.select("source", F.inline(F.filter(sides, lambda x: x["count"] > 0)))
    return tree.select("source", F.col("low").alias("shard"), "first", "count")


def slots(targets: DataFrame, block: int = BLOCK, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """source, shard, block_index, words: what each slot takes."""
    t = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("want", F.floor("target").cast("long"))
    t = t.withColumn("short", F.lit(block) - (F.col("source_size") - (F.col("blocks") - 1) * block))
    # Where the short last block is passed, a slot counts less; so many slots reach the target.
    t = t.withColumn("n", F.ceil((F.col("want") + (F.floor(F.col("want") / F.col("source_size")) + 2) * F.col("short")) / block).cast("long"))
    t = t.withColumn("a", stride(F.col("blocks"), F.col("source"), seed)).withColumn("short_at", F.pmod(F.xxhash64("source", F.lit(seed + 1)), "blocks"))
    total = t.agg(F.sum("n").alias("n"), F.count("*").alias("sources")).first()  # one row
    drawn = shard_counts(t.where("want > 0"), max(1, -(-(total.n or 0) // shard_blocks)), seed)
    drawn = beside_source(drawn.withColumn("uid", F.xxhash64("source", "shard")), t.drop("n", "target", "source_size"), total.sources).drop("uid")
    few = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(few, -(-(total.n or 0) // TASK_SLOTS)), -(-(total.n or 0) // MOST_SLOTS))
    each = drawn.repartition(tasks, "source", "shard").withColumn("i", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    # Slot short_at, and each one a whole pass later, takes the last block.
    ahead = F.pmod(F.col("i") - F.col("short_at"), F.col("blocks"))
    each = each.withColumn("block_index", F.pmod(times(F.col("a") % F.col("blocks"), ahead, F.col("blocks")) + F.col("blocks") - 1, F.col("blocks")))
    passed = F.when(F.col("i") > F.col("short_at"), F.floor((F.col("i") - 1 - F.col("short_at")) / F.col("blocks")) + 1).otherwise(0)
    own = F.when(F.col("block_index") == F.col("blocks") - 1, F.lit(block) - F.col("short")).otherwise(F.lit(block))
    words = F.least(own, F.col("want") - (F.col("i") * block - passed * F.col("short")))
    return each.withColumn("words", words.cast("long")).where("words > 0").select("source", "shard", "block_index", "words")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, takes). rows: uid, dup, doc_id, source, size, source_size, target, start. takes: uid, dup, first, ends, shards: from
    word `first` on, once for each of the ends, up to that end, for that output shard. Equal rows share a uid and differ in dup."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(id_col, text_col, source_col).alias("uid"))
    rows = rows.groupBy("uid", "doc_id", "source", "size").agg(F.count("*").alias("copies"))
    rows = durable(rows.withColumn("dup", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies"))
    targets = durable(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    bits = max(GROUP_BITS, (rows.count() // GROUP_ROWS).bit_length())
    rows = durable(beside_source(placed(rows, "source", seed, bits), targets, targets.count()))
    end = F.col("start") + F.col("size")
    pieces = rows.where("size > 0").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    from_ = F.greatest(F.col("b") * block, F.col("start"))
    pieces = pieces.select("uid", "dup", F.col("source").alias("of"), "b", (from_ - F.col("start")).alias("first"), (F.least((F.col("b") + 1) * block, end) - F.col("start")).alias("stop"), (from_ - F.col("b") * block).alias("at"))
    taken = slots(targets, block, seed).groupBy("source", "block_index").agg(F.collect_list(F.struct("words", "shard")).alias("takes"))
    # Both sides are exploded rows, which Spark still takes for as few as they come from: it would send them through the driver.
    both = pieces.join(taken.hint("merge"), F.col("of").eqNullSafe(F.col("source")) & (F.col("b") == F.col("block_index")))
    ends = F.transform("takes", lambda x: F.struct(F.least(F.col("stop"), F.col("first") + x["words"] - F.col("at")).alias("end"), x["shard"].alias("shard")))
    both = both.withColumn("takes", F.sort_array(F.filter(ends, lambda x: x["end"] > F.col("first")), asc=False)).where(F.size("takes") > 0)
    return rows, both.select("uid", "dup", "first", F.col("takes.end").alias("ends"), F.col("takes.shard").alias("shards"))


def mix_counts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    rows, takes = mix(docs, **how)
    words = F.aggregate("ends", F.lit(0).cast("long"), lambda total, end: total + end - F.col("first"))
    taken = takes.groupBy("uid", "dup").agg(F.sum(words).alias("taken"))
    return rows.join(taken, ["uid", "dup"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix as documents with the columns of docs: the words taken of each, in order; those taken again are a second row.
    A row that takes all words keeps the text as it is; documents of which nothing is taken go."""
    rows, takes = mix(docs, id_col, text_col, source_col, **how)
    spans = takes.select("uid", "dup", "first", F.posexplode("ends").alias("copy", "end"))
    spans = spans.groupBy("uid", "dup", "copy").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"), F.sum(F.col("end") - F.col("first")).alias("words"))
    spans = spans.join(rows.select("uid", "dup", "size"), ["uid", "dup"]).groupBy("uid").agg(F.collect_list(F.struct("dup", "spans", (F.col("words") == F.col("size")).alias("whole"))).alias("copies"))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, source_col).alias("uid"))
    own = own.join(spans, "uid").withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy(F.lit(1))))
    own = own.withColumn("take", F.explode(F.filter("copies", lambda x: x["dup"] == F.col("n"))))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.transform("take.spans", lambda x: F.array_join(F.slice(words, x["first"].cast("int") + 1, (x["end"] - x["first"]).cast("int")), " ")), " ")
    text = F.when(F.col("take.whole"), F.col("text")).otherwise(cut)
    return own.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
