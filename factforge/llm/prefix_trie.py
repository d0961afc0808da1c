"""The trie of conversations' turn prefixes, its subtree sums by the Euler-tour technique.

A turn is a digest of role and text and a number of words; texts go no further. Turns of a conversation get their
positions, and prefixes their digests (exclusive or of position-wise digests, 120 bits), by scans over sorted ranges with
one summary row for each range and conversation, so a conversation of any length is divided. A node is a prefix digest.

The tour enters and leaves each node: two arcs, linked by first child, next sibling and parent. Siblings are in order of
their smallest member. Children of one parent meet only within a range of nodes; ranges are linked by a row for each
range and parent, so a parent of very many children is divided as well. The list of arcs is ranked in two levels: a task
contracts the chains inside its chunk of the nodes' order, the chunks' heads form a much shorter list that pointer
doubling ranks (in one task while it is short), and each arc adds what its chain's end knows. The weights carried are
arcs, leaves and saved tokens, so the ranks are prefix sums at arc positions, and a subtree's sum is that at its enter arc
less that at its exit arc.

Null role and text are empty; a null turn comes first; turns that tie are in order of their digest. Rows with a null
conv_id belong to no conversation. Repeated rows are turns of their own. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factforge.llm.common import clean_up, durable, new_folder, partitions, written

#: Nodes that a task links at once, and arcs that one task ranks.
CHUNK, ALONE = 1 << 18, 1 << 17
#: Bytes of ids in a row that is hashed.
ID_BYTES = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
END = -1
WORD = r"[^\x20\x09-\x0D]+"


def in_ranges(df: DataFrame, *order) -> DataFrame:
    """Sorted by range, with `row` ascending over all rows and `part`, the range."""
    ordered = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return durable(ordered.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()))


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), d1, d2 (the turn's digest), words; part and row of the order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    turns = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = durable(turns.where("conv_id is not null").select("conv_id", "turn", half(1).alias("d1"), half(16).alias("d2"), "words"))
    turns = turns.withColumn("seq", F.monotonically_increasing_id())  # equal rows can be divided
    turns = in_ranges(turns, F.col("conv_id"), F.col("turn").asc_nulls_first(), "d1", "d2", "seq")
    runs = turns.groupBy("part", "conv_id").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return durable(turns.join(runs, ["part", "conv_id"]).select("conv_id", (F.col("before") + F.col("row") - F.col("first") + 1).alias("pos"), "d1", "d2", "words", "part"))


def with_heads(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of the first conversation of their group of ids, h = crc32(id) % heads.
    Returns the turns and (conv_id, n_turns) of every conversation, without turns as well."""
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    donors = sizes.select(F.col("conv_id").alias("donor"), F.col("n").alias("donor_n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = sizes.withColumn("donor", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h).join(donors, "donor", "left")
    taken = F.least("h", F.coalesce("donor_n", F.lit(0)))
    convs = durable(convs.select("conv_id", "donor", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "donor")
    given = convs.where("taken > 0").select("conv_id", "donor", "taken").join(first, "donor").where("pos <= taken").select("conv_id", "pos", "d1", "d2", "words", F.lit(-1).alias("part"))
    # A conversation's turns meet its one row range by range.
    per = turns.select("part", "conv_id").distinct().join(convs, "conv_id").select("part", "conv_id", "h", "taken")
    own = turns.join(per, ["part", "conv_id"]).where("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "d1", "d2", "words", "part")
    return given.unionByName(own), convs.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, depth, words, n1, n2 (digest of the prefix that ends here), p1, p2 (of the one before); and conv_id, n1, n2 of whole conversations."""
    at = durable(turns.select("conv_id", "pos", "words", "part", F.xxhash64(F.lit(1), "pos", "d1", "d2").alias("e1"), F.xxhash64(F.lit(2), "d2", "pos", "d1").alias("e2")))
    runs = at.groupBy("part", "conv_id").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select("part", "conv_id", *(F.coalesce(F.bit_xor(f"x{i}").over(earlier), F.lit(0)).alias(f"b{i}") for i in (1, 2)))
    so_far = Window.partitionBy("part", "conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(before, ["part", "conv_id"]).withColumns({f"n{i}": F.bit_xor(f"e{i}").over(so_far).bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    whole = runs.groupBy("conv_id").agg(F.bit_xor("x1").alias("n1"), F.bit_xor("x2").alias("n2"))
    return out.select("conv_id", F.col("pos").alias("depth"), "words", "n1", "n2", *(F.col(f"n{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2))), whole


def nodes_of(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each prefix, the root included: n1, n2, p1, p2, depth, conv_id (the smallest member), n_convs, words."""
    inner = steps.groupBy("n1", "n2").agg(*(F.min(c).alias(c) for c in ("p1", "p2", "depth", "conv_id")), F.count("*").alias("n_convs"), F.min("words").alias("words"))
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    return inner.unionByName(root.select(zero.alias("n1"), zero.alias("n2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("words")))


def tour(nodes: DataFrame) -> DataFrame:
    """Each node's two arcs: `row` numbers the node, 2 * row is its enter arc and 2 * row + 1 its exit arc; enter_next and exit_next are
    the arcs after them; parent_conv_id and n_children besides."""
    nodes = in_ranges(nodes, "conv_id", "depth")
    runs = nodes.where("p1 is not null").groupBy("part", "p1", "p2").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    by_part, whole = Window.partitionBy("p1", "p2").orderBy("part"), Window.partitionBy("p1", "p2")
    runs = runs.select("part", "p1", "p2", "first", F.lead("first").over(by_part).alias("later"), (F.row_number().over(by_part) == 1).alias("leads"), F.sum("n").over(whole).alias("n_children"))
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("row").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    runs = durable(runs.join(parents, ["p1", "p2"]))
    below = runs.where("leads").select(F.col("up").alias("row"), F.col("first").alias("child"), "n_children")
    out = nodes.join(runs.select("part", "p1", "p2", "later", "up", "parent_conv_id"), ["part", "p1", "p2"], "left")
    out = out.withColumn("sibling", F.coalesce(F.lead("row").over(Window.partitionBy("part", "p1", "p2").orderBy("row")), F.col("later")))
    out = out.join(below, "row", "left")
    enter = F.coalesce(2 * F.col("child"), 2 * F.col("row") + 1)
    leave = F.coalesce(2 * F.col("sibling"), 2 * F.col("up") + 1, F.lit(END))
    saved = (F.col("n_convs") - 1) * F.col("words")
    return out.select("row", "conv_id", "depth", "n1", "n2", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), enter.alias("enter_next"), leave.alias("exit_next"), saved.alias("saved"))


def chains(arcs: np.ndarray, after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the sorted arcs: the arc after its chain's end, the chain's weights from here on; and whether nothing here leads to it."""
    n = len(arcs)
    at = np.minimum(np.searchsorted(arcs, after), n - 1)
    here = arcs[at] == after
    head = np.ones(n, bool)
    head[at[here]] = False
    step = np.append(np.where(here, at, n), n)
    last, total = np.append(np.arange(n), n), np.concatenate([weights, np.zeros((1, weights.shape[1]), np.int64)])
    while (step < n).any():
        total = total + total[step]
        last = np.where(step < n, last[step], last)
        step = step[step]
    return after[last[:n]], total[:n], head


SUMS = ["arcs", "leaves", "saved"]
ARC = "arc long, after long, " + ", ".join(f"{c} long" for c in SUMS)


def contracted(links: DataFrame, chunk: int) -> DataFrame:
    """The nodes with, for either arc, the first arc outside the chunk that its chain leads to, the weights up to there, and whether
    the arc is a head that arcs of other chunks lead to."""
    sides = ("enter", "exit")
    more = [f"{s}_{c}" for s in sides for c in ("after", *SUMS)]
    kept = [f for f in links.schema.fields if f.name not in ("enter_next", "exit_next", "saved")]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["chunk long"] + [f"{c} long" for c in more] + [f"{s}_head boolean" for s in sides])

    def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        get = lambda c: whole.column(c).to_numpy()
        row, n = get("row"), whole.num_rows
        arcs, after, weights = np.empty(2 * n, np.int64), np.empty(2 * n, np.int64), np.zeros((2 * n, 3), np.int64)
        arcs[0::2], arcs[1::2], after[0::2], after[1::2] = 2 * row, 2 * row + 1, get("enter_next"), get("exit_next")
        weights[:, 0], weights[0::2, 1], weights[0::2, 2] = 1, get("n_children") == 0, get("saved")
        then, total, head = chains(arcs, after, weights)
        columns = [*(whole.column(f.name) for f in kept), pa.array(np.full(n, row[0]))]
        columns += [pa.array(np.ascontiguousarray(x)) for s in (0, 1) for x in (then[s::2], *(total[s::2, i] for i in range(3)))] + [pa.array(head[0::2]), pa.array(head[1::2])]
        return pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "chunk", *more, *(f"{s}_head" for s in sides)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, chunk - count))
                batch, count = batch.slice(held[-1].num_rows), count + held[-1].num_rows
                if count == chunk:
                    yield done(held)
                    held, count = [], 0
        if held:
            yield done(held)

    return links.repartitionByRange(partitions(links.sparkSession), "row").sortWithinPartitions("row").mapInArrow(run, schema)


def ranked(heads: DataFrame, alone: int) -> DataFrame:
    """(arc, after, weights to the end of the list) from (arc, after, weights up to `after`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0].sort_by("arc")
            arcs, after = (whole.column(c).to_numpy() for c in ("arc", "after"))
            then, total, _ = chains(arcs, after, np.stack([whole.column(c).to_numpy() for c in SUMS], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(arcs), pa.array(then), *(pa.array(np.ascontiguousarray(total[:, i])) for i in range(3))], ["arc", "after", *SUMS])

    if heads.count() <= alone:
        return durable(heads.coalesce(1).mapInArrow(run, ARC))
    while not heads.where(F.col("after") != END).isEmpty():
        there = heads.select(F.col("arc").alias("after"), F.col("after").alias("then"), *(F.col(c).alias(f"{c}_then") for c in SUMS))
        heads = heads.join(there, "after", "left").select("arc", F.coalesce("then", F.lit(END)).alias("after"), *((F.col(c) + F.coalesce(f"{c}_then", F.lit(0))).alias(c) for c in SUMS))
        heads = durable(heads)
    return heads


def subtree_sums(links: DataFrame, chunk: int = CHUNK, alone: int = ALONE) -> DataFrame:
    """The nodes with n_leaves and saved_tokens of their subtrees, and enter_at and exit_at, their arcs' positions in the tour from 0."""
    kept = [c for c in links.columns if c not in ("row", "enter_next", "exit_next", "saved")]
    parts = durable(contracted(links, chunk))
    n = parts.count()
    side = lambda s: parts.where(f"{s}_head").select((2 * F.col("row") + int(s == "exit")).alias("arc"), F.col(f"{s}_after").alias("after"), *(F.col(f"{s}_{c}").alias(c) for c in SUMS))
    heads = ranked(durable(side("enter").unionByName(side("exit"))), alone).drop("after")
    ends = parts.select("chunk", F.explode(F.array("enter_after", "exit_after")).alias("arc")).distinct().join(heads, "arc")
    for s in ("enter", "exit"):  # an arc's sum is that of its chain and of what comes after it; a chunk has few chains
        own = ends.select("chunk", F.col("arc").alias(f"{s}_after"), *(F.col(c).alias(f"{c}_then") for c in SUMS))
        parts = parts.join(own, ["chunk", f"{s}_after"], "left")
        parts = parts.withColumns({f"{s}_{c}": F.col(f"{s}_{c}") + F.coalesce(f"{c}_then", F.lit(0)) for c in SUMS}).drop(*(f"{c}_then" for c in SUMS))
    within = lambda c: F.col(f"enter_{c}") - F.col(f"exit_{c}")
    place = lambda s: 2 * n - F.col(f"{s}_arcs")
    return parts.select(*kept, within("leaves").alias("n_leaves"), within("saved").alias("saved_tokens"), place("enter").alias("enter_at"), place("exit").alias("exit_at"))


def end_hashes(ends: DataFrame) -> DataFrame:
    """n1, n2, ends_sha256 of the ascending, comma-joined conv_ids of each node. Ids are joined by range, so the one task that
    hashes a node's ids reads few long rows, in order."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, first, out = None, [], 0, 0, []

        def full() -> pa.RecordBatch:
            a, b, c, d = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["n1", "n2", "first", "ids"])

        for batch in batches:
            for n1, n2, conv in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "conv_id")), strict=True):
                if key != (n1, n2) or size >= ID_BYTES:
                    if ids:
                        out.append((*key, first, b",".join(ids)))
                    key, ids, size, first = (n1, n2), [], 0, conv
                ids.append(b"%d" % conv)
                size += len(ids[-1]) + 1
            if out:
                yield full()
        if ids:
            out.append((*key, first, b",".join(ids)))
            yield full()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def full() -> pa.RecordBatch:
            a, b, c = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c)], ["n1", "n2", "ends_sha256"])

        for batch in batches:
            for n1, n2, ids in zip(*(batch.column(c).to_pylist() for c in ("n1", "n2", "ids")), strict=True):
                if key == (n1, n2):
                    state.update(b",")
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (n1, n2), hashlib.sha256()
                state.update(ids)
            if out:
                yield full()
        if key:
            out.append((*key, state.hexdigest()))
            yield full()

    n = partitions(ends.sparkSession)
    joined = ends.repartitionByRange(n, "n1", "n2", "conv_id").sortWithinPartitions("n1", "n2", "conv_id").mapInArrow(join, "n1 long, n2 long, first long, ids binary")
    return joined.repartition(n, "n1", "n2").sortWithinPartitions("n1", "n2", "first").mapInArrow(digest, "n1 long, n2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4, chunk: int = CHUNK, alone: int = ALONE) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, enter_at, exit_at
    (positions of its arcs in the tour)."""
    spark = conversations.sparkSession
    result, before = new_folder(spark, "trie"), written()
    turns, convs = with_heads(turns_of(conversations), group, heads)
    steps, whole = prefixes(turns)
    ends = durable(convs.select("conv_id").join(whole, "conv_id", "left").fillna(0, ["n1", "n2"]))
    sums = subtree_sums(durable(tour(durable(nodes_of(steps, convs)))), chunk, alone)
    out = sums.join(end_hashes(ends), ["n1", "n2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    out = durable(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "enter_at", "exit_at"), result)
    clean_up(spark, before)
    return out
