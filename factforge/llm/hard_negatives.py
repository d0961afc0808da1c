"""Hard negatives by Four-Russians scoring of quantised vectors.

Components become integers, floor(256 * x). A candidate's integers are kept as bit planes: for eight dimensions and one
bit, a byte. For each block of anchors and each eight dimensions a table holds the sums of all 256 subsets of the
anchors' components, so a byte's look-up is the part of the inner product that its bits make. From the highest plane
(which counts negative) down, scores are doubled and the looked-up sums added: whole, exact inner products.

Rows are numbered in order of vec_id and packed into blocks. Each block of anchors meets every block of candidates twice
in one ordered stream of a task: first to keep each anchor's best positives, then to keep, for each of them, the best
candidates of other labels in its score range. A task holds its anchors' tables, one block and these lists, and only the
lists leave it, so the output grows with the anchors and not with the pairs.

Rows with a null label, a null vector, or a null or non-finite component take no part. A row without a vec_id is never an
anchor and comes last in ties. Rows that repeat a vec_id are rows of their own, so a repeated anchor has its results
repeated. A shorter vector counts as one with zeros after its end. Products beyond 64 bits wrap around; components beyond
them take the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.llm.common import durable, partitions

#: Rows of a block of candidates, bytes of its bit planes at most, rows of it that are scored at once.
BLOCK, BLOCK_BYTES, STEP = 16_384, 16 << 20, 1024
#: Anchors of a block at most (their tables take 8 KB each for 64 dimensions), at least, and those scored at once.
ANCHORS, LEAST_ANCHORS, LANE = 1024, 64, 128
SCALE = 256
LOWEST = np.iinfo(np.int64).min


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, label) -> DataFrame:
    """uid, vec_id, label, vector of the rows that take part; uids ascend with vec_id, a null one last."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    x = x.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    if label is not None:
        x = x.withColumn("label", label(F.col("vec_id"), F.col("label")))
    order = [F.col("vec_id").asc_nulls_last(), F.xxhash64("vector", "label")]  # ranges divide the rows of one vec_id as well
    x = durable(x.repartitionByRange(partitions(x.sparkSession), *order).sortWithinPartitions(*order).withColumn("uid", F.monotonically_increasing_id()))
    return x.select("uid", "vec_id", "label", "vector")


def integers(vectors: list, dims: int) -> np.ndarray:
    """floor(256 * x) of each component, padded with zeros to `dims`."""
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        scaled = np.floor(np.asarray(v, np.float64) * SCALE)
        out[i, : len(v)] = np.where(scaled >= 2.0**63, np.iinfo(np.int64).max, np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64))
    return out


def bits_of(x: np.ndarray) -> int:
    """Bits of two's complement that hold every component."""
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return 1 + max((-least - 1).bit_length() if least < 0 else 0, most.bit_length())


def planes(x: np.ndarray) -> np.ndarray:
    """Bytes [plane, group of eight dimensions, row], the highest plane first."""
    n, width = x.shape[0], bits_of(x)
    out = np.zeros((width, x.shape[1] // 8, n), np.uint8)
    for at in range(width):
        out[at] = np.packbits((x >> (width - 1 - at) & 1).astype(bool), axis=1).T
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """Tables [group, byte, anchor]: the sum of the components whose bits the byte has."""
    groups = anchors.shape[1] // 8
    out = np.zeros((groups, 256, len(anchors)), kind)
    parts = anchors.astype(kind).reshape(len(anchors), groups, 8).transpose(1, 2, 0)  # [group, dimension, anchor]
    for bit in range(8):  # dimension 7 is the byte's lowest bit
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + parts[:, 7 - bit, None]
    return out


def scores(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Inner products [candidate, anchor] by look-ups, shifts and additions."""
    out = np.zeros((packed.shape[2], tables.shape[2]), tables.dtype)
    found = np.empty_like(out)
    for at, plane in enumerate(packed):
        if at:
            out += out
        for table, index in zip(tables, plane, strict=True):
            np.take(table, index, axis=0, out=found, mode="clip")
            if at:
                out += found
            else:
                out -= found
    return out


class Best:
    """The best `most` candidates of each slot: highest score first, then the smallest uid. Candidates come in order of uid."""

    def __init__(self, slots: int, most: int):
        self.most = most
        self.slot, self.score, self.uid = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros((0, 2), np.int64)  # vec_id, and whether it has one
        self.bar = np.full(slots, LOWEST)  # only a higher score enters a slot that is full
        self.full = np.zeros(slots, bool)

    def add(self, slot: np.ndarray, score: np.ndarray, uid: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, uid, ids = (np.concatenate([old, new.astype(np.int64)]) for old, new in ((self.slot, slot), (self.score, score), (self.uid, uid), (self.ids, ids)))
        order = np.lexsort((uid, ~score, slot))  # ~ turns the order of scores around, without overflow
        slot = slot[order]
        keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.most
        self.slot, order = slot[keep], order[keep]
        self.score, self.uid, self.ids = score[order], uid[order], ids[order]
        ends = np.flatnonzero(np.append(self.slot[1:] != self.slot[:-1], True))
        full = np.diff(np.append(-1, ends)) == self.most
        self.bar[self.slot[ends[full]]], self.full[self.slot[ends[full]]] = self.score[ends[full]], True


class Miner:
    """One block of anchors against the stream of candidates."""

    def __init__(self, uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, vectors: np.ndarray, positives: int, negatives: int, low: int, high: int):
        self.uid, self.vec_id, self.label, self.vectors, self.k, self.low, self.high = uid, vec_id, label, vectors, positives, low, high
        self.width, self.made = bits_of(vectors), {}
        self.positive, self.negative = Best(len(uid), positives), Best(len(uid) * positives, negatives)
        self.ranges: tuple | None = None

    def tables(self, width: int) -> list[np.ndarray]:
        """Subset sums for lanes of anchors, in 32 bits where all products fit."""
        kind = np.int32 if width + self.width + max(self.vectors.shape[1], 1).bit_length() <= 31 else np.int64
        if kind not in self.made:
            self.made[kind] = [subset_sums(self.vectors[at : at + LANE], kind) for at in range(0, len(self.uid), LANE)]
        return self.made[kind]

    def meet(self, again: bool, uid: np.ndarray, ids: np.ndarray, label: np.ndarray, packed: np.ndarray) -> None:
        for lane, table in enumerate(self.tables(packed.shape[0])):
            anchors = slice(lane * LANE, (lane + 1) * LANE)
            for at in range(0, len(uid), STEP):
                own = slice(at, at + STEP)
                found = scores(table, np.ascontiguousarray(packed[:, :, own]))
                same = label[own, None] == self.label[anchors]
                (self.keep_negatives if again else self.keep_positives)(lane * LANE, anchors, found, same, uid[own], ids[own])

    def keep_positives(self, base: int, anchors: slice, found: np.ndarray, same: np.ndarray, uid: np.ndarray, ids: np.ndarray) -> None:
        bar = self.positive.bar[anchors]
        row, col = np.nonzero(same & ((found > bar) | ~self.positive.full[anchors]) & (uid[:, None] != self.uid[anchors]))
        self.positive.add(base + col, found[row, col], uid[row], ids[row])

    def keep_negatives(self, base: int, anchors: slice, found: np.ndarray, same: np.ndarray, uid: np.ndarray, ids: np.ndarray) -> None:
        if self.ranges is None:
            self.ranges = self.score_ranges()
        least, most = self.ranges
        for k in range(self.k):
            slots = np.arange(base, base + found.shape[1]) * self.k + k
            bar = np.where(self.negative.full[slots], np.maximum(least[slots], self.negative.bar[slots] + 1), least[slots])
            row, col = np.nonzero((found >= bar) & (found <= most[slots]) & ~same)
            self.negative.add(slots[col], found[row, col], uid[row], ids[row])

    def score_ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and positive the least and the greatest score of a negative: low * p <= 100 * n <= high * p."""
        least, most = np.full(len(self.uid) * self.k, np.iinfo(np.int64).max), np.full(len(self.uid) * self.k, LOWEST)
        for slot, score in zip(self.slots().tolist(), self.positive.score.tolist(), strict=True):
            a, b = -(-self.low * score // 100), self.high * score // 100
            if a <= b:
                least[slot], most[slot] = a, b
        return least, most

    def slots(self) -> np.ndarray:
        """Slot of each kept positive: anchor * k + its rank."""
        s = self.positive.slot
        return s * self.k + np.arange(len(s)) - np.searchsorted(s, s)

    def result(self) -> pa.RecordBatch:
        n = self.negative
        at = np.searchsorted(self.slots(), n.slot)
        rank = np.arange(len(n.slot)) - np.searchsorted(n.slot, n.slot) + 1
        positive, negative = (pa.array(x[:, 0], mask=x[:, 1] == 0) for x in (self.positive.ids[at], n.ids))
        columns = [pa.array(self.vec_id[n.slot // self.k]), positive, pa.array(rank.astype(np.int32)), negative, pa.array(self.positive.score[at]), pa.array(n.score)]
        return pa.RecordBatch.from_arrays(columns, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, label=None, anchors: int = ANCHORS, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by `every`) and
    each of its best positives the best rows of other labels that score from `low` to `high` percent of the positive.
    `label(vec_id, label)` may give labels anew."""
    spark = vectors.sparkSession
    rows = prepared(vectors, id_col, vector_col, label_col, label)
    is_anchor = F.col("vec_id") % every == 0
    n_anchors, dims = rows.agg(F.count_if(is_anchor), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    dims = max(8, dims + -dims % 8)
    size = min(anchors, max(LEAST_ANCHORS, -(-n_anchors // partitions(spark))))
    groups = max(1, -(-n_anchors // size))
    per = max(1, min(block, BLOCK_BYTES // (2 * dims)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of candidates: the first uid; uids, vec_ids with whether there is one, labels, bit planes."""

        def done(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            uid, label = (np.concatenate([b.column(c).to_numpy() for b in some]) for c in ("uid", "label"))
            ids = np.array([(0, 0) if v is None else (v, 1) for b in some for v in b.column("vec_id").to_pylist()], np.int64)
            packed = planes(integers([v for b in some for v in b.column("vector").to_numpy(zero_copy_only=False)], dims))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (int(uid[0]), uid.tobytes(), ids.tobytes(), label.tobytes(), packed.tobytes())], ["at", "uids", "ids", "labels", "planes"])

        held, count = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, per - count))
                batch, count = batch.slice(held[-1].num_rows), count + held[-1].num_rows
                if count == per:
                    yield done(held)
                    held, count = [], 0
        if held:
            yield done(held)

    # A group's stream: its anchors (dealt by number), all blocks for the positives, all blocks again for the negatives. A task may read several
    # files of rows, in any order, so ranges of uids are made anew: ties need candidates in order of uid, within blocks and across them.
    ordered = rows.repartitionByRange(partitions(spark), "uid").sortWithinPartitions("uid")
    blocks = ordered.mapInArrow(pack, "at long, uids binary, ids binary, labels binary, planes binary")
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    own = rows.where(is_anchor).select(F.col("uid").alias("at"), F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("turn"), "vec_id", "label", "vector")
    stream = own.unionByName(blocks, allowMissingColumns=True).repartition(groups, "group").sortWithinPartitions("group", "turn", "at")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, anchors, miner = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("group", "turn")]
            for r, (g, turn) in enumerate(zip(*keys, strict=True)):
                if g != group:
                    if miner:
                        yield miner.result()
                    group, anchors, miner = g, [], None
                if turn == 0:
                    anchors.append(tuple(batch.column(c)[r].as_py() for c in ("at", "vec_id", "label", "vector")))
                    continue
                if anchors:
                    *numbers, vector = zip(*anchors, strict=True)
                    miner, anchors = Miner(*(np.array(x, np.int64) for x in numbers), integers(vector, dims), positives, negatives, low, high), []
                if miner:
                    uid, ids, label = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in ("uids", "ids", "labels"))
                    packed = np.frombuffer(batch.column("planes")[r].as_buffer(), np.uint8)
                    miner.meet(turn == 2, uid, ids.reshape(-1, 2), label, packed.reshape(-1, dims // 8, len(uid)))
        if miner:
            yield miner.result()

    return stream.mapInArrow(mine, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
