"""Line dedup with two Bloom filters, and confirmation of what they suspect.

Pass one hashes every line's key into a filter of keys seen once and a filter of keys seen twice. A task holds both as
bits, of a fixed size, and sends what it has set; filters of the tasks are joined so that a key set by two tasks is
in the second filter. Pass two shuffles a key only if the second filter may hold it; there keys, as 128-bit digests, are
counted over distinct documents, and the largest doc_id that holds a key is chosen. Keys of more documents than
a bound go back to their documents by broadcast (their number is bounded by that), all others by a join. The filters have a fixed
size (``BITS``): beyond that they fill up and suspect more, which costs shuffle and never changes a result.

Null and empty texts are one empty line, which has no key of the least length. Rows that repeat a doc_id
count as one document. Rows with a null doc_id are left as they are and not counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.llm.common import durable, id_text, map_text, partitions, raw, sliced

#: Bits of each filter: 16 MB, the proven bound of what is broadcast.
BITS = 1 << 27
BLOCK = 1 << 18
HASHES = 3
#: A key in more rows than this is hot, and in more than one of so many of all rows: there are HOT_KEYS of these at most.
HOT_ROWS, HOT_KEYS = 5_000, 10_000
#: Hashes that a task gathers before it sets their bits.
GATHERED = 200_000
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """A-Z to lower case, the six white-space characters stripped at both ends."""
    return line.strip(SPACE).lower()


def code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def keys_of(text: bytes, least: int) -> list[bytes]:
    return [k for line in text.split(b"\n") if len(line) >= least and len(k := line_key(line)) >= least and code_points(k) >= least]


def positions(hashes: np.ndarray) -> np.ndarray:
    """The bits of each hash, a row for each hash function, all within one block."""
    block, low = hashes % np.uint64(BITS // BLOCK) * np.uint64(BLOCK), hashes >> np.uint64(20)
    step = (hashes >> np.uint64(40)) | np.uint64(1)
    return np.stack([block + (low + np.uint64(i) * step) % np.uint64(BLOCK) for i in range(HASHES)])


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of a column are set."""
    return ((bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0)


def put(bits: np.ndarray, at: np.ndarray) -> None:
    """Sets bits."""
    if len(at):
        at = np.sort(at)
        byte = (at >> np.uint64(3)).astype(np.int64)
        head = np.flatnonzero(np.diff(byte, prepend=-1))
        bits[byte[head]] |= np.bitwise_or.reduceat((np.uint64(128) >> (at & np.uint64(7))).astype(np.uint8), head)


def sent(block: np.ndarray) -> bytes:
    """A block's set bits: their places where these are few, else all bits."""
    at = np.flatnonzero(np.unpackbits(block)).astype("<u4")
    return b"p" + at.tobytes() if 4 * len(at) < len(block) else b"b" + block.tobytes()


def received(block: bytes) -> np.ndarray:
    return np.frombuffer(block, "<u4", -1, 1) if block[:1] == b"p" else np.flatnonzero(np.unpackbits(np.frombuffer(block, np.uint8, -1, 1)))


def task_filters(docs: DataFrame, least: int) -> DataFrame:
    """(block, once, twice): for each task and block the bits of keys seen, and of keys seen more than once in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(BITS // 8, np.uint8) for _ in range(2))

        def note(seen: list[int]) -> None:
            hashes, count = np.unique(np.array(seen, np.uint64), return_counts=True)
            at = positions(hashes)
            again = (count > 1) | has(once, at)
            put(twice, at[:, again].ravel())
            put(once, at.ravel())

        seen: list[int] = []
        for batch in batches:
            for part in sliced(batch, "text"):
                for text in raw(part):
                    seen += map(xxhash.xxh3_64_intdigest, set(keys_of(text, least)))
                if len(seen) >= GATHERED:
                    note(seen)
                    seen = []
        if seen:
            note(seen)
        rows = [(block, *(sent(x[block * BLOCK // 8 : (block + 1) * BLOCK // 8]) for x in (once, twice))) for block in np.flatnonzero(once.reshape(-1, BLOCK // 8).any(axis=1)).tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], ["block", "once", "twice"])

    return docs.mapInArrow(run, "block int, once binary, twice binary")


def twice_filter(docs: DataFrame, least: int) -> bytes:
    """The second filter, joined over all tasks: at most BITS/8 bytes reach the driver."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, *found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                once, twice = held.setdefault(block, (np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)))
                new, again = map(received, found)
                twice[new[once[new]]] = True  # set by an earlier task as well
                twice[again] = True
                once[new] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(t).tobytes() for _, t in held.values()], pa.binary())], ["block", "twice"])

    spark = docs.sparkSession
    parts = task_filters(docs, least).repartition(partitions(spark), "block").mapInArrow(merge, "block int, twice binary")
    whole = bytearray(BITS // 8)
    for row in parts.toLocalIterator():
        whole[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = row.twice
    return bytes(whole)


def suspects(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, key): a row for each document and key that the second filter may hold; keys as 128-bit digests."""
    known = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, least))

    def work():
        bits = np.frombuffer(known.value, np.uint8)

        def each(part: pa.RecordBatch) -> pa.RecordBatch | None:
            ids, keys = [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), raw(part), strict=True):
                own = set(keys_of(text, least))
                ids += [doc] * len(own)
                keys += own
            if not keys:
                return None
            at = positions(np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys)))
            hit = has(bits, at)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).filter(pa.array(hit)), pa.array([digest(k) for k, h in zip(keys, hit, strict=True) if h], pa.binary())], ["doc_id", "key"])

        return each

    return map_text(docs.where("doc_id is not null"), work, "doc_id long, key binary").distinct()


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, documents: int = 5, keep_row: bool = False) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_dropped, and with keep_row the whole row as the struct `row`: lines whose key of at least `least` code points is in at least
    `documents` documents stay in the largest doc_id alone. Rows keep their number; a repeated doc_id keeps all its rows."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = id_text(docs, id_col, text_col)
    rows, extra = (rows, ["row"]) if keep_row else (docs, [])
    kind = f"row {rows.schema['row'].dataType.simpleString()}, " if keep_row else ""
    held = durable(suspects(docs, least))
    # Counts by the exact key aggregate before the shuffle: a line of half the corpus is a row a task.
    frequent = held.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= documents)
    frequent = durable(frequent)
    most = max(HOT_ROWS, held.count() // HOT_KEYS)
    hot = F.broadcast(frequent.where(F.col("n") > most))  # bounded: HOT_KEYS rows
    both = held.join(hot, "key").unionByName(held.join(hot, "key", "left_anti").join(frequent.where(F.col("n") <= most), "key"))
    losing = both.where(F.col("doc_id") != F.col("keep")).groupBy("doc_id").agg(F.collect_set("key").alias("lost"))

    def cut():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            out, counts, dropped = [], [], []
            for text, lost in zip(raw(part), part.column("lost").to_pylist(), strict=True):
                lines = text.split(b"\n")
                left = lines
                if lost:
                    gone = set(lost)
                    left = [x for x in lines if len(x) < least or code_points(k := line_key(x)) < least or digest(k) not in gone]
                out.append(b"\n".join(left))
                counts.append(len(lines))
                dropped.append(len(lines) - len(left))
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in [*extra, "doc_id"]), pa.array(out, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [*extra, "doc_id", "text", "n_lines", "n_dropped"])

        return each

    return map_text(rows.join(losing, "doc_id", "left"), cut, f"{kind}doc_id long, text string, n_lines long, n_dropped long")
