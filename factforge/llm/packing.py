"""Packing of token ids into sequences of fixed length by minimum bin slack.

A document's ids and the end id fill whole sequences of their own as far as they reach; what is left of it, its rest, is
shorter than a sequence. A task holds some thousand rests at once, counted by length. Each window takes the longest of
them and the multiset of the others whose sum comes closest to the room left: a subset-sum dynamic program over the
bits of an integer finds the sum, its steps are walked back for how often each length takes part, and the same multiset
is taken as often as the counts allow. Where the best sum leaves slack, a further rest is cut to fill it.

So every sequence is full but the last of a task, whose ids are dealt to sequences of powers of two, which need no
padding either. Nothing is shuffled: what a task holds is bounded, and a lost task is packed again the same way.

Null and empty texts are documents of the end id alone. Rows that repeat a doc_id are documents of their own, a null
doc_id stays null. An empty table has no sequences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from factforge.llm.common import OUT_BYTES, id_text, sliced
from factforge.llm.token_files import encoder_of

CAPACITY = 1024
#: Rests that a task holds at most, and down to which it packs them while more documents come.
HELD, KEPT = 8192, 2048
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fullest(counts: dict[int, int], capacity: int) -> Counter:
    """The multiset of lengths, the longest one among them, whose sum comes closest to the capacity: length to times."""
    longest = max(counts)
    room = capacity - longest
    mask, sums, steps = (2 << room) - 1, 1, []  # bit s of sums: the lengths seen so far have a multiset of sum s
    for length in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[length] - (length == longest), room // length)):
            more = (sums | sums << length) & mask
            if more == sums:
                break
            steps.append((length, sums))
            sums = more
        if sums >> room & 1:
            break
    used, at = Counter({longest: 1}), sums.bit_length() - 1
    for length, before in reversed(steps):
        if not before >> at & 1:  # this sum needs one more of the length
            used[length] += 1
            at -= length
    return used


class Packer:
    """The rests of one task by length, and the pieces that are placed already."""

    def __init__(self, capacity: int, sequence: int):
        self.capacity, self.sequence = capacity, sequence
        self.rests: dict[int, list[tuple]] = {}
        self.held = 0
        self.placed: list[tuple] = []

    def place(self, piece: tuple, offset: int) -> int:
        """Puts a piece (doc_id, start, ids, doc_tokens) into the open sequence; the offset after it."""
        doc, start, ids, total = piece
        self.placed.append((doc, start, len(ids) // 4, ids, total, self.sequence, offset))
        return offset + len(ids) // 4

    def hold(self, piece: tuple) -> None:
        self.rests.setdefault(len(piece[2]) // 4, []).append(piece)
        self.held += 1

    def take(self, length: int) -> tuple:
        piece = self.rests[length].pop()
        self.held -= 1
        if not self.rests[length]:
            del self.rests[length]
        return piece

    def add(self, doc: int | None, ids: bytes) -> None:
        total, size = len(ids) // 4, 4 * self.capacity
        whole = len(ids) - len(ids) % size
        for at in range(0, whole, size):
            self.place((doc, at // 4, ids[at : at + size], total), 0)
            self.sequence += 1
        if whole < len(ids):
            self.hold((doc, whole // 4, ids[whole:], total))

    def pack(self, kept: int = 0) -> None:
        """Fills windows until no more than `kept` rests are held, or all of them together fill none."""
        while self.held > kept:
            counts = {length: len(some) for length, some in self.rests.items()}
            used = fullest(counts, self.capacity)
            slack = self.capacity - sum(length * n for length, n in used.items())
            need = used.copy()
            if slack:  # whatever is left is longer than the slack
                cut = min((x for x in counts if counts[x] > used[x]), default=None)
                if cut is None:
                    return
                need[cut] += 1
            for _ in range(min(counts[length] // n for length, n in need.items())):
                offset = 0
                for length, n in used.items():
                    for _ in range(n):
                        offset = self.place(self.take(length), offset)
                if slack:
                    doc, start, ids, total = self.take(cut)
                    self.place((doc, start, ids[: 4 * slack], total), offset)
                    self.hold((doc, start + slack, ids[4 * slack :], total))
                self.sequence += 1

    def finish(self) -> None:
        """Fills windows; ids that are fewer than a window go to sequences of powers of two, the largest first."""
        self.pack()
        left = sum(length * len(some) for length, some in self.rests.items())
        offset, size = 0, 1 << left.bit_length() - 1 if left else 0
        for length in sorted(self.rests, reverse=True):
            for doc, start, ids, total in self.rests[length]:
                while ids:
                    part = ids[: 4 * (size - offset)]
                    offset = self.place((doc, start, part, total), offset)
                    start, ids = start + len(part) // 4, ids[len(part) :]
                    if offset == size:
                        left -= size
                        offset, size, self.sequence = 0, 1 << left.bit_length() - 1 if left else 0, self.sequence + 1
        self.rests, self.held = {}, 0

    def batch(self) -> pa.RecordBatch:
        columns, self.placed = list(zip(*self.placed, strict=True)), []
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", held: int = HELD, kept: int = KEPT) -> DataFrame:
    """A row for each piece: doc_id, start (the document's ids before it), length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset in the sequence. Sequence ids are ascending in a task, tasks are 2 ** 33 apart."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, size = encoder_of(path), Packer(capacity, TaskContext.get().partitionId() << 33), 0
        for batch in batches:
            for part in sliced(batch, "text"):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                    packer.add(doc, ids + end)
                    size += len(ids)
                    if packer.held >= held:
                        packer.pack(kept)
                    if size >= OUT_BYTES and packer.placed:
                        size = 0
                        yield packer.batch()
        packer.finish()
        if packer.placed:
            yield packer.batch()

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
