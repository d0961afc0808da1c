"""Repeated byte strings between documents, by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first ``threshold`` bytes, most significant digit first, so groups that are equal
at that depth are exactly the repeated windows.

* First digit: the least hash of the ``anchor``-byte strings inside a window. Equal windows have an equal one, and it rarely
  changes from a window to the next, so a run of windows has one. The first pass counts digits alone: a task sends each
  digit once with the bucket of its text, a digit that it saw in several documents already without any. Back come, by
  bucket of texts, the digits that several documents have; windows under all others are lone and never travel.
* The second pass sends the runs under those digits as strings. Of equal runs that a task holds at once the least document's
  travels; later documents are known at once. Digits whose counts make more than ``HOT`` bytes of runs no longer divide:
  their windows travel one by one under a 128-bit hash of all their bytes, so a string that is in every text spreads over
  as many shards as it has windows.
* A shard merges equal runs, opens those that are left into windows and refines the groups by eight bytes a pass. A pass
  sorts only the groups that its digit divides; groups of one document leave.

A window is removed in a document if a document with a smaller doc_id has it. Null and empty texts have no window. Rows that
repeat a doc_id are not smaller than each other; a null doc_id comes after all others. Texts of any length are cut into
pieces that overlap by a window, so no array grows with a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.llm.common import OUT_BYTES, durable, partitions, raw, scratch, shuffles_removed

#: Bytes of text that a task hashes at once: its arrays stay in the processor's cache.
SLICE = 256 << 10
#: Most bytes of text for each bucket of texts and shard of digits, on average; bytes of runs that a shard holds on average, if all texts repeat.
BUCKET, SHARD = 32 << 20, 4 << 20
#: Digits, bytes of runs and spans that a task holds before it sends them.
DIGITS, HELD, SPANS = 3_000_000, 48 << 20, 1_000_000
#: Bytes of runs of one digit above which its windows are dealt one by one, and the most digits of which that can be true; bytes of runs opened at once for that.
HOT, HOT_DIGITS, OPENED = 8 << 20, 1_000_000, 4 << 20
LAST = np.iinfo(np.int64).max
_U = np.uint64
_BYTES, _OTHERS = (np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for seed in (11, 12))
_STEP, _BACK = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FIRST, _SECOND = _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def anchor(threshold: int) -> int:
    """Bytes of the strings whose least hash is a window's first digit."""
    if threshold < 8:
        raise ValueError("threshold of less than 8 bytes")
    return 16 if threshold >= 32 else 8


def string_hashes(data: np.ndarray, wide: int) -> np.ndarray:
    """The hash of the string of `wide` bytes (8 or 16) from each position on."""
    m = len(data) - wide + 1
    word = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = word[:m] * _FIRST
    if wide == 16:
        out ^= out >> _U(29)
        out += word[8 : 8 + m] * _SECOND
    out ^= out >> _U(32)
    out *= _STEP
    out ^= out >> _U(29)
    return out


def anchors(data: np.ndarray, threshold: int) -> np.ndarray:
    """For each position the least hash of the anchor strings in the window that starts there."""
    wide = anchor(threshold)
    low = string_hashes(data, wide)
    width, span = 1, threshold - wide + 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[: len(low) - (span - width)], low[span - width :]) if span > width else low


def runs(data: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(row, start, stop, digit): runs of windows with one digit, for rows that end at `ends`, none shorter than a window; stop is where the last window ends."""
    digit = anchors(data, threshold)
    cut = np.zeros(len(digit) + 1, bool)
    cut[0] = True
    cut[1:-1] = digit[1:] != digit[:-1]
    cut[ends[:-1]] = True
    cut[ends - threshold + 1] = True
    at = np.flatnonzero(cut[:-1])
    stop = np.append(at[1:], len(digit))
    row = np.searchsorted(ends, at, "right")
    inside = at + threshold <= ends[row]
    at, stop, row = at[inside], stop[inside], row[inside]
    return row, at, stop - 1 + threshold, digit[at]


def pieces(many: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """(row, offset, bytes, ends) of pieces of about SLICE bytes that hold all windows of the texts, each in one piece."""
    row, offset, held, size = [], [], [], 0
    for n, text in enumerate(many):
        for at in range(0, len(text) - threshold + 1, SLICE):
            held.append(text[at : at + SLICE + threshold - 1])
            row.append(n)
            offset.append(at)
            size += len(held[-1])
            if size >= SLICE:
                yield np.array(row), np.array(offset), b"".join(held), np.cumsum([len(x) for x in held])
                row, offset, held, size = [], [], [], 0
    if held:
        yield np.array(row), np.array(offset), b"".join(held), np.cumsum([len(x) for x in held])


def content(data: np.ndarray, table: np.ndarray = _BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any part follows."""
    power = np.cumprod(np.full(len(data) + 1, _STEP, _U))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(table[data] * power[:-1], out=sums[1:])
    back = np.cumprod(np.full(len(data) + 1, _BACK, _U))
    return sums, back


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes, and so on: small numbers compress to little."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def bundled(kinds: str, *columns: np.ndarray, text: bytes = b"", level: int = 1) -> bytes:
    """Columns of numbers, and a text, as one compressed string; kinds: a letter of numpy's for each."""
    head = np.array([len(c) for c in columns], "<i8").tobytes()
    return zstandard.compress(head + b"".join(planes(c.astype(f"<{k}")) for k, c in zip(kinds, columns, strict=True)) + text, level)


def unbundled(kinds: str, blob: bytes) -> list[np.ndarray]:
    """The columns, and the text as bytes' numbers."""
    flat = zstandard.decompress(blob)
    sizes, at, out = np.frombuffer(flat, "<i8", len(kinds)).tolist(), 8 * len(kinds), []
    for k, n in zip(kinds, sizes, strict=True):
        wide = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(flat, np.uint8, n * wide, at).reshape(wide, n).T).view(f"<{k}").ravel())
        at += n * wide
    return [*out, np.frombuffer(flat, np.uint8, -1, at)]


def heads(*sorted_: np.ndarray) -> np.ndarray:
    """Where groups of equal values begin."""
    new = np.ones(len(sorted_[0]), bool)
    if len(new):
        new[1:] = sorted_[0][1:] != sorted_[0][:-1]
        for x in sorted_[1:]:
            new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def by_key(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indexes that have it), indexes in order."""
    order = np.argsort(key.astype(np.uint16) if len(key) and key.max() < 1 << 16 else key, kind="stable")
    cuts = np.append(heads(key[order]), len(key))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(key[order[a]]), order[a:b]


# The first pass: digits alone. In a shard of digits a digit is told apart by 40 bits more; two that are equal by chance only send runs in vain.
_REST = _U((1 << 40) - 1)


def told(digit: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, code) of digits; a code holds its shard."""
    shard = digit % _U(shards)
    return shard.astype(np.int64), (shard << _U(40)) | (digit // _U(shards) & _REST)


def sent_digits(digit: np.ndarray, doc: np.ndarray, bucket: np.ndarray, shards: int) -> list[tuple[int, int, bytes]]:
    """(kind, key, blob): kind 1, for a shard: lone codes and their bucket; codes that several documents have, and their number.
    Kind 0, for a bucket: codes of its texts that several documents have."""
    _, code = told(digit, shards)
    order = np.argsort(code, kind="stable")
    code, doc, bucket = code[order], doc[order], bucket[order]
    head = heads(code)
    size = np.diff(np.append(head, len(code)))
    several = np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head)
    several |= np.minimum.reduceat(bucket, head) < np.maximum.reduceat(bucket, head)  # rows that repeat a doc_id
    first, at, count = code[head], bucket[head], size
    shard = (first >> _U(40)).astype(np.int64)
    out = []
    for key, own in by_key(shard):
        many = several[own]
        one, more = own[~many], own[many]
        lone, known = first[one] & _REST, first[more] & _REST
        out.append((1, key, bundled("QIQI", np.diff(lone, prepend=_U(0)), at[one], np.diff(known, prepend=_U(0)), count[more])))
    back = np.repeat(several, size)
    return out + replies(code[back], bucket[back])


def replies(code: np.ndarray, bucket: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Kind 0: the codes, in order, for each bucket."""
    return [(0, key, bundled("Q", np.diff(c := code[own][heads(code[own])], prepend=_U(0)))) for key, own in by_key(bucket)]


def solved_digits(shard: int, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes that several documents have, their buckets; codes with how often they occur, of those that occur most)."""
    parts = [unbundled("QIQI", b)[:4] for b in blobs]
    lone, bucket, known, count = (np.concatenate([np.cumsum(p[i]) if i in (0, 2) else p[i] for p in parts]) for i in range(4))
    code = np.concatenate([lone, known])
    number = np.concatenate([np.ones(len(lone), np.int64), count.astype(np.int64)])
    order = np.argsort(code, kind="stable")
    head = heads(code[order])
    size = np.diff(np.append(head, len(code)))
    is_known = np.maximum.reduceat((order >= len(lone)).astype(np.int8), head) > 0
    total = np.add.reduceat(number[order], head)
    base = _U(shard) << _U(40)
    back = order[np.repeat((size > 1) | is_known, size)]
    back = back[back < len(lone)]
    return lone[back] | base, bucket[back].astype(np.int64), code[order][head] | base, total


# The second pass: runs under digits that several documents have.
def opened(data: np.ndarray, size: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(run, offset, hash, second hash) of every window of runs that follow one another."""
    count = size - threshold + 1
    run = np.repeat(np.arange(len(size)), count)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(size) - size, count) + offset
    keys = []
    for table in (_BYTES, _OTHERS):
        sums, back = content(data, table)
        keys.append(mixed((sums[at + threshold] - sums[at]) * back[at]))
    return run, offset, *keys


def least(doc: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each member the least document that has an equal one."""
    order = np.lexsort((doc, *keys))
    head = heads(*(k[order] for k in keys))
    out = np.empty_like(doc)
    out[order] = np.repeat(doc[order][head], np.diff(np.append(head, len(doc))))
    return out


def joined(doc: np.ndarray, uid: np.ndarray, start: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(doc, uid, start, size) of the spans that windows cover; windows that follow each other are one."""
    order = np.lexsort((start, uid))
    doc, uid, start = doc[order], uid[order], start[order]
    head = np.flatnonzero(np.concatenate([[True], (uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + 1)])[: len(doc)])
    tail = np.append(head[1:], len(start)) - 1
    return (doc[head], uid[head], start[head], start[tail] + threshold - start[head]) if len(doc) else (doc, uid, start, start)


def spans_by_bucket(spans: list[tuple[np.ndarray, ...]], buckets: int) -> list[tuple[int, bytes]]:
    doc, uid, start, size = (np.concatenate(x) for x in zip(*spans, strict=True))
    return [(key, bundled("qqqi", doc[own], uid[own], start[own], size[own])) for key, own in by_key(uid % buckets)]


#: doc, uid, start and size of runs, and their bytes one after another.
RUNS = "qqqi"


class Held:
    """Runs that a task holds before it sends them."""

    def __init__(self, threshold: int, shards: int, hot: np.ndarray, more: int):
        self.threshold, self.shards, self.hot, self.more = threshold, shards, hot, more
        self.empty()

    def empty(self) -> None:
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.text: list[bytes] = []
        self.size = 0

    def add(self, doc: np.ndarray, uid: np.ndarray, offset: np.ndarray, text: bytes, start: np.ndarray, stop: np.ndarray, code: np.ndarray) -> None:
        own = [text[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        whole = np.fromiter(map(xxhash.xxh3_64_intdigest, own), _U, len(own))
        self.columns.append((doc, uid, start + offset, stop - start, code, whole))
        self.text += own
        self.size += int((stop - start).sum())

    def sent(self) -> tuple[list[tuple[int, bytes]], tuple[np.ndarray, ...]]:
        """((shard, blob) of the runs that travel, spans of those known to be late), and empties itself. Of equal runs those of
        the least document travel; runs of hot digits travel as windows, to shards after the others."""
        doc, uid, start, size, code, whole = (np.concatenate(x) for x in zip(*self.columns, strict=True))
        text = self.text
        self.empty()
        low = least(doc, whole, code)
        late = doc > low
        known = [(doc[late], uid[late], start[late], size[late])]
        left = np.flatnonzero(~late)
        place = np.searchsorted(self.hot, code[left])
        is_hot = self.hot[np.minimum(place, len(self.hot) - 1)] == code[left] if len(self.hot) else np.zeros(len(left), bool)
        out = []
        warm, left = left[is_hot], left[~is_hot]
        warm = warm[np.argsort(code[warm], kind="stable")]  # equal windows come together
        at = np.cumsum(size[warm])
        while len(warm):
            n = max(1, int(at.searchsorted(at[0] - size[warm[0]] + OPENED, "right")))
            own, warm, at = warm[:n], warm[n:], at[n:]
            more, spans = self.windows(doc[own], uid[own], start[own], np.frombuffer(b"".join([text[i] for i in own.tolist()]), np.uint8), size[own])
            out += more
            known.append(spans)
        for key, own in by_key((mixed(code[left]) % _U(self.shards)).astype(np.int64)):
            own = left[own]
            out.append((key, bundled(RUNS, doc[own], uid[own], start[own], size[own], text=b"".join([text[i] for i in own.tolist()]), level=5)))
        return out, tuple(np.concatenate(x) for x in zip(*known, strict=True))

    def windows(self, doc: np.ndarray, uid: np.ndarray, start: np.ndarray, data: np.ndarray, size: np.ndarray) -> tuple[list[tuple[int, bytes]], tuple[np.ndarray, ...]]:
        run, offset, key, other = opened(data, size, self.threshold)
        doc, uid, start = doc[run], uid[run], start[run] + offset
        late = doc > least(doc, other, key)
        left = np.flatnonzero(~late)
        out = []
        for shard, own in by_key((key[left] % _U(self.more)).astype(np.int64)):
            own = left[own]
            out.append((self.shards + shard, bundled("qqqQQ", doc[own], uid[own], start[own], key[own], other[own])))
        return out, joined(doc[late], uid[late], start[late], self.threshold)


def window_spans(blobs: list[bytes], threshold: int) -> tuple[np.ndarray, ...]:
    doc, uid, start, key, other = (np.concatenate(x) for x in list(zip(*(unbundled("qqqQQ", b) for b in blobs), strict=True))[:5])
    late = doc > least(doc, other, key)
    return joined(doc[late], uid[late], start[late], threshold)


def divided(group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted groups: which members are in a group of several documents, and the group's least document, for each member."""
    head = heads(group)
    size = np.diff(np.append(head, len(group)))
    low, high = np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)
    return np.repeat(low < high, size), np.repeat(low, size)


def repeated_windows(text: np.ndarray, start: np.ndarray, size: np.ndarray, digit: np.ndarray, doc: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of the windows that a smaller document has as well."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(digit, kind="stable")
    several, _ = divided(digit[order], doc[order])
    run = order[several]
    if not len(run):
        return none
    count = size[run] - threshold + 1
    of = np.repeat(np.arange(len(run), dtype=np.int32), count)
    offset = np.arange(len(of), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
    run = run.astype(np.int32)[of]
    del of
    at, group, own = start[run] + offset, digit[run], doc[run]
    word = np.ndarray(len(text) - 7, ">u8", text, strides=(1,))  # eight bytes from each position on, as one digit
    group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    for depth in [*range(0, threshold - 8, 8), threshold - 8]:
        value = word[at + depth].astype(_U)
        first = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
        differs = np.zeros(int(group[-1]) + 1, bool)
        differs[group[value != value[first]]] = True  # only groups that this digit divides are sorted
        sort = differs[group]
        if sort.any():
            where = np.flatnonzero(sort)
            new = where[np.lexsort((value[where], group[where]))]
            for x in (run, offset, at, own, value):
                x[where] = x[new]
            cut = np.concatenate([[0], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
            group = np.cumsum(cut)
        keep, low = divided(group, own)
        run, offset, at, own, group, low = (x[keep] for x in (run, offset, at, own, group, low))
        if not len(run):
            return none
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    late = own > low
    return run[late], offset[late]


def run_digits(text: np.ndarray, begins: np.ndarray, threshold: int) -> np.ndarray:
    """The digit of each of the runs that follow one another, a stretch at a time."""
    cuts = [0, *np.flatnonzero(np.diff(begins // SLICE)) + 1, len(begins)]
    return np.concatenate([anchors(text[begins[i] : begins[j - 1] + threshold], threshold)[begins[i:j] - begins[i]] for i, j in zip(cuts[:-1], cuts[1:], strict=True)])


def shard_spans(blobs: list[bytes], threshold: int) -> tuple[np.ndarray, ...]:
    parts = [unbundled(RUNS, b) for b in blobs]
    doc, uid, start, size, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    size = size.astype(np.int64)
    begins = np.cumsum(size) - size
    flat = text.tobytes()
    whole = np.fromiter((xxhash.xxh3_64_intdigest(flat[a:b]) for a, b in zip(begins.tolist(), (begins + size).tolist(), strict=True)), _U, len(begins))
    low = least(doc, whole)
    late = doc > low
    known = doc[late], uid[late], start[late], size[late]
    # Runs of a text that its document has elsewhere are opened once for each of them; equal ones of later documents not at all.
    left = np.flatnonzero(~late)
    digit = run_digits(text, begins, threshold)
    run, offset = repeated_windows(text, begins[left], size[left], digit[left], doc[left], threshold)
    run = left[run]
    more = joined(doc[run], uid[run], start[run] + offset, threshold)
    return tuple(np.concatenate(x) for x in zip(known, more, strict=True))


def segments(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(bucket, kind, rows) of rows that follow each other with equal ones."""
    key, kind = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "kind"))
    cuts = np.append(heads(key, kind), len(key))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(key[a]), int(kind[a]), batch.slice(a, b - a)


def numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def blobs_of(rows: list[tuple[int, ...]], names: str) -> pa.RecordBatch:
    kinds = [pa.int64() if n != "blob" else pa.binary() for n in names.split()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names.split())


def repeated_digits(docs: DataFrame, threshold: int, shards: int, limit: int) -> DataFrame:
    """Kind 0: (key, blob), by bucket the codes of its texts that several documents have. Kind 2: (key, n), codes with more than `limit` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            return blobs_of(sent_digits(*(np.concatenate(x) for x in zip(*held, strict=True)), shards), "kind key blob")

        for batch in batches:
            doc, bucket = numbers(batch, "doc"), numbers(batch, "key")
            for row, _, text, ends in pieces(raw(batch), threshold):
                own, _, _, digit = runs(np.frombuffer(text, np.uint8), ends, threshold)
                held.append((digit, doc[row[own]], bucket[row[own]]))
                n += len(digit)
                if n >= DIGITS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch | None:
            code, bucket, all_, n = solved_digits(now, held)
            often = n > limit
            rows = [(0, key, blob, 0) for _, key, blob in replies(code, bucket)] + [(2, c, None, k) for c, k in zip(all_[often].astype(np.int64).tolist(), n[often].tolist(), strict=True)]
            return blobs_of(rows, "kind key blob n") if rows else None

        for batch in batches:
            for key, kind, some in segments(batch):
                blobs = some.column("blob").to_pylist()
                if kind == 0:
                    yield blobs_of([(0, key, b, 0) for b in blobs], "kind key blob n")
                    continue
                if key != now and held:
                    if (found := out()) is not None:
                        yield found
                    held = []
                now = key
                held += blobs
        if held and (found := out()) is not None:
            yield found

    return dealt_out(docs.mapInArrow(count, "kind long, key long, blob binary")).mapInArrow(solve, "kind long, key long, blob binary, n long")


def late_spans(docs: DataFrame, replies: DataFrame, threshold: int, buckets: int, digit_shards: int, shards: int, hot: np.ndarray, more: int) -> DataFrame:
    """(key, blob): by bucket of texts the spans of windows that a smaller document has."""
    none = np.zeros(0, _U)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, codes, known = Held(threshold, shards, hot, more), None, none, []

        def out() -> Iterator[pa.RecordBatch]:
            rows, spans = held.sent()
            rows = [(1, *x) for x in rows]
            if len(spans[0]):
                rows += [(0, *x) for x in spans_by_bucket([spans], buckets)]
            yield blobs_of(rows, "kind key blob")

        for batch in batches:
            for key, kind, some in segments(batch):
                if key != now:
                    now, codes, known = key, none, []
                if kind == 0:
                    known += [np.cumsum(unbundled("Q", b)[0]) for b in some.column("blob").to_pylist()]
                    continue
                if known:
                    codes, known = np.unique(np.concatenate([codes, *known])), []
                if not len(codes):
                    continue
                doc, uid = numbers(some, "doc"), numbers(some, "uid")
                for row, offset, text, ends in pieces(raw(some), threshold):
                    own, start, stop, digit = runs(np.frombuffer(text, np.uint8), ends, threshold)
                    _, code = told(digit, digit_shards)
                    hit = np.flatnonzero(codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code)
                    if len(hit):
                        own, start, stop = own[hit], start[hit], stop[hit]
                        base = offset - (ends - np.diff(ends, prepend=0))
                        held.add(doc[row[own]], uid[row[own]], base[own], text, start, stop, code[hit])
                    if held.size >= HELD:
                        yield from out()
        if held.text:
            yield from out()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, spans = None, [], []

        def out() -> pa.RecordBatch:
            return blobs_of(spans_by_bucket(spans, buckets), "key blob")

        def close() -> None:
            own = (shard_spans if now < shards else window_spans)(held, threshold)
            if len(own[0]):
                spans.append(own)

        for batch in batches:
            for key, kind, some in segments(batch):
                blobs = some.column("blob").to_pylist()
                if kind == 0:
                    yield blobs_of([(key, b) for b in blobs], "key blob")
                    continue
                if key != now and held:
                    close()
                    held = []
                    if sum(len(x[0]) for x in spans) >= SPANS:
                        yield out()
                        spans = []
                now = key
                held += blobs
        if held:
            close()
        if spans:
            yield out()

    return dealt_out(beside(docs, replies, ("doc", "uid")).mapInArrow(cut, "kind long, key long, blob binary")).mapInArrow(solve, "key long, blob binary")


def beside(docs: DataFrame, blobs: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Texts by bucket, after the blobs of their bucket (kind 0), in an order that doesn't change when a task runs again."""
    both = docs.withColumns({"kind": F.lit(1).cast("long"), "blob": F.lit(None).cast("binary")}).unionByName(blobs.select(F.lit(0).cast("long").alias("kind"), "key", "blob"), allowMissingColumns=True)
    return dealt_out(both, *order)


def dealt_out(rows: DataFrame, *order: str) -> DataFrame:
    """Rows by key, as many keys for each partition; in it in order of key and kind."""
    n = partitions(rows.sparkSession)
    return rows.repartitionById(n, F.pmod("key", F.lit(n)).cast("int")).sortWithinPartitions("key", "kind", *order)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 50, hot_bytes: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the bytes that are left), spans (array of structs)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    parts = partitions(spark)
    buckets, digit_shards, shards = (parts * max(1, -(-total // (most * parts))) for most in (BUCKET, BUCKET, SHARD))  # as many for each partition
    uid = F.xxhash64("doc_id", "text")
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("doc"), uid.alias("uid"), F.pmod(uid, F.lit(buckets)).alias("key"), "text")
    anchor(threshold)
    long = docs.where(F.octet_length("text") >= threshold).drop("doc_id")
    mean = threshold + (threshold - anchor(threshold) + 2) // 2  # bytes of a run
    limit = max(hot_bytes, 4 * total // HOT_DIGITS) // mean
    with scratch(spark) as folder, shuffles_removed(spark):
        found = durable(repeated_digits(long, threshold, digit_shards, limit), folder)
        # Bounded: more than HOT_DIGITS digits can't be that frequent.
        rows = found.where("kind = 2").select("key", "n").collect()
        hot = np.sort(np.array([r.key for r in rows], np.int64).astype(_U))
        more = max(1, -(-sum(r.n * mean for r in rows) // hot_bytes))
        spans = durable(late_spans(long, found.where("kind = 0"), threshold, buckets, digit_shards, shards, hot, more))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, {}
        kind_of = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            for key, kind, some in segments(batch):
                if key != now:
                    now, found = key, {}
                if kind == 0:
                    for blob in some.column("blob").to_pylist():
                        doc, uid, start, size, _ = unbundled("qqqi", blob)
                        order = np.lexsort((uid, doc))
                        doc, uid, start, size = doc[order], uid[order], start[order], size[order]
                        cuts = np.append(heads(doc, uid), len(doc))
                        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                            found.setdefault((int(doc[a]), int(uid[a])), []).append(np.stack([start[a:b], start[a:b] + size[a:b]]))
                    continue
                n, removed, count, kept, where, at_row, held = [], [], [], [], [], 0, 0
                for i, (text, name) in enumerate(zip(raw(some), zip(numbers(some, "doc").tolist(), numbers(some, "uid").tolist(), strict=True), strict=True)):
                    spans_ = merged(found.get(name, []))
                    left, at = [], 0
                    for a, b in spans_:
                        left.append(text[at:a])
                        at = b
                    kept.append(b"".join([*left, text[at:]]))
                    n.append(len(text))
                    removed.append(len(text) - len(kept[-1]))
                    count.append(len(spans_))
                    where.append([{"start": a, "stop": b} for a, b in spans_])
                    held += len(kept[-1])
                    if held >= OUT_BYTES or i == some.num_rows - 1:
                        own = some.column("doc_id").slice(at_row, i + 1 - at_row)
                        yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(kept, pa.binary()), pa.array(where, kind_of)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])
                        n, removed, count, kept, where, at_row, held = [], [], [], [], [], i + 1, 0

    return beside(docs, spans, ("doc", "uid")).mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start: long, stop: long>>")


def merged(found: list[np.ndarray]) -> list[tuple[int, int]]:
    """Maximal runs of the spans' union; spans that touch are one run."""
    if not found:
        return []
    start, stop = np.concatenate(found, axis=1)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    head = np.concatenate([[True], start[1:] > stop[:-1]])
    last = np.concatenate([np.flatnonzero(head)[1:], [len(start)]]) - 1
    return list(zip(start[head].tolist(), stop[last].tolist(), strict=True))
