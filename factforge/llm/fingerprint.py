"""Document fingerprints that are invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs at line ends, and long paragraphs at words whose hash says so, so an edit moves only the
cuts next to it; how often words cut follows the text's length in powers of four. Each text is cut at two such steps, and one
not over twice as long as the limit below it at the step before too, so versions on both sides of a limit have two in common; a
text has tens of digests whatever its size. Repeated paragraphs get digests of their own (their ordinal is hashed with them). Each digest is added to
``HASHES`` cells of its step: count, XOR of digests, XOR of check values.

The cells of two versions subtract and peel: what is left are the digests that only one has. A sketch folds in half any
number of times, so comparison starts with few cells and retries with twice as many on failure, up to all that the smaller
one has. Likeness is shared over distinct digests of both, at the steps that both have; texts without a common step differ
more than eightfold in length and have likeness 0. If even the full sketches of a step don't peel, the difference exceeds their
capacity, and the other steps decide; if none peels the likeness is 0.

Null and empty texts have an empty sketch; two empty ones are alike (1). Equal texts have equal fingerprints. Rows that
repeat a doc_id follow each other by text; a null doc_id comes last.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.llm.common import partitions, sliced, texts

HASHES, LEAST_CELLS, CELL = 4, 16, np.dtype([("n", "<i2"), ("key", "<u8"), ("check", "<u4")])
#: Digests that a text aims at, and times that in cells so that unlike texts of one size still peel.
AIM, CELLS_FOR_EACH = 32, 3
_U = np.uint64
_WORD_CUT: dict[str, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hash(word: str) -> int:
    if (h := _WORD_CUT.get(word)) is None:
        h = _WORD_CUT[word] = xxhash.xxh32_intdigest(word)
    return h


def cuts(hashes: list[int], every: int) -> list[int]:
    """Ends of the paragraphs of a line: after words whose hash is 0 modulo `every` (a power of two), or after eight times as many words."""
    mask, out, at = every - 1, [], 0
    for end in [i + 1 for i, h in enumerate(hashes) if not h & mask] + [len(hashes)]:
        while end - at > 8 * every:
            at += 8 * every
            out.append(at)
        if end > at:
            out.append(end)
            at = end
    return out


def steps(n_chars: int) -> list[int]:
    """The steps at which a text of so many characters is cut: at least two are those of any text from half to twice its length."""
    every = 1
    while n_chars > 6 * AIM * every:
        every *= 4
    return [*([every // 4] if every > 1 and n_chars <= 2 * 6 * AIM * (every // 4) else []), every, 4 * every]


def digests(text: str) -> dict[int, np.ndarray]:
    """Sorted digests of the paragraphs by step."""
    if not text:
        return {step: np.zeros(0, _U) for step in steps(0)}
    if len(_WORD_CUT) > 500_000:
        _WORD_CUT.clear()
    out: dict[int, list[int]] = {step: [] for step in steps(len(text))}
    seen: dict[tuple[int, str], int] = {}
    for line in text.split("\n"):
        words = line.split(" ")
        hashes = list(map(word_hash, words))
        for step, own in out.items():
            at = 0
            for end in cuts(hashes, step):
                p = " ".join(words[at:end])
                at = end
                n = seen.get((step, p), 0)
                seen[step, p] = n + 1
                own.append(xxhash.xxh3_64_intdigest(p, seed=n * 64 + step.bit_length()))
    return {step: np.unique(np.array(own, _U)) for step, own in out.items()}


def places(keys: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The cells of each digest, a row for each hash; each hash has `part` cells of its own, and folding keeps the places."""
    part = np.broadcast_to(np.asarray(part, _U), keys.shape)
    return np.stack([_mixed(keys + _U((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) % part + _U(i) * part for i in range(HASHES)]).astype(np.int64)


def checks(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys ^ _U(0x5851F42D4C957F2D)) >> _U(32)).astype(np.uint32)


def sketches(many: list[np.ndarray]) -> list[np.ndarray]:
    """Cells of each set of digests: HASHES times a power of two, by their number; all sets at once."""
    parts = []
    for keys in many:
        part = 2 * LEAST_CELLS  # with fewer, two digests in the same cells would be too common
        while part * HASHES < CELLS_FOR_EACH * len(keys):
            part *= 2
        parts.append(part)
    sizes = np.array(parts, np.int64) * HASHES
    base = np.cumsum(sizes) - sizes
    n = [len(k) for k in many]
    keys = np.concatenate([np.zeros(0, _U), *many])
    at = (places(keys, np.repeat(np.array(parts, _U), n)) + np.repeat(base, n)).ravel()
    out = np.zeros(int(sizes.sum()), CELL)
    cell_n, cell_key, cell_check = np.zeros(len(out), np.int32), np.zeros(len(out), _U), np.zeros(len(out), np.uint32)
    np.add.at(cell_n, at, 1)
    np.bitwise_xor.at(cell_key, at, np.tile(keys, HASHES))
    np.bitwise_xor.at(cell_check, at, np.tile(checks(keys), HASHES))
    out["n"], out["key"], out["check"] = cell_n, cell_key, cell_check
    return [out[b : b + s] for b, s in zip(base.tolist(), sizes.tolist(), strict=True)]


def sketch(keys: np.ndarray) -> np.ndarray:
    return sketches([keys])[0]


def stepped(many: list[dict[int, np.ndarray]]) -> list[dict[int, np.ndarray]]:
    """Sketches of digests by step."""
    cells = iter(sketches([keys for own in many for keys in own.values()]))
    return [{step: next(cells) for step in own} for own in many]


def folded(cells: np.ndarray, part: int) -> np.ndarray:
    rows = cells.reshape(HASHES, -1, part)
    out = np.zeros((HASHES, part), CELL)
    out["n"] = rows["n"].sum(axis=1)
    out["key"], out["check"] = np.bitwise_xor.reduce(rows["key"], axis=1), np.bitwise_xor.reduce(rows["check"], axis=1)
    return out.ravel()


def peel(many: list[tuple[np.ndarray, int]]) -> list[tuple[list[int], list[int]] | None]:
    """For each (subtracted cells, cells of one hash): the digests that only the first and only the second has, or None if a core is left."""
    part = np.array([p for _, p in many], np.int64)
    sizes = part * HASHES
    base = np.cumsum(sizes) - sizes
    cells = np.concatenate([c for c, _ in many])
    n, key, check = cells["n"].astype(np.int32), cells["key"].copy(), cells["check"].copy()
    owner = np.repeat(np.arange(len(many)), sizes)
    found = []
    look = np.arange(len(n))
    for _ in range(200):
        look = look[np.abs(n[look]) == 1]
        pure = look[checks(key[look]) == check[look]]
        if not len(pure):
            break
        _, first = np.unique(key[pure] ^ _mixed(owner[pure].astype(_U)), return_index=True)
        pure = pure[first]
        k, s, o = key[pure], n[pure], owner[pure]
        found.append((o, k, s))
        at = (places(k, part[o].astype(_U)) + base[o]).ravel()
        np.subtract.at(n, at, np.tile(s, HASHES))
        np.bitwise_xor.at(key, at, np.tile(k, HASHES))
        np.bitwise_xor.at(check, at, np.tile(checks(k), HASHES))
        look = np.unique(at)
    left = np.bitwise_or.reduceat((n != 0) | (key != 0), base)
    only: list[tuple[list[int], list[int]]] = [([], []) for _ in many]
    for o, k, s in found:
        for i, x, sign in zip(o.tolist(), k.tolist(), s.tolist(), strict=True):
            only[i][sign < 0].append(x)
    return [None if core else x for x, core in zip(only, left.tolist(), strict=True)]


def differences(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[list[int], list[int]] | None]:
    """Digests that only a or only b has, for each pair: from few cells first, then from four times as many while peeling fails."""
    out: list[tuple[list[int], list[int]] | None] = [None] * len(pairs)
    todo = []
    for i, (a, b) in enumerate(pairs):
        most, n_a, n_b = min(len(a), len(b)) // HASHES, held(a), held(b)
        part = LEAST_CELLS
        while part < most and part * HASHES < 1.3 * abs(n_a - n_b):  # at least so many differ
            part *= 2
        todo.append((i, part, most, n_a - n_b))
    while todo:
        tries = []
        for i, part, _, _ in todo:
            x, y = folded(pairs[i][0], part), folded(pairs[i][1], part)
            both = np.zeros(len(x), CELL)
            both["n"], both["key"], both["check"] = x["n"] - y["n"], x["key"] ^ y["key"], x["check"] ^ y["check"]
            tries.append((both, part))
        later = []
        for (i, part, most, more), found in zip(todo, peel(tries), strict=True):
            if found is not None and len(found[0]) - len(found[1]) == more:
                out[i] = found
            elif part < most:
                later.append((i, min(most, part * 4), most, more))
        todo = later
    return out


def difference(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]] | None:
    return differences([(a, b)])[0]


def held(cells: np.ndarray) -> int:
    """Digests in a sketch."""
    return int(cells["n"][: len(cells) // HASHES].sum())


def likenesses(pairs: list[tuple[dict[int, np.ndarray], dict[int, np.ndarray]]]) -> list[float]:
    """Share of the digests of both that both have, over the steps of both, for each pair of sketches by step."""
    out, open_, at = [], [], []
    for a, b in pairs:
        n_a, n_b = (sum(map(held, x.values())) for x in (a, b))
        same = n_a + n_b == 0 or a.keys() == b.keys() and all(a[s].tobytes() == b[s].tobytes() for s in a)
        out.append(1.0 if same else 0.0)
        if not same and n_a and n_b:
            for step in sorted(a.keys() & b.keys()):
                at.append(len(out) - 1)
                open_.append((a[step], b[step]))
    shared, differ = [0.0] * len(out), [0] * len(out)
    for i, (a, b), found in zip(at, open_, differences(open_), strict=True):
        if found is not None:
            apart = len(found[0]) + len(found[1])
            shared[i] += (held(a) + held(b) - apart) / 2
            differ[i] += apart
    for i in set(at):
        if shared[i] + differ[i]:
            out[i] = max(0.0, shared[i] / (shared[i] + differ[i]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return likenesses([({1: a}, {1: b})])[0]


def fingerprint(cells: np.ndarray) -> str:
    """The cells' counts, digests and checks as text."""
    return base64.b64encode(cells["n"].astype("<i2").tobytes() + cells["key"].tobytes() + cells["check"].tobytes()).decode()


def cells_of(text: str) -> np.ndarray:
    """The sketch that a fingerprint states."""
    flat = base64.b64decode(text)
    n = len(flat) // CELL.itemsize
    out = np.zeros(n, CELL)
    out["n"], out["key"], out["check"] = np.frombuffer(flat, "<i2", n), np.frombuffer(flat, "<u8", n, 2 * n), np.frombuffer(flat, "<u4", n, 10 * n)
    return out


def stated(cells: dict[int, np.ndarray]) -> str:
    """The fingerprints of all steps as one text: step:fingerprint, with commas between."""
    return ",".join(f"{step}:{fingerprint(own)}" for step, own in cells.items())


def stated_cells(text: str) -> dict[int, np.ndarray]:
    """The sketches by step that a stated fingerprint has."""
    return {int(step): cells_of(own) for step, own in (x.split(":") for x in text.split(","))}


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, guest: rows in buckets of descending doc_id. The first row of each bucket is also in the one before
    it as a guest, so that every row finds the next one in its own bucket; texts are shuffled once."""
    spark = docs.sparkSession
    n = 8 * partitions(spark)  # more buckets than partitions, so that partitions are alike
    bounds = docs.select("doc_id").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = sorted(set(int(x) for x in bounds))
    limits = np.array(bounds, np.int64)  # in ascending order; a greater doc_id comes earlier

    @F.pandas_udf("int")
    def bucket_of(doc_id: pd.Series, none: pd.Series) -> pd.Series:
        found = len(limits) - np.searchsorted(limits, doc_id.to_numpy(), "left")
        return pd.Series(np.where(none.to_numpy(), len(limits) + 1, found).astype(np.int32))

    number, none = F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull()
    own = docs.withColumn("bucket", bucket_of(number, none))
    # Bounded: a row for each bucket reaches the driver.
    rows = sorted((r.bucket, r.top) for r in own.select("doc_id", "bucket").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    order, tops = np.array([b for b, _ in rows], np.int64), np.array([t or 0 for _, t in rows], np.int64)

    @F.pandas_udf("int")
    def guest_of(doc_id: pd.Series, none: pd.Series, bucket: pd.Series) -> pd.Series:
        """The bucket in which a row is a guest as well, if it is one of the first of its own; after the last bucket comes the first. -1: none."""
        at = np.searchsorted(order, bucket.to_numpy())
        leads = none.to_numpy() | (tops[at] == doc_id.to_numpy())
        return pd.Series(np.where(leads, order[at - 1], -1).astype(np.int32))

    guest = guest_of(number, none, F.col("bucket"))
    spread = F.array_compact(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")), F.when(F.col("to") >= 0, F.struct(F.col("to").alias("bucket"), F.lit(True).alias("guest")))))
    return own.withColumn("to", guest).select("doc_id", "text", F.explode(spread).alias("x")).select("doc_id", "text", "x.bucket", "x.guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint, edited (text), edited_fingerprint, near_edited, near_next. The edited text has its last third
    replaced by as much of the beginning of the next document, in descending doc_id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Guests follow all rows of their bucket; a sole bucket's guest is its own first row.
    rows = with_next(docs).repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    names = ["doc_id", "n_chars", "fingerprint", "edited", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the row that waits for the next one: doc_id, text, bucket, guest
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                items = [last] if last is not None else []
                for row in zip(part.column("doc_id").to_pylist(), texts(part), part.column("bucket").to_pylist(), part.column("guest").to_pylist(), strict=True):
                    if not (items and items[-1][3] and items[-1][2] == row[2]):  # the first guest was the next document already
                        items.append(row)
                last = items[-1]
                at = [i for i in range(len(items) - 1) if items[i][2] == items[i + 1][2]]
                if not at:
                    continue
                edited = []
                for i in at:
                    own, n = items[i][1], len(items[i][1]) // 3
                    edited.append(own[: len(own) - n] + items[i + 1][1][:n])
                cells = stepped([digests(t) for t in [*(x[1] for x in items), *edited]])
                own, new = cells[: len(items)], cells[len(items) :]
                near = likenesses([*((own[i], c) for i, c in zip(at, new, strict=True)), *((own[i], own[i + 1]) for i in at)])
                out = [[items[i][0] for i in at], [len(items[i][1]) for i in at], [stated(own[i]) for i in at], edited, [stated(c) for c in new], near[: len(at)], near[len(at) :]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return rows.mapInArrow(run, "doc_id long, n_chars long, fingerprint string, edited string, edited_fingerprint string, near_edited double, near_next double")
