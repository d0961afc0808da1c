"""Token ids in binary files of patched frame-of-reference blocks.

A file holds documents in order of doc_id: a table of ids and lengths, then blocks of ``BLOCK`` token ids. A block stores
its least id, the differences in as many bits as a percentile of them needs, and a list of exceptions with the bits
above; an index holds where each block starts, so any document is read without the rest. Tasks write files under a
name of their own attempt into the shared folder and report them; only reported files are read, so a task that runs
again leaves nothing behind that counts.

Null and empty texts are documents with the end id alone. Rows that repeat a doc_id are written one after another, by a hash of their text.
A null doc_id comes first.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factforge.llm.bpe import ODD, byte_symbols, regex
from factforge.llm.common import durable, id_text, new_folder, partitions, sliced

BLOCK, PERCENTILE, MAGIC = 256, 90, b"PFOR0001"
#: Tokens of a file at most, but for a longer document.
FILE_TOKENS = 1_000_000
#: Parts whose ids a worker remembers at once, over its tasks.
CACHE_WORDS = 800_000
#: The printable characters by which the model knows bytes.
SYMBOLS = dict(enumerate(byte_symbols()))

PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for texts without the characters of ODD.
PIECES_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: A space and then letters of the classes on which both engines agree.
SPACED = re.compile(r" [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
#: Texts are cut before these characters.
CUT = np.zeros(256, bool)
CUT[list(b" \n,.")] = True
#: Parts that end where the vocabulary's own pieces do, whatever comes before and after; but a comma or full stop without a
#: space belongs to the signs before it.
PART = re.compile(r"[ \n]?\S(?:.*\S)?")


class ByteEncoder:
    """Whole texts through the tokenizers library, which sees each distinct part once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.parts) > CACHE_WORDS // 2:  # what is met again moves over
            self.parts, self.before = {}, self.parts
        if len(self.pieces) > CACHE_WORDS // 4:
            self.pieces.clear()
        column = pa.concat_arrays([pc.fill_null(column, "")])  # starts at its buffers' beginning
        if not len(column):
            return []
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        cut = CUT[data]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(cut)
        parts = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(data)).astype(np.int32)), column.buffers()[2])
        coded = parts.dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ids = list(map(self.parts.get, words))
        unknown = [i for i, x in enumerate(ids) if x is None]
        again = [i for i in unknown if words[i] in self.before]
        new = [i for i in unknown if words[i] not in self.before and PART.fullmatch(words[i]) and not ODD.search(words[i])]
        for i, x in zip([*again, *new], [*(self.before[words[i]] for i in again), *self.learned([words[i] for i in new])], strict=True):
            ids[i] = self.parts[words[i]] = x
        odd = np.array([i is None for i in ids], bool)
        stop, opens = (np.fromiter(x, bool, len(words))[index] for x in ((not w[-1].isalnum() for w in words), (w[0] in ",." for w in words)))
        bad = odd[index]
        bad[:-1] |= stop[:-1] & opens[1:]  # may take the next text's first part for a neighbour, which costs time alone
        ids = [i or b"" for i in ids]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        count = sizes[index]
        ends = np.cumsum(count)
        starts = np.cumsum(sizes) - sizes
        whole = np.frombuffer(b"".join(ids), "<u4")[np.repeat(starts[index] - ends + count, count) + np.arange(count.sum())].tobytes()
        first = np.searchsorted(at, offsets)  # of each text's parts
        slow = np.diff(np.concatenate([[0], np.cumsum(bad)])[first]) > 0
        slow |= pc.match_substring(column, "<|").to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], 4 * ends])[first].tolist()
        out = [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        slow = np.flatnonzero(slow).tolist()
        for i, found in zip(slow, self.encode_pieces([column[i].as_py() for i in slow]), strict=True):
            out[i] = found
        return out

    def encode_pieces(self, many: list[str]) -> list[bytes]:
        """Texts of any kind, in the vocabulary's own pieces."""
        pieces = lambda t: (PIECES if ODD.search(t) else PIECES_FAST).findall(t)
        cut = [[p if p in self.special else pieces(p) for p in self.split.split(t)] if "<|" in t else [pieces(t)] for t in many]
        new = [w for w in {w for parts in cut for p in parts if type(p) is list for w in p} if w not in self.pieces]
        self.pieces.update(zip(new, self.learned(new), strict=True))
        get = self.pieces.__getitem__
        return [b"".join([b"".join(map(get, p)) if type(p) is list else self.special[p].to_bytes(4, "little") for p in parts]) for parts in cut]

    def learned(self, some: list[str]) -> list[bytes]:
        """Ids of each. A space and letters are one piece, which the library's model takes as it is; it cuts all others itself."""
        out: list[bytes] = [b""] * len(some)
        rest, one = [], self.library.model.tokenize
        for i, p in enumerate(some):
            if SPACED.fullmatch(p):
                out[i] = array("I", [t.id for t in one(p.encode().decode("latin-1").translate(SYMBOLS))]).tobytes()
            else:
                rest.append(i)
        for i, found in zip(rest, self.library.encode_batch_fast([some[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", found.ids).tobytes()
        return out


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder_of(path: str) -> ByteEncoder:
    """A worker's encoder, kept for its next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


#: Bits that a number needs.
BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Where each block starts, and all blocks: least u4, width u1, exceptions u2; packed bits; positions u1, high bits u4."""
    n = -(-len(ids) // BLOCK)
    full = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).astype(np.uint32).reshape(n, BLOCK)
    least = full.min(axis=1)
    rest = full - least[:, None]
    bits = BITS[rest] if rest.max() < len(BITS) else np.frexp(rest.astype(np.float64))[1].astype(np.uint8)
    at = BLOCK * PERCENTILE // 100 - 1
    width = np.partition(bits, at, axis=1)[:, at]
    above = bits > width[:, None]
    count = above.sum(axis=1)
    sizes = 7 + BLOCK // 8 * width.astype(np.int64) + 5 * count
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros((n, 7), np.uint8)
    head[:, :4], head[:, 4], head[:, 5:] = least.view(np.uint8).reshape(n, 4), width, count.astype("<u2").view(np.uint8).reshape(n, 2)
    out[starts[:, None] + np.arange(7)] = head
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        wide = 16 if w <= 16 else 32
        low = rest[own].astype(f">u{wide // 8}").view(np.uint8).reshape(len(own), BLOCK, -1)
        packed = np.packbits(np.unpackbits(low, axis=2)[:, :, wide - w :].reshape(len(own), -1), axis=1)
        out[starts[own][:, None] + 7 + np.arange(packed.shape[1])] = packed
    block, at = np.nonzero(above)
    if len(block):
        place = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        base = starts[block] + 7 + BLOCK // 8 * width[block].astype(np.int64)
        out[base + place] = at
        high = (rest[block, at] >> width[block].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + count[block] + 4 * place)[:, None] + np.arange(4)] = high
    return starts, out.tobytes()


def unpack_blocks(flat: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    n = len(starts)
    head = flat[starts[:, None] + np.arange(7)]
    least, width, count = np.ascontiguousarray(head[:, :4]).view("<u4").ravel(), head[:, 4].astype(np.int64), np.ascontiguousarray(head[:, 5:]).view("<u2").ravel().astype(np.int64)
    rest = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(flat[starts[own][:, None] + 7 + np.arange(BLOCK // 8 * w)], axis=1).reshape(len(own), BLOCK, w)
        rest[own] = bits @ (np.uint32(1) << np.arange(w - 1, -1, -1, dtype=np.uint32))
    block = np.repeat(np.arange(n), count)
    if len(block):
        place = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
        base = starts[block] + 7 + BLOCK // 8 * width[block]
        high = np.ascontiguousarray(flat[(base + count[block] + 4 * place)[:, None] + np.arange(4)]).view("<u4").ravel()
        rest[block, flat[base + place]] |= high << width[block].astype(np.uint32)
    return (rest + least[:, None]).ravel()[:total]


def file_bytes(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One file: magic; documents, tokens, blocks; doc_ids, whether each is null, lengths; the block index; the blocks."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    starts, blocks = pack_blocks(tokens)
    head = MAGIC + np.array([len(ids), len(tokens), len(starts)], "<i8").tobytes()
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return head + docs + np.array([len(x) // 4 for x in ids], "<i8").tobytes() + starts.astype("<i8").tobytes() + blocks


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and all token ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, blocks = np.frombuffer(content, "<i8", 3, 8).tolist()
    at = 32
    ids = np.frombuffer(content, "<i8", docs, at).tolist()
    null = content[at + 8 * docs : at + 9 * docs]
    at += 9 * docs
    lengths = np.frombuffer(content, "<i8", docs, at)
    starts = np.frombuffer(content, "<i8", blocks, at + 8 * docs)
    flat = np.frombuffer(content, np.uint8, -1, at + 8 * docs + 8 * blocks)
    return [None if z else i for i, z in zip(ids, null, strict=True)], lengths, unpack_blocks(flat, starts, tokens)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes the files and returns what they are: name, part and number (their order), docs, tokens."""
    docs = id_text(docs, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # ranges divide the rows of one doc_id as well
    ordered = docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store = encoder_of(path), None
        context = TaskContext.get()
        part, number, held_docs, held_ids, size = context.partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held_docs, held_ids, size, store
            if store is None:
                store, root = pyarrow.fs.FileSystem.from_uri(folder)
                store.create_dir(root)
                store = (store, root)
            name = f"{part:06d}-{number:04d}-{context.taskAttemptId()}.pfor"
            with store[0].open_output_stream(f"{store[1]}/{name}") as out:
                out.write(file_bytes(held_docs, held_ids))
            row = pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, part, number, len(held_docs), size)], ["name", "part", "number", "docs", "tokens"])
            number, held_docs, held_ids, size = number + 1, [], [], 0
            return row

        for batch in batches:
            for some in sliced(batch, "text"):
                for doc, ids in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text")), strict=True):
                    held_docs.append(doc)
                    held_ids.append(ids + end_id.to_bytes(4, "little"))
                    size += len(ids) // 4 + 1
                    if size >= file_tokens:
                        yield flush()
        if held_docs:
            yield flush()

    return durable(ordered.mapInArrow(run, "name string, part long, number long, docs long, tokens long"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary) of every document of the files, each file read by Spark as a whole."""
    spark = manifest.sparkSession
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", earlier(Window.orderBy("part")).alias("of_parts"))  # a row for each task that wrote
    base = manifest.withColumn("inside", earlier(Window.partitionBy("part").orderBy("number"))).join(parts, "part").select("name", (F.col("of_parts") + F.col("inside")).alias("base"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, first in zip(batch.column("content"), batch.column("base").to_pylist(), strict=True):
                doc_ids, lengths, tokens = read_file(content.as_py())
                ends = np.cumsum(lengths)
                flat = tokens.astype("<u4").tobytes()
                ids = pa.array([flat[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), ids], ["doc_id", "start", "n_tokens", "ids"])

    return files.join(base, "name").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the documents' ids as files into `folder` (a new one in the shared folder by default) and reads them back."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, path, end_id, id_col, text_col), folder)
