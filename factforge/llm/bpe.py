"""BPE encoding and decoding with a lexicon that is a minimal acyclic transducer.

Words are counted over the whole corpus; the most frequent ones (``LEXICON_WORDS``, a cache bound that
no result depends on) are compiled with their ids into an automaton that shares suffixes. The automaton is
one flat file that Spark ships to every executor (``addFile``, fetched again by executors that replace lost
ones) and that each task memory-maps. Words it doesn't hold are merged exactly, pair by pair.

Null and empty texts give no ids and decode to an empty text. Special tokens written out in a text become
their ids, as in the tokenizers library. Repeated rows are encoded each on its own.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.llm.common import durable, id_text, map_text, texts

#: Most words compiled into the lexicon: it bounds the driver's work and the shipped file (about 2 MB).
LEXICON_WORDS = 50_000
#: Words whose ids a task remembers at once.
CACHE_WORDS = 400_000
#: Bytes of texts that a task encodes at once: their words are objects of some ten times that size, and a worker keeps what it once took.
ENCODED = 1 << 20

#: How the vocabulary file splits a normalised text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for texts without the characters of ODD, on which the two engines' classes differ.
WORDS_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
ODD = re.compile("[\x1c-\x1f\x85\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Transducer:
    """A minimal acyclic automaton over byte strings whose paths number its words in order; the number finds the word's ids."""

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        order = sorted(words)
        states: list[tuple[bool, tuple]] = []
        known: dict[tuple, int] = {}

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in known:  # an equal right language is one state: suffixes are shared
                known[key] = len(states)
                states.append(key)
            return known[key]

        open_nodes: list[list] = [[False, []]]
        before = b""
        for word in order:
            same = len(os.path.commonprefix([before, word]))
            while len(open_nodes) - 1 > same:
                node = open_nodes.pop()
                open_nodes[-1][1][-1] = (open_nodes[-1][1][-1][0], freeze(node))
            for byte in word[same:]:
                open_nodes[-1][1].append((byte, -1))
                open_nodes.append([False, []])
            open_nodes[-1][0] = True
            before = word
        while len(open_nodes) > 1:
            node = open_nodes.pop()
            open_nodes[-1][1][-1] = (open_nodes[-1][1][-1][0], freeze(node))
        root = freeze(open_nodes[0])
        accepted, keys, targets, skips = [], [], [], []
        for at, (final, arcs) in enumerate(states):  # children come before their parents
            below = int(final)
            for byte, target in arcs:
                keys.append(at << 8 | byte)
                targets.append(target)
                skips.append(below)
                below += accepted[target]
            accepted.append(below)
        ids = [words[w] for w in order]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.uint32)
        parts = [np.array(keys, np.uint32), np.array(targets, np.uint32), np.array(skips, np.uint32), np.array([f for f, _ in states], np.uint32), ends, np.array([x for i in ids for x in i], np.uint32)]
        return np.array([root, *map(len, parts), 0], np.uint32).tobytes() + b"".join(p.tobytes() for p in parts)

    def __init__(self, path: str):
        flat = np.memmap(path, np.uint32, "r")
        self.root = int(flat[0])
        cuts = 8 + np.cumsum([0, *flat[1:7].tolist()])
        self.keys, self.targets, self.skips, self.final, self.ends, self.ids = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word as little-endian 32-bit numbers, None if the lexicon lacks it; all words walk at once."""
        n = len(words)
        if not n or not len(self.keys):
            return [None] * n
        lengths = np.fromiter(map(len, words), np.int64, n)
        flat, starts = np.frombuffer(b"".join(words), np.uint8).astype(np.uint32), np.cumsum(lengths) - lengths
        state, number, live = np.full(n, self.root, np.uint32), np.zeros(n, np.int64), np.arange(n)
        alive = np.ones(n, bool)
        for step in range(int(lengths.max())):
            live = live[alive[live] & (lengths[live] > step)]
            if not len(live):
                break
            key = state[live] << np.uint32(8) | flat[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive[live[~hit]] = False
            live, at = live[hit], at[hit]
            number[live] += self.skips[at]
            state[live] = self.targets[at]
        alive &= self.final[state] == 1
        out: list[bytes | None] = [None] * n
        for i in np.flatnonzero(alive):
            out[i] = self.ids[self.ends[number[i]] : self.ends[number[i] + 1]].tobytes()
        return out


class WordBpe:
    """The vocabulary file's merges with word ends: exact ids of a word, tokens of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.inner = [vocab[c] for c in byte_symbols()]
        self.last = [vocab[c + end] for c in byte_symbols()]
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in {**vocab, **self.special}.items():
            self.tokens[i] = token

    def merge(self, word: bytes) -> list[int]:
        """Joins the pair of lowest rank, the leftmost first, until none is left."""
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        if len(ids) > 40:
            return self._merge_long(ids)
        get, none = self.pairs.get, (1 << 30, 0)
        while len(ids) > 1:
            ranked = [get(p, none) for p in zip(ids, ids[1:])]
            best = min(ranked)
            if best is none or best[0] == none[0]:
                break
            at = ranked.index(best)
            ids[at : at + 2] = [best[1]]
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order from a heap: a run of letters as long as a text stays near-linear."""
        n, ids = len(ids), list(ids)
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(self.pairs[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i] if live[i] else -1
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], live[j], right[i] = self.pairs[pair][1], False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (ids[a], ids[b]) in self.pairs:
                    heapq.heappush(heap, (self.pairs[ids[a], ids[b]][0], a, (ids[a], ids[b])))
        return [x for x, on in zip(ids, live, strict=True) if on]

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one: no final sigma
        text = text.lower()
        return (WORDS if ODD.search(text) else WORDS_FAST).findall(text)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Encoder:
    """In a task: the words of whole texts through the mapped lexicon, the rest merged, all remembered up to a bound."""

    def __init__(self, bpe: WordBpe, lexicon: Transducer):
        self.bpe, self.lexicon, self.known = bpe, lexicon, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        flat = [w.encode() for w in new]
        for word, plain, ids in zip(new, flat, self.lexicon.find(flat), strict=True):
            self.known[word] = np.array(self.bpe.merge(plain), "<u4").tobytes() if ids is None else ids

    def encode(self, many: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        cut, special = [], self.bpe.special
        for text in many:
            parts = self.bpe.split.split(text) if "<|" in text else [text]
            cut.append([p if p in special else self.bpe.words(p) for p in parts])
        get = self.known.__getitem__

        def joined() -> list[bytes]:
            return [b"".join([b"".join(map(get, p)) if type(p) is list else special[p].to_bytes(4, "little") for p in parts]) for parts in cut]

        try:
            return joined()
        except KeyError:
            self.learn({w for parts in cut for p in parts if type(p) is list for w in p})
            return joined()


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The corpus's most frequent lower-case letter runs, counted over all documents: all those of at least the least count that
    at most `most` words reach. Counts stay on the cluster; a histogram of their logarithms finds that count, so what reaches the
    driver is bounded by `most`, whatever the number of words and tasks."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> '' and length(word) <= 40")
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").withColumn("level", F.floor(F.log2("n") * 8).cast("int"))
    counts = durable(counts)
    total, least = 0, None
    for row in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r.level):  # a row for each eighth of a power of two
        total += row["count"]
        if total > most:
            break
        least = row.level
    return [] if least is None else [r.word for r in counts.where(F.col("level") >= least).select("word").collect()]


def ship_lexicon(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon on the driver (bounded by `most`) and hands it to Spark; returns the name that tasks ask for."""
    bpe = WordBpe(path)
    flat = {w.encode(): bpe.merge(w.encode()) for x in frequent_words(docs, most) for w in [unicodedata.normalize("NFC", x).lower()]}
    compiled = Transducer.compile(flat)
    name = f"lexicon-{uuid.uuid4().hex}.bin"  # Spark knows files by name
    at = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(at, "wb") as f:
        f.write(compiled)
    docs.sparkSession.sparkContext.addFile(at)
    return name


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) and decoded (text) of every whole text."""
    docs = id_text(docs, id_col, text_col)
    name = ship_lexicon(docs, path, lexicon_words)

    def work():
        bpe = WordBpe(path)
        encoder = Encoder(bpe, Transducer(SparkFiles.get(name)))

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = encoder.encode(texts(part))
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

        return each

    return map_text(docs, work, "doc_id long, n_tokens long, ids binary, decoded string", most=ENCODED)
