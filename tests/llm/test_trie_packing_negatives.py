"""Prefix trie, packing and hard negatives against brute force, and on null, empty, long, tied, repeated and clashing input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factforge.llm import hard_negatives, packing, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, row string, part string, words string"


def brute_trie(rows, group=20, heads=4):
    """Nodes by their whole prefixes."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30], role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        rebuilt[c] = turns.get(c - (c % group if c >= 0 else -(-c % group)), [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, some in members.items():
        own = (len(some) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += own
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items())


def trie_rows(df):
    rows = df.collect()
    arcs = sorted(x for r in rows for x in (r.enter_at, r.exit_at))
    assert arcs == list(range(2 * len(rows)))  # one tour over all arcs
    return sorted(tuple(r[:8]) for r in rows)


def conversations(rng):
    """Copies, shared first turns, ids without their group's first conversation, negative ids, repeated rows, ties and nulls."""
    rows, word = [], lambda: rng.choice(["a", "b b", "c", None, "", " d\te\v"])
    for c in [*range(0, 130, rng.choice([1, 3])), -3, -20, -25, 10**12]:
        n = rng.choice([0, 1, 2, 5]) if c else 40
        shared = [(i, "user", f"s {i}") for i in range(n)]
        rows += [(c, *t) for t in (shared if c % 3 == 0 else [(i, rng.choice(["user", None]), word()) for i in range(n)])]
    rows += [(7, None, "x", "first"), (7, None, "x", "first too"), (7, 2, "y", "tie"), (7, 2, "y", "tie"), (None, 1, "x", "none")]
    return [r for r in rows if r[0] is not None or r[1]]


@pytest.mark.parametrize(("seed", "chunk", "alone"), [(1, 1 << 18, 1 << 17), (2, 7, 1 << 17), (3, 5, 0)])
def test_op11_equals_brute_force(spark, seed, chunk, alone):
    rows = conversations(random.Random(seed))
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)
    assert trie_rows(prefix_trie.prefix_trie(df, chunk=chunk, alone=alone)) == brute_trie(rows)


def test_op11_divides_a_long_conversation_and_a_wide_node(spark):
    rows = [(40, i, "u", f"t {i % 9}") for i in range(400)] + [(1000 + 20 * i, 0, "u", f"w {i}") for i in range(300)]
    rows += [(200_000 + i, 0, "u", "same") for i in range(300)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], TURNS)
    turns = prefix_trie.turns_of(df)
    assert turns.where("conv_id = 40").select("part").distinct().count() > 1
    assert [r.pos for r in turns.where("conv_id = 40").orderBy("pos").collect()] == list(range(1, 401))
    assert trie_rows(prefix_trie.prefix_trie(df, chunk=50, alone=10)) == brute_trie(rows)


def test_op11_no_rows(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "x", "x", "x", "x")], TURNS)).count() == 0


def test_op11_long_ids_of_one_node_are_hashed_in_order(spark, monkeypatch):
    ends = spark.createDataFrame([(1, 2, i * 7) for i in range(5000)] + [(1, 3, -5), (0, 0, 9)], "n1 long, n2 long, conv_id long")
    monkeypatch.setattr(prefix_trie, "ID_BYTES", 200)
    got = {(r.n1, r.n2): r.ends_sha256 for r in prefix_trie.end_hashes(ends.repartition(3)).collect()}
    want = {(1, 2): ",".join(str(i * 7) for i in range(5000)), (1, 3): "-5", (0, 0): "9"}
    assert got == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}


def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    return t


def held_pieces(rows, want, capacity):
    """Every id of `want` (doc order) lies in one piece; sequences are gapless. Returns the padding of all sequences."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) // 4 > 0
    found = Counter()
    for some in pieces.values():
        for start, ids in sorted(some):
            found[ids] += 0
    assert sum(len(ids) for some in pieces.values() for _, ids in some) == sum(map(len, want))
    padding = 0
    for some in sequences.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_op12_equals_library(spark, sf_dir):
    t, path = library(), public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for r in docs.collect()}
    for held, kept in ((8192, 2048), (20, 5)):
        rows = packing.pack_documents(docs.repartition(3), path, held=held, kept=kept).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
        for d, some in by.items():
            some.sort()
            assert b"".join(x[1] for x in some) == want[d] and all(x[2] == len(want[d]) // 4 for x in some)
            assert [x[0] for x in some] == np.cumsum([0, *(len(x[1]) // 4 for x in some)])[:-1].tolist()
        assert by.keys() == want.keys() and held_pieces(rows, want.values(), 1024) == 0
        assert len({r.sequence_id for r in rows}) <= sum(map(len, want.values())) // 4096 + 3 * 11


def test_op12_odd_rows(spark):
    path, long = public_tokenizers.path("byte_bpe_50k.json"), "lorem ipsum dolor " * 5000
    rows = [(1, None, "x"), (2, "", "x"), (None, "no id", "x"), (3, long, "x"), (4, "same", "x"), (4, "same", "x"), (5, "<|endoftext|>", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(df, path, capacity=100).collect()
    ids = [np.array([*library().encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t, _ in rows]
    assert held_pieces(got, ids, 100) == 0 and sum(r.length for r in got if r.doc_id == 4) == len(ids[4]) // 2
    assert packing.pack_documents(df.limit(0), path).count() == 0


def test_op12_fullest_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(200):
        some = [rng.randint(1, 40) for _ in range(rng.randint(1, 9))]
        used = packing.fullest(Counter(some), 60)
        assert not used - Counter(some) and used[max(some)]
        rest, sums = list(some), {max(some)}
        rest.remove(max(some))
        for x in rest:
            sums |= {s + x for s in sums}
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= 60)


def brute_negatives(rows):
    """rows of (vec_id, vector, label)."""
    ok = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = [[int(np.floor(float(x) * 256)) for x in v] for _, v, _ in ok]
    key = lambda j, s: (-s, ok[j][0] is None, ok[j][0] or 0)
    out = []
    for a, (anchor, _, label) in enumerate(ok):
        if anchor is None or anchor % 50:
            continue
        score = [sum(x * y for x, y in zip(q[a], v, strict=False)) for v in q]
        best = sorted((j for j in range(len(ok)) if j != a and ok[j][2] == label), key=lambda j: key(j, score[j]))[:5]
        for p in best:
            hits = sorted((j for j in range(len(ok)) if ok[j][2] != label and 50 * score[p] <= 100 * score[j] <= 95 * score[p]), key=lambda j: key(j, score[j]))[:3]
            out += [(anchor, ok[p][0], rank, ok[n][0], score[p], score[n]) for rank, n in enumerate(hits, 1)]
    return sorted(out, key=repr)


def moved(vec_id, label):
    from pyspark.sql import functions as F

    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def test_op13_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    for block, anchors in ((16_384, 1024), (37, 3)):
        got = sorted((tuple(r) for r in hard_negatives.hard_negatives(df, label=moved, block=block, anchors=anchors).collect()), key=repr)
        assert got == brute_negatives(rows)


def test_op13_odd_rows(spark):
    rng, nan, inf = np.random.default_rng(5), float("nan"), float("inf")
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=11))], int(rng.integers(3))) for i in range(-60, 260)]
    same = rows[70][1]
    rows += [(300 + i, same, i % 2) for i in range(80)]  # ties, among them anchors
    rows += [(50, same, 1), (50, same, 1), (None, same, 1), (None, same, 0), (None, None, None), (400, None, 1), (450, same, None), (500, [1.0, None], 1), (550, [nan], 1), (600, [inf] * 11, 1)]
    rows += [(650, [], 1), (700, [2.0], 0), (750, [1e4] * 20, 2), (751, [9e3] * 20, 2), (752, [8e3] * 20, 1), (753, [-9e3] * 20, 1), (None, [8.5e3] * 20, 0)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id long, embedding array<double>, label int, uid string, rank string")
    got = sorted((tuple(r) for r in hard_negatives.hard_negatives(df, label=moved, block=50).collect()), key=repr)
    want = brute_negatives(rows)
    assert got == want and any(r[3] is None for r in want) and any(r[0] == 750 for r in want)
    assert hard_negatives.hard_negatives(df.limit(0)).count() == 0


def test_op13_ties_when_a_task_reads_several_files(spark):
    rng = np.random.default_rng(9)
    few = [[float(x) for x in rng.integers(1, 4, 8)] for _ in range(12)]
    rows = [(i, few[int(rng.integers(12))], int(rng.integers(4))) for i in range(1500)]
    df, before = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")  # many small files, packed by their length
    try:
        got = sorted((tuple(r) for r in hard_negatives.hard_negatives(df, label=moved).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_negatives(rows)


def test_op13_look_ups_are_inner_products():
    rng = np.random.default_rng(6)
    for low, high in ((-1, 1), (0, 1), (-512, 512), (-(2**40), 2**20)):
        x, a = rng.integers(low, high, (50, 24)), rng.integers(-300, 300, (9, 24))
        assert (hard_negatives.scores(hard_negatives.subset_sums(a, np.int64), hard_negatives.planes(x)) == x @ a.T).all()
