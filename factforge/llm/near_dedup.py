"""MinHash near-dedup with HyperMinHash registers.

1. Each text becomes its set of word shingles (64-bit hashes). Texts with equal sets are one node, so copies cost a row.
2. One pass over a set fills ``REGISTERS`` registers: per bucket of the hash, the leading-zero count of the least value
   and ``MANTISSA`` bits after its leading one. Bands of ``ROWS`` registers are hashed; nodes that share a band are candidates.
3. Each node is first held only against the centre of a band (its least node) with the best collision-corrected estimate:
   a star, never all pairs. Links are confirmed on full sets and joined into components.
4. In bands that still hold two components, registers tell in blocks which members have an open pair: one across components
   that may reach the threshold. Each such member is held against its best partner, ``ROUNDS`` times over.
5. What is open then is settled in the same blocks on full sets, each pair in the first band that it shares; a block gives the
   links that join components, never its pairs. After that no candidate pair is open, so components are final.

Null, empty and white-space texts have an empty set and are linked with nothing. Texts with fewer words than a shingle
have one element: the whole sequence. Rows that repeat a doc_id with other texts are documents of their own. Rows with a
null doc_id are kept and linked with nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.llm.common import clean_up, durable, id_text, map_text, new_folder, partitions, raw, written

REGISTERS, MANTISSA, ROWS, BANDS = 192, 10, 5, 38
#: Members of a band compared in one block, and rounds of best partners before the rest is settled on full sets.
BLOCK, ROUNDS = 512, 2
#: Estimates so many standard deviations below the threshold are still confirmed.
SLACK = 5.0
KNOWN_WORDS = 500_000

_WORD_HASH: dict[bytes, int] = {}
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words, A-Z lower-cased."""
    own = text.lower().split()
    if not own:
        return np.zeros(0, _U)
    if len(own) < words:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(own), seed=7)], _U)
    if len(_WORD_HASH) > KNOWN_WORDS:
        _WORD_HASH.clear()
    try:
        hashes = np.array([_WORD_HASH[w] for w in own], _U)
    except KeyError:
        for w in own:
            if w not in _WORD_HASH:
                _WORD_HASH[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.array([_WORD_HASH[w] for w in own], _U)
    n = len(own) - words + 1
    run = hashes[:n].copy()
    for i in range(1, words):
        run = mixed(run * _U(0x9E3779B97F4A7C15) + hashes[i : n + i])
    return np.unique(run)


def _probes() -> np.ndarray:
    """For each register the order in which it looks for a filled one to borrow from."""
    at = mixed(np.arange(REGISTERS * 64, dtype=_U) + _U(1)) % _U(REGISTERS)
    return np.concatenate([at.astype(np.int64).reshape(REGISTERS, 64), (np.arange(REGISTERS)[:, None] + np.arange(REGISTERS)) % REGISTERS], axis=1)


PROBES = _probes()


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers; empty buckets borrow the register of a filled one, by a fixed order."""
    value = mixed(shingles ^ _U(0xD6E8FEB86659FD93))
    bucket = ((mixed(shingles + _U(0x632BE59BD9B4E019)) >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, _U)
    np.minimum.at(least, bucket, value | _U(1))
    filled = np.zeros(REGISTERS, bool)
    filled[bucket] = True
    share, exponent = np.frexp(least.astype(np.float64))
    out = ((64 - np.minimum(exponent, 64)) << MANTISSA | ((share * 2 - 1) * (1 << MANTISSA)).astype(np.int64)).astype(np.uint16)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        probes = PROBES[empty]
        out[empty] = out[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    rows = regs[: BANDS * ROWS].reshape(BANDS, ROWS).astype(_U)
    key = np.arange(BANDS, dtype=_U) + _U(1)
    for i in range(ROWS):
        key = mixed(key * _U(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


def estimate(same: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal registers, less what unequal values collide in by chance."""
    large, small = np.maximum(n_a, n_b) / REGISTERS, np.maximum(np.minimum(n_a, n_b) / REGISTERS, 1e-9)
    ratio = large / small
    chance = np.minimum(0.16992 * 4 * ratio / (1 + ratio) ** 2 * 2 / (1 << MANTISSA), 0.5)
    return np.clip((same - chance) / (1 - chance), 0, 1)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node (a hash of the set, null if it is empty), registers, bands."""

    def work():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            n, node, regs, bands = [], [], [], []
            for text in raw(part):
                own = shingle_set(text, words)
                n.append(len(own))
                if len(own):
                    node.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
                    r = registers(own)
                    regs.append(r.tobytes())
                    bands.append(band_keys(r))
                else:
                    node.append(None), regs.append(None), bands.append(None)
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "registers", "bands"])

        return each

    return map_text(docs, work, "doc_id long, n_shingles long, node long, registers binary, bands array<long>")


def with_estimate(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) with the estimate of their similarity."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("registers").alias(f"regs_{x}"), F.col("n_shingles").alias(f"n_{x}"))

    def run(frames):
        for f in frames:
            if len(f):
                a, b = (np.frombuffer(b"".join(f[c]), np.uint16).reshape(len(f), REGISTERS) for c in ("regs_a", "regs_b"))
                yield pd.DataFrame({"a": f.a, "b": f.b, "likeness": estimate((a == b).mean(axis=1), f.n_a.to_numpy(), f.n_b.to_numpy())})

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long, likeness double")


def confirmed(pairs: DataFrame, held: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets. held: node and text."""
    side = lambda x: held.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    def work():
        last: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in last:
                if len(last) > 64:
                    last.clear()
                last[text] = shingle_set(text, words)
            return last[text]

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            hit = []
            for a, b in zip(raw(part, "text_a"), raw(part, "text_b"), strict=True):
                x, y = of(a), of(b)
                hit.append(alike(x, y, percent))
            return pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(hit, pa.bool_())) for c in ("a", "b")], ["a", "b"])

        return each

    return map_text(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b"), work, "a long, b long", "text_a")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable. Least labels pass along edges, then along labels, until none changes."""
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = durable(step.join(up, "component").select("node", "was", F.least("component", "up").alias("component")))
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels


def in_blocks(bands: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the bands that hold several components, dealt into cells of two blocks: a member goes to as many cells as its band has blocks."""
    where = bands.join(labels, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component"))
    several = where.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = where.join(several, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")
    return cells.join(nodes.select("node", "registers", "n_shingles"), "node")


def by_cell(cells: DataFrame, work, schema: str, columns: list[str]) -> DataFrame:
    """work(batch, group) over whole cells, many at a time: group numbers the cells of the batch."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16_384:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                keys = [whole.column(c).to_numpy() for c in ("key", "i", "j")]
                last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))
                if len(last):
                    yield from done(whole.slice(0, int(last[-1]) + 1))
                    held = [whole.slice(int(last[-1]) + 1)]
                    rows = held[0].num_rows
        if rows:
            yield from done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def done(batch):
        keys = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
        group = np.cumsum(np.concatenate([[0], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        out = work(batch, group)
        if out is not None and out.num_rows:
            yield out

    dealt = cells.select("key", "i", "j", *columns).repartition(partitions(cells.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, schema)


def open_pairs(batch: pa.RecordBatch, group: np.ndarray, least: float):
    """Index pairs of one cell that lie in different components, may reach the threshold and share no earlier band, with their estimates."""
    regs = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
    component, own, i, j, band, n = (batch.column(c).to_numpy() for c in ("component", "own", "i", "j", "band", "n_shingles"))
    for d in range(1, len(group)):
        a = np.flatnonzero(group[:-d] == group[d:])
        if not len(a):
            return
        b = a + d
        ok = (component[a] != component[b]) & ((i[a] == j[a]) | (own[a] != own[b]))
        ok &= np.minimum(n[a], n[b]) >= (least - 0.01) * np.maximum(n[a], n[b])  # sizes bound the similarity
        for at in range(0, len(a), 8192):
            x, y = a[at : at + 8192][ok[at : at + 8192]], b[at : at + 8192][ok[at : at + 8192]]
            if not len(x):
                continue
            same = regs[x] == regs[y]
            alike = estimate(same.mean(axis=1), n[x], n[y])
            first = same[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
            hit = (alike >= least) & (first == band[x])
            if hit.any():
                yield x[hit], y[hit], alike[hit]


MEMBER = ["node", "component", "own", "band", "registers", "n_shingles"]


def open_members(cells: DataFrame, least: float) -> DataFrame:
    """key, i, j, node, partner, likeness: a row for each member of a cell that has an open pair, with its best partner."""

    def work(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        node, best, partner = batch.column("node").to_numpy(), np.zeros(len(group)), np.zeros(len(group), np.int64)
        for x, y, alike in open_pairs(batch, group, least):
            for one, other in ((x, y), (y, x)):
                better = alike > best[one]
                best[one[better]], partner[one[better]] = alike[better], node[other[better]]
        hit = pa.array(best > 0)
        return pa.RecordBatch.from_arrays([*(batch.column(c).filter(hit) for c in ("key", "i", "j", "node")), pa.array(partner).filter(hit), pa.array(best).filter(hit)], ["key", "i", "j", "node", "partner", "likeness"])

    return by_cell(cells, work, "key long, i int, j int, node long, partner long, likeness double", MEMBER)


def settled(cells: DataFrame, least: float, words: int, percent: int) -> DataFrame:
    """(a, b): links on full sets that join the components of a cell, from its open pairs."""

    def work(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch | None:
        node, component, text = batch.column("node").to_pylist(), batch.column("component").to_pylist(), raw(batch)
        sets: dict[int, np.ndarray] = {}
        root: dict[int, int] = {}

        def top(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        def of(k: int) -> np.ndarray:
            if node[k] not in sets:
                if len(sets) > 1024:
                    sets.clear()
                sets[node[k]] = shingle_set(text[k], words)
            return sets[node[k]]

        out = []
        for x, y, _ in open_pairs(batch, group, least):
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                if (p := top(component[a])) != (q := top(component[b])) and alike(of(a), of(b), percent):
                    root[max(p, q)] = min(p, q)
                    out.append((node[a], node[b]))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["a", "b"]) if out else None

    return by_cell(cells, work, "a long, b long", [*MEMBER, "text"])


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
    return 100 * both >= percent * (len(x) + len(y) - both)


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of components."""
    label = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    edges = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    more = components(edges).select(F.col("node").alias("component"), F.col("component").alias("last"))
    old = labels.join(more, "component", "left").select("node", F.coalesce("last", "component").alias("component"))
    new = more.select(F.col("component").alias("node"), F.col("last").alias("component")).join(labels.select("node"), "node", "left_anti")
    return durable(old.unionByName(new))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links of at least `percent`), kept."""
    spark, docs = docs.sparkSession, id_text(docs, id_col, text_col)
    result = new_folder(spark, "near")
    before = written()
    t = percent / 100
    least = t - SLACK * float(np.sqrt(t * (1 - t) / REGISTERS))
    sketched = durable(sketch(docs, words))
    linked = sketched.where("node is not null and doc_id is not null")
    nodes = durable(linked.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"), F.first("bands").alias("bands")))
    bands = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
    bands = durable(bands.join(shared, "key").select("key", "band", "node", "centre"))
    stars = bands.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    best = with_estimate(stars, nodes).where(F.col("likeness") >= least).groupBy("b").agg(F.max_by("a", F.struct("likeness", "a")).alias("a")).select("a", "b")
    best = durable(best)
    # Texts of the nodes that share a band with another one: all that confirmation may read.
    held = durable(_texts_of(docs, bands.select("node").distinct().join(nodes.select("node", "rep"), "node"), words))
    labels = components(confirmed(best, held, words, percent))
    bands = bands.drop("centre")
    for _ in range(ROUNDS):
        partners = open_members(in_blocks(bands, nodes, labels), least).groupBy("node").agg(F.max_by("partner", F.struct("likeness", "partner")).alias("partner"))
        pairs = durable(partners.select(F.least("node", "partner").alias("a"), F.greatest("node", "partner").alias("b")).distinct())
        links = durable(confirmed(pairs, held, words, percent))
        if links.isEmpty():
            break
        labels = joined(labels, links)
    cells = durable(in_blocks(bands, nodes, labels))
    still = open_members(cells, least).select("key", "i", "j", "node")
    labels = joined(labels, settled(cells.join(still, ["key", "i", "j", "node"]).join(held, "node"), least, words, percent))
    of = nodes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least_id = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(least_id, "component").select("node", "component_id")
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(of, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = durable(out, result)
    clean_up(spark, before)  # sketches, bands and texts of candidates
    return out


def _texts_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and text of each wanted node, from a document that has its set."""

    def work():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [hashlib.blake2b(shingle_set(t, words).tobytes(), digest_size=8).digest() for t in raw(part)]
            hit = pa.array([int.from_bytes(d, "little", signed=True) == n for d, n in zip(found, part.column("node").to_pylist(), strict=True)], pa.bool_())
            return pa.RecordBatch.from_arrays([part.column(c).filter(hit) for c in ("node", "text")], ["node", "text"])

        return each

    pairs = docs.join(wanted.select("node", F.col("rep").alias("doc_id")), "doc_id").select("node", "text")
    return map_text(pairs, work, "node long, text string").dropDuplicates(["node"])
