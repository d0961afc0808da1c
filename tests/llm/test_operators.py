"""The training-data operators against brute force, round trips and held-out labels, and on null, empty, long, tied and clashing input."""

import hashlib
import html
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factforge.llm import bpe, fingerprint, html_text, line_dedup, line_quality, mixing, near_dedup, quality, suffix_dedup, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, ids string, score string, start string, kept string"
LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [None, "", " \n\t ", "one", "two words", LONG, "same text here for the copies", "same text here for the copies", "ÄÖ ß Ünï ﬁ ² 🙂", "<|endoftext|> a<|startoftext|>b"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated ids and rows, columns whose names operators use."""
    rows = [(i, t, None, None if i % 3 else "s", None, "x", "x", None, "x", "x") for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s", 5, "x", "x", None, "x", "x"), (3, "again three", "en", "t", 5, "x", "x", None, "x", "x"), rows[4], rows[4]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation(), t.no_padding()
    return t


def test_op1_equals_library(docs, odd, none):
    t = library("word_bpe_49k.json")
    for rows in (docs, odd):
        got = sorted(((r.doc_id is None, r.doc_id, bytes(r.ids), r.decoded, r.n_tokens) for r in bpe.bpe_round_trip(rows, public_tokenizers.path("word_bpe_49k.json"), lexicon_words=500).collect()), key=repr)
        want = []
        for r in rows.select("doc_id", "text").collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id is None, r.doc_id, np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False), len(ids)))
        assert got == sorted(want, key=repr)
    assert bpe.bpe_round_trip(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_op1_transducer_is_a_shared_map(tmp_path):
    words = {w.encode(): [len(w), ord(w[0])] for w in ("walk", "walked", "walking", "talk", "talked", "talking", "ing", "t")}
    flat = bpe.Transducer.compile(words)
    (tmp_path / "x").write_bytes(flat)
    t = bpe.Transducer(str(tmp_path / "x"))
    assert [np.frombuffer(x, "<u4").tolist() if x else None for x in t.find([*words, b"wal", b"", b"talkedx"])] == [*words.values(), None, None, None]
    assert len(t.final) < 14  # the two stems share their suffixes


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><!-- x --><div class="ad">Buy it now.</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b> text of the page, with enough words to be read as such.<p>Second&nbsp;one
goes on.</p><div class="comments"><p>Reader says no.</p></div></article><form><label>Name</label></form><footer>&copy; 2020 imprint</footer></body></html>"""


def test_op2_blocks_and_labels(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_text.train_labeller(pages)
    got = {r.page_id: r for r in html_text.main_text(pages, model).collect()}
    article = re.compile(r"<article>(.*?)</article>", re.S)
    for r in pages.collect():  # the truth by the pages' own source text
        inner = article.search(r.html).group(1)
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1|h2)>", inner)]
        assert got[r.page_id].text == "\n\n".join(filter(None, want)) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "plain", "x"), (4, "u", PAGE[:260], "x"), (4, "u", "<div " + "a" * 100_000, "x")], "page_id long, url string, html string, text string")
    rows = html_text.main_text(odd, model).collect()
    assert len(rows) == 6 and {r.page_id: r.text for r in rows}[1] == "Head & line\n\nFirst bold text of the page, with enough words to be read as such.\n\nSecond one goes on."
    assert html_text.main_text(odd.limit(0), html_text.train_labeller(odd.limit(0))).count() == 0


def test_op2_other_templates(spark):
    """Content in lists, quotes and preformatted blocks stays, reader comments under names that no list has go; pages rebuilt
    under templates that training didn't draw agree with their truth."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    model = html_text.BlockLabeller()
    model.fit(*html_text.training_pages(pages[:-60]))
    held = [html_text.parse(h) for h in pages[-60:]]
    pool = [t for p in held for t in p.text]
    long = [t for t in pool if len(t) > 200]
    lead = f"<html><body><div class='topnav'><a href='/'>Home</a> <a href='/x'>News</a></div><article><h1>{long[0][:50]}</h1><p>{long[1]}</p>"
    content = f"<ul><li>{long[2][:90]}</li><li>{long[3][:120]}</li></ul><blockquote>{long[4]}</blockquote><pre>{long[5][:100]}</pre><p>{long[6]}</p></article>"
    talk = f"<div class='responses'><h3>Responses</h3><div>Anna</div><p>{long[7][:50]}</p><div>Ben</div><p>{long[8][:70]}</p></div><div id='talkback'><p>{long[9][:60]}</p></div><footer>Imprint</footer></body></html>"
    page = html_text.parse(lead + content + talk)
    assert model.content([html_text.vectors(page)])[0].tolist() == [False] + [True] * 7 + [False] * 7
    rng, right, of = np.random.default_rng(123), 0, 0
    for p in held:
        shown, labels = html_text.rebuilt(p, html_text.targets(p), pool, rng)
        again = html_text.parse(shown)
        if len(again.text) == len(labels):
            right += int((model.content([html_text.vectors(again)])[0] == np.array(labels)).sum())
            of += len(labels)
    assert of > 300 and right / of > 0.95


def test_op2_nesting_is_linear(spark):
    def seconds(page: str) -> float:
        start = time.process_time()
        html_text.vectors(html_text.parse(page))
        return time.process_time() - start

    for unit in ("<div>x", "<div class='a b'><b>y", "<span>x</p>", "<a><b>x</i>"):
        few, many = (min(seconds(unit * n) for _ in range(2)) for n in (2_000, 16_000))
        assert many < 30 * few + 0.2, unit
    assert html_text.parse("<div>x" * 1000).text == ["x"] * 1000 and html_text.parse("<p>a<p>b<ul><li>c<li>d</ul>").text == ["a", "b", "c", "d"]


def test_op2_trains_on_whole_pages(spark, monkeypatch):
    """Pages of several hundred blocks: comments and a footer after block 120 and character 60,000 are shown in their place."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    page = lambda n: f"<html><body><nav><a href='/'>{line(2)}</a></nav><article>" + "".join(f"<p>{line(40)}</p>" for _ in range(n)) + "</article><section class='comments'>" + "".join(f"<p>{line(9)}</p>" for _ in range(30)) + f"</section><footer><p>{line(5)}</p></footer></body></html>"
    sizes = (300, 400, 20, 150, 350, 60)
    htmls = [page(n) for n in sizes]
    assert max(map(len, htmls)) > 60_000
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")
    seen, fit = [], html_text.BlockLabeller.fit
    monkeypatch.setattr(html_text.BlockLabeller, "fit", lambda self, x, y: (seen.extend(zip(x, y, strict=True)), fit(self, x, y))[1])
    model = html_text.train_labeller(pages)
    whole = [y for _, y in seen if y[1:].sum() in sizes and y[-31:].sum() == 0 and not y[0] and y[1:-31].all()]
    assert sorted(map(len, whole)) == sorted(n + 32 for n in sizes)
    for r in html_text.main_text(pages, model).collect():
        assert r.text == "\n\n".join(html_text.parse(htmls[r.page_id]).text[1:-31])


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for i, (d, t) in enumerate(order):
        own, other = t or "", order[(i + 1) % len(order)][1] or ""
        n = len(own) // 3
        yield d, len(own), own[: len(own) - n] + other[:n]


def test_op3_edits_and_likeness(docs, odd, none):
    for rows in (docs, odd):
        got = fingerprint.fingerprints(rows).collect()
        assert sorted(((r.doc_id, r.n_chars, r.edited) for r in got), key=repr) == sorted(brute_next([(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]), key=repr)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    got = fingerprint.fingerprints(docs).collect()
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.95
    assert fingerprint.fingerprints(none).count() == 0


def test_op3_subtraction_recovers_the_difference():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 60, 400):
        a = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        b = np.concatenate([a[n // 4 :], rng.integers(1, 1 << 62, n // 4 + 1).astype(np.uint64)])
        x, y = fingerprint.sketch(a), fingerprint.cells_of(fingerprint.fingerprint(fingerprint.sketch(np.unique(b))))
        found = fingerprint.difference(x, y) if n else None
        if found is not None:
            assert set(found[0]) == set(a.tolist()) - set(b.tolist()) and set(found[1]) == set(b.tolist()) - set(a.tolist())
    assert fingerprint.likeness(x, x) == 1


def test_op3_likeness_is_the_share_of_digests(docs):
    """Where all steps peel, likeness is the plain share of common digests over the steps of both; it is never more than 1 nor for unlike texts above it."""
    texts = [r.text or "" for r in docs.select("text").orderBy("doc_id").limit(120).collect()]
    pairs = list(zip(texts, texts[1:] + texts[:1])) + [(t, t[: len(t) - len(t) // 3] + u[: len(t) // 3]) for t, u in zip(texts, texts[1:])]
    got = fingerprint.likenesses([tuple(fingerprint.stepped([fingerprint.digests(x) for x in p])) for p in pairs])
    exact = 0
    for (a, b), near in zip(pairs, got):
        x, y = fingerprint.digests(a), fingerprint.digests(b)
        both = [(set(x[s].tolist()), set(y[s].tolist())) for s in x.keys() & y.keys()]
        common, union = sum(len(p & q) for p, q in both), sum(len(p | q) for p, q in both)
        want = 1.0 if a == b else common / union if union else 0.0
        exact += abs(near - want) < 1e-9
        assert abs(near - want) < 1e-9 or near <= want + 0.35
    assert exact > 0.9 * len(pairs)


def test_op3_likeness_over_length_limits(spark):
    """Without a next text a third of each text is gone: about two thirds are shared, whatever side of a limit the texts are on."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    sizes = [170, 200, 240, 280, 700, 780, 900, 1140, 2900, 3100, 3600, 4500, 12_400, 18_000]
    rows = [(2 * i, " ".join(rng.choice(words) for _ in range(n))[:n]) for i, n in enumerate(sizes * 30)]
    docs = spark.createDataFrame(rows + [(2 * i - 1, "") for i in range(len(rows))], "doc_id long, text string")
    got = [r for r in fingerprint.fingerprints(docs).collect() if r.n_chars]
    for n in sizes:
        near = [r.near_edited for r in got if r.n_chars == n]
        assert len(near) == 30 and abs(np.mean(near) - 2 / 3) < 0.15, n
    for r in got[:50]:
        a, b = fingerprint.stated_cells(r.fingerprint), fingerprint.stated_cells(r.edited_fingerprint)
        assert fingerprint.likenesses([(a, b)]) == [r.near_edited]


def test_op4_targets_and_takes(docs, odd, none, spark):
    for rows in (docs, odd):
        got = mixing.mix_counts(rows, block=16).collect()
        assert len(got) == rows.count() and all(0 <= r.taken <= 2 * r.size for r in got)
        assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_counts(rows.repartition(3), block=16).collect()), key=repr)
    sizes = dict(docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).collect())
    names = sorted(sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while True:  # the excess over the caps is shared anew until none is above
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    got = mixing.mix_counts(docs, block=16).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * target[r.source] and abs(r.taken - r.target) <= 1
    assert mixing.mix_counts(none).count() == 0


def test_op4_any_share_and_shard_draws(spark):
    """Targets of many passes are met exactly; shards' counts keep the totals and spread like a draw, whatever their number."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (5 if i % 2 else 2)), "a" if i < 10 else None) for i in range(20)], "doc_id long, text string, source string")
    for most, share in ((4.0, 4.0), (7.0, 6.5)):
        got = mixing.mix_counts(docs, most=most, share=share, block=16)
        totals = got.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert len(totals) == 2 and all(r.taken == int(r.target) for r in totals)
    sources = spark.createDataFrame([("a", 100_000), ("b", 300), ("c", 1), (None, 2_000)], "source string, n long")
    for shards in (1, 7, 64):
        rows = mixing.shard_counts(sources, shards).collect()
        for name, n in (("a", 100_000), ("b", 300), ("c", 1), (None, 2_000)):
            own = sorted((r.first, r["count"], r.shard) for r in rows if r.source == name)
            assert sum(c for _, c, _ in own) == n and [f for f, _, _ in own] == np.cumsum([0] + [c for _, c, _ in own])[:-1].tolist() and all(0 <= s < shards for _, _, s in own)
            if n == 100_000:
                counts = np.array([c for _, c, _ in own])
                assert len(counts) == shards and np.abs(counts - n / shards).max() < 5 * (n / shards) ** 0.5 + 1


def test_large_shard_trees_are_dealt_over_tasks(spark, monkeypatch):
    """The same draws, whichever tasks make them; no task makes all of a source's."""
    sources = spark.createDataFrame([("hot", 40_000), ("b", 9000), (None, 300)], "source string, n long")
    rows = mixing.shard_counts(sources, 1 << 12).withColumn("task", F.spark_partition_id()).collect()
    hot = [r.task for r in rows if r.source == "hot"]
    assert len(set(hot)) > 2 and max(hot.count(t) for t in set(hot)) < 0.5 * len(hot)
    monkeypatch.setattr(mixing, "DEALT_LEVEL", 99)
    assert sorted(map(tuple, mixing.shard_counts(sources, 1 << 12).collect()), key=repr) == sorted((tuple(r)[:-1] for r in rows), key=repr)
    assert sum(r["count"] for r in rows) == 49_300


def test_op4_documents_are_the_takes(docs, odd):
    for rows in (docs, odd):
        mixed = mixing.mix_documents(rows, block=16)
        assert mixed.columns == rows.columns
        got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
        assert got == {r.doc_id: r.n for r in mixing.mix_counts(rows, block=16).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect() if r.n}


def test_op5_held_out(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, trees).select("row.doc_id", "score").join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert len(scored) > 20 and np.mean([(r.score >= 0.5) == (r.quality == 1) for r in scored]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score_quality(odd, trees).collect()) and quality.score_quality(odd, trees).count() == odd.count()
    empty = quality.fit_quality(none, labels.limit(0))
    assert quality.score_quality(none, empty).count() == 0 and quality.score_quality(odd, empty).first().score == 0.5


def test_op5_arrays_walk_like_plain_trees():
    rng = np.random.default_rng(2)
    x = rng.random((300, len(quality.FEATURES)))
    trees = quality.Trees.fit(x, (x[:, 0] + x[:, 3] * x[:, 5] > 0.8).astype(float))
    assert len(trees.feature)
    rows = np.concatenate([x[:50], rng.random((50, x.shape[1])), np.zeros((1, x.shape[1]))])

    def plain(row):
        total = trees.base
        for feature, threshold, value in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0  # of the whole tree: children of i are 2i + 1 and 2i + 2
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(rows), [plain(r) for r in rows])


def test_op5_sample_is_bounded_by_rows(spark):
    """A doc_id that repeats many times is one row of the sample; scores don't depend on the order of rows."""
    docs = spark.createDataFrame([(1, f"junk {i} {'$' * 40}") for i in range(200)] + [(i, f"good words of a plain text number {i} stand here in a line.") for i in range(2, 90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 1)) for i in range(1, 90)], "doc_id long, quality int")
    one, other = (quality.fit_quality(d, labels, sample_rows=60) for d in (docs, docs.orderBy(F.rand(5))))
    assert np.array_equal(one.threshold, other.threshold) and np.array_equal(one.value, other.value)


def brute_windows(rows, threshold):
    best = {}
    key = lambda d: float("inf") if d is None else d
    for d, t in rows:
        t = (t or "").encode()
        for i in range(len(t) - threshold + 1):
            w = t[i : i + threshold]
            best[w] = min(best.get(w, float("inf")), key(d))
    for d, t in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - threshold + 1):
            if best[t[i : i + threshold]] < key(d):
                gone[i : i + threshold] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        yield d, len(t), int(gone.sum()), int((edges == 1).sum()), bytes(b for b, g in zip(t, gone) if not g)


def test_op6_equals_brute_force(spark, odd, none):
    rng = random.Random(4)
    pool = ["".join(rng.choice("ab cdé") for _ in range(rng.randint(30, 140))) for _ in range(6)]
    rows = [(rng.randint(0, 30), "".join(rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice("ab ") for _ in range(rng.randint(0, 80))) for _ in range(rng.randint(0, 5)))) for _ in range(40)]
    own = spark.createDataFrame(rows + [(None, pool[0] * 2), (7, "z" * 200), (8, "z" * 200)], "doc_id long, text string")
    for table in (own, odd.where("length(text) < 1000 or text is null")):
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(table).collect()), key=repr)
        assert got == sorted(brute_windows([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()], 50), key=repr)
    assert suffix_dedup.remove_repeats(odd).count() == odd.count() and suffix_dedup.remove_repeats(none).count() == 0


def test_op6_divides_a_string_of_every_document(spark):
    """One 16-byte string that hashes low, in every document with other context: no shard gathers its windows."""
    rng = random.Random(8)
    many = ["".join(rng.choice("abcdefgh") for _ in range(16)) for _ in range(50_000)]
    common = many[int(np.argmin(suffix_dedup.string_hashes(np.frombuffer("".join(many).encode(), np.uint8), 16)[::16]))]
    text = lambda: "".join(rng.choice("ijklmnop") for _ in range(60)) + common + "".join(rng.choice("ijklmnop") for _ in range(60))
    shared = [text() for _ in range(5)]
    rows = [(i % 150, "".join(rng.choice(shared) if rng.random() < 0.1 else text() for _ in range(4))) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, hot_bytes=4000).collect()), key=repr)
    assert got == sorted(brute_windows(rows, 50), key=repr) and any(r[2] for r in got)
    held, codes = [], []
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        _, start, stop, digit = suffix_dedup.runs(data, np.array([len(data)]), 50)
        held.append((i, text.encode(), start, stop, suffix_dedup.told(digit, 3)[1]))
        codes.append(held[-1][-1])
    code, n = np.unique(np.concatenate(codes), return_counts=True)
    assert n.max() > 300  # the common string's digit
    tasks = suffix_dedup.Held(50, 3, code[n > 40], 50)
    for i, text, start, stop, own in held:
        tasks.add(np.full(len(own), i), np.full(len(own), i), np.zeros(len(own), np.int64), text, start, stop, own)
    sizes = {}
    for shard, blob in tasks.sent()[0]:
        size = suffix_dedup.unbundled("qqqQQ", blob)[0].size if shard >= 3 else 0
        sizes[shard] = sizes.get(shard, 0) + size
    assert sum(sizes.values()) > 4000 and max(sizes.values()) < 0.06 * sum(sizes.values())


def test_op7_equals_brute_force(spark, odd, none):
    rng = random.Random(5)
    lines = ["  Common LINE %d with quite enough characters in it  " % i for i in range(4)] + ["short", "", "É" * 40]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 5)))) for i in range(30)] + [(i, None) for i in (30, 31)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    for d, t in rows:
        own = (t or "").split("\n")
        left = [x for x in own if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and d != max(held[key(x)]))]
        assert got[d] == ("\n".join(left), len(own), len(own) - len(left))
    assert line_dedup.drop_repeated_lines(odd).count() == odd.count() and line_dedup.drop_repeated_lines(none).count() == 0


def test_op8_counts(odd, none):
    words = "a b c x a b c y".split()
    assert line_quality.repeat_words([w.encode() for w in words]) == 6
    got = {r.doc_id: r for r in line_quality.judge(odd).where("doc_id in (0, 2, 5)").collect()}
    assert got[0].n_words == got[2].n_words == 0 and got[0].base_failed and not got[0].kept
    assert got[5].n_words == 20000 and got[5].n_repeat_words == 20000 and got[5].word_chars == len(LONG.replace(" ", ""))
    assert line_quality.judge(odd).count() == odd.count() and line_quality.judge(none).count() == 0


def test_op8_rejects_depleted_documents(spark):
    boiler = [f"boiler line {i} " + " ".join(f"b{i}x{j}" for j in range(12)) for i in range(6)]
    own = lambda d: " ".join(f"w{d}y{j}" for j in range(60))
    rows = [(d, "\n".join([*boiler, f"only {d}"]), "h") for d in range(40)] + [(d, own(d) + "\n" + boiler[0], "h") for d in range(40, 60)] + [(d, "\n".join(boiler), "h") for d in range(60, 90)]
    got = {r.doc_id: r.kept for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[d] for d in [*range(40), *range(60, 90)]) and all(got[d] for d in range(40, 60))


def test_op8_counts_documents_of_a_host(spark):
    """Copies count each, repeated lines of one document once; a null host is one host; another host's documents don't count."""
    text = lambda line, d: line + "\n" + " ".join(f"z{d}q{j}" for j in range(10))
    long = " ".join(f"k{j}" for j in range(60))
    rows = [(d, long, "copies") for d in range(6)] + [(10 + d, long, "few") for d in range(5)] + [(20 + d, text(long, d), None) for d in range(6)] + [(30 + d, text(long, d), f"h{d}") for d in range(20)] + [(60, "\n".join([long] * 9), "once")]
    got = {r.doc_id: (r.n_removed_words, r.base_failed, r.kept) for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[d] == (60, False, False) for d in [*range(6), *range(20, 26)]) and all(got[d] == (0, False, True) for d in [*range(10, 15), *range(30, 50)])
    assert got[60] == (0, True, False)


def test_op9_files_give_back_the_ids(docs, odd, none):
    t = library("byte_bpe_50k.json")
    for rows in (docs, odd):
        got = sorted(token_files.token_files(rows, public_tokenizers.path("byte_bpe_50k.json")).collect(), key=lambda r: r.start)
        at = 0
        for r, (d, text) in zip(got, sorted(((r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), strict=True):
            ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
            assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) == (d, at, len(ids) // 4, zlib.crc32(ids))
            at += len(ids) // 4
    assert token_files.token_files(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_op9_blocks(seed):
    rng = np.random.default_rng(seed)
    ids = (rng.integers(0, 50257, 700) if seed % 2 else rng.integers(0, 9, 1)).astype("<u4")
    if seed == 3:
        ids[5] = 2**32 - 1
    starts, flat = token_files.pack_blocks(ids)
    assert (token_files.unpack_blocks(np.frombuffer(flat, np.uint8), starts, len(ids)) == ids).all()


def brute_near(rows, words, percent):
    def shingles(t):
        own = (t or "").translate({c: c + 32 for c in range(65, 91)}).split()
        return frozenset([tuple(own)] if 0 < len(own) < words else [tuple(own[i : i + words]) for i in range(len(own) - words + 1)])

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted([(d, len(sets[i]), least[top(i)] if d is not None else None) for i, (d, _) in enumerate(rows)], key=repr)


def test_op10_equals_brute_force(spark, odd, none):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = []
    for i in range(160):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"w{rng.randint(0, 60)}"
        rows.append((i, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 85), (5, 80)):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table, words=words, percent=percent).collect()), key=repr)
        assert got == brute_near(rows, words, percent)
    small = odd.where("length(text) < 1000 or text is null")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(small, words=3, percent=85).collect()), key=repr)
    assert got == brute_near([(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()], 3, 85)
    assert near_dedup.near_duplicates(odd, words=3, percent=85).count() == odd.count() and near_dedup.near_duplicates(none).count() == 0


def test_queries_are_registered():
    from factforge.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
