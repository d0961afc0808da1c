"""What a task holds and how often rows are read, on small inputs."""

import glob
import math
import os
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factforge.operators import extract, history, recursive, search, sheets
from factforge.plans import base, flows, pages
from factforge.plans.registry import QUERIES
from factforge.sources import tables
from tests.test_mechanisms import plan

TEXTS = "page_id long, no long, cy double, h double"


def test_texts_beside_each_other_meet_in_one_join(spark):
    """Also where only the other text is tall enough, at bins' edges, and below zero."""
    rows = [(p, i, (i * 37 % 400) / 4 - 20.0, (1.0, 8.0, 10.0, 90.0)[i % 4]) for p in (1, 2) for i in range(40)]
    t = spark.createDataFrame(rows, TEXTS)
    out = sheets.beside(t.where("no < 15"), t, 0.7)
    got = sorted(tuple(r) for r in out.select("page_id", "no", "o_no").collect())
    assert got == sorted((p, i, j) for p, i, a, h in rows for q, j, b, g in rows if p == q and i < 15 and abs(a - b) <= 0.7 * max(h, g))
    assert plan(out).count("Join type:") == 1


BY_ORDER = ["rule_markers", "prep_stable_ids", "fuse_collect_evidence", "fuse_load_conflicts", "calc_work_stress", "fuse_force_bundle", "rule_issue_dedupe"]


@pytest.mark.parametrize("name", [*BY_ORDER, "tol_grade_inference", "tol_grade_overall"])
def test_tasks_follow_the_size_of_the_input(spark, sf_dir, monkeypatch, name):
    """Beyond the session's 5 shuffle partitions rows are dealt once, by review, and everything after it takes that over."""
    before = sorted(map(str, QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(base, "SHARE", {t: -(-base.stored_bytes(spark, f"{sf_dir}/{t}.parquet") // 13) for t in base.SHARE})
    out = QUERIES[name](spark, sf_dir)
    shown = out._jdf.queryExecution().executedPlan().toString()
    assert ", 13), REPARTITION_BY_NUM" in shown
    if name in BY_ORDER:
        assert ", 5), ENSURE_REQUIREMENTS" not in shown
    assert sorted(map(str, out.collect())) == before


def test_a_stream_of_candidates_is_dealt_by_its_size(spark, sf_dir, monkeypatch):
    """More files and tasks for more rows, in two batches still, with the same result."""
    before = sorted(map(str, QUERIES["st_incremental_fuse"](spark, sf_dir).collect()))
    seen = []
    incremental = flows.events.incremental
    monkeypatch.setattr(flows.events, "incremental", lambda stream, folder, *a, **k: (seen.append((folder, k)), incremental(stream, folder, *a, **k))[1])
    monkeypatch.setattr(base, "SHARE", {t: -(-base.stored_bytes(spark, f"{sf_dir}/{t}.parquet") // 48) for t in base.SHARE})
    assert sorted(map(str, QUERIES["st_incremental_fuse"](spark, sf_dir).collect())) == before
    folder, k = seen[0]
    kept = spark.read.parquet(f"{folder}/index/*").select("batch").distinct().collect()
    assert k["tasks"] == 8 and {r.batch for r in kept} <= {0, 1} and len({f.split("part-")[1][:5] for f in spark.read.parquet(f"{folder}/kept/000000000").inputFiles()}) == 8


def test_fnv1a_folds_bytes_and_empty_levels_are_leaves(spark):
    def fnv(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return f"{h:08x}"

    texts = ["", "a", "päß\n€\U0001f600\x00é", "Σ" * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("t", history.fnv1a(F.col("t")).alias("h"))
    assert {r.t: r.h for r in rows.collect()} == {t: fnv(t) for t in texts}
    assert "conv(" not in plan(rows)  # a look-up by place for each byte reads a text as often as it is long
    docs = spark.createDataFrame([(1, '{"a":{},"b":[],"c":[null],"d":{"e":null},"f":[[],{}],"g":[1,"x"]}'), (2, "[]"), (3, "{}"), (4, "no json")], "id long, d string")
    got = sorted(r.leaf for r in history.canonical_leaves(docs, ["id"], "d").where("id = 1").collect())
    assert got == [".a={}", ".b=[]", ".c[000000000]=null", ".d.e=null", ".f[000000000]=[]", ".f[000000001]={}", ".g[000000000]=1", '.g[000000001]="x"']
    assert sorted((r.id, r.leaf) for r in history.canonical_leaves(docs, ["id"], "d").where("id > 1").collect()) == [(2, "=[]"), (3, "={}"), (4, '="no json"')]


def test_replays_ask_the_store_by_cell(spark):
    """Not once for each id; a sweep leaves what the watermark has not passed."""
    from factforge.streaming.events import ReplayGuard

    store, calls, timers = {}, [], []
    told = lambda name, f: lambda *a: (calls.append(name), f(*a))[1]
    state = SimpleNamespace(getValue=told("get", store.get), containsKey=told("get", store.__contains__), updateValue=told("put", store.__setitem__), removeKey=told("remove", store.pop), keys=lambda: iter(list(store)), iterator=lambda: iter(list(store.items())))
    guard = ReplayGuard(1000)
    guard.init(SimpleNamespace(getMapState=lambda *a: state, listTimers=lambda: iter(timers), registerTimer=timers.append))
    at = pd.Timestamp("2024-01-01")
    rows = lambda ids, digest, hours: pd.DataFrame({"id": [f"e{i}" for i in ids], "digest": digest, "ts": at + pd.Timedelta(hours=hours), "cell": [i % 4 for i in ids]})
    first = pd.concat(guard.handleInputRows((0,), iter([rows(range(1000), "a", 0), rows(range(0, 1000, 2), "b", 1)]), None))
    assert first.outcome.value_counts().to_dict() == {"new": 1000, "conflict": 500} and len(calls) <= 8
    second = pd.concat(guard.handleInputRows((0,), iter([rows(range(990, 1010), "a", 2)]), None))
    assert second.sort_values("id").outcome.value_counts().to_dict() == {"new": 10, "replay": 10} and len(calls) <= 16
    ms = int((at + pd.Timedelta(hours=1)).timestamp() * 1000)
    list(guard.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: ms), None))
    third = pd.concat(guard.handleInputRows((0,), iter([rows([5, 1005], "a", 3)]), None))
    assert dict(zip(third.id, third.outcome, strict=True)) == {"e5": "new", "e1005": "replay"} and len(calls) <= 32


def test_events_arrive_in_files_by_size(spark, sf_dir, monkeypatch):
    """As many for each of the four batches, with the same result."""
    before = sorted(map(str, QUERIES["st_dedupe_events"](spark, sf_dir).collect()))
    monkeypatch.setattr(base, "SHARE", base.SHARE | {"events": -(-base.stored_bytes(spark, f"{sf_dir}/events.parquet") // 12)})
    monkeypatch.setattr(flows, "FILE_ROWS", 20)
    folders = []
    scratch = flows.tables.scratch
    monkeypatch.setattr(flows.tables, "scratch", lambda *a: (folders.append(scratch(*a)), folders[-1])[1])
    assert sorted(map(str, QUERIES["st_dedupe_events"](spark, sf_dir).collect())) == before
    assert len(spark.read.parquet(folders[0]).inputFiles()) == 12


def test_forces_of_a_text_are_matched_in_one_pass(spark):
    """Also in texts that hold the marks between the groups."""
    texts = ["\u0002F1=100N+/-5N\u0001 F2=200N + 10 / -5\u0002", "no force", None, "", "F3\u0001=4N F4=5kN -1% F5=6 N"]
    out = extract.force_annotations(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), ["i"])
    got = sorted((r.i, r.label, r.force, r.unit, r.tol_upper, r.tol_lower, r.state) for r in out.collect())
    assert got == [(0, "F1", 100.0, "N", 5.0, -5.0, "specified"), (0, "F2", 200.0, "N", 10.0, -5.0, "specified"), (4, "F4", 5.0, "kN", None, None, "uncertain"), (4, "F5", 6.0, "N", None, None, "not_specified")]
    assert plan(out).count("(?<![A-Za-z0-9_])") <= 2  # as Input of a step and as the step


def test_patterns_are_matched_against_texts_that_hold_their_words(spark):
    """With the same result as against all; every word of a pattern, in either case, is one of them."""
    import re

    words = [w for _, p, *_ in extract.LABELED for w in re.match(r"\(\?:(.*?)\)(?=\\s)", p)[1].replace("\\s*", " ").replace("\\.", ".").split("|")]
    assert len(words) > 60
    texts = [f"x {f(w)}{s}3.5, " for w in words for f in (str, str.lower, str.upper, lambda w: w.replace(" ", "")) for s in ("", " : φ", "：")]
    rows = spark.createDataFrame(list(enumerate([*texts, *(a + b for a, b in zip(texts, reversed(texts), strict=True)), None, "", "İD 4 OD 5"])), "i int, text string")
    plain = tuple((f, f"(?:{p})", u, c) for f, p, u, c in extract.LABELED)
    out = extract.labeled_numbers(rows, ["i"])
    got = sorted(map(tuple, out.collect()))
    assert got == sorted(map(tuple, extract.labeled_numbers(rows, ["i"], plain).collect())) and {r[1] for r in got} == {r[0] for r in extract.LABELED}
    assert plan(out).count("Contains(") >= 22 or plan(out).count("contains(") >= 22


def test_chunks_are_split_once_and_indexed_by_the_words_of_queries(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "a b a 弹簧压缩试验"), (2, "b c"), (3, None), (2, "c")], "doc_id long, text string")
    out = search.postings(chunks, "doc_id", "text")
    got = sorted(tuple(r) for r in out.where("token < 'z'").select("token", "doc_id", "n", "n_chunks").collect())
    assert got == [("a", 1, 2, 1), ("b", 1, 1, 2), ("b", 2, 1, 2), ("c", 2, 2, 1)]
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
    written = []
    durable = search.durable
    monkeypatch.setattr(search, "durable", lambda df: (written.append(durable(df)), written[-1])[1])
    queries = spark.createDataFrame([(7, "b b x")], "item_id long, text string")
    assert [tuple(r) for r in search.score_topk(queries, chunks, 5, "item_id", "doc_id").select("item_id", "doc_id", "rank", "score").collect()] == [(7, 1, 1, 10.0), (7, 2, 2, 10.0)]
    assert sorted(r.doc_id for r in written[0].collect()) == [1, 2] and {r.token for r in written[0].collect()} == {"b"}


def test_a_round_of_heights_writes_open_points_alone(spark, monkeypatch):
    columns = "review_id long, seq long, page long, scope string, label string, kind string, value double, unit string, verified boolean, base_seq long, base_label string, height double, height_unit string, free_length double"
    step = lambda i, base: (1, i, 1, "a", None, "incremental_deflection", 1.0, "mm", True, base, None, None, "mm", None)
    rows = [(1, 0, 1, "a", None, None, None, "mm", True, None, None, 50.0, "mm", None)] + [step(i, i - 1) for i in range(1, 8)]
    written = []
    durable = recursive.durable
    monkeypatch.setattr(recursive, "durable", lambda df: (written.append(durable(df)), written[-1])[1])
    got = recursive.height_chain(spark.createDataFrame(rows, columns)).collect()
    assert sorted((r.seq, r.resolved, r.reason) for r in got) == [(i, 50.0 - i, "ok") for i in range(8)]
    assert [w.count() for w in written] == [8, 7, 6, 4]


def test_pages_are_looked_through_share_by_share(spark, sf_dir, monkeypatch):
    """What a share of the pages left on disk is gone before the next one begins; the rows are those of all pages at once."""
    def folders():
        return set(os.listdir(tables.shared_dir(spark).removeprefix("file://")))

    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data") if os.path.getsize(f)}

    before = sorted(map(str, QUERIES["geo_table_lookup"](spark, sf_dir).collect()))
    monkeypatch.setattr(pages, "PAGES_AT_ONCE", -(-base.stored_bytes(spark, f"{sf_dir}/lineitem.parquet") // 3))
    old, files, setting, rounds = folders(), shuffled(), spark.conf.get(tables.SHUFFLES_GO), []
    table_height = sheets.table_height
    monkeypatch.setattr(sheets, "table_height", lambda *a: (rounds.append((len(folders() - old), len(shuffled() - files))), table_height(*a))[1])
    out = QUERIES["geo_table_lookup"](spark, sf_dir)
    assert sorted(map(str, out.collect())) == before
    assert rounds == [(1, 0), (2, 0), (2, 0)]  # the share's lines, and the result once there is some
    assert len(folders() - old) == 1 and spark.conf.get(tables.SHUFFLES_GO) == setting


def test_vectors_meet_queries_in_blocks(spark, monkeypatch):
    """Slots of vectors against chunks of queries give the best of all pairs, ties by id; equal vectors beyond k, one without length, nulls."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8)).astype("f4")
    v[50:120], v[7], v[130], v[200:230] = v[49], 0, 0, v[200] * 2  # copies, no length, one direction
    rows = [(int(i), [float(x) for x in v[i]], int(i % 3 == 0)) for i in rng.permutation(400)] + [(900, None, 0), (901, [1.0, None] * 4, 0), (902, [1.0] * 8, None), (903, [1.0] * 4, 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(search, "VECTOR_BYTES", 2000)
    monkeypatch.setattr(search, "QUERY_BYTES", 300)
    out = search.vector_topk(t.where("vec_id % 5 = 0"), t, 6, "label")
    want = []
    with np.errstate(all="ignore"):
        unit = v.astype("f8") / np.sqrt((v.astype("f8") ** 2).sum(1))[:, None]
    for i in range(0, 400, 5):
        all_ = [(round(float(unit[i] @ unit[j]), 9), j) for j in range(400) if j != i and (i % 3 == 0) == (j % 3 == 0)]
        order = sorted((x for x in all_ if math.isnan(x[0]) or x[0] >= 0.1), key=lambda x: (-9 if math.isnan(x[0]) else -x[0], x[1]))[:6]
        want += [(i, j, n + 1) for n, (_, j) in enumerate(order)]
    got = out.collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(want) and math.isnan(next(r.score for r in got if r.vec_id == 130))
    assert "FlatMapCoGroupsInArrow" in plan(out)  # the pairs are no rows


def test_blocks_of_vectors_hold_the_best_of_all(monkeypatch):
    monkeypatch.setattr(search, "VECTOR_ROWS", 16)
    monkeypatch.setattr(search, "QUERY_ROWS", 4)
    rng = np.random.default_rng(6)
    ids, v = rng.integers(0, 90, 100), rng.integers(-2, 3, (100, 4)).astype("f4")  # ids that repeat, many ties
    q_ids, q = np.arange(10), rng.integers(-2, 3, (10, 4)).astype("f4")
    i, j, s = search._near(ids, v, q_ids, q, 5, 0.1)
    for a in range(10):
        order = lambda pairs: sorted(((-9 if math.isnan(x) else -round(x, 9)), int(d)) for x, d in pairs)[:5]
        every = [(x, d) for x, d in zip(search.cosine(v, np.repeat(q[a : a + 1], 100, 0)), ids) if d != a and not x < 0.1 - 5e-10]
        assert order((x, d) for x, d in zip(s[i == a], ids[j[i == a]]) if d != a and not x < 0.1 - 5e-10) == order(every)
