"""Boundary cases of formulas, states and order invariance that the stand-in tables don't hold."""

import math

from pyspark.sql import functions as F

from factforge.operators import calc, components, dictionary, extract, fuse, prep, recursive, rules
from factforge.streaming import events


def test_strict_number(spark):
    rows = spark.createDataFrame([("1.5",), (" 2 ",), ("true",), ("NaN",), ("inf",), ("",), (None,), ("1e400",), ("3mm",)], "s string")
    got = [r.v for r in rows.select(prep.strict_number(F.col("s")).alias("v")).collect()]
    assert got == [1.5, 2.0] + [None] * 7


def test_units(spark):
    rows = spark.createDataFrame([(2.0, "kN"), (2.0, None), (2.0, "stone"), (2.0, "")], "v double, u string")
    assert [r.x for r in rows.select(prep.to_base(F.col("v"), F.col("u"), "force").alias("x")).collect()] == [2000.0, 2.0, None, 2.0]
    assert [r.x for r in rows.select(prep.to_base(F.col("v"), F.col("u"), "force", explicit=True).alias("x")).collect()] == [2000.0, None, None, None]


def test_band_ends(spark):
    bands = spark.createDataFrame([(3.0, 8.0, True, 1, 0.01, 0.15), (8.0, 15.0, False, 1, 0.015, 0.2)], "c_min double, c_max double, include_min boolean, grade int, factor double, minimum double")
    rows = spark.createDataFrame([(3.0, 1, 10.0), (8.0, 1, 100.0), (8.1, 1, 100.0), (15.1, 1, 1.0)], "c double, grade int, base double")
    got = {r.c: r.tolerance for r in calc.band_lookup(rows, bands, "c", "base", key="c").collect()}
    assert got == {3.0: 0.15, 8.0: 1.0, 8.1: 1.5, 15.1: None}


def test_spring_rate(spark):
    row = spark.createDataFrame([(2.0, 20.0, 12.0, "ground", "inconel 718"), (2.0, 20.0, 12.0, "ground", "brass"), (2.0, 2.0, 12.0, "ground", "SUS316"), (2.0, 20.0, 12.0, "ground", None)], "wire_diameter double, outer_diameter double, total_coils double, end_mode string, material string")
    row = row.selectExpr("*", "'compression_spring' AS spring_type", "'closed' AS end_type", "1.0D AS support_coils", "CAST(NULL AS DOUBLE) AS drawn_active")
    assert math.isclose(row.select(calc.stiffness()).first()[0], 78500 * 16 / (8 * 18**3 * 10), rel_tol=1e-8)
    assert [r.s for r in row.select(calc.stiffness_status().alias("s")).collect()] == ["calculated", "material_not_configured", "missing_context", "missing_context"]


def test_fusion_does_not_depend_on_partitions(spark):
    rows = [(i % 7, i, "f", "manual" if i % 3 == 0 else "page_ocr", float(i % 5), 0.5 + (i % 4) / 10) for i in range(200)]
    c = spark.createDataFrame(rows, "review_id long, seq long, field string, source string, value double, confidence double")
    once = sorted(fuse.review_flag(c).collect())
    assert once == sorted(fuse.review_flag(c.repartition(7, F.rand(3))).collect())


def test_status_fold_stream_and_batch_agree(spark, sf_dir, tmp_path):
    rows = [(i, i * 10, i % 4, ["queued", "generating_3d", "generating_2d", "completed", "failed"][(i * 7) % 5], float(i % 9)) for i in range(120)]
    table = spark.createDataFrame(rows, "event_id long, s long, job_id long, status string, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    table.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = events.event_stream(spark, f"file://{tmp_path}/in", "event_id long, job_id long, status string, value double, ts timestamp")
    got = events.last_rows(events.finished(events.status_fold(stream), f"file://{tmp_path}", "update", events.ROCKS), "job_id")
    want = events.status_fold_batch(table)
    assert sorted(map(tuple, got.select("job_id", "status", "progress", "ignored", "conflicts").collect())) == sorted(map(tuple, want.collect()))


def test_lineage_cycle_is_not_current(spark):
    values = spark.createDataFrame([(1, x) for x in "abcd"], "review_id long, field string")
    edges = spark.createDataFrame([(1, "b", "a"), (1, "c", "d"), (1, "d", "c")], "review_id long, field string, input string")
    got = {r.field: r.current for r in prep.stale_lineage(values, edges, ["review_id"]).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


def test_chain_of_boxes_is_one_group(spark):
    nodes = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0), (2, 1)], "page_id int, block_no int")
    edges = spark.createDataFrame([(1, a, b) for i in range(9) for a, b in ((i, i + 1), (i + 1, i))], "page_id int, block_no int, other int")
    got = {(r.page_id, r.block_no): r.group for r in components.connected(edges, nodes, ["page_id"], "block_no").collect()}
    assert got == {(1, i): 0 for i in range(10)} | {(2, 0): 0, (2, 1): 1}


CANDIDATE = "review_id long, seq long, field string, source string, value double, confidence double"


def test_fused_confidence_by_hand(spark):
    """A lone candidate keeps its own confidence; two of one source are two candidates; the best one's own confidence decides on review."""
    rows = [(1, 1, "a", "page_ocr", 5.0, 0.9), (2, 1, "a", "manual", 5.0, 0.96), (3, 1, "a", "page_ocr", 5.0, 0.9), (3, 2, "a", "page_ocr", 6.0, 0.5), (4, 1, "a", "Inference", 1.0, 1.0), (4, 2, "a", "vision_model", 1.0, 0.6)]
    rows += [(5, i, "a", "human", 1.0, 1.0) for i in range(4)] + [(6, 1, "a", None, 1.0, None)]
    c = spark.createDataFrame(rows, CANDIDATE)
    got = {r.review_id: (r.confidence, r.n_candidates, r.needs_review) for r in fuse.review_flag(c).collect()}
    joint = 1 - (1 - 0.9 * 0.78) * (1 - 0.5 * 0.78)
    assert got == {1: (0.9, 1, True), 2: (0.96, 1, False), 3: (max(0.9, round(joint, 3)), 2, False), 4: (0.99, 2, False), 5: (0.99, 4, False), 6: (0.0, 1, True)}
    assert {r.review_id: r.confidence for r in fuse.confidence(c).collect()} == {k: v[0] for k, v in got.items()}
    assert {r.review_id for r in fuse.conflicts(c).collect()} == {3}


def test_source_weights_and_text_values(spark):
    names = ["qwen_vision", "my-vision", "RapidOCR", "baidu_ocr", "Human", "?", None]
    rows = spark.createDataFrame([(n,) for n in names], "source string")
    assert [r.w for r in rows.select(fuse.source_weight("source").alias("w")).collect()] == [0.88, 0.62, 0.78, 0.82, 1.0, 0.5, 0.5]
    many = spark.createDataFrame([(1, 1, "support_coils", ["inference", "cad"], " x", 0.5, None), (1, 2, "support_coils", ["ocr"], "x ", 0.4, "drawing_single_end"), (2, 1, "f", [], "1", 0.5, None), (2, 2, "f", ["ocr"], None, 0.1, None)], "review_id long, seq long, field string, source array<string>, value string, confidence double, support_coils_origin string")
    got = {(r.review_id, r.seq): (r.weight, r["rank"]) for r in fuse.scored(many).collect()}
    assert got == {(1, 1): (0.95, 2), (1, 2): (0.78, 1), (2, 1): (0.5, 1), (2, 2): (0.78, 2)}
    assert [(r.review_id, r.n_differing) for r in fuse.conflicts(many).collect()] == [(2, 1)]


RELATION = "review_id long, seq long, kind string, value double, unit string, verified boolean, base_seq long, base_label string, page int, scope string, label string, height double, height_unit string, free_length double"


def relation(k, seq, kind=None, value=None, base=None, label=None, unit="mm", verified=True, page=1, scope="a", own=None, height=None, free=None):
    return (k, seq, kind, value, unit, verified, base, label, page, scope, own or f"F{seq}", height, "mm", free)


def test_long_height_chain_and_cycle(spark):
    step = "incremental_deflection"
    rows = [relation(1, 0, height=50_000.0)] + [relation(1, i, step, 2.0, i - 1) for i in range(1, 10_001)]
    rows += [relation(2, 1, step, 1.0, 2), relation(2, 2, step, 1.0, 3), relation(2, 3, step, 1.0, 1), relation(2, 4, step, 1.0, 3), relation(2, 5, step, 1.0, 5), relation(2, 6, height=3.0), relation(2, 7, step, 3.0, 6), relation(2, 8, step, 1.0, 99), relation(2, 9, step, 0.5, 7), relation(3, 1)]
    got = {(r.review_id, r.seq): (r.resolved, r.reason) for r in recursive.height_chain(spark.createDataFrame(rows, RELATION)).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, i): (50_000.0 - 2 * i, "ok") for i in range(10_001)}
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {i: (None, "base_unresolved") for i in (1, 2, 3, 4, 5, 9)} | {6: (3.0, "ok"), 7: (None, "out_of_range"), 8: (None, "base_not_unique")}
    assert got[3, 1] == (None, "no_height") and recursive.height_chain(spark.createDataFrame([], RELATION)).count() == 0


def test_height_relations_by_hand(spark):
    step, free, drawn = "incremental_deflection", "free_deflection", "absolute_height"
    rows = [
        relation(1, 1, free, 10.0, free=60.0), relation(1, 2, step, -30.0, 1, free=60.0), relation(1, 3, step, 1.0, label=" f1 ", unit="cm", free=60.0), relation(1, 4, drawn, 70.0, free=60.0), relation(1, 5, step, 5.0, 4, free=60.0), relation(1, 6, step, 7.0, 5, free=60.0),
        relation(1, 7, free, 70.0, free=60.0), relation(1, 8, step, 5.0, 7, free=60.0), relation(1, 9, drawn, 40.0, verified=False, free=60.0), relation(1, 10, "unknown", 40.0, free=60.0), relation(1, 11, step, 1.0, 1, page=2, free=60.0), relation(1, 12, step, 1.0, 1, scope="b", free=60.0),
        relation(1, 13, drawn, None, free=60.0), relation(1, 14, step, 20.0, 4, free=60.0), relation(1, 15, step, 1.0, 14, free=60.0), relation(2, 1, free, 10.0), relation(2, 2, drawn, 9.0, own="X"), relation(2, 3, drawn, 8.0, own="x"), relation(2, 4, step, 1.0, label="X"),
    ]
    heights = recursive.height_chain(spark.createDataFrame(rows, RELATION))
    got = {(r.review_id, r.seq): (r.resolved, r.reason) for r in heights.collect()}
    assert got == {
        (1, 1): (50.0, "ok"), (1, 2): (None, "invalid_distance"), (1, 3): (40.0, "ok"), (1, 4): (70.0, "ok"), (1, 5): (None, "out_of_range"), (1, 6): (None, "base_unresolved"), (1, 7): (None, "out_of_range"), (1, 8): (None, "base_unresolved"),
        (1, 9): (None, "unverified"), (1, 10): (None, "unverified"), (1, 11): (None, "base_not_unique"), (1, 12): (None, "base_not_unique"), (1, 13): (None, "invalid_distance"), (1, 14): (50.0, "ok"), (1, 15): (49.0, "ok"), (2, 1): (None, "no_free_length"), (2, 2): (9.0, "ok"), (2, 3): (8.0, "ok"), (2, 4): (None, "base_not_unique"),
    }
    points = spark.createDataFrame([(1, 1, 100.0, None), (1, 3, 150.0, 10.0), (1, 4, 10.0, None), (1, 14, 5.0, 20.0), (1, 15, None, 1.0)], "review_id long, seq long, force double, distance double")
    declared = spark.createDataFrame([(1, 5.0, 1.0, -1.0)], "review_id long, rate_value double, rate_upper double, rate_lower double")
    assert sorted(tuple(r) for r in recursive.secant_rate(heights, points, declared).collect()) == [(1, 3, 5.0, ""), (1, 14, -0.25, "outside_band")]
    assert sorted(tuple(r) for r in recursive.secant_rate(heights, points).collect()) == [(1, 3, 5.0, ""), (1, 14, -0.25, "not_increasing")]


def test_long_lineage_and_closure(spark):
    n = 20
    values = spark.createDataFrame([(k, f"f{i:02d}") for k in (1, 2) for i in range(n) if (k, i) != (2, 0)], "review_id long, field string")
    edges = spark.createDataFrame([(k, f"f{i:02d}", f"f{i - 1:02d}") for k in (1, 2) for i in range(1, n)], "review_id long, field string, input string")
    got = {(r.review_id, r.field): r.current for r in prep.stale_lineage(values, edges, ["review_id"]).collect()}
    assert got == {(1, f"f{i:02d}"): True for i in range(n)} | {(2, f"f{i:02d}"): False for i in range(1, n)}
    ring = spark.createDataFrame([(1, i, i + 1) for i in range(12)] + [(2, 0, 1), (2, 1, 2), (2, 2, 0), (2, 0, 2)], "k long, src long, dst long")
    got = {(r.k, r.root, r.field): r.depth for r in recursive.dependents(ring, ["k"]).collect()}
    assert got == {(1, a, b): b - a for a in range(12) for b in range(a + 1, 13)} | {(2, 0, 1): 1, (2, 0, 2): 1, (2, 0, 0): 2, (2, 1, 2): 1, (2, 1, 0): 2, (2, 1, 1): 3, (2, 2, 0): 1, (2, 2, 1): 2, (2, 2, 2): 2}


def test_catalog_looks_at_every_occurrence(spark):
    """A first occurrence that is covered or negated doesn't hide a later one."""
    texts = spark.createDataFrame([(1, "There are the things."), (2, "no red ring, a red ring"), (3, "without ring"), (4, None), (5, ""), (6, "RED RINGRED ring")], "doc_id long, text string")
    words = spark.createDataFrame([("the",), ("there",), ("ring",), ("red ring",), (None,), ("",)], "word string")
    got = {(r.doc_id, r.word): (r.at, r.n) for r in extract.catalog_mentions(texts, words, "doc_id", "text", "word").collect()}
    assert got == {(1, "there"): (1, 1), (1, "the"): (11, 2), (2, "red ring"): (16, 1), (6, "red ring"): (1, 1)}


def test_all_roughness_mentions(spark):
    notes = spark.createDataFrame([(1, "bore Ra 0.8 and Ra 6.3 outer face; Ra 3.2 on surface"), (2, "no Ra 1.6 here; Ra 1.6"), (3, None)], "doc_id long, text string")
    assert {tuple(r) for r in extract.roughness_mentions(notes).collect()} == {(1, 0.8, "bore"), (1, 6.3, "bore"), (1, 3.2, "surface"), (2, 1.6, "unknown")}
    assert {tuple(r) for r in extract.evidence_quality(notes).collect()} == {(1, 0.8, "direct"), (1, 6.3, "direct"), (1, 3.2, "direct"), (2, 1.6, "direct")}


def test_labels_of_either_case(spark):
    texts = spark.createDataFrame([(1, "Wire Dia： φ2.5, 总圈数9"), (2, None), (3, "free length x")], "doc_id long, text string")
    assert {(r.doc_id, r.field, r.value, r.unit) for r in extract.labeled_numbers(texts, ["doc_id"]).collect()} == {(1, "wire_diameter", 2.5, "mm"), (1, "total_coils", 9.0, "turns")}
    notes = spark.createDataFrame([(1, "内径控制"), (2, "外径受控 内径控制 精度 2 级")], "doc_id long, text string")
    assert {(r.doc_id, r.feature, r.value) for r in extract.context_features(notes, ["doc_id"]).collect()} == {(1, "controlled_diameter_field", "inner_diameter"), (2, "controlled_diameter_field", "outer_diameter"), (2, "accuracy_grade", "2级")}


def test_dictionary_edges(spark):
    values = spark.createDataFrame([("hot-gear x",), ("gearhot",), ("",), (None,), ("ring 5",)], "v string")
    terms = spark.createDataFrame([(1, "GEAR", "hot-gear"), (2, "RING", "ring"), (3, "FIVE", "5"), (4, None, None)], "id int, term string, alias string")
    assert {(r.v, r.id) for r in dictionary.contains_grade(values, "v", terms).collect()} == {("hot-gear x", 1), ("ring 5", 2)}
    got = {(r.v, r.term): r.n for r in dictionary.fuzzy_topk(values, "v", terms, k=1).collect()}
    assert got[("gearhot", "GEAR")] == 1 and all(n == 1 for n in got.values()) and not any(v in ("", None) for v, _ in got)
    assert dictionary.fuzzy_topk(values, "v", terms.limit(0)).count() == 0 and dictionary.contains_grade(values.limit(0), "v", terms).count() == 0


def test_rule_tables_on_nulls(spark):
    kinds = ", ".join(f"{c} double" for c in (*rules.POSITIVE, "support_coils", "solid_height", "wire_upper"))
    none = [None] * 10
    one = lambda **k: tuple(k.get(c.split()[0]) for c in kinds.split(", "))
    rows = [(1, *none, None, None, None), (2, *one(wire_diameter=2.0, outer_diameter=4.0, inner_diameter=1.0, total_coils=60.0, active_coils=61.0, free_length=100.0), "ground", True, True), (3, *one(wire_diameter=0.0, total_coils=5.0), None, True, False)]
    table = spark.createDataFrame(rows, f"review_id long, {kinds}, end_mode string, has_points boolean, cold boolean")
    got: dict[int, set[str]] = {}
    for r in rules.issues(table, ["review_id"], rules.geometry_checks(F.col("cold"))).collect():
        got.setdefault(r.review_id, set()).add(r.rule_id)
    assert got == {2: {"SPRING-GEO-OUTER-INNER", "SPRING-GEO-DIAMETER-CONSISTENCY", "SPRING-GEO-COIL-COUNT", "GBT1239.2-SCOPE-SPRING-INDEX", "GBT1239.2-SCOPE-TOTAL-COILS", "GBT1239.2-SLENDERNESS", "SPRING-LOAD-FREE-OVER-SOLID"}, 3: {"SPRING-GEO-WIRE_DIAMETER", "SPRING-CONTEXT-ACTIVE-COILS", "SPRING-CONTEXT-END-CONDITION"}}


def test_markers_are_fields_all_points_and_notes_with_status(spark):
    fields = spark.createDataFrame([(1, "free_length", True), (1, "outer_diameter", True), (1, "wire_diameter", False), (2, "free_length", False)], "review_id long, name string, need boolean")
    points = spark.createDataFrame([(1, 2, "F1", False), (1, 1, "F1", True)], "review_id long, at long, name string, need boolean")  # two points of one label
    notes = spark.createDataFrame([(1, 1, "temper", True), (3, 1, "free_length", True)], "review_id long, at long, name string, need boolean")
    statuses = spark.createDataFrame([(1, "free_length", "fail"), (3, "free_length", "fail"), (1, "other", "warning")], "review_id long, field string, status string")
    got = rules.markers(fields, points, notes, statuses).orderBy("review_id", "number").collect()
    assert [(r.review_id, r.kind, r.name, r.status, r.number) for r in got] == [
        (1, 1, "free_length", "fail", 1), (1, 1, "outer_diameter", "need_review", 2), (1, 1, "wire_diameter", "pass", 3),
        (1, 2, "F1", "need_review", 4), (1, 2, "F1", "pass", 5), (1, 3, "temper", "need_review", 6), (2, 1, "free_length", "pass", 1), (3, 3, "free_length", "need_review", 1),
    ]
    assert [r.message for r in got[1:7]] == [rules.CONFIRM, rules.RECOGNIZED, rules.CHECK_POINT, rules.CHECK_POINT, rules.PASS_ON, rules.RECOGNIZED]
