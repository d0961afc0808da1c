"""The pipeline's stages on rows with nulls, repeated ids and clashing columns, and against plain statements of what each does."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append(docs)
    return out


def test_columns_and_shrinking(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(s.columns == columns for s in steps[:-1])
    n = [s.count() for s in steps]
    assert n[0] >= n[2] and n[0] == n[1] and n[3] == n[4] and steps[2].select("doc_id").distinct().count() == n[2]


def test_decisions_take_effect(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert steps[0].join(labels.where("quality = 0"), "doc_id").count() == 0
    assert labels.where("quality = 1").join(steps[0], "doc_id", "left_anti").count() == 0
    assert steps[1].where("n_chars <> length(text)").count() == 0
    assert steps[2].join(steps[1], ["doc_id", "text"], "left_anti").count() == 0
    assert steps[4].where("n_tokens * 4 <> length(ids)").count() == 0


def test_odd_rows_pass(spark):
    rows = [(1, None, None, None, None, "x"), (1, "a b c", "en", None, 5, None), (1, "a b c", "en", None, 5, None), (None, "d e", None, "s", 3, "x"), (2, "", "en", "s", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert name == "encoding" or out.columns == table.columns
            assert name not in ("line_dedup", "encoding") or out.count() == table.count()
            out.agg(F.count("*")).collect()


def test_near_dedup_decides_by_row(spark):
    """Equal rows of one id are one group, a copy under another id goes with them, another text of the id stays; empty texts stay."""
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (1, a), (1, a), (3, a), (3, b), (2, a + " more"), (None, b), (None, "x y"), (4, ""), (4, ""), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_number", F.lit(1))
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (None, "x y"), (4, ""), (4, ""), (5, None)], key=repr)


def test_mixing_sends_no_exploded_rows_to_the_driver(spark):
    """Blocks and slots of a few long documents looked small enough to broadcast."""
    docs = spark.createDataFrame([(i, "word " * 20_000, "en", f"s{i % 3}", 100_000) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mixing(spark, docs, "")
    assert mixed.agg(F.sum(F.size(F.split("text", " "))).alias("n")).first().n > 0
    mixed.collect()  # adaptive execution has decided by then
    shown = mixed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    found = [x for x in shown if "Join" in x and "block_index" in x]
    assert found and all("SortMergeJoin" in x for x in found)
