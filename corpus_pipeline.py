"""A training corpus from documents: quality, line dedup, near dedup, mixing, encoding. Counted as part of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factforge.llm.bpe import bpe_round_trip
from factforge.llm.common import clean_up, durable, new_folder, table, written
from factforge.llm.line_dedup import drop_repeated_lines
from factforge.llm.mixing import mix_documents
from factforge.llm.near_dedup import near_duplicates
from factforge.llm.quality import fit_quality, score_quality
from factforge.llm.queries import WORD_BPE, tokenizer

#: Documents that score less are rejected.
QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the classifier scores below QUALITY."""
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= QUALITY).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least five documents share; n_chars follows, a null text stays null. Every row stays."""
    out = drop_repeated_lines(docs, keep_row=True)
    text = F.when(F.col("row.text").isNotNull(), F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest doc_id, a null one last. Rows that repeat a doc_id are
    rows like all others: equal ones are one group. Rows without words are in no group."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    rows = durable(docs.withColumn(name, F.monotonically_increasing_id()))  # written, so that a row keeps its number
    ids = near_duplicates(rows, id_col=name, words=5, percent=80).select(F.col("doc_id").alias(name), "component_id")
    order = F.struct(F.col("own").isNull().alias("none"), "own", name)
    first = ids.join(rows.select(name, F.col("doc_id").alias("own")), name).groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col(f"first.{name}").alias(name)), name, "left_semi").drop(name)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: words taken once, and again in a second row of the document."""
    mixed = mix_documents(docs)
    return mixed.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in mixed.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256 of every row of the mix."""
    out = bpe_round_trip(docs, tokenizer(WORD_BPE))
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express the classifier, the mix or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written to the shared folder and read by the next one."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clean_up(spark, [*before, path])  # what the stage wrote on the way, and the one before it
    return STAGES[-1][1](spark, docs, sf_dir)
