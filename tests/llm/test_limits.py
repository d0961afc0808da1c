"""What operators hold of memory and disk on the way."""

import glob
import os
import tracemalloc

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from factforge.llm import bpe, common, mixing, quality, suffix_dedup


def test_encoding_holds_the_words_of_few_texts_at_once(spark, monkeypatch):
    """The words of 8 MB of texts took some 100 MB of objects, which a worker kept (pipeline)."""
    path, seen = public_tokenizers.path("word_bpe_49k.json"), []
    monkeypatch.setattr(bpe, "ship_lexicon", lambda *_: _empty_lexicon(spark))
    monkeypatch.setattr(bpe, "map_text", lambda df, work, schema, most=common.OUT_BYTES: seen.append((work(), most)))
    bpe.bpe_round_trip(spark.createDataFrame([], "doc_id long, text string"), path)
    each, most = seen[0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array(["lorem ipsum dolor sit amet " * 370] * 800)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        rows = sum(each(part).num_rows for part in common.sliced(batch, "text", most))
        assert rows == 800 and tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()


def _empty_lexicon(spark):
    import tempfile

    with tempfile.NamedTemporaryFile(prefix="spark-", suffix=".bin", delete=False) as f:
        f.write(bpe.Transducer.compile({b"a": [1]}))
    spark.sparkContext.addFile(f.name)
    return os.path.basename(f.name)


def test_scoring_sends_a_text_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i == 3 else f"{i} " * 5000, "en") for i in range(20)], "doc_id long, text string, lang string")
    sent = []
    monkeypatch.setattr(quality, "map_text", lambda df, work, schema: sent.append(df) or common.map_text(df, work, schema))
    trees = quality.fit_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert sorted(r.row for r in quality.score_quality(docs, trees).collect()) == sorted(docs.collect())
    assert sent[-1].toArrow().nbytes < 1.5 * docs.toArrow().nbytes
    number = docs.select(F.col("doc_id").alias("text"), "lang")  # a text of another type goes back as it came
    assert sorted(r.row for r in quality.score_quality(number, trees).collect()) == sorted(number.collect())


def test_suffix_passes_leave_no_shuffle_files(spark, sf_dir):
    def there():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data") if os.path.getsize(f)}

    before, setting = there(), spark.conf.get(common.SHUFFLES_GO)
    out = suffix_dedup.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    left = sum(os.path.getsize(f) for f in there() - before)
    assert left < 10_000 and spark.conf.get(common.SHUFFLES_GO) == setting
    assert out.agg(F.sum("n_removed")).first()[0] > 0


def test_slots_of_a_mix_are_never_broadcast(spark, monkeypatch):
    """Exploded rows look as few as those they come from; sent to all tasks they ended the driver (op4_mixing, mixing of the pipeline)."""
    docs = spark.createDataFrame([(i, "word " * 500, f"s{i % 3}") for i in range(60)], "doc_id long, text string, source string")

    def joins(df, key):
        df.collect()  # adaptive execution has decided by then
        return [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in x and key in x]

    found = joins(mixing.mix(docs, block=4)[1], "block_index")
    assert found and all("SortMergeJoin" in x for x in found)
    monkeypatch.setattr(mixing, "SENT_SOURCES", 2)  # each source's row is repeated for every salt
    found = joins(mixing.mix(docs, block=4)[1], "salt")
    assert all("SortMergeJoin" in x for x in found) and found
