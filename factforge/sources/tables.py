"""Sources and sinks of review data: nested payloads to flat candidate rows and back, inventories, upserts."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = "review_id long, seq long, field string, source string, value double, confidence double"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a session on one machine gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate results need a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that this process has written and not removed yet, and those of this thread's share of rows.
_WRITTEN: list[str] = []
_SHARE = threading.local()


def scratch(spark: SparkSession, what: str) -> str:
    """A folder of its own in the shared folder; clean_up() removes it."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    getattr(_SHARE, "written", []).append(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Writes a state to the shared folder and reads it back: computed once, safe from lost executors, and the plan starts anew."""
    path = scratch(df.sparkSession, "state")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Spark removes the shuffle files of an execution when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def in_shares(rows: DataFrame, key: str, shares: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work() of all rows, one share of them (by a hash of the key) after another: a share's result is written, and what it left on disk, states
    and shuffle files, goes before the next one begins. For work that leaves each key's rows to themselves."""
    spark, out, schema = rows.sparkSession, scratch(rows.sparkSession, "shares"), None
    before, outer = spark.conf.get(SHUFFLES_GO, None), getattr(_SHARE, "written", [])
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        for k in range(shares):
            _SHARE.written = []
            done = work(rows if shares == 1 else rows.where(F.pmod(F.xxhash64(key), F.lit(shares)) == k))
            done.write.mode("append").parquet(out)
            schema = done.schema
            for folder in _SHARE.written:
                remove(spark, folder)
                if folder in _WRITTEN:
                    _WRITTEN.remove(folder)
    finally:
        _SHARE.written = outer
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(schema).parquet(out)


#: Most rows of a table that is sent to every task.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A rule table or dictionary to be sent to every task: its rows are counted first, up to the bound, and beyond it this is an error."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows: this join takes a small rule table or dictionary")
    return F.broadcast(df)


def blocks(values: DataFrame, column: str, size: int = 1_000, most: int = SMALL) -> DataFrame:
    """Distinct values of a dictionary in rows of so many, as the array `block`, each to be held against every row of a table. The values are
    counted first: beyond the bound this is an error, as the dictionary goes to every task."""
    values = values.where(F.col(column).isNotNull()).select(column).distinct()
    n = values.limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} values: this join takes a dictionary of that size")
    block = F.pmod(F.xxhash64(column), F.lit(max(1, -(-n // size))))
    return F.broadcast(values.groupBy(block.alias("b")).agg(F.sort_array(F.collect_set(column)).alias("block")).select("block"))


def clean_up(spark: SparkSession) -> None:
    """Removes the intermediate results of this process. To be called when results are stored: these are read from there."""
    while _WRITTEN:
        remove(spark, _WRITTEN.pop())


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate payloads, one JSON object a line: {candidates: [...]} or a bare candidate; many files."""
    raw = spark.read.schema(f"candidates array<struct<{CANDIDATE.replace(' ', ': ').replace(',:', ',')}>>, {CANDIDATE}").json(path)
    nested = raw.where("candidates is not null").select(F.inline("candidates"))
    return nested.unionByName(raw.where("candidates is null").drop("candidates"))


def write_payloads(candidates: DataFrame, path: str) -> None:
    """One nested payload for each review."""
    c = ["review_id", "seq", "field", "source", "value", "confidence"]
    candidates.groupBy(F.col("review_id").alias("r")).agg(F.collect_list(F.struct(*c)).alias("candidates")).drop("r").write.json(path)


def text_blocks(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of documents with their ordinal."""
    return documents.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


def recognizer_payload(payloads: DataFrame) -> DataFrame:
    """A nested response (map of parameters, array of points) as candidate rows of one schema."""
    maps = payloads.select("review_id", F.explode("parameters").alias("field", "value")).withColumn("label", F.lit(None).cast("string"))
    points = payloads.select("review_id", F.explode("points").alias("p")).select("review_id", F.lit("load_point").alias("field"), F.col("p.height").alias("value"), F.col("p.label").alias("label"))
    return maps.unionByName(points)


def feature_groups(groups: dict[str, DataFrame], markers: DataFrame) -> DataFrame:
    """Several feature tables as one, with marker positions by reference."""
    out = None
    for name, rows in groups.items():
        one = rows.withColumn("feature_type", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.join(markers, ["review_id", "reference"], "left")


def dictionary_report(rows: DataFrame, key: str, positive: list[str]) -> DataFrame:
    """Duplicate keys and non-positive numbers of a dictionary, as rows; an empty result is a good dictionary."""
    repeated = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("duplicate").alias("problem"))
    bad = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*(F.when(~(F.col(c) > 0), F.lit(f"not_positive:{c}")) for c in positive)))).alias("problem"))
    return repeated.unionByName(bad)


def term_import(rows: DataFrame, name: str, order: str, prefix: str = "sfc_") -> DataFrame:
    """Distinct names in first-seen order, with an id from their digest."""
    first = rows.groupBy(F.col(name).alias("name")).agg(F.min(order).alias("first_row"))
    return first.select(F.concat(F.lit(prefix), F.substring(F.sha2("name", 256), 1, 12)).alias("id"), "name", "first_row")


def file_inventory(files: DataFrame, url: str, text_length: F.Column) -> DataFrame:
    """Kind of each file by its extension, and whether it looks scanned: an image, or no text."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)/?$", 1))
    kind = F.when(ext == "pdf", "pdf").when(ext.isin("dwg", "dxf", "step"), "cad").when(ext.isin("png", "jpg", "tif"), "image").otherwise("unknown")
    return files.select("page_id", kind.alias("kind"), ((kind == "image") | (text_length == 0)).alias("scanned"))


REVIEW = "id long, owner string, revision long, value double"


def kept_buckets(spark: SparkSession, folder: str) -> dict[int, str]:
    """The batch that wrote each bucket of a table last, by its index; batches without one were never finished."""
    try:
        index = spark.read.schema("bucket int, batch string, number long").parquet(f"{folder}/index/*")
        return {r.bucket: r.batch for r in index.groupBy("bucket").agg(F.max_by("batch", "number").alias("batch")).collect()}  # a row for each bucket
    except AnalysisException:  # nothing is there yet
        return {}


def saved_reviews(spark: SparkSession, folder: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of a table of reviews, or of some of its buckets."""
    paths = [f"{folder}/rows/{batch}/bucket={b}" for b, batch in sorted(kept_buckets(spark, folder).items()) if buckets is None or b in buckets]
    return spark.read.schema(REVIEW).parquet(*paths) if paths else spark.createDataFrame([], REVIEW)


def save_reviews(changes: DataFrame, folder: str, batch: str, buckets: int = 64) -> DataFrame:
    """Applies a batch of changes (id, seq, owner, expected, value) to a table of reviews and returns id, seq, outcome, revision of each: saved, with
    the new revision; revision_conflict, with the current one, where `expected` is given and isn't it; not_found for another owner's
    review. The changes of one review are taken by seq, each on what the one before it left; a null owner may write any review.

    Only buckets that changes touch are read and written anew, under the batch's name; the index, written last, makes them valid, so a
    batch that broke off left nothing, and one that is sent again is answered as before and changes nothing."""
    spark = changes.sparkSession
    answers = lambda: spark.read.schema("id long, seq long, outcome string, revision long").parquet(f"{folder}/outcomes/{batch}")
    try:
        spark.read.parquet(f"{folder}/index/{batch}")
        return answers()
    except AnalysisException:  # a new batch
        pass
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    touched = sorted(r.bucket for r in changes.select(bucket.alias("bucket")).distinct().collect())  # at most `buckets` rows
    old = saved_reviews(spark, folder, touched)
    todo = changes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "owner", F.col("expected").cast("long").alias("expected"), "value"))).alias("todo"))
    both = old.join(todo, "id", "full")
    done = F.array().cast("array<struct<seq: long, outcome: string, revision: long>>")
    start = F.struct(F.col("owner"), F.coalesce("revision", F.lit(0)).cast("long").alias("revision"), F.col("value"), done.alias("done"))

    def step(s, c):
        foreign = (s["revision"] > 0) & F.coalesce(c["owner"] != s["owner"], F.lit(False))
        stale = F.coalesce((s["revision"] > 0) & (c["expected"] != s["revision"]), F.lit(False))
        ok = ~foreign & ~stale
        outcome = F.when(foreign, "not_found").when(stale, "revision_conflict").otherwise("saved")
        after = s["revision"] + ok.cast("long")
        told = F.struct(c["seq"].alias("seq"), outcome.alias("outcome"), F.when(~foreign, after).alias("revision"))
        return F.struct(F.when(ok & (s["revision"] == 0), c["owner"]).otherwise(s["owner"]).alias("owner"), after.alias("revision"), F.when(ok, c["value"]).otherwise(s["value"]).alias("value"), F.concat(s["done"], F.array(told)).alias("done"))

    now = durable(both.select("id", F.aggregate(F.coalesce("todo", F.array().cast("array<struct<seq: long, owner: string, expected: long, value: double>>")), start, step).alias("s")))
    now.select("id", "s.owner", "s.revision", "s.value", bucket.alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/{batch}")
    outcomes = now.select("id", F.inline("s.done"))
    outcomes.write.mode("overwrite").parquet(f"{folder}/outcomes/{batch}")
    number = spark.read.schema("number long").parquet(f"{folder}/index/*").agg(F.max("number")).first()[0] + 1 if kept_buckets(spark, folder) else 0
    spark.createDataFrame([(b, batch, number) for b in touched], "bucket int, batch string, number long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index/{batch}")
    return answers()


def review_json(candidates: DataFrame) -> DataFrame:
    """One nested document for each review."""
    rows = candidates.groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("seq", "field", "value"))).alias("candidates"))
    return rows.select("review_id", F.to_json(F.struct("review_id", "candidates")).alias("document"))
