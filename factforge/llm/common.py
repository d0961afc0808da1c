"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that a Python task hands on at once; bounds what it holds besides its input batch.
OUT_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a session on one machine gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that this thread has written and not removed yet.
_OWN = threading.local()


def written() -> list[str]:
    """What clean_up() would remove."""
    return list(getattr(_OWN, "folders", []))


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own in the shared folder; clean_up() removes it."""
    _OWN.folders = [*written(), f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"]
    return _OWN.folders[-1]


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _OWN.folders = [f for f in written() if f != folder]


def clean_up(spark: SparkSession, but: list[str] | None = None) -> None:
    """Removes what the operators wrote to the shared folder in this thread, but for some folders. To be called when their results are stored: these are read from there."""
    for folder in written():
        if folder not in (but or []):
            remove(spark, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for intermediate results of one operator, removed at the end of the block."""
    folder = new_folder(spark, "llm")
    try:
        yield folder
    finally:
        remove(spark, folder)


def durable(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a result to the shared folder and reads it back: it is computed once, survives lost executors and cuts the lineage."""
    spark = df.sparkSession
    path = f"{folder or new_folder(spark, 'llm')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of an execution when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Results that are written in the block leave no shuffle files, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sliced(batch: pa.RecordBatch, column: str, most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, of about `most` bytes of the column; a longer single value is a part of its own."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        before = lengths[at - 1] if at else 0
        end = max(at + 1, int(lengths.searchsorted(before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def map_text(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, column: str = "text", most: int = OUT_BYTES) -> DataFrame:
    """mapInArrow over parts of bounded size. work() runs once a task and returns the function of a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part in sliced(batch, column, most):
                out = each(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's values as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names, whatever else the table has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
