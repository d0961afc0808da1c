"""Quality rules with cross-document line frequency.

Statistics of each whole text come with the hashes of its distinct normalised lines and their words. A line's frequency is
the number of distinct documents of its host that hold it, copies of a text counted each. Lines in more than ``LIMIT`` of a
host's documents, and in more than ``LEAST`` of them (two documents of a host of ten would be more than any share), count as
removed; a document that keeps less than ``REMAINS`` of its words is depleted and rejected.

Null and empty texts have no words and fail the base rule. A null host is a host of its own. Repeated rows are documents of
their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.llm.common import durable, map_text, raw

LIMIT, LEAST, REMAINS = 0.02, 5, 0.3
SYMBOLS = b"#*$%&|<>"


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more, the first time included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    _, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)  # numbered anew, so three fit in 64 bits
    _, window, count = np.unique(pair[:-1] * v + ids[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(n + 2, np.int8)
    many = count[window] > 1
    for i in range(3):
        hit[i : i + n - 2] |= many
    return int(hit.sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; hash and words of each distinct normalised line with a word."""
    words = text.split()
    chars = len(b"".join(words)) if text.isascii() else len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup, sizes = set(), 0, {}
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            key = xxhash.xxh3_64_intdigest(b" ".join(own).lower()) - (1 << 63)
            sizes[key] = sizes.get(key, 0) + len(own)
    return len(words), chars, symbols, dup, repeat_words(words), list(sizes), list(sizes.values())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = LIMIT, least: int = LEAST, remains: float = REMAINS) -> DataFrame:
    """doc_id, the base counts, base_failed, n_removed_words (in lines above the limits) and kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def work():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            found = list(zip(*map(statistics, raw(part)), strict=True))
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "host")), *(pa.array(x, pa.int64()) for x in found[:5]), *(pa.array(x, pa.list_(pa.int64())) for x in found[5:])], ["doc_id", "host", *names, "hashes", "sizes"])

        return each

    stats = durable(map_text(docs, work, "doc_id long, host string, " + ", ".join(f"{x} long" for x in names) + ", hashes array<long>, sizes array<long>"))
    stats = stats.withColumn("row", F.monotonically_increasing_id())  # written, so that a row keeps its number
    hosts = stats.groupBy("host").agg(F.count("*").alias("docs")).select(F.col("host").alias("h"), F.greatest(F.lit(float(least)), F.col("docs") * limit).alias("most"))
    lines = stats.select("host", "row", F.explode(F.arrays_zip("hashes", "sizes")).alias("line")).select("host", "row", F.col("line.hashes").alias("hash"), F.col("line.sizes").alias("words"))
    common = lines.groupBy("host", "hash").agg(F.count("*").alias("n")).join(hosts, F.col("host").eqNullSafe(F.col("h"))).where("n > most").select("h", F.col("hash").alias("common"))
    removed = lines.join(common, F.col("host").eqNullSafe(F.col("h")) & (F.col("hash") == F.col("common"))).groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    out = stats.join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("n_removed_words") < F.lit(remains) * F.col("n_words")
    return out.select("doc_id", *names, failed.alias("base_failed"), "n_removed_words", (~failed & ~depleted).alias("kept"))
