"""Quality classifier: histogram gradient-boosted trees over statistics of a whole text.

The trees are fitted on the driver over a bounded sample of labelled rows (``SAMPLE_ROWS``, in the order of a hash
of doc_id), flattened into arrays and walked level by level for all rows and trees of a batch at once. Scores are
inputs of text statistics alone. Null and empty texts have the statistics of an empty text and a score like any
other. Rows repeat as they come. Without labels, or with one label only, every score is the smoothed share of ones.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factforge.llm.common import id_text, map_text, raw

#: Most labelled rows that a fit uses.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.2, 2.0

UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS, SYMBOLS, STOPS = b"0123456789", b"#*$%&|<>@~^_=+\\{}[]", b".?"
FEATURES = ("bytes", "words", "word_bytes", "distinct", "top_word", "echo", "upper", "digits", "symbols", "exclaim", "stops", "commas", "lines", "same_lines", "short", "long", "bar_words", "pairs")


def statistics(text: bytes) -> list[float]:
    """FEATURES of one text; all zero for an empty one."""
    words = text.split()
    if not words:
        return [float(len(text))] + [0.0] * (len(FEATURES) - 1)
    n, size = len(words), len(text)
    count = Counter(words)
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = Counter(map(len, words))
    return [
        float(size), float(n), (size - n) / n, len(count) / n, max(count.values()) / n, sum(map(eq, words, words[1:])) / n,
        share(UPPER), share(DIGITS), share(SYMBOLS), share(b"!"), share(STOPS), share(b","), len(lines) / n,
        1 - len(set(lines)) / len(lines), sum(v for k, v in lengths.items() if k <= 2) / n, sum(v for k, v in lengths.items() if k >= 12) / n,
        count[b"|"] / n, len(set(zip(words, words[1:]))) / n,
    ]


class Trees:
    """Boosted trees as arrays: feature and threshold of each inner node of each full tree, value of each leaf."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape if x.size else (0, len(FEATURES))
        base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
        inner, leaves = 2**DEPTH - 1, 2**DEPTH
        if n == 0 or y.min() == y.max():
            return cls(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        flat = binned + np.arange(d) * BINS
        raw_score, feature, threshold, value = np.full(n, base), [], [], []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw_score))
            grad, hess = p - y, p * (1 - p)
            node, f, t = np.zeros(n, int), np.zeros(inner, int), np.full(inner, np.inf)
            for level in range(DEPTH):
                width = 2**level
                at = (node[:, None] * (d * BINS) + flat).ravel()
                g, h = (np.bincount(at, np.repeat(w, d), width * d * BINS).reshape(width, d, BINS).cumsum(axis=2) for w in (grad, hess))
                all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
                gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE) - all_g**2 / (all_h + RIDGE)
                gain[(h < 1e-3) | (all_h - h < 1e-3)] = -1
                best = gain.reshape(width, -1).argmax(axis=1)
                col, cut = best // BINS, best % BINS
                split = (gain.reshape(width, -1).max(axis=1) > 1e-6) & np.array([c < len(cuts[j]) for j, c in zip(col, cut, strict=True)])
                own = width - 1 + np.arange(width)
                f[own] = np.where(split, col, 0)
                t[own] = [cuts[j][c] if s else np.inf for j, c, s in zip(col, cut, split, strict=True)]
                node = 2 * node + (x[np.arange(n), f[width - 1 + node]] > t[width - 1 + node])
            v = -RATE * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + RIDGE)
            raw_score += v[node]
            feature.append(f)
            threshold.append(t)
            value.append(v)
        return cls(np.array(feature), np.array(threshold), np.array(value), base)

    def score(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees together, a level at a time."""
        trees = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), int)
        for level in range(DEPTH):
            at = 2**level - 1 + node
            node = 2 * node + (np.take_along_axis(x, self.feature[trees, at], axis=1) > self.threshold[trees, at])
        return 1 / (1 + np.exp(-(self.base + self.value[trees, node].sum(axis=1))))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Trees:
    docs = id_text(docs, id_col, text_col)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)  # bounded, so it may be broadcast

    def work():
        return lambda part: pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([statistics(t) for t in raw(part)], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    found = map_text(docs.join(F.broadcast(sample), "doc_id"), work, "doc_id long, label int, x array<double>")
    # Bounded: of rows that repeat a doc_id one reaches the driver.
    rows = found.groupBy("doc_id", "label").agg(F.min_by("x", F.struct(F.xxhash64("x"), "x")).alias("x")).toPandas().sort_values("doc_id", kind="stable")
    return Trees.fit(np.array(rows.x.tolist(), float).reshape(len(rows), len(FEATURES)), (rows.label.to_numpy(int) == 1).astype(float))


def score_quality(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """Every row of docs as the struct `row`, with its score. A text travels once: the row takes it back."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    names = docs.columns
    at = names.index(text_col) if (text_col, "string") in docs.dtypes else -1  # of another type: goes beside what is scored
    rows = docs.select(F.col(text_col).cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if i != at))
    kind = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).schema["row"].dataType.simpleString()

    def work():
        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            score = sent.value.score(np.array([statistics(t) for t in raw(part)], float))
            row = pa.StructArray.from_arrays([part.column("text" if i == at else f"c{i}") for i in range(len(names))], names)
            return pa.RecordBatch.from_arrays([row, pa.array(score, pa.float64())], ["row", "score"])

        return each

    return map_text(rows, work, f"row {kind}, score double")
