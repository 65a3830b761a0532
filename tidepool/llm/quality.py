"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are counted in the tasks. The trees are learned on the
driver from a bounded sample of labelled documents (``sample`` rows, the least by
a hash of doc_id), and flattened into arrays of one number a node, which numpy
walks for all rows and trees at once, level by level. The model is a few thousand
numbers, whatever the input.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import small_batches

SAMPLE, ROUNDS, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 20_000, 100, 4, 64, 0.15, 10, 1.0

_BYTE_CLASSES = ("upper", "lower", "digit", "mark", "shout", "symbol", "space", "newline", "wide")
FEATURES = (
    "log_chars", "log_words", "log_lines", "word_length", *_BYTE_CLASSES, "entropy", "distinct_words", "top_word", "distinct_triples", "repeated_lines", "repeated_chars",
    "line_length", "longest_line", "long_words", "short_words", "plain_words", "digit_words", "shout_words", "ended_lines", "longest_run",
)
_RUN = re.compile(r"(\S)\1{2,}")


def _classes() -> np.ndarray:
    table = np.full(256, 8)
    for c in range(128):
        x = chr(c)
        table[c] = 0 if x.isupper() else 1 if x.islower() else 2 if x.isdigit() else 7 if x == "\n" else 6 if x.isspace() else 3 if x in ".,;:'\"()-" else 4 if x in "!?" else 5
    return table


_CLASS = _classes()


def statistics(text: str) -> list[float]:
    """The features of one text; those of an empty text are zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    data = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    share = np.bincount(_CLASS, weights=data, minlength=9) / data.sum()
    p = data[data > 0] / data.sum()
    words, lines = text.split(), text.split("\n")
    n, m = max(1, len(words)), len(lines)
    counts, line_counts = Counter(words), Counter(lines)
    repeated = {x: k for x, k in line_counts.items() if k > 1}
    sizes = np.array([len(x) for x in words] or [0])
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(m), sizes.mean(), *share, float(-(p * np.log2(p)).sum()),
        len(counts) / n, max(counts.values(), default=0) / n, triples / max(1, len(words) - 2), 1 - len(line_counts) / m, sum(len(x) * k for x, k in repeated.items()) / len(text),
        len(text) / m, np.log1p(max(map(len, lines))), (sizes >= 12).mean(), (sizes <= 2).mean(), sum(map(str.isalpha, words)) / n, sum(any(c.isdigit() for c in x) for x in counts) / len(counts or "x"),
        sum(map(str.isupper, words)) / n, sum(x.rstrip()[-1:] in tuple(".!?") for x in lines) / m, np.log1p(max((m.end() - m.start() for m in _RUN.finditer(text)), default=1)),
    ]


@dataclass
class Trees:
    """Complete trees of one depth, one row a tree: the inner nodes' features and thresholds (left if at most), the leaves' values."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        node, feature, threshold = np.zeros((len(x), trees), np.int64), self.feature.reshape(-1), self.threshold.reshape(-1)
        root, row = np.arange(trees) * inner, np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            at = root + node
            node = 2 * node + 1 + (x[row, feature[at]] > threshold[at])
        leaf = self.value[np.arange(trees), node - inner]
        return 1 / (1 + np.exp(-(self.prior + leaf.sum(1))))


def learn(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees of the logistic loss over histograms of at most ``bins`` quantile bins. Without rows, or with one label only, the prior alone."""
    inner = (1 << depth) - 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return trees
    width = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], 1)
    place = binned + np.arange(width) * bins
    total, features, thresholds, values = np.full(len(y), trees.prior), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            k = 1 << level
            own = node - (k - 1)
            at = (own[:, None] * (width * bins) + place).reshape(-1)
            sums = [np.bincount(at, weights=np.repeat(w, width), minlength=k * width * bins).reshape(k, width, bins).cumsum(2) for w in (g, h, np.ones(len(y)))]
            gain = np.zeros((k, width, bins))
            for side in (lambda s: s, lambda s: s[:, :, -1:] - s):
                gain += side(sums[0]) ** 2 / (side(sums[1]) + RIDGE)
            gain -= sums[0][:, :, -1:] ** 2 / (sums[1][:, :, -1:] + RIDGE)
            gain[(sums[2] < LEAST_ROWS) | (sums[2][:, :, -1:] - sums[2] < LEAST_ROWS)] = 0
            best = gain.reshape(k, -1).argmax(1)
            f, b = best // bins, best % bins
            split = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            at_level = slice(k - 1, 2 * k - 1)
            feature[at_level] = np.where(split, f, 0)
            threshold[at_level] = [cuts[f[i]][b[i]] if split[i] and b[i] < len(cuts[f[i]]) else np.inf for i in range(k)]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + RIDGE)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(trees.prior, np.stack(features), np.stack(thresholds), np.stack(values))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned from; a null id is none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Trees:
    """Trees learned from at most ``sample`` labelled documents that aren't held out.

    Of a document's several labels the rounded mean counts (a tie: 1), of its several texts the least; labels that are null or
    of no document count for nothing.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))

    def count(parts):
        for part in parts:
            x = np.array([statistics(t.as_py()) for t in part.column(1)], float).reshape(-1)
            values = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([part.column(0), values, part.column(2)], ["doc_id", "x", "y"])

    found = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "y").mapInArrow(count, "doc_id string, x array<double>, y int").toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return learn(x, found["y"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the score from 0 to 1 of the whole ``text`` (null: empty) in the column ``to``."""

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        x = np.array([statistics(t or "") for t in texts], float).reshape(-1, len(FEATURES))
        return pd.Series(np.concatenate([trees.score(part) for part in np.array_split(x, max(1, len(x) // 2000))]))

    small_batches(docs.sparkSession)
    return docs.withColumn(to, scores(F.coalesce(F.col(text), F.lit(""))))
