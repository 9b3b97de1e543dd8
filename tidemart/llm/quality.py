"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

Statistics are computed on whole texts, in Arrow batches. Training takes the labelled rows it is
given; above TRAIN_ROWS a hash of the id picks about so many (the documented bound), and only their
statistics reach the driver. The trees are complete binary trees flattened into arrays, walked by
numpy for a whole batch at once. Scoring moves no row.

Defined cases: a null text is empty; an empty text has all statistics zero and a score. Labels of
null are left out; repeated labels of a document all count. Without labelled rows every score is
0.5. A null doc_id is never a labelled row and is not held out. An empty table gives an empty
result. The score never reads doc_id, lang, source or labels.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemart.llm.common import as_bytes, free_name, small_batches

TRAIN_ROWS = 20_000
ROUNDS, DEPTH, BINS, RATE, L2, LEAST_HESSIAN = 80, 4, 64, 0.15, 1.0, 2.0
#: A document is kept from this score on.
ACCEPT = 0.7

FEATURES = ("log_words", "word_chars", "longest_word", "distinct_words", "top_word",
            "distinct_triples", "words_a_line", "distinct_lines", "lower", "upper", "digits",
            "symbols", "exclamations", "sentence_ends", "other_ascii", "beyond_ascii", "pipes",
            "lines_upper")

_UPPER = np.arange(65, 91)
_GROUPS = np.zeros((256, 9))
_GROUPS[97:123, 0] = 1
_GROUPS[_UPPER, 1] = 1
_GROUPS[48:58, 2] = 1
_GROUPS[list(b"#*$%&<>@^~=+\\/{}[]_"), 3] = 1
_GROUPS[33, 4] = 1
_GROUPS[list(b".,;:?"), 5] = 1
_GROUPS[list(b"\"'()-`"), 6] = 1
_GROUPS[128:, 7] = 1
_GROUPS[124, 8] = 1


def statistics(text: bytes | None) -> list[float]:
    words = (text or b"").split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    sizes = list(map(len, words))
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 1
    lines = [line for line in text.split(b"\n") if line.strip()]
    chars = sum(sizes)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _GROUPS / chars
    return [np.log1p(n), chars / n, max(sizes), len(counts) / n,
            max(counts.values()) / n if n > 10 else 0.0, triples / max(1, n - 2), n / len(lines),
            len(set(lines)) / len(lines), *shares.tolist(),
            sum(line.isupper() for line in lines) / len(lines)]


def features(text: Column) -> Column:
    """The statistics of a text as an array of doubles."""
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t) for t in as_bytes(texts)], pa.list_(pa.float64()))
    return of(text)


@dataclass
class Trees:
    """Complete binary trees of one depth; node k has the children 2k + 1 and 2k + 2."""
    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Boosted trees for the logistic loss, split on histograms of quantile bins."""
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    rate = (y.sum() + 1) / (len(y) + 2)
    out = Trees(float(np.log(rate / (1 - rate))), np.zeros((rounds, inner), np.int64),
                np.full((rounds, inner), np.inf), np.zeros((rounds, leaves)))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    n_features = x.shape[1]
    total = np.full(len(y), out.base)
    flat = bins + np.arange(n_features) * BINS
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            width, first = 2 ** depth, 2 ** depth - 1
            at = ((node - first)[:, None] * (n_features * BINS) + flat).ravel()
            shape = (width, n_features, BINS)
            size = width * n_features * BINS
            g = np.bincount(at, np.repeat(gradient, n_features), size).reshape(shape)
            h = np.bincount(at, np.repeat(hessian, n_features), size).reshape(shape)
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga ** 2 / (ha + L2)
            gain[(hl < LEAST_HESSIAN) | (ha - hl < LEAST_HESSIAN)] = 0
            for f, e in enumerate(edges):
                gain[:, f, len(e):] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9:
                    out.feature[t, first + k] = f
                    out.threshold[t, first + k] = edges[f][b]
            split = out.feature[t][node]
            node = 2 * node + 1 + (x[np.arange(len(y)), split] > out.threshold[t][node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, hessian, leaves)
        out.value[t] = RATE * g / (h + L2)
        total += out.value[t][leaf]
    return out


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Trees for `labels.quality`, from at most `most` documents that aren't held out. Of rows that
    share a doc_id one is learnt from: the least statistics, with the highest label."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()
                          & ~held_out(F.col("doc_id")))
    n = known.count()
    scale = 1 << 30
    picked = known.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(scale))
                          < min(scale, most * scale // max(n, 1)))
    # statistics first: what is joined is a few numbers per document, not its text
    measured = docs.select("doc_id", features(F.col("text")).alias("x"))
    named = picked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = (measured.join(named, "doc_id").groupBy("doc_id")
            .agg(F.max("quality").alias("quality"), F.min("x").alias("x"))
            .orderBy(F.xxhash64(F.lit("train"), "doc_id"), "doc_id").limit(most)
            .toPandas().sort_values("doc_id"))
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return train(x, (rows["quality"].to_numpy() > 0).astype(float))


def score(text: Column, trees: Trees) -> Column:
    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        rows = [statistics(t) for t in as_bytes(texts)]
        return pa.array(trees.score(np.array(rows, float).reshape(len(rows), len(FEATURES))))
    return of(text)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    trees = fit(docs, labels)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        score(F.col("text"), trees).alias("score"))
            .withColumn("predicted", (F.col("score") >= ACCEPT).cast("int")))


def accepted(docs: DataFrame, labels: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The documents that the classifier keeps, with their columns."""
    name = free_name(docs.columns, "quality_score")
    scored = docs.withColumn(name, score(F.col("text"), fit(docs, labels)))
    return scored.filter(F.col(name) >= least).select(*docs.columns)
