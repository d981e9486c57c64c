"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays.

Trees of fixed depth are grown on histograms with second-order logistic loss.
Monotonic features bound the values below a split at the middle of its two
sides.  The trees lie in three numpy arrays (feature, threshold, value), node i
having children 2i + 1 and 2i + 2, so a whole batch walks one level at a time.

The model is fitted on the labelled documents with the TRAIN_ROWS smallest
hashes of doc_id (a bounded sample); scoring covers every document.

Defined results: null and empty texts have counts 0 and fail the base rule;
null labels are not used; doc_ids whose labels disagree are not used; with no
labels or one class, the verdict is that class or else keep; repeated doc_ids
and further columns are fine, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, need
from .stats import COUNTS, MONOTONE, features, text_counts

TRAIN_ROWS, TREES, DEPTH, RATE, BINS, L2, LEAST_HESSIAN = 4000, 60, 3, 0.2, 64, 1.0, 2.0


class Trees:
    """feature, threshold and value: one row a tree; feature -1 marks a leaf's place."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value
        self.depth = int(np.log2(value.shape[1] + 1)) - 1 if len(value) else 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = f[node]
                node = np.where(at < 0, 2 * node + 1, 2 * node + 1 + (x[rows, np.maximum(at, 0)] > t[node]))
            out += v[node]
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boosted trees for y in 0, 1; a feature with monotone sign s never moves the margin against s."""
    if len(y) == 0 or y.min() == y.max():
        return Trees(20.0 if len(y) == 0 or y[0] else -20.0, *(np.zeros((0, 1)) for _ in range(3)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])
    nodes = 2 ** (depth + 1) - 1
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin, made = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        members, bounds = {0: np.arange(len(y))}, {0: (-np.inf, np.inf)}
        for node in range(nodes):
            rows, (low, high) = members.pop(node, np.zeros(0, int)), bounds.pop(node, (-np.inf, np.inf))
            own = np.clip(g[rows].sum() / (h[rows].sum() + L2), low, high)
            value[node], best = own, None
            if node < nodes // 2 and len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, c in enumerate(cuts):
                    left_g = np.bincount(binned[rows, j], g[rows], len(c) + 1).cumsum()[:-1]
                    left_h = np.bincount(binned[rows, j], h[rows], len(c) + 1).cumsum()[:-1]
                    right_g, right_h = gs - left_g, hs - left_h
                    a, b = np.clip(left_g / (left_h + L2), low, high), np.clip(right_g / (right_h + L2), low, high)
                    gain = left_g * a - (left_h + L2) * a * a / 2 + right_g * b - (right_h + L2) * b * b / 2
                    gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN) | (monotone[j] * (b - a) < 0)] = -np.inf
                    if len(gain) and (k := int(gain.argmax())) >= 0 and gain[k] > (best[0] if best else gs * own - (hs + L2) * own * own / 2 + 1e-6):
                        best = (gain[k], j, k, a[k], b[k])
            kids = (2 * node + 1, 2 * node + 2)
            if best:
                _, j, k, a, b = best
                feature[node], threshold[node] = j, cuts[j][k]
                right = binned[rows, j] > k
                members |= {kids[0]: rows[~right], kids[1]: rows[right]}
                mid = (a + b) / 2
                bounds |= {kids[0]: (low, high), kids[1]: (low, high)}
                if monotone[j]:
                    up = monotone[j] > 0
                    bounds |= {kids[0]: (low, min(high, mid)) if up else (max(low, mid), high), kids[1]: (max(low, mid), high) if up else (low, min(high, mid))}
            elif node < nodes // 2:  # the value goes down to the leaf level on the left
                members[kids[0]], bounds[kids[0]] = rows, (own, own)
        value *= rate
        made.append((feature, threshold, value))
        margin = margin + Trees(0.0, *(np.array([m]) for m in made[-1])).margin(x)
    return Trees(base, *(np.array(m) for m in zip(*made)))


def labelled_counts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of a bounded sample of labelled documents."""
    need(labels, "doc_id", "quality")
    agreed = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_r")).where("_q = _r")
    chosen = agreed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").cast("long").alias("_id"), "_q")
    got = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "quality": b.column("_q").cast(pa.int32()), **text_counts(b.column("text"))})

    found = got.mapInArrow(lean(count), "doc_id long, quality int, " + ", ".join(f"{c} long" for c in COUNTS)).toPandas()
    found = found.sort_values(list(found.columns)).drop_duplicates("doc_id")
    return features({c: found[c].to_numpy() for c in COUNTS}), found["quality"].to_numpy().astype(float)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    need(docs, "doc_id", "text")
    x, y = labelled_counts(docs, labels, rows)
    model = fit(x, y, MONOTONE)
    least = float(np.log(threshold / (1 - threshold)))
    names = COUNTS[:5]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = text_counts(b.column("text"))
            margin = model.margin(features(c))
            failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **{n: c[n] for n in names}, "base_failed": failed, "score": 1 / (1 + np.exp(-margin)), "kept": ~failed & (margin >= least)})

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, score double, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(score), schema)
