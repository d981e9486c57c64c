"""Quality classifier by co-training a text view and a metadata view.

The text view sees document statistics and hashed trigrams of character
classes; the metadata view sees source, lang and n_chars.  Both are logistic
regressions.  In each round every view names the unlabelled documents it is
surest of, and these join the other view's training rows under the labels it
gave.  At the end each view is calibrated (Platt scaling) on labelled rows
kept apart, a logistic regression of the two calibrated log-odds, on other
labelled rows kept apart, combines them, and every document is scored; those
below the threshold are rejected.

The labelled rows for fitting are a bounded sample, the LABELLED documents with
the smallest hashes of doc_id.  The unlabelled side is no sample: views are
made once and kept, each round scores every document without a label, and the
PER_ROUND surest are found among all; ties go by hash of doc_id.

Defined results: null and empty texts have an empty text view; null metadata
is a value of its own; null or conflicting labels are not used; with labels
of one class or none all documents are kept; repeated doc_ids are scored each;
columns of the input are kept and clash with nothing; rows with a null doc_id
are scored but name no pseudo-label.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, need, staged, text_chunks
from .stats import FEATURES, features, text_counts

LABELLED, ROUNDS, SURE, PER_ROUND, THRESHOLD = 4000, 4, 0.97, 200, 0.5
BINS, SOURCES, LANGS, SIZES = 1024, 256, 64, 24
_U = np.uint64

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 1


def text_view(column: pa.Array) -> np.ndarray:
    """One row a text: statistics, then shares of hashed class trigrams."""
    tall = features(text_counts(column)).astype(np.float32)
    grams = []
    for a, z, data, offsets in text_chunks(column, 1 << 20):
        n, c = len(data), _CLASS[data]
        if n < 3:
            grams.append(np.zeros((z - a, BINS), np.float32))
            continue
        key = ((c[:-2] * _U(257) + c[1:-1]) * _U(257) + c[2:]) * _U(0x9E3779B97F4A7C15) >> _U(54)
        owner = np.repeat(np.arange(z - a), np.diff(offsets))
        inside = owner[:-2] == owner[2:]
        counts = np.bincount(owner[:-2][inside] * BINS + key[inside].astype(np.int64), minlength=(z - a) * BINS).reshape(z - a, BINS)
        grams.append((counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32))
    return np.hstack([tall, np.vstack(grams) if grams else np.zeros((0, BINS), np.float32)])


def metadata_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One row a document: hashed source and lang, and the binary size class of n_chars."""
    out = np.zeros((len(source), SOURCES + LANGS + SIZES), np.float32)
    for i, (s, l, n) in enumerate(zip(source, lang, n_chars)):
        out[i, zlib.crc32(s.encode()) % (SOURCES - 1) + 1 if s is not None else 0] = 1
        out[i, SOURCES + (zlib.crc32(l.encode()) % (LANGS - 1) + 1 if l is not None else 0)] = 1
        out[i, SOURCES + LANGS + (min(SIZES - 1, int(max(n, 0)).bit_length() + 1) if n is not None else 0)] = 1
    return out


class Logistic:
    """Logistic regression on standardised columns, fitted by Adam with an L2 penalty; every row has a weight."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 2e-3, steps: int = 250, rate: float = 0.05, scale: bool = True):
        self.mean = x.mean(axis=0) if scale else np.zeros(x.shape[1], x.dtype)
        self.scale = 1 / (x.std(axis=0) + 1e-3 * (1 + np.abs(self.mean))) if scale else np.ones(x.shape[1], x.dtype)
        z = np.clip((x - self.mean) * self.scale, -6, 6)
        share = (np.ones(len(y)) if weight is None else weight) / len(y)
        w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):
            r = share * (1 / (1 + np.exp(-np.clip(z @ w.astype(z.dtype) + b, -30, 30))) - y)
            g = np.append(z.T @ r.astype(z.dtype) + penalty * w, r.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
            w, b = w - step[:-1], b - step[-1]
        self.w, self.b = w.astype(np.float32), b

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -6, 6) @ self.w + self.b


class CoTrained:
    def __init__(self, text: Logistic, meta: Logistic, platt_text: Logistic, platt_meta: Logistic, joint: Logistic):
        self.text, self.meta, self.platt_text, self.platt_meta, self.joint = text, meta, platt_text, platt_meta, joint

    def views(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        """The calibrated log-odds of both views."""
        return np.column_stack([self.platt_text.margin(self.text.margin(xt)[:, None]), self.platt_meta.margin(self.meta.margin(xm)[:, None])])

    def margin(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        return self.joint.margin(self.views(xt, xm))


#: The surest documents of each view under its model, but for those named before: (doc_ids, text views, metadata views, labels).
Surest = Callable[[dict[str, Logistic], dict[str, set[int]]], dict[str, tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]]


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, surest: Surest, rounds: int = ROUNDS) -> CoTrained | None:
    """y: 0 or 1 for the labelled rows; every eighth only calibrates the views, every eighth only weighs them (where one of these lacks a class, both serve both ends); None with a class missing."""
    kept = np.arange(len(y)) % 4 == 0
    if min((y[kept] == 1).sum(), (y[kept] == 0).sum(), (y[~kept] == 1).sum(), (y[~kept] == 0).sum()) < 2:
        return None
    views = {"text": xt, "meta": xm}
    given = {k: (x[:0], np.zeros(0)) for k, x in views.items()}  # rows and labels from the other view
    named: dict[str, set[int]] = {k: set() for k in views}

    def fitted(k: str) -> Logistic:
        rows, labels = given[k]
        return Logistic(np.vstack([views[k][~kept], rows]), np.append(y[~kept], labels), np.append(np.ones((~kept).sum()), np.full(len(rows), 0.5)))

    models = {k: fitted(k) for k in views}
    for _ in range(rounds):
        found = surest(models, named)
        for k, other in (("text", "meta"), ("meta", "text")):
            ids, t, m, labels = found[k]
            named[k] |= set(ids)
            given[other] = np.vstack([given[other][0], m if other == "meta" else t]), np.append(given[other][1], labels)
        if not any(len(found[k][0]) for k in views):
            break
        models = {k: fitted(k) for k in views}
    own = kept & (np.arange(len(y)) % 8 == 0)
    ends = (own, kept & ~own)
    if min(np.bincount(y[e].astype(int), minlength=2).min() for e in ends) < 2:
        ends = (kept, kept)
    platt = {k: Logistic(models[k].margin(views[k][ends[0]])[:, None].astype(np.float32), y[ends[0]], penalty=1e-4) for k in views}
    both = np.column_stack([platt[k].margin(models[k].margin(views[k][ends[1]])[:, None]) for k in views])
    return CoTrained(models["text"], models["meta"], platt["text"], platt["meta"], Logistic(both.astype(np.float32), y[ends[1]], penalty=1e-4))


_NEEDED = ("doc_id", "text", "source", "lang", "n_chars")
_NT, _NM = len(FEATURES) + BINS, SOURCES + LANGS + SIZES


def _views(docs: DataFrame) -> DataFrame:
    """_id, t, m: both views of every document that has a doc_id, as bytes."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = text_view(b.column("text"))
            m = metadata_view(*(b.column(c).to_pylist() for c in _NEEDED[2:]))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([r.tobytes() for r in t], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], ["_id", "t", "m"])

    some = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), *_NEEDED[1:])
    return staged(some.mapInArrow(lean(see), "_id long, t binary, m binary"), "views")


def _dense(column: list[bytes] | pa.Array, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column if isinstance(column, list) else column.to_pylist()), np.float32).reshape(-1, n)


def _sample(views: DataFrame, labels: DataFrame, labelled: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Views and labels of the labelled rows."""
    agreed = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q"), F.max("quality").alias("_r")).where("_q = _r").drop("_r")
    chosen = agreed.orderBy(F.xxhash64("_id"), "_id").limit(labelled)
    rows = views.join(F.broadcast(chosen.withColumn("_q", F.col("_q").cast("int"))), "_id").toArrow().sort_by("_id").to_pylist()
    rows = list({r["_id"]: r for r in rows}.values())
    rows.sort(key=lambda r: zlib.crc32(str(r["_id"]).encode()))
    return _dense([r["t"] for r in rows], _NT), _dense([r["m"] for r in rows], _NM), np.array([float(r["_q"]) for r in rows])


def _surest(views: DataFrame, labels: DataFrame) -> Surest:
    """Over all documents without a label; repeated doc_ids count once, by their surest row."""
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id")).distinct()

    def find(models: dict[str, Logistic], named: dict[str, set[int]]) -> dict:
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = [1 / (1 + np.exp(-np.clip(models[k].margin(_dense(b.column(c), n)).astype(float), -30, 30))) for k, c, n in (("text", "t", _NT), ("meta", "m", _NM))]
                yield pa.RecordBatch.from_arrays([b.column("_id"), *(pa.array(x, pa.float64()) for x in p)], ["_id", "text", "meta"])

        sure = lambda k: F.greatest(F.col(k), 1 - F.col(k))
        scored = views.mapInArrow(lean(score), "_id long, text double, meta double").where((sure("text") >= SURE) | (sure("meta") >= SURE))
        best = [F.max_by(k, F.struct(sure(k), k)).alias(k) for k in models]
        scored = staged(scored.join(known, "_id", "left_anti").groupBy("_id").agg(*best), "scored")
        spark = views.sparkSession
        picked = {}
        for k in models:
            free = scored.where(sure(k) >= SURE).join(F.broadcast(spark.createDataFrame([(x,) for x in named[k]], "_id long")), "_id", "left_anti")
            picked[k] = {r["_id"]: r[k] for r in free.orderBy(sure(k).desc(), F.xxhash64("_id"), "_id").limit(PER_ROUND).select("_id", k).collect()}
        discard(scored)
        ids = sorted(set().union(*picked.values()))
        rows = views.join(F.broadcast(spark.createDataFrame([(x,) for x in ids], "_id long")), "_id").toArrow().to_pylist() if ids else []
        t, m = _dense([r["t"] for r in rows], _NT), _dense([r["m"] for r in rows], _NM)
        out = {}
        for k, x in (("text", t), ("meta", m)):
            odds = np.abs(models[k].margin(x)) if len(rows) else np.zeros(0)
            at: dict[int, int] = {}
            for i, r in enumerate(rows):
                if r["_id"] in picked[k] and (r["_id"] not in at or odds[i] > odds[at[r["_id"]]]):
                    at[r["_id"]] = i
            mine = list(picked[k])
            place = [at[x] for x in mine]
            out[k] = mine, t[place], m[place], np.array([float(picked[k][x] > 0.5) for x in mine])
        return out

    return find


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that the classifier rejects; columns under the names of its scores are docs' own."""
    own = {c: f"_own_{c}" for c in docs.columns if c.startswith("quality_")}
    kept = classify(docs.withColumnsRenamed(own), labels).where("quality_kept")
    return kept.select(*(F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, labelled: int = LABELLED, passed: list[str] | None = None) -> DataFrame:
    """docs (or its columns in passed) with quality_text, quality_meta, quality_score (probabilities) and quality_kept."""
    need(docs, *_NEEDED)
    need(labels, "doc_id", "quality")
    views = _views(docs)
    model = co_train(*_sample(views, labels, labelled), _surest(views, labels))
    discard(views)
    least = float(np.log(threshold / (1 - threshold)))
    made = ["quality_text", "quality_meta", "quality_score", "quality_kept"]
    passed = [c for c in passed or docs.columns if c not in made]
    docs = docs.select(*dict.fromkeys([*passed, *_NEEDED]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if model is None:
                odds, total = np.zeros((n, 2)), np.full(n, 20.0)
            else:
                parts = []
                for a in range(0, n, 2000):
                    c = b.slice(a, 2000)
                    parts.append(model.views(text_view(c.column("text")), metadata_view(*(c.column(k).to_pylist() for k in _NEEDED[2:]))))
                odds = np.vstack(parts) if parts else np.zeros((0, 2))
                total = model.joint.margin(odds)
            p = lambda m: pa.array(1 / (1 + np.exp(-np.clip(m, -30, 30).astype(float))), pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), p(odds[:, 0]), p(odds[:, 1]), p(total), pa.array(total >= least)], [*passed, *made])

    schema = T.StructType([*(docs.schema[c] for c in passed), *(T.StructField(c, T.DoubleType()) for c in made[:3]), T.StructField(made[3], T.BooleanType())])
    return docs.mapInArrow(lean(score), schema)
