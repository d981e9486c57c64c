"""Near-duplicate embeddings from randomised-rotation binary codes.

A unit vector o is rotated by random orthogonal matrices and coded by the
signs of its coordinates; with the code of each rotation goes the stored factor
<code, o>.  For another vector q, <code, q> / <code, o> estimates <o, q> without
bias; the mean over the rotations does too, and its spread gives a confidence
bound.  Codes, factors and q's coordinates in 8 bits (whose own error is
bounded) are written once and are all that moves.  Pairs whose bounds lie below
the threshold are dropped; the vectors of the others are fetched, and these
pairs are recomputed in double precision.

Vectors meet in buckets: each of TABLES groups of code bits is a bucket key,
with about BUCKET vectors a bucket.  A pair counts in the first table that it
shares, so it counts once.  Buckets above BLOCK vectors are cut into blocks,
and each pair of blocks is a group of its own, so no group is larger than two
blocks and no pair in a bucket is left out.  A group yields at most two rows
for each of its vectors: the links counted and its root in the group.

Two vectors at the cosine of 0.9 agree in a bit with probability 0.856; the
number of tables makes the chance that they share none MISS or less.

Equal vectors are one class with a count.

Defined results: vectors that are null, empty or zero, or hold null or
non-finite components, have no links; vectors of different lengths do not
link; repeated vec_ids are vectors each; rows with a null vec_id take part, and
their component_id is the smallest vec_id reached, or null and kept if there is
none; a cosine of exactly the threshold links; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, need, staged
from .components import components, forest

THRESHOLD, BUCKET, BLOCK, MISS, SURE, SEED = 0.9, 256, 2048, 1e-4, 4.5, 555


def plan_bits(n: int, threshold: float = THRESHOLD, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """Bits of a bucket key and the number of tables for n vectors."""
    bits = max(4, min(30, int(math.log2(max(n, bucket) / bucket))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


class Coder:
    """Sign codes of unit vectors under enough rotations for tables * bits signs."""

    def __init__(self, size: int, bits: int, tables: int, seed: int = SEED):
        self.bits, self.tables = bits, tables
        rng = np.random.default_rng([seed, size])
        turns = -(-bits * tables // size)
        self.turns = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(turns)]

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return np.hstack([unit @ t for t in self.turns]) >= 0

    def buckets(self, signs: np.ndarray) -> np.ndarray:
        """One key a table."""
        cut = signs[:, : self.bits * self.tables].reshape(len(signs), self.tables, self.bits)
        return cut.astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))


_coders: dict[tuple[int, int, int], Coder] = {}


def _coder(size: int, bits: int, tables: int) -> Coder:
    return _coders.get((size, bits, tables)) or _coders.setdefault((size, bits, tables), Coder(size, bits, tables))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; the scaling first keeps squares of extreme components finite."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _keys(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id and, for usable vectors, the node (a hash of its bytes) and its bytes, of the kind of number that the column has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, data = [], []
            for v in b.column("embedding"):
                x = np.array([] if v.as_py() is None or None in v.as_py() else v.as_py(), kind) + np.zeros(1, kind)
                good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
                raw = x.tobytes() if good else None
                data.append(raw)
                node.append(int.from_bytes(hashlib.md5(raw).digest()[:8], "little", signed=True) if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(node, pa.int64()), pa.array(data, pa.binary())], ["vec_id", "node", "data"])

    element = "float" if kind == "f4" else "double"
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{element}>")).mapInArrow(lean(run), "vec_id long, node long, data binary")


_CODED = "size int, code binary, factors binary, scale float, small binary"


def _coded(classes: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """node, mult and the code of each class: the signs under every rotation, a factor for each rotation, coordinates in 8 bits and their scale; and the bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        for b in batches:
            sizes = np.array([len(x) // width for x in b.column("data").to_pylist()], np.int32)
            for size in np.unique(sizes).tolist():
                g = b.take(pa.array(np.flatnonzero(sizes == size)))
                coder = _coder(size, bits, tables)
                unit = _unit(np.frombuffer(b"".join(g.column("data").to_pylist()), kind).reshape(-1, size).astype(float))
                signs = coder.signs(unit)
                turned = np.stack([np.abs(unit @ t).sum(axis=1) for t in coder.turns], axis=1) / math.sqrt(size)
                scale = np.abs(unit).max(axis=1, keepdims=True) / 127
                rows = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                columns = [pa.array(np.full(len(unit), size, np.int32)), rows(np.packbits(signs, axis=1)), rows(turned.astype(np.float32)), pa.array(scale[:, 0].astype(np.float32)), rows(np.rint(unit / scale).astype(np.int8))]
                keys = coder.buckets(signs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([g.column("node"), g.column("mult"), *columns, lists], ["node", "mult", "size", "code", "factors", "scale", "small", "buckets"])

    return classes.select("node", "mult", "data").mapInArrow(lean(run), f"node long, mult long, {_CODED}, buckets array<long>")


_GROUP = ["size", "t", "bucket", "i", "j"]


def _signs(f: pd.DataFrame, turns: int, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(f["code"]), np.uint8).reshape(len(f), -1), axis=1, count=turns * size).astype(bool)


def _new_pairs(x: np.ndarray, y: np.ndarray, block: np.ndarray, i: int, j: int, keys: np.ndarray, t: int) -> np.ndarray:
    """Whether pairs belong to this pair of blocks, once, and share no earlier table."""
    keep = x < y if i == j else (block[x] == i) & (block[y] == j)
    if t:
        keep[keep] = ~(keys[x[keep], :t] == keys[y[keep], :t]).any(axis=1)
    return keep


def _group_open(bits: int, tables: int, threshold: float):
    """The members of a group that have a pair which the bounds leave open."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        size, t, i, j = key[0], key[1], key[3], key[4]
        f = f.sort_values("node")
        block = f["block"].to_numpy()
        coder = _coder(size, bits, tables)
        turns = len(coder.turns)
        signs = _signs(f, turns, size)
        keys = coder.buckets(signs)
        factors = np.frombuffer(b"".join(f["factors"]), np.float32).reshape(len(f), turns)
        scale = f["scale"].to_numpy()
        near = np.frombuffer(b"".join(f["small"]), np.int8).reshape(len(f), size) * scale[:, None]
        slip = scale * np.float32(math.sqrt(size) / 2) + np.float32(1e-6)  # the length of what 8 bits leave out, at most
        turned = np.hstack([near @ m.astype(np.float32) for m in coder.turns])
        code = np.where(signs, 1, -1).astype(np.float32) / np.repeat(factors * np.float32(math.sqrt(size) * turns), size, axis=1)
        spread = np.sqrt((np.maximum(1 - factors**2, 0) / factors**2).sum(axis=1) / max(size - 1, 1)) / turns
        bound = SURE * spread + 1e-4
        far = (1 / factors).mean(axis=1)
        found = np.zeros(len(f), bool)
        for a in range(0, len(f), 512):
            s = slice(a, a + 512)
            estimate = code[s] @ turned.T + bound[s, None] + far[s, None] * slip
            x, y = np.nonzero(estimate >= threshold)
            x = x + a
            keep = _new_pairs(x, y, block, i, j, keys, t)
            x, y = x[keep], y[keep]
            for k in range(0, len(x), 1 << 16):
                p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                still = np.einsum("ij,ij->i", near[p], near[q]) + slip[p] + slip[q] + slip[p] * slip[q] >= threshold
                found[p[still]] = found[q[still]] = True
        return f.loc[found, [*_GROUP, "block", "node", "mult", "code"]]

    return run


def _group_links(bits: int, tables: int, threshold: float, kind: str):
    """Links among the members of a group that have open pairs, in double precision."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        size, t, i, j = key[0], key[1], key[3], key[4]
        f = f.sort_values("node")
        unit = _unit(np.frombuffer(b"".join(f["data"]), kind).reshape(-1, size).astype(float))
        node, mult, block = (f[c].to_numpy() for c in ("node", "mult", "block"))
        coder = _coder(size, bits, tables)
        keys = coder.buckets(_signs(f, len(coder.turns), size))
        links, pairs = np.zeros(len(f), np.int64), []
        for a in range(0, len(f), 512):
            x, y = np.nonzero(unit[a : a + 512] @ unit.T >= threshold - 1e-9)
            x = x + a
            keep = _new_pairs(x, y, block, i, j, keys, t)
            x, y = x[keep], y[keep]
            for k in range(0, len(x), 1 << 16):
                p, q = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                near = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                p, q = p[near], q[near]
                np.add.at(links, p, mult[q])
                np.add.at(links, q, mult[p])
                pairs += zip(node[p].tolist(), node[q].tolist())
                if len(pairs) > 1 << 18:
                    pairs = list(forest(pairs).items())
        root = forest(pairs)
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": node[at], "links": links[at], "root": [root[n] for n in node[at].tolist()]})

    return run


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, bits: int | None = None, tables: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector.  bits and tables follow from the number of distinct vectors unless given."""
    need(vectors, "vec_id", "embedding")
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    keyed = staged(_keys(vectors, kind), "vectors")
    stands = F.struct(F.col("vec_id").isNull().alias("no"), "vec_id")
    classes = staged(keyed.where("node is not null").groupBy("node").agg(F.count("*").alias("mult"), F.min(stands).alias("c"), F.first("data").alias("data")).select("node", "mult", "c.vec_id", "data"), "classes")
    bits, tables = plan_bits(classes.count(), threshold) if bits is None else (bits, tables)
    coded = staged(_coded(classes, bits, tables, kind), "codes")
    posted = coded.select(*(c for c in coded.columns if c != "buckets"), F.posexplode("buckets").alias("t", "bucket"))
    full = posted.groupBy("size", "t", "bucket").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    full = staged(full, "full")
    cut = posted.join(full, ["size", "t", "bucket"])  # a vector alone in its bucket has no pair there
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node", "t"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    grouped = cut.select("*", F.explode(pair).alias("p")).select("size", "t", "bucket", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", "node", "mult", "code", "factors", "scale", "small")
    some = grouped.groupBy(*_GROUP).applyInPandas(_group_open(bits, tables, threshold), "size int, t int, bucket long, i int, j int, block int, node long, mult long, code binary")
    some = staged(some, "open").join(classes.select("node", "data"), "node")
    found = staged(some.groupBy(*_GROUP).applyInPandas(_group_links(bits, tables, threshold, kind), "node long, links long, root long"), "found")
    discard(coded, full)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select("node", "root"))
    member = classes.select("node", "mult", "vec_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(links, "node", "left")
    first = member.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = member.join(first, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    out = keyed.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
