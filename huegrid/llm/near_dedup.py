"""Near-duplicate documents by an inverted join over signature coordinates.

A document is the set of its 5-word shingles; documents with equal sets are
one class.  A class has COORDINATES MinHash values, and every (coordinate,
value) is a token under which the class is posted.  Two classes are a
candidate pair if at least MATCHES of their coordinates agree; then they share
a token among any COORDINATES - MATCHES + 1 of their tokens, taken in one order
for all classes.  Frequent tokens come last in that order, so their lists are
skipped unless a class consists mostly of them (prefix and skip merging).

Lists of up to SMALL_LIST classes give all their pairs.  Longer lists give the
pairs with one member each, chosen by the token's hash; after the first round
of confirmed links, members that are still apart from a long list's largest
component are compared with all members of other components.  That happens in
groups of two blocks of at most about BLOCK members and BLOCK_SHINGLES
shingles, and only a forest of confirmed links leaves a group.  Links are
confirmed on full sets from whole texts: first the best candidate of each
class, then all candidates whose ends are still in different components.  So
no link between components is lost among the candidates, and copies are not
expanded into all pairs.

Agreement of coordinates is a binomial count: at the similarity of 0.75 a pair
has fewer than 52 of 96 agreements with a probability of about 3e-6.

Defined results: null texts and texts without words have an empty set and no
links; fewer than 5 words make one shingle of the whole sequence; repeated
rows and doc_ids are documents each; ties go to the smallest doc_id; further
columns are ignored.  Rows with a null doc_id take part like others and are not
kept in a component that has a doc_id; a component without any has a null
component_id, and its rows are all kept.  without_near_duplicates goes by rows:
of the smallest doc_id's rows in a component it keeps one.  A class's text is
found again by doc_id and 64-bit text hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, lean, mix, need, ngrams, staged, text_chunks
from .components import components, forest

SHINGLE, COORDINATES, MATCHES, SMALL_LIST, BLOCK, BLOCK_SHINGLES, MOST_FREQUENT = 5, 96, 52, 64, 4096, 3_000_000, 1_000_000
_PREFIX = COORDINATES - MATCHES + 1
_U = np.uint64
_A = np.random.default_rng(7).integers(1, (1 << 64) - 1, COORDINATES, dtype=np.uint64) | _U(1)
_B = np.random.default_rng(8).integers(1, (1 << 64) - 1, COORDINATES, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for _, _, data, offsets in text_chunks(column):
        words = Words(data, offsets, lower=True)
        keys = ngrams(words.hashes, n)
        for a, z in zip(words.first[:-1], words.first[1:]):
            if z - a >= n:
                yield np.unique(keys[a : z - n + 1])
            elif z > a:  # the whole sequence as one, apart from windows of n
                yield ngrams(words.hashes[a:z], z - a)[:1] ^ _U(z - a)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES values, 32 bits of the least of each hash family member."""
    least = np.full(COORDINATES, ~_U(0))
    for a in range(0, len(shingles), 2048):
        part = shingles[a : a + 2048]
        least = np.minimum(least, (part[:, None] * _A + _B).min(axis=0))
    return (mix(least) & _U(0x7FFFFFFF)).astype(np.int32)


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, key, sig = [], [], []
            for s in shingle_sets(b.column("text")):
                size.append(len(s))
                key.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "t", "n_shingles", "key", "sig"])

    return docs.mapInArrow(lean(run), "doc_id long, t long, n_shingles long, key binary, sig array<int>")


def _postings(classes: DataFrame) -> DataFrame:
    """(token, node, n_shingles) of each class's prefix."""
    tokens = F.transform("sig", lambda v, k: F.shiftleft(k.cast("long"), 32).bitwiseOR(v.cast("long")))
    total = classes.count() * COORDINATES
    often = max(SMALL_LIST, total // MOST_FREQUENT)
    listed = classes.select(F.explode(tokens).alias("token")).groupBy("token").count().where(F.col("count") > often)
    # at most MOST_FREQUENT tokens can have more than total / MOST_FREQUENT postings: 8 MB
    frequent = np.array(sorted(r["token"] for r in listed.collect()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.arange(COORDINATES, dtype=np.int64) << 32
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column("sig").flatten().to_numpy().astype(np.int64).reshape(-1, COORDINATES) | high
            rank = mix(t.astype(np.uint64)) >> _U(1)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)
                rank |= (frequent[at] == t).astype(np.uint64) << _U(63)
            first = np.take_along_axis(t, np.argsort(rank, axis=1, kind="stable")[:, :_PREFIX], 1)
            each = lambda c: pa.array(np.repeat(b.column(c).to_numpy(), _PREFIX))
            yield pa.RecordBatch.from_arrays([pa.array(first.ravel()), each("node"), each("n_shingles")], ["token", "node", "n_shingles"])

    return classes.select("node", "n_shingles", "sig").mapInArrow(lean(run), "token long, node long, n_shingles long")


def _matching(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs a < b whose sizes allow the similarity and whose signatures agree often enough, with matches."""
    side = lambda n: classes.select(F.col("node").alias(n), F.col("n_shingles").alias(f"n{n}"), F.col("sig").alias(f"s{n}"))
    got = pairs.join(side("a"), "a").join(side("b"), "b").where("100 * least(na, nb) >= 75 * greatest(na, nb)")
    matches = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return got.select("a", "b", matches.alias("matches")).where(F.col("matches") >= MATCHES)


def _ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(shingle_sets(b.column("ta")), shingle_sets(b.column("tb"))):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= 75 * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"t{n}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long")


def _coordinates(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bit masks of 48 coordinates each, as flags."""
    bits = np.arange(48, dtype=np.int64)
    return np.hstack([low[:, None] >> bits & 1, high[:, None] >> bits & 1]).astype(bool)[:, :COORDINATES]


def _agreeing(pairs: np.ndarray, sets: dict[int, np.ndarray]) -> np.ndarray:
    """The pairs whose sets link; intersections are the product of 0-1 matrices over the shingles that occur twice here."""
    used, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    sizes = np.array([len(sets[k]) for k in used])
    keys, column = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True)
    row = np.repeat(np.arange(len(used), dtype=np.int32), sizes)
    twice = np.flatnonzero(np.bincount(column, minlength=len(keys)) > 1)
    place = np.full(len(keys), -1, np.int32)
    place[twice] = np.arange(len(twice), dtype=np.int32)
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    firsts, first = np.unique(at[:, 0], return_inverse=True)
    common = np.zeros((len(firsts), len(used)), np.float32)
    for z in range(0, len(twice), 512):
        lo, hi = np.searchsorted(column, [z, z + 512])
        flags = np.zeros((len(used), 512), np.float32)
        flags[row[lo:hi], column[lo:hi] - z] = 1
        common += flags[firsts] @ flags.T
    both = common[first, at[:, 1]].astype(np.int64)
    return pairs[100 * both >= 75 * (sizes[at[:, 0]] + sizes[at[:, 1]] - both)]


def _linked(f: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links of one pair of blocks of a list, as stars: strays with members of other components.

    A pair is looked at in the list of the first coordinate that makes both its
    ends members of a common list, so once in all; pairs with enough equal
    coordinates are confirmed on the full sets.  Ends that links found here have
    joined already are not looked at again.
    """
    i, j, k = (int(f[c].iloc[0]) for c in ("i", "j", "coordinate"))
    node, block, size, stray = (f[c].to_numpy() for c in ("node", "block", "n_shingles", "stray"))
    root = f["rnode"].to_numpy().copy()
    sig = np.frombuffer(b"".join(f["data"]), f"u{len(f['data'].iloc[0]) // COORDINATES}").reshape(len(f), -1)
    member = _coordinates(f["low"].to_numpy(), f["high"].to_numpy())
    at, out, sets = np.flatnonzero(stray), [], {}
    for a in range(0, len(at), 128):
        x = at[a : a + 128]
        new = (root[x, None] != root[None, :]) & (100 * np.minimum(size[x, None], size[None, :]) >= 75 * np.maximum(size[x, None], size[None, :]))
        if i != j:
            new &= block[x, None] != block[None, :]
        for c in range(k):
            if not new.any():
                break
            new &= ~((sig[x, None, c] == sig[None, :, c]) & member[x, None, c] & member[None, :, c])
        p, q = np.nonzero(new)
        wanted = []
        for z in range(0, len(p), 1 << 15):
            u, v = x[p[z : z + (1 << 15)]], q[z : z + (1 << 15)]
            good = (sig[u] == sig[v]).sum(axis=1) >= MATCHES
            wanted.append(np.column_stack([u[good], v[good]]))
        pairs = np.concatenate(wanted) if wanted else np.zeros((0, 2), np.int64)
        if not len(pairs):
            continue
        fresh = [n for n in np.unique(pairs).tolist() if n not in sets]
        sets.update(zip(fresh, shingle_sets(pa.array(f["text"].iloc[fresh].tolist(), pa.large_string()))))
        pairs = _agreeing(pairs, sets)
        if len(pairs):
            out = list(forest([*out, *zip(node[pairs[:, 0]].tolist(), node[pairs[:, 1]].tolist())]).items())
            joined = forest(zip(root[pairs[:, 0]].tolist(), root[pairs[:, 1]].tolist()))
            names, which = np.unique(root, return_inverse=True)
            root = np.array([joined.get(r, r) for r in names.tolist()], np.int64)[which]
    return pd.DataFrame([(x, r) for x, r in out if x != r], columns=["a", "b"], dtype=np.int64)


def _stray_links(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """members: token, node, rnode, main, blocks of long lists with several components."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.array(v, np.int32).tobytes() for v in b.column("sig").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "n_shingles", "low", "high")), pa.array(data, pa.binary())], ["node", "n_shingles", "low", "high", "data"])

    members = members.withColumn("coordinate", F.shiftright("token", 32).cast("int"))
    bit = lambda a, z: F.coalesce(F.bit_or(F.when(F.col("coordinate").between(a, z), F.expr(f"shiftleft(1L, coordinate - {a})"))), F.lit(0))
    own = members.groupBy("node").agg(bit(0, 47).cast("long").alias("low"), bit(48, 95).cast("long").alias("high"))
    packed = classes.join(own, "node").select("node", "n_shingles", "low", "high", "sig").mapInArrow(lean(pack), "node long, n_shingles long, low long, high long, data binary")
    m = members.join(staged(packed.join(texts, "node"), "packed"), "node")
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("stray", F.col("rnode") != F.col("main"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    m = m.withColumn("p", F.explode(pair)).select("*", "p.i", "p.j").drop("p", "main", "blocks")
    return m.groupBy("token", "i", "j").applyInPandas(_linked, "a long, b long")


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of classes (node, doc_id, t), from the document that stands for each."""
    named = nodes.select("node", F.col("doc_id").alias("_id"), F.col("t").alias("_t"))
    got = docs.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")))
    return got.groupBy("node").agg(F.first("text").alias("text"))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t"))


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, t, n_shingles and c of every document: c is (no, doc_id, t) of the row that stands for its component, null without words."""
    docs = _hashed(docs)
    sets = staged(_sets(docs), "sets")
    full = sets.where("key is not null")
    stands = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "t")
    classes = full.groupBy("key").agg(F.min(stands).alias("c"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = staged(classes.select(F.xxhash64("key").alias("node"), "c.doc_id", "c.t", "n_shingles", "sig"), "classes")
    postings = staged(_postings(classes), "postings")
    lists = postings.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("token", "node").alias("h"), "node")).alias("p")).where("m > 1")
    lists = staged(lists.select("token", "m", F.col("p.node").alias("pivot")), "lists")
    small = postings.join(lists.where(F.col("m") <= SMALL_LIST), "token").select("token", "node")
    pairs = small.select("token", F.col("node").alias("a")).join(small.select("token", F.col("node").alias("b")), "token").where("a < b").select("a", "b")
    long = staged(postings.join(lists.where(F.col("m") > SMALL_LIST), "token").select("token", "node", "n_shingles", "pivot"), "long")
    pairs = pairs.unionByName(long.where("node != pivot").select(*_ordered("node", "pivot"))).distinct()
    candidates = staged(_matching(pairs, classes), "candidates")
    discard(postings, lists)

    # whole texts of the classes that have a candidate or are in a long list; one document stands for its class
    ends = candidates.select(F.col("a").alias("node")).unionByName(candidates.select(F.col("b").alias("node"))).unionByName(long.select("node")).distinct()
    texts = staged(_texts_of(docs, classes.join(ends, "node", "left_semi")), "texts")

    # first the best candidate of each class
    of = lambda c: candidates.select(F.col(c).alias("node"), F.struct("matches", "a", "b").alias("e"))
    best = of("a").unionByName(of("b")).groupBy("node").agg(F.max("e").alias("e")).select("e.a", "e.b").distinct()
    links = staged(_confirmed(best, texts), "confirmed")
    roots = components(links)

    # then whatever still joins two components
    label = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    apart = label(long, "node").select("token", "node", "rnode", "n_shingles")
    counts = apart.groupBy("token", "rnode").agg(F.count("*").alias("count"), F.sum("n_shingles").alias("w"))
    counts = counts.groupBy("token").agg(F.count("*").alias("n"), F.sum("count").alias("m"), F.sum("w").alias("w"), F.max(F.struct("count", "rnode")).alias("top")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    counts = staged(counts.select("token", F.col("top.rnode").alias("main"), blocks.alias("blocks")), "apart")
    late = _stray_links(apart.drop("n_shingles").join(counts, "token"), classes, texts)
    rest = label(label(candidates.select("a", "b"), "a"), "b").where("ra != rb").select("a", "b").join(best, ["a", "b"], "left_anti")
    more = staged(_confirmed(rest, texts).unionByName(late), "late")
    first = roots
    roots = components(links.unionByName(more))
    discard(candidates, long, texts, links, first, counts, more)

    member = classes.select("node", stands.alias("c")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = member.groupBy("root").agg(F.min("c").alias("c"))
    named = member.select("node", "root").join(least, "root").select("node", "c")
    return sets.withColumn("node", F.xxhash64("key")).join(named, "node", "left").select("doc_id", "t", "n_shingles", F.when(F.col("key").isNotNull(), F.col("c")).alias("c"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    need(docs, "doc_id", "text")
    component = F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("c.doc_id"))
    return _labelled(docs).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id (of several texts under it, the one with the least hash); of rows without words with one doc_id and text, one."""
    need(docs, "doc_id", "text")
    stands = F.col("c").isNull() | (F.col("doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t") == F.col("c.t")))
    kept = _labelled(docs).where(stands).groupBy(F.col("doc_id").alias("_near_id"), F.col("t").alias("_near_t")).agg(F.count("*").alias("_near_n"))
    kept = staged(kept, "near")
    match = docs["doc_id"].cast("long").eqNullSafe(kept["_near_id"]) & (F.xxhash64(docs["text"]) == kept["_near_t"])
    out = docs.join(kept.where("_near_n = 1"), match, "left_semi")
    again = kept.where("_near_n > 1")
    if again.isEmpty():
        return out
    return out.unionByName(docs.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))
