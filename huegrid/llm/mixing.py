"""Mixing sources to target weights by drawing fixed-length blocks.

The words of a source, document after document, are packed into blocks of
BLOCK words.  The mix is a list of slots in output shards: a shard has a
multinomial count of slots per source, and slot j of a source holds the block
that a pseudorandom permutation of the source's block indexes gives for
j mod blocks; the permutation changes with j div blocks.  A pass over a source
thus takes each block once.  The last slot of a source is cut so that the
words taken are the rounded target.

The counts come from a binary tree over the shards: what a node has of each
source is divided between its halves by a seeded multinomial draw (source
after source, kept to what is left), so totals are met exactly, and any shard
finds its counts and its first slots from the root down without the others.

Documents have their texts moved once: sizes, places and takes are narrow
tables keyed by a row number written with the text, and the takes of a document
join its text at the end.

Sources are a dimension: their sizes (one number each) are on the driver, and
more than MOST_SOURCES raise.  Documents, blocks, slots and shards never are.

Defined results: null text has size 0; a null source is a source of its own,
last in order; repeated doc_ids are separate documents, and equal rows share
their places in any order; documents without words take 0; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, mix, need, packed, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, BLOCK = (5, 2, 1), 1.5, 2, 256
#: Slots of an output shard; documents of an offset bucket.
SHARD_SLOTS, BUCKET_DOCS, MOST_SOURCES = 16_384, 4_000, 1_000_000
_SEED = 1729


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Share of all sizes by weight; a target stops at most times its size and the excess is reshared by weight."""
    total, out, free = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        rest = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in free)
        weight = sum(weights[i] for i in free)
        for i in free:
            out[i] = rest * weights[i] / weight
        above = {i for i in free if out[i] > most * sizes[i]}
        if not above:
            break
        for i in above:
            out[i] = float(most * sizes[i])
        free -= above
    return out


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n) chosen by key, at x: a four-round Feistel network that walks its cycles until it is below n."""
    x, n, key = (np.asarray(a, np.uint64) for a in (x, n, key))
    half = np.ones(len(n), np.uint64)
    while (small := (np.uint64(1) << (2 * half).astype(np.uint64)) < n).any():
        half += small.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.ones(len(x), bool)
    while todo.any():
        h, m, k, v = half[todo], mask[todo], key[todo], out[todo]
        left, right = v >> h, v & m
        for r in reversed(range(4)) if inverse else range(4):
            if inverse:
                left, right = right ^ (mix(left * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r)) & m), left
            else:
                left, right = right, left ^ (mix(right * np.uint64(0x9E3779B97F4A7C15) + k + np.uint64(r)) & m)
        out[todo] = left << h | right
        todo[todo] = out[todo] >= n[todo]
    return out.astype(np.int64)


def _key(sid: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    return mix(np.asarray(sid, np.uint64) * np.uint64(1_000_003) + mix(np.asarray(epoch, np.uint64) + np.uint64(seed)))


def sources_of(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = _SEED) -> list[dict]:
    """One dict a source: source, sid, docs, source_size, target, blocks, slots, last (words of the last slot)."""
    found = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size")).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"{len(found)} sources; at most {MOST_SOURCES} make a mix")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["source_size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most)
    out = []
    for sid, (r, target) in enumerate(zip(found, goal)):
        size, want = r["source_size"], min(round(target), int(most * r["source_size"]))
        blocks, slots, last = -(-size // block), 0, 0
        if want:
            epochs, rest = divmod(want, size)
            slots, last = epochs * blocks, block
            if rest:
                short = block * blocks - size  # what the last block lacks
                rank = int(permuted([blocks - 1], [blocks], _key([sid], [epochs], seed), inverse=True)[0])
                more = -(-rest // block)
                if more > rank:  # the short block is among them
                    more = -(-(rest + short) // block)
                last = rest - ((more - 1) * block - (short if more - 1 > rank else 0))
                slots += more
        out.append(dict(source=r["source"], sid=sid, docs=r["docs"], source_size=size, target=float(target), blocks=blocks, slots=slots, last=last))
    return out


class ShardTree:
    """The slots of each source in each shard; total slots are shard_slots a shard, the last one's the rest."""

    def __init__(self, slots: list[int], shard_slots: int = SHARD_SLOTS, seed: int = _SEED):
        self.slots, self.shard_slots, self.seed = np.array(slots, np.int64), shard_slots, seed
        self.total = int(self.slots.sum())
        self.shards = -(-self.total // shard_slots)

    def _left(self, low: int, high: int, counts: np.ndarray) -> tuple[int, np.ndarray]:
        """The middle of the shards low..high and the counts of the left half."""
        middle = (low + high) // 2
        n, rest = (middle - low) * self.shard_slots, int(counts.sum())
        rng = np.random.default_rng([self.seed, low, high])
        out = np.zeros(len(counts), np.int64)
        for i, c in enumerate(counts.tolist()):
            if not n:
                break
            drawn = int(rng.binomial(n, min(1.0, c / rest))) if c else 0
            out[i] = min(max(drawn, n - (rest - c)), c, n)
            n, rest = n - out[i], rest - c
        return middle, out

    def counts(self, first: int, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """shard, first slots and counts of the shards first..last - 1."""
        nodes = [(0, self.shards, np.zeros(len(self.slots), np.int64), self.slots)] if self.shards else []
        while nodes:
            low, high, before, counts = nodes.pop()
            if high <= first or low >= last:
                continue
            if high - low == 1:
                yield low, before, counts
                continue
            middle, left = self._left(low, high, counts)
            nodes += [(middle, high, before + left, counts - left), (low, middle, before, left)]


def slot_blocks(spark, sources: list[dict], seed: int = _SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, sid, slot, block, part (words of the block that a cut slot takes, else null)."""
    tree = ShardTree([s["slots"] for s in sources], shard_slots, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            wanted = np.sort(b.column(0).to_numpy())
            for part in np.split(wanted, np.flatnonzero(np.diff(wanted) > 1) + 1):
                for shard, before, counts in tree.counts(int(part[0]), int(part[-1]) + 1):
                    for sid in np.flatnonzero(counts).tolist():
                        s = sources[sid]
                        for a in range(int(before[sid]), int(before[sid] + counts[sid]), 200_000):
                            j = np.arange(a, min(a + 200_000, int(before[sid] + counts[sid])))
                            block = permuted(j % s["blocks"], np.full(len(j), s["blocks"]), _key(np.full(len(j), sid), j // s["blocks"], seed))
                            cut = j == s["slots"] - 1
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), shard)), pa.array(np.full(len(j), sid, np.int32)), pa.array(j), pa.array(block), pa.array(np.full(len(j), s["last"]), mask=~cut)], ["shard", "sid", "slot", "block", "part"])

    return spark.range(0, tree.shards, 1, max(1, -(-tree.shards // 32))).mapInArrow(lean(run), "shard long, sid int, slot long, block long, part long")


def offsets(sized: DataFrame, sources: list[dict]) -> DataFrame:
    """Documents with words, with sid, source_size, target and start: the words of their source before them.

    sized: _row, doc_id, source, size, _t (hash of the text).  Rows that agree but for _row are a group, which starts
    where the groups before it end: prefix sums within buckets of groups and over the buckets.  Rows of a group follow
    one another, numbered within the partitions that _row names and over these.
    """
    key = ["sid", "_no", "_id", "size", "_t"]
    dim = sized.sparkSession.createDataFrame([(s["source"], s["sid"], s["source_size"], s["target"], max(1, -(-s["docs"] // BUCKET_DOCS))) for s in sources], "_source string, sid int, source_size long, target double, _buckets long")
    named = sized.where("size > 0").join(dim, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    named = named.withColumns({"_no": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))})
    groups = named.groupBy(*key).agg(F.count("*").alias("_rows"), F.first("_buckets").alias("_buckets"))
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64("_id", "size", "_t"), F.col("_buckets"))).withColumn("_words", F.col("size") * F.col("_rows"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    groups = staged(groups, "groups")
    sums = groups.groupBy("sid", "_bucket").agg(F.sum("_words").alias("_n"))
    bases = sums.select("sid", "_bucket", upto("_n", Window.partitionBy("sid").orderBy("_bucket")).alias("_base"))
    placed = groups.withColumn("_in", upto("_words", Window.partitionBy("sid", "_bucket").orderBy("_no", "_id", "size", "_t"))).join(bases, ["sid", "_bucket"])
    placed = placed.select(*key, "_rows", (F.col("_base") + F.col("_in")).alias("start"))
    rows = named.drop("_buckets").join(placed, key)
    columns = ["_row", "doc_id", "size", "sid", "source_size", "target", "start"]
    if groups.where("_rows > 1").isEmpty():
        return rows.select(columns)
    single, many = rows.where("_rows = 1"), rows.where("_rows > 1").withColumn("_part", F.shiftright("_row", 33))
    parts = many.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    parts = parts.select(*key, "_part", upto("_n", Window.partitionBy(*key).orderBy("_part")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_row")) - 1
    many = many.withColumn("_rank", rank).join(parts, [*key, "_part"]).withColumn("start", F.col("start") + F.col("size") * (F.col("_rank") + F.col("_before")))
    return single.select(columns).unionByName(many.select(columns))


def block_parts(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each document's share of each block it reaches: placed's columns, block, a and z (words a..z of the block)."""
    ends = placed.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    return ends.withColumn("a", F.greatest(F.col("start") - F.col("block") * block, F.lit(0))).withColumn("z", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block)))


def takes(slots: DataFrame) -> DataFrame:
    """How often the mix takes each block whole, and the words of a cut take."""
    return slots.groupBy("sid", "block").agg(F.count_if(F.col("part").isNull()).alias("times"), F.coalesce(F.max("part"), F.lit(0)).alias("part"))


def _taken(placed: DataFrame, sources: list[dict], block: int, seed: int) -> DataFrame:
    """placed's columns with block, a, z, times and part of each block that the mix takes some of."""
    slots = takes(slot_blocks(placed.sparkSession, sources, seed))
    return block_parts(placed, block).join(slots.hint("merge"), ["sid", "block"])


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix_digest(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = _SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    need(docs, "doc_id", "text", "source")
    sized = staged(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long"), "source", _size().alias("size"), F.xxhash64("text").alias("_t")), "sizes")
    sources = sources_of(sized, weights, share, most, block, seed)
    got = _taken(offsets(sized, sources).select("_row", "size", "sid", "start"), sources, block, seed)
    words = F.col("times") * (F.col("z") - F.col("a")) + F.greatest(F.least("z", "part") - F.col("a"), F.lit(0))
    some = got.groupBy("_row").agg(F.sum(words).alias("taken"))
    dim = docs.sparkSession.createDataFrame([(s["source"], s["source_size"], s["target"]) for s in sources], "_source string, source_size long, target double")
    out = sized.join(some, "_row", "left").join(dim, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, seed: int = _SEED) -> DataFrame:
    """The mix itself as documents: a row for each take of a document's part of a block, with docs' columns; text is that part (its words joined by one space), n_chars its length."""
    need(docs, "doc_id", "text", "source")
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    kept = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text", "source", packed(others).alias("_rest"), _size().alias("size"), F.xxhash64("text").alias("_t"))
    kept = staged(kept, "texts")
    sized = kept.select("_row", "doc_id", "source", "size", "_t")
    sources = sources_of(sized, weights, share, most, block, seed)
    got = _taken(offsets(sized, sources).select("_row", "size", "sid", "start"), sources, block, seed)
    # words first..first + n of a document, `times` over; first..first + part once
    first = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    cut = F.struct(first.alias("first"), (F.col("z") - F.col("a")).alias("n"), "times", F.greatest(F.least("z", "part") - F.col("a"), F.lit(0)).alias("part"))
    cuts = got.groupBy("_row").agg(F.collect_list(cut).alias("_cuts"))  # of one document: no more than its blocks
    joined = kept.drop("size", "_t").join(cuts.hint("merge"), "_row").drop("_row")
    counted = "n_chars" in others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, texts, held = [], [], 0
            for i, (text, cuts) in enumerate(zip(b.column("text"), b.column("_cuts").to_pylist())):
                words = text.as_py().encode().split()
                for c in cuts:
                    whole = b" ".join(words[c["first"] : c["first"] + c["n"]])
                    made = [whole] * c["times"] + ([b" ".join(words[c["first"] : c["first"] + c["part"]])] if c["part"] else [])
                    texts += made
                    rows += [i] * len(made)
                    held += len(whole) * len(made)
                    if held > 4 << 20:
                        yield cut_rows(b, rows, texts)
                        rows, texts, held = [], [], 0
            yield cut_rows(b, rows, texts)

    def cut_rows(b: pa.RecordBatch, rows: list[int], texts: list[bytes]) -> pa.RecordBatch:
        kept = b.select(["doc_id", "source", "_rest"]).take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "source", "_rest", "text"])

    schema = T.StructType([joined.schema[c] for c in ("doc_id", "source", "_rest")] + [T.StructField("text", T.StringType())])
    out = joined.mapInArrow(lean(run), schema)
    out = out.select("doc_id", "text", "source", *(F.col("_rest").getField(c).alias(c) for c in others))
    if counted:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
