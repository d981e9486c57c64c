"""Removal of passages that repeat anywhere in the corpus.

A window is WINDOW consecutive words of a document; words covered by a window
whose sequence starts anywhere else are removed.

Suffix automata of reference shards tell how often each window occurs:
documents are streamed through them, the matching statistics give the state
of every window, and the state's occurrence count decides.  The reference is
the corpus itself, so its shards are cut by content: consecutive windows with
the same least hash among their ANCHOR-word runs form a segment, and segments
go to the shard of that hash.  Equal windows have equal least hashes, so every
occurrence of a window is in one shard, and each automaton (about SHARD_WORDS
words) meets only the documents' segments that can match it.  Sending every
automaton to every document would cost shards times documents.

Before that, segments whose anchor occurs once are dropped, since their
windows cannot repeat.  Anchors with more than HOT occurrences would make one
unbounded shard; their windows are counted by 128-bit hashes instead.  Windows
that repeat within a batch are settled there, and only one row of each is left
to count, so a common passage moves once a batch.  Documents with the same word sequence are
one class whose windows weigh as many as the class has documents.

With a given reference table (`remove_reference_spans`), its automata are
broadcast, one bounded shard at a time, and documents stream through them.

Texts are found again by doc_id and a 64-bit hash, and their word sequence is
checked, so repeated and null doc_ids cost no more than others.  Words are
compared by 64-bit hashes.

Defined results: null and empty texts have no words; repeated rows and
doc_ids are documents each, whose texts repeat each other, and so are rows with
a null doc_id; overlapping repeats of a text within itself count; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, discard, lean, mix, need, ngrams, packed, staged, text_chunks
from .suffix_automaton import SuffixAutomaton

WINDOW, ANCHOR, HOT, SHARD_WORDS = 35, 12, 256, 50_000
_U = np.uint64


def _least(keys: np.ndarray, w: int) -> np.ndarray:
    """The place of the first least key in each run of w keys."""
    at, span = np.arange(len(keys)), 1
    while span * 2 <= w:
        a, b = at[:-span], at[span:]
        at = np.where(keys[b] < keys[a], b, a)
        span *= 2
    n = len(keys) - w + 1
    a, b = at[:n], at[w - span : w - span + n]
    return np.where(keys[b] < keys[a], b, a)


def _identity(hashes: np.ndarray) -> int:
    """The node of a class: its word sequence."""
    return int.from_bytes(hashlib.md5(hashes.tobytes()).digest()[:8], "little", signed=True)


def segments(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Text index, first window (a word index in its text), windows, anchor hash and anchor places of each segment."""
    none = (np.zeros(0, np.int64),) * 5
    if len(words.hashes) < window:
        return none
    owner, keys = words.owner(), ngrams(words.hashes, anchor)
    at = _least(keys, window - anchor + 1)
    pos = np.flatnonzero(owner[: len(at)] == owner[window - 1 : window - 1 + len(at)])
    if not len(pos):
        return none
    place = at[pos]
    value = keys[place]
    new = np.append(True, (value[1:] != value[:-1]) | (np.diff(pos) != 1))
    first = np.flatnonzero(new)
    moved = np.append(0, np.cumsum(np.append(False, place[1:] != place[:-1]) & ~new))
    upto = np.append(first[1:], len(pos))
    return owner[pos[first]], pos[first] - words.first[owner[pos[first]]], upto - first, value[first].astype(np.int64), moved[upto] - moved[first] + 1


_FOUND = "doc_id long, t long, key long, n_words long, segments array<struct<start:int,n:int,anchor:long,places:int>>"


def _found(docs: DataFrame, window: int) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("places", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in text_chunks(b.column("text")):
                words = Words(data, offsets)
                owner, start, n, anchor, places = segments(words, window)
                bounds = np.searchsorted(owner, np.arange(j - i + 1))
                inner = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(places.astype(np.int32))], ["start", "n", "anchor", "places"])
                key = [_identity(words.hashes[a:z]) for a, z in zip(words.first[:-1], words.first[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("t").slice(i, j - i), pa.array(key, pa.int64()), pa.array(words.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), inner).cast(kind)], ["doc_id", "t", "key", "n_words", "segments"])

    return docs.mapInArrow(lean(run), _FOUND)


#: kind 0: the words of a segment of a cold anchor, in data; 1: windows to count by h1 and h2 (key null: only to be counted); 2: a span start..z that repeats.
_CUT = "kind int, key long, start int, z int, anchor long, data binary, h1 long, h2 long, mult long"
_CUT_KINDS = dict(kind=pa.int32(), key=pa.int64(), start=pa.int32(), z=pa.int32(), anchor=pa.int64(), data=pa.binary(), h1=pa.int64(), h2=pa.int64(), mult=pa.int64())


def _cut_rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _CUT_KINDS.items()], list(_CUT_KINDS))


def _settled(key: np.ndarray, at: np.ndarray, one: np.ndarray, two: np.ndarray, mult: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """The windows of hot anchors in a batch: those that repeat here as spans, with one row of each left to count; the others to count."""
    order = np.lexsort((two, one))
    same = np.append(False, (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]))
    group = np.cumsum(~same) - 1
    again = np.bincount(group, mult[order]) > 1
    found = np.zeros(len(order), bool)
    found[order] = again[group]
    first = order[np.flatnonzero(~same)[again]]
    yield _cut_rows(len(first), kind=np.ones(len(first), np.int32), h1=one[first].astype(np.int64), h2=two[first].astype(np.int64), mult=np.full(len(first), 2))
    rest = np.flatnonzero(~found)
    yield _cut_rows(len(rest), kind=np.ones(len(rest), np.int32), key=key[rest], start=at[rest].astype(np.int32), h1=one[rest].astype(np.int64), h2=two[rest].astype(np.int64), mult=mult[rest])
    key, at = key[found], at[found]
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (np.diff(at) > window))) if len(key) else np.zeros(0, int)
    last = np.append(new[1:], len(key))[: len(new)] - 1
    yield _cut_rows(len(new), kind=np.full(len(new), 2, np.int32), key=key[new], start=at[new].astype(np.int32), z=(at[last] + window).astype(np.int32))


def _cut(needed: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The words of segments; for hot anchors, the two hashes of every window that does not repeat in its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hot = []
            for i, j, data, offsets in text_chunks(b.column("text"), 1 << 20):
                words, cold = Words(data, offsets), []
                keys, mults, wanted = (b.column(c).slice(i, j - i).to_pylist() for c in ("key", "mult", "wanted"))
                for k, (key, mult, some) in enumerate(zip(keys, mults, wanted)):
                    h = words.hashes[words.first[k] : words.first[k + 1]]
                    if _identity(h) != key:  # another text under a repeated doc_id
                        continue
                    one = two = None
                    for s in some:
                        if not s["hot"]:
                            cold.append((key, s["start"], s["anchor"], h[s["start"] : s["start"] + s["n"] + window - 1].tobytes(), mult))
                            continue
                        if one is None:
                            one, two = ngrams(h, window), ngrams(mix(h + _U(99)), window)
                        at = np.arange(s["start"], s["start"] + s["n"])
                        hot.append((np.full(len(at), key), at, one[at], two[at], np.full(len(at), mult)))
                if cold:
                    yield _cut_rows(len(cold), kind=[0] * len(cold), **dict(zip(("key", "start", "anchor", "data", "mult"), zip(*cold))))
            if hot:
                yield from _settled(*(np.concatenate(c) for c in zip(*hot)), window)

    one = docs.join(needed, ["doc_id", "t"]).dropDuplicates(["doc_id", "t"])  # of equal rows
    return one.select("key", "mult", "wanted", "text").mapInArrow(lean(run), _CUT)


def _runs(mask: list[bool], window: int) -> list[tuple[int, int]]:
    """Word spans that the marked windows cover."""
    out: list[tuple[int, int]] = []
    for x, on in enumerate(mask):
        if on:
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], x + window)
            else:
                out.append((x, x + window))
    return out


def _shard_spans(window: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        weight: Counter = Counter()
        for data, mult in zip(f["data"], f["mult"]):
            weight[bytes(data)] += mult
        texts = list(weight)
        symbols, flat = np.unique(np.concatenate([np.frombuffer(t, np.uint64) for t in texts]), return_inverse=True)
        bounds = np.cumsum([0] + [len(t) // 8 for t in texts])
        lists = [flat[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])]
        automaton = SuffixAutomaton()
        for t, seq in zip(texts, lists):
            automaton.add(seq, weight[t])
        automaton.finish()
        spans = {}
        for t, seq in zip(texts, lists):
            mask = [long == window and count > 1 for long, count in automaton.matching(seq, window)][window - 1 :]
            spans[t] = _runs(mask, window)
        rows = [(key, start + a, start + z) for key, start, data in zip(f["key"], f["start"], f["data"]) for a, z in spans[bytes(data)]]
        return pd.DataFrame(rows, columns=["key", "a", "z"])

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n_words, n_removed and kept_text to the rows whose key is their text's own; key and spans go."""
    for b in batches:
        for i, j, data, offsets in text_chunks(b.column("text")):
            words, out, rows = Words(data, offsets), [], []
            keys, spans = (b.column(c).slice(i, j - i).to_pylist() for c in ("key", "spans"))
            raw = data.tobytes()
            for k, (key, some) in enumerate(zip(keys, spans)):
                a, z = words.first[k], words.first[k + 1]
                if _identity(words.hashes[a:z]) != key:
                    continue
                gone = np.zeros(z - a + 1, np.int64)
                for s in some or ():
                    gone[s["a"]] += 1
                    gone[s["z"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                kept = raw[offsets[k] : offsets[k + 1]].split()
                if gone.any():
                    kept = [w for w, g in zip(kept, gone.tolist()) if not g]
                rows.append(i + k)
                out.append((int(z - a), int(gone.sum()), b" ".join(kept).decode()))
            columns = list(zip(*out)) or [()] * 3
            had = b.select([n for n in b.schema.names if n not in ("key", "spans")]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*had.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string())))], [*had.schema.names, "n_words", "n_removed", "kept_text"])


_NULL = -(1 << 63)


def remove_repeats(docs: DataFrame, window: int = WINDOW, passed: list[str] | None = None) -> DataFrame:
    """doc_id, text and the other columns in passed, with n_words, n_removed and kept_text (kept words joined by one space)."""
    need(docs, "doc_id", "text")
    full = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), F.xxhash64("text").alias("t"), "text", *(F.col(c).alias(f"_{k}") for k, c in enumerate(passed or [])))
    docs = full.select("doc_id", "t", "text")
    found = staged(_found(docs, window), "segments")
    classes = staged(found.groupBy("key").agg(F.count("*").alias("mult"), F.min(F.struct("doc_id", "t")).alias("c")).select("key", "mult", "c.*"), "classes")
    each = found.select("key", F.explode("segments").alias("s")).select("key", "s.*")
    counts = staged(each.groupBy("anchor").agg(F.sum("places").alias("total")).where("total > 1"), "anchors")
    some = each.join(counts, "anchor").select("key", F.struct("start", "n", "anchor", (F.col("total") > HOT).alias("hot")).alias("s"))
    wanted = some.groupBy("key").agg(F.collect_set("s").alias("wanted"))  # of one class: no more than its document's windows
    needed = staged(wanted.join(classes, "key"), "needed")
    size = needed.select(F.expr(f"aggregate(filter(wanted, s -> not s.hot), 0L, (x, s) -> x + s.n + {window - 1})").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-size // SHARD_WORDS))

    cut = staged(_cut(needed, docs, window), "cut")
    cold = cut.where("kind = 0").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    spans = cold.select("shard", "key", "start", "data", "mult").groupBy("shard").applyInPandas(_shard_spans(window), "key long, a int, z int")
    hot = cut.where("kind = 1").select("key", "start", "h1", "h2", "mult")
    again = staged(hot.groupBy("h1", "h2").agg(F.sum("mult").alias("total")).where("total > 1").select("h1", "h2"), "again")
    more = hot.where("key is not null").join(again, ["h1", "h2"]).select("key", F.col("start").alias("a"), (F.col("start") + window).alias("z"))
    more = more.unionByName(cut.where("kind = 2").select("key", F.col("start").alias("a"), "z"))
    covered = spans.unionByName(more).groupBy("key").agg(F.collect_set(F.struct("a", "z")).alias("spans"))
    covered = staged(covered, "covered")
    discard(classes, counts, needed, cut, again)
    named = found.select("doc_id", "t", "key").distinct().join(covered, "key", "left")
    joined = full.join(named, ["doc_id", "t"]).drop("t")
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    out = joined.mapInArrow(lean(_keep), T.StructType([*(f for f in full.schema.fields if f.name != "t"), *made]))
    others = [F.col(f"_{k}").alias(c) for k, c in enumerate(passed or [])]
    return out.select(F.nullif("doc_id", F.lit(_NULL)).alias("doc_id"), "text", *others, "n_words", "n_removed", "kept_text")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages taken out of text and n_chars following; texts without any stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select("doc_id", "text", packed(others).alias("_rest"))
    out = remove_repeats(whole, window, ["_rest"]).withColumn("_gone", F.col("n_removed") > 0)
    text = F.when(F.col("_gone"), F.col("kept_text")).otherwise(F.col("text"))
    columns = {c: F.col("_rest").getField(c) for c in others} | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("_gone"), F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def remove_reference_spans(docs: DataFrame, reference: list[str], window: int = WINDOW, most_words: int = SHARD_WORDS) -> DataFrame:
    """docs with the maximal spans of at least window words that occur in the reference taken out of text.

    reference: texts of a bounded list; shards of at most most_words words.  Longer texts are cut into pieces that
    overlap by window - 1 words, so each broadcast is bounded and every window lies in a piece.
    """
    need(docs, "text")
    if most_words < window:
        raise ValueError("a shard must hold a window")
    spark, step = docs.sparkSession, most_words - window + 1
    texts = [t.encode().split() for t in reference if t]
    rest = [t[a : a + most_words] for t in texts for a in range(0, max(1, len(t) - window + 1), step)]
    found = docs.withColumn("_spans", F.lit(b""))
    while rest:
        automaton, n = SuffixAutomaton(), 0
        while rest and (n == 0 or n + len(rest[-1]) <= most_words):
            n += len(rest[-1])
            automaton.add(rest.pop())
        shard = spark.sparkContext.broadcast((automaton.next, automaton.link, automaton.length))

        def match(frames: Iterator[pd.DataFrame], shard=shard) -> Iterator[pd.DataFrame]:
            a = SuffixAutomaton()
            a.next, a.link, a.length = shard.value
            a.count = [0] * len(a.length)
            for f in frames:
                spans = []
                for t, before in zip(f["text"], f["_spans"]):
                    words = t.encode().split() if t is not None else []
                    mask = [long == window for long, _ in a.matching(words, window)][window - 1 :]
                    spans.append(bytes(before) + np.array(_runs(mask, window), np.int64).tobytes())
                f["_spans"] = spans
                yield f

        found = found.mapInPandas(match, found.schema)

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for t, spans in zip(f["text"], f["_spans"]):
                if spans:
                    words = t.encode().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for x, z in np.frombuffer(spans, np.int64).reshape(-1, 2):
                        gone[x] += 1
                        gone[z] -= 1
                    t = b" ".join(w for w, g in zip(words, np.cumsum(gone[:-1]) > 0) if not g).decode()
                texts.append(t)
            f["text"] = texts
            yield f.drop(columns="_spans")

    return found.mapInPandas(remove, docs.schema)
