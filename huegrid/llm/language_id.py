"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 drawn from its code point.  A
trigram's vector binds (multiplies) its letters' vectors, permuted (rolled) by
their places; a document's vector bundles (sums) those of its trigrams, and a
language's prototype bundles its documents' unit vectors.  A document gets the
language whose prototype has the largest cosine with it.

Trigrams run over lower-cased letters, with one blank for whatever stands
between words; their middle is a letter.

Prototypes come from the TRAIN_ROWS training documents with the smallest hash
of doc_id (a bounded sample): those with text and a language whose
crc32(doc_id as text) mod 5 is not 0.  Every document is scored whole.

Defined results: null text and text without a letter give `und` and score 0;
so does every text if there is nothing to learn from; ties go to the first
language by code point; repeated doc_ids are scored each; a null doc_id is not
learned from and not held out; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, need

TRAIN_ROWS, SIZE, SEED = 4000, 1024, 90210
#: Letters of text handled at once; trigram and letter vectors a worker remembers; distinct trigrams handled at once.
CHUNK_CHARS, REMEMBERED, LETTERS, SLICE = 2 << 20, 40_000, 20_000, 4096

_letters: np.ndarray | None = None


def _is_letter(code: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters[code]


class Space:
    """Vectors of trigrams, remembered up to a bound."""

    def __init__(self, size: int = SIZE, seed: int = SEED):
        self.size, self.seed = size, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((0, size), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= LETTERS:
                self.letters.clear()
            self.letters[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.size, np.int8) * 2 - 1
        return self.letters[code]

    def _made(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << 21) - 1
        codes = np.stack([keys >> 42, keys >> 21 & mask, keys & mask])
        found, at = np.unique(codes, return_inverse=True)
        letters = np.stack([self.letter(c) for c in found.tolist()])
        first, second, third = at.reshape(3, -1)
        return np.roll(letters, 2, 1)[first] * np.roll(letters, 1, 1)[second] * letters[third]

    def trigrams(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of distinct trigram keys, at most SLICE of them."""
        new = [k for k in keys.tolist() if k not in self.rows]
        if len(new) > len(keys) // 2 and len(self.rows) + len(new) > REMEMBERED:
            return self._made(keys)  # a run of rare ones
        if new:
            if len(self.rows) + len(new) > REMEMBERED:
                self.rows.clear()
                self.vectors = self.vectors[:0]
                new = keys.tolist()
            self.rows.update(zip(new, range(len(self.vectors), len(self.vectors) + len(new))))
            self.vectors = np.concatenate([self.vectors, self._made(np.array(new, np.int64))])
        return self.vectors[[self.rows[k] for k in keys.tolist()]]

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors of texts, zero for those without a letter."""
        codes = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) + 1 for c in codes])
        flat = np.concatenate([np.append(np.uint32(32), c) for c in codes]) if codes else np.zeros(0, np.uint32)
        letter = _is_letter(flat)
        flat = np.where(letter, flat, 32).astype(np.int64)
        keep = letter | np.append(letter[:-1] != letter[1:], True) | (np.append(-1, owner[:-1]) != owner)
        keep &= letter | ~np.append(False, (~letter[:-1]) & (owner[:-1] == owner[1:])) | np.append(letter[1:], False)
        flat, owner, letter = flat[keep], owner[keep], letter[keep]
        out = np.zeros((len(texts), self.size), np.float32)
        if len(flat) < 1:
            return out
        left = np.append(32, flat[:-1])
        right = np.append(flat[1:], 32)
        right = np.where(np.append(owner[1:] != owner[:-1], True), 32, right)
        key = (left << 42 | flat << 21 | right)[letter]
        if not len(key):
            return out
        found, at = np.unique(key, return_inverse=True)
        order, whose = np.argsort(at, kind="stable"), owner[letter]
        at, whose = at[order], whose[order]
        most = min(SLICE, max(64, (2 << 20) // len(texts)))
        for a in range(0, len(found), most):  # a bounded run of distinct trigrams, over the texts that hold any
            z = min(len(found), a + most)
            i, j = np.searchsorted(at, [a, z])
            rows, row = np.unique(whose[i:j], return_inverse=True)
            counts = np.bincount(row * (z - a) + at[i:j] - a, minlength=len(rows) * (z - a)).reshape(len(rows), -1)
            out[rows] += counts.astype(np.float32) @ self.trigrams(found[a:z]).astype(np.float32)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(length, 1e-12)


_spaces: dict[tuple[int, int], Space] = {}


def _space(size: int = SIZE, seed: int = SEED) -> Space:
    return _spaces.setdefault((size, seed), Space(size, seed))


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= CHUNK_CHARS:
            yield a, i + 1
            a, chars = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def prototypes(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their unit prototypes."""
    learn = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    chosen = learn.select(F.col("doc_id").cast("long").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
    got = learn.select("doc_id", "text", "lang").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left_semi")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), object)
            for a, z in _runs(texts):
                v = _space().bundles(texts[a:z])
                for lang in set(langs[a:z]):
                    sums[lang] = sums.get(lang, 0) + np.rint(v[langs[a:z] == lang] * (1 << 20)).astype(np.int64).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sum": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    total: dict[str, np.ndarray] = {}
    for r in got.mapInArrow(lean(bundle), "lang string, sum binary").collect():  # a row for each language and task of a bounded sample
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["sum"], np.int64)
    names = sorted(k for k, v in total.items() if v.any())
    matrix = np.array([total[k] for k in names], float).reshape(-1, SIZE)
    return names, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine, at least 0) of every document."""
    need(docs, "doc_id", "text", "lang")
    names, matrix = prototypes(docs, rows)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            langs, scores = [], []
            for a, z in _runs(texts):
                v = _space().bundles(texts[a:z]).astype(float)
                if not names:
                    langs += ["und"] * (z - a)
                    scores += [0.0] * (z - a)
                    continue
                cosines = v @ matrix.T
                known = v.any(axis=1)
                best = cosines.argmax(axis=1)
                langs += [names[k] if y else "und" for k, y in zip(best, known)]
                scores += np.where(known, np.clip(cosines.max(axis=1), 0, 1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows_in = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows_in.mapInArrow(lean(predict), "doc_id long, held_out boolean, lang_pred string, score double")
