"""Statistics of whole texts, computed for many documents at once on their bytes.

Lines are compared by their bytes; words and windows within one document by
64-bit hashes, so two of n different ones pass for equal with a probability of
about n * n / 2**65.  Null and empty texts have every count 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import Words, mix, ngrams, text_chunks

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_MARK[list(b"!?;:\"'()[]{}=+~^@\\/_")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks", "n_bangs"]


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _repeated(owner: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs again in its owner, and whether an equal one came earlier."""
    order = np.argsort(both := mix(keys ^ mix(owner.astype(np.uint64) + _U(77))), kind="stable")
    same = both[order][1:] == both[order][:-1]
    again, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    later[order[1:]] = same
    return again, later


def _chunk_counts(data: np.ndarray, offsets: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    words = Words(data, offsets)
    owner = words.owner()
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.starts, 1)
    np.add.at(inside, words.ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": words.counts.astype(np.int64), "word_chars": _per_text(inside & ((data & 0xC0) != 0x80), offsets)}
    for name, flags in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
        out[name] = _per_text(flags[data], offsets)
    out["n_bangs"] = _per_text(data == 33, offsets)
    # lines with a word
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1)
    starts = starts[starts < len(data)]
    ends = np.append(starts[1:], len(data))[: len(starts)]
    ends = ends - ((ends > starts) & (data[ends - 1] == 10)) if len(starts) else ends
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[full], ends[full]
    line_owner = np.searchsorted(offsets, starts, "right") - 1
    raw, seen, of = data.tobytes(), set(), -1
    later = np.zeros(len(starts), bool)
    for k, (i, a, z) in enumerate(zip(line_owner.tolist(), starts.tolist(), ends.tolist())):
        if i != of:
            seen, of = set(), i
        line = raw[a:z]
        later[k] = line in seen
        seen.add(line)
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=n)
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    # words in windows found twice or more in their text
    keys = ngrams(words.hashes, window)
    valid = owner[: len(keys)] == owner[window - 1 : window - 1 + len(keys)]
    at = np.flatnonzero(valid)
    again, _ = _repeated(owner[at], keys[at])
    cover = np.zeros(len(owner) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + window, -1)
    out["n_repeat_words"] = np.bincount(owner[np.cumsum(cover[:-1]) > 0], minlength=n)
    _, later = _repeated(owner, words.hashes)
    out["n_distinct"] = out["n_words"] - np.bincount(owner[later], minlength=n)
    return {k: np.asarray(v, np.int64) for k, v in out.items()}


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every text of a column."""
    found = [_chunk_counts(data, offsets) for _, _, data, offsets in text_chunks(column)]
    return {k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in COUNTS}


FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "distinct", "upper", "digits", "marks", "bangs"]
#: Sign by which a feature may move the verdict towards keeping: -1 only down, 0 either way.
MONOTONE = [0, 0, -1, -1, -1, 0, 0, 0, 0, 0, -1]


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    lines = np.maximum(c["n_lines"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / lines, c["n_repeat_words"] / words,
        np.log1p(c["n_words"] / lines), c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars, c["n_marks"] / chars, c["n_bangs"] / words,
    ])
