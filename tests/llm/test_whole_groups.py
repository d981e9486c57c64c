"""Near copies that a narrow signature, a low recall or a null doc_id would lose."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa

from huegrid.llm import near_dedup


def near_copies(n, words=300):
    """n texts that differ in a word each."""
    text = np.random.default_rng(3).permutation(5000).astype(str)[:words].tolist()
    return [" ".join([*text[: 9 * k], f"x{k}", *text[9 * k + 1 :]]) for k in range(n)]


def test_lists_that_agree_in_16_bits_alone_are_two(spark):
    """Nodes 1 and 2 are in two long lists of coordinate 0, whose values differ by 65,536, and in one of coordinate 1."""
    texts = near_copies(2)
    sig = [near_dedup.signature(s).tolist() for s in near_dedup.shingle_sets(pa.array(texts))]
    sig[0][0], sig[1][0], sig[1][1] = 5, 5 + (1 << 16), sig[0][1]
    size = len(next(near_dedup.shingle_sets(pa.array(texts))))
    classes = spark.createDataFrame([(1, size, sig[0]), (2, size, sig[1])], "node long, n_shingles long, sig array<int>")
    lists = [(5, 1), (5 + (1 << 16), 2), ((1 << 32) + sig[0][1], 1), ((1 << 32) + sig[0][1], 2)]
    members = spark.createDataFrame([(token, node, node, 1, 1) for token, node in lists], "token long, node long, rnode long, main long, blocks int")
    found = near_dedup._stray_links(members, classes, spark.createDataFrame(list(enumerate(texts, 1)), "node long, text string")).collect()
    assert {frozenset(r) for r in found} == {frozenset((1, 2))}


def test_few_pairs_are_missed():
    n, m = near_dedup.COORDINATES, near_dedup.MATCHES
    miss = lambda s: sum(comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(m))
    assert miss(0.75) < 3e-6 and miss(0.8) < 3e-9


def test_null_ids_beside_copies(spark):
    a, b, c = near_copies(3)
    alone = "a text without a copy of its own kind"
    rows = [(None, a), (7, a), (9, a), (3, b), (None, c), (None, alone), (20, alone), (None, "none of these words has an id"), (None, None)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    size = {t: len(s) for t, s in zip((a, b, c, alone, rows[7][1]), near_dedup.shingle_sets(pa.array([a, b, c, alone, rows[7][1]])))}
    assert got == {(None, size[a], 3, False), (7, size[a], 3, False), (9, size[a], 3, False), (3, size[b], 3, True), (None, size[c], 3, False), (None, size[alone], 20, False), (20, size[alone], 20, True), (None, size[rows[7][1]], None, True), (None, 0, None, True)}
