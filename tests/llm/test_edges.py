"""Awkward inputs: words that a weak hash confuses, null and repeated ids, hubs, long and varied texts, many sources."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from huegrid.llm import common, components, cotraining, language_id, mixing, near_dedup, packing, stats, substring_dedup, token_files, tokens

TEXTS = "doc_id long, text string"


def thue_morse(n):
    """Two words of 2**n letters that every polynomial hash modulo 2**64 takes for equal from n = 10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def hashes(*words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return common.Words(data, np.array([0, len(data)])).hashes


def test_words_are_told_apart():
    a, b = thue_morse(10)
    assert len(set(hashes(a, b, a).tolist())) == 2
    r = np.random.default_rng(0)
    words = {"".join(r.choice(list("abé"), r.integers(1, 130))) for _ in range(4000)}
    assert len(set(hashes(*words).tolist())) == len(words)
    assert hashes("ab", "x" * 60).tolist() == [hashes("ab")[0], hashes("x" * 60)[0]]  # wherever they stand


def test_complementary_words_repeat_nothing(spark):
    a, b = thue_morse(10)
    got = stats.text_counts(pa.array([f"{a}\n{b}", f"1 2 {a} 4 5 x 1 2 {b} 4 5"]))
    assert got["n_dup_lines"].tolist() == [0, 0] and got["n_repeat_words"].tolist() == [0, 0]
    fill = [f"w{k}" for k in range(34)]
    docs = spark.createDataFrame([(k, " ".join([*fill[:17], w, *fill[17:]])) for k, w in enumerate((a, b))], TEXTS)
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(docs).collect()} == {0}
    assert {r["component_id"] for r in near_dedup.near_duplicates(docs).collect()} == {0, 1}


def test_null_and_repeated_ids_lose_no_repeat(spark):
    r = np.random.default_rng(4)
    say = lambda n: " ".join(r.integers(0, 10**6, n).astype(str))
    passage = say(50)
    texts = [f"{say(5)} {passage} {say(5)}" for _ in range(6)] + [say(60)]
    docs = spark.createDataFrame([(None, t) for t in texts[:3]] + [(7, t) for t in texts[3:]] + [(7, texts[6])] * 2, TEXTS).repartition(3)
    got = Counter((x["doc_id"], x["n_words"], x["n_removed"]) for x in substring_dedup.remove_repeats(docs).collect())
    assert got == Counter({(None, 60, 50): 3, (7, 60, 50): 3, (7, 60, 60): 3})
    again = substring_dedup.without_repeats(docs)
    assert again.count() == 9


def test_one_row_of_each_group_whatever_the_ids(spark):
    r = np.random.default_rng(5)
    a, other, third = (" ".join(r.integers(0, 10**6, 80).astype(str)) for _ in range(3))
    near = a + " tail"
    rows = [(1, a), (7, near), (7, other), (None, near), (None, third), (None, third), (9, ""), (9, ""), (10, None)]
    out = near_dedup.without_near_duplicates(spark.createDataFrame(rows, TEXTS).withColumn("t", F.lit("clash")))
    assert out.columns == ["doc_id", "text", "t"]
    assert Counter((x["doc_id"], x["text"]) for x in out.collect()) == Counter([(1, a), (7, other), (None, third), (9, ""), (10, None)])


def test_hubs_and_paths(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5200)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {k: 0 for k in range(1, 3000)} | {k: 5000 for k in range(5001, 5201)}


def test_many_trigrams_in_bounded_runs(monkeypatch):
    r = np.random.default_rng(6)
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9FFF, 30_000))), "plain words here", None, "日本語 の text"]
    whole = language_id.Space(64).bundles(texts)
    monkeypatch.setattr(language_id, "SLICE", 100)
    monkeypatch.setattr(language_id, "REMEMBERED", 500)
    monkeypatch.setattr(language_id, "LETTERS", 50)
    assert np.allclose(language_id.Space(64).bundles(texts), whole, atol=1e-5)


def test_a_very_long_text_is_scored(spark):
    rows = [(k, "some plain words " * (60_000 if k == 0 else 5 + k), "s", "en", 9) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    out = cotraining.classify(docs, labels, passed=["doc_id"])
    assert out.count() == 30 and out.where("quality_score is null").isEmpty()
    assert language_id.identify(docs).count() == 30


def test_many_sources_and_rows_that_agree(spark):
    rows = [(k // 3, "w " * (1 + k % 40), f"host{k % 300}") for k in range(3000)] + [(None, "x y z", "host0")] * 50 + [(5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mix_digest(docs).toPandas()
    sums = got.groupby("source_size", as_index=False).agg(target=("target", "first"))
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all() and len(sums) > 1
    total = got["taken"].sum()
    assert abs(total - 1.5 * got["size"].sum()) <= 301
    out = mixing.mix_documents(docs)
    assert out.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == total


def test_one_doc_id_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 500)
    docs = spark.createDataFrame([(3, f"words number {k}") for k in range(200)] + [(None, None), (1, "a")], TEXTS)
    got = token_files.token_files(docs, tokens.default_path()).toPandas().sort_values("start")
    assert len(got) == 202 and list(got["start"]) == [0, *got["n_tokens"].cumsum()[:-1]]
    assert got["doc_id"].iloc[1:].is_monotonic_increasing and np.isnan(got["doc_id"].iloc[0])
    e = tokens.encoder(tokens.default_path())
    want = Counter(zlib.crc32(e.encode(t, 1).astype("<u4")) for t in [f"words number {k}" for k in range(200)] + ["", "a"])
    assert Counter(got["ids_crc32"].tolist()) == want


def test_long_reference_texts_are_cut(spark):
    words = [f"w{k}" for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(["q", *words[45:75], "z"])), (2, " ".join(words)), (3, "w1 w3 w5 w7 w9")], TEXTS)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_reference_spans(docs, [" ".join(words)], window=5, most_words=20).collect()}
    assert got == {1: "q z", 2: "", 3: "w1 w3 w5 w7 w9"}
    with pytest.raises(ValueError):
        substring_dedup.remove_reference_spans(docs, ["a"], window=5, most_words=4)


def test_a_checkpoint_folder_is_demanded_off_one_machine(spark, monkeypatch):
    from huegrid import _stage

    class Elsewhere:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("sc", (), {"getCheckpointDir": lambda self: type("o", (), {"isDefined": lambda self: False})()})()

    fake = type("s", (), {"sparkContext": Elsewhere, "conf": type("c", (), {"get": staticmethod(lambda k, d: None)})()})()
    with pytest.raises(RuntimeError):
        _stage.checkpoint_dir(fake)


def test_sequences_of_a_whole_table(spark):
    got = packing.pack_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), tokens.default_path()).select("length", "sequence_id").toPandas()
    least = max(-(-got["length"].sum() // 2048), (got["length"] > 1024).sum())
    assert got["sequence_id"].nunique() <= 1.002 * least and got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_columns_under_the_names_that_operators_use(spark):
    names = ["_", "quality_kept", "quality_score", "_near_id", "_near_t", "_rest", "_row", "_t", "t", "size", "key", "mult", "sid", "a", "z", "spans", "n_words"]
    rows = [(k, f"word{k} and some more of them {k}" if k else None, "en", f"s{k % 2}", 9) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    labels = spark.createDataFrame([(k, 1) for k in range(6)], "doc_id long, quality int")
    for f in (lambda d: cotraining.without_rejected(d, labels), near_dedup.without_near_duplicates, substring_dedup.without_repeats, mixing.mix_documents):
        out = f(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
