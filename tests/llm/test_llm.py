"""Operators against brute force, exact round trips and held-out accuracy, with the awkward cases in the inputs."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from huegrid.llm import components, cotraining, embedding_dedup, html_blocks, html_crf, language_id, mixing, near_dedup, packing, quality_rules, stats, substring_dedup, token_files, tokens
from huegrid.llm.suffix_automaton import SuffixAutomaton

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns under names that the operators use themselves.
CLASHES = ("key", "node", "size", "block", "start", "length", "root", "_id", "kept", "token", "sid", "spans", "h1", "n_words", "piece")


def words_of(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def corpus(seed=0, copies=True):
    r = np.random.default_rng(seed)
    vocabulary = ["".join(r.choice(list("abcdeéß"), r.integers(1, 7))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(vocabulary, n))
    passage, line, rows = say(60), say(6), []
    for i in range(90):
        rows.append(f"{say(r.integers(1, 200))}\n{line}" if i % 3 else say(r.integers(1, 30)))
    if copies:
        long = say(400).split()
        for i in range(75):  # near copies, more than a short list holds
            t = list(long)
            for k in r.integers(0, 400, 6):
                t[k] = f"x{i}"
            rows.append(" ".join(t))
        rows += [rows[3]] * 4 + [f"{say(9)} {passage} {say(9)}" for _ in range(6)]
        rows += ["same " * 300, "a b c d e f g " * 30, "tiny", "tiny", "Tiny", "two words", "  ", "", None, None, "x" * 70_000, say(9000)]
    docs = [(i, t, [None, "en", "de"][i % 3], [None, "s0", "s0", "s1"][i % 4], None if t is None else len(t)) for i, t in enumerate(rows)]
    return docs + [docs[5], (7, "another text under a repeated id", "en", "s1", 3)] * copies


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ tokens


def test_encoder_equals_the_library():
    e = tokens.encoder(tokens.default_path())
    for t in ["", " ", "don't STOP we'll", "a<|endoftext|>b", "x́ é ΣΑΣ", "12½² ﬁ ###!!'s", "a　b\x85c\x1cd", "İSTANBUL ß", "日本 語", "'real 'll"]:
        assert e.encode(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert e.encode(None, 1).tolist() == [1]


def test_token_files(spark, docs, empty):
    got = token_files.token_files(docs, tokens.default_path()).toPandas()
    e = tokens.encoder(tokens.default_path()).tokenizer
    want = Counter()
    for r in docs.collect():
        ids = np.array(e.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want[(r["doc_id"], len(ids), zlib.crc32(ids))] += 1
    assert Counter(got[["doc_id", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == want
    got = got.sort_values("start")
    assert got["doc_id"].is_monotonic_increasing and list(got["start"]) == [0, *got["n_tokens"].cumsum()[:-1]]
    assert token_files.token_files(empty, tokens.default_path()).count() == 0


# ------------------------------------------------------------------ packing


def test_packing(spark, docs, empty):
    got = packing.pack_documents(docs, tokens.default_path()).toPandas()
    e = tokens.encoder(tokens.default_path()).tokenizer
    want = Counter()
    for r in docs.collect():
        ids = np.array(e.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[(r["doc_id"], k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048]))] += 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 2048 and list(s["offset"]) == [0, *s["length"].cumsum()[:-1]]
    least = max(got["length"].sum() / 2048, (got["length"] > 1024).sum())  # two pieces over half do not share a sequence
    assert got["sequence_id"].nunique() <= 1.005 * least + 1
    assert packing.pack_documents(empty, tokens.default_path()).count() == 0


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    fit = packing.BestFit(10, open_bins=2)
    assert [fit.add(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    fit = packing.BestFit(10, open_bins=2)
    [fit.add(n) for n in (6, 7, 8)]  # the bin with 8 closes
    assert fit.add(2) == (1, 7) and fit.open == 2


# ------------------------------------------------------------------ near duplicates


def brute_components(sets):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def test_near_duplicates(spark, docs, empty, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = words_of((r["text"] or "").translate(fold))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    roots = brute_components(sets)
    least = {}
    for r, k in zip(rows, roots):
        least[k] = min(r["doc_id"], least.get(k, 1 << 60))
    want = Counter((r["doc_id"], len(s), least[k], r["doc_id"] == least[k]) for r, s, k in zip(rows, sets, roots))
    got = near_dedup.near_duplicates(docs).toPandas()
    assert Counter(got.itertuples(index=False, name=None)) == want
    assert near_dedup.near_duplicates(empty).count() == 0
    out = near_dedup.without_near_duplicates(docs)
    assert out.columns == docs.columns and out.where("text = 'tiny'").count() == 1


def test_strays_of_long_lists_are_linked():
    """A chain: each member is linked to the next alone, and all share a list."""
    r = np.random.default_rng(2)
    text = r.permutation(4000).astype(str).tolist()
    chain = [" ".join(text[k * 20 : k * 20 + 200]) for k in range(12)]
    import pyarrow as pa

    sets = list(near_dedup.shingle_sets(pa.array(chain)))
    sig = [near_dedup.signature(s) for s in sets]
    f = pd.DataFrame({
        "token": 0, "i": 0, "j": 0, "coordinate": 0, "node": np.arange(12), "rnode": np.arange(12), "block": 0, "n_shingles": [len(s) for s in sets],
        "stray": [False] + [True] * 11, "data": [s.astype(np.uint16).tobytes() for s in sig], "low": (1 << 48) - 1, "high": (1 << 48) - 1, "text": chain,
    })
    got = components.forest(near_dedup._linked(f).itertuples(index=False, name=None))
    assert set(got.values()) == {0} and len(got) == 12


def test_components(spark):
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 440)]
    got = {row["node"]: row["root"] for row in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {x: root for x, root in components.forest(edges).items() if x != root}


# ------------------------------------------------------------------ substrings


def brute_repeats(texts, window):
    lists = [words_of(t) for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in lists for k in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [1, 256])
def test_repeats(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([r["text"] for r in rows], 35)))
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text").toPandas()
    assert Counter(got.itertuples(index=False, name=None)) == want
    if hot == 1:
        assert substring_dedup.remove_repeats(empty).count() == 0
        out = substring_dedup.without_repeats(docs)
        assert out.columns == docs.columns and out.count() == docs.count()


def test_suffix_automaton_counts():
    r = np.random.default_rng(0)
    texts = [r.integers(0, 3, r.integers(1, 30)).tolist() for _ in range(12)]
    a = SuffixAutomaton()
    for k, t in enumerate(texts):
        a.add(t, 1 + k % 2)
    a.finish()
    for t in texts:
        for n in (1, 2, 4):
            for end, (long, count) in enumerate(a.matching(t, n), 1):
                part = t[max(0, end - n) : end]
                assert long == len(part)
                if long == n:
                    assert count == sum((1 + k % 2) * sum(u[i : i + n] == part for i in range(len(u) - n + 1)) for k, u in enumerate(texts))


def test_reference_spans(spark):
    df = spark.createDataFrame([(1, "q a b c d z"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = substring_dedup.remove_reference_spans(df, ["x a b c d y", "c d z"], window=3, most_words=4).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["q", "", None]


# ------------------------------------------------------------------ embeddings


def test_embedding_links(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(6, 64))
    rows = [(i, (base[i % 6] + r.normal(size=64) * (0.05 + 0.3 * (i % 4 == 0))).tolist()) for i in range(160)]
    rows += [(200 + i, rows[0][1]) for i in range(5)] + [(0, rows[3][1]), (300, None), (301, [0.0] * 64), (302, [float("nan")] * 64), (303, [1.0, None]), (304, []), (305, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1))
    ok = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v)]
    x = np.array([rows[k][1] for k in ok], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    roots = components.forest((int(a), int(b)) for a, b in zip(*np.nonzero(near)))
    least = {}
    for k in range(len(ok)):
        least[roots[k]] = min(rows[ok[k]][0], least.get(roots[k], 1 << 60))
    want = Counter((rows[ok[k]][0], int(near[k].sum()) - 1, least[roots[k]]) for k in range(len(ok)))
    want += Counter((v, 0, v) for v in (300, 301, 302, 303, 304, 305))
    got = embedding_dedup.embedding_links(df).toPandas()
    assert Counter(got[["vec_id", "n_links", "component_id"]].itertuples(index=False, name=None)) == want
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()
    assert embedding_dedup.embedding_links(df.where("false")).count() == 0


def brute_links(rows, threshold=0.9):
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T >= threshold


def test_recall_with_long_keys(spark):
    """Keys of 12 bits, as a million vectors have them, on the 2,000 of the table: the share of links found."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    near = brute_links(df.select("vec_id", "embedding").toPandas().itertuples(index=False, name=None))
    _, tables = embedding_dedup.plan_bits(256 << 12)
    got = embedding_dedup.embedding_links(df, bits=12, tables=tables).agg(F.sum("n_links")).first()[0]
    assert 0.999 * (near.sum() - len(near)) <= got <= near.sum() - len(near)


def test_null_vec_ids_and_one_bucket(spark, monkeypatch):
    """All vectors in one bucket of several blocks; copies, a null id beside others and alone, a pair at the threshold itself."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(5)
    base = r.normal(size=8)
    rows = [(k, (base + 0.1 * r.normal(size=8)).tolist()) for k in range(60)] + [(None, rows_copy) for rows_copy in [(base + 0.1).tolist()]] + [(None, (-base).tolist()), (70, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    roots = components.forest((int(a), int(b)) for a, b in zip(*np.nonzero(near)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[k]] = min(i, least.get(roots[k], 1 << 60))
    want = Counter((rows[k][0], int(near[k].sum()) - 1, least.get(roots[k]), rows[k][0] == least.get(roots[k])) for k in range(len(rows)))
    got = embedding_dedup.embedding_links(df, bits=1, tables=20).collect()
    assert Counter(map(tuple, got)) == want
    exact = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [2.9, 4.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["n_links"] for r in embedding_dedup.embedding_links(exact, threshold=0.6).collect()} == {1: 1, 2: 2, 3: 1}


def test_estimates_are_unbiased():
    r = np.random.default_rng(0)
    a, b = r.normal(size=(2, 64))
    a, b = a / np.linalg.norm(a), (a + 0.8 * b / np.linalg.norm(b))
    b /= np.linalg.norm(b)
    found = []
    for seed in range(600):
        turn = embedding_dedup.Coder(64, 8, 1, seed).turns[0]
        code = np.where(a @ turn >= 0, 1, -1) / 8
        found.append(code @ (b @ turn) / (code @ (a @ turn)))
    assert abs(np.mean(found) - a @ b) < 0.02


# ------------------------------------------------------------------ mixing


def test_mixing(spark, docs, empty):
    got = mixing.mix_digest(docs).toPandas()
    rows = docs.select("doc_id", "text", "source").toPandas()
    rows["size"] = rows["text"].map(lambda t: len(words_of(t)))
    assert Counter(got[["doc_id", "size"]].itertuples(index=False, name=None)) == Counter(rows[["doc_id", "size"]].itertuples(index=False, name=None))
    assert (got["taken"] <= 2 * got["size"]).all()
    sizes = rows.groupby(rows["source"].fillna("~"))["size"].sum()
    goal = mixing.targets(sizes.tolist(), [5, 2, 1])
    assert sum(goal) == pytest.approx(1.5 * sizes.sum()) and all(g <= 2 * s for g, s in zip(goal, sizes))
    for size, target in zip(sizes, goal):
        own = got[got["source_size"] == size]
        assert own["target"].iloc[0] == pytest.approx(target) and abs(own["taken"].sum() - target) <= 1
    again = mixing.mix_digest(docs.repartition(5)).toPandas()
    assert Counter(again.itertuples(index=False, name=None)) == Counter(got.itertuples(index=False, name=None))
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    taken = out.select(F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).alias("n")).agg(F.sum("n")).first()[0]
    assert taken == got["taken"].sum()
    assert mixing.mix_digest(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_permutations_and_shards():
    for n in (1, 2, 5, 64, 1000):
        x = np.arange(n)
        y = mixing.permuted(x, np.full(n, n), np.full(n, 9))
        assert sorted(y) == list(range(n)) and (mixing.permuted(y, np.full(n, n), np.full(n, 9), inverse=True) == x).all()
    tree = mixing.ShardTree([1000, 0, 300], 128)
    plan = list(tree.counts(0, tree.shards))
    assert [h for h, _, _ in plan] == list(range(11)) and sum(c for _, _, c in plan).tolist() == [1000, 0, 300]
    assert all(c.sum() == min(128, 1300 - 128 * h) for h, _, c in plan) and len({c[2] for _, _, c in plan}) > 3
    assert all((b == sum((c for _, _, c in plan[:h]), np.zeros(3, int))).all() for h, b, _ in plan)
    assert [x[2].tolist() for x in tree.counts(4, 7)] == [x[2].tolist() for x in plan[4:7]]


# ------------------------------------------------------------------ statistics and quality


def test_counts(docs):
    import pyarrow as pa

    texts = [r["text"] for r in docs.collect()] + ["a\na\n\n a\na", "x y\nx y\nz", "é#|<\n# #"]
    got = stats.text_counts(pa.array(texts))
    for k, t in enumerate(texts):
        w, lines = words_of(t), [x for x in (t or "").split("\n") if words_of(x)]
        five = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        marked = {i + j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(5)}
        want = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked)]
        assert [got[c][k] for c in stats.COUNTS[:5]] == want, t


def test_monotone_trees():
    r = np.random.default_rng(0)
    x = r.random((1500, 3))
    y = ((x[:, 0] + 0.3 * r.normal(size=1500) < 0.5) & (x[:, 1] < 0.8)).astype(float)
    model = quality_rules.fit(x, y, [-1, 0, 1])
    probe = r.random((200, 3))
    for feature, sign in ((0, -1), (2, 1)):
        margins = []
        for v in np.linspace(0, 1, 21):
            p = probe.copy()
            p[:, feature] = v
            margins.append(model.margin(p))
        assert (sign * np.diff(margins, axis=0) >= -1e-12).all()
    assert ((model.margin(x) > 0) == y).mean() > 0.8
    assert (quality_rules.fit(x, np.ones(1500), [0, 0, 0]).margin(x) > 0).all()


def test_quality_operators(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    test = labels.where(fold)
    rules = quality_rules.quality_rules(real, labels.where(~fold)).join(test, "doc_id").toPandas()
    clean = rules[(rules["quality"] == 1) & ~rules["base_failed"]]
    assert clean["kept"].mean() > 0.97 and (rules[rules["quality"] == 0]["kept"]).mean() < 0.1
    scored = cotraining.classify(real, labels.where(~fold), passed=["doc_id"]).join(test, "doc_id").toPandas()
    assert (scored["quality_kept"] == (scored["quality"] == 1)).mean() > 0.95
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert quality_rules.quality_rules(docs, odd).count() == docs.count()
    kept = cotraining.classify(docs, odd)
    assert kept.where("quality_kept").count() == docs.count() and kept.columns[: len(docs.columns)] == docs.columns
    assert quality_rules.quality_rules(empty, labels).count() == 0 and cotraining.classify(empty, labels).count() == 0


# ------------------------------------------------------------------ languages


def test_language(spark, docs, empty):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(real).join(real.select("doc_id", "lang"), "doc_id").toPandas()
    held = got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    assert (got["held_out"] == held).all() and (got[held]["lang"] == got[held]["lang_pred"]).mean() > 0.99 and got["score"].between(0, 1).all()
    odd = language_id.identify(docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, "12 ## !").otherwise(F.col("text")))).toPandas()
    assert set(odd[odd["doc_id"] % 2 == 0]["lang_pred"]) == {"und"} and len(odd) == docs.count()
    assert language_id.identify(empty).count() == 0
    unlabelled = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.where("lang_pred <> 'und' or score <> 0").isEmpty()


def test_trigram_vectors_bind_rolled_letters():
    s = language_id.Space(256)
    a, b, c = (s.letter(ord(x)).astype(int) for x in "abc")
    blank = s.letter(32).astype(int)
    whole = sum(np.roll(p, 2) * np.roll(q, 1) * r for p, q, r in ((blank, a, b), (a, b, c), (b, c, blank)))
    assert s.bundles(["Abc!"])[0] == pytest.approx(whole / np.linalg.norm(whole), abs=1e-6)


# ------------------------------------------------------------------ pages


def test_pages(spark):
    crf = html_crf.trained()
    pages = html_crf.labelled_pages(80, seed=99)  # not those it was fitted on
    right = [a == b for blocks, labels in pages for a, b in zip(crf.decode(blocks), labels)]
    assert np.mean(right) > 0.99
    rows = [
        (1, "u", "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One\n two.<p>Three<br>four &eacute;.</article><footer>&copy; x</footer></body>"),
        (2, None, None), (3, "u", ""), (4, "u", "<script>var a = '<p>no</p>'</script><style>p{}</style>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_crf.extract_main_text(df).collect()}
    want = "A & B\n\nOne two.\n\nThree four é."
    assert got == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("", 0)}
    assert html_crf.extract_main_text(df.where("false")).count() == 0


def test_viterbi_is_the_best_of_all_paths():
    r = np.random.default_rng(0)
    blocks = [html_blocks.Block(f"w{k}", html_blocks.Element("p"), 0) for k in range(6)]
    names = {n: k for k, n in enumerate({n for f in html_crf.block_features(blocks) for n in f})}
    for _ in range(20):
        crf = html_crf.Crf(names, r.normal(size=len(names)), r.normal(size=(2, 2)), r.normal(size=2))
        state = [sum(crf.weights[names[n]] for n in f) for f in html_crf.block_features(blocks)]
        score = lambda p: crf.begin[p[0]] + sum(s * y for s, y in zip(state, p)) + sum(crf.moves[a, b] for a, b in zip(p, p[1:]))
        assert score(crf.decode(blocks)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=6))))


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        before, after = docs.toPandas(), out.toPandas()
        if name in ("quality_classifier", "minhash_near_dedup"):
            assert set(after["doc_id"]) < set(before["doc_id"]) and after["doc_id"].is_unique
        if name == "substring_dedup":
            want = {d: x for d, x in zip(before["doc_id"], brute_repeats(before["text"], 35))}
            assert all(words_of(t) == want[d][2].split() for d, t in zip(after["doc_id"], after["text"]))
        docs = out
    total = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == total
    assert hashlib.sha256(str(corpus_pipeline.run(spark, SF).count()).encode()).hexdigest() == hashlib.sha256(str(packed.count()).encode()).hexdigest()
