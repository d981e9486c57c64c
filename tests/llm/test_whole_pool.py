"""Pseudo-labels come from all unlabelled documents."""

from __future__ import annotations

import numpy as np

from huegrid.llm import cotraining


def test_the_surest_of_more_than_4000_unlabelled(spark):
    """The only sure documents are the 30 of largest hash among 6,000, whose share no sample of smallest hashes holds."""
    from pyspark.sql import functions as F

    ids = [r["id"] for r in spark.range(6000).orderBy(F.xxhash64("id"), "id").collect()]
    last = set(ids[-30:])
    rows = [(i, "a few words", "rare" if i in last else "common", "en", 11) for i in ids] + [(10_000 + i, "labelled", "rare", "en", 11) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(10_000 + i, 1) for i in range(40)], "doc_id long, quality int")
    views = cotraining._views(docs)
    meta = cotraining.metadata_view(["rare", "common"], ["en", "en"], [11, 11])

    class Rare:
        def __init__(self, x):
            self.row = x

        def margin(self, x):
            return 9.0 * (np.abs(x - self.row).sum(axis=1) == 0)

    models = {"text": Rare(np.full(cotraining._NT, -1, np.float32)), "meta": Rare(meta[0])}
    found = cotraining._surest(views, labels)(models, {"text": set(), "meta": set(ids[-5:])})
    assert set(found["meta"][0]) == last - set(ids[-5:]) and (found["meta"][3] == 1).all() and found["text"][0] == []
    assert (found["meta"][2] == meta[0]).all() and len(found["meta"][1]) == 25
