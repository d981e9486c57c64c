"""Queries against their SQL on whole tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from huegrid.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda it: sorted(it, key=str)
    assert rows(tuple(r) for r in got.select(columns).collect()) == rows(want.select(*columns).fetchall())


def test_targets_where_none_and_all_sources_stop(spark):
    """Sources of one size, and one that holds nearly all."""
    for many in ([("a", "x y z"), ("b", "x y z"), ("c", "x y z"), (None, "x y z")], [("a", "x " * 900), ("b", "x"), (None, None), ("c", "x y")]):
        docs = spark.createDataFrame([(k, t, s) for k, (s, t) in enumerate(many)], "doc_id long, text string, source string")
        db = duckdb.connect()
        documents = docs.toPandas()  # noqa: F841  read by name
        want = db.sql(queries.ORACLES["mix_targets"]).select("doc_id", "target").fetchall()
        from huegrid.llm.mixing import mix_digest

        got = mix_digest(docs).select("doc_id", F.round("target", 6)).collect()
        assert sorted(map(tuple, got)) == sorted(want)
