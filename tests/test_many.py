"""Many images planned and separated together equal each by itself."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from huegrid import fixtures
from huegrid.operators import palette as P
from huegrid.plans import many, pipeline, workflows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def images(spark):
    px = fixtures.px(spark, SF)
    other = px.where("y < 9").withColumns({"r": F.col("b"), "b": F.col("r")})
    gray = px.withColumns({c: F.col("g") for c in "rgb"})
    parts = {"one": px, "two": other, "three": gray}
    out = None
    for k, p in parts.items():
        p = p.withColumn("image_id", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return parts, out.cache()


def test_palettes_and_detection(images):
    parts, px = images
    got = many.palettes(px, 6, 0.002).collect()
    found = {r["image_id"]: r["workflow"] for r in many.detected(px).collect()}
    for k, p in parts.items():
        want = [(*e.rgb, pytest.approx(e.coverage)) for e in P.auto_palette(p, 6, 0.002)[0]]
        assert [(r["r"], r["g"], r["b"], r["coverage"]) for r in sorted(got, key=lambda r: r["idx"]) if r["image_id"] == k] == want
        size = p.agg(F.max("x") + 1, F.max("y") + 1).first()
        assert found[k] == workflows.detect(p, tuple(size))


@pytest.mark.parametrize("workflow", ["stencil", "index_bayer"])
def test_plates(images, workflow):
    parts, px = images
    o = workflows.Options(max_colors=4)
    got = many.separate(px, many.plans(px, workflow, o)).cache()
    for k, p in parts.items():
        want = pipeline.separate(p, workflows.plan(workflow, p, o), tuple(p.agg(F.max("x") + 1, F.max("y") + 1).first())).select("layer_idx", "x", "y", "d")
        own = got.where(F.col("image_id") == k).select("layer_idx", "x", "y", "d")
        assert own.exceptAll(want).isEmpty() and want.exceptAll(own).isEmpty()
