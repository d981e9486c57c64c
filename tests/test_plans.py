"""Planners, pipeline, files, projects, history, streams and the SQL oracles."""

from __future__ import annotations

import json
import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from huegrid import fixtures
from huegrid.plans import pipeline, project, workflows
from huegrid.plans.layer import BLACK, History, Layer, deleted, moved
from huegrid.sources import images
from huegrid.streaming import edits

SF = "/root/testdata/sf0.001"


def test_workflows_plan(spark):
    px = fixtures.px(spark, SF)
    counts = {w: len(workflows.plan(w, px)) for w in workflows.LABELS}
    assert counts["cmyk_process_light"] == 5 and counts["cmyk_process_dark"] == 6 and counts["duotone"] == 2 and counts["tritone"] == 3
    assert counts["single_halftone"] == counts["black_only"] == counts["stencil"] == 1
    assert counts["simprocess_dark"] == counts["simprocess_light"] + 1 and counts["index_fs"] == counts["index_bayer"] > 2
    with pytest.raises(ValueError):
        workflows.plan("nothing", px)
    assert workflows.choose(0, 0, 0, 0) == "spot" and workflows.choose(10, 55, 0, 9) == "index_bayer" and workflows.choose(300_000, 55, 0, 9) == "simprocess_dark"
    assert workflows.detect(px, fixtures.size(spark, SF)) in workflows.LABELS


def test_union_layer_runs_second_and_follows_the_others(spark):
    px, size = fixtures.px(spark, SF), fixtures.size(spark, SF)
    layers = workflows.plan("cmyk_process_dark", px)
    f = pipeline.separate(px, layers, size, processed=False).groupBy("layer_idx").agg(F.count("*").alias("n"), F.min("d").alias("least")).orderBy("layer_idx").toPandas()
    assert list(f["layer_idx"]) == list(range(6)) and (f["n"] == 1500).all() and f["least"][0] == 0


def test_identity_layer_is_its_extraction(spark):
    px, size = fixtures.px(spark, SF), fixtures.size(spark, SF)
    layer = Layer(BLACK, extractor={"kind": "luminance_threshold", "threshold": 128, "above": False})
    layer = replace(layer, mask=replace(layer.mask, solid_blur=0.0))
    preview, final = pipeline.process_layer(px, layer, size)
    want = pipeline.E.extract(px, layer.extractor)
    assert preview.exceptAll(want).isEmpty() and final.exceptAll(want).isEmpty()


@pytest.mark.parametrize("workflow", ["spot", "index_bayer"])
def test_layers_carried_out_together_equal_those_alone(spark, workflow):
    px, size = fixtures.px(spark, SF), fixtures.size(spark, SF)
    layers = workflows.plan(workflow, px, workflows.Options(max_colors=3))
    together = pipeline.separate(px, layers, size).select("layer_idx", "x", "y", "d")
    src = pipeline.foreground.clamp_near_black(px)
    for i in (0, len(layers) - 1):
        alone = pipeline.process_layer(src, layers[i], size)[1].select("x", "y", "d")
        own = together.where(F.col("layer_idx") == i).select("x", "y", "d")
        assert own.exceptAll(alone).isEmpty() and alone.exceptAll(own).isEmpty()


def test_png_round_trip_and_resolution(spark, tmp_path):
    a = np.random.default_rng(0).integers(0, 256, (5, 7), np.uint8)
    data = images.encode_png(a, 300)
    at = data.index(b"pHYs")
    assert struct.unpack(">IIB", data[at + 4 : at + 13]) == (11811, 11811, 1)
    assert (images.decode_png(data)[..., 0] == a).all()
    rgb = np.random.default_rng(1).integers(0, 256, (4, 3, 3), np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(images.encode_png(rgb))
    for read in (images.read_png, images.read_images):
        f = read(spark, f"file://{tmp_path}/in").orderBy("i").toPandas()
        assert (f[["r", "g", "b"]].to_numpy().reshape(4, 3, 3) == rgb).all() and (f["alpha"] == 255).all(), read
    with pytest.raises(ValueError):
        images.decode_png(b"GIF89a")


def test_films_are_written(spark, tmp_path):
    plates = spark.createDataFrame([(k, x, y, 255 * ((x + y + k) % 2)) for k in range(2) for x in range(4) for y in range(3)], "layer_idx int, x int, y int, d int")
    layers = [Layer((255, 0, 16), "a b/c", print_index=3), Layer(BLACK, "k")]
    paths = images.write_films(images.png_films(plates, layers, 72), f"file://{tmp_path}/films")
    assert sorted(p.rpartition("/")[2] for p in paths) == ["00_k_000000.png", "03_a_b_c_ff0010.png"]
    assert images.decode_png((tmp_path / "films" / "00_k_000000.png").read_bytes()).shape == (3, 4, 4)


def test_furniture(spark):
    sheet = spark.range(200 * 200).select((F.col("id") % 200).alias("x"), F.floor(F.col("id") / 200).alias("y"), F.lit(255).alias("d"))
    marked = images.registration_marks(sheet, (200, 200))
    assert marked.where("x = 48 and y = 48").first()["d"] == 0 and marked.where("x = 100 and y = 100").first()["d"] == 255
    out, size = images.film_border(sheet.where("x < 10 and y < 5"), (10, 5))
    assert size == (58, 109) and out.count() == 58 * 109 and out.where("d = 0").count() == 2 * (10 + 5) - 4
    layer = Layer((255, 0, 0), "red", render_mode="halftone")
    assert images.format_caption(layer, 0, 55) == "01  red  #FF0000  halftone  55lpi"


def test_contact_sheet(spark):
    masks = spark.range(12).select(F.lit(0).alias("layer_idx"), (F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"), F.lit(0).alias("d"))
    out, size = images.contact_sheet(masks, [Layer((250, 0, 0)), Layer(BLACK, visible=False)], (4, 3), columns=2, cell=20, padding=4)
    assert size == (52, 52) and out.count() == 52 * 52
    assert tuple(out.where("x = 14 and y = 14").first())[2:] == (250, 0, 0) and tuple(out.where("x = 0 and y = 0").first())[2:] == (20, 20, 24)


def test_project_round_trip(spark, tmp_path):
    layers = workflows.plan("tritone", fixtures.px(spark, SF)) + [Layer(BLACK, extractor={"kind": "manual_paint", "width": 1, "height": 2, "pixels": b"\x00\xff"})]
    text = project.to_json(layers, "x.png")
    assert project.from_json(text) == (layers, "x.png")
    old = json.loads(text)
    for x in old["layers"]:
        del x["mask"]["solid_blur"]
    assert project.from_json(json.dumps(old))[0][0].mask.solid_blur == 1.5
    with pytest.raises(project.ProjectError):
        project.from_json(text.replace('"version": 1', '"version": 2'))
    (tmp_path / "p.json").write_text(text)
    assert project.read_projects(spark, f"file://{tmp_path}/p.json").count() == 4


def test_history_and_list_edits():
    h = History()
    for k in range(74):
        h.push([Layer(BLACK, str(k))], k)
    assert len(h.past) == 64
    now = ([], None)
    back = h.undo(now)
    assert back[1] == 73 and h.redo(back) == now
    h.undo(now)
    h.push([], 0)
    assert not h.future and h.redo(now) is None
    layers = [Layer(BLACK, n) for n in "abc"]
    assert [x.name for x in moved(layers, 0, 1)] == ["b", "a", "c"] and [x.name for x in moved(layers, 0, -1)] == ["a", "b", "c"]
    assert [x.print_index for x in deleted(layers, 1, 2)[0]] == [0, 1] and deleted(layers, 1, 2)[1] == 1


def test_edit_stream_equals_batch(spark, tmp_path):
    rows = fixtures.edits(spark, SF)
    rows.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    edits.stream_latest(stream, "newest").awaitTermination(120)
    want = edits.latest(rows)
    assert spark.table("newest").exceptAll(want).isEmpty() and want.exceptAll(spark.table("newest")).isEmpty()
    edits.stream_upsert(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    got = edits.merged(spark.read.parquet(f"file://{tmp_path}/out")).select(want.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_cascade(spark):
    unions = spark.createDataFrame([(0,)], "layer_idx int")
    got = edits.cascade(spark.createDataFrame([(2,), (2,)], "layer_idx int"), unions).orderBy("pass").collect()
    assert [tuple(r) for r in got] == [(2, 1), (0, 2)]


ORACLE_SAMPLE = ["stencil_coverage", "lab_values", "spot_aa_plate", "gaussian_15", "halftone_round", "white_noise", "composite", "shadow_merge", "flood_fill", "edit_stream_latest", "color_name_cube"]


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_against_sql(spark, name):
    import duckdb

    from huegrid.oracles import ORACLES
    from huegrid.queries import QUERIES

    con = duckdb.connect()
    for t in ("orders", "part", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    a, b = (f[columns].sort_values(columns).reset_index(drop=True) for f in (got, want))
    for c in columns:
        assert (a[c].astype(float) == b[c].astype(float)).all() if a[c].dtype.kind in "if" else (a[c] == b[c]).all()


def test_every_oracle_has_a_query():
    from huegrid.oracles import ORACLES
    from huegrid.queries import QUERIES

    assert set(ORACLES) <= set(QUERIES)
