"""Export jobs, command lines, merges, sessions and parameter ranges."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from huegrid import cli
from huegrid.functions.color import parse_hex_field
from huegrid.operators import layers as L
from huegrid.plans import domains, export, merges, pipeline, project
from huegrid.plans.layer import BLACK, WHITE, Job, Layer
from huegrid.sources import images


@pytest.fixture(scope="module")
def art(tmp_path_factory):
    """A red block and a dark one on white, 24 x 16."""
    rgb = np.full((16, 24, 3), 255, np.uint8)
    rgb[4:12, 3:10] = (220, 20, 30)
    rgb[4:12, 13:20] = (20, 20, 20)
    path = tmp_path_factory.mktemp("art") / "art.png"
    path.write_bytes(images.encode_png(rgb))
    return rgb, str(path)


def sheet(path):
    return images.decode_png(path.read_bytes())[..., 0]


LAYERS = [
    Layer(WHITE, "base", "underbase", extractor={"kind": "composite_union"}),
    Layer((220, 20, 30), "red", extractor={"kind": "spot_solid", "ink": (220, 20, 30), "tolerance": 8}, print_index=1),
    Layer(BLACK, "black", extractor={"kind": "luminance_threshold", "threshold": 128}, print_index=2, render_mode="halftone"),
    Layer((0, 0, 255), "kept back", include_in_export=False, print_index=3),
]


def test_export_all(spark, art, tmp_path):
    px, size = images.open_image(spark, art[1])
    paths = export.export_all(px, LAYERS, size, str(tmp_path / "films"), export.Film(dpi=150))
    names = [p.rpartition("/")[2] for p in paths]
    assert names == ["00_base_ffffff.png", "01_red_dc141e.png", "02_black_000000.png"]
    alone = pipeline.process_layer(pipeline.foreground.clamp_near_black(px), LAYERS[1], size, Job(150, 55.0))[1].toPandas()
    red = sheet(tmp_path / "films" / names[1])
    assert (red[alone["y"], alone["x"]] == alone["d"]).all() and (red[6:10, 5:8] == 0).all()
    base = sheet(tmp_path / "films" / names[0])
    assert (base[6:10, 5:8] == 0).all() and (base[6:10, 15:18] == 255).all()  # under the red, not under near-black
    assert b"pHYs" in (tmp_path / "films" / names[0]).read_bytes()
    assert export.export_all(px, [LAYERS[3]], size, str(tmp_path / "none")) == []


def test_export_size_marks_and_border(spark, art, tmp_path):
    px, size = images.open_image(spark, art[1])
    film = export.Film(dpi=24, width_inches=2.0, marks=export.Marks(4, 2, 1), border=export.Border(5, 10), preview_only=True)
    path = export.export_layer(px, LAYERS[1], 1, size, str(tmp_path), film)
    out = sheet(tmp_path / path.rpartition("/")[2])
    assert out.shape == (32 + 2 * 5 + 10, 48 + 2 * 5) and (out[5, 5:53] == 0).all() and (out[:5] == 255).all()
    assert out[5 + 4, 5 + 4] == 0 and out[5 + 16, 5 + 12] == 0 and out[5 + 16, 5 + 30] == 255
    blank = export.export_layer(px, LAYERS[0], 0, size, str(tmp_path), export.Film())
    assert (sheet(tmp_path / blank.rpartition("/")[2]) == 255).all()
    wrong = export.Film(foreground=px.select("x", "y", F.lit(False).alias("is_fg")), width_inches=2.0, dpi=24)
    assert export._prepared(px, size, wrong)[2] is None and export._prepared(px, size, export.Film(foreground=wrong.foreground))[2] is not None


def test_source_size_rule(spark, art):
    px, size = images.open_image(spark, art[1])
    assert L.resize_source(px, size, None, 300)[1] == size and L.resize_source(px, size, 0.08, 300)[0] is px
    out, new = L.resize_source(px, size, 0.5, 24)
    assert new == (12, 8) and out.count() == 96 and out.where("x = 3 and y = 4").select("r", "g", "b").first()["g"] < 60


def test_command_lines(spark, art, tmp_path, capsys):
    out = tmp_path / "films"
    assert cli.main(["separate", "--image", art[1], "--workflow", "black_only", "--outdir", str(out)], spark) == 0
    assert [p.name for p in out.glob("*.png")] == ["00_black_000000.png"] and "running 1 layers" in capsys.readouterr().out
    assert cli.main(["separate", "--image", art[1], "--outdir", str(out)], spark) == 0
    assert cli.main(["separate", "--image", art[1], "--workflow", "no"], spark) == 2 and cli.main(["separate"], spark) == 2
    assert cli.main(["separate", "--image", str(tmp_path / "none.png")], spark) == 1
    assert cli.main(["extract", "--image", art[1], "--out", str(tmp_path / "m.png")], spark) == 0
    px, size = images.open_image(spark, art[1])
    want = pipeline.process_layer(px, Layer(BLACK, extractor={"kind": "gcr_black"}), size)[0].toPandas()
    assert (sheet(tmp_path / "m.png")[want["y"], want["x"]] == want["d"]).all()
    assert cli.main(["extract", "--image", art[1], "--extractor", "spot_solid"], spark) == 2
    assert cli.main(["extract", "--image", art[1], "--extractor", "spot_solid", "--target", "#zz"], spark) == 2
    assert cli.main(["extract", "--image", art[1], "--extractor", "channel_calc"], spark) == 2 and cli.main(["extract", "--image", art[1], "--extractor", "no"], spark) == 2
    a = cli.parser().parse_args(["extract", "--image", "x", "--extractor", "gcr_black", "--strength", "1.5", "--invert"])
    assert cli.extractor_of(a) == {"kind": "gcr_black", "strength": 1.5, "invert_input": True}


def masks_of(spark, *sheets):
    return spark.createDataFrame([(k, x, y, int(d)) for k, s in enumerate(sheets) for y, row in enumerate(s) for x, d in enumerate(row)], "layer_idx int, x int, y int, d int")


def test_merge_same_ink(spark):
    a, b, c = (np.array(v, np.uint8).reshape(2, 2) for v in ([0, 200, 255, 255], [90, 50, 255, 10], [0, 0, 0, 0]))
    layers = [Layer((9, 9, 9), "a"), Layer((1, 2, 3), "other"), Layer((9, 9, 9), "b")]
    previews = masks_of(spark, a, c, b)
    got = merges.merge_same_ink(layers, previews, {layers[0].id, layers[2].id}, (2, 2))
    assert [x.name for x in got] == ["a", "other"] and [x.print_index for x in got] == [0, 1] and got[0].id == layers[0].id
    assert got[0].extractor == {"kind": "manual_paint", "width": 2, "height": 2, "pixels": np.minimum(a, b).tobytes()}
    assert merges.merge_same_ink(layers, previews, {layers[0].id, layers[1].id}, (2, 2)) is None
    assert merges.merge_same_ink(layers, previews, {layers[0].id}, (2, 2)) is None and merges.merge_same_ink(layers, previews, {layers[0].id, layers[2].id}, (3, 2)) is None


def test_merge_to_shadow(spark):
    light, dark = np.array([[0, 255, 0, 255]], np.uint8), np.array([[0, 0, 255, 255]], np.uint8)
    layers = [Layer((40, 40, 40), "dark"), Layer((7, 7, 7), "third"), Layer((240, 240, 240), "light")]
    got = merges.merge_to_shadow(layers, masks_of(spark, dark, light, light), {layers[0].id, layers[2].id}, (4, 1))
    assert [x.name for x in got] == ["third", "light", "light shadow"] and [x.print_index for x in got] == [0, 1, 2]
    assert got[1].extractor["pixels"] == bytes([0, 0, 0, 255])
    from huegrid.functions.color import lab_of

    kl, dl = lab_of((240, 240, 240))[0], lab_of((40, 40, 40))[0]
    assert got[2].extractor["pixels"] == bytes([255, 255 - round(255 * (kl - dl) / kl), 255, 255])
    assert (got[2].ink, got[2].kind, got[2].render_mode) == (BLACK, "shadow", "halftone")


def test_sessions(spark, art, tmp_path):
    p = project.Project(LAYERS, art[1], (1, 2, 3), Job(200, 40.0, 10.0), "duotone")
    p.save(str(tmp_path / "a.json"))
    again = project.Project.load(str(tmp_path / "a.json"))
    assert again == p
    s = project.reopen(spark, again, 4)
    assert s.generation == 5 and s.size == (24, 16) and "alpha" not in s.px.columns and s.previews.select("layer_idx").distinct().count() == 4
    gone = project.reopen(spark, project.Project(LAYERS, str(tmp_path / "none.png")))
    assert gone.px is None and gone.previews is None and gone.project.layers == LAYERS


def test_domains():
    x = Layer(BLACK, mask=domains.replace(LAYERS[0].mask, solid_blur=9.0), extractor={"kind": "spot_aa", "ink": BLACK, "targets": [BLACK], "target_weights": [40.0]})
    assert len(domains.problems(x)) == 2 and not domains.problems(domains.clamped(x))
    with pytest.raises(ValueError):
        domains.checked(x)
    assert domains.checked(LAYERS[1]) is LAYERS[1] and domains.job_problems(Job(default_lpi=10)) and not domains.job_problems(Job())
    y = domains.switched(LAYERS[1], "color_range")
    assert y.extractor == {"kind": "color_range", "target": (220, 20, 30), "fuzziness": 60.0, "falloff": "smooth"} and domains.switched(y, "color_range") is y
    assert parse_hex_field(" ##0a0B0c ", BLACK) == (10, 11, 12) and parse_hex_field("red", WHITE) == WHITE


def test_masks_of_another_size_are_left_out(spark):
    masks = masks_of(spark, np.zeros((2, 2)), np.zeros((1, 2)))
    layers = spark.createDataFrame([(0, "spot", 255, 0, 0, True, 0), (1, "spot", 0, 255, 0, True, 1)], "layer_idx int, kind string, r int, g int, b int, visible boolean, print_index int")
    px = spark.createDataFrame([(x, y, 255, 255, 255) for x in range(2) for y in range(2)], "x int, y int, r int, g int, b int")
    assert {tuple(r)[2:] for r in L.composite(masks, layers, px, size=(2, 2)).collect()} == {(255, 0, 0)}
    assert {tuple(r)[2:] for r in L.composite(masks, layers.where("false"), px).collect()} == {L.GARMENT}
    assert L.preview_size(masks) == (2, 2) and L.preview_size(masks.where("false")) == (1, 1)
    dabs = spark.createDataFrame([(1, 0, 0, 0, False, 1)], "seq int, cx int, cy int, radius int, ink boolean, layer_idx int")
    assert [tuple(r) for r in L.brush(masks, dabs).where("d = 255").collect()] == [(1, 0, 0, 255)]


def png(w, h, depth, kind, laced, rows, extra=b""):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, laced)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_kinds(spark):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    bits = images.decode_png(png(5, 2, 1, 0, 0, bytes([0, 0b10101000, 0, 0b01010000])))
    assert bits[..., 0].tolist() == [[255, 0, 255, 0, 255], [0, 255, 0, 255, 0]]
    deep = images.decode_png(png(2, 1, 16, 0, 0, bytes([0]) + struct.pack(">HH", 65535, 300)))
    assert deep[0, :, 0].tolist() == [255, 1]
    pal = images.decode_png(png(2, 1, 8, 3, 0, bytes([0, 1, 0]), chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])) + chunk(b"tRNS", bytes([7]))))
    assert pal[0].tolist() == [[4, 5, 6, 255], [1, 2, 3, 7]]
    keyed = images.decode_png(png(2, 1, 8, 0, 0, bytes([0, 9, 8]), chunk(b"tRNS", struct.pack(">H", 9))))
    assert keyed[0, :, 3].tolist() == [0, 255]
    # interlaced: the passes of a 5 x 5 gray image
    want = np.arange(25, dtype=np.uint8).reshape(5, 5)
    rows = b"".join(b"\0" + part.tobytes() for x0, y0, dx, dy in images._PASSES for part in want[y0::dy, x0::dx] if len(part))
    assert (images.decode_png(png(5, 5, 8, 0, 1, rows))[..., 0] == want).all()
    # every row filter, against what the JVM decodes
    r = np.random.default_rng(0)
    plain = r.integers(0, 256, (5, 21), np.int64)
    out, above = b"", np.zeros(21, np.int64)
    for kind, line in enumerate(plain):
        left, corner = np.append([0, 0, 0], line[:-3]), np.append([0, 0, 0], above[:-3])
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (0 * line, left, above, (left + above) // 2, near)[kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    assert (images.decode_png(png(7, 5, 8, 2, 0, out))[..., :3].reshape(5, 21) == plain).all()


def test_undecodable_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(images.encode_png(np.zeros((2, 2), np.uint8)))
    (tmp_path / "b.jpg").write_bytes(b"no image")
    assert [r["path"].rpartition("/")[2] for r in images.undecodable(spark, str(tmp_path)).collect()] == ["b.jpg"]
    with pytest.raises(Exception, match="no image that can be decoded"):
        images.read_images(spark, str(tmp_path)).count()
    jvm = spark.sparkContext._jvm  # a TIFF file by the JVM's own encoder
    sheet = jvm.java.awt.image.BufferedImage(3, 2, jvm.java.awt.image.BufferedImage.TYPE_3BYTE_BGR)
    sheet.setRGB(1, 0, 0x0A0B0C)
    if jvm.javax.imageio.ImageIO.write(sheet, "tiff", jvm.java.io.File(str(tmp_path / "c.tif"))):
        px, size = images.open_image(spark, str(tmp_path / "c.tif"))
        assert size == (3, 2) and tuple(px.where("i = 1").select("r", "g", "b").first()) == (10, 11, 12)


def test_captions(spark):
    layer = Layer((255, 0, 0), "red", render_mode="halftone")
    assert images.format_caption(layer, 0, 52.5) == "01  red  #FF0000  halftone  53lpi"
    sheet = spark.range(200 * 60).select(F.lit(0).alias("layer_idx"), (F.col("id") % 200).cast("int").alias("x"), F.floor(F.col("id") / 200).cast("int").alias("y"), F.lit(255).alias("d"))
    got = images.captioned(sheet, (150, 10), {0: layer}, 55.0, margin=2)
    assert got.count() == 200 * 60 and (images.find_font() is None) == got.where("d < 255").isEmpty()
    assert images.find_font(("/no/font.ttf",)) is None and images.caption_pixels(spark, "x", "/no/font.ttf", 14.0) == []


def test_trailing_text_of_an_expression_is_ignored(spark):
    from huegrid.functions import dsl
    from huegrid.operators import extract as E

    px = spark.createDataFrame([(0, 0, 0, 255, 0, 0)], "i int, x int, y int, r int, g int, b int")
    assert E.extract(px, {"kind": "channel_calc", "expr": "R G"}).first()["d"] == 0
    with pytest.raises(dsl.DslError):
        dsl.parse("R G")
