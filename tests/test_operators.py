"""Properties on hand-built pixels and masks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from huegrid.functions import color as C
from huegrid.functions import dsl, tone
from huegrid.operators import extract as E
from huegrid.operators import foreground as G
from huegrid.operators import layers as L
from huegrid.operators import neighborhood as M
from huegrid.operators import palette as P
from huegrid.operators import raster as R


def pixels(spark, rows):
    """rows: lists of colours."""
    flat = [(y * len(row) + x, x, y, *c) for y, row in enumerate(rows) for x, c in enumerate(row)]
    return spark.createDataFrame(flat, "i long, x long, y long, r long, g long, b long")


def mask(spark, a):
    return spark.createDataFrame([(x, y, int(v)) for y, row in enumerate(a) for x, v in enumerate(row)], "x long, y long, d int")


def grid(df, column="d"):
    f = df.toPandas()
    out = np.full((f["y"].max() + 1, f["x"].max() + 1), -1)
    out[f["y"], f["x"]] = f[column]
    return out


def test_lab_known_values_and_round_trip(spark):
    colors = [(255, 255, 255), (0, 0, 0), (255, 0, 0), (12, 200, 99)]
    lab = C.with_lab(pixels(spark, [colors]))
    rows = lab.orderBy("x").collect()
    assert rows[0]["l"] == pytest.approx(100, abs=0.1) and rows[1]["l"] == pytest.approx(0, abs=0.01)
    assert (rows[2]["l"], rows[2]["a"], rows[2]["b_"]) == pytest.approx((53.2, 80.1, 67.2), abs=0.3)
    for row, c in zip(rows, colors):
        assert C.lab_of(c) == pytest.approx((row["l"], row["a"], row["b_"]), abs=1e-9)
        assert np.abs(np.array(C.rgb_of(C.lab_of(c))) - c).max() <= 2
    back = lab.select("x", *C.lab_to_rgb(F.col("l"), F.col("a"), F.col("b_"))).orderBy("x").collect()
    assert all(max(abs(u - v) for u, v in zip(b[1:], c)) <= 2 for b, c in zip(back, colors))


def test_hex():
    assert C.parse_hex("#FF8000") == C.parse_hex("ff8000") == (255, 128, 0)
    for bad in ("#FFF", "GG0000", ""):
        with pytest.raises(C.HexError):
            C.parse_hex(bad)


def test_hex_column(spark):
    got = spark.createDataFrame([("#0aFF10",), ("12345",), ("zz0000",), (None,)], "h string").select(C.rgb_from_hex("h").alias("c")).collect()
    assert tuple(got[0]["c"]) == (10, 255, 16) and [r["c"] for r in got[1:]] == [None] * 3


def test_names_agree_with_the_planner(spark):
    from huegrid.plans.workflows import name_of

    colors = [tuple(c) for c in np.random.default_rng(3).integers(0, 256, (400, 3)).tolist()]
    got = pixels(spark, [colors]).select("x", C.color_name().alias("n")).orderBy("x").collect()
    assert [r["n"] for r in got] == [name_of(c) for c in colors]


def test_curves():
    assert tone.build_lut([]) is None and tone.build_lut(tone.IDENTITY) is None
    for curve in tone.CURVES.values():
        lut = tone.build_lut(curve)
        assert lut == sorted(lut) and all(lut[x] == y for x, y in curve)
    assert tone.build_lut([(10, 5), (10, 50), (200, 100)])[:11] == [50] * 11
    assert tone.add_point([(0, 0), (255, 255)], 2, 9) == [(0, 0), (255, 255)]
    assert tone.move_point([(0, 0), (9, 9), (255, 255)], 1, 300, 300) == [(0, 0), (254, 255), (255, 255)]


def test_density(spark):
    got = mask(spark, [[0, 128, 200, 255]]).select("x", tone.apply_density("d", 2.0).alias("d")).orderBy("x").collect()
    assert [r["d"] for r in got] == [0, 1, 145, 255]


def test_dsl_errors():
    for text, kind in (("R +", "unexpected_end"), ("R $ G", "unexpected_char"), ("Q", "unknown_ident"), ("max(R)", "bad_arity"), ("R G", "expected"), ("(R", "unexpected_end"), ("1.2.3", "unexpected_char")):
        with pytest.raises(dsl.DslError) as e:
            dsl.parse(text)
        assert e.value.kind == kind, text
    assert dsl.parse("1 - R * -2") == ("-", 1.0, ("*", "R", ("neg", 2.0)))


def test_dsl_values(spark):
    px = C.with_lab(pixels(spark, [[(255, 0, 51)]]))
    for text, want in (("R", 1), ("B", 0.2), ("R / 0", 0), ("invert(B)", 0.8), ("clip(R * 3, 0, 0.5)", 0.5), ("-R", 0), ("abs(G - R) - B", 0.8), ("K", 0)):
        assert px.select(dsl.compile_expr(text)).first()[0] == pytest.approx(want), text


def test_wrong_expression_is_a_blank_plate(spark):
    px = pixels(spark, [[(0, 0, 0)] * 2])
    assert {r["d"] for r in E.extract(px, {"kind": "channel_calc", "expr": "R +"}).collect()} == {255}


def test_spot_plates_claim_each_pixel_once(spark):
    targets = [(200, 40, 40), (30, 120, 200), (200, 40, 40)]
    colors = [tuple(c) for c in np.random.default_rng(1).integers(0, 256, (60, 3)).tolist()] + targets
    plates = E.spot_plates(C.with_lab(pixels(spark, [colors])), targets).select("plates").collect()
    assert all(sum(d < 128 for d in r["plates"]) == 1 for r in plates)
    assert E.spot_plates(C.with_lab(pixels(spark, [[(0, 0, 0)]])), []).first()["plates"] == []


def test_weight_flips_the_winner(spark):
    px = C.with_lab(pixels(spark, [[(120, 60, 60)]]))
    targets = [(200, 40, 40), (60, 60, 60)]
    plain = E.spot_plates(px, targets).first()["plates"]
    pulled = E.spot_plates(px, targets, weights=[0.0, 30.0] if plain[0] < 128 else [30.0, 0.0]).first()["plates"]
    assert [d < 128 for d in plain] == [d >= 128 for d in pulled]


def test_cmyk_corners(spark):
    px = pixels(spark, [[(255, 255, 255), (0, 0, 0), (0, 255, 255)]])
    got = px.select("x", E.cmyk_channel("cyan", 1.0).alias("c"), E.cmyk_channel("black", 1.0).alias("k")).orderBy("x").collect()
    assert [(r["c"], r["k"]) for r in got] == [(255, 255), (255, 0), (0, 255)]


def test_index_error_diffusion(spark):
    palette = [(255, 0, 0), (0, 0, 255)]
    got = E.index_floyd_steinberg(pixels(spark, [[palette[0], palette[1]] * 2]), palette).orderBy("x").collect()
    assert [r["idx"] for r in got] == [0, 1, 0, 1]


def test_disk_is_a_plus_and_forms_agree(spark):
    a = np.full((7, 7), 0)
    a[3, 3] = 255
    got = grid(M.erode_ink(mask(spark, a), 1))
    assert sorted(zip(*np.nonzero(got))) == [(2, 3), (3, 2), (3, 3), (3, 4), (4, 3)]
    m = mask(spark, np.random.default_rng(0).integers(0, 256, (9, 11)))
    for r in (1, 2, 3):
        assert (grid(M.erode_ink(m, r)) == grid(M.apply_offsets(m, M.disk_offsets(r), True))).all()
    inverted = m.withColumn("d", 255 - F.col("d"))
    assert (grid(M.erode_ink(m, 2)) == 255 - grid(M.dilate_ink(inverted, 2))).all()
    opened = M.open_ink(m, 1)
    assert (grid(M.open_ink(opened, 1)) == grid(opened)).all()


def test_blur_keeps_flat(spark):
    assert (grid(M.smooth_mask(mask(spark, np.full((6, 6), 77)), 1.5)) == 77).all()


def test_dithers_are_binary_and_keep_the_mean(spark):
    ramp = mask(spark, np.tile(np.linspace(0, 255, 64).astype(int), (64, 1)))
    for out in (R.bayer(ramp, 8), R.blue_noise(ramp), R.white_noise(ramp, 64), R.floyd_steinberg(ramp)):
        g = grid(out)
        assert set(np.unique(g)) <= {0, 255} and abs(g.mean() - 127.5) < 8


def test_floyd_steinberg_against_a_plain_loop(spark):
    a = np.random.default_rng(5).integers(0, 256, (8, 10))
    want = a.astype(float)
    for y in range(8):
        xs = range(10) if y % 2 == 0 else range(9, -1, -1)
        s = 1 if y % 2 == 0 else -1
        for x in xs:
            old = want[y, x]
            want[y, x] = 0 if old < 128 else 255
            for dx, dy, w in ((s, 0, 7), (-s, 1, 3), (0, 1, 5), (s, 1, 1)):
                if 0 <= x + dx < 10 and y + dy < 8:
                    want[y + dy, x + dx] += (old - want[y, x]) * w / 16
    assert (grid(R.floyd_steinberg(mask(spark, a))) == want).all()


def test_white_noise_jumps_equal_steps():
    state, seen = 0x9E3779B9, []
    for _ in range(300):
        state = R._xorshift(state)
        seen.append(state)
    order = np.random.default_rng(0).permutation(300)
    assert (R.white_noise_states(order) == np.array(seen, np.uint32)[order]).all()


def test_blue_noise_tile():
    t = R.blue_noise_tile()
    assert t.shape == (64, 64) and t.min() == 0 and t.max() == 255 and abs(t.mean() - 127.5) < 1


def test_halftone_flat(spark):
    for value, want in ((255, 255), (0, 0)):
        g = grid(R.halftone(mask(spark, np.full((20, 20), value)), 20, 20, lpi=20.0))
        assert (g == 255).all() if want else g.mean() < 60


def test_palette_keeps_a_small_accent(spark):
    rows = [[(200, 30, 30)] * 70 + [(30, 30, 200)] * 25 + [(240, 240, 60)] * 3 + [(20, 160, 60)] * 2 for _ in range(10)]
    found, centers = P.auto_palette(pixels(spark, rows), 8, 0.01)
    assert [round(e.coverage, 2) for e in found] == [0.7, 0.25, 0.03, 0.02]
    assert P.requantized(pixels(spark, rows), centers).groupBy("r", "g", "b").count().count() == 4
    assert P.auto_palette(pixels(spark, rows).where("false"), 8, 0.01) == ([], [])


def test_hues_and_extremes():
    e = [P.Entry((200, 30, 30), 0.5), P.Entry((120, 10, 10), 0.3), P.Entry((30, 30, 200), 0.2)]
    assert len(P.consolidate_by_hue(e)) == 2
    assert [x.rgb for x in P.snap_extremes([P.Entry((10, 10, 10), 1), P.Entry((252, 252, 252), 1)])] == [(0, 0, 0), (255, 255, 255)]
    assert [x.rgb for x in P.print_order([P.Entry((0, 0, 0), 1), P.Entry((9, 9, 90), 1), P.Entry((255, 255, 255), 1)])][0] == (255, 255, 255)


@pytest.mark.parametrize("parts, want", [
    # groups of 1,656,000 of 9,000,000 pixels each: in doubles, the parts of the yellow one add up to a last bit more
    ([
        ((252, 252, 252), 2376000), ((34, 124, 204), 1656000), ((26, 26, 26), 737060), ((246, 206, 46), 735440), ((207, 47, 47), 550180), ((244, 204, 44), 371080), ((202, 42, 42), 369280), ((21, 21, 21), 368860),
        ((23, 23, 23), 367420), ((241, 201, 41), 364760), ((203, 43, 43), 185980), ((240, 200, 40), 184720), ((204, 44, 44), 184640), ((205, 45, 45), 183420), ((20, 20, 20), 182660), ((200, 40, 40), 182500),
    ], [(0, 252, 252, 252, 0.264), (1, 244, 204, 44, 0.184), (2, 34, 124, 204, 0.184), (3, 24, 24, 24, 0.184), (4, 204, 44, 44, 0.184)]),
    # a coverage of 0.24855
    ([((38, 128, 208), 1656000), ((255, 255, 255), 1263260), ((3, 109, 195), 580950)], [(0, 29, 123, 205, 0.2486), (1, 255, 255, 255, 0.1404)]),
])
def test_hue_groups_add_and_round_as_their_sql(spark, monkeypatch, parts, want):
    import duckdb

    from huegrid import queries
    from huegrid.oracles import ORACLES

    monkeypatch.setattr(P, "auto_palette", lambda *_: ([P.Entry(c, n / 9_000_000) for c, n in parts], []))
    assert [tuple(r) for r in queries.QUERIES["hue_groups"](spark, "/root/testdata/sf0.001").collect()] == want
    # the SQL from the palette on
    rows = ", ".join(f"({i}::BIGINT, {r}::BIGINT, {g}::BIGINT, {b}::BIGINT, {n} / 9e6)" for i, ((r, g, b), n) in enumerate(parts))
    sql = ORACLES["hue_groups"]
    assert sorted(duckdb.connect().sql(f"WITH RECURSIVE pal(idx, r, g, b, coverage) AS (VALUES {rows}), {sql[sql.index('pl_1 AS') :]}").fetchall()) == want


def test_flood_fill_keeps_an_enclosed_interior(spark):
    w, k = (255, 255, 255), (10, 10, 10)
    rows = [[w] * 9 for _ in range(9)]
    for i in range(2, 7):
        rows[2][i] = rows[6][i] = rows[i][2] = rows[i][6] = k
    fg = grid(G.flood_background(pixels(spark, rows)).withColumn("f", F.col("is_fg").cast("int")), "f")
    assert fg[4, 4] == 1 and fg[0, 0] == 0 and fg[2, 2] == 1 and fg.sum() == 25


def test_alpha_mask(spark):
    px = pixels(spark, [[(1, 1, 1)] * 2])
    assert G.alpha_mask(px.withColumn("alpha", F.lit(255))) is None
    got = G.alpha_mask(px.withColumn("alpha", F.col("x") * 200)).orderBy("x").collect()
    assert [r["is_fg"] for r in got] == [False, True]


def test_same_ink_and_resize(spark):
    layers = spark.createDataFrame([(0, 1, 2, 3), (1, 1, 2, 3)], "layer_idx int, r int, g int, b int")
    assert L.same_ink(layers) and not L.same_ink(layers.limit(1))
    a = np.arange(12).reshape(3, 4)
    got = grid(L.nearest_resize(mask(spark, a), (4, 3), (8, 2)))
    assert (got == a[np.arange(2) * 3 // 2][:, np.arange(8) * 4 // 8]).all()
    assert (grid(L.lanczos_resize(mask(spark, np.full((6, 6), 90)), (6, 6), (9, 4))) == 90).all()
