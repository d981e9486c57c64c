"""A query for each operator over the fixture views; huegrid.oracles holds the same in SQL."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as X
from ._stage import checkpoint_dir
from .functions import color as C
from .functions import dsl, tone
from .operators import extract as E
from .operators import foreground as G
from .operators import layers as L
from .operators import neighborhood as M
from .operators import palette as P
from .operators import raster as R
from .plans import export, pipeline, project, workflows
from .plans.layer import Halftone, History, Layer, deleted, moved
from .sources import images
from .streaming import edits as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TARGETS = [X.BASE[k] for k in range(4)]
WEIGHTS = [0.0, 2.5, 0.0, -1.0]
DSL_DIFF = "max(R, G) - min(G, B) * 0.5"
DSL_BAND = "clip(1 - abs(L - 0.5) * 3.3, 0, 1)"
DSL_MIX = "invert(K) / (0.2 + abs(a)) * -(b - 1) / 4"


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT."""
    return df.select(*(F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(spark, sf_dir))
    return f


def _register(name: str, f: Query) -> None:
    QUERIES[name] = lambda spark, sf_dir: _plain(f(spark, sf_dir))


def _density(name: str, d: Callable[[], Column], lab: bool = False) -> None:
    """x, y, d of an extractor or tone that is one Column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        image = X.px(spark, sf_dir)
        return (C.with_lab(image) if lab else image).select("x", "y", d().cast("long").alias("d"))

    _register(name, run)


def _masked(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    """x, y, d of an operator on the gray mask."""
    _register(name, lambda spark, sf_dir: f(X.gray(X.px(spark, sf_dir))).select("x", "y", "d"))


# colour scalars


@query
def lab_values(spark, sf_dir):
    lab = C.with_lab(X.px(spark, sf_dir))
    return lab.select("i", *((F.round(c, 4) + 0.0).alias(n) for c, n in (("l", "l"), ("a", "a"), ("b_", "b"))))


@query
def lab_round_trip(spark, sf_dir):
    lab = C.with_lab(X.px(spark, sf_dir))
    back = C.lab_to_rgb(F.col("l"), F.col("a"), F.col("b_"))
    return lab.select("i", *(c.alias(n) for c, n in zip(back, ("r2", "g2", "b2"))))


@query
def hue_chroma(spark, sf_dir):
    lab = C.with_lab(X.px(spark, sf_dir)).withColumns({"h": C.hue_deg(), "c": C.chroma()})
    hued = lambda v: F.when(F.col("c") > 1, F.round(v, 4))
    return lab.select("i", hued(F.col("h")).alias("hue"), hued(F.col("c")).alias("chroma"), hued(C.hue_distance(F.col("h"), F.lit(350.0))).alias("from_350"))


@query
def delta_e_pair(spark, sf_dir):
    to = C.lab_of(TARGETS[0])
    lab = C.with_lab(X.px(spark, sf_dir))
    return lab.select("i", F.round(C.delta_e("l", "a", "b_", *to), 4).alias("e76"), F.round(C.delta_e94("l", "a", "b_", *to), 4).alias("e94"))


@query
def linear_light(spark, sf_dir):
    return X.px(spark, sf_dir).select("i", F.round(C.to_linear("r"), 6).alias("lin"), C.from_linear(C.to_linear("r") * 0.5).alias("half"))


@query
def luma_hist(spark, sf_dir):
    return X.px(spark, sf_dir).groupBy(C.luma().alias("luma")).agg(F.count("*").alias("n"))


@query
def hsv_stats(spark, sf_dir):
    return X.px(spark, sf_dir).select("i", F.round(C.value(), 6).alias("v"), F.round(C.saturation(), 6).alias("s"))


@query
def color_name_hist(spark, sf_dir):
    return X.px(spark, sf_dir).groupBy(C.color_name().alias("name")).agg(F.count("*").alias("n"))


@query
def color_name_cube(spark, sf_dir):
    """Names over a grid of the colour cube, so that every branch occurs."""
    p = X.table(spark, sf_dir, "orders").select(*((F.floor(F.col("o_orderkey") / d) % 13 * 21).alias(c) for c, d in zip("rgb", (1, 13, 169))))
    return p.groupBy(C.color_name().alias("name")).agg(F.count("*").alias("n"), F.sum(F.col("r") + F.col("g") * 2 + F.col("b") * 3).alias("sum"))


@query
def hex_round_trip(spark, sf_dir):
    h = X.px(spark, sf_dir).select("i", C.hex_of().alias("hex")).withColumn("c", C.rgb_from_hex("hex"))
    return h.select("i", "hex", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b"))


@query
def sanitize_names(spark, sf_dir):
    return X.table(spark, sf_dir, "part").select("p_partkey", images.sanitized("p_name").alias("file"))


@query
def mesh_and_angle(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    return p.select("p_partkey", C.mesh_for_lpi(F.col("p_size") + 20).alias("mesh"), C.auto_angle(F.col("p_partkey")).alias("angle"))


# extractors

_density("spot_solid_mask", lambda: E.spot_solid(TARGETS[0], 6))
_density("gcr_black", lambda: E.gcr_black(1.0))
_density("gcr_highlight", lambda: E.gcr_black(1.3, True))
_density("stencil_mask", lambda: E.luminance_threshold(128))
_density("luminance_above", lambda: E.luminance_threshold(100, True))
_density("hsb_underbase", lambda: E.hsb_brightness_inverted(1.4, True, 0.8))
_density("hsb_plain", lambda: E.hsb_brightness_inverted())
_density("lab_underbase", E.lab_lightness_inverted, True)
for _c in ("cyan", "magenta", "yellow", "black"):
    _density(f"cmyk_{_c}", lambda c=_c: E.cmyk_channel(c))
for _f in ("linear", "quadratic", "smooth"):
    _density(f"color_range_{_f}", lambda f=_f: E.color_range(TARGETS[2], 40.0, f), True)
_density("dsl_max_diff", lambda: E.channel_calc(DSL_DIFF), True)
_density("dsl_lband", lambda: E.channel_calc(DSL_BAND), True)
_density("dsl_mix", lambda: E.channel_calc(DSL_MIX), True)
_density("index_bayer_assign", lambda: E.index_bayer(TARGETS), True)
_density("blank_plate", lambda: F.lit(255))


@query
def stencil_coverage(spark, sf_dir):
    return P.coverage_fraction(X.px(spark, sf_dir).select(E.luminance_threshold(128).alias("d"))).select(F.round("coverage", 6).alias("coverage"))


@query
def nearest_palette(spark, sf_dir):
    lab = C.with_lab(X.px(spark, sf_dir))
    return lab.select("i", E.nearest(E.target_distances(TARGETS))["i"].alias("k"))


@query
def spot_aa_plate(spark, sf_dir):
    """All weighted plates in one pass, a row a pixel and plate."""
    out = E.spot_plates(C.with_lab(X.px(spark, sf_dir)), TARGETS, [], WEIGHTS)
    # exploding plates itself would put a filter on their size below every costly column
    each = out.select("x", "y", "plates", F.explode(F.array(*map(F.lit, range(len(TARGETS))))).alias("plate"))
    return each.select("x", "y", "plate", F.element_at("plates", F.col("plate") + 1).alias("d"))


@query
def spot_reject(spark, sf_dir):
    out = E.spot_plates(C.with_lab(X.px(spark, sf_dir)), TARGETS[:2], TARGETS[2:3] + [X.BASE[4]])
    return out.select("x", "y", F.col("plates")[0].alias("d"))


@query
def manual_paint_resized(spark, sf_dir):
    pixels = bytes((k * 37) % 256 for k in range(20))
    image = X.px(spark, sf_dir)
    return E.extract(image.select("x", "y", "r", "g", "b"), {"kind": "manual_paint", "width": 5, "height": 4, "pixels": pixels})


@query
def index_floyd_steinberg(spark, sf_dir):
    return E.index_floyd_steinberg(X.px(spark, sf_dir), TARGETS)


# tone

_density("curve_black_plate", lambda: tone.apply_curve(E.gcr_black(1.0), tone.CURVES["black_plate"]))
_density("curve_custom", lambda: tone.apply_curve(F.greatest("r", "g", "b"), [(20, 40), (90, 10), (90, 60), (200, 250)]))
_density("density_half", lambda: tone.apply_density(F.greatest("r", "g", "b"), 0.5))
_density("density_double", lambda: tone.apply_density(F.greatest("r", "g", "b"), 2.0))
_density("levels_gamma", lambda: tone.apply_levels(F.greatest("r", "g", "b"), 20, 220, 1.8))
_density("invert_mask", lambda: tone.invert(F.greatest("r", "g", "b")))
_density("binarize_mask", lambda: tone.binarize(F.greatest("r", "g", "b")))

# filters on the source


@query
def clamp_near_black(spark, sf_dir):
    return G.clamp_near_black(X.px(spark, sf_dir))


@query
def to_black_background(spark, sf_dir):
    return G.fill_background(X.px(spark, sf_dir), (0, 0, 0), 12.0)


@query
def desaturated(spark, sf_dir):
    return G.desaturate(X.px(spark, sf_dir))


# neighbourhoods

_masked("erode_r2", lambda m: M.erode_ink(m, 2))
_masked("dilate_r2", lambda m: M.dilate_ink(m, 2))
_masked("erode_r1", lambda m: M.erode_ink(m, 1))
_masked("open_r2", lambda m: M.open_ink(m, 2))
_masked("close_r2", lambda m: M.close_ink(m, 2))
_masked("gaussian_15", lambda m: M.smooth_mask(m, 1.5))
_masked("box_mean_2", lambda m: M.box_mean(m, 2))
_masked("downsample_3", lambda m: M.downsample(m, 3))
_masked("offsets_max", lambda m: M.apply_offsets(m, [(0, 0), (2, 0), (0, -1)], True))

# rasters

for _n in (2, 4, 8):
    _masked(f"bayer{_n}", lambda m, n=_n: R.bayer(m, n))
_masked("blue_noise", R.blue_noise)
_masked("white_noise", lambda m: R.white_noise(m, X.WIDTH))
_masked("floyd_steinberg", R.floyd_steinberg)
for _d, _curve in (("round", "linear"), ("square", "s_curve"), ("ellipse", "hard"), ("line", "linear")):
    _register(f"halftone_{_d}", lambda spark, sf_dir, d=_d, c=_curve: R.halftone(X.gray(X.px(spark, sf_dir)), *X.size(spark, sf_dir), lpi=20.0, angle_deg=22.5, dot=d, curve=c))

# aggregates and palettes


@query
def modal_color(spark, sf_dir):
    return P.modal_color(X.px(spark, sf_dir))


@query
def border_mode(spark, sf_dir):
    return P.modal_color(P.border_pixels(X.px(spark, sf_dir)))


@query
def hist_buckets(spark, sf_dir):
    return P.histogram_stats(X.px(spark, sf_dir)).select("n_colors", F.round("peak", 6).alias("peak"))


@query
def p95_chroma(spark, sf_dir):
    return P.p95_chroma(X.px(spark, sf_dir), *X.size(spark, sf_dir)).select(F.round("p95", 4).alias("p95"))


@query
def workflow_detect(spark, sf_dir):
    return spark.createDataFrame([(workflows.detect(X.px(spark, sf_dir), X.size(spark, sf_dir)),)], "workflow string")


@query
def layer_coverage(spark, sf_dir):
    return P.coverage_fraction(X.masks(X.px(spark, sf_dir)), "layer_idx").select("layer_idx", F.round("coverage", 6).alias("coverage"))


@query
def kmeans_step(spark, sf_dir):
    out = P.kmeans_step(C.with_lab(X.px(spark, sf_dir)), [C.lab_of(t) for t in X.BASE])
    return out.select("k", "n", *((F.round(c, 4) + 0.0).alias(n) for c, n in (("l", "l"), ("a", "a"), ("b_", "b"))))


@query
def label_means(spark, sf_dir):
    """The same aggregate beyond three dimensions: means of embeddings by label."""
    e = X.table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query
def palette_full(spark, sf_dir):
    found, _ = P.auto_palette(X.px(spark, sf_dir), 8, 0.002)
    return spark.createDataFrame([(i, *e.rgb, round(e.coverage, 4)) for i, e in enumerate(found)], "idx int, r int, g int, b int, coverage double")


@query
def palette_snap(spark, sf_dir):
    """Pure black and white for nearly black and white entries, over part colours."""
    p = X.table(spark, sf_dir, "part").select("p_partkey", *((F.col("p_partkey") % 256).alias(c) for c in "rgb"))
    grays = [(v, v, v) for v in range(256)]
    snapped = spark.createDataFrame([(a[0], *b.rgb) for a, b in zip(grays, P.snap_extremes([P.Entry(c, 0.0) for c in grays]))], "v long, r2 long, g2 long, b2 long")
    return p.join(F.broadcast(snapped), F.col("r") == F.col("v")).select("p_partkey", F.col("r2").alias("r"), F.col("g2").alias("g"), F.col("b2").alias("b"))


@query
def requantized(spark, sf_dir):
    return P.requantized(X.px(spark, sf_dir), [C.lab_of(t) for t in X.BASE])


# joins, sets and orders over layers


@query
def union_min(spark, sf_dir):
    return L.union_min(X.masks(X.px(spark, sf_dir)))


@query
def composite_union(spark, sf_dir):
    image = X.px(spark, sf_dir)
    return L.composite_union(X.masks(image), X.layers(spark), image, own=0)


@query
def shadow_merge(spark, sf_dir):
    image = X.px(spark, sf_dir)
    pick = X.layers(spark).where("layer_idx in (1, 2, 4)")
    return L.shadow_merge(L.selected(X.masks(image), pick.select("layer_idx")), pick)


@query
def composite(spark, sf_dir):
    """Layer 5 is hidden and layer 2 left out of the export; the masks leave a corner bare, where the shirt shows."""
    image = X.px(spark, sf_dir)
    layers = X.layers(spark).withColumn("include_in_export", F.col("layer_idx") != 2)
    return L.composite(X.masks(image).where("x >= 10 or y >= 10"), layers, image)


@query
def single_over_shirt(spark, sf_dir):
    return L.over_shirt(X.gray(X.px(spark, sf_dir)), (250, 60, 10))


@query
def knockout(spark, sf_dir):
    image = X.px(spark, sf_dir)
    return G.knockout(X.gray(image), image.select("x", "y", (F.col("x") >= 4).alias("is_fg")))


@query
def reindex(spark, sf_dir):
    return L.reindex(L.dropped(X.layers(spark), spark.createDataFrame([(3,)], "layer_idx int"))).select("layer_idx", "print_index")


@query
def visible_layers(spark, sf_dir):
    return L.exportable(X.layers(spark).withColumn("include_in_export", F.col("layer_idx") != 2)).select("layer_idx", "print_index")


@query
def weight_propagation(spark, sf_dir):
    targets = spark.createDataFrame([(i, p, *c, None) for i in range(3) for p, c in enumerate(TARGETS)], "layer_idx int, pos int, r int, g int, b int, weight double")
    e = X.edits(spark, sf_dir)
    base = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "rgb"))) for c in TARGETS[:3]))
    changes = e.select("seq", F.element_at(base, (F.col("layer_idx") % 3 + 1).cast("int")).alias("c"), "param").select("seq", "c.*", F.col("param").alias("weight"))
    return L.propagate_weights(targets, changes).select("layer_idx", F.posexplode("target_weights").alias("pos", "weight"))


@query
def nearest_resize(spark, sf_dir):
    w, h = X.size(spark, sf_dir)
    return L.nearest_resize(X.gray(X.px(spark, sf_dir)), (w, h), (w * 3 // 2, h // 2))


@query
def lanczos_resize(spark, sf_dir):
    w, h = X.size(spark, sf_dir)
    return L.lanczos_resize(X.gray(X.px(spark, sf_dir)), (w, h), (w // 2, h // 3))


@query
def brush_dabs(spark, sf_dir):
    """A dab of every event, over the whole height."""
    height = max(1, X.size(spark, sf_dir)[1])
    dabs = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") * 7 % 100).cast("int").alias("cx"), (F.col("event_id") % height).cast("int").alias("cy"), F.lit(5).alias("radius"), (F.col("event_id") % 2 == 0).alias("ink"))
    return L.brush(X.gray(X.px(spark, sf_dir)), dabs)


# regions


@query
def flood_fill(spark, sf_dir):
    return G.flood_background(X.px(spark, sf_dir), 12.0)


@query
def mask_source(spark, sf_dir):
    """Background pixels in one colour; the mask lacks every 11th pixel, which stays."""
    image = X.px(spark, sf_dir)
    fg = image.where("(x + y) % 11 <> 0").select("x", "y", (F.col("x") >= 30).alias("is_fg"))
    return G.mask_source(image, fg, (9, 8, 7))


def _with_alpha(image):
    return image.withColumn("alpha", (F.col("x") * 5 + F.col("y") * 3) % 256)


@query
def alpha_mask(spark, sf_dir):
    return G.alpha_mask(_with_alpha(X.px(spark, sf_dir)))


@query
def foreground_choice(spark, sf_dir):
    """Alpha counts where there is any, else the flood fill if wanted, else nothing."""
    image = X.px(spark, sf_dir)
    opaque = image.withColumn("alpha", F.lit(255))
    by_alpha = G.detect_foreground(_with_alpha(image), remove=False).withColumn("choice", F.lit("alpha"))
    by_fill = G.detect_foreground(opaque, remove=True).withColumn("choice", F.lit("fill"))
    assert G.detect_foreground(opaque, remove=False) is None
    return by_alpha.unionByName(by_fill).groupBy("choice", "is_fg").agg(F.count("*").alias("n"), F.sum(F.col("x") * 7 + F.col("y")).alias("sum"))


@query
def safety_knockout(spark, sf_dir):
    """A blurred, spread plate, knocked out before and after it is rendered."""
    image = X.px(spark, sf_dir)
    layer = Layer((20, 20, 20), "k", extractor={"kind": "luminance_threshold", "threshold": 128}, render_mode="bayer")
    return pipeline.process_layer(image, layer, X.size(spark, sf_dir), fg=image.select("x", "y", (F.col("x") >= 50).alias("is_fg")))[1]


# film furniture and names


@query
def registration_marks(spark, sf_dir):
    return images.registration_marks(X.gray(X.px(spark, sf_dir)), X.size(spark, sf_dir), offset=12, arm=7, thickness=2)


@query
def film_border(spark, sf_dir):
    return images.film_border(X.gray(X.px(spark, sf_dir)), X.size(spark, sf_dir), margin=3, caption=5)[0]


_MODES = ("solid", "halftone", "fm_floyd_steinberg", "bayer", "white_noise", "blue_noise", "index_fs", "index_bayer")


def _film_layers() -> list[Layer]:
    return [Layer(ink, f"{k} & {i}/{ink[0]}", k, render_mode=_MODES[i], halftone=Halftone(40.5 * (i % 2), 15.0 * i - 20), print_index=p) for i, k, ink, _, p in X.LAYERS]


@query
def captions(spark, sf_dir):
    return spark.createDataFrame([(i, images.format_caption(x, i, 52.5), images.film_name(x)) for i, x in enumerate(_film_layers())], "layer_idx int, caption string, film string")


@query
def blank_paint(spark, sf_dir):
    """A paint layer without a buffer, and one whose buffer has the wrong size."""
    image = X.px(spark, sf_dir)
    none = E.extract(image, {"kind": "manual_paint"}).withColumn("layer_idx", F.lit(0))
    return none.unionByName(E.extract(image, {"kind": "manual_paint", "width": 3, "height": 2, "pixels": bytes(5)}).withColumn("layer_idx", F.lit(1)))


@query
def same_ink(spark, sf_dir):
    """Whether the layers of each choice share an ink."""
    layers = X.layers(spark)
    picks = ((1, 5), (1, 2), (1,), (1, 2, 5), tuple(i for i, *_ in X.LAYERS))
    return spark.createDataFrame([(k, L.same_ink(layers.where(F.col("layer_idx").isin(list(p))))) for k, p in enumerate(picks)], "choice int, same boolean")


@query
def print_order(spark, sf_dir):
    """A palette with pure extremes in its order of print."""
    found = P.print_order(P.snap_extremes(P.auto_palette(X.px(spark, sf_dir), 16, 0.002)[0]))
    return spark.createDataFrame([(i, *e.rgb, round(e.coverage, 4)) for i, e in enumerate(found)], "idx int, r int, g int, b int, coverage double")


@query
def hue_groups(spark, sf_dir):
    """A palette whose entries of one hue are joined."""
    found = P.consolidate_by_hue(P.auto_palette(X.px(spark, sf_dir), 16, 0.002)[0])
    places = lambda v: math.floor(v * 1e4 + 0.5) / 1e4  # noqa: E731 - half up, as SQL: round() takes 0.24855 to 0.2485
    return spark.createDataFrame([(i, *e.rgb, places(e.coverage)) for i, e in enumerate(found)], "idx int, r int, g int, b int, coverage double")


@query
def contact_sheet(spark, sf_dir):
    """Previews in ink on the shirt, letterboxed in cells."""
    image, size = X.px(spark, sf_dir), X.size(spark, sf_dir)
    layers = [Layer(ink, k, k, visible=v, include_in_export=i != 3) for i, k, ink, v, _ in X.LAYERS]
    return images.contact_sheet(X.masks(image), layers, size, columns=3, cell=60, padding=7)[0]


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/huegrid/{name}-{uuid.uuid4().hex}"


@query
def png_round_trip(spark, sf_dir):
    """The image written as a PNG file and read again."""
    width, height = X.size(spark, sf_dir)

    def encode(t: pa.Table) -> pa.Table:
        f = t.to_pandas()
        sheet = np.zeros((height, width, 3), np.uint8)
        sheet[f["y"], f["x"]] = f[["r", "g", "b"]]
        return pa.table({"name": ["art.png"], "png": [images.encode_png(sheet, 300)]})

    folder = _folder(spark, "art")
    one = X.px(spark, sf_dir).select("x", "y", "r", "g", "b").groupBy(F.lit(0).alias("_")).applyInArrow(encode, "name string, png binary")
    images.write_films(one, folder)
    return images.open_image(spark, f"{folder}/art.png")[0].select("i", "x", "y", "r", "g", "b", "alpha")


@query
def export_films(spark, sf_dir):
    """Films of a job with marks and borders as the files hold them: size, pixels a metre, and ink above the caption."""
    image, size = X.px(spark, sf_dir), X.size(spark, sf_dir)
    layers = [
        Layer((0, 0, 0), "the stencil", extractor={"kind": "luminance_threshold", "threshold": 128}, print_index=2),
        Layer((200, 40, 40), "soft", extractor={"kind": "gcr_black"}, render_mode="bayer"),
        Layer((1, 2, 3), "hidden", visible=False),
    ]
    found = export.films(image, layers, size, export.Film(dpi=200, marks=export.Marks(12, 7, 2), border=export.Border(3, 5)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, png in zip(b.column("name").to_pylist(), b.column("png").to_pylist()):
                sheet, at = images.decode_png(png)[..., 0], png.index(b"pHYs") + 4
                rows.append((name, sheet.shape[1], sheet.shape[0], int.from_bytes(png[at : at + 4], "big"), int((sheet[: size[1] + 6] < 128).sum())))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4))], ["name", "w", "h", "per_metre", "ink"])

    return found.mapInArrow(decode, "name string, w long, h long, per_metre long, ink long")


@query
def project_layers(spark, sf_dir):
    """A project saved and read again, a row a layer."""
    layers = workflows.plan("tritone", X.px(spark, sf_dir)) + [Layer((9, 8, 7), "painted", "shadow", visible=False, extractor={"kind": "manual_paint"}, print_index=3)]
    folder = _folder(spark, "project")
    text = project.Project(layers, "art.png").to_json().encode()
    images.write_films(spark.createDataFrame([("project.json", bytearray(text))], "name string, png binary"), folder)
    found = project.read_projects(spark, folder)
    return found.select("version", "source", "layer_idx", "name", "kind", *(F.col("ink")[k].alias(c) for k, c in enumerate("rgb")), "visible", F.get_json_object("extractor", "$.kind").alias("extractor"), "render_mode", "print_index")


# layer lists, curves and presets


@query
def curve_edited(spark, sf_dir):
    """A curve after points were added, moved against their bounds and deleted."""
    curve = tone.add_point([(0, 0), (255, 255)], 100, 40)
    curve = tone.add_point(tone.add_point(curve, 98, 9), 180, 200)  # the first is too near another
    curve = tone.move_point(tone.move_point(curve, 1, 250, 300), 0, 50, 20)
    curve = tone.delete_point(tone.delete_point(tone.add_point(curve, 60, 90), 0), 1)
    return X.px(spark, sf_dir).select("x", "y", tone.apply_curve(F.greatest("r", "g", "b"), curve).cast("long").alias("d"))


@query
def list_edits(spark, sf_dir):
    """The layer list and selection after moves, deletions, undo and redo."""
    layers, at, history, out = [Layer((0, 0, 0), n) for n in "abcd"], 2, History(), []
    steps = [lambda: (moved(layers, 0, 1), at), lambda: (moved(layers, 3, 1), at), lambda: deleted(layers, 1, at), lambda: deleted(layers, 2, 2)]
    for step in steps:
        history.push(layers, at)
        layers, at = step()
        out.append((layers, at))
    for go in (history.undo, history.undo, history.redo, history.undo, history.undo, history.undo):
        layers, at = go((layers, at)) or (layers, at)
        out.append((layers, at))
    return spark.createDataFrame([(k, i, x.name, x.print_index, s) for k, (found, s) in enumerate(out) for i, x in enumerate(found)], "step int, pos int, name string, print_index int, selected int")


@query
def preset_layers(spark, sf_dir):
    """The layers of the workflows that need no palette."""
    planned = [(w, i, x) for w in workflows.LABELS if workflows.palette_of(w) is None for i, x in enumerate(workflows.plan(w, X.px(spark, sf_dir)))]
    rows = [(w, i, x.name, x.kind, *x.ink, x.render_mode, float(x.halftone.lpi), float(x.halftone.angle_deg), x.print_index) for w, i, x in planned]
    return spark.createDataFrame(rows, "workflow string, pos int, name string, kind string, r int, g int, b int, mode string, lpi double, angle double, print_index int")


# edit streams


@query
def edit_stream_latest(spark, sf_dir):
    return S.latest(X.edits(spark, sf_dir))


@query
def edit_stream_current(spark, sf_dir):
    return S.current(X.edits(spark, sf_dir))


# whole jobs


def _job(name: str, workflow: str, mode: bool = True) -> None:
    def run(spark, sf_dir):
        image = X.px(spark, sf_dir)
        plates = pipeline.separate(image, workflows.plan(workflow, image), X.size(spark, sf_dir), processed=mode)
        return P.coverage_fraction(plates, "layer_idx").select("layer_idx", F.round("coverage", 6).alias("coverage"))

    _register(name, run)


for _w in workflows.LABELS:
    _job(f"full_{_w}", _w)


@query
def black_plate_blocks(spark, sf_dir):
    """Pixels to a black plate, its curve, an ordered dither, and coverage by 80-pixel blocks."""
    plate = X.px(spark, sf_dir).select("x", "y", tone.apply_curve(E.gcr_black(1.0), tone.CURVES["black_plate"]).alias("d"))
    return R.bayer(plate, 8).groupBy(F.floor(F.col("x") / 80).alias("bx"), F.floor(F.col("y") / 80).alias("by")).agg(F.round(F.avg(F.when(F.col("d") < 128, 1.0).otherwise(0.0)), 6).alias("coverage"))
