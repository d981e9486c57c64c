"""Carrying out a layer list: each layer's stages in their fixed order, unions in a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._stage import checkpointed
from ..functions import color as C
from ..functions import tone
from ..operators import extract as E
from ..operators import foreground, layers as L, neighborhood as M, raster as R
from .layer import LAYER_SCHEMA, Job, Layer, layer_rows


def shape(mask: DataFrame, layer: Layer, fg: DataFrame | None = None) -> DataFrame:
    """Tone, cleanup and knockout of an extracted density: the preview.  Stages that change nothing are not planned."""
    d, t, m = F.col("d"), layer.tone, layer.mask
    if m.invert:
        d = tone.invert(d)
    out = mask.withColumn("d", tone.apply_density(tone.apply_curve(d, list(t.curve)), t.density).cast("int"))
    if layer.render_mode == "solid":
        if m.solid_blur > 0.01:
            out = M.smooth_mask(out, m.solid_blur)
        out = out.withColumn("d", tone.binarize("d"))
    out = M.erode_ink(out, t.choke)
    out = M.smooth_mask(out, m.smooth_radius)
    out = M.open_ink(out, m.noise_open) if m.noise_open else out
    out = M.close_ink(out, m.holes_close) if m.holes_close else out
    if m.edge_radius > 0:
        out = {"hard": lambda: out, "choke": lambda: M.erode_ink(out, m.edge_radius), "spread": lambda: M.dilate_ink(out, m.edge_radius), "feather_ht": lambda: M.feather_edge(out, float(m.edge_radius))}[m.edge_mode]()
    return foreground.knockout(out, fg)


def render(preview: DataFrame, layer: Layer, size: tuple[int, int], job: Job = Job(), fg: DataFrame | None = None) -> DataFrame:
    """The preview as printable dots, knocked out once more."""
    h = layer.halftone
    match layer.render_mode:
        case "solid":
            out = preview
        case "halftone":
            angle = h.angle_deg if h.angle_deg >= 0 else C.ANGLES[layer.print_index % len(C.ANGLES)]
            out = R.halftone(preview, *size, lpi=h.lpi if h.lpi > 0 else job.default_lpi, angle_deg=angle, dot=h.dot_shape or "round", curve=h.curve)
            out = out.withColumn("d", tone.binarize("d"))
        case "fm_floyd_steinberg":
            out = R.floyd_steinberg(preview)
        case "bayer":
            out = R.bayer(preview)
        case "white_noise":
            out = R.white_noise(preview, size[0])
        case "blue_noise":
            out = R.blue_noise(preview)
        case _:
            out = preview.withColumn("d", tone.binarize("d"))
    return foreground.knockout(out, fg)


def process_layer(px: DataFrame, layer: Layer, size: tuple[int, int], job: Job = Job(), fg: DataFrame | None = None, extracted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The preview and the processed plate of one layer."""
    preview = shape(E.extract(px, layer.extractor) if extracted is None else extracted, layer, fg)
    return preview, render(preview, layer, size, job, fg)


def _groups(plan: list[tuple[int, Layer]]) -> list[list[tuple[int, Layer]]]:
    """Solid layers that read one assignment of pixels and are shaped alike go together, others alone."""
    found: dict = {}
    for i, x in plan:
        kind = x.extractor["kind"]
        shared = {"spot_aa": ("targets", "others", "target_weights"), "index_assignment": ("palette", "dither")}.get(kind)
        one = not shared or x.render_mode != "solid" or (kind == "spot_aa" and not x.extractor["targets"])
        key = i if one else (kind, str([x.extractor.get(k) for k in shared]), x.tone, x.mask)
        found.setdefault(key, []).append((i, x))
    return list(found.values())


def _extract_together(src: DataFrame, group: list[tuple[int, Layer]]) -> DataFrame:
    """keys, layer_idx, x, y, d of all layers of a group: distances or assignments are computed once."""
    keys, spec = E.keys_of(src), group[0][1].extractor
    if spec["kind"] == "spot_aa":
        targets = [tuple(t) for t in spec["targets"]]
        at = [targets.index(x.ink) if x.ink in targets else 0 for _, x in group]
        out = E.spot_plates(C.with_lab(src), targets, [tuple(o) for o in spec.get("others", ())], spec.get("target_weights")).select(*keys, "x", "y", "plates")
        d = F.element_at("plates", F.col("o.at") + 1)
    else:
        palette = [tuple(t) for t in spec["palette"]]
        at = [x.extractor["index"] for _, x in group]
        if spec.get("dither", "bayer") == "bayer":
            out = C.with_lab(src).select(*keys, "x", "y", E.index_bayer(palette).alias("idx"))
        else:
            out = E.index_floyd_steinberg(src, palette)
        d = F.when(F.col("idx") == F.col("o.at"), 0).otherwise(255)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("layer_idx"), F.lit(k).alias("at")) for (i, _), k in zip(group, at))))
    return out.select("*", each.alias("o")).select(*keys, "o.layer_idx", "x", "y", d.cast("int").alias("d"))


def separate(px: DataFrame, layers: list[Layer], size: tuple[int, int], job: Job = Job(), fg: DataFrame | None = None, clamp: int = foreground.NEAR_BLACK, processed: bool = True, only_visible: bool = False) -> DataFrame:
    """All plates of a job: layer_idx, x, y, d.  Layers that union others run after those, whose previews are then written once."""
    src = foreground.clamp_near_black(px, clamp) if clamp else px
    plan = [(i, x) for i, x in enumerate(layers) if not only_visible or (x.visible and x.include_in_export)]
    unions = [(i, x) for i, x in plan if x.extractor["kind"] == "composite_union"]
    previews, first = [], []
    for group in _groups([(i, x) for i, x in plan if x.extractor["kind"] != "composite_union"]):
        i, x = group[0]
        if len(group) > 1:
            preview = shape(_extract_together(src, group), x, fg)
        else:
            preview = shape(E.extract(src, x.extractor), x, fg).withColumn("layer_idx", F.lit(i))
        previews.append((group, preview))
    if unions and previews:  # the unions and the plates both read the previews
        columns = previews[0][1].columns
        masks = checkpointed(together([p.select(columns) for _, p in previews]))
        previews = [(group, masks.where(F.col("layer_idx").isin([i for i, _ in group]))) for group, _ in previews]
    for group, preview in previews:
        i, x = group[0]
        final = preview if not processed else render(preview, x, size, job, fg) if len(group) > 1 else render(preview.drop("layer_idx"), x, size, job, fg).withColumn("layer_idx", F.lit(i))
        first.append(final)
    for i, x in unions:
        if previews:
            rows = px.sparkSession.createDataFrame(layer_rows(layers), LAYER_SCHEMA)
            union = L.composite_union(masks, rows, src, own=i)
        else:
            union = E.extract(src, x.extractor)
        preview, final = process_layer(src, x, size, job, fg, extracted=union)
        first.append((final if processed else preview).withColumn("layer_idx", F.lit(i)))
    return together(first)


def together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
