"""Extractors: pixels to ink density (0 = full ink), one Column each where that can be said.

`extract(px, spec)` returns px's key columns and d.  px needs x, y, r, g, b and
any key columns before them (image_id, say).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions import dsl

RGB = tuple[int, int, int]
RAMP = 6.0


def keys_of(px: DataFrame) -> list[str]:
    """The columns that tell images or layers apart."""
    return [c for c in px.columns if c in ("image_id", "layer_idx")]


def spot_solid(target: RGB, tolerance: int = 0) -> Column:
    near = [F.abs(F.col(c) - t) <= tolerance for c, t in zip("rgb", target)]
    return F.when(near[0] & near[1] & near[2], 0).otherwise(255)


def target_distances(targets: list[RGB], weights: list[float] | None = None) -> list[Column]:
    """Weighted difference of a pixel (l, a, b_) from each target."""
    weights = weights if weights and len(weights) == len(targets) else [0.0] * len(targets)
    return [C.delta_e94("l", "a", "b_", *C.lab_of(t)) - w for t, w in zip(targets, weights)]


def nearest(distances: list[Column]) -> Column:
    """A struct d, i: the least distance and its index, the lowest among equals."""
    return F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(distances))))


def spot_plates(lab: DataFrame, targets: list[RGB], others: list[RGB] = (), weights: list[float] | None = None) -> DataFrame:
    """All soft-edged spot plates in one pass: lab's columns and plates, an array with a density for each target.

    The distances are computed once; each plate needs its own and the least of the rest.
    """
    if not targets:
        return lab.withColumn("plates", F.array().cast("array<int>"))
    n = len(targets)
    # a column each: references to costly columns are not inlined, elements of an array would be
    out = lab.withColumns({f"_d{i}": c for i, c in enumerate(target_distances(targets, weights))})
    d = [F.col(f"_d{i}") for i in range(n)]
    out = out.withColumn("_w", nearest(d))
    rejected = F.lit(False)
    for o in others:
        rejected = rejected | (C.delta_e94("l", "a", "b_", *C.lab_of(o)) < F.col("_w.d"))
    plates = []
    for i in range(n):
        rest = [d[k] for k in range(n) if k != i]
        best = F.least(*rest) if len(rest) > 1 else rest[0] if rest else F.lit(1e30)
        raw = 128.0 - (best - d[i]) * (128.0 / RAMP)
        raw = raw + F.when(F.col("_w.i") == i, -0.5).otherwise(0.5)
        plates.append(F.when(F.col("_rejected"), 255).otherwise(C.clamp(raw, 0.0, 255.0).cast("int")))
    return out.withColumn("_rejected", rejected).withColumn("plates", F.array(*plates)).select(*lab.columns, "plates")


def color_range(target: RGB, fuzziness: float, kind: str = "smooth") -> Column:
    t = C.clamp(C.delta_e94("l", "a", "b_", *C.lab_of(target)) / max(fuzziness, 1.0), 0.0, 1.0)
    return C.byte(255.0 * C.falloff(t, kind))


def hsb_brightness_inverted(s_curve: float = 1.0, boost_under_darks: bool = False, boost: float = 1.0) -> Column:
    v = C.value()
    amount = C.logistic_s(v, max(s_curve, 0.1))
    if boost_under_darks:
        gate = C.clamp((v - 0.10) / 0.15, 0.0, 1.0)
        amount = C.clamp(amount + C.saturation() * (1.0 - v) * gate * min(max(boost, 0.0), 2.0), 0.0, 1.0)
    return C.byte(255.0 * (1.0 - amount))


def lab_lightness_inverted() -> Column:
    return C.byte(255.0 * (1.0 - C.clamp(F.col("l"), 0.0, 100.0) / 100.0))


def gcr_black(strength: float = 1.0, invert: bool = False) -> Column:
    k = F.least("r", "g", "b") if invert else 255 - F.greatest("r", "g", "b")
    return 255 - C.byte(k * F.lit(min(max(strength, 0.0), 2.0)))


def channel_calc(text: str) -> Column:
    """Raises DslError for a wrong expression."""
    return C.byte(255.0 * (1.0 - dsl.compile_expr(text)))


def luminance_threshold(threshold: int = 128, above: bool = False) -> Column:
    light = C.luma()
    return F.when(light >= threshold if above else light < threshold, 0).otherwise(255)


def cmyk_channel(channel: str, gcr: float = 0.75) -> Column:
    inks = [1.0 - C.to_linear(c) for c in "rgb"]
    k = F.least(*inks) * F.lit(min(max(gcr, 0.0), 1.0))
    ink = {"cyan": 0, "magenta": 1, "yellow": 2}
    v = k if channel == "black" else F.greatest(inks[ink[channel]] - k, F.lit(0.0))
    return C.byte(255.0 * (1.0 - v))


def bayer_matrix(n: int) -> np.ndarray:
    """The ordered-dither matrix of size 2, 4, 8 by its doubling rule; other sizes fall back to 8."""
    m = np.zeros((1, 1), int)
    for _ in range({2: 1, 4: 2}.get(n, 3)):
        m = np.block([[4 * m, 4 * m + 2], [4 * m + 3, 4 * m + 1]])
    return m


def index_bayer(palette: list[RGB]) -> Column:
    """The palette index of each pixel whose lightness is shifted by an 8 x 8 ordered matrix."""
    m = F.element_at(F.array(*(F.lit(int(v)) for v in bayer_matrix(8).ravel())), (F.pmod("y", F.lit(8)) * 8 + F.pmod("x", F.lit(8)) + 1).cast("int"))
    light = F.col("l") + (m - 31.5) / 31.5 * 8.0
    return nearest([C.delta_e94(light, "a", "b_", *C.lab_of(t)) for t in palette])["i"]


def index_floyd_steinberg(px: DataFrame, palette: list[RGB]) -> DataFrame:
    """px's keys, x, y and idx: error diffusion in LAB along a serpentine, image by image (a recurrence, so one task an image)."""
    labs, keys = np.array([C.lab_of(t) for t in palette]), keys_of(px)
    chromas = np.hypot(labs[:, 1], labs[:, 2])

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"])
        w, h = f["x"].nunique(), f["y"].nunique()
        err = f[["l", "a", "b_"]].to_numpy().reshape(h, w, 3).copy()
        out = np.zeros((h, w), np.int32)
        for y in range(h):
            ahead = 1 if y % 2 == 0 else -1
            for x in range(w)[::ahead]:
                v = err[y, x]
                dl, dc = v[0] - labs[:, 0], np.hypot(v[1], v[2]) - chromas
                dh2 = np.maximum((v[1] - labs[:, 1]) ** 2 + (v[2] - labs[:, 2]) ** 2 - dc * dc, 0)
                k = int(((dl / 2) ** 2 + (dc / (1 + 0.048 * chromas)) ** 2 + dh2 / (1 + 0.014 * chromas) ** 2).argmin())
                out[y, x], e = k, v - labs[k]
                for dx, dy, part in ((ahead, 0, 7), (-ahead, 1, 3), (0, 1, 5), (ahead, 1, 1)):
                    if 0 <= x + dx < w and y + dy < h:
                        err[y + dy, x + dx] += e * (part / 16)
        return f[[*keys, "x", "y"]].assign(idx=out.ravel())

    kinds = {k: t for k, t in px.dtypes}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"x {kinds['x']}", f"y {kinds['y']}", "idx int"])
    lab = C.with_lab(px).select(*keys, "x", "y", "l", "a", "b_")
    return lab.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInPandas(run, schema)


def manual_paint(px: DataFrame, width: int, height: int, pixels: bytes | None) -> Column:
    """A stored mask, nearest-resized to the image; all 255 if there is none or its size is wrong.  px has one size, in w and h."""
    if not pixels or width * height != len(pixels):
        return F.lit(255)
    at = F.floor(F.col("y") * height / F.col("h")) * width + F.floor(F.col("x") * width / F.col("w"))
    return F.conv(F.hex(F.substring(F.lit(bytearray(pixels)), (at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")


LAB_KINDS = {"spot_aa", "color_range", "lab_lightness_inverted", "channel_calc", "index_assignment"}


def extract(px: DataFrame, spec: dict) -> DataFrame:
    """keys, x, y, d of one extractor; spec: kind and its parameters.  A wrong expression gives a blank plate."""
    keys, kind = [*keys_of(px), "x", "y"], spec["kind"]
    src = C.with_lab(px) if kind in LAB_KINDS else px
    p = {k: v for k, v in spec.items() if k != "kind"}
    match kind:
        case "spot_solid":
            d = spot_solid(tuple(p["ink"]), p.get("tolerance", 0))
        case "spot_aa":
            targets = [tuple(t) for t in p["targets"]]
            if not targets:
                d = F.lit(0)
            else:
                at = targets.index(tuple(p["ink"])) if tuple(p["ink"]) in targets else 0
                return spot_plates(src, targets, [tuple(o) for o in p.get("others", ())], p.get("target_weights")).select(*keys, F.col("plates")[at].alias("d"))
        case "color_range":
            d = color_range(tuple(p["target"]), p["fuzziness"], p.get("falloff", "smooth"))
        case "hsb_brightness_inverted":
            d = hsb_brightness_inverted(p.get("s_curve", 1.0), p.get("boost_under_darks", False), p.get("boost_strength", 1.0))
        case "lab_lightness_inverted":
            d = lab_lightness_inverted()
        case "gcr_black":
            d = gcr_black(p.get("strength", 1.0), p.get("invert_input", False))
        case "channel_calc":
            try:
                d = channel_calc(p["expr"])
            except dsl.DslError:
                d = F.lit(255)
        case "luminance_threshold":
            d = luminance_threshold(p.get("threshold", 128), p.get("above", False))
        case "index_assignment":
            palette, index = [tuple(t) for t in p["palette"]], p["index"]
            if not 0 <= index < len(palette):
                d = F.lit(255)
            elif p.get("dither", "bayer") == "bayer":
                d = F.when(index_bayer(palette) == index, 0).otherwise(255)
            else:
                return index_floyd_steinberg(px, palette).select(*keys, F.when(F.col("idx") == index, 0).otherwise(255).alias("d"))
        case "cmyk_channel":
            d = cmyk_channel(p["channel"], p.get("gcr_strength", 0.75))
        case "manual_paint":
            size = px.groupBy(*keys_of(px)).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
            src = px.join(F.broadcast(size), keys_of(px)) if keys_of(px) else px.crossJoin(F.broadcast(size))
            d = manual_paint(src, p.get("width", 0), p.get("height", 0), p.get("pixels"))
        case "composite_union":
            d = F.lit(255)  # the two-pass driver puts the union here
        case _:
            raise ValueError(f"unknown extractor: {kind}")
    return src.select(*keys, d.cast("int").alias("d"))
