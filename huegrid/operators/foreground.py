"""Backgrounds: flood fill, alpha masks, knockout, and filters on the source."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from .extract import RGB, keys_of
from .palette import border_pixels, modal_color

NEAR_BLACK = 50


def clamp_near_black(px: DataFrame, threshold: int = NEAR_BLACK) -> DataFrame:
    dark = F.greatest("r", "g", "b") < threshold
    return px.withColumns({c: F.when(dark, 0).otherwise(F.col(c)).cast(px.schema[c].dataType) for c in "rgb"})


def _replaced(px: DataFrame, where, fill: RGB) -> DataFrame:
    return px.withColumns({c: F.when(where, v).otherwise(F.col(c)).cast(px.schema[c].dataType) for c, v in zip("rgb", fill)})


def fill_background(px: DataFrame, fill: RGB, tolerance: float) -> DataFrame:
    """Pixels close to the modal colour take the fill colour."""
    mode = modal_color(px).first()
    if mode is None:
        return px
    lab = C.with_lab(px)
    return _replaced(lab, C.delta_e("l", "a", "b_", *C.lab_of((mode["r"], mode["g"], mode["b"]))) < tolerance, fill).select(px.columns)


def desaturate(px: DataFrame) -> DataFrame:
    """Lightness alone."""
    lab = C.with_lab(px)
    gray = C.lab_to_rgb(F.col("l"), F.lit(0.0), F.lit(0.0))
    return lab.select(*(gray["rgb".index(c)].cast(px.schema[c].dataType).alias(c) if c in "rgb" else F.col(c) for c in px.columns))


def alpha_mask(px: DataFrame) -> DataFrame | None:
    """x, y, is_fg from alpha; None if the image is opaque."""
    keys = keys_of(px)
    if px.where("alpha < 255").isEmpty():
        return None
    return px.select(*keys, "x", "y", (F.col("alpha") >= 128).alias("is_fg"))


#: Rows of a band, whose runs one task joins.
BAND = 256


def _banded(f: pd.DataFrame) -> pd.DataFrame:
    """Runs of one band of rows with c, the first run (y, x0) of those that they join, and whether any of these is at the edge."""
    f = f.sort_values(["y", "x0"], ignore_index=True)
    y, x0, x1 = (f[c].to_numpy() for c in ("y", "x0", "x1"))
    up = list(range(len(f)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    at = np.searchsorted(y, [*range(int(y[0]), int(y[-1]) + 2)])
    for a, m, z in zip(at[:-2], at[1:-1], at[2:]):
        i, j = a, m
        while i < m and j < z:
            if x0[i] <= x1[j] and x0[j] <= x1[i]:
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(k) for k in range(len(f))])
    edge = np.zeros(len(f), bool)
    np.logical_or.at(edge, roots, f["edge"].to_numpy())
    return f.assign(cy=y[roots], cx=x0[roots], edge=edge[roots])


def flood_background(px: DataFrame, tolerance: float = 12.0) -> DataFrame:
    """keys, x, y, is_fg: false for pixels near the border's modal colour that reach the border through such pixels.

    Rows are cut into runs of such pixels.  Runs that overlap in adjacent rows
    join within bands of BAND rows, a task each; then bands join where they
    meet, as the connected components of a small graph, in rounds that grow
    with the logarithm of its size.
    """
    from .._stage import checkpointed
    from .graph import components

    keys = keys_of(px)
    mode = modal_color(border_pixels(px, *keys), *keys)
    lab = C.with_lab(px.join(F.broadcast(C.with_lab(mode, ("ml", "ma", "mb")).select(*keys, "ml", "ma", "mb")), keys) if keys else px.crossJoin(F.broadcast(C.with_lab(mode, ("ml", "ma", "mb")).select("ml", "ma", "mb"))))
    near = lab.where(C.delta_e("l", "a", "b_", "ml", "ma", "mb") < tolerance).select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    row = Window.partitionBy(*keys, "y").orderBy("x")
    islands = near.withColumn("_g", F.col("x") - F.row_number().over(row))
    runs = islands.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")
    size = px.groupBy(*keys).agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    runs = runs.join(F.broadcast(size), keys) if keys else runs.crossJoin(F.broadcast(size))
    runs = runs.withColumns({"edge": (F.col("x0") == 0) | (F.col("x1") == F.col("_w")) | (F.col("y") == 0) | (F.col("y") == F.col("_h")), "band": F.floor(F.col("y") / BAND)}).drop("_w", "_h")
    kinds = dict(px.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "y long, x0 long, x1 long, edge boolean, band long, cy long, cx long"])
    runs = checkpointed(runs.groupBy(*keys, "band").applyInPandas(_banded, schema))

    # a node is a band's component; bands meet in the last row of one and the first of the next
    node = F.struct(*keys, "cy", "cx")
    low = runs.where(F.col("y") % BAND == BAND - 1).select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("_a"), F.col("x1").alias("_z"), node.alias("a"))
    links = low.join(runs.where(F.col("y") % BAND == 0).select(*keys, "y", "x0", "x1", node.alias("b")), [*keys, "y"]).where("x0 <= _z and x1 >= _a").select("a", "b").distinct()
    roots = components(links)
    named = runs.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    reached = named.groupBy("root").agg(F.bool_or("edge").alias("_out")).where("_out").select("root")
    background = named.join(reached, "root", "left_semi").select(*keys, F.col("y").cast(kinds["y"]).alias("y"), F.explode(F.sequence("x0", "x1")).alias("x"))
    background = background.withColumn("x", F.col("x").cast(kinds["x"])).withColumn("_bg", F.lit(True))
    return px.select(*keys, "x", "y").join(background, [*keys, "x", "y"], "left").select(*keys, "x", "y", F.col("_bg").isNull().alias("is_fg"))


def detect_foreground(px: DataFrame, remove: bool = True, tolerance: float = 12.0) -> DataFrame | None:
    """Alpha if there is any, else the flood fill if wanted, else no mask."""
    mask = alpha_mask(px) if "alpha" in px.columns else None
    return mask if mask is not None else flood_background(px, tolerance) if remove else None


def knockout(mask: DataFrame, fg: DataFrame | None) -> DataFrame:
    """No ink on the background; pixels that fg lacks stay."""
    if fg is None:
        return mask
    on = [c for c in ("image_id", "x", "y") if c in mask.columns and c in fg.columns]
    joined = mask.join(fg.select(*on, "is_fg"), on, "left")
    return joined.withColumn("d", F.when(~F.coalesce("is_fg", F.lit(True)), 255).otherwise(F.col("d")).cast(mask.schema["d"].dataType)).select(mask.columns)


def mask_source(px: DataFrame, fg: DataFrame, fill: RGB) -> DataFrame:
    """Background pixels take the fill colour."""
    on = [*keys_of(px), "x", "y"]
    joined = px.join(fg.select(*on, "is_fg"), on, "left")
    return _replaced(joined, ~F.coalesce("is_fg", F.lit(True)), fill).select(px.columns)
