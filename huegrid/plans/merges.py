"""Merges of chosen layers as edits of the layer list.

A merged mask becomes its layer's paint buffer (width, height, pixels), which
is part of the list and so comes to the driver: one plate's bytes a merge.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layers as L
from .layer import BLACK, LAYER_SCHEMA, Halftone, Layer, MaskShape, Tone, layer_rows, reindexed


def paint_of(mask: DataFrame, size: tuple[int, int]) -> dict:
    """x, y, d of one mask as a paint extractor; pixels that it lacks hold no ink.  Rows of pixels come to the driver as bytes."""
    w, h = size

    def line(t: pa.Table) -> pa.Table:
        out = np.full(w, 255, np.uint8)
        out[t.column("x").to_numpy()] = t.column("d").to_numpy()
        return pa.table({"y": t.column("y").slice(0, 1).cast(pa.int32()), "line": [out.tobytes()]})

    sheet = np.full((h, w), 255, np.uint8)
    for r in mask.select("x", "y", "d").groupBy("y").applyInArrow(line, "y int, line binary").toArrow().to_pylist():
        sheet[r["y"]] = np.frombuffer(r["line"], np.uint8)
    return {"kind": "manual_paint", "width": w, "height": h, "pixels": sheet.tobytes()}


def _chosen(layers: list[Layer], previews: DataFrame, ids: set[str], size: tuple[int, int]) -> tuple[list[int], DataFrame] | None:
    """The chosen layers that have a preview, and these; None if they are fewer than two or one has another size."""
    has = {r["layer_idx"] for r in previews.select("layer_idx").distinct().collect()}  # a row a layer
    at = [i for i, x in enumerate(layers) if x.id in ids and i in has]
    masks = previews.where(F.col("layer_idx").isin(at))
    if len(ids) < 2 or len(at) < 2 or L.of_size(masks, size).select("layer_idx").distinct().count() < len(at):
        return None
    return at, masks


def merge_same_ink(layers: list[Layer], previews: DataFrame, ids: set[str], size: tuple[int, int]) -> list[Layer] | None:
    """The chosen layers as one, the first of them, painted with the most ink that any of them has; None unless they are two or more of one ink and size."""
    found = _chosen(layers, previews, ids, size)
    if found is None or len({layers[i].ink for i in found[0]}) > 1:
        return None
    (keeper, *gone), masks = found
    out = list(layers)
    out[keeper] = replace(out[keeper], extractor=paint_of(L.union_min(masks.drop("layer_idx")), size))
    return reindexed([x for i, x in enumerate(out) if i not in gone])


def merge_to_shadow(layers: list[Layer], previews: DataFrame, ids: set[str], size: tuple[int, int]) -> list[Layer] | None:
    """The lightest of the chosen layers takes all their pixels, and a new black halftone after it the darkening that the others meant; None unless they are two or more of one size."""
    found = _chosen(layers, previews, ids, size)
    if found is None:
        return None
    at, masks = found
    rows = previews.sparkSession.createDataFrame([r for r in layer_rows(layers) if r[0] in at], LAYER_SCHEMA)
    merged = L.shadow_merge(masks, rows)
    keeper = L.lightest(rows)
    base = layers[keeper]
    shadow = Layer(
        BLACK, f"{base.name} shadow", "shadow", extractor=paint_of(merged.select("x", "y", F.col("shadow_d").alias("d")), size),
        tone=Tone(), mask=MaskShape(), render_mode="halftone", halftone=Halftone(0, -1.0, "round", "linear"),
    )
    kept = replace(base, extractor=paint_of(merged.select("x", "y", F.col("union_d").alias("d")), size))
    out = []
    for i, x in enumerate(layers):
        if i == keeper:
            out += [kept, shadow]
        elif i not in at:
            out.append(x)
    return reindexed(out)
