"""Planning and separating many images at once: pixel relations with an image_id.

Statistics and palettes are one job over all images, with a group an image
where numpy is needed; such a group is the image's systematic sample, of at
most SAMPLE pixels.  Plates are carried out for all images that share a size
and a layer list together, since every kernel keys by image_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import foreground
from ..operators import palette as P
from . import pipeline, workflows
from .layer import Job, Layer


def sizes(px: DataFrame) -> DataFrame:
    """image_id, w, h, n."""
    return px.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.count("*").alias("n"))


def palettes(px: DataFrame, max_colors: int, min_coverage: float) -> DataFrame:
    """image_id, idx, r, g, b, coverage of every image's palette, as palette.auto_palette finds it."""
    strides = sizes(px).select("image_id", F.greatest(F.ceil(F.col("n") / P.SAMPLE), F.lit(1)).alias("_stride"), "n")
    sample = C.with_lab(px.join(strides, "image_id").where(F.col("i") % F.col("_stride") == 0)).select("image_id", "i", "l", "a", "b_")

    def seek(f: pd.DataFrame) -> pd.DataFrame:
        points = f.sort_values("i")[["l", "a", "b_"]].to_numpy(float).round(9) + 0.0
        centers = P.refine(points, P.median_cut(points, max(2 * max_colors, 4)))
        return pd.DataFrame({"image_id": f["image_id"].iloc[0], "k": range(len(centers)), "cl": centers[:, 0], "ca": centers[:, 1], "cb": centers[:, 2]})

    found = sample.groupBy("image_id").applyInPandas(seek, "image_id string, k int, cl double, ca double, cb double")
    centers = found.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("k", "cl", "ca", "cb"))).alias("_c"))  # at most 2 * max_colors an image
    lab = C.with_lab(px).select("image_id", "l", "a", "b_").join(centers, "image_id")
    near = F.transform("_c", lambda c: F.struct(F.floor(C.delta_e94("l", "a", "b_", c["cl"], c["ca"], c["cb"]) * P.NINE + 0.5).alias("d"), c["k"].alias("k"), c["cl"].alias("cl"), c["ca"].alias("ca"), c["cb"].alias("cb")))
    counts = lab.select("image_id", F.array_min(near).alias("o")).groupBy("image_id", "o.k", "o.cl", "o.ca", "o.cb").count()
    rgb = C.lab_to_rgb(F.col("cl"), F.col("ca"), F.col("cb"))
    entries = counts.join(strides.select("image_id", "n"), "image_id").select("image_id", "k", *(c.alias(n) for c, n in zip(rgb, "rgb")), (F.col("count") / F.col("n")).alias("coverage"))
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("coverage"), "k")) - 1
    return entries.where(F.col("coverage") >= min_coverage).withColumn("idx", rank).where(F.col("idx") < max_colors).select("image_id", "idx", "r", "g", "b", "coverage")


def detected(px: DataFrame) -> DataFrame:
    """image_id and the workflow that each image's statistics call for."""
    size = sizes(px)
    step = F.greatest(F.floor(F.least("w", "h") / 100), F.lit(1))
    grid = px.join(size.withColumn("_step", step).select("image_id", "_step"), "image_id").where((F.col("x") % F.col("_step") == 0) & (F.col("y") % F.col("_step") == 0))
    counts = C.with_lab(grid.select("image_id", "r", "g", "b")).select("image_id", C.chroma().alias("chroma")).groupBy("image_id", "chroma").count()
    upto = F.sum("count").over(Window.partitionBy("image_id").orderBy("chroma"))
    total = F.sum("count").over(Window.partitionBy("image_id"))
    p95 = counts.withColumns({"upto": upto, "total": total}).where(F.col("upto") > F.floor(F.col("total") * 0.95)).groupBy("image_id").agg(F.min("chroma").alias("p95"))
    stats = P.histogram_stats(px, "image_id").join(p95, "image_id").join(size, "image_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"image_id": f["image_id"], "workflow": [workflows.choose(w * h, n, peak, p) for w, h, n, peak, p in zip(f["w"], f["h"], f["n_colors"], f["peak"], f["p95"])]})

    return stats.select("image_id", "w", "h", "n_colors", "peak", "p95").mapInPandas(run, "image_id string, workflow string")


def plans(px: DataFrame, workflow: str, o: workflows.Options = workflows.Options()) -> dict[str, list[Layer]]:
    """The layers of each image.  Layer lists are on the driver, a small record an image; palettes come from one job."""
    needed = workflows.palette_of(workflow, o)
    if needed is None:
        layers = workflows.plan(workflow, px, o)
        return {r["image_id"]: layers for r in px.select("image_id").distinct().collect()}
    entries: dict[str, list] = {r["image_id"]: [] for r in px.select("image_id").distinct().collect()}
    for r in sorted(palettes(px, *needed).collect(), key=lambda r: (r["image_id"], r["idx"])):
        entries[r["image_id"]].append(P.Entry((r["r"], r["g"], r["b"]), r["coverage"]))
    return {k: workflows.plan(workflow, px, o, palette=v) for k, v in entries.items()}


def separate(px: DataFrame, planned: dict[str, list[Layer]], job: Job = Job(), clamp: int = foreground.NEAR_BLACK, processed: bool = True) -> DataFrame:
    """image_id, layer_idx, x, y, d of all images: one plan for each size and layer list that occurs."""
    alike: dict[tuple, list[str]] = {}
    for r in sizes(px).collect():  # a row an image
        if planned.get(r["image_id"]):
            alike.setdefault(((r["w"], r["h"]), tuple(str(x.__dict__ | {"id": ""}) for x in planned[r["image_id"]])), []).append(r["image_id"])
    parts = [pipeline.separate(px.where(F.col("image_id").isin(ids)), planned[ids[0]], size, job, clamp=clamp, processed=processed) for (size, _), ids in alike.items()]
    if not parts:
        raise ValueError("no image has layers")
    return pipeline.together([p.select("image_id", "layer_idx", "x", "y", "d") for p in parts])
