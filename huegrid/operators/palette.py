"""Aggregates over pixels, and palette extraction.

Assignment and statistics run over all pixels on the executors.  Seeding and
refining use a systematic sample of at most SAMPLE pixels, the bound that the
extraction itself defines, so they run on the driver in numpy.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._stage import checkpointed
from ..functions import color as C
from .extract import RGB, nearest

SAMPLE, ROUNDS, STILL, CHROMA_BINS, NINE = 80_000, 15, 0.5, 4096, 1e9


@dataclass(frozen=True)
class Entry:
    rgb: RGB
    coverage: float


# ------------------------------------------------------------------ aggregates


def modal_color(px: DataFrame, *keys: str) -> DataFrame:
    """The most frequent colour, the smallest among equals: r, g, b, n."""
    counts = px.groupBy(*keys, "r", "g", "b").count()
    best = counts.groupBy(*keys).agg(F.max(F.struct(F.col("count").alias("n"), (-F.col("r")).alias("r"), (-F.col("g")).alias("g"), (-F.col("b")).alias("b"))).alias("m"))
    return best.select(*keys, (-F.col("m.r")).alias("r"), (-F.col("m.g")).alias("g"), (-F.col("m.b")).alias("b"), F.col("m.n").alias("n"))


def border_pixels(px: DataFrame, *keys: str) -> DataFrame:
    """The frame's pixels; corners count twice."""
    size = px.groupBy(*keys).agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    at = px.join(F.broadcast(size), list(keys)) if keys else px.crossJoin(F.broadcast(size))
    times = ((F.col("y") == 0).cast("int") + (F.col("y") == F.col("_h")).cast("int") + (F.col("x") == 0).cast("int") + (F.col("x") == F.col("_w")).cast("int"))
    return at.select(*px.columns, F.explode(F.array_repeat(F.lit(0), times)).alias("_")).drop("_")


def histogram_stats(px: DataFrame, *keys: str) -> DataFrame:
    """Colours at 16 levels a channel: how many there are, and the share of the largest."""
    level = lambda c: F.col(c).bitwiseAND(0xF0)
    counts = px.groupBy(*keys, level("r").alias("r"), level("g").alias("g"), level("b").alias("b")).count()
    return counts.groupBy(*keys).agg(F.count("*").alias("n_colors"), (F.max("count") / F.sum("count")).alias("peak"))


def p95_chroma(px: DataFrame, width: int, height: int) -> DataFrame:
    """Element floor(0.95 n) of the ascending chromas on a grid of every min(width, height) div 100 pixels.

    Chromas are counted in BINS bins; the element is then looked for among the counted values of its bin alone.
    """
    step = max(min(width, height) // 100, 1)
    c = C.with_lab(px.where((F.col("x") % step == 0) & (F.col("y") % step == 0))).select(C.chroma().alias("chroma"))
    # written once: both passes read it, and a filter on bin would otherwise repeat the colour maths in one huge expression
    c = checkpointed(c.withColumn("bin", F.least(F.floor(F.col("chroma") * (CHROMA_BINS / 256)), F.lit(CHROMA_BINS))))
    counts = sorted((r["bin"], r["count"]) for r in c.groupBy("bin").count().collect())  # at most CHROMA_BINS + 1 rows
    rank = math.floor(sum(n for _, n in counts) * 0.95)
    at = None
    for at, n in counts:
        if rank < n:
            break
        rank -= n
    values = c.where(F.col("bin") == F.lit(at)).groupBy("chroma").count()
    upto = values.select("chroma", F.sum("count").over(Window.orderBy("chroma")).alias("upto"))  # the distinct values of one bin
    return upto.where(F.col("upto") > rank).agg(F.min("chroma").alias("p95"))


def coverage_fraction(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.when(F.col("d") < 128, 1.0).otherwise(0.0)).alias("coverage"))


def snap(lab: tuple, rgb: RGB) -> RGB:
    if math.hypot(lab[1], lab[2]) < 10:
        return (0, 0, 0) if lab[0] < 15 else (255, 255, 255) if lab[0] > 92 else rgb
    return rgb


def snap_extremes(palette: list[Entry]) -> list[Entry]:
    """Nearly black and nearly white entries become pure."""
    return [Entry(snap(C.lab_of(e.rgb), e.rgb), e.coverage) for e in palette]


def print_score(rgb: RGB) -> float:
    return -1.0 if rgb == (255, 255, 255) else 1000.0 if rgb == (0, 0, 0) else 100.0 - C.lab_of(rgb)[0]


def print_order(palette: list[Entry]) -> list[Entry]:
    """White first, then light to dark, black last."""
    return sorted(palette, key=lambda e: print_score(e.rgb))


def _total(values: Iterable[float]) -> float:
    """Plain additions one after the other, as in SQL: sum() compensates for rounding, and groups of almost one coverage would change places."""
    return reduce(add, values, 0.0)


def consolidate_by_hue(palette: list[Entry], hue_tolerance: float = 10.0, gray_chroma: float = 6.0) -> list[Entry]:
    """Entries join the first group with a member of their hue (or, for grays, of their lightness); a group's colour is weighted by coverage."""
    labs = [C.lab_of(e.rgb) for e in palette]
    hue = [math.degrees(math.atan2(b, a)) % 360 for _, a, b in labs]
    gray = [math.hypot(a, b) < gray_chroma for _, a, b in labs]

    def alike(i: int, j: int) -> bool:
        if gray[i] or gray[j]:
            return gray[i] and gray[j] and abs(labs[i][0] - labs[j][0]) < 10
        apart = abs(hue[i] - hue[j])
        return min(apart, 360 - apart) < hue_tolerance

    groups: list[list[int]] = []
    for i in range(len(palette)):
        home = next((g for g in groups if any(alike(i, j) for j in g)), None)
        groups.append([i]) if home is None else home.append(i)
    out = []
    for g in groups:
        total = _total(palette[i].coverage for i in g)
        rgb = tuple(math.floor(_total(palette[i].rgb[k] * palette[i].coverage for i in g) / max(total, 1e-6) + 0.5) for k in range(3))
        out.append(Entry(rgb, total))
    return sorted(out, key=lambda e: -e.coverage)


# ------------------------------------------------------------------ extraction


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """CIE94 of each point to each centre, whose chroma scales, in units of its ninth place, so that ties do not hang on the last bits."""
    cp, cc = np.hypot(points[:, 1], points[:, 2])[:, None], np.hypot(centers[:, 1], centers[:, 2])[None, :]
    dl, dc = points[:, 0, None] - centers[None, :, 0], cp - cc
    dh2 = np.maximum((points[:, 1, None] - centers[None, :, 1]) ** 2 + (points[:, 2, None] - centers[None, :, 2]) ** 2 - dc**2, 0)
    return np.floor(np.sqrt((dl / 2) ** 2 + (dc / (1 + 0.048 * cc)) ** 2 + dh2 / (1 + 0.014 * cc) ** 2) * NINE + 0.5)


def _ranges(box: np.ndarray) -> np.ndarray:
    """Extents along L (half weight), a and b, to nine places, so that ties do not hang on the last bits."""
    span = box.max(axis=0) - box.min(axis=0)
    return (span * (0.5, 1.0, 1.0)).round(9)


def median_cut(points: np.ndarray, boxes: int) -> np.ndarray:
    """Means of boxes: the widest (the last of equals) is halved at its median along its widest axis (a, then b, then L)."""
    found = [points]
    while len(found) < boxes:
        widths = [_ranges(b).max() for b in found]
        at = max(range(len(found)), key=lambda i: (widths[i], i))
        if widths[at] < 1.0:
            break
        box = found.pop(at)
        rl, ra, rb = _ranges(box)
        axis = 1 if ra >= rl and ra >= rb else 2 if rb >= rl else 0
        box = box[np.argsort(box[:, axis], kind="stable")]
        half = len(box) // 2
        if not half:
            found.append(box)
            break
        found += [box[:half], box[half:]]
    return np.array([b.mean(axis=0) for b in found])


def refine(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """k-means under CIE94; centres without points stay put and are dropped at the end."""
    for _ in range(ROUNDS):
        near = _distances(points, centers).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centers))
        sums = np.column_stack([np.bincount(near, points[:, k], len(centers)) for k in range(3)])
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        moved = sum(C.delta_e94_of(a, b) for a, b in zip(centers, new))
        centers = new
        if moved < STILL:
            break
    return centers[np.unique(_distances(points, centers).argmin(axis=1))]


def assignment(lab: DataFrame, centers: list[tuple[float, float, float]]) -> DataFrame:
    """lab with k, the index of the nearest centre, the lowest among equals."""
    return lab.withColumn("k", nearest([F.floor(C.delta_e94("l", "a", "b_", *map(float, c)) * NINE + 0.5) for c in centers])["i"])


def kmeans_step(lab: DataFrame, centers: list[tuple[float, float, float]]) -> DataFrame:
    """One distributed round: k, n and the mean of each non-empty cluster."""
    return assignment(lab, centers).groupBy("k").agg(F.count("*").alias("n"), F.avg("l").alias("l"), F.avg("a").alias("a"), F.avg("b_").alias("b_"))


def auto_palette(px: DataFrame, max_colors: int, min_coverage: float) -> tuple[list[Entry], list[tuple]]:
    """The palette of an image (i, x, y, r, g, b) by descending coverage, and the centres that assignment() takes."""
    total = px.count()
    if not total or not max_colors:
        return [], []
    stride = max(-(-total // SAMPLE), 1)
    sample = C.with_lab(px.where(F.col("i") % stride == 0)).select("i", "l", "a", "b_").toPandas().sort_values("i")
    points = sample[["l", "a", "b_"]].to_numpy(float).round(9) + 0.0  # grays are equal along a and b
    centers = [tuple(c) for c in refine(points, median_cut(points, max(2 * max_colors, 4))).tolist()]
    counts = {r["k"]: r["count"] for r in assignment(C.with_lab(px), centers).groupBy("k").count().collect()}  # a row a centre
    found = [Entry(C.rgb_of(c), counts.get(k, 0) / total) for k, c in enumerate(centers)]
    found = sorted((e for e in found if e.coverage >= min_coverage), key=lambda e: -e.coverage)
    return found[:max_colors], centers


def requantized(px: DataFrame, centers: list[tuple]) -> DataFrame:
    """Each pixel in its centre's colour."""
    at = assignment(C.with_lab(px), centers)
    colors = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(C.rgb_of(k), "rgb"))) for k in centers))
    new = F.element_at(colors, F.col("k") + 1)
    return at.select(*(new[c].alias(c) if c in "rgb" else F.col(c) for c in px.columns))
