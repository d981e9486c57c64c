"""Two-dimensional neighbourhood operators over (keys, x, y, d).

Separable passes: a window along each row, then one along each column, so two
shuffles whatever the radius, and a task never holds more than one row or
column of one image.  Frames are RANGE frames on the coordinate, so gaps in
the grid are neighbours that do not exist.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import byte
from .extract import keys_of


def disk_offsets(r: int) -> list[tuple[int, int]]:
    """All (dx, dy) with dx^2 + dy^2 <= r^2; r = 1 is a plus."""
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= r * r]


def _row(df: DataFrame):
    return Window.partitionBy(*keys_of(df), "y").orderBy("x")


def _column(df: DataFrame):
    return Window.partitionBy(*keys_of(df), "x").orderBy("y")


def _disk(df: DataFrame, r: int, biggest: bool) -> DataFrame:
    if r <= 0:
        return df
    of, pick = (F.max, F.greatest) if biggest else (F.min, F.least)
    half = {dy: math.isqrt(r * r - dy * dy) for dy in range(-r, r + 1)}
    rows = df.withColumns({f"_h{h}": of("d").over(_row(df).rangeBetween(-h, h)) for h in sorted(set(half.values()))})
    column = _column(df)
    reach = [of(f"_h{h}").over(column.rangeBetween(dy, dy)) for dy, h in half.items()]
    return rows.withColumn("d", pick(*reach)).select(df.columns)


def erode_ink(df: DataFrame, r: int) -> DataFrame:
    """Less ink: the largest density within the disk."""
    return _disk(df, r, True)


def dilate_ink(df: DataFrame, r: int) -> DataFrame:
    """More ink: the smallest density within the disk."""
    return _disk(df, r, False)


def open_ink(df: DataFrame, r: int) -> DataFrame:
    return dilate_ink(erode_ink(df, r), r)


def close_ink(df: DataFrame, r: int) -> DataFrame:
    return erode_ink(dilate_ink(df, r), r)


def gaussian_weights(sigma: float) -> list[float]:
    r = math.ceil(2 * sigma)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def _blur_pass(of: str, window, weights: list[float]) -> Column:
    r = len(weights) // 2
    whole = window.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(of).over(whole), F.last(of).over(whole)
    terms = [F.lit(w) * (F.coalesce(F.max(of).over(window.rangeBetween(k, k)), first if k < 0 else last) if k else F.col(of)) for k, w in zip(range(-r, r + 1), weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def smooth_mask(df: DataFrame, sigma: float) -> DataFrame:
    """Gaussian blur of radius ceil(2 sigma), edges repeated; sigma <= 0 changes nothing."""
    if sigma <= 0:
        return df
    w = gaussian_weights(sigma)
    out = df.withColumn("_d", _blur_pass("d", _row(df), w))
    return out.withColumn("d", byte(_blur_pass("_d", _column(df), w))).select(df.columns)


feather_edge = smooth_mask


def box_mean(df: DataFrame, half: int) -> DataFrame:
    """Integer mean (rounded down) over the (2 half + 1)^2 box, cut at the image's edges."""
    wide = _row(df).rangeBetween(-half, half)
    tall = _column(df).rangeBetween(-half, half)
    out = df.withColumns({"_s": F.sum("d").over(wide), "_n": F.count("d").over(wide)})
    return out.withColumns({"_s2": F.sum("_s").over(tall), "_n2": F.sum("_n").over(tall)}).withColumn("d", F.floor(F.col("_s2") / F.col("_n2")).cast("int")).select(df.columns)


def downsample(df: DataFrame, factor: int) -> DataFrame:
    """Integer mean of factor x factor blocks; at the right and lower edge, of the pixels that a block has."""
    keys = keys_of(df)
    grouped = df.groupBy(*keys, F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y"))
    return grouped.agg(F.floor(F.sum("d") / F.count("d")).cast("int").alias("d"))


def apply_offsets(df: DataFrame, offsets: list[tuple[int, int]], biggest: bool) -> DataFrame:
    """Max or min over any set of offsets, by sending each pixel to its neighbours."""
    sent = df.select("*", F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets))).alias("o"))
    keys = keys_of(df)
    moved = sent.select(*keys, (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), "d")
    return moved.groupBy(*keys, "x", "y").agg((F.max if biggest else F.min)("d").alias("d")).join(df.select(*keys, "x", "y"), [*keys, "x", "y"], "left_semi")
