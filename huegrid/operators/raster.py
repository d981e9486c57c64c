"""Dithers and halftones over (keys, x, y, d).

Ordered dithers look a threshold up by coordinates modulo a tile.  The
halftone finds the cells of the rotated screen at their centre pixels, and each
cell draws its dot into the supersampled pixels of its box; a pixel's inked
parts are one bit set.  White noise is linear over bits and needs no order.
Floyd-Steinberg is a recurrence and takes one task an image.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import shape_curve
from .extract import bayer_matrix, keys_of
from .neighborhood import box_mean

SUPERSAMPLE, NEAR_WHITE, LEAST_COVERAGE, PRINT_INCHES, LEAST_DPI = 3, 248, 0.01, 13.0, 72.0


def _tile(values: np.ndarray) -> Column:
    n = len(values)
    at = F.pmod("y", F.lit(n)) * n + F.pmod("x", F.lit(n)) + 1
    return F.element_at(F.array(*(F.lit(int(v)) for v in values.ravel())), at.cast("int"))


def _cut(threshold: Column) -> Column:
    return F.when(F.col("d") > threshold, 255).otherwise(0)


def bayer(df: DataFrame, n: int = 8) -> DataFrame:
    m = bayer_matrix(n)
    return df.withColumn("d", _cut(_tile((m * 256 + 128) // m.size)))


def _xorshift(state: int) -> int:
    state ^= state << 13 & 0xFFFFFFFF
    state ^= state >> 17
    return state ^ (state << 5 & 0xFFFFFFFF)


@lru_cache(1)
def blue_noise_tile(n: int = 64, sigma: float = 1.5, reach: int = 5, seed: int = 0xC0FFEE) -> np.ndarray:
    """Void-and-cluster thresholds 0..255: a sparse pattern is evened out, then cells are ranked by crowding."""
    span = np.arange(-reach, reach + 1)
    bump = np.exp(-(span[:, None] ** 2 + span[None, :] ** 2) / (2 * sigma**2))
    kernel = np.zeros((n, n))
    for i, dy in enumerate(span):
        for j, dx in enumerate(span):
            if bump[i, j] > 0.005:
                kernel[dy % n, dx % n] = bump[i, j]

    def shifted(at: int) -> np.ndarray:
        return np.roll(kernel, (at // n, at % n), (0, 1)).ravel()

    def crowding(on: np.ndarray) -> np.ndarray:
        return sum((shifted(k) for k in np.flatnonzero(on)), np.zeros(n * n))

    def densest(on: np.ndarray, score: np.ndarray) -> int:
        return int(np.where(on, score, -1.0).argmax())

    def emptiest(on: np.ndarray, score: np.ndarray) -> int:
        return int(np.where(on, np.inf, score).argmin())

    on, state = np.zeros(n * n, bool), seed
    while on.sum() < n * n // 10:
        state = _xorshift(state)
        on[state // n % n * n + state % n] = True
    score = crowding(on)
    for _ in range(n * n // 4):
        out = densest(on, score)
        on[out] = False
        score -= shifted(out)
        into = emptiest(on, score)
        on[into] = True
        score += shifted(into)
        if out == into:
            break
    rank, ones = np.zeros(n * n), int(on.sum())
    left, score = on.copy(), crowding(on)
    for r in reversed(range(ones)):
        k = densest(left, score)
        rank[k], left[k] = r, False
        score -= shifted(k)
    filled, score = on.copy(), crowding(on)
    for r in range(ones, n * n):
        k = emptiest(filled, score)
        rank[k], filled[k] = r, True
        score += shifted(k)
    return np.floor(rank / (n * n - 1) * 255 + 0.5).astype(int).reshape(n, n)


def tile_table(spark, tile: np.ndarray) -> DataFrame:
    """(tx, ty, t): a relation of len(tile)^2 rows."""
    n = len(tile)
    return spark.createDataFrame(pd.DataFrame({"tx": np.tile(np.arange(n), n), "ty": np.repeat(np.arange(n), n), "t": tile.ravel()}))


def blue_noise(df: DataFrame, tile: DataFrame | None = None) -> DataFrame:
    """Joined by coordinates modulo 64 to a table of 4,096 rows, which is always broadcast."""
    t = F.broadcast(tile if tile is not None else tile_table(df.sparkSession, blue_noise_tile()))
    joined = df.join(t, (F.pmod("x", F.lit(64)) == F.col("tx")) & (F.pmod("y", F.lit(64)) == F.col("ty")))
    return joined.withColumn("d", _cut(F.col("t"))).select(df.columns)


_WHITE_SEED = 0x9E3779B9


@lru_cache(1)
def _jumps() -> list[np.ndarray]:
    """Powers 2^k of one xorshift step, as 32 images of single bits: the step is linear over bits."""
    step = np.array([_xorshift(1 << b) for b in range(32)], np.uint32)
    out = [step]
    for _ in range(40):
        out.append(_advance(out[-1], out[-1]))
    return out


def _advance(state: np.ndarray, step: np.ndarray) -> np.ndarray:
    out = np.zeros_like(state)
    for b in range(32):
        out ^= np.where(state >> np.uint32(b) & np.uint32(1), step[b], np.uint32(0)).astype(np.uint32)
    return out


def white_noise_states(ordinals: np.ndarray) -> np.ndarray:
    """The generator's state after ordinal + 1 steps, for any ordinals in any order: steps are jumped, not walked."""
    k = np.asarray(ordinals, np.uint64) + np.uint64(1)
    state = np.full(len(k), _WHITE_SEED, np.uint32)
    for b, step in enumerate(_jumps()):
        if not (k >> np.uint64(b)).any():
            break
        on = (k >> np.uint64(b) & np.uint64(1)).astype(bool)
        state[on] = _advance(state[on], step)
    return state


#: Ordinals that one row of white_noise_masks serves.
STRIDE = 4096


def white_noise_masks(block: int) -> list[int]:
    """For the low 8 bits of the state after STRIDE * block more steps: the bits of a state whose parity each is."""
    images, at = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32)), block
    for step in _jumps()[12:]:  # STRIDE is 2^12
        if not at:
            break
        if at & 1:
            images = _advance(images, step)
        at >>= 1
    return [int(((images >> np.uint32(bit) & np.uint32(1)).astype(np.uint64) << np.arange(32, dtype=np.uint64)).sum()) for bit in range(8)]


def white_noise(df: DataFrame, width: int) -> DataFrame:
    """Thresholds follow the scan order of an image of the given width.

    Ordinal n is n div STRIDE blocks of steps after the state of n mod STRIDE:
    a literal list has those states, and the blocks that occur bring eight
    masks each, whose parities with the state are the threshold's bits.
    """
    n = (F.col("y") * width + F.col("x")).cast("long")
    states = F.array(*(F.lit(int(v)) for v in white_noise_states(np.arange(STRIDE))))
    blocks = df.select(F.expr(f"(y * {width} + x) div {STRIDE}").cast("long").alias("_block")).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"_block": f["_block"], "_masks": [white_noise_masks(int(b)) for b in f["_block"]]})

    masks = blocks.mapInPandas(run, "_block long, _masks array<long>")
    placed = df.withColumns({"_block": F.floor(n / STRIDE).cast("long"), "_state": F.element_at(states, (F.pmod(n, F.lit(STRIDE)) + 1).cast("int"))})
    joined = placed.join(masks, "_block")
    bit = lambda k: F.shiftleft(F.bit_count(F.col("_state").bitwiseAND(F.col("_masks")[k])).bitwiseAND(F.lit(1)), k)
    threshold = bit(0)
    for k in range(1, 8):
        threshold = threshold + bit(k)
    return joined.withColumn("d", _cut(threshold)).select(df.columns)


def floyd_steinberg(df: DataFrame) -> DataFrame:
    """Serpentine 7 3 5 1 error diffusion at 128; one task an image and layer."""
    keys = keys_of(df)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"])
        w, h = f["x"].nunique(), f["y"].nunique()
        rows = f["d"].to_numpy(float).reshape(h, w).tolist()
        for y, row in enumerate(rows):
            below = rows[y + 1] if y + 1 < h else None
            ahead = 1 if y % 2 == 0 else -1
            for x in range(w)[::ahead]:
                new = 0 if row[x] < 128 else 255
                e, row[x] = row[x] - new, new
                if 0 <= x + ahead < w:
                    row[x + ahead] += e * 7 / 16
                if below:
                    below[x] += e * 5 / 16
                    if 0 <= x - ahead < w:
                        below[x - ahead] += e * 3 / 16
                    if 0 <= x + ahead < w:
                        below[x + ahead] += e / 16
        return f.assign(d=np.array(rows, np.int32).ravel())

    return df.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInPandas(run, df.withColumn("d", F.col("d").cast("int")).schema)


def halftone(df: DataFrame, width: int, height: int, lpi: float = 55.0, angle_deg: float = 22.5, dot: str = "round", curve: str = "linear", supersample: int = SUPERSAMPLE) -> DataFrame:
    """Rotated-screen halftone of images of one size.

    The cell follows from the image's pixels (longest edge = 13 inches, at
    least 72 dpi) and lpi.  A cell without its centre in the image, with a
    mean of at least 248 or a coverage of at most 0.01 has no dot.  Dots are
    clipped to the axis-aligned box of half a cell around their centre.
    """
    keys, s = keys_of(df), supersample
    cell = max(max(max(width, height) / PRINT_INCHES, LEAST_DPI) / max(lpi, 1.0), 1.0)
    big, half = cell * s, cell * s / 2
    sin, cos = math.sin(math.radians(angle_deg)), math.cos(math.radians(angle_deg))
    cx, cy = width * s / 2, height * s / 2

    # the cells whose centre lies in a pixel: a pixel's middle is at most a few cells away
    means = box_mean(df, max(int(cell * 0.5), 1)).where(F.col("d") < NEAR_WHITE).select(*keys, F.col("x").cast("long").alias("_sx"), F.col("y").cast("long").alias("_sy"), F.col("d").alias("_avg"))
    mx, my = (F.col("_sx") + 0.5) * s - cx, (F.col("_sy") + 0.5) * s - cy
    reach = range(-1, 2) if cell >= 2 else range(-2, 3)
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in reach for i in reach)))
    cells = means.withColumns({"_ci": F.floor((mx * cos + my * sin) / big), "_cj": F.floor((my * cos - mx * sin) / big)}).select("*", near.alias("c"))
    cells = cells.withColumns({"_ux": (F.col("_ci") + F.col("c.i") + 0.5) * big, "_uy": (F.col("_cj") + F.col("c.j") + 0.5) * big})
    cells = cells.withColumns({"_dx": cx + F.col("_ux") * cos - F.col("_uy") * sin, "_dy": cy + F.col("_ux") * sin + F.col("_uy") * cos})
    cells = cells.where(((F.col("_dx") / s).cast("long") == F.col("_sx")) & ((F.col("_dy") / s).cast("long") == F.col("_sy")))
    cells = cells.withColumn("_c", shape_curve(1.0 - F.col("_avg") / 255.0, curve)).where(F.col("_c") > LEAST_COVERAGE)

    # their boxes, and what of them the dot inks
    span = lambda c, most: F.explode(F.sequence(F.greatest(F.floor(c - half), F.lit(0)), F.greatest(F.least(F.ceil(c + half), F.lit(most - 1)), F.greatest(F.floor(c - half), F.lit(0)))))
    px = cells.select(*keys, "_c", "_dx", "_dy", span(F.col("_dx"), width * s).alias("px")).select("*", span(F.col("_dy"), height * s).alias("py"))
    dx, dy = F.col("px") + 0.5 - F.col("_dx"), F.col("py") + 0.5 - F.col("_dy")
    ux, uy = dx * cos + dy * sin, -dx * sin + dy * cos
    r = half * F.sqrt(4.0 * F.col("_c") / math.pi)
    inside = {
        "round": lambda: ux * ux + uy * uy <= r * r,
        "square": lambda: (F.abs(ux) <= half * F.sqrt("_c")) & (F.abs(uy) <= half * F.sqrt("_c")),
        "ellipse": lambda: (ux / r) * (ux / r) + (uy / (0.6 * r)) * (uy / (0.6 * r)) <= 1.0,
        "line": lambda: (F.abs(uy) <= half * F.col("_c") * 2.0) & (F.abs(ux) <= half),
    }[dot]()
    kinds = dict(df.dtypes)
    at = lambda c, name: F.floor(F.col(c) / s).cast(kinds[name]).alias(name)
    part = F.expr(f"shiftleft(1L, cast(pmod(py, {s}) * {s} + pmod(px, {s}) as int))")
    inked = px.where(inside).groupBy(*keys, at("px", "x"), at("py", "y")).agg(F.bit_count(F.bit_or(part)).alias("_n"))
    out = df.join(inked, [*keys, "x", "y"], "left")
    clear = s * s - F.coalesce("_n", F.lit(0))
    return out.withColumn("d", F.floor(clear * 255 / F.lit(s * s)).cast("int")).select(df.columns)
