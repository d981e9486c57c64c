"""Relations over layers: unions, merges, composites, ordering and selection.

Masks are (layer_idx, x, y, d), image_id optional; layers are small relations
(layer_idx, kind, r, g, b, visible, print_index, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.color import byte
from .extract import RGB

GARMENT: RGB = (24, 24, 28)


def _pixel(df: DataFrame) -> list[str]:
    return [c for c in ("image_id", "x", "y") if c in df.columns]


def union_min(masks: DataFrame) -> DataFrame:
    """The most ink that any layer wants: the least density of each pixel."""
    return masks.groupBy(*_pixel(masks)).agg(F.min("d").alias("d"))


def composite_union(masks: DataFrame, layers: DataFrame, px: DataFrame, own: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """The union over other layers that are neither underbases nor near-black inks; none where the source is near-black.

    With a size, layers whose masks have another are left out.

    layers is one job's list of plates, small beside the masks; Spark broadcasts it by its size.
    """
    sharing = layers.where((F.col("kind") != "underbase") & ~((F.col("r") < 30) & (F.col("g") < 30) & (F.col("b") < 30)))
    if own is not None:
        sharing = sharing.where(F.col("layer_idx") != own)
    key = _pixel(px)
    masks = of_size(masks, size) if size else masks
    union = union_min(masks.join(sharing.select("layer_idx"), "layer_idx", "left_semi"))
    out = px.select(*key, F.greatest("r", "g", "b").alias("_m")).join(union, key, "left")
    return out.select(*key, F.when(F.col("_m") < 50, 255).otherwise(F.coalesce("d", F.lit(255))).cast("int").alias("d"))


def same_ink(layers: DataFrame) -> bool:
    """Whether two or more layers all have one ink."""
    r = layers.agg(F.countDistinct("r", "g", "b").alias("inks"), F.count("*").alias("n")).first()
    return r["n"] >= 2 and r["inks"] == 1


def lightest(layers: DataFrame) -> int:
    """The layer with the lightest ink, the first of equals."""
    return C.with_lab(layers).orderBy(F.desc("l"), "layer_idx").first()["layer_idx"]


def shadow_merge(masks: DataFrame, layers: DataFrame) -> DataFrame:
    """keys, x, y, union_d, shadow_d.

    The lightest layer is the keeper.  A pixel belongs to the lightest layer
    with ink there (d < 128); the union is full ink on owned pixels, and the
    shadow's ink grows with how much darker the owner's ink is than the keeper's.
    """
    lab = C.with_lab(layers)
    ranked = lab.select("layer_idx", "l", F.row_number().over(Window.orderBy(F.desc("l"), "layer_idx")).alias("rank"))  # one job's layers
    keeper = ranked.agg(F.max("l").alias("kl"))
    shadow = ranked.crossJoin(keeper).select("layer_idx", "rank", (255 - byte(255.0 * C.clamp((F.col("kl") - F.col("l")) / F.greatest("kl", F.lit(1.0)), 0.0, 1.0))).alias("shadow"))
    key = _pixel(masks)
    owned = masks.join(shadow, "layer_idx").groupBy(*key).agg(F.min(F.when(F.col("d") < 128, F.struct("rank", "shadow"))).alias("o"))
    return owned.select(*key, F.when(F.col("o").isNull(), 255).otherwise(0).alias("union_d"), F.coalesce("o.shadow", F.lit(255)).alias("shadow_d"))


def composite(masks: DataFrame, layers: DataFrame, px: DataFrame, shirt: RGB = GARMENT, size: tuple[int, int] | None = None) -> DataFrame:
    """Layers that are visible and exported, painted over the shirt in print order, rounding after each: keys, x, y, r, g, b of every pixel of px.

    A pixel that no mask covers shows the shirt.  With a size, layers whose masks have another are left out.  layers is
    one job's list, small beside the masks.
    """
    masks = of_size(masks, size) if size else masks
    inks = exportable(layers).select("layer_idx", "print_index", F.col("r").alias("ir"), F.col("g").alias("ig"), F.col("b").alias("ib"))
    key = _pixel(px)
    stack = masks.join(inks, "layer_idx").groupBy(*_pixel(masks)).agg(F.array_sort(F.collect_list(F.struct("print_index", "layer_idx", "d", "ir", "ig", "ib"))).alias("s"))
    alpha = lambda s: 1.0 - s["d"] / 255.0
    over = lambda v, ink, s: F.round(v * (1.0 - alpha(s)) + ink * alpha(s))
    bare = F.struct(*(F.lit(float(v)).alias(c) for v, c in zip(shirt, "rgb")))
    fold = F.aggregate("s", bare, lambda p, s: F.struct(*(over(p[c], s[f"i{c}"], s).alias(c) for c in "rgb")))
    out = px.select(*key).join(stack, _pixel(masks), "left").select(*key, F.coalesce(fold, bare).alias("p"))
    return out.select(*key, *(F.col(f"p.{c}").cast("int").alias(c) for c in "rgb"))


def over_shirt(mask: DataFrame, ink: RGB, shirt: RGB = GARMENT) -> DataFrame:
    alpha = 1.0 - F.col("d") / 255.0
    return mask.select(*_pixel(mask), *(byte(s * (1.0 - alpha) + i * alpha).alias(c) for s, i, c in zip(shirt, ink, "rgb")))


def reindex(layers: DataFrame, order: str = "layer_idx") -> DataFrame:
    """print_index counts from 0 along the list."""
    return layers.withColumn("print_index", F.row_number().over(Window.orderBy(order)) - 1)  # one job's layers


def selected(layers: DataFrame, chosen: DataFrame) -> DataFrame:
    return layers.join(chosen, "layer_idx", "left_semi")


def dropped(layers: DataFrame, gone: DataFrame) -> DataFrame:
    return layers.join(gone, "layer_idx", "left_anti")


def exportable(layers: DataFrame) -> DataFrame:
    """Layers that are visible and not left out of the export; without that column none is left out."""
    return layers.where("visible and include_in_export" if "include_in_export" in layers.columns else "visible")


def propagate_weights(targets: DataFrame, edits: DataFrame) -> DataFrame:
    """Spot targets (layer_idx, pos, r, g, b, weight) take the newest weight edited (seq, r, g, b, weight) for their colour; then a list a layer."""
    newest = edits.groupBy("r", "g", "b").agg(F.max_by("weight", "seq").alias("_new"))
    out = targets.join(newest, ["r", "g", "b"], "left").withColumn("weight", F.coalesce("_new", "weight", F.lit(0.0)))
    return out.groupBy("layer_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "weight"))), lambda s: s["weight"]).alias("target_weights"))


def nearest_resize(mask: DataFrame, old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """Masks of size old at size new, by an equi-join on source coordinates."""
    keys = [c for c in ("image_id", "layer_idx") if c in mask.columns]
    spread = lambda c, a, b: F.explode(F.sequence(F.ceil(F.col(c) * b / F.lit(a)), F.ceil((F.col(c) + 1) * b / F.lit(a)) - 1))
    fits = lambda c, a, b: (F.ceil((F.col(c) + 1) * b / F.lit(a)) > F.ceil(F.col(c) * b / F.lit(a)))
    m = mask.where(fits("x", old[0], new[0]) & fits("y", old[1], new[1]))
    m = m.withColumn("_x", spread("x", old[0], new[0])).withColumn("_y", spread("y", old[1], new[1]))
    return m.select(*keys, F.col("_x").alias("x"), F.col("_y").alias("y"), "d")


def lanczos_resize(mask: DataFrame, old: tuple[int, int], new: tuple[int, int], lobes: int = 3) -> DataFrame:
    """Separable Lanczos resampling: taps are a small relation of (new coordinate, old coordinate, weight) joined along each axis."""
    import math

    spark, keys = mask.sparkSession, [c for c in ("image_id", "layer_idx") if c in mask.columns]

    def taps(a: int, b: int) -> list[tuple[int, int, float]]:
        scale, out = a / b, []
        wide = max(scale, 1.0)
        for n in range(b):
            c = (n + 0.5) * scale
            own = []
            for k in range(max(0, math.floor(c - lobes * wide)), min(a - 1, math.ceil(c + lobes * wide)) + 1):
                t = (k + 0.5 - c) / wide
                if abs(t) < lobes:
                    own.append((k, 1.0 if t == 0 else lobes * math.sin(math.pi * t) * math.sin(math.pi * t / lobes) / (math.pi * t) ** 2))
            total = sum(w for _, w in own)
            out += [(n, k, w / total) for k, w in own]
        return out

    for axis, other, a, b in (("x", "y", old[0], new[0]), ("y", "x", old[1], new[1])):
        t = spark.createDataFrame(taps(a, b), f"_n int, {axis} int, _w double")
        mask = mask.join(t, axis).groupBy(*keys, F.col("_n").alias(axis), other).agg(F.sum(F.col("d") * F.col("_w")).alias("d"))
    return mask.select(*keys, "x", "y", byte(F.col("d")).alias("d"))


def brush(mask: DataFrame, dabs: DataFrame) -> DataFrame:
    """Dabs (seq, cx, cy, radius, ink) on a mask; the newest dab that covers a pixel sets it to 0 or 255.

    Dabs that name an image_id or layer_idx meet that image or layer alone.  A
    dab meets only the pixels of its box, so the join is on coordinates.
    """
    on = [*(c for c in ("image_id", "layer_idx") if c in mask.columns and c in dabs.columns), "x", "y"]
    reach = dabs.withColumn("x", F.explode(F.sequence(F.col("cx") - F.col("radius"), F.col("cx") + F.col("radius")))).withColumn("y", F.explode(F.sequence(F.col("cy") - F.col("radius"), F.col("cy") + F.col("radius"))))
    disk = reach.where("(x - cx) * (x - cx) + (y - cy) * (y - cy) <= radius * radius")
    newest = disk.groupBy(*on).agg(F.max_by(F.when(F.col("ink"), 0).otherwise(255), "seq").alias("_new"))
    return mask.join(newest, on, "left").withColumn("d", F.coalesce("_new", "d")).select(mask.columns)


def resize_source(px: DataFrame, old: tuple[int, int], width_inches: float | None, dpi: int) -> tuple[DataFrame, tuple[int, int]]:
    """An image (r, g, b) at the width that a film of so many inches has, the height in proportion, and its size; as it is without a width or at that width."""
    wide = int(width_inches * dpi + 0.5) if width_inches else 0
    if not wide or wide == old[0] or not old[0]:
        return px, old
    new = (wide, max(1, int(old[1] * wide / old[0] + 0.5)))
    key, out = _pixel(px), None
    for c in "rgb":
        one = lanczos_resize(px.select(*key, F.col(c).alias("d")), old, new).withColumnRenamed("d", c)
        out = one if out is None else out.join(one, key)
    i = (F.col("y") * new[0] + F.col("x")).cast("long").alias("i")
    return out.select(*(c for c in key if c == "image_id"), i, "x", "y", "r", "g", "b"), new


def preview_size(masks: DataFrame) -> tuple[int, int]:
    """The size of the first layer's mask; (1, 1) if there is none."""
    first = masks.groupBy("layer_idx") if "layer_idx" in masks.columns else masks.groupBy(F.lit(0).alias("layer_idx"))
    found = first.agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).orderBy("layer_idx").first()
    return (found["w"], found["h"]) if found else (1, 1)


def of_size(masks: DataFrame, size: tuple[int, int]) -> DataFrame:
    """The layers (of each image) whose masks have this size; others are left out whole."""
    keys = [c for c in ("image_id", "layer_idx") if c in masks.columns]
    found = masks.groupBy(*keys).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h")).where((F.col("_w") == size[0]) & (F.col("_h") == size[1]))
    return masks.join(F.broadcast(found.select(*keys)), keys, "left_semi") if keys else masks.join(F.broadcast(found.select("_w")), F.lit(True), "left_semi")
