"""Pixel, mask and layer views derived from the star-schema tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100
BASE = ((200, 40, 40), (30, 120, 200), (240, 200, 40), (20, 20, 20), (250, 250, 250))
#: layer_idx, kind, ink, visible, print_index
LAYERS = (
    (0, "underbase", (255, 255, 255), True, 0), (1, "spot", (200, 40, 40), True, 3), (2, "spot", (30, 120, 200), True, 1),
    (3, "spot", (240, 200, 40), True, 2), (4, "spot", (20, 20, 20), True, 4), (5, "color", (200, 40, 40), False, 5),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, x, y, r, g, b: one image WIDTH wide, a pixel an order."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), ((F.col("o_custkey") * 7) % 9).alias("_n"))
    o = o.withColumns({"x": F.col("i") % WIDTH, "y": F.floor(F.col("i") / WIDTH)})
    o = o.withColumn("_k", (F.floor(F.col("x") / 12) + F.floor(F.col("y") / 9)) % 5)
    frame = (F.col("x") < 4) | (F.col("x") > 95)

    def channel(c: int):
        out = F.when(frame, 255)
        for k, base in enumerate(BASE):
            out = out.when(F.col("_k") == k, base[c] + (F.col("_n") if k < 4 else 0))
        return out.cast("long")

    return o.select("i", "x", "y", *(channel(c).alias(n) for c, n in enumerate("rgb")))


def size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    n = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0]
    return (WIDTH, n // WIDTH + 1) if n is not None else (0, 0)


def layers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, *ink, v, p) for i, k, ink, v, p in LAYERS], "layer_idx int, kind string, r int, g int, b int, visible boolean, print_index int")


def gray(image: DataFrame) -> DataFrame:
    """x, y, d: the image's lightest channel as a density."""
    return image.select("x", "y", F.greatest("r", "g", "b").cast("int").alias("d"))


def masks(image: DataFrame) -> DataFrame:
    """layer_idx, x, y, d: each layer's density falls off with the largest channel difference from its ink."""
    inks = F.array(*(F.struct(F.lit(i).alias("layer_idx"), *(F.lit(v).alias(c) for v, c in zip(ink, ("kr", "kg", "kb")))) for i, _, ink, _, _ in LAYERS))
    each = image.select("x", "y", "r", "g", "b", F.explode(inks).alias("k"))
    far = F.greatest(F.abs(F.col("r") - F.col("k.kr")), F.abs(F.col("g") - F.col("k.kg")), F.abs(F.col("b") - F.col("k.kb")))
    return each.select("k.layer_idx", "x", "y", F.least(far * 3, F.lit(255)).cast("int").alias("d"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, generation, layer_idx, param."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 1000).alias("generation"), (F.col("user_id") % 8).alias("layer_idx"), F.col("value").alias("param"))
