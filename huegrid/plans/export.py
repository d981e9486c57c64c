"""Film export: a job's plates at film size, with marks and border, as PNG files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layers as L
from ..sources import images
from . import pipeline
from .layer import Job, Layer


@dataclass(frozen=True)
class Marks:
    offset: int = 48
    arm: int = 32
    thickness: int = 2
    dot: bool = True


@dataclass(frozen=True)
class Border:
    margin: int = 24
    caption: int = 56
    font_px: int = 0  # 0: by the film's width
    font: str | None = None  # None: the first that the system has


@dataclass(frozen=True)
class Film:
    dpi: int = 300
    width_inches: float | None = None  # None: the size that the image has
    lpi: float | None = None
    preview_only: bool = False
    marks: Marks | None = None
    border: Border | None = None
    foreground: DataFrame | None = field(default=None, compare=False)  # used only if it has the film's size

    @property
    def job(self) -> Job:
        return Job(self.dpi, 55.0 if self.lpi is None else self.lpi, 22.5)


def _furnished(plates: DataFrame, layers: dict[int, Layer], size: tuple[int, int], film: Film) -> DataFrame:
    if film.marks:
        m = film.marks
        plates = images.registration_marks(plates, size, m.offset, m.arm, m.thickness, m.dot)
    if film.border:
        b = film.border
        plates, _ = images.film_border(plates, size, b.margin, b.caption)
        plates = images.captioned(plates, size, layers, film.job.default_lpi, b.margin, b.font, b.font_px)
    return plates


def _prepared(px: DataFrame, size: tuple[int, int], film: Film) -> tuple[DataFrame, tuple[int, int], DataFrame | None]:
    image, at = L.resize_source(px, size, film.width_inches, film.dpi)
    fg = film.foreground
    if fg is not None and L.preview_size(fg) != at:
        fg = None
    return image, at, fg


def films(px: DataFrame, layers: list[Layer], size: tuple[int, int], film: Film = Film()) -> DataFrame | None:
    """name, png of every layer that is visible and exported; unions are made of the others' previews.  None if there is no such layer."""
    shown = {i: x for i, x in enumerate(layers) if x.visible and x.include_in_export}
    if not shown:
        return None
    image, at, fg = _prepared(px, size, film)
    plates = pipeline.separate(image, layers, at, film.job, fg, processed=not film.preview_only, only_visible=True)
    return images.png_films(_furnished(plates, shown, at, film), layers, film.dpi)


def export_all(px: DataFrame, layers: list[Layer], size: tuple[int, int], folder: str, film: Film = Film()) -> list[str]:
    """Write the films under a folder that all executors share; the paths, in order."""
    made = films(px, layers, size, film)
    return images.write_films(made, folder) if made is not None else []


def export_layer(px: DataFrame, layer: Layer, index: int, size: tuple[int, int], folder: str, film: Film = Film()) -> str:
    """One layer by itself, whatever its visibility; a layer that unions others has none to union and comes out blank."""
    image, at, fg = _prepared(px, size, film)
    src = pipeline.foreground.clamp_near_black(image)
    preview, final = pipeline.process_layer(src, layer, at, film.job, fg)
    plate = (preview if film.preview_only else final).withColumn("layer_idx", F.lit(index))
    return images.write_films(images.png_films(_furnished(plate, {index: layer}, at, film), {index: layer}, film.dpi), folder)[0]
