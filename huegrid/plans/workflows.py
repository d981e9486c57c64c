"""Workflow planners: an image and options to a layer list.  Only palettes and detection touch data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions import color as C
from ..functions.color import name_of
from ..functions.tone import CURVES
from ..operators import palette as P
from .layer import BLACK, WHITE, Halftone, Layer, MaskShape, RGB, Tone, reindexed

LABELS = {
    "spot": "Spot color", "cel_shaded": "Cel shaded", "simprocess_light": "Sim process, light shirt", "simprocess_dark": "Sim process, dark shirt",
    "cmyk_process_light": "CMYK process, light shirt", "cmyk_process_dark": "CMYK process, dark shirt", "single_halftone": "Single halftone", "black_only": "Black only",
    "stencil": "Stencil", "duotone": "Duotone", "tritone": "Tritone", "index_fs": "Index, error diffusion", "index_bayer": "Index, ordered",
}


#: Fixed values of the workflows: names, inks, angles, expressions, curves and bounds.
PALETTE_LEAST = {"spot": 0.002, "cel_shaded": 0.0015, "simprocess_light": 0.003, "simprocess_dark": 0.003, "index_fs": 0.002, "index_bayer": 0.002}
CEL_COLORS, SPOT_BLUR, LEAST_CHROMA = 14, 3.5, 8
UNDERBASE = {"curve": "underbase_composite", "choke": 2, "noise_open": 2, "holes_close": 2}
HIGHLIGHT = {"curve": "highlight_white", "strength": 1.0}
BLACK_PLATE = {"curve": "black_plate", "strength": 1.0}
PROCESS_CURVE, SIM_CURVE = "cmyk_channel", "sim_process"
PROCESS_PLATES = (("cyan", (0, 200, 255), 15.0), ("magenta", (220, 0, 180), 75.0), ("yellow", (255, 230, 0), 0.0), ("black", BLACK, 45.0))
DUOTONE_ANGLES = (15.0, 75.0)
SINGLE = ("black halftone", "1 - L", 22.5, 45)
TRITONE = (("highlight", "clip((L - 0.7) * 3.3, 0, 1)", 15.0), ("mid", "clip(1 - abs(L - 0.5) * 3.3, 0, 1)", 75.0), ("shadow", "clip((0.3 - L) * 3.3, 0, 1)", 45.0))
BLACK_THRESHOLD = 128


@dataclass(frozen=True)
class Options:
    max_colors: int = 16
    fuzziness: float = 40.0
    stencil_threshold: int = 128
    consolidate_hues: bool = False
    gcr_strength: float = 0.75
    duotone_light: RGB = (240, 220, 200)
    duotone_dark: RGB = (30, 40, 80)
    tritone_highlight: RGB = (240, 220, 200)
    tritone_mid: RGB = (160, 80, 60)
    tritone_shadow: RGB = (30, 20, 20)


def _curve(name: str, choke: int = 0) -> Tone:
    return Tone(tuple(CURVES[name]), 1.0, choke)


def _dots(angle: float = -1.0, lpi: float = 0) -> dict:
    return dict(render_mode="halftone", halftone=Halftone(lpi, angle, "round"))


def palette_of(workflow: str, o: Options = Options()) -> tuple[int, float] | None:
    """Colours and least coverage of the palette that a workflow starts from; None if it needs none."""
    if workflow not in PALETTE_LEAST:
        return None
    return (CEL_COLORS if workflow == "cel_shaded" else o.max_colors), PALETTE_LEAST[workflow]


def _spot(found: list[P.Entry], hues: bool) -> list[Layer]:
    found = P.snap_extremes(found)
    found = P.print_order(P.consolidate_by_hue(found) if hues else found)
    targets = [e.rgb for e in found]
    return [
        Layer(rgb, f"{i + 1:02} {name_of(rgb)}", "spot", print_index=i, mask=MaskShape(solid_blur=SPOT_BLUR),
              extractor={"kind": "spot_aa", "ink": rgb, "targets": targets, "others": [], "target_weights": [0.0] * len(targets)})
        for i, rgb in enumerate(targets)
    ]


def _light(angle: float = -1.0) -> dict:
    return dict(extractor={"kind": "gcr_black", "strength": HIGHLIGHT["strength"], "invert_input": True}, tone=_curve(HIGHLIGHT["curve"]), **_dots(angle))


def _dark(angle: float = -1.0) -> dict:
    return dict(extractor={"kind": "gcr_black", "strength": BLACK_PLATE["strength"], "invert_input": False}, tone=_curve(BLACK_PLATE["curve"]), **_dots(angle))


def _underbase(name: str) -> Layer:
    return Layer(WHITE, name, "underbase", extractor={"kind": "composite_union"}, tone=_curve(UNDERBASE["curve"], UNDERBASE["choke"]), mask=MaskShape(noise_open=UNDERBASE["noise_open"], holes_close=UNDERBASE["holes_close"]))


def _highlight(name: str) -> Layer:
    return Layer(WHITE, name, "highlight", **_light())


def _sim(found: list[P.Entry], o: Options, dark: bool) -> list[Layer]:
    found = P.consolidate_by_hue(found) if o.consolidate_hues else found
    labs = {e.rgb: C.lab_of(e.rgb) for e in found}
    colored = sorted((e.rgb for e in found if (labs[e.rgb][1] ** 2 + labs[e.rgb][2] ** 2) ** 0.5 > LEAST_CHROMA), key=lambda c: -labs[c][0])
    plates = [Layer(c, f"color {name_of(c)}", "color", extractor={"kind": "color_range", "target": c, "fuzziness": o.fuzziness, "falloff": "smooth"}, tone=_curve(SIM_CURVE), **_dots()) for c in colored]
    black = Layer(BLACK, "black plate", "color", **_dark())
    return reindexed([_underbase("underbase")] * dark + [*plates, black, _highlight("highlight white")])


def _cmyk(o: Options, dark: bool) -> list[Layer]:
    plates = [Layer(ink, n, "color", extractor={"kind": "cmyk_channel", "channel": n, "gcr_strength": o.gcr_strength}, tone=_curve(PROCESS_CURVE), **_dots(angle)) for n, ink, angle in PROCESS_PLATES]
    return reindexed([_underbase("white underbase")] * dark + [*plates, _highlight("white highlight")])


def _index(found: list[P.Entry], dither: str) -> list[Layer]:
    palette = [e.rgb for e in P.snap_extremes(found)]
    return [Layer(c, f"{i + 1:02} {name_of(c)}", "color", print_index=i, extractor={"kind": "index_assignment", "palette": palette, "index": i, "dither": dither}) for i, c in enumerate(palette)]


def _threshold(name: str, at: int) -> list[Layer]:
    return [Layer(BLACK, name, "color", extractor={"kind": "luminance_threshold", "threshold": at, "above": False})]


def _calc(ink: RGB, name: str, expr: str, angle: float, index: int = 0, lpi: float = 0) -> Layer:
    return Layer(ink, name, "color", extractor={"kind": "channel_calc", "expr": expr}, print_index=index, **_dots(angle, lpi))


def plan(workflow: str, px: DataFrame, o: Options = Options(), palette: list[P.Entry] | None = None) -> list[Layer]:
    """The layers of a workflow over an image (i, x, y, r, g, b).  A palette, by descending coverage, is taken as the image's own."""
    needed = palette_of(workflow, o)
    if needed and palette is None:
        palette = P.auto_palette(px, *needed)[0]
    match workflow:
        case "spot":
            return _spot(palette, o.consolidate_hues)
        case "cel_shaded":
            return _spot(palette, False)
        case "simprocess_light" | "simprocess_dark":
            return _sim(palette, o, workflow.endswith("dark"))
        case "cmyk_process_light" | "cmyk_process_dark":
            return _cmyk(o, workflow.endswith("dark"))
        case "single_halftone":
            name, expr, angle, lpi = SINGLE
            return [_calc(BLACK, name, expr, angle, lpi=lpi)]
        case "black_only":
            return _threshold("black", BLACK_THRESHOLD)
        case "stencil":
            return _threshold("stencil", o.stencil_threshold)
        case "duotone":
            light, dark = DUOTONE_ANGLES
            return [Layer(o.duotone_light, "light tone", "color", **_light(light)), Layer(o.duotone_dark, "dark tone", "color", print_index=1, **_dark(dark))]
        case "tritone":
            inks = (o.tritone_highlight, o.tritone_mid, o.tritone_shadow)
            return [_calc(ink, name, expr, angle, i) for i, (ink, (name, expr, angle)) in enumerate(zip(inks, TRITONE))]
        case "index_fs" | "index_bayer":
            return _index(palette, workflow.removeprefix("index_"))
    raise ValueError(f"unknown workflow {workflow!r}; there are {', '.join(LABELS)}")


def choose(total: int, n_colors: int, peak: float, p95: float) -> str:
    """The workflow that an image's statistics call for."""
    if total == 0:
        return "spot"
    if p95 < 8.0:
        return "single_halftone"
    if n_colors < 12 and peak > 0.08:
        return "spot"
    if n_colors < 50:
        return "cel_shaded"
    return "index_bayer" if total < 200_000 and n_colors < 64 else "simprocess_dark"


def detect(px: DataFrame, size: tuple[int, int]) -> str:
    total = size[0] * size[1]
    if not total:
        return "spot"
    h = P.histogram_stats(px).first()
    return choose(total, h["n_colors"], h["peak"], P.p95_chroma(px, *size).first()["p95"])


def auto_plan(px: DataFrame, size: tuple[int, int], o: Options = Options()) -> tuple[str, list[Layer]]:
    found = detect(px, size)
    return found, plan(found, px, o)
