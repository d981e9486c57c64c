"""The ranges that parameters may take, and what an extractor starts from."""

from __future__ import annotations

from dataclasses import replace

from .layer import RGB, Job, Layer

#: Least and most of each parameter.
LAYER_RANGES = {
    "tone.density": (0, 2), "tone.choke": (0, 8),
    "mask.solid_blur": (0, 5), "mask.smooth_radius": (0, 10), "mask.noise_open": (0, 10), "mask.holes_close": (0, 10), "mask.edge_radius": (0, 10),
    "halftone.lpi": (0, 120), "halftone.angle_deg": (-1, 180),
}
EXTRACTOR_RANGES = {
    ("spot_solid", "tolerance"): (0, 64), ("spot_aa", "target_weights"): (-30, 30), ("color_range", "fuzziness"): (1, 200),
    ("hsb_brightness_inverted", "s_curve"): (0.5, 3), ("hsb_brightness_inverted", "boost_strength"): (0, 2),
    ("gcr_black", "strength"): (0, 2), ("cmyk_channel", "gcr_strength"): (0, 1), ("luminance_threshold", "threshold"): (0, 255),
}
JOB_RANGES = {"default_lpi": (20, 300), "default_angle_deg": (0, 180)}
OPTION_RANGES = {"max_colors": (2, 48), "background_tolerance": (1, 60), "clamp_threshold": (1, 100), "brush_radius": (1, 256)}
OPTION_DEFAULTS = {"max_colors": 16, "background_tolerance": 12, "clamp_threshold": 50, "brush_radius": 16}
SELECTABLE_MODES = ("solid", "halftone", "fm_floyd_steinberg", "bayer", "white_noise", "blue_noise")


def _values(layer: Layer):
    """name, value, least and most of everything that has a range."""
    for name, (low, high) in LAYER_RANGES.items():
        part, field = name.split(".")
        yield name, getattr(getattr(layer, part), field), low, high
    for (kind, field), (low, high) in EXTRACTOR_RANGES.items():
        if layer.extractor["kind"] == kind and field in layer.extractor:
            yield f"extractor.{field}", layer.extractor[field], low, high
    if layer.extractor["kind"] == "index_assignment":
        yield "extractor.index", layer.extractor["index"], 0, max(len(layer.extractor["palette"]) - 1, 0)


def problems(layer: Layer) -> list[str]:
    """What of a layer lies outside its range."""
    out = []
    for name, value, low, high in _values(layer):
        for v in value if isinstance(value, (list, tuple)) else [value]:
            if not low <= v <= high:
                out.append(f"{name} is {v}, not in {low}..{high}")
    return out


def job_problems(job: Job) -> list[str]:
    return [f"{n} is {getattr(job, n)}, not in {low}..{high}" for n, (low, high) in JOB_RANGES.items() if not low <= getattr(job, n) <= high]


def checked(layer: Layer) -> Layer:
    found = problems(layer)
    if found:
        raise ValueError(f"{layer.name}: {'; '.join(found)}")
    return layer


def clamped(layer: Layer) -> Layer:
    """The layer with every value moved into its range."""
    near = lambda v, low, high: [near(x, low, high) for x in v] if isinstance(v, (list, tuple)) else type(v)(min(max(v, low), high))
    parts = {"tone": {}, "mask": {}, "halftone": {}, "extractor": {}}
    for name, value, low, high in _values(layer):
        part, field = name.split(".")
        parts[part][field] = near(value, low, high)
    extractor = layer.extractor | parts.pop("extractor")
    return replace(layer, extractor=extractor, **{p: replace(getattr(layer, p), **v) for p, v in parts.items()})


def extractor_defaults(kind: str, ink: RGB) -> dict:
    """What a layer's extractor is reset to when its kind is switched."""
    #: Fixed values.
    starts = {
        "spot_solid": {"ink": ink, "tolerance": 0},
        "spot_aa": {"ink": ink, "targets": [ink], "others": [], "target_weights": [0.0]},
        "color_range": {"target": ink, "fuzziness": 60.0, "falloff": "smooth"},
        "hsb_brightness_inverted": {"s_curve": 1.6, "boost_under_darks": True, "boost_strength": 0.4},
        "lab_lightness_inverted": {},
        "gcr_black": {"strength": 1.0, "invert_input": False},
        "channel_calc": {"expr": "1 - L"},
        "luminance_threshold": {"threshold": 128, "above": False},
        "index_assignment": {"palette": [ink], "index": 0, "dither": "fs"},
        "cmyk_channel": {"channel": "cyan", "gcr_strength": 0.75},
        "manual_paint": {},
        "composite_union": {},
    }
    if kind not in starts:
        raise ValueError(f"unknown extractor: {kind}")
    return {"kind": kind, **starts[kind]}


def switched(layer: Layer, kind: str) -> Layer:
    """The layer with another kind of extractor, at that kind's start."""
    return layer if layer.extractor["kind"] == kind else replace(layer, extractor=extractor_defaults(kind, layer.ink))
