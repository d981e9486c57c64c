"""The layer list: what every workflow plans and the pipeline carries out."""

from __future__ import annotations

import uuid
from collections import deque
from dataclasses import dataclass, field, replace
from typing import Any

from ..functions import tone
from ..functions.color import hex_of  # noqa: F401  (the Column form of hex())

RGB = tuple[int, int, int]
BLACK, WHITE = (0, 0, 0), (255, 255, 255)
KINDS = ("spot", "color", "underbase", "highlight", "shadow")
RENDER_MODES = ("solid", "halftone", "fm_floyd_steinberg", "bayer", "white_noise", "blue_noise", "index_fs", "index_bayer")


def hex_text(rgb: RGB) -> str:
    return "#%02X%02X%02X" % tuple(rgb)


@dataclass(frozen=True)
class Tone:
    curve: tuple = tuple(tone.IDENTITY)
    density: float = 1.0
    choke: int = 0


@dataclass(frozen=True)
class MaskShape:
    smooth_radius: int = 0
    noise_open: int = 0
    holes_close: int = 0
    edge_radius: int = 0
    edge_mode: str = "hard"  # hard, choke, spread, feather_ht
    invert: bool = False
    solid_blur: float = 1.5


@dataclass(frozen=True)
class Halftone:
    lpi: float = 0  # 0: the job's
    angle_deg: float = -1.0  # below 0: by print index
    dot_shape: str | None = None
    curve: str = "linear"


@dataclass(frozen=True)
class Layer:
    ink: RGB
    name: str = ""
    kind: str = "spot"
    visible: bool = True
    locked: bool = False
    include_in_export: bool = True
    opacity: float = 1.0
    extractor: dict[str, Any] = field(default_factory=dict)
    tone: Tone = Tone()
    mask: MaskShape = MaskShape()
    render_mode: str = "solid"
    halftone: Halftone = Halftone()
    print_index: int = 0
    id: str = ""

    def __post_init__(self):
        object.__setattr__(self, "ink", tuple(self.ink))
        if not self.id:
            object.__setattr__(self, "id", str(uuid.uuid4()))
        if not self.name:
            object.__setattr__(self, "name", hex_text(self.ink))
        if not self.extractor:
            object.__setattr__(self, "extractor", {"kind": "spot_solid", "ink": self.ink, "tolerance": 0})
        if self.kind not in KINDS or self.render_mode not in RENDER_MODES:
            raise ValueError(f"unknown kind or render mode: {self.kind}, {self.render_mode}")


@dataclass(frozen=True)
class Job:
    dpi: int = 300
    default_lpi: float = 65.0
    default_angle_deg: float = 22.5


def reindexed(layers: list[Layer]) -> list[Layer]:
    return [replace(x, print_index=i) for i, x in enumerate(layers)]


def moved(layers: list[Layer], i: int, by: int) -> list[Layer]:
    """Layer i up (-1) or down (1) the list, renumbered."""
    j = i + by
    if not 0 <= j < len(layers):
        return layers
    out = list(layers)
    out[i], out[j] = out[j], out[i]
    return reindexed(out)


def deleted(layers: list[Layer], i: int, selected: int) -> tuple[list[Layer], int]:
    """Without layer i, and the selection that then holds."""
    out = reindexed(layers[:i] + layers[i + 1 :])
    return out, max(0, min(selected - (selected > i), len(out) - 1))


def layer_rows(layers: list[Layer]) -> list[tuple]:
    """For a relation layer_idx, name, kind, r, g, b, visible, include_in_export, print_index."""
    return [(i, x.name, x.kind, *x.ink, x.visible, x.include_in_export, x.print_index) for i, x in enumerate(layers)]


LAYER_SCHEMA = "layer_idx int, name string, kind string, r int, g int, b int, visible boolean, include_in_export boolean, print_index int"


class History:
    """Bounded undo and redo of layer lists with their selection; pushing clears redo."""

    def __init__(self, most: int = 64):
        self.past: deque = deque(maxlen=most)
        self.future: deque = deque(maxlen=most)

    def push(self, layers: list[Layer], selected: int | None = None) -> None:
        self.past.append((list(layers), selected))
        self.future.clear()

    def undo(self, now: tuple) -> tuple | None:
        return self._step(self.past, self.future, now)

    def redo(self, now: tuple) -> tuple | None:
        return self._step(self.future, self.past, now)

    @staticmethod
    def _step(source: deque, target: deque, now: tuple) -> tuple | None:
        if not source:
            return None
        target.append(now)
        return source.pop()
