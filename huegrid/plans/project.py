"""Project documents: versioned JSON of a layer list and the settings of its session."""

from __future__ import annotations

import base64
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import images
from . import pipeline
from .layer import RGB, Halftone, Job, Layer, MaskShape, Tone
from .workflows import Options

VERSION = 1
#: What Spark reads of a document; extractors stay JSON text, since their fields depend on their kind.
SCHEMA = "version int, source string, layers array<struct<id string, name string, kind string, ink array<int>, visible boolean, include_in_export boolean, extractor string, render_mode string, print_index int>>"


#: Extractor parameters that are colours or lists of them.
COLORS = ("ink", "target", "targets", "others", "palette")


class ProjectError(ValueError):
    pass


@dataclass(frozen=True)
class Project:
    layers: list[Layer]
    source: str | None = None
    shirt: RGB = (24, 24, 28)
    job: Job = Job()
    workflow: str = "simprocess_dark"
    options: Options = field(default_factory=Options)

    def to_json(self) -> str:
        def plain(x):
            if isinstance(x, bytes):
                return {"base64": base64.b64encode(x).decode()}
            raise TypeError(type(x))

        return json.dumps({"version": VERSION, **asdict(self)}, indent=2, default=plain)

    @staticmethod
    def from_json(text: str) -> "Project":
        """Fields that older documents lack take their defaults; newer versions raise."""
        doc = json.loads(text, object_hook=lambda d: base64.b64decode(d["base64"]) if set(d) == {"base64"} else d)
        if doc.get("version", 0) > VERSION:
            raise ProjectError(f"version {doc['version']} is newer than {VERSION}")
        settings = {k: doc[k] for k in ("source", "workflow") if k in doc}
        if "shirt" in doc:
            settings["shirt"] = tuple(doc["shirt"])
        if "job" in doc:
            settings["job"] = Job(**doc["job"])
        if "options" in doc:
            settings["options"] = Options(**{k: tuple(v) if isinstance(v, list) else v for k, v in doc["options"].items()})
        return Project([_layer(x) for x in doc["layers"]], **settings)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json())

    @staticmethod
    def load(path: str) -> "Project":
        with open(path, encoding="utf-8") as f:
            return Project.from_json(f.read())


def _layer(x: dict) -> Layer:
    tone = dict(x.get("tone", {}))
    if "curve" in tone:
        tone["curve"] = tuple(map(tuple, tone["curve"]))
    color = lambda v: tuple(v) if isinstance(v, list) and len(v) == 3 and all(isinstance(c, int) for c in v) else [color(c) for c in v] if isinstance(v, list) else v
    if "extractor" in x:
        x = x | {"extractor": {k: color(v) if k in COLORS else v for k, v in x["extractor"].items()}}
    parts = dict(ink=tuple(x["ink"]), tone=Tone(**tone), mask=MaskShape(**x.get("mask", {})), halftone=Halftone(**x.get("halftone", {})))
    return Layer(**{k: v for k, v in x.items() if k not in parts}, **parts)


def to_json(layers: list[Layer], source: str | None = None) -> str:
    return Project(layers, source).to_json()


def from_json(text: str) -> tuple[list[Layer], str | None]:
    """Layers and source."""
    found = Project.from_json(text)
    return found.layers, found.source


@dataclass(frozen=True)
class Session:
    """A reopened project: its image and all its plates, or neither if the source no longer reads."""

    project: Project
    generation: int
    px: DataFrame | None = None
    size: tuple[int, int] | None = None
    previews: DataFrame | None = None


def reopen(spark: SparkSession, project: Project, generation: int = 0) -> Session:
    """The session that a project stands for, one generation on.

    The source is read again if its path still leads to an image, as r, g, b:
    neither alpha nor a foreground mask comes back.  All layers are planned.
    """
    try:
        px, size = images.open_image(spark, project.source) if project.source else (None, None)
    except Exception:  # gone or no image: the layers are there all the same
        px, size = None, None
    if px is None:
        return Session(project, generation + 1)
    px = px.drop("alpha")
    previews = pipeline.separate(px, project.layers, size, project.job, processed=False) if project.layers else None
    return Session(project, generation + 1, px, size, previews)


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """One row a layer of every document under path."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", SCHEMA).alias("p"))
    return docs.select("p.version", "p.source", F.posexplode("p.layers").alias("layer_idx", "l")).select("version", "source", "layer_idx", "l.*")
