"""Command lines: ``python -m huegrid separate`` (a workflow's films) and ``python -m huegrid extract`` (one extractor's mask).

Exit codes: 0 done, 1 the image cannot be read or a film not written, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.color import HexError, parse_hex
from .plans import domains, pipeline, workflows
from .plans.layer import BLACK, Job, Layer
from .sources import images


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="huegrid")
    verbs = top.add_subparsers(dest="verb", required=True)
    s = verbs.add_parser("separate", help="run a workflow on an image and write its layers as PNG films")
    s.add_argument("--image", required=True)
    s.add_argument("--outdir", default="films")
    s.add_argument("--workflow", help="left out: chosen by the image's statistics")
    s.add_argument("--max-colors", type=int)
    s.add_argument("--dpi", type=int, default=300)
    s.add_argument("--lpi", type=float, default=55.0)
    s.add_argument("--preview", action="store_true", help="write smooth previews instead of dots")
    e = verbs.add_parser("extract", help="run one extractor on an image and write its mask")
    e.add_argument("--image", required=True)
    e.add_argument("--out", default="out.png")
    e.add_argument("--extractor", default="gcr_black")
    e.add_argument("--target", type=parse_hex)
    e.add_argument("--tolerance", type=int)
    e.add_argument("--fuzziness", type=float)
    e.add_argument("--strength", type=float)
    e.add_argument("--invert", action="store_true")
    e.add_argument("--threshold", type=int)
    e.add_argument("--above", action="store_true")
    e.add_argument("--expr")
    return top


#: Extractors of the command line and the options that each reads; spot_aa and index_assignment need palettes and take the library.
OPTIONS = {
    "spot_solid": {"tolerance": "tolerance"}, "color_range": {"fuzziness": "fuzziness"}, "hsb_brightness_inverted": {}, "lab_lightness_inverted": {},
    "gcr_black": {"strength": "strength", "invert_input": "invert"}, "luminance_threshold": {"threshold": "threshold", "above": "above"}, "channel_calc": {"expr": "expr"},
}


def extractor_of(a: argparse.Namespace) -> dict:
    if a.extractor not in OPTIONS:
        raise ValueError(f"unknown extractor: {a.extractor}; there are {', '.join(OPTIONS)}")
    if a.extractor in ("spot_solid", "color_range") and a.target is None:
        raise ValueError(f"{a.extractor} needs --target #RRGGBB")
    if a.extractor == "channel_calc" and a.expr is None:
        raise ValueError('channel_calc needs --expr "<formula>"')
    given = {field: getattr(a, option) for field, option in OPTIONS[a.extractor].items() if getattr(a, option) is not None}
    return domains.extractor_defaults(a.extractor, a.target or BLACK) | given


def _say(text: str) -> None:
    print(f"error: {text}", file=sys.stderr)


def separate(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.workflow is not None and a.workflow not in workflows.LABELS:
        _say(f"unknown workflow {a.workflow!r}; known workflows:")
        for k, label in workflows.LABELS.items():
            print(f"  {k:<22}  {label}", file=sys.stderr)
        return 2
    try:
        px, size = images.open_image(spark, a.image)
    except Exception as e:  # whatever the reader says
        _say(f"failed to open {a.image}: {str(e).splitlines()[0]}")
        return 1
    options = workflows.Options(**({"max_colors": a.max_colors} if a.max_colors is not None else {}))
    if a.workflow is None:
        workflow, layers = workflows.auto_plan(px, size, options)
        print(f"auto-detected workflow: {workflows.LABELS[workflow]}")
    else:
        workflow, layers = a.workflow, workflows.plan(a.workflow, px, options)
    if not layers:
        print(f"warning: workflow {workflow} produced 0 layers", file=sys.stderr)
        return 0
    print(f"running {len(layers)} layers through workflow {workflow}")
    plates = pipeline.separate(px, layers, size, Job(a.dpi, a.lpi, 22.5), processed=not a.preview)
    for path in images.write_films(images.png_films(plates, layers, None), a.outdir):
        print(f"  wrote {path}")
    return 0


def extract(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        spec = extractor_of(a)
    except ValueError as e:
        _say(str(e))
        return 2
    try:
        px, size = images.open_image(spark, a.image)
    except Exception as e:  # whatever the reader says
        _say(f"failed to open {a.image}: {str(e).splitlines()[0]}")
        return 1
    layer = Layer(a.target or BLACK, a.extractor, "color", extractor=spec)
    preview, _ = pipeline.process_layer(px, layer, size, Job())
    films = images.png_films(preview.withColumn("layer_idx", F.lit(0)), [layer], None)
    folder, _, name = a.out.rpartition("/")
    images.write_films(films.withColumn("name", F.lit(name)), folder or ".")
    print(f"wrote {a.out} ({size[0]}x{size[1]}, extractor: {a.extractor})")
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(args)
    except HexError as e:
        _say(str(e))
        return 2
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("huegrid").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    return {"separate": separate, "extract": extract}[a.verb](spark, a)
