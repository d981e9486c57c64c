"""Images in and out: files to pixel relations, density relations to PNG films.

PNG is decoded here with the standard library (all colour kinds and depths,
interlaced or not) and encoded as 8-bit gray or RGB.  Other formats go through
Spark's own image source, which reads what the JVM's decoders read (JPEG, BMP,
TIFF and GIF, but not WebP).  A file that cannot be decoded raises.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.layer import Layer

_PNG = b"\x89PNG\r\n\x1a\n"
FORMATS = ("png", "jpg", "jpeg", "webp", "tif", "tiff", "bmp")
PIXELS = "image_id string, i long, x int, y int, r int, g int, b int, alpha int"


#: Samples a pixel by PNG colour kind, and where each pass of an interlaced file starts and steps (x, y).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(raw: memoryview, rows: int, width: int, step: int) -> np.ndarray:
    """rows x width bytes, each row of which follows a byte that names its filter; step: bytes a pixel, at least 1."""
    out = np.zeros((rows, width), np.uint8)
    above = bytearray(width)
    for y in range(rows):
        kind, line = raw[y * (width + 1)], bytearray(raw[y * (width + 1) + 1 : (y + 1) * (width + 1)])
        if kind == 1:
            whole = -(-width // step) * step
            padded = np.zeros(whole, np.uint8)
            padded[:width] = line
            line = bytearray(np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:width].tobytes())
        elif kind == 2:
            line = bytearray((np.frombuffer(line, np.uint8) + np.frombuffer(above, np.uint8)).tobytes())
        elif kind == 3:
            for k in range(width):
                line[k] = (line[k] + ((line[k - step] if k >= step else 0) + above[k]) // 2) & 255
        elif kind == 4:
            for k in range(width):
                left, up, corner = (line[k - step], above[k], above[k - step]) if k >= step else (0, above[k], 0)
                far_left, far_up, far_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                near = left if far_left <= far_up and far_left <= far_corner else up if far_up <= far_corner else corner
                line[k] = (line[k] + near) & 255
        elif kind:
            raise ValueError(f"unknown row filter {kind}")
        out[y] = np.frombuffer(line, np.uint8)
        above = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """height x width x 4 samples of 8 bits; 16-bit samples are rounded to 8."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, body, head, parts = 8, [], None, {}
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        else:
            parts[kind] = part
        at += size + 12
    if head is None or head[3] not in _SAMPLES or head[2] not in (1, 2, 4, 8, 16) or (head[3] == 3 and b"PLTE" not in parts):
        raise ValueError("a PNG file without a header that says how to read it")
    w, h, depth, kind, laced = head[0], head[1], head[2], head[3], head[6]
    samples = _SAMPLES[kind]
    raw, at = memoryview(zlib.decompress(b"".join(body))), 0
    found = np.zeros((h, w, samples), np.uint16)
    for x0, y0, dx, dy in _PASSES if laced else ((0, 0, 1, 1),):
        wide, tall = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if wide <= 0 or tall <= 0:
            continue
        width = -(-wide * samples * depth // 8)
        rows = _unfiltered(raw[at : at + tall * (width + 1)], tall, width, max(1, samples * depth // 8))
        at += tall * (width + 1)
        if depth == 16:
            values = rows.reshape(tall, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
        elif depth == 8:
            values = rows
        else:
            bits = np.unpackbits(rows, axis=1).reshape(tall, -1, depth)
            values = bits @ (1 << np.arange(depth)[::-1]).astype(np.uint16)
        found[y0::dy, x0::dx] = values[:, : wide * samples].reshape(tall, wide, samples)
    clear = parts.get(b"tRNS")
    if kind == 3:
        colors = np.frombuffer(parts[b"PLTE"], np.uint8).reshape(-1, 3)
        alpha = np.full(len(colors), 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(colors)]
        return np.hstack([colors, alpha[:, None]])[found[..., 0]]
    keyed = None
    if clear and kind in (0, 2):
        keyed = (found == np.frombuffer(clear, ">u2")[:samples]).all(axis=-1)
    eight = found if depth == 8 else (found.astype(np.uint32) * 255 + (1 << depth) // 2 - 1) // ((1 << depth) - 1) if depth < 16 else (found.astype(np.uint32) + 128) // 257
    px = eight.astype(np.uint8)
    if samples < 3:
        px = np.concatenate([px[..., :1].repeat(3, -1), px[..., 1:]], -1)
    if px.shape[-1] == 3:
        px = np.concatenate([px, np.full((h, w, 1), 255, np.uint8)], -1)
    if keyed is not None:
        px[..., 3] = np.where(keyed, 0, 255)
    return px


def encode_png(pixels: np.ndarray, dpi: int | None = None) -> bytes:
    """8-bit gray (height x width) or RGB; dpi goes into the physical size chunk, in pixels a metre."""
    h, w = pixels.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.astype(np.uint8).reshape(h, -1)], 1).tobytes()
    out = _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0))
    if dpi:
        metre = int(dpi / 0.0254 + 0.5)
        out += chunk(b"pHYs", struct.pack(">IIB", metre, metre, 1))
    return out + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """The pixels of PNG files: image_id (the path), i, x, y, r, g, b, alpha.  A file that cannot be decoded raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                px = decode_png(data)
                h, w = px.shape[:2]
                flat, i = px.reshape(-1, 4).astype(np.int32), np.arange(h * w)
                for a in range(0, len(i), 1 << 18):
                    s = slice(a, a + (1 << 18))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(i[s])), pa.array(i[s]), pa.array((i[s] % w).astype(np.int32)), pa.array((i[s] // w).astype(np.int32)), *(pa.array(np.ascontiguousarray(flat[s, k])) for k in range(4))], ["image_id", "i", "x", "y", "r", "g", "b", "alpha"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, PIXELS)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels by Spark's image source, whose samples lie as B, G, R (and A); a file that it cannot decode raises."""
    img = spark.read.format("image").load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, h, w = r["nChannels"], r["height"], r["width"]
                if h < 0:
                    raise ValueError(f"no image that can be decoded: {r['origin']}")
                flat = np.frombuffer(r["data"], np.uint8).reshape(-1, n).astype(np.int32)
                i = np.arange(h * w)
                bgra = [flat[:, 0], flat[:, 1 % n if n > 1 else 0], flat[:, 2 if n > 2 else 0], flat[:, 3] if n == 4 else np.full(len(i), 255, np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array([r["origin"]] * len(i)), pa.array(i), pa.array((i % w).astype(np.int32)), pa.array((i // w).astype(np.int32)), *(pa.array(np.ascontiguousarray(bgra[k])) for k in (2, 1, 0, 3))], ["image_id", "i", "x", "y", "r", "g", "b", "alpha"])

    return img.mapInArrow(run, PIXELS)


def undecodable(spark: SparkSession, path: str) -> DataFrame:
    """path of the files that read_images cannot decode."""
    return spark.read.format("image").load(path).where("image.height < 0").select(F.col("image.origin").alias("path"))


def open_image(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """The pixels (i, x, y, r, g, b, alpha) and size of one image file; raises if it cannot be read."""
    px = read_png(spark, path) if path.lower().endswith(".png") else read_images(spark, path)
    size = px.agg(F.max("x") + 1, F.max("y") + 1).first()
    if size[0] is None:
        raise ValueError(f"no image: {path}")
    return px.drop("image_id"), (size[0], size[1])


# ------------------------------------------------------------------ film furniture


def registration_marks(mask: DataFrame, size: tuple[int, int], offset: int = 48, arm: int = 32, thickness: int = 2, dot: bool = True) -> DataFrame:
    """Crosshairs with a dot near the four corners, in full ink."""
    w, h = size
    thick = max(thickness, 1)
    ink = F.lit(False)
    for cx, cy in ((offset, offset), (w - offset - 1, offset), (offset, h - offset - 1), (w - offset - 1, h - offset - 1)):
        dx, dy = F.col("x") - cx, F.col("y") - cy
        band = lambda v: v.between(-(thick // 2), thick - thick // 2 - 1)
        ink = ink | (band(dy) & (F.abs(dx) <= arm)) | (band(dx) & (F.abs(dy) <= arm))
        if dot:
            r = max(thickness + 1, 2)
            ink = ink | (dx * dx + dy * dy <= r * r)
    return mask.withColumn("d", F.when(ink, 0).otherwise(F.col("d")).cast(mask.schema["d"].dataType))


def film_border(mask: DataFrame, size: tuple[int, int], margin: int = 24, caption: int = 56) -> tuple[DataFrame, tuple[int, int]]:
    """The film on a larger white sheet with an outline; the strip below is for the caption (captioned)."""
    w, h = size
    wide, tall = w + 2 * margin, h + 2 * margin + caption
    keys = [c for c in ("image_id", "layer_idx") if c in mask.columns]
    moved = mask.select(*keys, (F.col("x") + margin).alias("x"), (F.col("y") + margin).alias("y"), "d")
    sheet = mask.sparkSession.range(wide * tall).select((F.col("id") % wide).cast("int").alias("x"), F.floor(F.col("id") / wide).cast("int").alias("y"))
    sheet = mask.select(*keys).distinct().crossJoin(sheet) if keys else sheet  # every pixel of every sheet
    right, low = margin + w - 1, margin + h - 1
    edge = (F.col("x").isin(margin, right) & F.col("y").between(margin, low)) | (F.col("y").isin(margin, low) & F.col("x").between(margin, right))
    out = sheet.join(moved, [*keys, "x", "y"], "left").withColumn("d", F.when(edge, 0).otherwise(F.coalesce("d", F.lit(255))))
    return out.select(*keys, "x", "y", F.col("d").cast("int").alias("d")), (wide, tall)


_MODES = {"solid": "solid", "halftone": "halftone", "fm_floyd_steinberg": "FM", "bayer": "Bayer", "white_noise": "noise", "blue_noise": "blue noise", "index_fs": "idx FS", "index_bayer": "idx Bayer"}


def format_caption(layer: Layer, index: int, lpi: float) -> str:
    dots = layer.render_mode == "halftone"
    out = f"{index + 1:02}  {layer.name}  #{'%02X%02X%02X' % layer.ink}  {_MODES[layer.render_mode]}"
    if dots:
        out += f"  {int((layer.halftone.lpi if layer.halftone.lpi > 0 else lpi) + 0.5)}lpi"
        if layer.halftone.angle_deg >= 0:
            out += f"  {layer.halftone.angle_deg:.0f}°"
    return out


#: Where systems keep a font for captions; the first that can be read counts.
FONTS = (
    "C:/Windows/Fonts/segoeui.ttf", "C:/Windows/Fonts/arial.ttf", "C:/Windows/Fonts/tahoma.ttf",
    "/System/Library/Fonts/Helvetica.ttc", "/System/Library/Fonts/Supplemental/Arial.ttf",
    "/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf", "/usr/share/fonts/TTF/DejaVuSans.ttf",
)


def find_font(candidates: tuple[str, ...] = FONTS) -> str | None:
    return next((p for p in candidates if os.access(p, os.R_OK)), None)


def caption_pixels(spark: SparkSession, text: str, font: str, pixels: float) -> list[tuple[int, int, int]]:
    """x, y, d of a line of text, drawn by the JVM on the driver; nothing if it cannot use the font."""
    jvm = spark.sparkContext._jvm
    awt = jvm.java.awt
    try:
        face = awt.Font.createFont(awt.Font.TRUETYPE_FONT, jvm.java.io.File(font)).deriveFont(float(pixels))
        box = face.getStringBounds(text, awt.font.FontRenderContext(None, True, True))
        w, h = math.ceil(box.getWidth()) + 2, math.ceil(box.getHeight()) + 2
        sheet = awt.image.BufferedImage(w, h, awt.image.BufferedImage.TYPE_BYTE_GRAY)
        pen = sheet.createGraphics()
        pen.setRenderingHint(awt.RenderingHints.KEY_TEXT_ANTIALIASING, awt.RenderingHints.VALUE_TEXT_ANTIALIAS_ON)
        pen.setFont(face)
        pen.drawString(text, 0.0, float(-box.getY()))
        data = bytes(sheet.getRaster().getDataBuffer().getData())
    except Py4JJavaError:
        return []
    ink = np.frombuffer(data, np.uint8).reshape(h, w)
    return [(int(x), int(y), 255 - int(ink[y, x])) for y, x in zip(*np.nonzero(ink))]


def captioned(sheets: DataFrame, size: tuple[int, int], layers: dict[int, Layer], lpi: float, margin: int = 24, font: str | None = None, font_px: int = 0) -> DataFrame:
    """Bordered films (layer_idx, x, y, d) with each layer's caption below its film of the given size; unchanged without a font."""
    font = font or find_font()
    if font is None:
        return sheets
    w, h = size
    high = font_px or min(max(w / 70, 14.0), 40.0)
    rows = [(i, margin + x, margin + h + margin // 2 + y, d) for i, layer in layers.items() for x, y, d in caption_pixels(sheets.sparkSession, format_caption(layer, i, lpi), font, high)]
    if not rows:
        return sheets
    text = sheets.sparkSession.createDataFrame(rows, "layer_idx int, x int, y int, _t int")  # a line of text a layer
    on = ["layer_idx", "x", "y"]
    return sheets.join(F.broadcast(text), on, "left").withColumn("d", F.least("d", F.coalesce("_t", F.lit(255))).cast(sheets.schema["d"].dataType)).select(sheets.columns)


def sanitize(name: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c in "-_") else "_" for c in name)


def sanitized(name: Column | str) -> Column:
    """sanitize of a column."""
    return F.regexp_replace(name, "[^A-Za-z0-9_-]", "_")


def film_name(layer: Layer) -> str:
    return f"{layer.print_index:02}_{sanitize(layer.name)}_{'%02x%02x%02x' % layer.ink}.png"


def png_films(plates: DataFrame, layers: list[Layer] | dict[int, Layer], dpi: int | None = 300) -> DataFrame:
    """layers: by layer_idx. name, png of each plate (layer_idx, x, y, d); a plate is assembled in one task, since a PNG is one stream."""
    names = {i: film_name(x) for i, x in (layers.items() if isinstance(layers, dict) else enumerate(layers))}

    def run(t: pa.Table) -> pa.Table:
        f = t.to_pandas()
        sheet = np.full((f["y"].max() + 1, f["x"].max() + 1), 255, np.uint8)
        sheet[f["y"], f["x"]] = f["d"]
        return pa.table({"name": [names[int(f["layer_idx"].iloc[0])]], "png": [encode_png(sheet, dpi)]})

    return plates.select("layer_idx", "x", "y", "d").groupBy("layer_idx").applyInArrow(run, "name string, png binary")


def write_films(films: DataFrame, folder: str) -> list[str]:
    """Write each film under a folder that all executors share, and return the paths; a repeated task replaces its files."""
    from pyarrow import fs as pafs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        store.create_dir(top, recursive=True)
        for b in batches:
            for name, png in zip(b.column("name").to_pylist(), b.column("png").to_pylist()):
                with store.open_output_stream(f"{top}/.{name}.part") as out:
                    out.write(png)
                store.move(f"{top}/.{name}.part", f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in b.column("name").to_pylist()], pa.string())], ["path"])

    return sorted(r["path"] for r in films.mapInArrow(run, "path string").collect())  # a path a plate


def contact_sheet(masks: DataFrame, layers: list[Layer], size: tuple[int, int], columns: int = 4, cell: int = 300, padding: int = 16, shirt=(24, 24, 28), background=(20, 20, 24)) -> tuple[DataFrame, tuple[int, int]]:
    """x, y, r, g, b of a grid of previews in ink on the shirt, letterboxed in cells, and the sheet's size."""
    from ..operators.layers import lanczos_resize, over_shirt

    shown = [(i, x) for i, x in enumerate(layers) if x.visible and x.include_in_export]
    rows, step = -(-len(shown) // max(columns, 1)), cell + 24
    wide, tall = columns * cell + (columns + 1) * padding, rows * step + (rows + 1) * padding
    scale = min(cell / size[0], cell / size[1])
    fit = (max(1, int(size[0] * scale)), max(1, int(size[1] * scale)))
    sheet = masks.sparkSession.range(max(wide, 1) * max(tall, 1)).select((F.col("id") % wide).cast("int").alias("x"), F.floor(F.col("id") / wide).cast("int").alias("y"))
    color = [F.lit(v) for v in background]
    cells = None
    for n, (i, layer) in enumerate(shown):
        x0, y0 = padding + n % columns * (cell + padding), padding + n // columns * (step + padding)
        inside = F.col("x").between(x0, x0 + cell - 1) & F.col("y").between(y0, y0 + cell - 1)
        color = [F.when(inside, s).otherwise(c) for s, c in zip(shirt, color)]
        small = lanczos_resize(masks.where(F.col("layer_idx") == i).select("x", "y", "d"), size, fit)
        part = over_shirt(small, layer.ink, shirt).select((F.col("x") + x0 + (cell - fit[0]) // 2).alias("x"), (F.col("y") + y0 + (cell - fit[1]) // 2).alias("y"), *(F.col(c).alias(f"_{c}") for c in "rgb"))
        cells = part if cells is None else cells.unionByName(part)
    if cells is None:
        return sheet.select("x", "y", *(c.alias(n) for c, n in zip(color, "rgb"))), (wide, tall)
    out = sheet.join(cells, ["x", "y"], "left")
    return out.select("x", "y", *(F.coalesce(f"_{n}", c).cast("int").alias(n) for c, n in zip(color, "rgb"))), (wide, tall)
