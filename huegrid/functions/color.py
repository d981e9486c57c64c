"""Colour scalars as Columns: sRGB, LAB, differences, names and hex.

Channels are integers 0..255, LAB values doubles (D65).  Everything stays in
whole-stage codegen.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Linear sRGB to XYZ and back, the D65 white, and the LAB break point.
TO_XYZ = ((0.412456, 0.357576, 0.180437), (0.212673, 0.715152, 0.072175), (0.019334, 0.119192, 0.950304))
FROM_XYZ = ((3.240454, -1.537138, -0.498531), (-0.969266, 1.87601, 0.041556), (0.055643, -0.204025, 1.057225))
WHITE = (0.95047, 1.0, 1.08883)
DELTA = 6.0 / 29.0
LUMA = (0.299, 0.587, 0.114)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def byte(c: Column) -> Column:
    """Rounded half up into 0..255."""
    return clamp(F.round(c), 0.0, 255.0).cast("int")


def luma(r="r", g="g", b="b") -> Column:
    return byte(LUMA[0] * col(r) + LUMA[1] * col(g) + LUMA[2] * col(b))


def linear_of(v: int) -> float:
    c = v / 255
    return c / 12.92 if c <= 0.040448 else ((c + 0.055) / 1.055) ** 2.4


def to_linear(c: Column | str) -> Column:
    """Linear light of a channel, from a table of its 256 values (a folded literal)."""
    return F.element_at(F.array(*(F.lit(linear_of(v)) for v in range(256))), (col(c) + 1).cast("int"))


def from_linear(c: Column) -> Column:
    v = clamp(c, 0.0, 1.0)
    return byte(255.0 * F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1.0 / 2.4)) - 0.055))


def _mix(row: tuple[float, ...], parts: list[Column]) -> Column:
    return F.lit(row[0]) * parts[0] + F.lit(row[1]) * parts[1] + F.lit(row[2]) * parts[2]


def with_lab(px: DataFrame, names: tuple[str, str, str] = ("l", "a", "b_")) -> DataFrame:
    """px with LAB columns; the steps are columns of their own so that each is computed once."""
    keep = px.columns
    out = px.withColumns({f"_{c}": to_linear(c) for c in "rgb"})
    xyz = {f"_{n}": _mix(row, [F.col("_r"), F.col("_g"), F.col("_b")]) / F.lit(white) for n, row, white in zip("xyz", TO_XYZ, WHITE)}
    out = out.withColumns({f"_f{n[1]}": F.when(c > DELTA**3, F.cbrt(c)).otherwise(c / (3 * DELTA * DELTA) + 4.0 / 29.0) for n, c in xyz.items()})
    fx, fy, fz = (F.col(f"_f{n}") for n in "xyz")
    l, a, b = names
    return out.select(*keep, (116.0 * fy - 16.0).alias(l), (500.0 * (fx - fy)).alias(a), (200.0 * (fy - fz)).alias(b))


def lab_of(rgb: tuple[int, int, int]) -> tuple[float, float, float]:
    """LAB of a constant colour, for the planner."""
    lin = [linear_of(v) for v in rgb]
    f = []
    for row, white in zip(TO_XYZ, WHITE):
        t = sum(k * v for k, v in zip(row, lin)) / white
        f.append(math.cbrt(t) if t > DELTA**3 else t / (3 * DELTA * DELTA) + 4 / 29)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def lab_to_rgb(l: Column, a: Column, b: Column) -> list[Column]:
    """The r, g and b Columns of LAB values."""
    fy = (l + 16.0) / 116.0
    back = lambda f: F.when(f > DELTA, f * f * f).otherwise(3 * DELTA * DELTA * (f - 4.0 / 29.0))
    xyz = [F.lit(w) * back(f) for w, f in zip(WHITE, (fy + a / 500.0, fy, fy - b / 200.0))]
    return [from_linear(_mix(row, xyz)) for row in FROM_XYZ]


def rgb_of(lab: tuple[float, float, float]) -> tuple[int, int, int]:
    fy = (lab[0] + 16) / 116
    xyz = [w * (f**3 if f > DELTA else 3 * DELTA * DELTA * (f - 4 / 29)) for w, f in zip(WHITE, (fy + lab[1] / 500, fy, fy - lab[2] / 200))]
    out = []
    for row in FROM_XYZ:
        v = min(max(sum(k * x for k, x in zip(row, xyz)), 0.0), 1.0)
        v = v * 12.92 if v <= 0.0031308 else 1.055 * v ** (1 / 2.4) - 0.055
        out.append(min(max(math.floor(v * 255 + 0.5), 0), 255))
    return tuple(out)


def delta_e(l1, a1, b1, l2, a2, b2) -> Column:
    """CIE76: Euclidean distance."""
    d = [col(x) - (F.lit(y) if isinstance(y, (int, float)) else col(y)) for x, y in ((l1, l2), (a1, a2), (b1, b2))]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def delta_e94(l1, a1, b1, l2, a2, b2) -> Column:
    """CIE94 with kL 2, K1 0.048, K2 0.014; not symmetric: the second colour's chroma scales."""
    lift = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else col(v)
    l1, a1, b1, l2, a2, b2 = map(lift, (l1, a1, b1, l2, a2, b2))
    c1, c2 = F.sqrt(a1 * a1 + b1 * b1), F.sqrt(a2 * a2 + b2 * b2)
    dl, dc, da, db = l1 - l2, c1 - c2, a1 - a2, b1 - b2
    dh2 = F.greatest(da * da + db * db - dc * dc, F.lit(0.0))
    tl, tc = dl / 2.0, dc / (1.0 + 0.048 * c2)
    sh = 1.0 + 0.014 * c2
    return F.sqrt(tl * tl + tc * tc + dh2 / (sh * sh))


def delta_e94_of(x: tuple, y: tuple) -> float:
    c1, c2 = math.hypot(x[1], x[2]), math.hypot(y[1], y[2])
    dl, dc = x[0] - y[0], c1 - c2
    dh2 = max((x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2 - dc * dc, 0.0)
    return math.sqrt((dl / 2) ** 2 + (dc / (1 + 0.048 * c2)) ** 2 + dh2 / (1 + 0.014 * c2) ** 2)


def chroma(a="a", b="b_") -> Column:
    return F.sqrt(col(a) * col(a) + col(b) * col(b))


def hue_deg(a="a", b="b_") -> Column:
    h = F.degrees(F.atan2(col(b), col(a)))
    return F.when(h < 0, h + 360.0).otherwise(h)


def hue_distance(x: Column, y: Column) -> Column:
    d = F.abs(x - y)
    return F.least(d, 360.0 - d)


def hex_of(r="r", g="g", b="b") -> Column:
    return F.concat(F.lit("#"), *(F.lpad(F.hex(col(c)), 2, "0") for c in (r, g, b)))


def rgb_from_hex(c: Column | str) -> Column:
    """A struct r, g, b; null unless there are exactly six hex digits after an optional #."""
    digits = F.regexp_extract(col(c), "^#?([0-9A-Fa-f]{6})$", 1)
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    return F.when(digits != "", F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


class HexError(ValueError):
    pass


def parse_hex(text: str) -> tuple[int, int, int]:
    """The same for a constant; errors name the length or the digits."""
    digits = text.removeprefix("#")
    if len(digits) != 6:
        raise HexError(f"six hex digits wanted, got {len(digits)}")
    try:
        return tuple(int(digits[k : k + 2], 16) for k in (0, 2, 4))
    except ValueError:
        raise HexError(f"not hex digits: {digits!r}") from None


def parse_hex_field(text: str, now: tuple[int, int, int]) -> tuple[int, int, int]:
    """A colour typed into a field: blanks and any number of leading # are dropped; what is no colour leaves the one there is."""
    try:
        return parse_hex(text.strip().lstrip("#"))
    except HexError:
        return now


def value(r="r", g="g", b="b") -> Column:
    """HSV value in 0..1."""
    return F.greatest(col(r), col(g), col(b)) / F.lit(255.0)


def saturation(r="r", g="g", b="b") -> Column:
    high, low = F.greatest(col(r), col(g), col(b)) / F.lit(255.0), F.least(col(r), col(g), col(b)) / F.lit(255.0)
    return F.when(high > 1e-6, (high - low) / high).otherwise(0.0)


def logistic_s(x: Column, amount: float) -> Column:
    """x^k / (x^k + (1-x)^k); k = 1 is the identity."""
    if abs(amount - 1.0) < 1e-4:
        return x
    up, down = F.pow(x, F.lit(amount)), F.pow(1.0 - x, F.lit(amount))
    return up / (up + down)


def falloff(t: Column, kind: str) -> Column:
    return {"linear": lambda: t, "quadratic": lambda: t * t, "smooth": lambda: t * t * (3.0 - 2.0 * t)}[kind]()


#: How dark shades of the plain names are called, where not "dark" and the name.
DARK_NAMES = {"yellow": "olive", "cyan": "teal"}
PLAIN_NAMES = ("red", "green", "blue", "yellow", "cyan", "magenta", "purple")


def _named(r, g, b, high, low, third, pick):
    """The decision tree over channels, for Columns or whole numbers; pick(cases, other) takes the first case that holds."""
    base = pick([
        ((r == high) & (g >= b) & (g > third(r, 2)), "yellow"), ((r == high) & (g >= b) & (b > third(r, 1)), "magenta"), (r == high, "red"),
        ((g == high) & (r >= b) & (r > third(g, 2)), "yellow"), (g == high, "green"),
        (r > third(b, 2), "purple"), (g > third(b, 2), "cyan"),
    ], "blue")
    gray = pick([(high < 96, "darkgray"), (high > 180, "lightgray")], "gray")
    dark = pick([(base == n, DARK_NAMES.get(n, f"dark{n}")) for n in PLAIN_NAMES], "")
    return pick([(high < 32, "black"), (low > 224, "white"), (high - low < 20, gray), ((base == "red") & (high > 200) & (low > 80), "pink"), (high < 110, dark)], base)


def color_name(r="r", g="g", b="b") -> Column:
    """One of 20 short names, by a decision tree on integers."""
    r, g, b = col(r).cast("int"), col(g).cast("int"), col(b).cast("int")

    def pick(cases, other):
        out = F.lit(other) if isinstance(other, str) else other
        for when, value in reversed(cases):
            out = F.when(when, value).otherwise(out)
        return out

    return _named(r, g, b, F.greatest(r, g, b), F.least(r, g, b), lambda c, k: F.floor(c * k / 3), pick)


def name_of(rgb: tuple[int, int, int]) -> str:
    """color_name of one colour, on the driver."""
    return _named(*rgb, max(rgb), min(rgb), lambda c, k: c * k // 3, lambda cases, other: next((v for when, v in cases if when), other))


#: The meshes on sale and the screen angles in order of print.
MESHES = (110, 156, 200, 230, 280, 305, 355, 380)
ANGLES = (45.0, 75.0, 15.0, 105.0, 0.0, 60.0, 30.0, 90.0, 22.5, 67.5, 112.5, 157.5)


def mesh_for_lpi(lpi: Column | str) -> Column:
    """The mesh nearest to 4.5 times the screen frequency, the first of equals."""
    want = F.round(4.5 * col(lpi))
    near = F.transform(F.array(*map(F.lit, MESHES)), lambda m, k: F.struct(F.abs(m - want).alias("d"), k.alias("k"), m.alias("m")))
    return F.array_min(near)["m"]


def auto_angle(index: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, ANGLES)), (F.pmod(col(index), F.lit(len(ANGLES))) + 1).cast("int"))


def shape_curve(x: Column, kind: str) -> Column:
    """Coverage curves of the halftone."""
    x = clamp(x, 0.0, 1.0)
    if kind == "s_curve":
        return x * x * (3.0 - 2.0 * x)
    if kind == "hard":
        return F.when(x < 0.5, clamp(x * 0.2, 0.0, 1.0)).otherwise(clamp(0.1 + (x - 0.5) * 1.8, 0.0, 1.0))
    return x
