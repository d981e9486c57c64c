"""The queries of huegrid.queries in DuckDB SQL, written apart from the DataFrame code.

Neighbourhoods are joins instead of windows; the flood fill, error diffusion
(a row a step), median cut and k-means are recursive queries.
"""

from __future__ import annotations

import math

from .fixtures import BASE, LAYERS
from .functions.color import ANGLES, MESHES
from .functions.tone import CURVES
from .operators.extract import bayer_matrix
from .operators.raster import blue_noise_tile

ORACLES: dict[str, str] = {}

TARGETS = BASE[:4]
WEIGHTS = (0.0, 2.5, 0.0, -1.0)


def _channel(c: int) -> str:
    arms = " ".join(f"WHEN {k} THEN {base[c]} {'+ nz' if k < 4 else ''}" for k, base in enumerate(BASE))
    return f"CASE WHEN x < 4 OR x > 95 THEN 255 ELSE CASE k {arms} END END"


PX = f"""
p0 AS (SELECT o_orderkey AS i, o_orderkey % 100 AS x, o_orderkey // 100 AS y, (o_custkey * 7) % 9 AS nz FROM orders),
p1 AS (SELECT *, (x // 12 + y // 9) % 5 AS k FROM p0),
px AS (SELECT i, x, y, {_channel(0)} AS r, {_channel(1)} AS g, {_channel(2)} AS b FROM p1)"""
DIM = "dim AS (SELECT 100 AS w, max(o_orderkey) // 100 + 1 AS h FROM orders)"
GRAY = PX + ", m AS (SELECT x, y, greatest(r, g, b) AS d FROM px)"


def _lin(c: str) -> str:
    return f"(CASE WHEN {c} / 255e0 <= 0.040448 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END)"


def _lab(source: str, out: str, keep: str = "*") -> str:
    """CTEs that add l, a, b_ to a relation with r, g, b."""
    f = lambda t: f"(CASE WHEN {t} > pow(6e0 / 29, 3) THEN cbrt({t}) ELSE {t} / (3 * pow(6e0 / 29, 2)) + 4e0 / 29 END)"
    return f"""
{out}_1 AS (SELECT *, {_lin('r')} AS lr, {_lin('g')} AS lg, {_lin('b')} AS lb FROM {source}),
{out}_2 AS (SELECT *, (0.412456e0 * lr + 0.357576e0 * lg + 0.180437e0 * lb) / 0.95047e0 AS tx, 0.212673e0 * lr + 0.715152e0 * lg + 0.072175e0 * lb AS ty,
  (0.019334e0 * lr + 0.119192e0 * lg + 0.950304e0 * lb) / 1.08883e0 AS tz FROM {out}_1),
{out}_3 AS (SELECT *, {f('tx')} AS fx, {f('ty')} AS fy, {f('tz')} AS fz FROM {out}_2),
{out} AS (SELECT {keep}, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b_ FROM {out}_3)"""


LAB = PX + "," + _lab("px", "lab")


def _byte(v: str) -> str:
    return f"CAST(least(greatest(round({v}), 0), 255) AS BIGINT)"


def _de94(l1, a1, b1, l2, a2, b2) -> str:
    c1, c2 = f"sqrt(({a1}) * ({a1}) + ({b1}) * ({b1}))", f"sqrt(({a2}) * ({a2}) + ({b2}) * ({b2}))"
    dh = f"greatest(pow(({a1}) - ({a2}), 2) + pow(({b1}) - ({b2}), 2) - pow({c1} - {c2}, 2), 0)"
    return f"sqrt(pow((({l1}) - ({l2})) / 2e0, 2) + pow(({c1} - {c2}) / (1 + 0.048e0 * {c2}), 2) + {dh} / pow(1 + 0.014e0 * {c2}, 2))"


def _colors(rows, name: str) -> str:
    values = ", ".join(f"({i}, {r}, {g}, {b})" for i, (r, g, b) in enumerate(rows))
    return f"{name}_v(idx, r, g, b) AS (VALUES {values}),{_lab(f'{name}_v', f'{name}_l')}, {name} AS (SELECT idx, l AS tl, a AS ta, b_ AS tb FROM {name}_l)"


def _curve(points, d: str) -> str:
    """A piecewise-linear curve over density d, rounded; the last of points at one input counts."""
    table = dict(sorted(points, key=lambda p: p[0]))
    at = sorted(table.items())
    arms = [f"WHEN {d} <= {at[0][0]} THEN {at[0][1]}"]
    for (x0, y0), (x1, y1) in zip(at, at[1:]):
        arms.append(f"WHEN {d} <= {x1} THEN round({y0} + ({y1} - {y0}) * ({d} - {x0}) / {x1 - x0}e0)")
    return f"CAST(CASE {' '.join(arms)} ELSE {at[-1][1]} END AS BIGINT)"


def _density(name: str, v: str, lab: bool = False) -> None:
    ORACLES[name] = f"WITH {LAB if lab else PX} SELECT x, y, CAST({v} AS BIGINT) AS d FROM {'lab' if lab else 'px'}"


# colour scalars

ORACLES["lab_values"] = f"WITH {LAB} SELECT i, round(l, 4) + 0e0 AS l, round(a, 4) + 0e0 AS a, round(b_, 4) + 0e0 AS b FROM lab"


def _gamma(v: str) -> str:
    c = f"least(greatest({v}, 0), 1)"
    return _byte(f"255 * CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92e0 ELSE 1.055e0 * pow({c}, 1 / 2.4e0) - 0.055e0 END")


def _to_rgb(source: str) -> str:
    back = lambda f: f"(CASE WHEN {f} > 6e0 / 29 THEN {f} * {f} * {f} ELSE 3 * pow(6e0 / 29, 2) * ({f} - 4e0 / 29) END)"
    return f"""
u1 AS (SELECT *, (l + 16) / 116 AS gy, (l + 16) / 116 + a / 500 AS gx, (l + 16) / 116 - b_ / 200 AS gz FROM {source}),
u2 AS (SELECT *, 0.95047e0 * {back('gx')} AS ux, {back('gy')} AS uy, 1.08883e0 * {back('gz')} AS uz FROM u1),
u3 AS (SELECT *, {_gamma('3.240454e0 * ux - 1.537138e0 * uy - 0.498531e0 * uz')} AS r2, {_gamma('-0.969266e0 * ux + 1.87601e0 * uy + 0.041556e0 * uz')} AS g2,
  {_gamma('0.055643e0 * ux - 0.204025e0 * uy + 1.057225e0 * uz')} AS b2 FROM u2)"""


HUE = "CASE WHEN degrees(atan2(b_, a)) < 0 THEN degrees(atan2(b_, a)) + 360 ELSE degrees(atan2(b_, a)) END"
ORACLES |= {
    "lab_round_trip": f"WITH {LAB},{_to_rgb('lab')} SELECT i, r2, g2, b2 FROM u3",
    "hue_chroma": f"WITH {LAB}, hc AS (SELECT i, {HUE} AS h, sqrt(a * a + b_ * b_) AS c FROM lab) SELECT i, CASE WHEN c > 1 THEN round(h, 4) END AS hue, CASE WHEN c > 1 THEN round(c, 4) END AS chroma, CASE WHEN c > 1 THEN round(least(abs(h - 350), 360 - abs(h - 350)), 4) END AS from_350 FROM hc",
    "delta_e_pair": f"WITH {LAB}, {_colors(TARGETS[:1], 't')} SELECT i, round(sqrt(pow(l - tl, 2) + pow(a - ta, 2) + pow(b_ - tb, 2)), 4) AS e76, round({_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')}, 4) AS e94 FROM lab, t",
    "linear_light": f"WITH {PX} SELECT i, round({_lin('r')}, 6) AS lin, {_gamma(_lin('r') + ' * 0.5e0')} AS half FROM px",
    "luma_hist": f"WITH {PX} SELECT {_byte('0.299e0 * r + 0.587e0 * g + 0.114e0 * b')} AS luma, count(*) AS n FROM px GROUP BY 1",
    "hsv_stats": f"WITH {PX} SELECT i, round(greatest(r, g, b) / 255e0, 6) AS v, round(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) END, 6) AS s FROM px",
}
NAME = """CASE WHEN hi < 32 THEN 'black' WHEN lo > 224 THEN 'white'
 WHEN hi - lo < 20 THEN CASE WHEN hi < 96 THEN 'darkgray' WHEN hi > 180 THEN 'lightgray' ELSE 'gray' END
 WHEN base = 'red' AND hi > 200 AND lo > 80 THEN 'pink'
 WHEN hi < 110 THEN CASE base WHEN 'yellow' THEN 'olive' WHEN 'cyan' THEN 'teal' ELSE 'dark' || base END ELSE base END"""
BASE_NAME = """CASE WHEN r = hi THEN CASE WHEN g >= b AND g > r * 2 // 3 THEN 'yellow' WHEN g >= b AND b > r // 3 THEN 'magenta' ELSE 'red' END
 WHEN g = hi THEN CASE WHEN r >= b AND r > g * 2 // 3 THEN 'yellow' ELSE 'green' END
 WHEN r > b * 2 // 3 THEN 'purple' WHEN g > b * 2 // 3 THEN 'cyan' ELSE 'blue' END"""
NAMED = f"c1 AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM px), c2 AS (SELECT *, {BASE_NAME} AS base FROM c1), named AS (SELECT *, {NAME} AS name FROM c2)"
MESH = ", ".join(f"({k}, {m})" for k, m in enumerate(MESHES))
ORACLES |= {
    "color_name_hist": f"WITH {PX}, {NAMED} SELECT name, count(*) AS n FROM named GROUP BY 1",
    "color_name_cube": f"WITH px AS (SELECT o_orderkey % 13 * 21 AS r, o_orderkey // 13 % 13 * 21 AS g, o_orderkey // 169 % 13 * 21 AS b FROM orders), {NAMED} SELECT name, count(*) AS n, CAST(sum(r + g * 2 + b * 3) AS BIGINT) AS sum FROM named GROUP BY 1",
    "hex_round_trip": f"WITH {PX} SELECT i, printf('#%02X%02X%02X', r, g, b) AS hex, r, g, b FROM px",
    "sanitize_names": "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_-]', '_', 'g') AS file FROM part",
    "mesh_and_angle": f"""WITH mesh(k, m) AS (VALUES {MESH}), near AS (SELECT p_partkey, m, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(m - round(4.5e0 * (p_size + 20))), k) AS rn FROM part, mesh)
SELECT p_partkey, CAST(m AS BIGINT) AS mesh, CAST([{', '.join(map(str, ANGLES))}][p_partkey % {len(ANGLES)} + 1] AS DOUBLE) AS angle FROM near JOIN part USING (p_partkey) WHERE rn = 1""",
}

# extractors

R0 = TARGETS[0]
_density("spot_solid_mask", f"CASE WHEN abs(r - {R0[0]}) <= 6 AND abs(g - {R0[1]}) <= 6 AND abs(b - {R0[2]}) <= 6 THEN 0 ELSE 255 END")
_density("gcr_black", "greatest(r, g, b)")
_density("gcr_highlight", f"255 - {_byte('(255 - greatest(255 - r, 255 - g, 255 - b)) * 1.3e0')}")
LUMA = _byte("0.299e0 * r + 0.587e0 * g + 0.114e0 * b")
_density("stencil_mask", f"CASE WHEN {LUMA} < 128 THEN 0 ELSE 255 END")
_density("luminance_above", f"CASE WHEN {LUMA} >= 100 THEN 0 ELSE 255 END")
V, SAT = "(greatest(r, g, b) / 255e0)", "(CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / CAST(greatest(r, g, b) AS DOUBLE) END)"
_density("hsb_plain", _byte(f"255 * (1 - {V})"))
_density("hsb_underbase", _byte(f"255 * (1 - least(greatest(pow({V}, 1.4e0) / (pow({V}, 1.4e0) + pow(1 - {V}, 1.4e0)) + {SAT} * (1 - {V}) * least(greatest(({V} - 0.1e0) / 0.15e0, 0), 1) * 0.8e0, 0), 1))"))
_density("lab_underbase", _byte("255 * (1 - least(greatest(l, 0), 100) / 100)"), True)
C_, M_, Y_ = (f"(1 - {_lin(c)})" for c in "rgb")
K_ = f"(least({C_}, {M_}, {Y_}) * 0.75e0)"
for _n, _v in (("cyan", C_), ("magenta", M_), ("yellow", Y_)):
    _density(f"cmyk_{_n}", _byte(f"255 * (1 - greatest({_v} - {K_}, 0))"))
_density("cmyk_black", _byte(f"255 * (1 - {K_})"))
for _n, _v in (("linear", "t"), ("quadratic", "t * t"), ("smooth", "t * t * (3 - 2 * t)")):
    ORACLES[f"color_range_{_n}"] = f"WITH {LAB}, {_colors(TARGETS[2:3], 'c')}, f AS (SELECT x, y, least(greatest({_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')} / 40, 0), 1) AS t FROM lab, c) SELECT x, y, {_byte(f'255 * ({_v})')} AS d FROM f"
_density("dsl_max_diff", _byte("255 * (1 - least(greatest(greatest(r / 255e0, g / 255e0) - least(g / 255e0, b / 255e0) * 0.5e0, 0), 1))"))
LN = "least(greatest(l / 100, 0), 1)"
_density("dsl_lband", _byte(f"255 * (1 - least(greatest(1 - abs({LN} - 0.5e0) * 3.3e0, 0), 1))"), True)
AN, BN = "least(greatest(a / 128, -1), 1)", "least(greatest(b_ / 128, -1), 1)"
_density("dsl_mix", _byte(f"255 * (1 - least(greatest((1 - (1 - {V})) / (0.2e0 + abs({AN})) * -({BN} - 1) / 4, 0), 1))"), True)
_density("blank_plate", "255")
B8 = bayer_matrix(8)
B8_LIST = "[" + ", ".join(str(int(v)) for v in B8.ravel()) + "]"
ORACLES |= {
    "index_bayer_assign": f"""WITH {LAB}, {_colors(TARGETS, 't')}, s AS (SELECT x, y, l + ({B8_LIST}[y % 8 * 8 + x % 8 + 1] - 31.5e0) / 31.5e0 * 8 AS l, a, b_ FROM lab),
e AS (SELECT x, y, idx, row_number() OVER (PARTITION BY x, y ORDER BY {_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')}, idx) AS rn FROM s, t) SELECT x, y, CAST(idx AS BIGINT) AS d FROM e WHERE rn = 1""",
    "stencil_coverage": f"WITH {PX} SELECT round(avg(CASE WHEN {LUMA} < 128 THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM px",
    "nearest_palette": f"WITH {LAB}, {_colors(TARGETS, 't')}, e AS (SELECT i, idx, row_number() OVER (PARTITION BY i ORDER BY {_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')}, idx) AS rn FROM lab, t) SELECT i, CAST(idx AS BIGINT) AS k FROM e WHERE rn = 1",
}
WT = ", ".join(f"({i}, {w}e0)" for i, w in enumerate(WEIGHTS))


def _plates(n: int, weights: str, others: str, where: str, columns: str) -> str:
    return f"""WITH {LAB}, {_colors(TARGETS[:n], 't')}, wt(wi, w) AS (VALUES {weights}),
e AS (SELECT x, y, l, a, b_, idx, {_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')} - w AS dist FROM lab, t JOIN wt ON wi = idx), {others}
q AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY dist, idx) AS rn, min(dist) OVER (PARTITION BY x, y) AS best FROM e),
s AS (SELECT p.x, p.y, p.l, p.a, p.b_, p.idx, p.rn, p.best, p.dist, min(o.dist) AS rival FROM q p JOIN q o ON p.x = o.x AND p.y = o.y AND p.idx <> o.idx GROUP BY ALL)
SELECT x, y, {columns} CAST(CASE WHEN {where} THEN 255 ELSE trunc(least(greatest(128 - (rival - dist) * (128 / 6e0) + CASE WHEN rn = 1 THEN -0.5e0 ELSE 0.5e0 END, 0), 255)) END AS BIGINT) AS d FROM s"""


ORACLES["spot_aa_plate"] = _plates(4, WT, "", "false", "CAST(idx AS BIGINT) AS plate,")
_OTHERS = _colors((TARGETS[2], BASE[4]), "o")
ORACLES["spot_reject"] = _plates(2, "(0, 0e0), (1, 0e0)", f"{_OTHERS}, ", f"EXISTS (SELECT 1 FROM o WHERE {_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')} < best)", "") + " WHERE idx = 0"
ORACLES["manual_paint_resized"] = f"WITH {PX}, {DIM} SELECT x, y, CAST(((y * 4 // h) * 5 + x * 5 // w) * 37 % 256 AS BIGINT) AS d FROM px, dim"

# tone and filters

TOP = "greatest(r, g, b)"
_density("curve_black_plate", _curve(CURVES["black_plate"], TOP))
_density("curve_custom", _curve([(20, 40), (90, 10), (90, 60), (200, 250)], TOP))
_density("density_half", _byte(f"255 - (255 - {TOP}) * 0.5e0"))
_density("density_double", _byte(f"255 - (255 - {TOP}) * 2e0"))
_density("levels_gamma", _byte(f"255 * pow(least(greatest(({TOP} - 20) / 200e0, 0), 1), 1 / 1.8e0)"))
_density("invert_mask", f"255 - {TOP}")
_density("binarize_mask", f"CASE WHEN {TOP} < 128 THEN 0 ELSE 255 END")
MODE = "mode AS (SELECT r, g, b, count(*) AS n FROM px GROUP BY 1, 2, 3 ORDER BY n DESC, r, g, b LIMIT 1)"
ORACLES |= {
    "clamp_near_black": f"WITH {PX} SELECT i, x, y, " + ", ".join(f"CASE WHEN {TOP} < 50 THEN 0 ELSE {c} END AS {c}" for c in "rgb") + " FROM px",
    "to_black_background": f"WITH {LAB}, {MODE},{_lab('mode', 'ml')}, z AS (SELECT i, x, y, r, g, b, sqrt(pow(lab.l - q.l, 2) + pow(lab.a - q.a, 2) + pow(lab.b_ - q.b_, 2)) < 12 AS bg FROM lab, (SELECT l, a, b_ FROM ml) q) SELECT i, x, y, " + ", ".join(f"CASE WHEN bg THEN 0 ELSE {c} END AS {c}" for c in "rgb") + " FROM z",
    "desaturated": f"WITH {LAB}, flat AS (SELECT i, x, y, l, 0e0 AS a, 0e0 AS b_ FROM lab),{_to_rgb('flat')} SELECT i, x, y, r2 AS r, g2 AS g, b2 AS b FROM u3",
}

# neighbourhoods: joins over the offsets


def _disk(source: str, out: str, r: int, agg: str) -> str:
    offsets = ", ".join(f"({dx}, {dy})" for dx in range(-r, r + 1) for dy in range(-r, r + 1) if dx * dx + dy * dy <= r * r)
    return f"{out} AS (SELECT p.x, p.y, {agg}(q.d) AS d FROM {source} p, (VALUES {offsets}) o(dx, dy) JOIN {source} q ON q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2)"


W15 = [math.exp(-k * k / 4.5) for k in range(-3, 4)]
TAPS = ", ".join(f"({k - 3}, {w / sum(W15)!r}::DOUBLE)" for k, w in enumerate(W15))
ORACLES |= {
    "erode_r1": f"WITH {GRAY}, {_disk('m', 'e', 1, 'max')} SELECT x, y, d FROM e",
    "erode_r2": f"WITH {GRAY}, {_disk('m', 'e', 2, 'max')} SELECT x, y, d FROM e",
    "dilate_r2": f"WITH {GRAY}, {_disk('m', 'e', 2, 'min')} SELECT x, y, d FROM e",
    "open_r2": f"WITH {GRAY}, {_disk('m', 'e', 2, 'max')}, {_disk('e', 'f', 2, 'min')} SELECT x, y, d FROM f",
    "close_r2": f"WITH {GRAY}, {_disk('m', 'e', 2, 'min')}, {_disk('e', 'f', 2, 'max')} SELECT x, y, d FROM f",
    "gaussian_15": f"""WITH {GRAY}, {DIM}, tap(k, w_) AS (VALUES {TAPS}),
hz AS (SELECT p.x, p.y, sum(w_ * q.d) AS d FROM m p, tap, dim JOIN m q ON q.y = p.y AND q.x = least(greatest(p.x + k, 0), w - 1) GROUP BY 1, 2),
vt AS (SELECT p.x, p.y, sum(w_ * q.d) AS d FROM hz p, tap, dim JOIN hz q ON q.x = p.x AND q.y = least(greatest(p.y + k, 0), h - 1) GROUP BY 1, 2) SELECT x, y, {_byte('d')} AS d FROM vt""",
    "box_mean_2": f"WITH {GRAY} SELECT p.x, p.y, CAST(sum(q.d) // count(*) AS BIGINT) AS d FROM m p JOIN m q ON q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 GROUP BY 1, 2",
    "downsample_3": f"WITH {GRAY} SELECT x // 3 AS x, y // 3 AS y, CAST(sum(d) // count(*) AS BIGINT) AS d FROM m GROUP BY 1, 2",
    "offsets_max": f"WITH {GRAY} SELECT p.x, p.y, max(q.d) AS d FROM m p, (VALUES (0, 0), (2, 0), (0, -1)) o(dx, dy) JOIN m q ON q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1, 2",
}

# rasters

for _s in (2, 4, 8):
    _m = bayer_matrix(_s)
    _t = "[" + ", ".join(str(int((v * 256 + 128) // _m.size)) for v in _m.ravel()) + "]"
    ORACLES[f"bayer{_s}"] = f"WITH {GRAY} SELECT x, y, CAST(CASE WHEN d > {_t}[y % {_s} * {_s} + x % {_s} + 1] THEN 255 ELSE 0 END AS BIGINT) AS d FROM m"
ORACLES["blue_noise"] = f"WITH {GRAY}, t AS (SELECT [{', '.join(map(str, blue_noise_tile().ravel()))}] AS v) SELECT x, y, CAST(CASE WHEN d > v[y % 64 * 64 + x % 64 + 1] THEN 255 ELSE 0 END AS BIGINT) AS d FROM m, t"
ORACLES["white_noise"] = f"""WITH RECURSIVE {GRAY}, {DIM}, s(n, v) AS (SELECT -1::BIGINT, 2654435769::BIGINT UNION ALL
SELECT n + 1, (WITH a AS (SELECT xor(v, (v << 13) & 4294967295) AS v1), b AS (SELECT xor(v1, v1 >> 17) AS v2 FROM a) SELECT xor(v2, (v2 << 5) & 4294967295) FROM b) FROM s, dim WHERE n + 1 < w * h)
SELECT x, y, CAST(CASE WHEN d > v & 255 THEN 255 ELSE 0 END AS BIGINT) AS d FROM m JOIN s ON n = y * 100 + x"""


def _screen(p: str, mask: str, lpi: float, angle: float, dot: str = "round", shape: str = "z") -> str:
    """CTEs that end with p_out: the dots of every cell drawn forward, then averaged over 3 x 3 subpixels."""
    sin, cos = repr(math.sin(math.radians(angle))), repr(math.cos(math.radians(angle)))
    inside = {
        "round": "ux * ux + uy * uy <= rr * rr", "square": "abs(ux) <= half * sqrt(c) AND abs(uy) <= half * sqrt(c)",
        "ellipse": "pow(ux / rr, 2) + pow(uy / (0.6e0 * rr), 2) <= 1", "line": "abs(uy) <= half * c * 2 AND abs(ux) <= half",
    }[dot]
    return f"""
{p}_g AS (SELECT w, h, greatest(greatest(greatest(w, h) / 13e0, 72) / {lpi}e0, 1) AS cell FROM dim),
{p}_g2 AS (SELECT *, cell * 3 AS big, cell * 1.5e0 AS half, w * 1.5e0 AS cx, h * 1.5e0 AS cy, greatest(CAST(floor(cell * 0.5e0) AS BIGINT), 1) AS hs FROM {p}_g),
{p}_n AS (SELECT *, unnest(range(-CAST(ceil(greatest(w, h) * 3 / big) AS BIGINT) - 2, CAST(ceil(greatest(w, h) * 3 / big) AS BIGINT) + 3)) AS ci FROM {p}_g2),
{p}_cells AS (SELECT n.*, q.ci AS cj, cx + (n.ci + 0.5e0) * big * {cos} - (q.ci + 0.5e0) * big * {sin} AS sx, cy + (n.ci + 0.5e0) * big * {sin} + (q.ci + 0.5e0) * big * {cos} AS sy FROM {p}_n n, (SELECT ci FROM {p}_n) q),
{p}_cat AS (SELECT *, CAST(trunc(sx / 3) AS BIGINT) AS px0, CAST(trunc(sy / 3) AS BIGINT) AS py0 FROM {p}_cells),
{p}_mean AS (SELECT cat.ci, cat.cj, sx, sy, half, w, h, sum(m.d) // count(*) AS av FROM {p}_cat cat JOIN {mask} m ON m.x BETWEEN px0 - hs AND px0 + hs AND m.y BETWEEN py0 - hs AND py0 + hs WHERE px0 BETWEEN 0 AND w - 1 AND py0 BETWEEN 0 AND h - 1 GROUP BY ALL),
{p}_cov AS (SELECT *, 1 - av / 255e0 AS z FROM {p}_mean WHERE av < 248), {p}_dots AS (SELECT *, {shape} AS c FROM {p}_cov), {p}_d2 AS (SELECT *, half * sqrt(4 * c / pi()) AS rr FROM {p}_dots WHERE c > 0.01),
{p}_ys AS (SELECT *, unnest(range(greatest(CAST(floor(sy - half) AS BIGINT), 0), least(CAST(ceil(sy + half) AS BIGINT), h * 3 - 1) + 1)) AS py FROM {p}_d2),
{p}_xs AS (SELECT *, unnest(range(greatest(CAST(floor(sx - half) AS BIGINT), 0), least(CAST(ceil(sx + half) AS BIGINT), w * 3 - 1) + 1)) AS px_ FROM {p}_ys),
{p}_lo AS (SELECT *, (px_ + 0.5e0 - sx) * {cos} + (py + 0.5e0 - sy) * {sin} AS ux, -(px_ + 0.5e0 - sx) * {sin} + (py + 0.5e0 - sy) * {cos} AS uy FROM {p}_xs),
{p}_ink AS (SELECT px_ // 3 AS x, py // 3 AS y, count(DISTINCT (px_, py)) AS n FROM {p}_lo WHERE {inside} GROUP BY 1, 2),
{p}_out AS (SELECT m.x, m.y, CAST((9 - coalesce(n, 0)) * 255 // 9 AS BIGINT) AS d FROM {mask} m LEFT JOIN {p}_ink ink ON ink.x = m.x AND ink.y = m.y)"""


for _d, _s in (("round", "z"), ("square", "z * z * (3 - 2 * z)"), ("ellipse", "CASE WHEN z < 0.5 THEN z * 0.2e0 ELSE least(0.1e0 + (z - 0.5e0) * 1.8e0, 1) END"), ("line", "z")):
    ORACLES[f"halftone_{_d}"] = f"WITH {GRAY}, {DIM},{_screen('s', 'm', 20, 22.5, _d, _s)} SELECT x, y, d FROM s_out"

# whole jobs: coverage of every plate

SOURCE = f"{PX}, {DIM}, src AS (SELECT x, y, " + ", ".join(f"CASE WHEN {TOP} < 50 THEN 0 ELSE {c} END AS {c}" for c in "rgb") + f" FROM px),{_lab('src', 'lab')}"


def _blurred(source: str, out: str) -> str:
    """sigma 1.5, then cut at 128."""
    return f"""{out}_h AS (SELECT p.x, p.y, sum(w_ * q.d) AS d FROM {source} p, tap, dim JOIN {source} q ON q.y = p.y AND q.x = least(greatest(p.x + k, 0), w - 1) GROUP BY 1, 2),
{out}_v AS (SELECT p.x, p.y, sum(w_ * q.d) AS d FROM {out}_h p, tap, dim JOIN {out}_h q ON q.x = p.x AND q.y = least(greatest(p.y + k, 0), h - 1) GROUP BY 1, 2),
{out} AS (SELECT x, y, CASE WHEN {_byte('d')} < 128 THEN 0 ELSE 255 END AS d FROM {out}_v)"""


def _total(plates: list[tuple[int, str]]) -> str:
    return " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS layer_idx, round(avg(CASE WHEN d < 128 THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM {p}" for i, p in plates)


def _screened(plates: list[tuple[str, float, float]], first: int = 0) -> str:
    """plates: density over lab, screen frequency and angle."""
    ctes = "".join(f", l{i} AS (SELECT x, y, CAST({d} AS BIGINT) AS d FROM lab),{_screen(f'k{i}', f'l{i}', lpi, angle)}" for i, (d, lpi, angle) in enumerate(plates, first))
    return SOURCE + ctes


def _calc_density(v: str) -> str:
    return _byte(f"255 * (1 - least(greatest({v}, 0), 1))")


HIGH = _curve(CURVES["highlight_white"], "(255 - least(r, g, b))")
DARK = _curve(CURVES["black_plate"], TOP)
PROCESS = [(_curve(CURVES["cmyk_channel"], _byte(f"255 * (1 - {v})")), 65, a) for v, a in ((f"greatest({C_} - {K_}, 0)", 15), (f"greatest({M_} - {K_}, 0)", 75), (f"greatest({Y_} - {K_}, 0)", 0), (K_, 45))]
JOBS = {
    "single_halftone": [(_calc_density(f"1 - {LN}"), 45, 22.5)],
    "duotone": [(HIGH, 65, 15), (DARK, 65, 75)],
    "tritone": [(_calc_density(f"least(greatest({v}, 0), 1)"), 65, a) for v, a in ((f"({LN} - 0.7e0) * 3.3e0", 15), (f"1 - abs({LN} - 0.5e0) * 3.3e0", 75), (f"(0.3e0 - {LN}) * 3.3e0", 45))],
    "cmyk_process_light": PROCESS + [(HIGH, 65, ANGLES[4])],
}
for _n, _plates_ in JOBS.items():
    ORACLES[f"full_{_n}"] = f"WITH {_screened(_plates_)} {_total([(i, f'k{i}_out') for i in range(len(_plates_))])}"
for _n in ("black_only", "stencil"):
    ORACLES[f"full_{_n}"] = f"WITH {SOURCE}, tap(k, w_) AS (VALUES {TAPS}), l0 AS (SELECT x, y, CASE WHEN {LUMA} < 128 THEN 0 ELSE 255 END AS d FROM src), {_blurred('l0', 'k0')} {_total([(0, 'k0')])}"
_UNION = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in (1, 2, 3, 5))  # not the black plate
ORACLES["full_cmyk_process_dark"] = f"""WITH {_screened(PROCESS + [(HIGH, 65, ANGLES[5])], 1)}, tap(k, w_) AS (VALUES {TAPS}), u AS (SELECT x, y, min(d) AS d FROM ({_UNION}) GROUP BY 1, 2),
ug AS (SELECT u.x, u.y, CASE WHEN {TOP} < 50 THEN 255 ELSE u.d END AS v FROM u JOIN src ON src.x = u.x AND src.y = u.y), uc AS (SELECT x, y, {_curve(CURVES["underbase_composite"], "v")} AS d FROM ug), {_blurred('uc', 'ub')},
{_disk('ub', 'c1', 2, 'max')}, {_disk('c1', 'c2', 2, 'max')}, {_disk('c2', 'c3', 2, 'min')}, {_disk('c3', 'c4', 2, 'min')}, {_disk('c4', 'c5', 2, 'max')} {_total([(0, 'c5')] + [(i, f'k{i}_out') for i in range(1, 6)])}"""

# aggregates and palettes

DETECT = f"""{LAB}, {DIM}, hb AS (SELECT r & 240 AS r, g & 240 AS g, b & 240 AS b, count(*) AS n FROM px GROUP BY 1, 2, 3), hs AS (SELECT count(*) AS n_colors, max(n) / sum(n) AS peak FROM hb),
ch AS (SELECT sqrt(a * a + b_ * b_) AS c FROM lab, dim WHERE x % greatest(least(w, h) // 100, 1) = 0 AND y % greatest(least(w, h) // 100, 1) = 0),
rk AS (SELECT c, row_number() OVER (ORDER BY c) AS rn, count(*) OVER () AS n FROM ch), pc AS (SELECT c AS p95 FROM rk WHERE rn = CAST(floor(n * 0.95e0) AS BIGINT) + 1)"""
ORACLES |= {
    "modal_color": f"WITH {PX}, {MODE} SELECT r, g, b, n FROM mode",
    "border_mode": f"WITH {PX}, {DIM}, f AS (SELECT r, g, b FROM px WHERE y = 0 UNION ALL SELECT r, g, b FROM px, dim WHERE y = h - 1 UNION ALL SELECT r, g, b FROM px WHERE x = 0 UNION ALL SELECT r, g, b FROM px, dim WHERE x = w - 1) SELECT r, g, b, count(*) AS n FROM f GROUP BY 1, 2, 3 ORDER BY n DESC, r, g, b LIMIT 1",
    "hist_buckets": f"WITH {DETECT} SELECT n_colors, round(peak, 6) AS peak FROM hs",
    "p95_chroma": f"WITH {DETECT} SELECT round(p95, 4) AS p95 FROM pc",
    "workflow_detect": f"WITH {DETECT} SELECT CASE WHEN p95 < 8 THEN 'single_halftone' WHEN n_colors < 12 AND peak > 0.08 THEN 'spot' WHEN n_colors < 50 THEN 'cel_shaded' WHEN w * h < 200000 AND n_colors < 64 THEN 'index_bayer' ELSE 'simprocess_dark' END AS workflow FROM hs, pc, dim",
    "kmeans_step": f"WITH {LAB}, {_colors(BASE, 't')}, e AS (SELECT i, l, a, b_, idx, row_number() OVER (PARTITION BY i ORDER BY {_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')}, idx) AS rn FROM lab, t) SELECT CAST(idx AS BIGINT) AS k, count(*) AS n, round(avg(l), 4) + 0e0 AS l, round(avg(a), 4) + 0e0 AS a, round(avg(b_), 4) + 0e0 AS b FROM e WHERE rn = 1 GROUP BY 1",
    "label_means": "WITH e AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT CAST(label AS BIGINT) AS label, dim, round(avg(v), 5) AS mean FROM e GROUP BY 1, 2",
    "palette_snap": f"WITH px AS (SELECT p_partkey, p_partkey % 256 AS r, p_partkey % 256 AS g, p_partkey % 256 AS b FROM part),{_lab('px', 'lab')} SELECT p_partkey, " + ", ".join(f"CASE WHEN sqrt(a * a + b_ * b_) < 10 AND l < 15 THEN 0 WHEN sqrt(a * a + b_ * b_) < 10 AND l > 92 THEN 255 ELSE {c} END AS {c}" for c in "rgb") + " FROM lab",
    "requantized": f"WITH {LAB}, {_colors(BASE, 't')}, e AS (SELECT i, x, y, idx, row_number() OVER (PARTITION BY i ORDER BY {_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')}, idx) AS rn FROM lab, t) SELECT i, x, y, CAST(v.r AS BIGINT) AS r, CAST(v.g AS BIGINT) AS g, CAST(v.b AS BIGINT) AS b FROM e JOIN t_v v USING (idx) WHERE rn = 1",
}

# error diffusion, resampling, whole palettes and the jobs that need them

_STEP = "{'v': %s, 'c': 0e0, 'q': []::DOUBLE[], 'o': []::BIGINT[]}"
_DIFFUSED = f"""line AS MATERIALIZED (SELECT y, list(d::DOUBLE ORDER BY x) AS d FROM m GROUP BY y),
fs(y, e, o) AS (SELECT -1::BIGINT, list_transform(range(w), lambda k: 0e0), []::BIGINT[] FROM dim
UNION ALL SELECT y, CASE WHEN y % 2 = 0 THEN r.q ELSE list_reverse(r.q) END, CASE WHEN y % 2 = 0 THEN r.o ELSE list_reverse(r.o) END FROM (
  SELECT y, list_reduce(CASE WHEN y % 2 = 0 THEN s ELSE list_reverse(s) END,
    lambda a, p: {{'v': p.v, 'c': (p.v + a.c - CASE WHEN p.v + a.c < 128 THEN 0e0 ELSE 255e0 END) * 7 / 16, 'q': list_append(a.q, p.v + a.c - CASE WHEN p.v + a.c < 128 THEN 0e0 ELSE 255e0 END), 'o': list_append(a.o, CASE WHEN p.v + a.c < 128 THEN 0 ELSE 255 END)}}, {_STEP % '0e0'}) AS r FROM (
    SELECT line.y, list_transform(range(1, len(line.d) + 1), lambda k: {_STEP % "line.d[k] + CASE WHEN k - step BETWEEN 1 AND len(e) THEN e[k - step] / 16 ELSE 0 END + e[k] * 5 / 16 + CASE WHEN k + step BETWEEN 1 AND len(e) THEN e[k + step] * 3 / 16 ELSE 0 END"}) AS s
    FROM (SELECT *, CASE WHEN (fs.y) % 2 = 0 THEN 1 ELSE -1 END AS step FROM fs) fs JOIN line ON line.y = fs.y + 1)))"""


def _index_fs(lab: str, targets: str) -> str:
    """idx of every pixel of `lab` diffused over the colours of `targets` (idx, tl, ta, tb)"""
    zero = "{'l': 0e0, 'a': 0e0, 'b': 0e0}"
    blank = f"{{'v': %s, 'c': {zero}, 'q': []::STRUCT(l DOUBLE, a DOUBLE, b DOUBLE)[], 'o': []::BIGINT[]}}"
    dist = "list_transform(ts, lambda t: pow((v.l - t.l) / 2e0, 2) + pow((sqrt(v.a * v.a + v.b * v.b) - t.c) / (1 + 0.048e0 * t.c), 2) + greatest(pow(v.a - t.a, 2) + pow(v.b - t.b, 2) - pow(sqrt(v.a * v.a + v.b * v.b) - t.c, 2), 0) / pow(1 + 0.014e0 * t.c, 2))"
    part = lambda c: f"line.p[k].{c} + CASE WHEN k - step BETWEEN 1 AND len(e) THEN e[k - step].{c} / 16 ELSE 0 END + e[k].{c} * 5 / 16 + CASE WHEN k + step BETWEEN 1 AND len(e) THEN e[k + step].{c} * 3 / 16 ELSE 0 END"
    return f"""ts AS MATERIALIZED (SELECT list({{'l': tl, 'a': ta, 'b': tb, 'c': sqrt(ta * ta + tb * tb)}} ORDER BY idx) AS ts FROM {targets}),
line AS MATERIALIZED (SELECT y, list({{'l': l, 'a': a, 'b': b_}} ORDER BY x) AS p FROM {lab} GROUP BY y),
fs(y, e, o) AS (SELECT -1::BIGINT, list_transform(range(w), lambda k: {zero}), []::BIGINT[] FROM dim
UNION ALL SELECT y, CASE WHEN y % 2 = 0 THEN r.q ELSE list_reverse(r.q) END, CASE WHEN y % 2 = 0 THEN r.o ELSE list_reverse(r.o) END FROM (
  SELECT y, list_reduce(CASE WHEN y % 2 = 0 THEN s ELSE list_reverse(s) END, lambda z, p:
    list_transform([{{'l': p.v.l + z.c.l, 'a': p.v.a + z.c.a, 'b': p.v.b + z.c.b}}], lambda v:
    list_transform([list_position({dist}, list_min({dist}))], lambda k:
    list_transform([{{'l': v.l - ts[k].l, 'a': v.a - ts[k].a, 'b': v.b - ts[k].b}}], lambda q:
    {{'v': p.v, 'c': {{'l': q.l * 7 / 16, 'a': q.a * 7 / 16, 'b': q.b * 7 / 16}}, 'q': list_append(z.q, q), 'o': list_append(z.o, (k - 1)::BIGINT)}})[1])[1])[1], {blank % zero}) AS r FROM (
    SELECT line.y, ts, list_transform(range(1, len(line.p) + 1), lambda k: {blank % ("{'l': " + part('l') + ", 'a': " + part('a') + ", 'b': " + part('b') + "}")}) AS s
    FROM (SELECT *, CASE WHEN fs.y % 2 = 0 THEN 1 ELSE -1 END AS step FROM fs) fs JOIN line ON line.y = fs.y + 1, ts)))"""


ORACLES["floyd_steinberg"] = f"WITH RECURSIVE {GRAY}, {DIM}, {_DIFFUSED} SELECT unnest(range(len(o))) AS x, y, unnest(o) AS d FROM fs WHERE y >= 0"
ORACLES["index_floyd_steinberg"] = f"WITH RECURSIVE {LAB}, {DIM}, {_colors(TARGETS, 't')}, {_index_fs('lab', 't')} SELECT unnest(range(len(o))) AS x, y, unnest(o) AS idx FROM fs WHERE y >= 0"


def _lanczos_taps(out: str, a: str, b: str) -> str:
    return f"""{out}_s AS (SELECT n, k, (k + 0.5e0 - (n + 0.5e0) * ({a} / CAST({b} AS DOUBLE))) / greatest({a} / CAST({b} AS DOUBLE), 1) AS t FROM dim, range(100000) n_(n), range(100000) k_(k)
  WHERE n < {b} AND k < {a} AND abs((k + 0.5e0 - (n + 0.5e0) * ({a} / CAST({b} AS DOUBLE))) / greatest({a} / CAST({b} AS DOUBLE), 1)) < 3),
{out}_w AS (SELECT n, k, CASE WHEN t = 0 THEN 1e0 ELSE 3 * sin(pi() * t) * sin(pi() * t / 3) / pow(pi() * t, 2) END AS v FROM {out}_s), {out} AS (SELECT n, k, v / sum(v) OVER (PARTITION BY n) AS v FROM {out}_w)"""


ORACLES["lanczos_resize"] = f"""WITH {GRAY}, {DIM}, {_lanczos_taps('tx', 'w', '(w // 2)')}, {_lanczos_taps('ty', 'h', '(h // 3)')},
hz AS (SELECT n AS x, y, sum(d * v) AS d FROM m JOIN tx ON k = x GROUP BY 1, 2) SELECT x, n AS y, {_byte('sum(d * v)')} AS d FROM hz JOIN ty ON k = y GROUP BY 1, 2"""


def _palette(source: str, colors: int, least: float, out="pal") -> str:
    """The palette of a pixel relation (x, y, r, g, b, l, a, b_, i): idx, r, g, b, coverage by descending coverage."""
    boxes = max(2 * colors, 4)
    near = lambda l, a, b: f"(floor({_de94(l, a, b, 'c.l', 'c.a', 'c.b_')} * 1e9 + 0.5e0), c.k)"
    return f"""
{out}_s AS MATERIALIZED (SELECT i, round(l, 9) + 0e0 AS l, round(a, 9) + 0e0 AS a, round(b_, 9) + 0e0 AS b_ FROM {source}, (SELECT greatest((count(*) + 79999) // 80000, 1) AS stride FROM {source}) WHERE i % stride = 0),
{out}_mc(step, i, l, a, b_, box, r) AS (SELECT 0, i, l, a, b_, 0, i FROM {out}_s UNION ALL
SELECT step + 1, i, l, a, b_, CASE WHEN box <> pick THEN box WHEN rn <= n // 2 THEN 2 * step + 2 ELSE 2 * step + 3 END, CASE WHEN box = pick THEN rn ELSE r END FROM (
  SELECT *, first_value(box) OVER (ORDER BY wide DESC, box DESC) AS pick, max(wide) OVER () AS widest, row_number() OVER (PARTITION BY box ORDER BY CASE WHEN ra >= rl AND ra >= rb THEN a WHEN rb >= rl THEN b_ ELSE l END, r) AS rn FROM (
    SELECT *, greatest(rl, ra, rb) AS wide FROM (
      SELECT *, count(*) OVER q AS n, round((max(l) OVER q - min(l) OVER q) * 0.5e0, 9) AS rl, round(max(a) OVER q - min(a) OVER q, 9) AS ra, round(max(b_) OVER q - min(b_) OVER q, 9) AS rb FROM {out}_mc WINDOW q AS (PARTITION BY box)))) WHERE step < {boxes - 1} AND widest >= 1),
{out}_seed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY box) - 1 AS k, l, a, b_ FROM (SELECT box, avg(l) AS l, avg(a) AS a, avg(b_) AS b_ FROM {out}_mc WHERE step = (SELECT max(step) FROM {out}_mc) GROUP BY box)),
{out}_km(step, moved, cs) AS (SELECT 0, 1e9, list({{'k': k, 'l': l, 'a': a, 'b_': b_}} ORDER BY k) FROM {out}_seed UNION ALL
SELECT any_value(step) + 1, sum(d), list({{'k': k, 'l': nl, 'a': na, 'b_': nb}} ORDER BY k) FROM (
  SELECT step, o.k, coalesce(ml, o.l) AS nl, coalesce(ma, o.a) AS na, coalesce(mb, o.b_) AS nb, {_de94('o.l', 'o.a', 'o.b_', 'coalesce(ml, o.l)', 'coalesce(ma, o.a)', 'coalesce(mb, o.b_)')} AS d FROM (
    SELECT step, o, ml, ma, mb FROM (SELECT step, unnest(cs) AS o FROM {out}_km WHERE step < 15 AND moved >= 0.5) LEFT JOIN (
      SELECT k, avg(l) AS ml, avg(a) AS ma, avg(b_) AS mb FROM (SELECT p.l, p.a, p.b_, arg_min(c.k, {near('p.l', 'p.a', 'p.b_')}) AS k FROM {out}_s p, (SELECT unnest(cs) AS c FROM {out}_km) GROUP BY p.i, p.l, p.a, p.b_) GROUP BY k) ON o.k = k)) HAVING count(*) > 0),
{out}_c AS MATERIALIZED (SELECT o.k AS k, o.l AS l, o.a AS a, o.b_ AS b_ FROM (SELECT unnest(cs) AS o FROM {out}_km WHERE step = (SELECT max(step) FROM {out}_km))),
{out}_n AS (SELECT k, count(*) AS n FROM (SELECT arg_min(c.k, {near('p.l', 'p.a', 'p.b_')}) AS k FROM {source} p, {out}_c c GROUP BY p.i) GROUP BY k),
{out}_m AS (SELECT k, l, a, b_, n / (sum(n) OVER ())::DOUBLE AS coverage FROM {out}_c JOIN {out}_n USING (k)),{_to_rgb(out + '_m').replace('u1', out + '_u1').replace('u2', out + '_u2').replace('u3', out + '_u3')},
{out} AS (SELECT row_number() OVER (ORDER BY coverage DESC, k) - 1 AS idx, r2 AS r, g2 AS g, b2 AS b, coverage FROM {out}_u3 WHERE coverage >= {least} QUALIFY row_number() OVER (ORDER BY coverage DESC, k) <= {colors})"""


ORACLES["palette_full"] = f"WITH RECURSIVE {LAB}, {_palette('lab', 8, 0.002)} SELECT idx, r, g, b, round(coverage, 4) AS coverage FROM pal"


def _snapped(pal: str, out: str) -> str:
    """pal with nearly black and nearly white entries pure."""
    pure = lambda c: f"CASE WHEN sqrt(a * a + b_ * b_) < 10 AND l < 15 THEN 0 WHEN sqrt(a * a + b_ * b_) < 10 AND l > 92 THEN 255 ELSE {c} END AS {c}"
    return f"{_lab(pal, out + '_l').lstrip()}, {out} AS (SELECT idx, {', '.join(map(pure, 'rgb'))} FROM {out}_l)"


def _inks(rows: str, out: str) -> str:
    """idx, tl, ta, tb of a relation idx, r, g, b"""
    return f"{_lab(rows, out + '_k').lstrip()}, {out} AS (SELECT idx, r, g, b, l AS tl, a AS ta, b_ AS tb FROM {out}_k)"


def _blurred_plates(source: str, out: str, sigma: float) -> str:
    """Plates (k, x, y, d) blurred, then cut at 128."""
    r = math.ceil(2 * sigma)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    taps = ", ".join(f"({k - r}, {v / sum(w)!r}::DOUBLE)" for k, v in enumerate(w))
    return f"""{out}_t(o, w_) AS (VALUES {taps}),
{out}_h AS (SELECT p.k, p.x, p.y, sum(w_ * q.d) AS d FROM {source} p, {out}_t, dim JOIN {source} q ON q.k = p.k AND q.y = p.y AND q.x = least(greatest(p.x + o, 0), w - 1) GROUP BY ALL),
{out}_v AS (SELECT p.k, p.x, p.y, sum(w_ * q.d) AS d FROM {out}_h p, {out}_t, dim JOIN {out}_h q ON q.k = p.k AND q.x = p.x AND q.y = least(greatest(p.y + o, 0), h - 1) GROUP BY ALL),
{out} AS (SELECT k, x, y, CASE WHEN {_byte('d')} < 128 THEN 0 ELSE 255 END AS d FROM {out}_v)"""


def _covered(plates: str) -> str:
    return f"SELECT CAST(k AS BIGINT) AS layer_idx, round(avg(CASE WHEN d < 128 THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM {plates} GROUP BY k"


def _index_job(assigned: str) -> str:
    return f"WITH RECURSIVE {SOURCE},{_lab('px', 'plab')}, {_palette('plab', 16, 0.002)}, {_snapped('pal', 'sn')}, {_inks('sn', 't')}, {assigned}, plates AS MATERIALIZED (SELECT t.idx AS k, x, y, CASE WHEN given.idx = t.idx THEN 0 ELSE 255 END AS d FROM given, t), {_blurred_plates('plates', 'cut', 1.5)} {_covered('cut')}"


ORACLES["full_index_bayer"] = _index_job(f"sh AS (SELECT x, y, l + ({B8_LIST}[y % 8 * 8 + x % 8 + 1] - 31.5e0) / 31.5e0 * 8 AS l, a, b_ FROM lab), given AS (SELECT x, y, arg_min(idx, ({_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')}, idx)) AS idx FROM sh, t GROUP BY x, y)")
ORACLES["full_index_fs"] = _index_job(f"{_index_fs('lab', 't')}, given AS MATERIALIZED (SELECT unnest(range(len(o))) AS x, y, unnest(o) AS idx FROM fs WHERE y >= 0)")


def _spot_job(colors: int, least: float) -> str:
    return f"""WITH RECURSIVE {SOURCE},{_lab('px', 'plab')}, {_palette('plab', colors, least)}, {_snapped('pal', 'sn')}, {_lab('sn', 'so').lstrip()},
pr AS (SELECT row_number() OVER (ORDER BY CASE WHEN r = 255 AND g = 255 AND b = 255 THEN -1 WHEN r = 0 AND g = 0 AND b = 0 THEN 1000 ELSE 100 - l END, idx) - 1 AS idx, r, g, b FROM so), {_inks('pr', 't')},
e AS MATERIALIZED (SELECT x, y, idx, {_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')} AS dist FROM lab, t),
q AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY dist, idx) AS rn, min(dist) OVER (PARTITION BY x, y ORDER BY dist, idx ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS after, min(dist) OVER (PARTITION BY x, y) AS best FROM e),
s AS (SELECT x, y, idx, CAST(trunc(least(greatest(128 - (CASE WHEN rn = 1 THEN after ELSE best END - dist) * (128 / 6e0) + CASE WHEN rn = 1 THEN -0.5e0 ELSE 0.5e0 END, 0), 255)) AS BIGINT) AS d FROM q),
own AS (SELECT p.idx AS k, min(o.idx) AS idx FROM t p JOIN t o ON o.r = p.r AND o.g = p.g AND o.b = p.b GROUP BY 1), plates AS MATERIALIZED (SELECT k, x, y, d FROM own JOIN s USING (idx)), {_blurred_plates('plates', 'cut', 3.5)} {_covered('cut')}"""


ORACLES["full_spot"] = _spot_job(16, 0.002)
ORACLES["full_cel_shaded"] = _spot_job(14, 0.0015)

_TURNS = ", ".join(f"({k}, {math.sin(math.radians(v))!r}::DOUBLE, {math.cos(math.radians(v))!r}::DOUBLE)" for k, v in enumerate(ANGLES))


def _screens(mask: str, out: str, lpi: float) -> str:
    """Round dots of plates (k, x, y, d), each at the angle of its place in print; as _screen, for any number of plates."""
    return f"""{out}_a(ai, sn_, cs_) AS (VALUES {_TURNS}), {out}_p AS (SELECT DISTINCT k, sn_, cs_ FROM {mask} JOIN {out}_a ON ai = k % {len(ANGLES)}),
{out}_g AS (SELECT w, h, greatest(greatest(greatest(w, h) / 13e0, 72) / {lpi}e0, 1) AS cell FROM dim),
{out}_g2 AS (SELECT *, cell * 3 AS big, cell * 1.5e0 AS half, w * 1.5e0 AS cx, h * 1.5e0 AS cy, greatest(CAST(floor(cell * 0.5e0) AS BIGINT), 1) AS hs FROM {out}_g),
{out}_n AS (SELECT *, unnest(range(-CAST(ceil(greatest(w, h) * 3 / big) AS BIGINT) - 2, CAST(ceil(greatest(w, h) * 3 / big) AS BIGINT) + 3)) AS ci FROM {out}_g2),
{out}_cells AS (SELECT k, sn_, cs_, n.*, q.ci AS cj, cx + (n.ci + 0.5e0) * big * cs_ - (q.ci + 0.5e0) * big * sn_ AS sx, cy + (n.ci + 0.5e0) * big * sn_ + (q.ci + 0.5e0) * big * cs_ AS sy FROM {out}_p, {out}_n n, (SELECT ci FROM {out}_n) q),
{out}_cat AS (SELECT *, CAST(trunc(sx / 3) AS BIGINT) AS px0, CAST(trunc(sy / 3) AS BIGINT) AS py0 FROM {out}_cells),
{out}_box AS (SELECT p.k, p.x, p.y, sum(q.d) // count(*) AS av FROM {out}_g2, {mask} p JOIN {mask} q ON q.k = p.k AND q.x BETWEEN p.x - hs AND p.x + hs AND q.y BETWEEN p.y - hs AND p.y + hs GROUP BY ALL),
{out}_d2 AS (SELECT cat.*, 1 - av / 255e0 AS c, half * sqrt(4 * (1 - av / 255e0) / pi()) AS rr FROM {out}_cat cat JOIN {out}_box b ON b.k = cat.k AND b.x = px0 AND b.y = py0 WHERE av < 248 AND 1 - av / 255e0 > 0.01),
{out}_ys AS (SELECT *, unnest(range(greatest(CAST(floor(sy - half) AS BIGINT), 0), least(CAST(ceil(sy + half) AS BIGINT), h * 3 - 1) + 1)) AS py FROM {out}_d2),
{out}_xs AS (SELECT *, unnest(range(greatest(CAST(floor(sx - half) AS BIGINT), 0), least(CAST(ceil(sx + half) AS BIGINT), w * 3 - 1) + 1)) AS px_ FROM {out}_ys),
{out}_lo AS (SELECT *, (px_ + 0.5e0 - sx) * cs_ + (py + 0.5e0 - sy) * sn_ AS ux, -(px_ + 0.5e0 - sx) * sn_ + (py + 0.5e0 - sy) * cs_ AS uy FROM {out}_xs),
{out}_ink AS (SELECT k, px_ // 3 AS x, py // 3 AS y, count(DISTINCT (px_, py)) AS n FROM {out}_lo WHERE ux * ux + uy * uy <= rr * rr GROUP BY 1, 2, 3),
{out} AS (SELECT m.k, m.x, m.y, CAST((9 - coalesce(n, 0)) * 255 // 9 AS BIGINT) AS d FROM {mask} m LEFT JOIN {out}_ink ink ON ink.k = m.k AND ink.x = m.x AND ink.y = m.y)"""


def _sim_job(dark: bool) -> str:
    first = int(dark)
    head = f"""WITH RECURSIVE {SOURCE},{_lab('px', 'plab')}, {_palette('plab', 16, 0.003)}, {_inks('pal', 'pk')},
t AS (SELECT row_number() OVER (ORDER BY tl DESC, idx) - 1 + {first} AS k, r, g, b, tl, ta, tb FROM pk WHERE sqrt(ta * ta + tb * tb) > 8), nt AS (SELECT count(*) + {first} AS n FROM t),
far AS (SELECT k, x, y, least(greatest({_de94('l', 'a', 'b_', 'tl', 'ta', 'tb')} / 40, 0), 1) AS f FROM lab, t), ranged AS (SELECT k, x, y, {_byte('255 * (f * f * (3 - 2 * f))')} AS d FROM far),
plates AS MATERIALIZED (SELECT k, x, y, {_curve(CURVES['sim_process'], 'd')} AS d FROM ranged UNION ALL SELECT n, x, y, {DARK} FROM src, nt UNION ALL SELECT n + 1, x, y, {HIGH} FROM src, nt), {_screens('plates', 'dots', 65)}"""
    if not dark:
        return f"{head} {_covered('dots')}"
    return f"""{head}, tap(k, w_) AS (VALUES {TAPS}),
u AS (SELECT x, y, min(d) AS d FROM plates, nt WHERE k <> n AND k NOT IN (SELECT k FROM t WHERE r < 30 AND g < 30 AND b < 30) GROUP BY 1, 2),
ug AS (SELECT u.x, u.y, CASE WHEN {TOP} < 50 THEN 255 ELSE u.d END AS v FROM u JOIN src ON src.x = u.x AND src.y = u.y), uc AS (SELECT x, y, {_curve(CURVES["underbase_composite"], "v")} AS d FROM ug), {_blurred('uc', 'ub')},
{_disk('ub', 'c1', 2, 'max')}, {_disk('c1', 'c2', 2, 'max')}, {_disk('c2', 'c3', 2, 'min')}, {_disk('c3', 'c4', 2, 'min')}, {_disk('c4', 'c5', 2, 'max')} {_covered('dots')} UNION ALL {_covered('(SELECT 0 AS k, d FROM c5)')}"""


ORACLES["full_simprocess_light"] = _sim_job(False)
ORACLES["full_simprocess_dark"] = _sim_job(True)

# layers

LAYER = "layer(layer_idx, kind, r, g, b, visible, print_index) AS (VALUES " + ", ".join(f"({i}, '{k}', {c[0]}, {c[1]}, {c[2]}, {str(v).lower()}, {p})" for i, k, c, v, p in LAYERS) + ")"
MASKS = f"{PX}, {LAYER}, masks AS (SELECT layer_idx, x, y, least(3 * greatest(abs(px.r - layer.r), abs(px.g - layer.g), abs(px.b - layer.b)), 255) AS d FROM px, layer)"
STEP = lambda c: f"round(s.{c} * (1 - (1 - d / 255e0)) + k.{c} * (1 - d / 255e0))"
ORACLES |= {
    "layer_coverage": f"WITH {MASKS} SELECT CAST(layer_idx AS BIGINT) AS layer_idx, round(avg(CASE WHEN d < 128 THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM masks GROUP BY 1",
    "union_min": f"WITH {MASKS} SELECT x, y, min(d) AS d FROM masks GROUP BY 1, 2",
    "composite_union": f"WITH {MASKS}, u AS (SELECT x, y, min(d) AS d FROM masks JOIN layer USING (layer_idx) WHERE kind <> 'underbase' AND NOT (r < 30 AND g < 30 AND b < 30) AND layer_idx <> 0 GROUP BY 1, 2) SELECT px.x, px.y, CASE WHEN greatest(r, g, b) < 50 THEN 255 ELSE d END AS d FROM px JOIN u ON u.x = px.x AND u.y = px.y",
    "shadow_merge": f"""WITH {MASKS},{_lab('layer', 'll')}, sel AS (SELECT layer_idx, l, row_number() OVER (ORDER BY l DESC, layer_idx) AS rk, max(l) OVER () AS kl FROM ll WHERE layer_idx IN (1, 2, 4)),
sh AS (SELECT layer_idx, rk, 255 - {_byte('255 * least(greatest((kl - l) / greatest(kl, 1), 0), 1)')} AS shadow FROM sel), own AS (SELECT x, y, min(rk) FILTER (d < 128) AS rk FROM masks JOIN sh USING (layer_idx) GROUP BY 1, 2)
SELECT x, y, CAST(CASE WHEN own.rk IS NULL THEN 255 ELSE 0 END AS BIGINT) AS union_d, coalesce(shadow, 255) AS shadow_d FROM own LEFT JOIN sh USING (rk)""",
    "composite": f"""WITH RECURSIVE {MASKS}, st AS (SELECT x, y, d, r, g, b, row_number() OVER (PARTITION BY x, y ORDER BY print_index, layer_idx) AS n FROM masks JOIN layer USING (layer_idx) WHERE visible AND layer_idx <> 2 AND (x >= 10 OR y >= 10)),
s(x, y, n, r, g, b) AS (SELECT x, y, 0::BIGINT, 24e0, 24e0, 28e0 FROM px UNION ALL SELECT s.x, s.y, k.n, {STEP('r')}, {STEP('g')}, {STEP('b')} FROM s JOIN st k ON k.x = s.x AND k.y = s.y AND k.n = s.n + 1)
SELECT x, y, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b FROM s QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY n DESC) = 1""",
    "single_over_shirt": f"WITH {GRAY} SELECT x, y, " + ", ".join(f"{_byte(f'{s} * (d / 255e0) + {i} * (1 - d / 255e0)')} AS {c}" for c, s, i in zip("rgb", (24, 24, 28), (250, 60, 10))) + " FROM m",
    "knockout": f"WITH {GRAY} SELECT x, y, CASE WHEN x < 4 THEN 255 ELSE d END AS d FROM m",
    "reindex": f"WITH {LAYER} SELECT CAST(layer_idx AS BIGINT) AS layer_idx, row_number() OVER (ORDER BY layer_idx) - 1 AS print_index FROM layer WHERE layer_idx <> 3",
    "visible_layers": f"WITH {LAYER} SELECT CAST(layer_idx AS BIGINT) AS layer_idx, CAST(print_index AS BIGINT) AS print_index FROM layer WHERE visible AND layer_idx <> 2",
    "weight_propagation": "WITH e AS (SELECT (user_id % 8) % 3 AS pos, arg_max(value, event_id) AS w FROM events GROUP BY 1) SELECT CAST(l AS BIGINT) AS layer_idx, CAST(p AS BIGINT) AS pos, coalesce(w, 0e0) AS weight FROM range(3) a(l), range(4) b(p) LEFT JOIN e ON e.pos = p",
    "nearest_resize": f"WITH {GRAY}, {DIM}, n AS (SELECT nx, ny, nx * w // (w * 3 // 2) AS x, ny * h // (h // 2) AS y FROM dim, range(150) a(nx), range(100000) c(ny) WHERE ny < h // 2) SELECT nx AS x, ny AS y, d FROM n JOIN m USING (x, y)",
    "brush_dabs": f"WITH {GRAY}, {DIM}, db AS (SELECT event_id AS seq, event_id * 7 % 100 AS cx, event_id % h AS cy, event_id % 2 = 0 AS ink FROM events, dim), hit AS (SELECT cx + dx AS x, cy + dy AS y, arg_max(CASE WHEN ink THEN 0 ELSE 255 END, seq) AS v FROM db, range(-5, 6) a(dx), range(-5, 6) b(dy) WHERE dx * dx + dy * dy <= 25 GROUP BY 1, 2) SELECT x, y, CAST(coalesce(v, d) AS BIGINT) AS d FROM m LEFT JOIN hit USING (x, y)",
    "flood_fill": f"""WITH RECURSIVE {PX},{_lab('px', 'cl')}, e AS (SELECT max(y) AS hy FROM px),
f AS (SELECT r, g, b FROM px WHERE y = 0 UNION ALL SELECT r, g, b FROM px, e WHERE y = hy UNION ALL SELECT r, g, b FROM px WHERE x = 0 UNION ALL SELECT r, g, b FROM px WHERE x = 99),
md AS (SELECT r, g, b FROM f GROUP BY 1, 2, 3 ORDER BY count(*) DESC, r, g, b LIMIT 1),{_lab('md', 'mdl')},
near AS (SELECT x, y FROM cl, (SELECT l AS ml, a AS ma, b_ AS mb FROM mdl) q WHERE sqrt(pow(l - ml, 2) + pow(a - ma, 2) + pow(b_ - mb, 2)) < 12),
bg(x, y) AS (SELECT near.x, near.y FROM near, e WHERE x = 0 OR x = 99 OR y = 0 OR y = hy UNION SELECT near.x, near.y FROM (SELECT x + dx AS x, y + dy AS y FROM bg, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy)) n JOIN near ON near.x = n.x AND near.y = n.y)
SELECT px.x, px.y, bg.x IS NULL AS is_fg FROM px LEFT JOIN bg ON bg.x = px.x AND bg.y = px.y""",
    "edit_stream_latest": "SELECT event_id // 1000 AS generation, user_id % 8 AS layer_idx, arg_max(value, event_id) AS param, max(event_id) AS seq, count(*) AS edits FROM events GROUP BY 1, 2",
    "edit_stream_current": "SELECT event_id // 1000 AS generation, user_id % 8 AS layer_idx, arg_max(value, event_id) AS param, max(event_id) AS seq, count(*) AS edits FROM events WHERE event_id // 1000 = (SELECT max(event_id // 1000) FROM events) GROUP BY 1, 2",
}
T8 = "[" + ", ".join(str(int((v * 256 + 128) // 64)) for v in B8.ravel()) + "]"
ORACLES["black_plate_blocks"] = f"WITH {PX}, t AS (SELECT x, y, {_curve(CURVES['black_plate'], TOP)} AS d FROM px) SELECT x // 80 AS bx, y // 80 AS by, round(avg(CASE WHEN d > {T8}[y % 8 * 8 + x % 8 + 1] THEN 0e0 ELSE 1e0 END), 6) AS coverage FROM t GROUP BY 1, 2"

# masks, furniture and names

_BG = "(x + y) % 11 <> 0 AND x < 30"
_ALPHA = "(x * 5 + y * 3) % 256 >= 128"
ORACLES |= {
    "mask_source": f"WITH {PX} SELECT i, x, y, " + ", ".join(f"CASE WHEN {_BG} THEN {v} ELSE {c} END AS {c}" for c, v in zip("rgb", (9, 8, 7))) + " FROM px",
    "alpha_mask": f"WITH {PX} SELECT x, y, {_ALPHA} AS is_fg FROM px",
    "foreground_choice": ORACLES["flood_fill"].replace("SELECT px.x, px.y, bg.x IS NULL AS is_fg FROM px", "SELECT 'fill' AS choice, bg.x IS NULL AS is_fg, count(*) AS n, CAST(sum(px.x * 7 + px.y) AS BIGINT) AS sum FROM px") + f" GROUP BY 1, 2 UNION ALL SELECT 'alpha', {_ALPHA}, count(*), CAST(sum(x * 7 + y) AS BIGINT) FROM px GROUP BY 1, 2",
    "safety_knockout": f"WITH {PX} SELECT x, y, CAST(CASE WHEN x < 50 THEN 255 WHEN CASE WHEN {LUMA} < 128 THEN 0 ELSE 255 END > {T8}[y % 8 * 8 + x % 8 + 1] THEN 255 ELSE 0 END AS BIGINT) AS d FROM px",
    "film_border": f"""WITH {GRAY}, {DIM}, sheet AS (SELECT x, y FROM dim, range(1000) a(x), range(100000) b(y) WHERE x < w + 6 AND y < h + 11)
SELECT s.x, s.y, CAST(CASE WHEN (s.x IN (3, w + 2) AND s.y BETWEEN 3 AND h + 2) OR (s.y IN (3, h + 2) AND s.x BETWEEN 3 AND w + 2) THEN 0 ELSE coalesce(d, 255) END AS BIGINT) AS d FROM sheet s, dim LEFT JOIN m ON m.x = s.x - 3 AND m.y = s.y - 3""",
    "blank_paint": f"WITH {PX} SELECT CAST(l AS BIGINT) AS layer_idx, x, y, 255::BIGINT AS d FROM px, range(2) r(l)",
    "same_ink": f"WITH {LAYER}, pick(choice, l) AS (VALUES (0, [1, 5]), (1, [1, 2]), (2, [1]), (3, [1, 2, 5]), (4, [0, 1, 2, 3, 4, 5])) SELECT CAST(choice AS BIGINT) AS choice, count(DISTINCT (r, g, b)) = 1 AND count(*) >= 2 AS same FROM pick JOIN layer ON list_contains(l, layer_idx) GROUP BY choice",
}
_CROSS = " OR ".join(f"(x - {cx} BETWEEN -1 AND 0 AND abs(y - {cy}) <= 7) OR (y - {cy} BETWEEN -1 AND 0 AND abs(x - {cx}) <= 7) OR pow(x - {cx}, 2) + pow(y - {cy}, 2) <= 9" for cx in ("12", "(w - 13)") for cy in ("12", "(h - 13)"))
ORACLES["registration_marks"] = f"WITH {GRAY}, {DIM} SELECT x, y, CASE WHEN {_CROSS} THEN 0 ELSE d END AS d FROM m, dim"
_SHOWN = ("solid", "halftone", "FM", "Bayer", "noise", "blue noise")
ORACLES["captions"] = f"""WITH {LAYER}, made AS (SELECT *, kind || ' & ' || layer_idx || '/' || r AS name, [{", ".join(f"'{m}'" for m in _SHOWN)}][layer_idx + 1] AS mode FROM layer)
SELECT CAST(layer_idx AS BIGINT) AS layer_idx, printf('%02d  %s  #%02X%02X%02X  %s', layer_idx + 1, name, r, g, b, mode) || CASE WHEN layer_idx = 1 THEN '  41lpi' ELSE '' END AS caption,
printf('%02d_%s_%02x%02x%02x.png', print_index, regexp_replace(name, '[^A-Za-z0-9_-]', '_', 'g'), r, g, b) AS film FROM made"""
ORACLES["print_order"] = f"""WITH RECURSIVE {LAB}, {_palette('lab', 16, 0.002)}, {_snapped('pal', 'sn')}, {_lab('sn', 'so').lstrip()}
SELECT row_number() OVER (ORDER BY CASE WHEN so.r = 255 AND so.g = 255 AND so.b = 255 THEN -1 WHEN so.r = 0 AND so.g = 0 AND so.b = 0 THEN 1000 ELSE 100 - l END, idx) - 1 AS idx, so.r, so.g, so.b, round(coverage, 4) AS coverage FROM so JOIN pal USING (idx)"""
# entries join the first group with a member like them: one entry a step
ORACLES["hue_groups"] = f"""WITH RECURSIVE {LAB}, {_palette('lab', 16, 0.002)}, {_lab('pal', 'pl').lstrip()},
hue AS MATERIALIZED (SELECT idx, r, g, b, coverage, l, {HUE} AS h, sqrt(a * a + b_ * b_) < 6 AS gray FROM pl),
near AS MATERIALIZED (SELECT p.idx AS i, q.idx AS j FROM hue p JOIN hue q ON q.idx < p.idx AND CASE WHEN p.gray OR q.gray THEN p.gray AND q.gray AND abs(p.l - q.l) < 10 ELSE least(abs(p.h - q.h), 360 - abs(p.h - q.h)) < 10 END),
walk(i, home) AS (SELECT -1::BIGINT, MAP {{}}::MAP(BIGINT, BIGINT) UNION ALL
SELECT i + 1, map_concat(home, MAP {{i + 1: coalesce((SELECT min(home[j]) FROM near WHERE near.i = walk.i + 1), i + 1)}}) FROM walk WHERE i + 1 < (SELECT count(*) FROM hue)),
own AS (SELECT unnest(map_keys(home)) AS idx, unnest(map_values(home)) AS home FROM walk WHERE i = (SELECT max(i) FROM walk)),
out AS (SELECT home, sum(coverage) AS coverage, {", ".join(f"CAST(floor(sum({c} * coverage) / greatest(sum(coverage), 1e-6) + 0.5e0) AS BIGINT) AS {c}" for c in "rgb")} FROM (SELECT home, hue.* FROM own JOIN hue USING (idx)) GROUP BY home)
SELECT row_number() OVER (ORDER BY coverage DESC, home) - 1 AS idx, r, g, b, round(coverage, 4) AS coverage FROM out"""
# three cells a row of 60 with a strip of 24, 7 apart; layers 3 (not exported) and 5 (hidden) have none
ORACLES["contact_sheet"] = f"""WITH {MASKS}, {DIM}, fit AS (SELECT *, greatest(1, CAST(trunc(w * least(60e0 / w, 60e0 / h)) AS BIGINT)) AS fw, greatest(1, CAST(trunc(h * least(60e0 / w, 60e0 / h)) AS BIGINT)) AS fh FROM dim),
cell AS (SELECT layer_idx, r, g, b, 7 + k % 3 * 67 AS x0, 7 + k // 3 * 91 AS y0 FROM (SELECT *, row_number() OVER (ORDER BY layer_idx) - 1 AS k FROM layer WHERE visible AND layer_idx <> 3)),
{_lanczos_taps('tx', 'w', 'fw').replace('FROM dim', 'FROM fit')}, {_lanczos_taps('ty', 'h', 'fh').replace('FROM dim', 'FROM fit')},
hz AS (SELECT layer_idx, n AS x, y, sum(d * v) AS d FROM masks JOIN tx ON k = x GROUP BY 1, 2, 3), small AS (SELECT layer_idx, x, n AS y, {_byte('sum(d * v)')} AS d FROM hz JOIN ty ON k = y GROUP BY 1, 2, 3),
shown AS (SELECT x + x0 + (60 - fw) // 2 AS x, y + y0 + (60 - fh) // 2 AS y, {", ".join(f"{_byte(f'{v} * (d / 255e0) + {c} * (1 - d / 255e0)')} AS {c}" for c, v in zip("rgb", (24, 24, 28)))} FROM small JOIN cell USING (layer_idx), fit),
sheet AS (SELECT x, y, EXISTS (SELECT 1 FROM cell WHERE x BETWEEN x0 AND x0 + 59 AND y BETWEEN y0 AND y0 + 59) AS inside FROM range(3 * 60 + 4 * 7) a(x), range(2 * 84 + 3 * 7) b(y))
SELECT s.x, s.y, {", ".join(f"CAST(coalesce(shown.{c}, CASE WHEN inside THEN {v} ELSE {u} END) AS BIGINT) AS {c}" for c, v, u in zip("rgb", (24, 24, 28), (20, 20, 24)))} FROM sheet s LEFT JOIN shown USING (x, y)"""
_density("curve_edited", _curve([(0, 20), (179, 255), (180, 200), (255, 255)], TOP))
_LISTS = (("bacd", 2), ("bacd", 2), ("bcd", 1), ("bc", 1), ("bcd", 1), ("bacd", 2), ("bcd", 1), ("bacd", 2), ("bacd", 2), ("abcd", 2))
ORACLES["list_edits"] = "SELECT CAST(step AS BIGINT) AS step, CAST(pos AS BIGINT) AS pos, name, CAST(print_index AS BIGINT) AS print_index, CAST(selected AS BIGINT) AS selected FROM (VALUES " + ", ".join(f"({k}, {i}, '{n}', {0 if names == 'abcd' else i}, {at})" for k, (names, at) in enumerate(_LISTS) for i, n in enumerate(names)) + ") t(step, pos, name, print_index, selected)"
_PLATES = [("cyan", 0, 200, 255, 15), ("magenta", 220, 0, 180, 75), ("yellow", 255, 230, 0, 0), ("black", 0, 0, 0, 45)]
_PRESETS = [
    *(("cmyk_process_light", n, "color", *ink, "halftone", 0, a) for n, *ink, a in _PLATES), ("cmyk_process_light", "white highlight", "highlight", 255, 255, 255, "halftone", 0, -1),
    ("cmyk_process_dark", "white underbase", "underbase", 255, 255, 255, "solid", 0, -1), *(("cmyk_process_dark", n, "color", *ink, "halftone", 0, a) for n, *ink, a in _PLATES),
    ("cmyk_process_dark", "white highlight", "highlight", 255, 255, 255, "halftone", 0, -1), ("single_halftone", "black halftone", "color", 0, 0, 0, "halftone", 45, 22.5),
    ("black_only", "black", "color", 0, 0, 0, "solid", 0, -1), ("stencil", "stencil", "color", 0, 0, 0, "solid", 0, -1),
    ("duotone", "light tone", "color", 240, 220, 200, "halftone", 0, 15), ("duotone", "dark tone", "color", 30, 40, 80, "halftone", 0, 75),
    ("tritone", "highlight", "color", 240, 220, 200, "halftone", 0, 15), ("tritone", "mid", "color", 160, 80, 60, "halftone", 0, 75), ("tritone", "shadow", "color", 30, 20, 20, "halftone", 0, 45),
]
ORACLES["preset_layers"] = f"""WITH p(n, workflow, name, kind, r, g, b, mode, lpi, angle) AS (VALUES {", ".join(f"({n}, '{w}', '{name}', '{kind}', {r}, {g}, {b}, '{mode}', {lpi}, {angle}e0)" for n, (w, name, kind, r, g, b, mode, lpi, angle) in enumerate(_PRESETS))})
SELECT workflow, row_number() OVER q - 1 AS pos, name, kind, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, mode, CAST(lpi AS DOUBLE) AS lpi, CAST(angle AS DOUBLE) AS angle, row_number() OVER q - 1 AS print_index FROM p WINDOW q AS (PARTITION BY workflow ORDER BY n)"""

# files

ORACLES["png_round_trip"] = f"WITH {PX} SELECT i, x, y, r, g, b, 255::BIGINT AS alpha FROM px"
_FILM = lambda source: f"""SELECT count(*) FILTER (edge OR (inside AND (mark OR d < 128))) FROM (SELECT s.x, s.y, m.d, m.d IS NOT NULL AS inside, coalesce({_CROSS.replace("x -", "s.x - 3 -").replace("y -", "s.y - 3 -")}, false) AS mark,
  (s.x IN (3, w + 2) AND s.y BETWEEN 3 AND h + 2) OR (s.y IN (3, h + 2) AND s.x BETWEEN 3 AND w + 2) AS edge FROM dim, range(1000) a(x), range(100000) b(y) CROSS JOIN LATERAL (SELECT a.x, b.y) s LEFT JOIN {source} m ON m.x = s.x - 3 AND m.y = s.y - 3 WHERE s.x < w + 6 AND s.y < h + 6)"""  # noqa: E731
ORACLES["export_films"] = f"""WITH {SOURCE}, tap(k, w_) AS (VALUES {TAPS}), l0 AS (SELECT x, y, CASE WHEN {LUMA} < 128 THEN 0 ELSE 255 END AS d FROM src), {_blurred('l0', 'k0')}, k1 AS (SELECT x, y, CASE WHEN {TOP} > {T8}[y % 8 * 8 + x % 8 + 1] THEN 255 ELSE 0 END AS d FROM src)
SELECT '02_the_stencil_000000.png' AS name, CAST(w + 6 AS BIGINT) AS w, CAST(h + 11 AS BIGINT) AS h, 7874::BIGINT AS per_metre, ({_FILM('k0')}) AS ink FROM dim UNION ALL SELECT '00_soft_c82828.png', w + 6, h + 11, 7874, ({_FILM('k1')}) FROM dim"""
ORACLES["project_layers"] = """SELECT 1::BIGINT AS version, 'art.png' AS source, CAST(layer_idx AS BIGINT) AS layer_idx, name, kind, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, visible, extractor, render_mode, CAST(layer_idx AS BIGINT) AS print_index
FROM (VALUES (0, 'highlight', 'color', 240, 220, 200, true, 'channel_calc', 'halftone'), (1, 'mid', 'color', 160, 80, 60, true, 'channel_calc', 'halftone'), (2, 'shadow', 'color', 30, 20, 20, true, 'channel_calc', 'halftone'),
(3, 'painted', 'shadow', 9, 8, 7, false, 'manual_paint', 'solid')) t(layer_idx, name, kind, r, g, b, visible, extractor, render_mode)"""
