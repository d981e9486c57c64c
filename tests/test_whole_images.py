"""Queries over whole images, on tables large enough for a cut to show."""

from __future__ import annotations

from collections import Counter

import numpy as np

from huegrid import fixtures as X
from huegrid.functions import color as C
from huegrid.operators import foreground as G
from huegrid.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_flood_fill_covers_the_whole_image(spark):
    rgb = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in X.px(spark, SF).collect()}
    w, h = X.size(spark, SF)
    border = [p for p in rgb if p[0] in (0, w - 1) or p[1] in (0, h - 1)]
    counts = Counter(rgb[p] for p in border)
    mode = C.lab_of(min(counts, key=lambda c: (-counts[c], c)))
    distance = {c: np.linalg.norm(np.subtract(C.lab_of(c), mode)) for c in set(rgb.values())}
    near = {p for p, c in rgb.items() if distance[c] < 12}
    reached = set(border) & near
    todo = list(reached)
    while todo:
        x, y = todo.pop()
        new = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} & near - reached
        reached |= new
        todo += new
    got = {(r["x"], r["y"]): r["is_fg"] for r in QUERIES["flood_fill"](spark, SF).collect()}
    assert h > 60 and got == {p: p not in reached for p in rgb}


def test_a_dab_of_every_event(spark):
    w, h = X.size(spark, SF)
    want = np.full((h, w), -1)
    for r in X.gray(X.px(spark, SF)).collect():
        want[r["y"], r["x"]] = r["d"]
    ys, xs = np.mgrid[:h, :w]
    for e in sorted(r["event_id"] for r in X.table(spark, SF, "events").select("event_id").collect()):
        want[(xs - e * 7 % 100) ** 2 + (ys - e % h) ** 2 <= 25] = 0 if e % 2 == 0 else 255
    got = QUERIES["brush_dabs"](spark, SF).toPandas()
    assert len(got) == w * h and (want[got["y"], got["x"]] == got["d"]).all()


def test_downsample_keeps_the_last_column(spark):
    w, h = X.size(spark, SF)
    d = np.zeros((h, w), int)
    for r in X.gray(X.px(spark, SF)).collect():
        d[r["y"], r["x"]] = r["d"]
    got = {(r["x"], r["y"]): r["d"] for r in QUERIES["downsample_3"](spark, SF).collect()}
    assert got == {(x, y): int(d[y * 3 : y * 3 + 3, x * 3 : x * 3 + 3].mean()) for x in range(34) for y in range(h // 3)}


def test_knockout_takes_every_background_pixel(spark, monkeypatch):
    image = spark.createDataFrame([(x, y, 9, 9, 9) for x in range(8) for y in range(7)], "x long, y long, r long, g long, b long")
    monkeypatch.setattr(X, "px", lambda spark, sf_dir: image)
    assert all(r["d"] == (255 if r["x"] < 4 else 9) for r in QUERIES["knockout"](spark, SF).collect())


def test_knockout_keeps_pixels_without_a_foreground_row(spark):
    mask = spark.createDataFrame([(x, 0, 9) for x in range(3)], "x long, y long, d int")
    fg = spark.createDataFrame([(0, 0, False), (1, 0, True)], "x long, y long, is_fg boolean")
    assert {r["x"]: r["d"] for r in G.knockout(mask, fg).collect()} == {0: 255, 1: 9, 2: 9}
