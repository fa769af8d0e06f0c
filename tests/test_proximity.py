import math

import numpy as np
import pytest

from dasymetra.operators.proximity import EARTH_M, cover_region, cover_regions, located, near_pairs, points_in_regions


def _metres(a, b):
    (y1, x1), (y2, x2) = np.radians(a), np.radians(b)
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("lat, spread", [(-10, 0.004), (60, 0.006), (89.95, 0.03), (-89.999, 0.0015)])
@pytest.mark.parametrize("rows_per_salt", [7, 100_000])
def test_near_pairs_against_all_pairs(spark, lat, spread, rows_per_salt):
    rng = np.random.default_rng(3)
    lons = (179.999 + rng.uniform(-spread, spread, 160) / max(math.cos(math.radians(lat)), 0.02) + 180) % 360 - 180
    points = [(i, float(min(90, max(-90, lat + rng.uniform(-spread, spread)))), float(x)) for i, x in enumerate(lons)]
    points += [(500, *points[0][1:]), (501, *points[0][1:])]
    truth = {(a[0], b[0]) for a in points for b in points if a[0] < b[0] and _metres(a[1:], b[1:]) <= 100}
    out = near_pairs(spark.createDataFrame(points, "id bigint, lat double, lon double"), 100.0, rows_per_salt).collect()
    assert len(out) == len({(r.id_a, r.id_b) for r in out})
    assert {(r.id_a, r.id_b) for r in out} == truth


def test_located_leaves_out_what_has_no_position(spark):
    rows = [(1, -10.0, -50.0), (1, -10.0, -50.0), (2, None, 1.0), (3, -1.0, 5.0), (4, 5.0, -1.0), (None, 1.0, 1.0), (5, float("nan"), 1.0), (6, 95.0, 1.0)]
    out = located(spark.createDataFrame(rows, "k bigint, lat double, lon double"), "k", "lat", "lon")
    assert [tuple(r) for r in out.collect()] == [(1, -10.0, -50.0)]
    assert near_pairs(out.limit(0), 100.0).count() == 0


def _inside(rings, x, y):
    odd = 0
    for r in rings:
        n = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:] + r[:1]))
        odd += n % 2
    return odd % 2 == 1


def test_points_in_regions_against_every_polygon(spark):
    rng = np.random.default_rng(1)
    regions = {}
    for k in range(25):
        cx, cy, size = rng.uniform(-60, -50), rng.uniform(-20, -10), rng.uniform(0.05, 3)
        angles = np.sort(rng.uniform(0, 2 * math.pi, 11))
        outer = [(cx + size * rng.uniform(0.4, 1) * math.cos(a), cy + size * rng.uniform(0.4, 1) * math.sin(a)) for a in angles]
        hole = [(cx + size * 0.2 * math.cos(a), cy + size * 0.2 * math.sin(a)) for a in angles[::-1]]
        regions[f"r{k}"] = [outer + outer[:1], hole] if k % 2 else [outer]
    regions["empty"] = []
    rows = [(k, [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in regions.items()] + [("null", None), (None, None)]
    table = spark.createDataFrame(rows, "code string, rings array<array<struct<x: double, y: double>>>")
    cover = cover_regions(table.union(table.limit(3)), "code", "rings").cache()
    points = [(i, float(y), float(x)) for i, (x, y) in enumerate(zip(rng.uniform(-63, -47, 3000), rng.uniform(-23, -7, 3000)))]
    out = points_in_regions(spark.createDataFrame(points, "id bigint, lat double, lon double"), cover).collect()
    truth = {(i, k) for i, y, x in points for k, rings in regions.items() if _inside(rings, x, y)}
    assert len(out) == len(truth) and {(r.id, r.region) for r in out} == truth
    assert any(r.exact for r in out) and any(not r.exact for r in out)


def test_cells_inside_are_coarse_and_border_cells_fine():
    square = [[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 1.0}]]
    cells = list(cover_region(square))
    inside = {level for level, _, _, e in cells if e is None}
    border = {level for level, _, _, e in cells if e is not None}
    assert len(border) == 1 and min(inside) < max(border)
    assert list(cover_region(None)) == []
