"""Polygons as rings of points: representative points, lines that cross polygons, clipping and overlay.

Rings are even-odd: a point is inside if an odd number of them encloses it. All joins are equi-joins on the cells
of proximity's adaptive cover; exact tests run only where a border is.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasymetra.operators import proximity, spatial

#: Kilometres to a degree of latitude, for areas in square kilometres.
KM = 111.32


def rings_area(rings: Column) -> Column:
    """Area of even-odd rings in which holes turn against their outer ring or lie inside it: the greatest ring less those in it is |sum| where directions alternate; else outer less the rest."""
    areas = F.transform(rings, lambda r: F.abs(spatial.signed_area(r)))
    return F.greatest(2 * F.array_max(areas) - F.aggregate(areas, F.lit(0.0), lambda s, v: s + v), F.lit(0.0))


def area_km2(rings: Column, lat: Column) -> Column:
    """Area in square kilometres of rings in degrees, by the cosine of a latitude of theirs."""
    return rings_area(rings) * KM * KM * F.cos(F.radians(lat))


def _spans(edges: np.ndarray, y: float) -> np.ndarray:
    """Sorted x of the crossings of a level with the border."""
    e = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
    return np.sort((e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])


def point_on_surface(rings) -> tuple[float, float] | None:
    """A point inside rings: the middle of the widest stretch inside along a level through the middle of the box, moved off vertices; None for rings without area."""
    edges = proximity._edges(rings)
    if not len(edges):
        return None
    ys = np.unique(edges[:, [1, 3]])
    middle = (ys[0] + ys[-1]) / 2
    below, above = ys[ys <= middle], ys[ys > middle]
    if not len(above):
        return None
    # halfway between the nearest vertices below and above the middle, so that no vertex lies on the level
    y = (below[-1] + above[0]) / 2
    x = _spans(edges, y)
    if len(x) < 2:
        return None
    width = x[1::2] - x[::2][: len(x) // 2]
    k = int(np.argmax(width))
    return float((x[2 * k] + x[2 * k + 1]) / 2), float(y)


def points_on_surface(zones: DataFrame, key: str = "zone_id", rings: str = "rings") -> DataFrame:
    """(key, x, y): a point inside each zone; none for zones without area. A zone is worked on by itself, in Arrow batches; no shuffle."""
    kind = zones.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = [(k, p) for k, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (p := point_on_surface(r)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], batch.schema.field(0).type), pa.array([p[0] for _, p in got], pa.float64()), pa.array([p[1] for _, p in got], pa.float64())], names=["key", "x", "y"])

    out = zones.select(F.col(f"`{key}`").alias("key"), F.col(f"`{rings}`").alias("rings")).mapInArrow(run, f"key {kind}, x double, y double")
    return out.select(F.col("key").alias(key), "x", "y")


def cells_of_segments(lines: DataFrame, level: int, key: str = "line_id", points: str = "points") -> DataFrame:
    """(line_id, x1, y1, x2, y2, ix, iy): each segment of a line once for each cell of a level that its box meets."""
    side = 360 / 2**level
    pts = F.col(f"`{points}`")
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pts) - 1, F.lit(1))), lambda i: F.struct(F.element_at(pts, i).alias("a"), F.try_element_at(pts, i + 1).alias("b")))
    s = lines.select(F.col(f"`{key}`").alias("line_id"), F.explode(F.when(F.size(pts) >= 2, parts)).alias("s"))
    s = s.select("line_id", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2")).dropna()
    cell = lambda c: F.floor((c + 180) / side)
    span = lambda a, b: F.sequence(cell(F.least(a, b)), cell(F.greatest(a, b)))
    return s.withColumn("ix", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("iy", F.explode(span(F.col("y1"), F.col("y2"))))


def _turn(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _meet(e: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether an edge [x1, y1, x2, y2] and a segment touch or cross; in line they must share a stretch of their boxes."""
    a, b = _turn(e[0], e[1], e[2], e[3], x1, y1), _turn(e[0], e[1], e[2], e[3], x2, y2)
    c, d = _turn(x1, y1, x2, y2, e[0], e[1]), _turn(x1, y1, x2, y2, e[2], e[3])
    boxes = (F.least(e[0], e[2]) <= F.greatest(x1, x2)) & (F.greatest(e[0], e[2]) >= F.least(x1, x2)) & (F.least(e[1], e[3]) <= F.greatest(y1, y2)) & (F.greatest(e[1], e[3]) >= F.least(y1, y2))
    return boxes & (F.signum(a) * F.signum(b) <= 0) & (F.signum(c) * F.signum(d) <= 0)


def lines_in_regions(lines: DataFrame, cover: DataFrame, key: str = "line_id", points: str = "points") -> DataFrame:
    """(line_id, region): each line and region that share a point, once. cover: from proximity.cover_regions, materialised, as it is read twice.

    A segment asks the cells that its box meets at each level of the cover, at most a dozen. A segment with an end in an interior cell is
    accepted at once; else an end inside, or an edge of the cell that it crosses, decides. A line that only runs through an interior
    cell crosses the border elsewhere, in a border cell, or lies inside with an end.
    """
    levels = sorted(r.level for r in cover.select("level").distinct().collect())
    if not levels:
        return lines.select(F.col(f"`{key}`").alias("line_id")).limit(0).crossJoin(cover.select("region").limit(0))
    found = None
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    for level in levels:
        side = 360 / 2**level
        asked = cells_of_segments(lines, level, key, points)
        met = asked.join(cover.filter(F.col("level") == level), ["ix", "iy"])

        def here(x, y, side=side):
            return (F.floor((x + 180) / side) == F.col("ix")) & (F.floor((y + 180) / side) == F.col("iy"))

        def inside(x, y):
            odd = F.size(F.filter("edges", lambda e: ((e[1] > y) != (e[3] > y)) & (x < (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1]) + e[0]))) % 2 == 1
            return here(x, y) & (F.col("inside") | odd)

        hit = inside(x1, y1) | inside(x2, y2) | F.exists("edges", lambda e: _meet(e, x1, y1, x2, y2))
        part = met.filter(hit).select("line_id", "region")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _near(cell: tuple[float, float], segments: list, metres: float) -> bool:
    """Whether a point lies within a distance of any segment, on a plane around the point."""
    if not segments:
        return False
    x, y = cell
    s = np.asarray(segments, float)
    scale = np.array([proximity.EARTH_M * math.radians(1) * math.cos(math.radians(y)), proximity.EARTH_M * math.radians(1)])
    a, b = (s[:, :2] - (x, y)) * scale, (s[:, 2:] - (x, y)) * scale
    d = b - a
    length = (d * d).sum(axis=1)
    t = np.clip(-(a * d).sum(axis=1) / np.where(length > 0, length, 1.0), 0.0, 1.0)
    near = a + d * t[:, None]
    return bool(((near * near).sum(axis=1) <= metres * metres).any())


def near_roads(cells: DataFrame, roads: DataFrame, metres: float = 200.0) -> DataFrame:
    """(zone_id, cx, cy, tier): cells within a distance of a road of their zone, with the best (least) tier among such roads.

    cells: (zone_id, cx, cy, x, y) with the position of their middle; roads: (zone_id, tier, x1, y1, x2, y2), the segments that meet a zone. Both meet on
    a grid as wide as the distance: a segment stands in each grid cell that its box, widened by the distance, meets. A very long segment is cut first by whoever makes roads.
    """
    step = F.lit(math.degrees(metres / proximity.EARTH_M) * (1 + 1e-9))
    wide = step / F.cos(F.radians(F.least(F.abs(F.col("y")), F.lit(85.0))))
    placed = cells.select("zone_id", "cx", "cy", "x", "y", F.floor(F.col("y") / step).alias("gy"))
    reach = step / F.cos(F.radians(F.least(F.greatest(F.abs("y1"), F.abs("y2")) + step, F.lit(85.0))))
    rows = F.sequence(F.floor((F.least("y1", "y2") - step) / step), F.floor((F.greatest("y1", "y2") + step) / step))
    low, high = F.least("x1", "x2") - reach, F.greatest("x1", "x2") + reach
    asked = roads.withColumn("gy", F.explode(rows)).select("zone_id", "tier", "x1", "y1", "x2", "y2", "gy", low.alias("low"), high.alias("high"))
    met = placed.join(asked, ["zone_id", "gy"]).filter((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
    k = math.radians(1) * proximity.EARTH_M
    kx = F.lit(k) * F.cos(F.radians("y"))
    ax, ay, bx, by = (F.col("x1") - F.col("x")) * kx, (F.col("y1") - F.col("y")) * k, (F.col("x2") - F.col("x")) * kx, (F.col("y2") - F.col("y")) * k
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(length > 0, length).otherwise(1.0)))
    px, py = ax + t * dx, ay + t * dy
    return met.filter(px * px + py * py <= metres * metres).groupBy("zone_id", "cx", "cy").agg(F.min("tier").alias("tier"))


def weighted_points(labelled: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(zone_id, patch, patch_pop, n_patches, cx, cy, pop, has_roads, near_road, tier): the cell of the most populous patch of each zone that stands for it.

    labelled: cells with their patch, from spatial.patches. Of the best patch the most populous cell counts; with ``near``, the most populous of
    those near a road, roads of the first tier tried before the first two, and those before all. Ties: lower patch, then first cell.
    Three aggregations by zone, each combined before its shuffle; no zone is gathered.
    """
    totals = labelled.groupBy("zone_id", "patch").agg(F.sum("pop").alias("patch_pop"))
    best = totals.groupBy("zone_id").agg(F.min(F.struct((-F.col("patch_pop")).alias("p"), "patch", "patch_pop")).alias("b"), F.count(F.lit(1)).alias("n_patches")).select("zone_id", F.col("b.patch").alias("patch"), "b.patch_pop", "n_patches")
    cells = labelled.join(best, ["zone_id", "patch"])
    cells = cells.withColumn("tier", F.lit(None).cast("int")) if near is None else cells.join(near, ["zone_id", "cx", "cy"], "left")
    order = F.struct(F.coalesce("tier", F.lit(9)).alias("t"), (-F.col("pop")).alias("p"), "cy", "cx", "pop")
    out = cells.groupBy("zone_id", "patch", "patch_pop", "n_patches").agg(F.min(order).alias("c"))
    tier = F.when(F.col("c.t") < 9, F.col("c.t")).cast("int")
    return out.select("zone_id", "patch", "patch_pop", "n_patches", "c.cx", "c.cy", "c.pop", tier.isNotNull().alias("near_road"), tier.alias("tier"))


def representative_points(zones: DataFrame, method: str = "point_on_surface", cells: DataFrame | None = None, roads: DataFrame | None = None, least_km2: float = 1.0, key: str = "zone_id", rings: str = "rings") -> DataFrame:
    """(key, x, y, how): one point for each zone.

    method centroid, point_on_surface or pop_weighted. Weighted: zones of at least ``least_km2`` with populated cells take the cell that
    weighted_points picks, all others a point inside. cells: (zone_id, cx, cy, x, y, pop); roads: see near_roads.
    """
    if method == "centroid":
        largest = F.array_max(F.transform(rings, lambda r: F.struct(F.abs(spatial.signed_area(r)).alias("a"), r.alias("r"))))["r"]
        c = zones.select(key, spatial.centroid(largest).alias("c"))
        return c.select(key, "c.x", "c.y", F.lit(method).alias("how"))
    surface = points_on_surface(zones, key, rings).withColumn("how", F.lit("point_on_surface"))
    if method == "point_on_surface":
        return surface
    if method != "pop_weighted" or cells is None:
        raise ValueError("method must be centroid, point_on_surface or pop_weighted, the last with cells")
    y = F.element_at(F.element_at(rings, 1), 1)["y"]
    large = zones.filter(area_km2(F.col(rings), y) >= least_km2).select(F.col(key).alias("zone_id"))
    mine = cells.join(large, "zone_id", "left_semi")
    near = None if roads is None else near_roads(mine, roads)
    picked = weighted_points(spatial.patches(mine), near)
    at = picked.join(mine.select("zone_id", "cx", "cy", F.col("x").alias("wx"), F.col("y").alias("wy")).dropDuplicates(["zone_id", "cx", "cy"]), ["zone_id", "cx", "cy"])
    both = surface.join(at.select(F.col("zone_id").alias(key), "wx", "wy"), key, "left")
    return both.select(key, F.coalesce("wx", "x").alias("x"), F.coalesce("wy", "y").alias("y"), F.when(F.col("wx").isNotNull(), "pop_weighted").otherwise(F.col("how")).alias("how"))


def overlap_area(a, b) -> float:
    """Area that two sets of even-odd rings share, exact for straight edges.

    Levels through every vertex and every crossing of two borders cut the plane into slabs in which no two edges cross, so
    the width that both hold changes in a straight line across a slab: its mean at the middle times the height is exact.
    """
    e, f = proximity._edges(a), proximity._edges(b)
    if not len(e) or not len(f):
        return 0.0
    low, high = max(e[:, [1, 3]].min(), f[:, [1, 3]].min()), min(e[:, [1, 3]].max(), f[:, [1, 3]].max())
    if low >= high:
        return 0.0
    d, g = e[:, 2:] - e[:, :2], f[:, 2:] - f[:, :2]
    cross = d[:, 0][:, None] * g[:, 1] - d[:, 1][:, None] * g[:, 0]
    gap = f[None, :, :2] - e[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * g[:, 1] - gap[..., 1] * g[:, 0]) / cross
        u = (gap[..., 0] * d[:, 1][:, None] - gap[..., 1] * d[:, 0][:, None]) / cross
    t, u = np.where(np.isfinite(t), t, -1.0), np.where(np.isfinite(u), u, -1.0)
    hit = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    at = (e[:, 1][:, None] + t * d[:, 1][:, None])[hit]
    levels = np.unique(np.concatenate([e[:, [1, 3]].ravel(), f[:, [1, 3]].ravel(), at]))
    levels = levels[(levels >= low) & (levels <= high)]
    total = 0.0
    for y0, y1 in zip(levels, levels[1:]):
        y = (y0 + y1) / 2
        x, z = _spans(e, y), _spans(f, y)
        marks = np.concatenate([x, z])
        order = np.argsort(marks, kind="stable")
        which = np.concatenate([np.zeros(len(x), int), np.ones(len(z), int)])[order]
        held = np.stack([np.cumsum(which == 0) % 2, np.cumsum(which == 1) % 2])
        both = (held[0] == 1) & (held[1] == 1)
        width = np.diff(marks[order])
        total += (y1 - y0) * width[both[:-1]].sum()
    return float(total)


def clipped(zones: DataFrame, clip: list, values: list[str], rings: str = "rings") -> DataFrame:
    """Zones that share area with a shape, with ``share`` of their area inside and their values times it. clip: the rings of one town's outline, sent to all tasks. No shuffle."""
    shape = [[(p["x"], p["y"]) if isinstance(p, dict) or hasattr(p, "asDict") else tuple(p) for p in r] for r in clip]
    sent = zones.sparkSession.sparkContext.broadcast([[{"x": x, "y": y} for x, y in r] for r in shape])

    @F.pandas_udf("double")
    def share(columns):
        import pandas as pd

        out = []
        for r in columns:
            own = [[{"x": p["x"], "y": p["y"]} for p in ring] for ring in (r if r is not None else [])]
            whole = overlap_area(own, own)
            out.append(overlap_area(own, sent.value) / max(whole, 1e-10))
        return pd.Series(out, dtype=float)

    out = zones.withColumn("share", share(F.col(rings))).filter("share > 0")
    return out.withColumns({v: F.col(v) * F.col("share") for v in values})
