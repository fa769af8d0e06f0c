"""Points near points, and points in regions, by cell coverage.

Both joins are equi-joins on cells. A region is covered by an adaptive set of cells: a cell that lies
wholly inside is accepted for every point in it without a test, and only cells that the border crosses
lead to an exact test. The disc around a point is covered in the same way by the cells of one grid.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasymetra.plans.common import salted_join

EARTH_M = 6_371_008.8


def _haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared sine of half the angle between two points: what distances are compared by."""
    return F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres on a sphere of radius EARTH_M."""
    a = _haversine(lat1, lon1, lat2, lon2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def located(rows: DataFrame, key: str, lat: str, lon: str, missing: float | None = -1.0) -> DataFrame:
    """(id, lat, lon) once for each non-null key with a position.

    A coordinate that is null, NaN, outside the globe or equal to ``missing`` gives no position. A key
    delivered several times keeps one position, the smallest pair; repeated deliveries collapse before
    the shuffle.
    """
    y, x = F.col(f"`{lat}`").cast("double"), F.col(f"`{lon}`").cast("double")
    usable = y.between(-90, 90) & x.between(-180, 180) & F.col(f"`{key}`").isNotNull()
    if missing is not None:
        usable &= (y != missing) & (x != missing)
    return (
        rows.filter(usable).groupBy(F.col(f"`{key}`").alias("id")).agg(F.min(F.struct(y.alias("lat"), x.alias("lon"))).alias("p"))
        .select("id", "p.lat", "p.lon")
    )


def near_pairs(points: DataFrame, metres: float, rows_per_salt: int = 20_000, fineness: int = 2) -> DataFrame:
    """(id_a, id_b, distance_m): each pair of different ids at most ``metres`` apart once, id_a < id_b.

    points: (id, lat, lon) as from ``located``. The disc around each point is covered by cells ``fineness`` times narrower than the
    distance: those that lie wholly inside the disc accept every point in them without a test, those that its edge crosses lead to an exact test, all
    others are left out. A point looks for others in its own cell and in the cells of its disc that follow it in the order of rows and columns, so that every pair meets
    once; two points of one cell are near without a test. Rows are as high as a cell and in each the columns are as wide at its widest; their number is whole,
    so the grid closes at 180 degrees; next to the poles, where a row has few columns, all are tested. A cell with very many points is split over salts; none is ever collected in one place.
    """
    angle = metres / EARTH_M
    reach = math.degrees(angle) * (1 + 1e-9)
    height = reach / fineness
    rows = math.ceil(180 / height)

    def columns(row: Column) -> Column:
        """Number of grid columns in a row: 1 next to the poles."""
        widest = F.greatest(F.abs(row * height - 90), F.abs((row + 1) * height - 90)) + reach
        step = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(angle)) / F.cos(F.radians(F.least(widest, F.lit(89.9))))))) / fineness
        n = F.floor(360 / (step * (1 + 1e-9)))
        return F.when((widest >= 89.9) | (n < 8 * fineness), F.lit(1)).otherwise(n).cast("bigint")

    placed = points.withColumn("home", F.floor((F.col("lat") + 90) / height)).withColumn("n", columns(F.col("home")))
    placed = placed.withColumn("col", F.floor((F.col("lon") + 180) / 360 * F.col("n")) % F.col("n"))
    home = placed.select(F.col("home").alias("row"), "col", "id", "lat", "lon")

    # the rows from the point's own up to where its disc ends, and in each the columns between which the disc lies
    disc = placed.withColumn("row", F.explode(F.sequence(F.col("home"), F.least(F.floor((F.col("lat") + 90 + reach) / height), F.greatest(F.lit(rows), F.col("home"))))))
    disc = disc.withColumn("m", columns(F.col("row"))).withColumn("south", F.col("row") * height - 90)
    away = F.radians(F.greatest(F.col("south") - F.col("lat"), F.lit(0.0)))
    least_cos = F.cos(F.radians(F.least(F.greatest(F.abs("lat"), F.abs("south"), F.abs(F.col("south") + height)), F.lit(89.9))))
    part = F.greatest(F.lit(math.sin(angle / 2) ** 2) - F.pow(F.sin(away / 2), 2), F.lit(0.0)) / (least_cos * F.cos(F.radians("lat")))
    half = F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), part)))) * (1 + 1e-6) + 1e-12
    first, last = (F.floor((F.col("lon") + 180 + sign * half) / 360 * F.col("m")) for sign in (-1, 1))
    own = F.col("row") == F.col("home")
    begin = F.when(own, F.floor((F.col("lon") + 180) / 360 * F.col("m"))).otherwise(first)
    span = F.when(F.col("m") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(begin, F.greatest(begin, F.least(last, begin + F.col("m") - 1))))
    widest = F.cos(F.radians(F.when(F.col("south") * (F.col("south") + height) > 0, F.least(F.abs("south"), F.abs(F.col("south") + height))).otherwise(F.lit(0.0)))) * F.cos(F.radians("lat"))
    disc = disc.withColumn("widest", widest).withColumn("at", F.explode(span))
    west = F.col("at") * 360 / F.col("m") - 180
    # no corner is further than by the greatest steps in latitude and longitude, the latter at its widest
    limit = math.sin(angle / 2) ** 2
    dy = F.greatest(F.abs(F.col("south") - F.col("lat")), F.abs(F.col("south") + height - F.col("lat")))
    dx = F.greatest(F.abs(west - F.col("lon")), F.abs(west + 360 / F.col("m") - F.col("lon")))
    furthest = F.pow(F.radians(dy) / 2, 2) + F.col("widest") * F.pow(F.radians(dx) / 2, 2)
    here = own & (F.pmod(F.col("at"), F.col("m")) == F.col("col"))
    whole = (F.col("m") > 1) & (here | (furthest <= limit * (1 - 1e-9)))
    cover = disc.select("row", F.pmod(F.col("at"), F.col("m")).alias("col"), here.alias("own"), whole.alias("inside"), F.col("id").alias("id2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    metre = great_circle_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    met = salted_join(home, cover, ["row", "col"], rows_per_salt).filter(~F.col("own") | (F.col("id") < F.col("id2")))
    near = met.filter(F.col("inside") | (_haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) <= limit))
    return near.select(F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b"), metre.alias("distance_m"))


def _edges(rings) -> np.ndarray:
    """(n, 4) array of x1, y1, x2, y2 over all rings, each closed; null and empty rings and points are left out."""
    out = []
    for ring in rings if rings is not None else ():
        if ring is None:
            continue
        xy = np.array([(p["x"], p["y"]) for p in ring if p is not None and p["x"] is not None and p["y"] is not None], dtype=float).reshape(-1, 2)
        if len(xy) >= 3:
            out.append(np.hstack([xy, np.roll(xy, -1, axis=0)]))
    edges = np.vstack(out) if out else np.empty((0, 4))
    return edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]


def _crossings(e: np.ndarray, x0: np.ndarray, y0: np.ndarray, side: float) -> np.ndarray:
    """(cells, edges): whether an edge touches the closed box of a cell, by clipping it against the four sides."""
    gap = side * 1e-9  # keeps rounding from parting an edge from its cell
    ok, lo, hi = True, 0.0, 1.0
    for d, start, edge in ((e[:, 2] - e[:, 0], x0, e[:, 0]), (e[:, 3] - e[:, 1], y0, e[:, 1])):
        a, b = start[:, None] - gap - edge, start[:, None] + side + gap - edge
        flat = d == 0
        with np.errstate(divide="ignore", invalid="ignore"):
            t = a / d, b / d
        ok &= ~flat | ((a <= 0) & (b >= 0))
        lo = np.maximum(lo, np.where(flat, 0.0, np.minimum(*t)))
        hi = np.minimum(hi, np.where(flat, 1.0, np.maximum(*t)))
    return ok & (lo <= hi)


def _odd(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each point, whether a ray towards larger x crosses an odd number of edges."""
    e = e[e[:, 1] != e[:, 3]]
    up = (e[:, 1] > y[:, None]) != (e[:, 3] > y[:, None])
    at = (e[:, 2] - e[:, 0]) * (y[:, None] - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]
    return np.count_nonzero(up & (x[:, None] < at), axis=1) % 2 == 1


def cover_region(rings, finest: int = 4, coarsest_level: int = 2, step: int = 2):
    """(level, ix, iy, edges or None) of the cells that cover a region; edges are given for border cells only.

    Level L splits 360 degrees into 2^L; levels in use differ by ``step``. The first level is that at
    which the region's box is about one cell across; border cells are split until ``finest`` levels
    deeper. A border cell carries the edges that a ray from any of its points towards larger x can meet.
    A region is what an odd number of its rings encloses.
    """
    e = _edges(rings)
    if not len(e):
        return
    x_min, y_min = e[:, [0, 2]].min(), e[:, [1, 3]].min()
    x_max, y_max = e[:, [0, 2]].max(), e[:, [1, 3]].max()
    level = max(coarsest_level, int(math.floor(math.log2(360 / max(x_max - x_min, y_max - y_min, 1e-9)))))
    level -= (level - coarsest_level) % step
    deepest = level + finest - finest % step
    side = 360 / 2**level
    across = [np.arange(math.floor((lo + 180) / side), math.floor((hi + 180) / side) + 1) for lo, hi in ((x_min, x_max), (y_min, y_max))]
    ix, iy = (g.ravel() for g in np.meshgrid(*across))
    while len(ix):
        side, border = 360 / 2**level, []
        for at in range(0, len(ix), chunk := max(1, 2_000_000 // len(e))):
            x, y = ix[at : at + chunk] * side - 180, iy[at : at + chunk] * side - 180
            touched = _crossings(e, x, y, side).any(axis=1)
            border.append(touched)
            free = np.flatnonzero(~touched)
            for k in free[_odd(e, x[free] + side / 2, y[free] + side / 2)]:
                yield level, int(ix[at + k]), int(iy[at + k]), None
        border = np.concatenate(border)
        ix, iy = ix[border], iy[border]
        if level == deepest:
            gap, (low, high), right = side * 1e-9, np.sort(e[:, [1, 3]], axis=1).T, e[:, [0, 2]].max(axis=1)
            for i, j in zip(ix.tolist(), iy.tolist()):
                x0, y0 = i * side - 180, j * side - 180
                yield level, i, j, e[(high >= y0 - gap) & (low <= y0 + side + gap) & (right >= x0 - gap)]
            return
        n = 2**step
        inner = np.arange(n)
        ix, iy = (ix[:, None, None] * n + inner[:, None] + 0 * inner).ravel(), (iy[:, None, None] * n + 0 * inner[:, None] + inner).ravel()
        level += step


def cover_regions(regions: DataFrame, key: str, rings: str, finest: int = 4) -> DataFrame:
    """(region, level, ix, iy, inside, edges): the covering cells of every region; see cover_region.

    A null key is left out; a key given twice keeps one shape, the smallest. A region without a ring of
    three points covers nothing.
    """

    def cover(batches):
        kinds = pa.list_(pa.list_(pa.float64()))
        for batch in batches:
            cells = [
                (name, *cell) for name, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for cell in cover_region(r, finest)
            ]
            columns = list(zip(*cells)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()),
                 pa.array([e is None for e in columns[4]], pa.bool_()), pa.array([[] if e is None else e.tolist() for e in columns[4]], kinds)],
                names=["region", "level", "ix", "iy", "inside", "edges"])

    kind = regions.schema[key].dataType.simpleString()
    known = regions.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("region")).agg(F.min(f"`{rings}`").alias("rings"))
    known = known.repartition(4 * regions.sparkSession.sparkContext.defaultParallelism)
    return known.mapInArrow(cover, f"region {kind}, level int, ix bigint, iy bigint, inside boolean, edges array<array<double>>")


def points_in_regions(points: DataFrame, cover: DataFrame, rows_per_salt: int = 100_000) -> DataFrame:
    """(id, region, exact): each region that holds a point; ``exact`` tells that a border test decided.

    points: (id, lat, lon); x is lon and y is lat. cover: from cover_regions, and materialised, as it is
    read more than once. A point asks once at each level that the cover uses: at most a dozen numbers, read from
    the cover first. Overlapping regions each give a row. An empty cover gives no rows. The points of a cell that
    holds very many of them are split over salts, and the cell's regions repeated for each.
    """
    levels = sorted(r.level for r in cover.select("level").distinct().collect())
    asked = points.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    side = F.lit(360.0) / F.pow(F.lit(2.0), F.col("level"))
    asked = asked.withColumn("ix", F.floor((F.col("lon") + 180) / side)).withColumn("iy", F.floor((F.col("lat") + 180) / side))
    x, y = F.col("lon"), F.col("lat")

    def crosses(e: Column) -> Column:
        return ((e[1] > y) != (e[3] > y)) & (x < (e[2] - e[0]) * (y - e[1]) / (e[3] - e[1]) + e[0])

    # points are counted in the finest cells, and those counts summed for the coarser levels
    on, finest = ["level", "ix", "iy"], max(levels, default=0)
    fine = F.lit(360.0 / 2**finest)
    held = points.groupBy(F.floor((x + 180) / fine).alias("fx"), F.floor((y + 180) / fine).alias("fy")).agg(F.count(F.lit(1)).alias("n"))
    held = held.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>"))).withColumn("_step", F.pow(F.lit(2.0), F.lit(finest) - F.col("level")))
    counts = held.groupBy("level", F.floor(F.col("fx") / F.col("_step")).alias("ix"), F.floor(F.col("fy") / F.col("_step")).alias("iy")).agg(F.sum("n").alias("n"))
    met = salted_join(asked, cover, on, rows_per_salt, counts)
    held = met.filter(F.col("inside") | (F.size(F.filter("edges", crosses)) % 2 == 1))
    return held.select("id", "region", (~F.col("inside")).alias("exact"))
