"""Geometry as arrays of points, and statistics over neighbouring zones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasymetra.operators.diagnostics import running
from dasymetra.plans.common import cut_lineage


def signed_area(ring: Column) -> Column:
    """Shoelace area of a ring of (x, y) points, closed or not; positive against the clock."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def centroid(ring: Column) -> Column:
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    part = lambda axis: F.aggregate(F.zip_with(ring, turned, lambda a, b: (a[axis] + b[axis]) * (a["x"] * b["y"] - b["x"] * a["y"])), F.lit(0.0), lambda s, v: s + v)
    area = F.nullif(signed_area(ring), F.lit(0.0))
    return F.struct((part("x") / (6 * area)).alias("x"), (part("y") / (6 * area)).alias("y"))


def buffered_box(points: DataFrame, km: float) -> DataFrame:
    """(x0, y0, x1, y1): the box of all points and ``km`` around it, by 111 km to a degree and the cosine of its middle latitude."""
    box = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    dy = F.lit(km / 111.0)
    dx = dy / F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))
    return box.select((F.col("x0") - dx).alias("x0"), (F.col("y0") - dy).alias("y0"), (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"))


def neighbours(zones: DataFrame, digits: int = 9) -> DataFrame:
    """(a, b): zones that share a vertex, both ways. zones: (zone_id, rings); coordinates are rounded to ``digits``."""
    points = zones.select("zone_id", F.explode("rings").alias("ring")).select("zone_id", F.explode("ring").alias("p"))
    points = points.select("zone_id", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y")).distinct()
    other = points.withColumnRenamed("zone_id", "b")
    return points.withColumnRenamed("zone_id", "a").join(other, ["x", "y"]).filter("a <> b").select("a", "b").distinct()


def lagged(values: DataFrame, links: DataFrame) -> DataFrame:
    """(zone_id, z, lag): standardised value (sample deviation) and mean of the neighbours' z; zones without neighbours have lag 0. Nulls are left out."""
    known = values.filter(F.col("value").isNotNull())
    stats = known.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = known.join(F.broadcast(stats), how="cross").select("zone_id", ((F.col("value") - F.col("m")) / F.nullif("s", F.lit(0.0))).alias("z"))
    lag = links.join(z.select(F.col("zone_id").alias("b"), F.col("z").alias("zb")), "b").groupBy(F.col("a").alias("zone_id")).agg(F.avg("zb").alias("lag"), F.count(F.lit(1)).alias("n_neighbours"))
    return z.join(lag, "zone_id", "left").select("zone_id", "z", F.coalesce("lag", F.lit(0.0)).alias("lag"), F.coalesce("n_neighbours", F.lit(0)).alias("n_neighbours"))


def morans_i(lag: DataFrame) -> DataFrame:
    """(moran_i, n): with row-standardised weights; zones without neighbours count in the variance, not in the sum of weights."""
    linked = F.count_if(F.col("n_neighbours") > 0)
    return lag.agg((F.count(F.lit(1)) / F.nullif(linked, F.lit(0)) * F.sum(F.col("z") * F.col("lag")) / F.nullif(F.sum(F.col("z") * F.col("z")), F.lit(0.0))).alias("moran_i"), F.count(F.lit(1)).alias("n"))


def quadrants(lag: DataFrame) -> DataFrame:
    """(zone_id, local_i, quadrant): local statistic and the signs of z and its lag; what rounding leaves of a zero counts as zero."""
    z, l = F.round("z", 12), F.round("lag", 12)
    q = F.when((z >= 0) & (l >= 0), "HH").when((z < 0) & (l < 0), "LL").when(z >= 0, "HL").otherwise("LH")
    return lag.select("zone_id", (F.col("z") * F.col("lag")).alias("local_i"), q.alias("quadrant"))


#: Zones of which a permutation test may hold the values in each task.
MOST_ZONES = 5_000_000


def permutation_p(lag: DataFrame, rounds: int = 999, seed: int = 1, alpha: float = 0.05) -> DataFrame:
    """(zone_id, p, cluster): pseudo p of the local statistic from ``rounds`` draws of as many other zones' values, and its quadrant where p <= alpha, else NS.

    The values of all zones, one number each and checked against MOST_ZONES, go to every task; zones are spread over tasks.
    """
    spark = lag.sparkSession
    n = lag.count()
    if n > MOST_ZONES:
        raise ValueError(f"more than {MOST_ZONES} zones")
    values = lag.select("zone_id", "z").orderBy("zone_id").toPandas()
    shared = spark.sparkContext.broadcast((values["zone_id"].to_numpy(), values["z"].to_numpy()))

    def test(frames):
        ids, z = shared.value
        for frame in frames:
            out = []
            for zone, own, k, value in zip(frame["zone_id"], frame["z"], frame["n_neighbours"], frame["lag"]):
                if k == 0 or len(z) <= k:
                    out.append(1.0)
                    continue
                at = int(np.searchsorted(ids, zone))
                rng = np.random.default_rng([seed, at])
                drawn = rng.integers(0, len(z) - 1, (rounds, int(k)))
                drawn += drawn >= at  # never the zone itself
                larger = int(np.count_nonzero(own * z[drawn].mean(axis=1) >= own * value))
                out.append((min(larger, rounds - larger) + 1) / (rounds + 1))
            yield pd.DataFrame({"zone_id": frame["zone_id"], "p": out})

    kind = lag.schema["zone_id"].dataType.simpleString()
    p = lag.mapInPandas(test, f"zone_id {kind}, p double")
    return p.join(quadrants(lag), "zone_id").select("zone_id", "p", F.when(F.col("p") <= alpha, F.col("quadrant")).otherwise("NS").alias("cluster"))


def correlations(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(pearson, spearman, n): the second from mean ranks, found on distinct values, whose counts are summed range by range."""
    # written once: a sum of doubles worked out anew may differ in its last place and no longer meet its rank
    known = cut_lineage(pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y))

    def ranks(c: str) -> DataFrame:
        counts = known.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        return running(counts, [F.col(c)], "n", "below").select(c, (F.col("below") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    both = known.join(ranks(x), x).join(ranks(y), y)
    return both.agg(F.corr(x, y).alias("pearson"), F.corr(f"rank_{x}", f"rank_{y}").alias("spearman"), F.count(F.lit(1)).alias("n"))


def patches(cells: DataFrame) -> DataFrame:
    """(zone_id, cx, cy, pop, patch): populated cells of a zone's grid with the number of the patch that touching cells, also by a corner, form.

    cells: (zone_id, cx, cy, pop) with whole cx and cy. A zone's grid is one group: the cells of one zone, not of all.
    Patches are numbered by their first cell in order of cy and cx.
    """

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cy", "cx"]).reset_index(drop=True)
        at = {(x, y): i for i, (x, y) in enumerate(zip(frame["cx"], frame["cy"]))}
        root = list(range(len(frame)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for (x, y), i in at.items():
            for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)):
                if (j := at.get((x + dx, y + dy))) is not None:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
        first = [find(i) for i in range(len(frame))]
        number = {r: n for n, r in enumerate(sorted(set(first)), 1)}
        return frame.assign(patch=[number[r] for r in first])

    schema = cells.select("zone_id", "cx", "cy", "pop").schema
    text = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", patch int"
    return cells.select("zone_id", "cx", "cy", "pop").filter("pop > 0").dropDuplicates(["zone_id", "cx", "cy"]).groupBy("zone_id").applyInPandas(label, text)


def best_cells(labelled: DataFrame) -> DataFrame:
    """(zone_id, patch, patch_pop, cx, cy): the most populous patch of each zone and its most populous cell, ties to the lower number and the first cell."""
    totals = labelled.groupBy("zone_id", "patch").agg(F.sum("pop").alias("patch_pop"), F.min(F.struct((-F.col("pop")).alias("p"), "cy", "cx")).alias("cell"))
    best = totals.groupBy("zone_id").agg(F.min(F.struct((-F.col("patch_pop")).alias("p"), "patch", "patch_pop", "cell")).alias("b"))
    return best.select("zone_id", "b.patch", "b.patch_pop", "b.cell.cx", "b.cell.cy")


#: Roads that are always part of a town's network, and those that mostly are.
TIERS = (("primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "residential", "living_street"), ("unclassified", "service"))


def road_tier(highway: Column) -> Column:
    """1 for roads that are always connected, 2 for those that mostly are, 3 for any other."""
    return F.when(highway.isin(*TIERS[0]), 1).when(highway.isin(*TIERS[1]), 2).otherwise(3)


def clipped_share(ring: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Share of a ring's area inside a box, by clipping it against the four sides in turn."""

    def area(p):
        return abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2 if len(p) > 2 else 0.0

    whole = area(ring)
    p = ring
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        out = []
        for a, b in zip(p, np.roll(p, -1, axis=0)):
            da, db = sign * (a[axis] - limit), sign * (b[axis] - limit)
            if da >= 0:
                out.append(a)
            if da * db < 0:
                out.append(a + (b - a) * (da / (da - db)))
        p = np.array(out).reshape(-1, 2)
    return area(p) / max(whole, 1e-10)
