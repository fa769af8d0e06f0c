"""Zone to source travel times: dense tables, retries, modes, nearest source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Zones in a block of the dense grid.
GRID = 50_000


def dense(zones: DataFrame, sources: DataFrame, routes: DataFrame | None = None, fill_missing: float | None = None) -> DataFrame:
    """(zone_id, source_id, minutes) for every pair, null or ``fill_missing`` where no route is known.

    The full grid is the result that is asked for. Zones go to every task in blocks of at most GRID of them, one for each copy of a source, so
    that no task holds more than a block whatever their number.
    """
    block = F.pmod(F.xxhash64("zone_id"), F.col("_blocks")).cast("int")
    count = zones.agg(F.greatest(F.ceil(F.count(F.lit(1)) / GRID), F.lit(1)).cast("int").alias("_blocks"))
    held = zones.select("zone_id").crossJoin(F.broadcast(count)).withColumn("_block", block).groupBy("_block").agg(F.collect_list("zone_id").alias("_zones"))
    asked = sources.select("source_id").crossJoin(F.broadcast(count)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    grid = asked.join(held, "_block").select(F.explode("_zones").alias("zone_id"), "source_id")
    if routes is None:
        return grid.withColumn("minutes", F.lit(fill_missing).cast("double"))
    t = F.when(F.col("minutes") == float("inf"), F.lit(None)).otherwise(F.col("minutes"))
    return grid.join(routes.select("zone_id", "source_id", t.alias("minutes")), ["zone_id", "source_id"], "left").withColumn(
        "minutes", F.coalesce("minutes", F.lit(fill_missing)) if fill_missing is not None else F.col("minutes"))


def oriented(routes: DataFrame, zones: DataFrame) -> DataFrame:
    """Routes (from_id, to_id, minutes) as (zone_id, source_id, minutes), turned round if more from_ids than to_ids name zones are not zones."""
    z = zones.select(F.col("zone_id").alias("z"))
    forth = routes.join(z, routes["from_id"] == z["z"], "left_semi").count()
    back = routes.join(z, routes["to_id"] == z["z"], "left_semi").count()
    a, b = ("from_id", "to_id") if forth >= back else ("to_id", "from_id")
    return routes.select(F.col(a).alias("zone_id"), F.col(b).alias("source_id"), "minutes")


def retried(od: DataFrame, retry: DataFrame) -> DataFrame:
    """od with the pairs that lacked a time filled from the retry; known times stay."""
    again = retry.select("zone_id", "source_id", F.col("minutes").alias("again"))
    return od.join(again, ["zone_id", "source_id"], "left").select("zone_id", "source_id", F.coalesce("minutes", "again").alias("minutes"))


def unreachable_share(od: DataFrame) -> DataFrame:
    """(share): zones without any time, of all."""
    return od.groupBy("zone_id").agg(F.count("minutes").alias("n")).agg(F.avg((F.col("n") == 0).cast("double")).alias("share"))


def auto_mode(walk: DataFrame, car: DataFrame, threshold: float) -> DataFrame:
    """The walking table, or all of the driving one if the share of zones that cannot be walked to is ``threshold`` or more; never a mixture."""
    share = unreachable_share(walk).select((F.col("share") >= threshold).alias("drive"))
    both = walk.withColumn("mode", F.lit("WALK")).unionByName(car.withColumn("mode", F.lit("CAR")))
    return both.join(F.broadcast(share), F.col("drive") == (F.col("mode") == "CAR")).drop("drive")


def nearest(od: DataFrame, distance: str = "minutes") -> DataFrame:
    """The source of least distance for each zone, ties to the lower id; zones that nothing reaches have none. Reduced before the shuffle."""
    best = F.min(F.struct(F.col(distance).alias("d"), "source_id"))
    return od.filter(F.col(distance).isNotNull()).groupBy("zone_id").agg(best.alias("b")).select("zone_id", F.col("b.source_id").alias("source_id"), F.col("b.d").alias(distance))


def histogram(values: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, n): equal bins from the least to the greatest value, the greatest in the last; nulls left out."""
    v = values.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1))
    return v.join(F.broadcast(ends), how="cross").groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def extremes(od: DataFrame, margin: float = 0.1) -> DataFrame:
    """(n_null, most, n_near_most): one row with the pairs without a time, the longest time and how many come within ``margin`` of it, as a time cut off at a limit would."""
    top = od.agg(F.max("minutes").alias("top"))
    return od.crossJoin(F.broadcast(top)).agg(F.count_if(F.col("minutes").isNull()).alias("n_null"), F.max("minutes").alias("most"), F.count_if(F.col("minutes") >= F.col("top") - margin).alias("n_near_most"))


def spread(values: DataFrame, value: Column, by: list[str] = ()) -> DataFrame:
    """(by, n, q0, q25, q50, q75, q100, low, high, n_outside): what a box plot shows; whiskers end at the furthest values within one and a half times the quartiles' distance."""
    v = values.select(*by, value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    q = v.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("v", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    q = q.select(*by, "n", *[F.col("q")[k].alias(f"q{p}") for k, p in enumerate((0, 25, 50, 75, 100))])
    both = v.join(q, list(by)) if by else v.crossJoin(F.broadcast(q))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = (F.col("v") >= F.col("q25") - reach) & (F.col("v") <= F.col("q75") + reach)
    names = ["n", "q0", "q25", "q50", "q75", "q100"]
    return both.groupBy(*by, *names).agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.count_if(~inside).alias("n_outside"))


def density(values: DataFrame, value: Column, points: int = 512) -> DataFrame:
    """(x, density): Gaussian kernel density at equal steps three bandwidths beyond the least and greatest value, bandwidth 0.9 min(deviation, quartiles / 1.34) n^-1/5.

    Values are first counted in bins a fortieth of the bandwidth wide or wider, 20,000 at most, so that the join with the points is bounded.
    """
    v = values.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    s = v.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    iqr = (F.col("q")[1] - F.col("q")[0]) / 1.34
    width = F.coalesce(F.nullif(F.least("sd", F.when(iqr > 0, iqr)), F.lit(0.0)), F.nullif("sd", F.lit(0.0)), F.lit(1.0))
    s = s.withColumn("h", 0.9 * width * F.pow("n", F.lit(-0.2))).withColumn("b", F.greatest(F.col("h") / 40, (F.col("hi") - F.col("lo")) / 20_000))
    bins = v.crossJoin(F.broadcast(s.select("lo", "b"))).groupBy(F.floor((F.col("v") - F.col("lo")) / F.nullif("b", F.lit(0.0))).alias("k")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("c"))
    at = s.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") - 3 * F.col("h") + F.col("i") / (points - 1) * (F.col("hi") - F.col("lo") + 6 * F.col("h")))
    z = (F.col("x") - F.col("v")) / F.col("h")
    return F.broadcast(at).crossJoin(bins).groupBy("x", "h", "n").agg(F.sum(F.col("c") * F.exp(-z * z / 2)).alias("s")).select("x", (F.col("s") / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))


def ranked(values: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return values.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
