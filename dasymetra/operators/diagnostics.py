"""Checks of an interpolation, and the tables behind its diagnostic views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasymetra.operators.weights import row_entropy
from dasymetra.plans.common import cut_lineage


#: The checks in order, each with the value above which it warns and above which it fails.
CHECKS = (
    ("convergence", 0.0, None), ("alpha_distribution", 5.0, None), ("residual_rmse", None, None), ("residual_bias", 0.1, None), ("population_voter_gap", 5.0, 20.0), ("unreachable_pairs", 1.0, 10.0),
    ("alpha_variation", None, None), ("implied_turnout", 5.0, None), ("representative_points", 50.0, None),
)


def checks(fit: DataFrame, population: DataFrame, voters: DataFrame, od: DataFrame, alpha: DataFrame, history: DataFrame | None = None, clusters: DataFrame | None = None, alpha_limit: float = 15.0) -> DataFrame:
    """(check, status, detail, value): one row for each of nine checks; nothing to judge is a skip, equality with a limit passes.

    convergence: 1 if the fit ended without it (history: epoch, converged). alpha_distribution: per cent of zones whose median alpha is above the
    limit. residual_rmse. residual_bias: greatest mean residual of a bracket, judged as a share of the rmse. population_voter_gap: per cent of the greater total.
    unreachable_pairs: per cent. alpha_variation: deviation over mean of the zones' medians, too low below 0.1, skipped below three zones. implied_turnout: per cent of
    zones above 110 %. representative_points: per cent of clusters without roads (clusters: has_roads).
    Each table is read once and brought down to one row, the fit by zone and by bracket in one aggregation.
    """
    both = population.join(fit, ["zone_id", "bracket"], "left").withColumn("r", F.col("fitted") - F.col("pop"))
    r = F.col("r")
    sides = both.groupingSets([["zone_id"], ["bracket"]], "zone_id", "bracket").agg(
        F.grouping("bracket").alias("by_zone"), F.sum(r * r).alias("rr"), F.abs(F.avg(r)).alias("b"), F.count(r).alias("n"), F.sum("fitted").alias("f"), F.sum("pop").alias("p"))
    zone, bracket = F.col("by_zone") == 1, F.col("by_zone") == 0
    rate = F.when(zone & (F.col("p") > 0), (F.col("f") / F.col("p") > 1.1).cast("double"))
    parts = [
        sides.agg(F.sqrt(F.sum(F.when(bracket, F.col("rr"))) / F.nullif(F.sum(F.when(bracket, F.col("n"))), F.lit(0))).alias("rmse"), F.max(F.when(bracket, F.col("b"))).alias("bias"),
                  F.sum(F.when(bracket, F.col("p"))).alias("p"), (100 * F.avg(rate)).alias("over")),
        voters.agg(F.sum("voters").alias("c")),
        od.agg((100 * F.avg(F.col("minutes").isNull().cast("double"))).alias("lost")),
        alpha.groupBy("zone_id").agg(F.median("alpha").alias("a")).agg(
            (100 * F.avg((F.col("a") > alpha_limit).cast("double"))).alias("high"), F.median("a").alias("mid"),
            F.when(F.count("a") >= 3, F.coalesce(F.stddev_samp("a") / F.nullif(F.avg("a"), F.lit(0.0)), F.lit(0.0))).alias("spread")),
    ]
    if history is not None:
        parts.append(history.agg(F.max(F.struct("epoch", (~F.col("converged")).cast("double").alias("x")))["x"].alias("stopped")))
    if clusters is not None:
        parts.append(clusters.agg((100 * F.avg((~F.col("has_roads")).cast("double"))).alias("bare"), F.count(F.lit(1)).alias("n_clusters")))
    one = parts[0]
    for part in parts[1:]:
        one = one.crossJoin(F.broadcast(part))  # of one row each
    most = F.greatest(F.coalesce("p", F.lit(0)), F.coalesce("c", F.lit(0)))
    gap = F.when(most > 0, 100 * F.abs(F.coalesce("p", F.lit(0)) - F.coalesce("c", F.lit(0))) / most).otherwise(0.0)
    none = F.lit(None).cast("double")
    share = F.coalesce(F.col("bias") / F.nullif("rmse", F.lit(0.0)), F.when(F.col("rmse") == 0, F.lit(0.0)))
    values = {
        "convergence": (none if history is None else F.col("stopped"), None, F.lit("1 if the fit ended without convergence")), "alpha_distribution": (F.col("high"), None, F.format_string("median %.2f, %.1f %% of zones above the limit", F.col("mid"), F.col("high"))),
        "residual_rmse": (F.col("rmse"), None, F.format_string("%.4f", F.col("rmse"))), "residual_bias": (F.col("bias"), share, F.format_string("greatest mean residual is %.4f, %.1f %% of the rmse", F.col("bias"), 100 * share)),
        "population_voter_gap": (gap, None, F.format_string("%.0f persons, %.0f voters, %.1f %% apart", F.col("p").cast("double"), F.col("c").cast("double"), gap)), "unreachable_pairs": (F.col("lost"), None, F.format_string("%.1f %% of pairs", F.col("lost"))),
        "alpha_variation": (F.col("spread"), None, F.format_string("variation of the median alpha is %.3f", F.col("spread"))), "implied_turnout": (F.col("over"), None, F.format_string("%.1f %% of zones above 110 %%", F.col("over"))),
        "representative_points": (none if clusters is None else F.col("bare"), None, F.lit("no clusters") if clusters is None else F.format_string("%d clusters, %.0f %% of them without roads", F.col("n_clusters"), F.col("bare"))),
    }
    rows = []
    for name, warn, fail in CHECKS:
        value, judged, detail = values[name]
        judged = value if judged is None else judged
        status = F.when(judged.isNull(), "skip")
        if name == "alpha_variation":
            status = status.when(judged < 0.1, "warn")
        if fail is not None:
            status = status.when(judged > fail, "fail")
        if warn is not None:
            status = status.when(judged > warn, "warn")
        rows.append(F.struct(F.lit(name).alias("check"), status.otherwise("pass").alias("status"), detail.alias("detail"), value.cast("double").alias("value")))
    return one.select(F.inline(F.array(*rows)))


def weight_summary(weights: DataFrame, od: DataFrame) -> DataFrame:
    """One row per zone: dominant source and its weight, weight of the first three, entropy, effective number, concentration, and weighted minutes, as a sum and divided by the weight. Ties go to the lower source."""
    order = Window.partitionBy("zone_id").orderBy(F.desc("w"), "source_id")
    ranked = weights.join(od, ["zone_id", "source_id"], "left").withColumn("n", F.row_number().over(order))
    top = ranked.groupBy("zone_id").agg(
        F.max(F.when(F.col("n") == 1, F.col("source_id"))).alias("dominant_source"), F.max(F.when(F.col("n") == 1, F.col("w"))).alias("dominant_weight"),
        F.sum(F.when(F.col("n") <= 3, F.col("w"))).alias("top3_weight"), F.sum(F.col("w") * F.col("minutes")).alias("weighted_minutes"), F.sum("w").alias("all"))
    top = top.withColumn("weighted_minutes_norm", F.col("weighted_minutes") / F.nullif("all", F.lit(0.0))).drop("all")
    return top.join(row_entropy(weights), "zone_id")


def connections(weights: DataFrame, threshold: float = 0.0, top_k: int | None = None) -> DataFrame:
    """Pairs of weight above a threshold, of each zone the ``top_k`` heaviest (all if None), with their rank."""
    order = Window.partitionBy("zone_id").orderBy(F.desc("w"), "source_id")
    out = weights.filter(F.col("w") > threshold).withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.filter(F.col("rank") <= top_k)


def cumulative(weights: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("zone_id").orderBy(F.desc("w"), "source_id")
    running = F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return weights.withColumn("rank", F.row_number().over(order)).withColumn("cumulative", running).filter(F.col("rank") <= k)


def source_summary(weights: DataFrame, od: DataFrame) -> DataFrame:
    """One row per source: sum of weights, share of all, zones that it dominates, weighted mean minutes."""
    order = Window.partitionBy("zone_id").orderBy(F.desc("w"), "source_id")
    rows = weights.join(od, ["zone_id", "source_id"], "left").withColumn("n", F.row_number().over(order))
    out = rows.groupBy("source_id").agg(F.sum("w").alias("total"), F.count_if(F.col("n") == 1).alias("n_dominant"), (F.sum(F.col("w") * F.col("minutes")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean_minutes"))
    return out.join(F.broadcast(out.agg(F.sum("total").alias("all"))), how="cross").withColumn("share", F.col("total") / F.col("all")).drop("all")


def json_row(*keys: str, **values: Column) -> Column:
    """A row as JSON: the given columns and values in order, numbers already written with fixed decimals as text, missing values as null."""
    fields = [F.col(k).alias(k) for k in keys] + [v.alias(k) for k, v in values.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def top_zones(weights: DataFrame, od: DataFrame, k: int = 10) -> DataFrame:
    """(source_id, rank, zone_id, w, minutes): of each source the ``k`` zones that it reaches with most weight, ties to the lower zone."""
    order = Window.partitionBy("source_id").orderBy(F.desc("w"), "zone_id")
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).join(od, ["zone_id", "source_id"], "left").select("source_id", "rank", "zone_id", "w", "minutes")


def default_zone(weights: DataFrame, digits: int = 9) -> DataFrame:
    """(zone_id): the zone whose weight is spread most, by entropy to so many digits, the lower id among equals; none without weights. One aggregate over zones, no sort."""
    h = row_entropy(weights)
    return h.agg(F.min(F.struct((-F.round("entropy", digits)).alias("h"), "zone_id")).alias("b")).filter(F.col("b").isNotNull()).select("b.zone_id")


def best_epoch(history: DataFrame) -> DataFrame:
    """(epoch, loss) of least loss, the first among equals."""
    return history.agg(F.min(F.struct("loss", "epoch")).alias("b")).select("b.epoch", "b.loss")


def min_ranks(values: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Rows with the rank of their value, the greatest first, ties with the least rank; nulls have none. Ranks are found over distinct values, see ``running``."""
    values = cut_lineage(values)  # joined back by value, so worked out once
    counts = values.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    below = running(counts, [F.desc(value)], "_n", "_before").select(value, (F.col("_before") + 1).cast("int").alias(name))
    return values.join(below, value, "left")


def running(rows: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """Rows with the sum of ``amount`` over all rows before them in an order without ties.

    Two levels: rows are split into ranges of the order, each summed by itself; the sums of the ranges before, one number for
    each range, are added. No task sorts more than its range.
    """
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    split = rows.repartitionByRange(int(parts), *order).withColumn("_part", F.spark_partition_id())
    split = split.withColumn("_in", F.coalesce(F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    split = cut_lineage(split)  # the sampled bounds of the ranges must not be drawn twice
    whole = split.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = whole.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return split.join(F.broadcast(before), "_part").withColumn(name, F.col("_in") + F.col("_ahead")).drop("_part", "_in", "_ahead")


def frequent_or_other(rows: DataFrame, c: str, k: int = 19) -> DataFrame:
    """(c, n): the k most frequent values, ties by value, and the rest as Other."""
    counts = rows.groupBy(F.col(c).cast("string").alias(c)).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), c).limit(k).select(c, F.lit(True).alias("_top"))
    return counts.join(F.broadcast(top), c, "left").groupBy(F.when(F.col("_top"), F.col(c)).otherwise("Other").alias(c)).agg(F.sum("n").alias("n"))


def lookback(history: DataFrame, patience: int) -> DataFrame:
    """History with the loss ``patience`` epochs before, the relative change since, and the mean of the last 100 losses. One row per epoch: a history is as long as one fit."""
    order = Window.orderBy("epoch")
    out = history.withColumn("before", F.lag("loss", patience).over(order)).withColumn("mean_100", F.avg("loss").over(order.rowsBetween(-99, 0)))
    return out.withColumn("change", F.abs(F.col("loss") - F.col("before")) / F.nullif(F.abs("before"), F.lit(0.0)))


def learning_rates(epochs: DataFrame, rate: float, t0: int = 500, growth: int = 2, floor: float = 0.01, decay: float = 0.7) -> DataFrame:
    """(epoch, cycle, lr): cosine with warm restarts in closed form: cycle k lasts t0 growth^k epochs and starts at rate decay^k."""
    e = F.col("epoch") - 1
    cycle = F.floor(F.log(e / t0 * (growth - 1) + 1 + 1e-12) / F.log(F.lit(float(growth)))).cast("int")
    start = t0 * (F.pow(F.lit(float(growth)), F.col("cycle")) - 1) / (growth - 1)
    peak = F.lit(rate) * F.pow(F.lit(decay), F.col("cycle"))
    along = (e - start) / (t0 * F.pow(F.lit(float(growth)), F.col("cycle")))
    return epochs.withColumn("cycle", cycle).withColumn("lr", peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * along))))
