"""Distance-decay weights that hand out each source in full, and what is interpolated with them.

All tables are long and keyed: od(zone_id, source_id, minutes), population(zone_id, bracket, pop),
voters(source_id, bracket, voters), alpha(zone_id, bracket, alpha). A null minute is an unreachable pair; its weight is exactly 0, so it has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_SUM = 0.5


def log_kernel(minutes: Column, alpha: Column, kernel: str = "power", offset: float = 1.0) -> Column:
    """-alpha ln(t + offset), or -alpha t, for which the offset does not count."""
    if kernel == "power":
        return -alpha * F.log(minutes + F.lit(float(offset)))
    if kernel == "exponential":
        return -alpha * minutes
    raise ValueError("kernel must be power or exponential")


def with_offset(od: DataFrame, offset: float) -> DataFrame:
    """Travel times with the offset added; pairs without a time stay so."""
    if not 0 <= offset < float("inf"):
        raise ValueError("offset must be finite and not negative")
    return od.withColumn("minutes", F.col("minutes") + F.lit(float(offset)))


def faults(od: DataFrame, kernel: str = "power", offset: float = 1.0) -> DataFrame:
    """(n, n_null, n_nan, n_infinite, n_negative, n_bad): one row that counts the pairs whose minutes are missing or wrong; bad is what the kernel cannot take."""
    t = F.col("minutes")
    bad = (t < 0) | F.isnan(t) | (t == float("inf"))
    if kernel == "power":
        bad |= t + offset <= 0
    return od.agg(F.count(F.lit(1)).alias("n"), F.count_if(t.isNull()).alias("n_null"), F.count_if(F.isnan(t)).alias("n_nan"), F.count_if(t == float("inf")).alias("n_infinite"), F.count_if(t < 0).alias("n_negative"), F.count_if(bad).alias("n_bad"))


def check_od(od: DataFrame, kernel: str, offset: float) -> None:
    """Eager check of the whole table in one pass: infinite, NaN or negative minutes, or an offset that leaves no logarithm."""
    if offset < 0 or offset != offset or offset == float("inf"):
        raise ValueError("offset must be finite and not negative")
    if n := faults(od, kernel, offset).first().n_bad:
        raise ValueError(f"{n} pairs have minutes that the {kernel} kernel cannot take")


def populated(population: DataFrame, least: float) -> DataFrame:
    """(zone_id, pop) of zones that hold at least ``least`` in all brackets together."""
    return population.groupBy("zone_id").agg(F.sum("pop").alias("pop")).filter(F.col("pop") >= least)


def row_targets(population: DataFrame, n_sources: DataFrame) -> DataFrame:
    """(zone_id, target): the number of sources shared out by population. n_sources: one row (n)."""
    zones = population.groupBy("zone_id").agg(F.sum("pop").alias("p"))
    total = zones.agg(F.sum("p").alias("all")).crossJoin(F.broadcast(n_sources))
    return zones.crossJoin(F.broadcast(total)).select("zone_id", (F.col("p") / F.nullif("all", F.lit(0)) * F.col("n")).alias("target"))


def uniform_fit(population: DataFrame, voters: DataFrame) -> DataFrame:
    """(zone_id, bracket, fitted): each bracket's voters shared out equally over the zones."""
    n = population.agg(F.count_distinct("zone_id").alias("n"))
    each = voters.groupBy("bracket").agg(F.sum("voters").alias("v")).crossJoin(F.broadcast(n)).select("bracket", (F.col("v") / F.nullif("n", F.lit(0))).alias("fitted"))
    return population.join(F.broadcast(each), "bracket").select("zone_id", "bracket", "fitted")


def compared(fits: list[tuple[str, DataFrame]], population: DataFrame) -> DataFrame:
    """(model, rmse, deviance) of several fits (zone_id, bracket, fitted) against the population."""
    out = None
    for name, fit in fits:
        both = population.join(fit, ["zone_id", "bracket"])
        r = F.col("fitted") - F.col("pop")
        row = both.agg(F.sqrt(F.avg(r * r)).alias("rmse"), poisson_deviance(F.col("fitted"), F.col("pop")).alias("deviance")).select(F.lit(name).alias("model"), "rmse", "deviance")
        out = row if out is None else out.unionByName(row)
    return out


def active_brackets(population: DataFrame, voters: DataFrame) -> DataFrame:
    """(bracket, c_total): brackets in which both sides hold at least one half."""
    p = population.groupBy("bracket").agg(F.sum("pop").alias("p")).filter(F.col("p") >= LEAST_SUM)
    return voters.groupBy("bracket").agg(F.sum("voters").alias("c_total")).filter(F.col("c_total") >= LEAST_SUM).join(p, "bracket", "left_semi")


def normalised(pairs: DataFrame, by: list[str], log_k: Column) -> DataFrame:
    """Pairs with w = exp(log_k) shared within ``by`` so that it sums to 1: the maximum is taken out first, so nothing underflows.

    One shuffle and one pass over the pairs, which are far too many to be worked out again for an aggregate and its join. A group is the
    pairs of one source and so has at most as many rows as there are zones; the window spills.
    """
    group = Window.partitionBy(*by)
    shifted = pairs.withColumn("lk", log_k).withColumn("e", F.exp(F.col("lk") - F.max("lk").over(group)))
    return shifted.withColumn("w", F.col("e") / F.sum("e").over(group)).drop("lk", "e")


def bracket_weights(od: DataFrame, alpha: DataFrame | float, brackets: DataFrame, kernel: str = "power", offset: float = 1.0) -> DataFrame:
    """(zone_id, source_id, bracket, w), sum of w over zones = 1 for each source and bracket with a reachable zone.

    alpha: a number for all, or a table by zone and bracket, of zones times brackets rows.
    """
    reachable = od.filter(F.col("minutes").isNotNull())
    if isinstance(alpha, (int, float)):
        # without a bracket in alpha the weights are the same in all of them: normalise first, repeat after
        w = normalised(reachable, ["source_id"], log_kernel(F.col("minutes"), F.lit(float(alpha)), kernel, offset))
        return w.join(F.broadcast(brackets.select("bracket")), how="cross").select("zone_id", "source_id", "bracket", "w")
    pairs = reachable.join(alpha.join(brackets.select("bracket"), "bracket", "left_semi"), "zone_id")
    return normalised(pairs, ["source_id", "bracket"], log_kernel(F.col("minutes"), F.col("alpha"), kernel, offset)).select("zone_id", "source_id", "bracket", "w")


def aggregate_weights(weights: DataFrame, voters: DataFrame, brackets: DataFrame) -> DataFrame:
    """(zone_id, source_id, w): mean over active brackets weighted by the source's voters; a source without voters takes the plain mean. Shares are taken over voters, which have one row for each source and bracket, not over weights."""
    held = voters.join(brackets.select("bracket"), "bracket", "left_semi")
    total = Window.partitionBy("source_id")
    share = held.withColumn("all", F.sum("voters").over(total)).withColumn("n", F.count(F.lit(1)).over(total)).select(
        "source_id", "bracket", F.when(F.col("all") > 0, F.col("voters") / F.col("all")).otherwise(1 / F.col("n")).alias("share"))
    return weights.join(share, ["source_id", "bracket"]).groupBy("zone_id", "source_id").agg(F.sum(F.col("w") * F.col("share")).alias("w"))


def weight_matrix(od: DataFrame, alpha: DataFrame | float, population: DataFrame, voters: DataFrame, kernel: str = "power", offset: float = 1.0) -> DataFrame:
    brackets = active_brackets(population, voters)
    return aggregate_weights(bracket_weights(od, alpha, brackets, kernel, offset), voters, brackets)


def column_standardised(weights: DataFrame, value: str = "k") -> DataFrame:
    """Values divided by their sum over the zones of a source; a source whose sum is 0 keeps its zeros."""
    total = F.sum(value).over(Window.partitionBy("source_id"))
    return weights.withColumn("w", F.col(value) / F.when(total == 0, F.lit(1.0)).otherwise(total))


def fitted(weights: DataFrame, voters: DataFrame) -> DataFrame:
    """(zone_id, bracket, fitted): what each zone gets of each bracket."""
    return weights.join(voters, ["source_id", "bracket"]).groupBy("zone_id", "bracket").agg(F.sum(F.col("w") * F.col("voters")).alias("fitted"))


def interpolated(weights: DataFrame, values: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """(zone_id, variable, value) of long source values (source_id, variable, value).

    zones: all zones; those that no weight reaches come back with a null value for each variable.
    """
    out = weights.join(values, "source_id").groupBy("zone_id", "variable").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    if zones is None:
        return out
    grid = zones.select("zone_id").join(F.broadcast(values.select("variable").distinct()), how="cross")
    return grid.join(out, ["zone_id", "variable"], "left")


def poisson_deviance(fit: Column, observed: Column) -> Column:
    """2 sum(f - o ln f) plus its constant 2 sum(o ln o - o), f kept from 0."""
    f = F.greatest(fit, F.lit(1e-30))
    o_ln_o = F.when(observed > 0, observed * F.log(F.greatest(observed, F.lit(1e-300)))).otherwise(0.0)
    return 2 * F.sum(f - observed * F.log(f)) + 2 * F.sum(o_ln_o - observed)


def log_barrier(fit: DataFrame, mu: float = 1.0) -> DataFrame:
    """(barrier): -mu sum over zones of ln of what a zone gets in all brackets."""
    zones = fit.groupBy("zone_id").agg(F.sum("fitted").alias("f"))
    return zones.agg((-mu * F.sum(F.log(F.greatest(F.col("f"), F.lit(1e-30))))).alias("barrier"))


def row_entropy(weights: DataFrame) -> DataFrame:
    """(zone_id, entropy, effective_n, herfindahl) of a zone's weights, made to sum to 1; a zone without weight has 0, 1 and 0. One aggregation: with s the sum, the entropy is ln s - sum(w ln w) / s."""
    w = F.col("w")
    sums = weights.groupBy("zone_id").agg(F.sum("w").alias("s"), F.sum(F.when(w > 0, w * F.log(w)).otherwise(0.0)).alias("q"), F.sum(w * w).alias("d"))
    h = F.when(F.col("s") > 0, F.greatest(F.log("s") - F.col("q") / F.col("s"), F.lit(0.0))).otherwise(0.0)
    return sums.select("zone_id", h.alias("entropy"), F.exp(h).alias("effective_n"), F.when(F.col("s") > 0, F.col("d") / (F.col("s") * F.col("s"))).otherwise(0.0).alias("herfindahl"))
