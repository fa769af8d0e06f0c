"""What is derived from an interpolation: quantities, residuals, summaries, looked-up variables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasymetra.functions.text import name_key
from dasymetra.operators.votes import column_parts

EPS = 2.220446049250313e-16
QUANTITIES = ("absolute", "pct_tract", "pct_muni", "pct_valid", "pct_eligible", "density")


@dataclass
class Interpolation:
    """The tables of one interpolation, all long: zones' values, weights, alpha, fitted brackets, the dictionary of variables and the fit by epoch."""

    values: DataFrame
    weights: DataFrame
    fitted: DataFrame
    alpha: DataFrame | None = None
    dictionary: DataFrame | None = None
    meta: dict[str, Any] = field(default_factory=dict)
    history: DataFrame | None = None


def quantity(value: Column, kind: str, turnout: Column | None = None, blank: Column | None = None, null: Column | None = None, eligible: Column | None = None, km2: Column | None = None) -> Column:
    """A derived measure of a variable; null where what it is divided by is 0, or for valid votes not above 0. pct_muni needs the total: see ``with_quantity``."""
    if kind == "absolute":
        return value
    if kind == "pct_muni":
        raise ValueError("a share of the town needs a pass over all zones: use with_quantity")
    if kind == "density":
        return value / F.when(km2 != 0, km2)
    if kind == "pct_valid":
        valid = turnout - F.coalesce(blank, F.lit(0)) - F.coalesce(null, F.lit(0))
        return 100 * value / F.when(valid > 0, valid)
    divisor = {"pct_tract": turnout, "pct_eligible": eligible}[kind]
    return 100 * value / F.when(divisor != 0, divisor)


def with_quantity(rows: DataFrame, value: str, kind: str, name: str = "quantity", **columns: Column) -> DataFrame:
    """Rows with a derived measure; the town's total is one aggregate, of which one row goes to all tasks."""
    if kind != "pct_muni":
        return rows.withColumn(name, quantity(F.col(value), kind, **columns))
    total = rows.agg(F.sum(value).alias("_total"))
    return rows.crossJoin(F.broadcast(total)).withColumn(name, 100 * F.col(value) / F.nullif("_total", F.lit(0))).drop("_total")


def residual(fit: Column, observed: Column, kind: str = "raw") -> Column:
    """fitted less observed, or its Pearson or deviance form; null where nothing was fitted."""
    raw = fit - observed
    f = F.greatest(fit, F.lit(EPS))
    if kind == "raw":
        return raw
    if kind == "pearson":
        return raw / F.sqrt(f)
    part = observed * F.log(F.greatest(observed / f, F.lit(EPS))) - (observed - fit)
    return F.when(fit.isNull(), F.lit(None)).otherwise(F.signum(raw) * F.sqrt(2 * F.greatest(part, F.lit(0.0))))


def residuals(fit: DataFrame, population: DataFrame, kind: str = "raw") -> DataFrame:
    """(zone_id, bracket, residual) of every zone and bracket with a population."""
    both = population.join(fit, ["zone_id", "bracket"], "left")
    return both.select("zone_id", "bracket", residual(F.col("fitted"), F.col("pop"), kind).alias("residual"))


def residuals_by_bracket(r: DataFrame) -> DataFrame:
    """mean, rmse, greatest size and the share of residuals beyond two standard deviations, in one pass and a join of one row per bracket."""
    x = F.col("residual")
    base = r.groupBy("bracket").agg(F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rmse"), F.max(F.abs(x)).alias("max_abs"), F.stddev_samp(x).alias("sd"))
    beyond = r.join(F.broadcast(base.select("bracket", "sd")), "bracket").groupBy("bracket").agg((100 * F.avg((F.abs(x) > 2 * F.col("sd")).cast("double"))).alias("pct_beyond"))
    return base.drop("sd").join(beyond, "bracket")


def residuals_by_zone(r: DataFrame) -> DataFrame:
    """mean, rmse and the bracket of greatest size, the first by name among equals."""
    x = F.col("residual")
    worst = F.min(F.when(x.isNotNull(), F.struct((-F.abs(x)).alias("a"), "bracket")))
    return r.groupBy("zone_id").agg(F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rmse"), worst["bracket"].alias("worst_bracket"))


def collapsed(rows: DataFrame, value: str, how: str, weight: str | None = None) -> DataFrame:
    """(zone_id, value): one number for a zone's brackets."""
    v = F.col(value)
    forms = {
        "median": F.median(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "range": F.max(v) - F.min(v), "rmse": F.sqrt(F.avg(v * v)),
        "mean_abs": F.avg(F.abs(v)), "max_abs": F.max(F.abs(v)),
        "weighted": F.sum(v * F.col(weight)) / F.nullif(F.sum(F.when(v.isNotNull(), F.col(weight))), F.lit(0)) if weight else None,
    }
    if forms.get(how) is None:
        raise ValueError(f"unknown form {how}, or no weight given")
    return rows.groupBy("zone_id").agg(forms[how].alias(how))


def summary(values: DataFrame) -> DataFrame:
    return values.groupBy("variable").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


def from_columns(columns: DataFrame) -> DataFrame:
    """A dictionary read from the names of columns (column) alone: type, ballot number and party."""
    kind, ballot, party, cargo = column_parts(F.col("column"))
    return columns.select("column", kind, ballot, party, cargo, F.lit(None).cast("string").alias("candidate_name"))


def resolve(dictionary: DataFrame | None, wanted: str | int, columns: DataFrame | None = None) -> DataFrame:
    """(column, priority) of the best matches: 1 the column itself, 2 a ballot number, 3 a party, 4 part of a name. No row means none; more than one is ambiguous.

    columns: (column), those that there are; what the dictionary does not know of a ballot or party is read from their names, after what it does.
    A number stands for a ballot alone, unless a column is called so.
    """
    w = str(wanted).strip()
    number = w.lstrip("0") or "0" if w.isdigit() else None
    parts = []
    if dictionary is not None:
        by_name = F.lit(False) if number else F.coalesce(F.contains(name_key(F.col("candidate_name")), name_key(F.lit(w))), F.lit(False))
        by_party = F.lit(False) if number else (F.upper("party") == w.upper()) & (F.col("type") == "party")
        order = F.when(F.col("column") == w, 1.0).when(F.lit(number is not None) & (F.col("ballot_number") == number), 2.0).when(by_party, 3.0).when(by_name, 4.0)
        parts.append(dictionary.select("column", order.alias("order")))
    if columns is not None:
        read = from_columns(columns)
        ballot = F.lit(number is not None) & (F.col("ballot_number") == number)
        order = F.when(F.col("column") == w, 1.0).when(ballot, 2.5).when(F.lit(number is None) & (F.col("column") == f"PARTY_{w.upper()}"), 3.5)
        parts.append(read.select("column", order.alias("order")))
    if not parts:
        raise ValueError("a dictionary or columns are needed")
    found = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).filter(F.col("order").isNotNull())
    best = found.join(F.broadcast(found.agg(F.min("order").alias("order"))), "order", "left_semi")
    return best.select("column", F.floor("order").cast("int").alias("priority")).distinct()


#: Matches that a message names.
NAMED = 8


def resolved(dictionary: DataFrame | None, wanted: str | int, allow_multiple: bool = False, columns: DataFrame | None = None) -> list[str]:
    """The matching columns, all of them; none, or several where one is wanted, are errors, of which the message names the first few."""
    found = [r.column for r in resolve(dictionary, wanted, columns).orderBy("column").collect()]
    named = ", ".join(found[:NAMED]) + (f" ... and {len(found) - NAMED} more" if len(found) > NAMED else "")
    if not found:
        there = [] if columns is None else [r.column for r in columns.orderBy("column").limit(NAMED).collect()]
        raise KeyError(f"nothing matches {wanted!r}" + (f"; there are {', '.join(there)}" if there else ""))
    if len(found) > 1 and not allow_multiple:
        raise KeyError(f"{wanted!r} may be any of {named}")
    return found


def implied_turnout(fit: DataFrame, population: DataFrame) -> DataFrame:
    """(zone_id, bracket, rate): fitted voters per person; null without persons."""
    both = population.join(fit, ["zone_id", "bracket"], "left")
    return both.select("zone_id", "bracket", F.when(F.col("pop") > 0, F.col("fitted") / F.greatest("pop", F.lit(1))).alias("rate"))
