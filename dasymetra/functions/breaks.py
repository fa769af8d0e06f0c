"""Class breaks and classes of values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasymetra.operators.diagnostics import running

#: Distinct values at most on which natural breaks are worked out by the driver.
JENKS_VALUES = 1_000_000


def breaks(values: DataFrame, c: str, method: str | list[float] = "quantile", n: int = 5, tidy: bool = True) -> list[float]:
    """Ends of n classes: quantiles of type 7, natural breaks, equal steps, or given numbers. None without values. tidy: rounded, see ``clean``.

    Natural breaks are exact: distinct values and how often each is held reach the driver; more than JENKS_VALUES of them are an error.
    """
    if isinstance(method, list):
        return sorted(method)
    known = values.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).select(F.col(c).cast("double").alias("v"))
    share = [i / n for i in range(n + 1)]
    if method == "quantile":
        ends = quantiles(known, "v", share)
    elif method == "equal":
        row = known.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
        ends = [] if row.a is None else [row.a + (row.b - row.a) * x for x in share]
    elif method == "jenks":
        rows = known.groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(JENKS_VALUES + 1).toPandas().sort_values("v")
        if len(rows) > JENKS_VALUES:
            raise ValueError(f"more than {JENKS_VALUES} distinct values for natural breaks: round them, or choose another method")
        ends = natural(rows["v"].tolist(), n, rows["n"].tolist()) if len(rows) else []
    else:
        raise ValueError(f"unknown method {method}")
    return clean(ends) if tidy else sorted(set(ends))


def quantiles(values: DataFrame, c: str, shares: list[float]) -> list[float]:
    """Exact quantiles of type 7 at a few shares; none without values. Distinct values are counted and their ranks found range by range, so no task holds them all; two numbers a share reach the driver."""
    counts = values.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(counts, [F.col("v")], "n", "before")
    total = ranked.agg(F.sum("n")).first()[0]
    if not total:
        return []
    at = [(total - 1) * s for s in shares]
    wanted = sorted({k for x in at for k in (int(np.floor(x)), int(np.ceil(x)))})
    held = F.filter(F.array(*[F.lit(k) for k in wanted]), lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
    found = {k: r.v for r in ranked.select("v", held.alias("k")).filter(F.size("k") > 0).collect() for k in r.k}
    return [found[int(np.floor(x))] + (found[int(np.ceil(x))] - found[int(np.floor(x))]) * (x - np.floor(x)) for x in at]


def natural(x: list[float], n: int, counts: list[float] | None = None) -> list[float]:
    """Ends of the n groups of sorted values, each held ``counts`` times, with the least sum of squares within.

    Exact, by dynamic programming; where a group best starts never falls as its end moves on, so that the
    starts are found by halving: n N log N steps for N values.
    """
    v = np.asarray(x, float)
    k = np.ones(len(v)) if counts is None else np.asarray(counts, float)
    n, size = min(n, len(v)), len(v)
    d = v - (v * k).sum() / k.sum()
    w, s, q = (np.concatenate([[0.0], np.cumsum(y)]) for y in (k, k * d, k * d * d))
    cost = lambda i, j: np.maximum(q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i]), 0.0)
    best, cuts = np.full(size + 1, np.inf), []
    best[1:] = cost(np.zeros(size, int), np.arange(1, size + 1))
    for group in range(2, n + 1):
        best, at = _next_group(best, cost, group, size)
        cuts.append(at)
    ends, j = [size - 1], size
    for at in reversed(cuts):
        j = at[j]
        ends.append(j - 1)
    return sorted({float(v[e]) for e in [0, *ends]})


def _next_group(best: np.ndarray, cost, group: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least costs of the first j values in ``group`` groups, and where the last of them starts; spans of j are halved level by level."""
    now, at = np.full(size + 1, np.inf), np.zeros(size + 1, int)
    spans = np.array([[group, size, group - 1, size - 1]])
    while len(spans):
        first, last, low, high = spans.T
        mid = (first + last) // 2
        high_here = np.minimum(high, mid - 1)
        many = high_here - low + 1
        starts = np.cumsum(many) - many
        i = np.arange(many.sum()) - np.repeat(starts, many) + np.repeat(low, many)
        value = best[i] + cost(i, np.repeat(mid, many))
        least = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == np.repeat(least, many))
        chosen = i[hit[np.searchsorted(hit, starts)]]
        now[mid], at[mid] = least, chosen
        spans = np.concatenate([np.column_stack([first, mid - 1, low, chosen]), np.column_stack([mid + 1, last, chosen, high])])
        spans = spans[spans[:, 0] <= spans[:, 1]]
    return now, at


def clean(ends: list[float]) -> list[float]:
    """Sorted breaks, those nearer than a billionth of the range merged, then rounded to as few significant digits, from 3 to 8, as keep all of them apart; what is next to zero then becomes zero."""
    ends = sorted(set(map(float, ends)))
    if len(ends) < 2:
        return ends
    gap = (ends[-1] - ends[0]) * 1e-9
    kept = [ends[0]] + [b for a, b in zip(ends, ends[1:]) if b - a > gap]
    for digits in range(3, 9):
        short = [float(f"{e:.{digits - 1}e}") for e in kept]
        span = max(short) - min(short)
        short = list(dict.fromkeys(0.0 if span > 0 and abs(e) < span * 1e-4 else e for e in short))
        if len(short) >= len(kept):
            return short
    return kept


def classed(value: Column, ends: list[float]) -> Column:
    """Number of the class of a value: right ends belong to it, the least value to the first; below and above all breaks count with the outer classes. One class if there are fewer than two breaks."""
    if len(ends) < 3:
        return F.when(value.isNotNull(), F.lit(1))
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for k, end in enumerate(ends[1:-1], 1):
        out = out.when(value <= end, k)
    return out.otherwise(len(ends) - 1)


def labels(ends: list[float], quantity: str = "absolute") -> list[str]:
    """A label per class: whole numbers, or for shares and densities as many decimals, from 1 to 6, as keep the breaks apart; an open end is below or above its other end."""
    share = quantity.startswith("pct_")
    suffix = "%" if share else "/km²" if quantity == "density" else ""
    digits = 0
    if share or quantity == "density":
        known = [e for e in ends if np.isfinite(e)]
        digits = next((n for n in range(1, 7) if len({f"{e:.{n}f}" for e in known}) == len(known)), 6)
    shown = [f"{e:,.{digits}f}" for e in ends]
    name = lambda a, b, lo, hi: f"<{hi}" if a == -np.inf else f">{lo}" if b == np.inf else f"{lo}–{hi}"
    return [name(a, b, lo, hi) + suffix for a, b, lo, hi in zip(ends, ends[1:], shown, shown[1:])]
