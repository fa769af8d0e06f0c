"""Mixing of sources to target shares of tokens, by nested thresholds on a hash."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The hash has 60 bits; each level of the histogram splits 12 of them.
HASH_BITS = 60
BITS = 12
#: Sources that a table of targets may name at most; their budgets are held by the driver and sent to all executors.
MOST_TARGETS = 100_000


@dataclass(frozen=True)
class Budget:
    source: str
    available: int
    tokens: int

    @property
    def whole(self) -> int:
        return self.tokens // self.available

    @property
    def rest(self) -> int:
        return self.tokens % self.available


def hash60(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - HASH_BITS)


def _wanted(targets: DataFrame) -> DataFrame:
    share = F.when((F.col("target_share") > 0) & ~F.isnan(F.col("target_share").cast("double")), F.col("target_share").cast("double")).otherwise(F.lit(0.0))
    return targets.filter(F.col("source").isNotNull()).groupBy("source").agg(F.sum(share).alias("target_share"), F.min("max_repeats").alias("max_repeats"))


def _available(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("source").agg(F.sum(F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0))).cast("bigint").alias("available_tokens"), F.count(F.lit(1)).alias("available_records"))


def budgets(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[Budget]:
    """The tokens each usable source contributes.

    sizes: (id, source, n_tokens). targets: (source, target_share, max_repeats). A source is usable with
    tokens, a share above 0 and max_repeats of 1 or more; the others contribute nothing, and the shares of
    the usable ones are taken in proportion to their sum. A target given twice counts with the sum of its
    shares and the least of its max_repeats; null and NaN shares count as 0; a null source is no target.
    Without ``total`` the mixture is the largest in which each usable source fills its share within
    max_repeats. With it, a source that max_repeats keeps below its share of the total gives all it may.
    """
    want = _wanted(targets).filter((F.col("target_share") > 0) & (F.col("max_repeats") >= 1))
    rows = want.join(_available(sizes), "source").filter(F.col("available_tokens") > 0).orderBy("source").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources have a target")
    if not rows:
        return []
    share = math.fsum(r.target_share for r in rows)
    most = [r.available_tokens * r.max_repeats for r in rows]
    whole = min(m / (r.target_share / share) for m, r in zip(most, rows)) if total is None else float(total)
    # half a millionth of the budget keeps rounding from leaving out the last record of a source that is used up
    return [Budget(r.source, r.available_tokens, min(m, int(r.target_share / share * whole * (1 + 5e-13) + 1e-6))) for m, r in zip(most, rows)]


def thresholds(sizes: DataFrame, plan: list[Budget]) -> dict[str, int]:
    """For each source the hash below which its records fill the rest of its budget that whole repeats leave.

    Level by level, tokens are summed by source and bucket of the hash within the range that is still
    open, at first all of it; the first bucket that the rest cannot pay in full is the next range. A level
    scans ids, sources and sizes, of which only the records of its range are summed, and returns one row per source; ranges are narrowed until
    one hash is left, mostly after two levels.
    """
    spark = sizes.sparkSession
    low, rest = {b.source: 0 for b in plan}, {b.source: b.rest for b in plan}
    open_ = [b.source for b in plan if b.rest > 0]
    for level in range(HASH_BITS // BITS):
        if not open_:
            break
        width = 1 << (HASH_BITS - BITS * (level + 1))
        state = spark.createDataFrame([(s, low[s], rest[s]) for s in open_], "source string, low bigint, rest bigint")
        inside = sizes.select("source", hash60(F.col("id")).alias("h"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).alias("n")).join(F.broadcast(state), "source")
        inside = inside.filter((F.col("h") >= F.col("low")) & (F.col("h") - F.col("low") < width << BITS))
        histogram = inside.groupBy("source", "low", "rest", F.expr(f"(h - low) div {width}L").alias("bucket")).agg(F.sum("n").alias("tokens"), F.min("h").alias("first"), F.max("h").alias("last"))
        before = F.coalesce(F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # at most 4096 buckets of a source; without such a bucket all of the range fits
        edge = histogram.withColumn("before", before).filter(F.col("before") + F.col("tokens") > F.col("rest"))
        edge = edge.groupBy("source").agg(F.min(F.struct("bucket", "before", "first", "last")).alias("e")).select("source", "e.*").collect()
        found = {e.source: e for e in edge}
        still = []
        for s in open_:
            e = found.get(s)
            if e is None:
                low[s] += width << BITS
                continue
            low[s] += e.bucket * width
            rest[s] -= e.before
            if e.first < e.last and rest[s] > 0:
                still.append(s)
        open_ = still
    return low


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """(id, source, n_tokens, repeats): every record that the mixture uses, and how often.

    sizes: (id, source, n_tokens), materialised, as each level reads it. A source whose budget is k times its
    tokens and a rest uses each record k times, and once more where the hash of its id lies below the
    source's threshold; nothing is sorted. A source stays within its budget and short of it by less than the
    tokens of the records that share one hash. Thresholds nest: a larger total keeps what a smaller one
    uses. Rows with equal ids, null ids too, go in or out together; null or negative tokens count as 0.
    Without usable source the result is empty.
    """
    plan = budgets(sizes, targets, total)
    low = thresholds(sizes, plan)
    chosen = sizes.sparkSession.createDataFrame([(b.source, b.whole, low[b.source]) for b in plan], "source string, whole bigint, low bigint")
    repeats = F.col("whole") + (hash60(F.col("id")) < F.col("low")).cast("bigint")
    return sizes.join(F.broadcast(chosen), "source").withColumn("repeats", repeats).filter(F.col("repeats") > 0).select("id", "source", "n_tokens", "repeats")


def shares(sizes: DataFrame, targets: DataFrame, mixture: DataFrame) -> DataFrame:
    """One row per source of the data or the targets: what was asked, what there is, and what the mixture reaches.

    The null source of the data is a row of its own. actual_share is null if the mixture is empty.
    """
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).cast("bigint").alias("used_tokens"), F.count(F.lit(1)).alias("used_records"), F.max("repeats").alias("most_repeats"))
    all_tokens = used.agg(F.sum("used_tokens").alias("mixture_tokens"))
    have, want = _available(sizes), _wanted(targets)
    both = have.join(want, "source", "full").join(used, "source", "left").join(F.broadcast(all_tokens), how="left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return both.select("source", "target_share", "max_repeats", *[count(c) for c in ("available_records", "available_tokens", "used_records", "used_tokens", "most_repeats")],
                       (F.coalesce("used_tokens", F.lit(0)) / F.nullif("mixture_tokens", F.lit(0))).alias("actual_share"))
