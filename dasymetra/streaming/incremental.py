"""Interpolation of section results as they arrive: weights are fixed, so each batch adds its own share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dasymetra.operators.weights import interpolated


def zone_totals(arrivals: DataFrame, weights: DataFrame) -> DataFrame:
    """(zone_id, variable, value) kept up over a stream of (source_id, variable, value): W times V is linear in V, so sums of parts are the whole."""
    return interpolated(weights, arrivals)


def without_repeats(arrivals: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Arrivals of which a repeat of the same key within the delay counts once; later than that, state is given up and the row is late."""
    return arrivals.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_totals(arrivals: DataFrame, weights: DataFrame, at: str, delay: str, length: str) -> DataFrame:
    """(window, zone_id, variable, value) per window of event time; rows later than the delay are left out."""
    timed = arrivals.withWatermark(at, delay)
    return timed.join(weights, "source_id").groupBy(F.window(at, length), "zone_id", "variable").agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def start(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the totals of each batch as a table of their own under ``path``; a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
