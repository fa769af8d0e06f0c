"""Helpers shared by every operator: table access, lineage cuts, column naming, skew."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns, wanted: str) -> str:
    """``wanted``, or ``wanted_``, ``wanted__`` and so on: the first that no column has (case ignored)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of ``df``: a later loss of executors cannot undo it.

    The folder is the one the session names in spark.checkpoint.dir. Only where that is unset and the
    master is local does the helper set a folder of its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


#: Keys of which a salted join may send to all executors at most.
MOST_HOT = 100_000


def salted_join(many: DataFrame, few: DataFrame, on: list[str], rows_per_salt: int, counts: DataFrame | None = None) -> DataFrame:
    """Inner equi-join in which no task meets a key with more than about ``rows_per_salt`` rows of ``many``, or one MOST_HOT-th of all.

    Keys with more rows are counted with map-side aggregation, unless ``counts`` (on, n) gives the rows of the keys that
    matter; their rows on ``many`` are spread over salts by a hash of the row, and their rows on ``few`` repeated once per salt. All other keys have one salt,
    so ``few`` is not repeated for them. The hot keys are sent to all executors: fewer than MOST_HOT, whatever
    the data, as each holds more than one MOST_HOT-th of the counted rows. Null keys match nothing.
    """
    columns = [*many.columns, *few.columns]
    salt, top = free_name(columns, "_salt"), free_name(columns, "_salts")
    counts = many.groupBy(*on).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    each = F.greatest(F.lit(rows_per_salt), F.ceil(F.col("_all") / MOST_HOT))
    total = counts.agg(F.sum("n").alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).select(*on, F.ceil(F.col("n") / each).cast("int").alias(top)).filter(F.col(top) > 1)
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*many.columns), F.coalesce(F.col(top), F.lit(1))).cast("int")
    left = many.join(hot, on, "left").withColumn(salt, spread).drop(top)
    right = few.join(hot, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(top), F.lit(1)) - 1))).drop(top)
    return left.join(right, [*on, salt]).drop(salt)
