"""References to records that do not exist, are deleted, or arrive later."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasymetra.plans.common import cut_lineage, salted_join

STATES = ("missing", "deleted", "late")
#: Rows of one key that a task may meet, and microseconds of a slice of time.
ROWS_PER_SALT, SLICE = 200_000, 3_600_000_000


@dataclass(frozen=True)
class Reference:
    """Rows of ``rows`` that refer by ``key`` to the parent table: name, columns of key, row id, time and period."""

    name: str
    rows: DataFrame
    key: tuple[Column, ...]
    row_id: Column
    at: Column
    period: Column


def whole_number(c: Column) -> Column:
    """Text as a whole number written one way: spaces around and leading zeros aside; other text, trimmed, stands for itself."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike("^[0-9]+$"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(t)


def orphan_references(parents: DataFrame, key: tuple[Column, ...], valid_from: Column, valid_to: Column, references: list[Reference], parent_table: str = "parent") -> DataFrame:
    """(tab_name, rec_id, period, state): each distinct row that refers to no valid parent.

    state, by the referring row's time t: missing, no parent row has the key; no case if one has
    valid_from <= t and valid_to null or > t; late if all have valid_from > t; else deleted. A key with
    a null part equals no parent's key, so such a row is missing; leave those out beforehand where they
    are no references. A null t counts as earlier than every time, a null valid_from as later than every t.

    Plan: parent and child keys go in long form, tagged, into one aggregation by key whose state is a
    few numbers, so a hot key shrinks to one row per task before the shuffle. Groups without a parent are
    missing; groups in which every child is later than the first valid_from, and no parent ever ends,
    have no case and are left. Only rows of the rest are looked at one by one: they and their parents are
    put in order of their different times within (key, slice of time) and meet the latest valid_to so far, a running
    maximum, so neither a key with very many parents nor one with very many children is collected; slices are
    one hour long, and what earlier slices of the key leave is carried by one number for each.
    """
    parts = [f"k{i}" for i in range(len(key))]
    far = F.lit(9_223_372_036_854_775_807)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    parent = parents.select(*[k.cast("string").alias(n) for k, n in zip(key, parts)], F.coalesce(micros(valid_from), far).alias("at"),
                            F.coalesce(micros(valid_to), far).alias("until"), F.lit(True).alias("is_parent"))
    parent = parent.dropna(subset=parts)
    child = None
    for r in references:
        rows = r.rows.select(*[k.cast("string").alias(n) for k, n in zip(r.key, parts)], F.coalesce(micros(r.at), -far).alias("at"),
                             F.lit(r.name).alias("tab_name"), r.row_id.cast("bigint").alias("rec_id"), r.period.cast("string").alias("period"))
        child = rows if child is None else child.unionByName(rows)
    long = _long_form(parent, child, parts)
    mine = F.col("is_parent")
    groups = long.groupBy(F.lit(parent_table).alias("parent_table"), *parts).agg(
        F.max(mine).alias("has_parent"), F.min(F.when(mine, F.col("at"))).alias("first"), F.min(F.when(mine, F.col("until"))).alias("ends"),
        F.min(F.when(~mine, F.col("at"))).alias("earliest"), F.count_if(mine).alias("n_parents"), F.count_if(~mine).alias("n_children"))
    doubtful = groups.filter(F.col("earliest").isNotNull() & (~F.col("has_parent") | (F.col("first") > F.col("earliest")) | (F.col("ends") < far)))
    doubtful = cut_lineage(doubtful.select(*parts, "has_parent", "first", "n_parents", "n_children"))
    children, elders = (doubtful.select(*parts, F.col(c).alias("n")) for c in ("n_children", "n_parents"))

    null_key = child.filter(F.greatest(F.lit(False), *[F.col(n).isNull() for n in parts]))
    # few rows, used four times; a key with a null part joins nothing, and the rows of a hot key are spread
    asked = cut_lineage(salted_join(child, doubtful.select(*parts, "has_parent", "first"), parts, ROWS_PER_SALT, children))
    plain = asked.filter(~F.col("has_parent")).withColumn("state", F.lit("missing"))
    plain = plain.unionByName(asked.filter(F.col("has_parent") & (F.col("at") < F.col("first"))).withColumn("state", F.lit("late")))
    columns = ["tab_name", "rec_id", "period", "state"]
    found = plain.select(*columns).unionByName(null_key.select("tab_name", "rec_id", "period", F.lit("missing").alias("state")))

    # the rest have a parent that began by their time: deleted, unless one of those still lasts
    started = asked.filter(F.col("has_parent") & (F.col("at") >= F.col("first"))).select(*parts, "at", "tab_name", "rec_id", "period", F.lit(None).cast("bigint").alias("until"))
    none = F.lit(None).cast("string")
    lasting = salted_join(parent, started.select(*parts).distinct(), parts, ROWS_PER_SALT, elders).select(
        *parts, "at", none.alias("tab_name"), none.cast("bigint").alias("rec_id"), none.alias("period"), "until")
    deleted = _ended(lasting, started, parts)
    return found.unionByName(deleted.select(*columns)).distinct()


def _long_form(parent: DataFrame, child: DataFrame, parts: list[str]) -> DataFrame:
    """Parent and child keys, tagged, under each other."""
    return parent.unionByName(child.select(*parts, "at", F.lit(None).cast("bigint").alias("until"), F.lit(False).alias("is_parent")))


def _ended(lasting: DataFrame, started: DataFrame, parts: list[str]) -> DataFrame:
    """Rows of ``started`` whose time is at or beyond the ``until`` of every parent that began by then.

    Rows of one key and time are one before anything is put in order, so a window holds at most the different times of one key in one slice.
    """
    both = lasting.select(*parts, "at", "until", F.lit(0).alias("c")).unionByName(started.select(*parts, "at", "until", F.lit(1).alias("c")))
    times = both.groupBy(*parts, "at").agg(F.max("until").alias("until"), F.sum("c").alias("n"))
    times = times.withColumn("slice", F.floor(F.col("at") / SLICE))
    before = Window.partitionBy(*parts).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = times.groupBy(*parts, "slice").agg(F.max("until").alias("own")).withColumn("carried", F.max("own").over(before)).select(*parts, "slice", "carried")
    within = Window.partitionBy(*parts, "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    met = times.withColumn("here", F.max("until").over(within)).join(slices, [*parts, "slice"])
    gone = cut_lineage(met.filter((F.greatest(F.col("here"), F.col("carried")) <= F.col("at")) & (F.col("n") > 0)).select(*parts, "at", "n"))
    return salted_join(started, gone.drop("n"), [*parts, "at"], ROWS_PER_SALT, gone).withColumn("state", F.lit("deleted"))


def missing_counts(parents: DataFrame, key: tuple[Column, ...], references: list[Reference], parent_table: str) -> DataFrame:
    """(parent_table, tab_name, period, n_rows): rows whose key no parent has, without a join of rows.

    Parent and child keys in long form, tagged, are grouped by key; a key keeps for each child table and period how many different
    rows name it: as many numbers as there are tables and periods. Groups without a parent are summed by table and period. The rows of a key are counted before
    they meet, so a hot key is one row for each table, period and task. A row with a null part in its key is missing.
    """
    parts = [f"k{i}" for i in range(len(key))]
    none = F.lit(None).cast("string")
    long = parents.select(*[k.cast("string").alias(n) for k, n in zip(key, parts)], none.alias("tab_name"), none.cast("bigint").alias("rec_id"), none.alias("period")).dropna(subset=parts)
    for r in references:
        long = long.unionByName(r.rows.select(*[k.cast("string").alias(n) for k, n in zip(r.key, parts)], F.lit(r.name).alias("tab_name"), r.row_id.cast("bigint").alias("rec_id"), r.period.cast("string").alias("period")))
    once = long.groupBy(*parts, "tab_name", "period", "rec_id").agg(F.lit(1).alias("one"))
    named = once.groupBy(*parts, "tab_name", "period").agg(F.count("one").alias("n"))
    keys = named.groupBy(*parts).agg(F.max(F.col("tab_name").isNull()).alias("has_parent"), F.collect_list(F.when(F.col("tab_name").isNotNull(), F.struct("tab_name", "period", "n"))).alias("children"))
    rows = keys.filter(~F.col("has_parent")).select(F.explode("children").alias("c"))
    return rows.groupBy(F.lit(parent_table).alias("parent_table"), "c.tab_name", "c.period").agg(F.sum("c.n").alias("n_rows"))


def orphan_report(found: DataFrame, parent_table: str, missing: DataFrame | None = None) -> DataFrame:
    """(parent_table, tab_name, period, state, n_rows): the cases of orphan_references counted per table and period; the missing ones from ``missing_counts`` if given."""
    table = F.lit(parent_table).alias("parent_table")
    if missing is None:
        return found.groupBy(table, "tab_name", "period", "state").agg(F.count(F.lit(1)).alias("n_rows"))
    rest = found.filter("state <> 'missing'").groupBy(table, "tab_name", "period", "state").agg(F.count(F.lit(1)).alias("n_rows"))
    return missing.select("parent_table", "tab_name", "period", F.lit("missing").alias("state"), "n_rows").unionByName(rest)
