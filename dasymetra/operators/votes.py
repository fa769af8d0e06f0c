"""From records of votes, turnout and voter profiles to one row per polling place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dasymetra.functions.text import name_key
from dasymetra.operators.diagnostics import running

BLANK, NULL = "95", "96"
DICTIONARY = ("column", "type", "cargo", "ballot_number", "candidate_name", "party")


def wide(rows: DataFrame, keys: list[str], name: Column, value: Column, names: list[str], prefix: str = "") -> DataFrame:
    """One row per key with a column for each of the given names: sums, 0 where there are none. Columns not given are left out, those without rows are 0."""
    out = rows.select(*keys, name.alias("_name"), value.alias("_value")).groupBy(*keys).pivot("_name", names).agg(F.sum("_value"))
    return out.select(*keys, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(prefix + n) for n in names])


def candidates(votes: DataFrame, numbers: list[str] = (), names: list[str] = (), number: str = "ballot", name: str | None = None) -> DataFrame:
    """Votes of the ballots given by number, or by part of a name without regard to marks and case; both together add up. A null matches nothing."""
    keep = F.coalesce(F.col(number).cast("string").isin(*[str(n) for n in numbers]), F.lit(False))
    for part in names if name is not None else ():
        keep |= F.coalesce(F.contains(name_key(F.col(name)), name_key(F.lit(part))), F.lit(False))
    return votes.filter(keep)


def parties(votes: DataFrame, wanted: list[str], party: str = "party") -> DataFrame:
    """Votes of the given parties, case and spaces aside; all votes where the table has no such column."""
    if party not in votes.columns:
        return votes
    return votes.filter(F.upper(F.trim(party)).isin(*[w.strip().upper() for w in wanted]))


def with_party_key(votes: DataFrame, party: str = "party", ballot: str = "ballot", name: str = "party_key") -> DataFrame:
    """Votes with the name of their party's column: the abbreviation in capitals, white space as an underscore, NA where it is null.

    Where no vote of the table has an abbreviation, the first two digits of the ballot stand for it: that is
    settled for the whole table by one aggregate, of which one row goes to all tasks.
    """
    digits = F.substring(F.col(ballot).cast("string"), 1, 2)
    if party not in votes.columns:
        return votes.withColumn(name, digits)
    label = F.coalesce(F.regexp_replace(F.upper(F.trim(party)), r"\s+", "_"), F.lit("NA"))
    some = votes.agg(F.coalesce(F.max(F.trim(party) != ""), F.lit(False)).alias("_some"))
    return votes.crossJoin(F.broadcast(some)).withColumn(name, F.when(F.col("_some"), label).otherwise(digits)).drop("_some")


def no_blanks(votes: DataFrame, ballot: str = "ballot") -> DataFrame:
    return votes.filter(~F.col(ballot).cast("string").isin(BLANK, NULL))


def turnout_of_first_office(votes: DataFrame, keys: list[str], office: str = "office", value: str = "votes") -> DataFrame:
    """(keys, turnout): votes of the office whose code is least, the only one that counts for turnout."""
    first = votes.agg(F.min(office).alias("first"))
    return votes.join(F.broadcast(first), F.col(office) == F.col("first"), "left_semi").groupBy(*keys).agg(F.sum(value).alias("turnout"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that has no ties, by a rank that spills and never collects a group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lat, lon, source): places with coordinates, places filled from the fallback, and places that only it has.

    Both sides may repeat a key; the smallest known pair counts.
    """
    once = lambda df: df.groupBy(*keys).agg(F.min(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("lat", "lon"))).alias("p"))
    a, b = once(primary).withColumnRenamed("p", "a").withColumn("known", F.lit(True)), once(fallback).withColumnRenamed("p", "b").filter(F.col("b").isNotNull())
    both = a.join(b, keys, "full").withColumn("p", F.coalesce("a", "b")).filter(F.col("p").isNotNull())
    source = F.when(F.col("a").isNotNull(), "primary").when(F.col("known"), "filled").otherwise("extra")
    return both.select(*keys, "p.lat", "p.lon", source.alias("source"))


def rolled_up(rows: DataFrame, values: list[str]) -> DataFrame:
    """(id, lat, lon, sums): sections at one position summed, nulls as 0; ids count positions in order of lat and lon, those without any left out.

    Ids are counted range by range over the positions, after the rows have been summed, so that no task orders all of them.
    """
    known = rows.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    places = known.groupBy("lat", "lon").agg(*[F.sum(F.coalesce(v, F.lit(0))).alias(v) for v in values]).withColumn("_one", F.lit(1))
    return running(places, [F.col("lat"), F.col("lon")], "_one", "_before").withColumn("id", (F.col("_before") + 1).cast("int")).drop("_one", "_before")


def candidate_dictionary(votes: DataFrame, cargo: Column, prefix: str = "") -> DataFrame:
    """Dictionary rows of ballots: the least non-blank name and party of each; blank and null votes have fixed names."""
    filled = lambda c: F.min(F.when(F.trim(c) != "", F.trim(c)))
    # fixed values: the names of votes for no one
    out = votes.groupBy(F.col("ballot").cast("string").alias("ballot_number")).agg(filled("name").alias("n"), filled("party").alias("p"))
    special = F.col("ballot_number").isin(BLANK, NULL)
    name = F.when(F.col("ballot_number") == BLANK, "Votos em Branco").when(F.col("ballot_number") == NULL, "Votos Nulos").otherwise(F.col("n"))
    return out.select(F.concat(F.lit(f"{prefix}CAND_"), "ballot_number").alias("column"), F.lit("candidate").alias("type"), cargo.alias("cargo"),
                      "ballot_number", name.alias("candidate_name"), F.when(~special, F.col("p")).alias("party"))


def party_dictionary(votes: DataFrame, cargo: Column) -> DataFrame:
    null = F.lit(None).cast("string")
    return with_party_key(no_blanks(votes), name="_key").select(F.col("_key").alias("party")).distinct().select(
        F.concat(F.lit("PARTY_"), "party").alias("column"), F.lit("party").alias("type"), cargo.alias("cargo"), null.alias("ballot_number"), null.alias("candidate_name"), "party")


def column_parts(c: Column) -> list[Column]:
    """type, ballot_number, party and cargo read from a column's name, for results without a dictionary."""
    ballot = F.nullif(F.regexp_extract(c, "(?:^|_)CAND_([0-9]+)$", 1), F.lit(""))
    party = F.nullif(F.regexp_extract(c, "(?:^|_)PARTY_(.+)$", 1), F.lit(""))
    kind = F.when(ballot.isNotNull(), "candidate").when(party.isNotNull(), "party").when(c.startswith("QT_"), "turnout").when(
        c.rlike("^(GENERO|EDUC)_"), "demographics").when(c.rlike("^(votantes|vot|pop)_"), "calibration").otherwise("other")
    cargo = F.lower(F.nullif(F.regexp_extract(c, "^([A-Z_]+?)_(?:CAND|PARTY)_", 1), F.lit("")))
    return [kind.alias("type"), ballot.alias("ballot_number"), party.alias("party"), cargo.alias("cargo")]
