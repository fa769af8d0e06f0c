"""Dictionaries of result columns, and the words that stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasymetra.functions import text
from dasymetra.operators.votes import BLANK, DICTIONARY, NULL, column_parts

#: What a derived quantity is called.
QUANTITY_LABELS = {"absolute": "Count", "pct_tract": "% of tract votes", "pct_muni": "% of municipality total", "pct_valid": "% of valid votes", "pct_eligible": "% of eligible voters", "density": "per km²"}
#: The columns of turnout, and how many columns a popup shows at most.
TURNOUT, POPUP = ("QT_COMPARECIMENTO", "QT_APTOS", "QT_ABSTENCOES"), 8


def from_names(columns: DataFrame) -> DataFrame:
    """Dictionary rows read from column names (column) alone: candidates and parties, with the office that leads them; blank and null votes by their names."""
    kind, ballot, party, cargo = column_parts(F.col("column"))
    rows = columns.select("column", kind, cargo, ballot, party).filter(F.col("type").isin("candidate", "party"))
    name = F.when(F.col("ballot_number") == BLANK, "Votos em Branco").when(F.col("ballot_number") == NULL, "Votos Nulos")
    return rows.withColumn("candidate_name", name).select(*DICTIONARY)


def assemble(dictionary: DataFrame | None, columns: DataFrame, calibration: DataFrame) -> DataFrame:
    """The dictionary of the interpolated columns: what is known of them, then calibration, turnout and demographics; of rows for one column the first counts.

    dictionary: as from votes.candidate_dictionary and party_dictionary, or None, for which names are read. columns and calibration: (column).
    Only interpolated columns stay. One aggregation by column, in an order that the rows carry.
    """
    known = from_names(columns) if dictionary is None else dictionary.select(*DICTIONARY)
    bare = lambda rows, kind: rows.select("column", F.lit(kind).alias("type"), *[F.lit(None).cast("string").alias(c) for c in DICTIONARY[2:]])
    parts = [known, bare(calibration, "calibration"), bare(columns.filter(F.col("column").isin(*TURNOUT)), "turnout"), bare(columns.filter(F.col("column").rlike("^(GENERO_|EDUC_)")), "demographics")]
    rows = None
    for order, part in enumerate(parts):
        part = part.withColumn("_order", F.lit(order))
        rows = part if rows is None else rows.unionByName(part)
    fields = [F.col(c) for c in DICTIONARY[1:]]
    first = rows.groupBy("column").agg(F.min(F.struct("_order", *fields)).alias("r")).select("column", *[F.col(f"r.{c}") for c in DICTIONARY[1:]])
    return first.join(columns.select("column").distinct(), "column", "left_semi")


def label(kind: Column, name: Column, party: Column) -> Column:
    """Short label of a dictionary row: name and party of a candidate, the party of a party, else the kind."""
    candidate = F.concat(F.coalesce(name, F.lit("")), F.coalesce(F.concat(F.lit(" ("), party, F.lit(")")), F.lit("")))
    return F.when(kind == "candidate", candidate).when(kind == "party", F.coalesce(party, F.lit(""))).otherwise(kind)


def title(column: Column, kind: Column, name: Column, party: Column, ballot: Column) -> Column:
    """Title of a column: a candidate's name in title case with party and ballot, else its short label, or the column where that is empty."""
    meta = F.concat_ws(" — ", party, ballot)
    named = F.concat(text.title_case(name), F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""))
    short = F.nullif(label(kind, name, party), F.lit(""))
    return F.when((kind == "candidate") & name.isNotNull(), named).otherwise(F.coalesce(short, column))


def subtitle(town: str | None = None, uf: str | None = None, year: int | None = None, turn: int | None = None, offices: list[int] = (), quantity: str = "absolute", breaks=None) -> str:
    """Place, year, round, offices, quantity and method of breaks, those that are given, with dashes between."""
    names = [text.OFFICES.get(o, f"CARGO{o}") for o in offices]
    parts = [f"{town} ({uf})" if town else None, str(year) if year else None, f"{turn}º turno" if turn else None, "/".join(names) or None,
             QUANTITY_LABELS.get(quantity, quantity) if quantity != "absolute" else None, breaks.title() if isinstance(breaks, str) and breaks != "continuous" else None]
    return " — ".join(p for p in parts if p)


def default_column(dictionary: DataFrame | None, columns: list[str]) -> str:
    """The column shown if none is asked for: the first candidate who is neither blank nor null, else the first party, else the first column."""
    if dictionary is not None:
        real = F.when((F.col("type") == "candidate") & ~F.coalesce(F.col("ballot_number").isin(BLANK, NULL), F.lit(False)), 0).when(F.col("type") == "party", 1)
        best = dictionary.filter(F.col("column").isin(*columns)).select(real.alias("o"), "column").filter("o IS NOT NULL").agg(F.min(F.struct("o", "column")).alias("b")).first().b
        if best is not None:
            return best["column"]
    return columns[0]


def popup_columns(columns: list[str], key: str, shown: str, calibration: list[str]) -> list[str]:
    """The columns of a popup: key, what is shown, turnout and calibration, each once and at most POPUP of them; a display is bounded by nature."""
    wanted = [key, shown, *TURNOUT, *calibration]
    return list(dict.fromkeys(c for c in wanted if c in columns))[:POPUP]


def common(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """The values of a column that both tables hold, each once, compared as text."""
    return a.select(F.col(c).cast("string").alias(c)).intersect(b.select(F.col(c).cast("string").alias(c)))
