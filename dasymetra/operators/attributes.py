"""Entity, attribute, value rows into one typed row per entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasymetra.plans.common import free_name

#: How a boolean may be written, case aside (fixed values of the task).
TRUE_WORDS = ("s", "sim", "true", "1", "yes")
FALSE_WORDS = ("n", "não", "false", "0", "no")


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str  # int, decimal, boolean, date or string


def plain_name(c: Column) -> Column:
    """An attribute's name with case and all but letters and digits ignored."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def usable(value: Column, kind: str) -> Column:
    """Whether the text, spaces around aside, can be read as the kind; false for null."""
    t = F.trim(value)
    if kind == "int":
        ok = t.rlike(r"^([0-9]+|[0-9]{1,3}(\.[0-9]{3})+)$")
    elif kind == "decimal":
        ok = t.rlike(r"^[0-9]+([.,][0-9]+)?$")
    elif kind == "boolean":
        ok = F.lower(t).isin(*TRUE_WORDS, *FALSE_WORDS)
    elif kind == "date":
        ok = as_date(t).isNotNull()
    elif kind == "string":
        ok = t != ""
    else:
        raise ValueError(f"unknown kind {kind}")
    return F.coalesce(ok, F.lit(False))


def as_date(t: Column) -> Column:
    forms = ((r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$", 1, 2, 3), (r"^([0-9]{2})/([0-9]{2})/([0-9]{4})$", 3, 2, 1),
             (r"^([0-9]{2})\.([0-9]{2})\.([0-9]{4})$", 3, 2, 1), (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", 1, 2, 3))
    iso = None
    for form, y, m, d in forms:
        this = F.concat_ws("-", *[F.regexp_extract(t, form, g) for g in (y, m, d)])
        iso = F.when(t.rlike(form), this) if iso is None else iso.when(t.rlike(form), this)
    return iso.try_cast("date")


def _text(name: str) -> str:
    """A string as SQL writes it."""
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def typed(value: str, kind: str) -> str:
    """SQL for the value of a usable text (also SQL); null for a whole number beyond 38 digits, which no column type holds.

    A wide table has very many columns: as text each is one call of the session, not dozens.
    """
    t = f"trim({value})"
    if kind == "int":
        return f"try_cast(replace({t}, '.', '') AS DECIMAL(38,0))"
    if kind == "decimal":
        return f"try_cast(replace({t}, ',', '.') AS DOUBLE)"
    if kind == "boolean":
        return f"lower({t}) IN ({', '.join(map(_text, TRUE_WORDS))})"
    if kind == "date":
        day = f"CASE WHEN length({t}) = 8 THEN concat_ws('-', left({t}, 4), substr({t}, 5, 2), right({t}, 2)) WHEN substr({t}, 5, 1) = '-' THEN {t} ELSE concat_ws('-', right({t}, 4), substr({t}, 4, 2), left({t}, 2)) END"
        return f"try_cast({day} AS DATE)"
    return t


def resolve(rows: DataFrame, entity: str, attribute: str, value: str, at: str, attributes: list[Attribute]) -> DataFrame:
    """(entity, values, failures): the resolved pairs of each entity as two maps from attribute to text.

    Of the rows of one entity and attribute the latest counts alone, also when it is unusable; a null time
    is earlier than all others, and of rows with equal times the largest value counts, null last. Names
    that match no attribute are dropped, as are rows without an entity. An entity none of whose rows
    match has no row. Pairs collapse before the shuffle, so an entity with very many rows costs one row
    per attribute and task; a map holds at most one entry for each of the attributes.
    """
    names = F.create_map(*[x for a in attributes for x in (plain_name(F.lit(a.name)), F.lit(a.name))])
    known = rows.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{attribute}`").alias("a"), F.col(f"`{value}`").alias("v"), F.col(f"`{at}`").alias("t"))
    known = known.withColumn("name", F.element_at(names, plain_name(F.col("a")))).filter(F.col("entity").isNotNull() & F.col("name").isNotNull())
    pairs = known.groupBy("entity", "name").agg(F.max(F.struct("t", "v")).alias("last")).select("entity", "name", F.col("last.v").alias("v"))
    ok = F.lit(False)
    for kind in dict.fromkeys(a.kind for a in attributes):
        ok = F.when(F.col("name").isin(*[a.name for a in attributes if a.kind == kind]), usable(F.col("v"), kind)).otherwise(ok)
    pairs = pairs.withColumn("ok", ok)
    entry = F.struct("name", "v")
    return pairs.groupBy("entity").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("ok"), entry))).alias("values"),
        F.map_from_entries(F.collect_list(F.when(~F.col("ok"), entry))).alias("failures"))


def widen(resolved: DataFrame, attributes: list[Attribute], entity: str = "entity") -> DataFrame:
    """One row per entity with a typed column per attribute and the map ``failures`` of the texts that could not be read.

    A text of the right form whose value no column holds (a whole number beyond 38 digits) stays in ``failures`` too,
    so that no value is lost. An attribute called like the entity or ``failures`` gets a trailing underscore.
    """
    columns, beyond = [f"entity AS {_column(entity)}"], []
    for a, name in zip(attributes, column_names(attributes, entity)):
        text = f"element_at(values, {_text(a.name)})"
        columns.append(f"{typed(text, a.kind)} AS {_column(name)}")
        if a.kind == "int":
            beyond.append(f"if({text} IS NOT NULL AND {typed(text, a.kind)} IS NULL, struct({_text(a.name)} AS name, {text} AS v), NULL)")
    failures = "failures"
    if beyond:
        # most rows have none, and the map is not built anew for those
        more = f"map_from_entries(filter(array({', '.join(beyond)}), e -> e IS NOT NULL))"
        failures = f"if(exists(map_values(values), v -> length(v) > 38), map_concat(failures, {more}), failures)"
    return resolved.selectExpr(*columns, f"{failures} AS failures")


def column_names(attributes: list[Attribute], entity: str = "entity") -> list[str]:
    """The column of each attribute in the wide table."""
    taken = [entity, "failures"]
    for a in attributes:
        taken.append(free_name(taken, a.name))
    return taken[2:]


def filled_cells(wide: DataFrame, attributes: list[Attribute], entity: str = "entity") -> DataFrame:
    """(entity, attr_name) of the filled cells of a wide table: its typed columns that are not null, and the values of the right form that no column holds."""
    cells = ", ".join(f"if({_column(c)} IS NOT NULL, {_text(a.name)}, NULL)" for a, c in zip(attributes, column_names(attributes, entity)))
    cells = F.expr(f"array({cells})").cast("array<string>")
    whole = [a.name for a in attributes if a.kind == "int"]
    beyond = F.map_filter("failures", lambda k, v: k.isin(*whole) & usable(v, "int")) if whole else F.create_map().cast("map<string,string>")
    names = F.when(F.size("failures") > 0, F.concat(cells, F.map_keys(beyond))).otherwise(cells)
    return wide.select(F.col(f"`{entity}`"), F.explode(F.filter(names, lambda n: n.isNotNull())).alias("attr_name"))
