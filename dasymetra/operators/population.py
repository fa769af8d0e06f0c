"""Population of zones by age, sex and literacy from census tables, and the brackets that zones and sources share."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dasymetra.functions import text

SEXES, LITERACY = ("hom", "mul"), ("alf", "nalf")
#: The seven age groups in which zones and sources are compared, by census.
AGES = {2000: ("18_20", "21_24", "25_29", "30_39", "40_49", "50_59", "60_69"), 2010: ("18_20", "21_24", "25_29", "30_39", "40_49", "50_59", "60_69"),
        2022: ("18_19", "20_24", "25_29", "30_39", "40_49", "50_59", "60_69")}
#: The finer groups of voters that make up a group; any other is its own.
VOTER_PARTS = {"18_20": ("18_19", "20"), "20_24": ("20", "21_24"), "30_39": ("30_34", "35_39"), "40_49": ("40_44", "45_49"), "50_59": ("50_54", "55_59"), "60_69": ("60_64", "65_69")}
#: Of the people of 15 to 19 years, the share that is 18 or 19.
ADULT_SHARE = 2 / 5
#: Spans of single years by group of a census that counts single years.
SPANS = {"00_04": (0, 4), "05_09": (5, 9), "10_14": (10, 14), "15_17": (15, 17), "18_20": (18, 20), "21_24": (21, 24), "25_29": (25, 29), "30_39": (30, 39), "40_49": (40, 49),
         "50_59": (50, 59), "60_69": (60, 69), "70mais": (70, 100)}


def _sum(df: DataFrame, names) -> Column:
    """Sum of the columns that are there, nulls as 0; 0 if none is."""
    known = [F.coalesce(F.col(f"`{n}`").try_cast("double"), F.lit(0.0)) for n in names if n in df.columns]
    return reduce(Column.__add__, known) if known else F.lit(0.0)


@dataclass(frozen=True)
class Ladder:
    """How a census names its counts. total, men, women, literate_men, literate_women: each from an age to its column; all but total may be None. groups: columns of whole groups in place of single years, with those to take away; bands: the numbers that stand for ages in a compared group, in place of single years."""

    total: object = None
    men: object = None
    women: object = None
    literate_men: object = None
    literate_women: object = None
    illiterate_men: object = None
    illiterate_women: object = None
    groups: dict | None = None
    bands: dict | None = None


def _numbered(prefix: str, first: int, width: int = 3):
    """Columns numbered by age: prefix and ``first`` + age."""
    return lambda age: f"{prefix}{first + age:0{width}d}"


def _groups_2000() -> dict:
    v = lambda *ns: tuple(f"pessoa1_V{n}" for n in ns)
    return {
        "00_04": (v(1448), ()), "05_09": (v(1449), ()), "10_14": (v(1450), ()), "15_17": (v(1362, 1363, 1364), ()), "18_20": (v(1365, 1366, 1367), ()), "21_24": (v(1452), v(1367)), "25_29": (v(1453), ()),
        "30_39": (v(1454, 1455), ()), "40_49": (v(1456, 1457), ()), "50_59": (v(1458, 1459), ()), "60_69": (v(1460, 1461), ()), "70mais": (v(1462, 1463, 1464), ()),
    }


def _groups_2022() -> dict:
    names = ("00_04", "05_09", "10_14", "15_19", "20_24", "25_29", "30_39", "40_49", "50_59", "60_69", "70mais")
    return {n: ((f"demografia_V{1031 + k:05d}",), ()) for k, n in enumerate(names)}


#: Where each census keeps its counts.
LADDERS = {
    2000: Ladder(groups=_groups_2000(), literate_men=_numbered("instrucao3_V", 2644, 4), illiterate_men=_numbered("instrucao3_V", 2736, 4),
                 literate_women=_numbered("instrucao5_V", 2929, 4), illiterate_women=_numbered("instrucao5_V", 3021, 4)),
    2010: Ladder(total=_numbered("pessoa13_V", 34), men=_numbered("pessoa11_V", 34), women=_numbered("pessoa12_V", 34), literate_men=_numbered("pessoa02_V", -3), literate_women=_numbered("pessoa02_V", 82)),
    2022: Ladder(groups=_groups_2022(), men=_numbered("alfabetizacao_V", 722, 5), women=_numbered("alfabetizacao_V", 735, 5), literate_men=_numbered("alfabetizacao_V", 826, 5), literate_women=_numbered("alfabetizacao_V", 839, 5),
                 bands={"18_19": (0,), "20_24": (1,), "25_29": (2,), "30_39": (3, 4), "40_49": (5, 6), "50_59": (7, 8), "60_69": (9, 10)}),
}


def prepare_population(census: DataFrame, year: int, town: str | None = None, keys: tuple[str, ...] = ("code_tract", "code_muni")) -> DataFrame:
    """Keys, ``pop_<group>`` for each age group of the census, and ``pop_<sex>_<alf|nalf>_<group>`` for the compared groups where the census has them by single years.

    Missing columns and nulls count 0, differences are not below 0; the illiterate are counted, or else all less the literate. town: code_muni to keep.
    The filter and the columns in use reach the scan; nothing is shuffled.
    """
    if year not in LADDERS:
        raise ValueError(f"census year must be one of {', '.join(map(str, LADDERS))}")
    ladder = LADDERS[year]
    rows = census if town is None else census.filter(F.col("code_muni").cast("string") == str(town))
    def span(column, group):
        ages = range(SPANS[group][0], SPANS[group][1] + 1) if ladder.bands is None else ladder.bands[group]
        # a census of five-year bands has no group of 18 and 19
        return _sum(rows, [column(a) for a in ages]) * (ADULT_SHARE if ladder.bands and group == "18_19" else 1.0)

    out = []
    if ladder.groups is not None:
        for group, (plus, minus) in ladder.groups.items():
            value = _sum(rows, plus)
            out.append((F.greatest(value - _sum(rows, minus), F.lit(0.0)) if minus else value).alias(f"pop_{group}"))
    else:
        out += [span(ladder.total, group).alias(f"pop_{group}") for group in SPANS]
    for sex, everyone, able, unable in (("hom", ladder.men, ladder.literate_men, ladder.illiterate_men), ("mul", ladder.women, ladder.literate_women, ladder.illiterate_women)):
        for group in AGES[year] if able is not None else ():
            literate = span(able, group)
            out.append(literate.alias(f"pop_{sex}_alf_{group}"))
            rest = span(unable, group) if unable is not None else F.greatest(span(everyone, group) - literate, F.lit(0.0))
            out.append(rest.alias(f"pop_{sex}_nalf_{group}"))
    return rows.select(*keys, *out)


def prepare_zones(tracts: DataFrame, population: DataFrame, town: str | None = None, income: DataFrame | None = None, key: str = "code_tract") -> DataFrame:
    """Zones with their population, and income where it is given; zones that the census lacks have population 0. tracts: (key, code_muni, rings, ...).

    town: code_muni to keep; without a column code_muni the first seven signs of the key stand for it.
    """
    place = F.col("code_muni") if "code_muni" in tracts.columns else F.substring(key, 1, 7)
    zones = tracts if town is None else tracts.filter(place.cast("string") == str(town))
    added = [c for c in population.columns if c not in tracts.columns]
    out = zones.join(population.select(key, *added), key, "left").fillna(0, [c for c in added if c.startswith("pop")])
    return out if income is None else out.join(income, key, "left")


def match_calibration(zones: DataFrame, sources: DataFrame, year: int) -> tuple[DataFrame, DataFrame, list[tuple[str, str]]]:
    """(zones, sources, pairs): both with one column for each sex and compared age group, and the fourteen pairs of them.

    Groups of voters that are finer are summed, then literate and illiterate; of people of 15 to 19 years two in five
    count as 18 or 19. Missing columns count 0. Neither table is shuffled.
    """
    groups = AGES[year if year in AGES else 2022]
    pairs, mine, theirs = [], {}, {}
    for sex in SEXES:
        for group in groups:
            pairs.append((f"pop_{sex}_{group}", f"vot_{sex}_{group}"))
            fine = VOTER_PARTS.get(group, (group,))
            theirs[f"vot_{sex}_{group}"] = _sum(sources, [f"vot_{sex}_{a}_{g}" for a in LITERACY for g in fine])
            names = [f"pop_{sex}_{a}_{group}" for a in LITERACY]
            if group == "18_19":
                whole = [n.replace("18_19", "15_19") for n in names]
                value = reduce(Column.__add__, [_sum(zones, [w]) * ADULT_SHARE if w in zones.columns else _sum(zones, [n]) for n, w in zip(names, whole)])
            else:
                value = _sum(zones, names)
            mine[f"pop_{sex}_{group}"] = value
    return zones.withColumns(mine), sources.withColumns(theirs), pairs


def fold_ages(rows: DataFrame, value: str, bracket: str = "bracket", keys: tuple[str, ...] = ("zone_id",)) -> DataFrame:
    """(keys, age, value): the brackets of both sexes summed by age; the name of a bracket is its side, sex and age."""
    age = F.regexp_replace(F.regexp_replace(F.regexp_replace(bracket, "^[^_]*_[^_]*_", ""), "_", "-"), "-mais$", "+")
    return rows.groupBy(*keys, age.alias("age")).agg(F.sum(value).alias(value))


def demographics(profile: DataFrame, keys: list[str], genders: list[str], levels: list[str], n: str = "n", gender: str = "gender", schooling: str = "schooling") -> DataFrame:
    """One row per key with voters by sex (GENERO_) and by schooling (EDUC_), of the given names; keys without a row of sex have none. One shuffle: both pivots are one aggregation."""
    name = lambda c: F.regexp_replace(F.upper(text.plain(F.trim(c))), r"\s+", "_")
    rows = profile.withColumns({"_sex": name(gender), "_level": text.education(F.col(schooling))})
    sums = [F.coalesce(F.sum(F.when(F.col("_sex") == g, F.col(n))), F.lit(0)).alias(f"GENERO_{g}") for g in genders]
    sums += [F.coalesce(F.sum(F.when(F.col("_level") == e, F.col(n))), F.lit(0)).alias(f"EDUC_{e}") for e in levels]
    return rows.groupBy(*keys).agg(*sums)


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c)]
