"""From tables of zones, sources and travel times to an interpolation, and on from there."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dasymetra.functions import breaks as brk
from dasymetra.functions import text
from dasymetra.operators import diagnostics as dg
from dasymetra.operators import fit as ft
from dasymetra.operators import od as times
from dasymetra.operators import population as pop
from dasymetra.operators import result as res
from dasymetra.operators import votes as vt
from dasymetra.operators import weights as wt
from dasymetra.plans.common import cut_lineage

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Routing:
    """How travel times are put together: the mode (WALK, CAR or AUTO), the share of zones out of reach at which AUTO drives, and what stands for a missing time."""

    mode: str = "AUTO"
    threshold: float = 0.01
    fill_missing: float | None = None
    longest: float = 120.0

    def __post_init__(self):
        if self.mode not in ("WALK", "CAR", "AUTO"):
            raise ValueError("mode must be WALK, CAR or AUTO")
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        if self.longest <= 0 or (self.fill_missing is not None and self.fill_missing < 0):
            raise ValueError("longest must be above 0 and fill_missing not below")


def assemble_od(zones: DataFrame, sources: DataFrame, walk: DataFrame, car: DataFrame | None = None, retry: DataFrame | None = None, routing: Routing = Routing()) -> DataFrame:
    """Dense travel times from routed pairs: one mode for all, a retry for pairs without a time, times beyond ``longest`` out of reach, the fill last of all."""
    limited = lambda r: r.withColumn("minutes", F.when(F.col("minutes") <= routing.longest, F.col("minutes")))
    grid = lambda r: times.dense(zones, sources, limited(r))
    if routing.mode == "CAR" or (routing.mode == "AUTO" and car is not None):
        if car is None:
            raise ValueError("mode CAR needs a table of driving times")
        od = grid(car) if routing.mode == "CAR" else times.auto_mode(grid(walk), grid(car), routing.threshold)
    else:
        od = grid(walk)
    od = od.select("zone_id", "source_id", "minutes")
    if retry is not None:
        od = times.retried(od, limited(retry))
    return od if routing.fill_missing is None else od.fillna({"minutes": routing.fill_missing})


def numeric_columns(df: DataFrame, but: list[str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMBERS) and f.name not in but]


def long(df: DataFrame, key: str, columns: list[str], name: str, value: str) -> DataFrame:
    return df.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot(key, columns, name, value)


def interpolate(zones: DataFrame, sources: DataFrame, od: DataFrame, calibration: list[tuple[str, str]], variables: list[str] | None = None, zone_id: str = "zone_id", source_id: str = "source_id",
                alpha: DataFrame | float | None = None, weights: DataFrame | None = None, control: ft.Control = ft.Control(), min_population: float = 1.0, dictionary: DataFrame | None = None) -> res.Interpolation:
    """Interpolate source columns over zones.

    zones and sources are wide; calibration pairs a column of zones with one of sources, each pair a bracket
    named after the zones' column. variables: source columns, by default all numeric ones that calibrate
    nothing, or else those that do. Zones below ``min_population`` in all brackets together are left out;
    zones that nothing reaches come back with null values. Given ``weights``, nothing is fitted; given
    alpha, it is used; else it is fitted, in one task or, if it is too large for that, spread over sources. A source none of whose pairs has a time loses its values; ``meta`` counts those.
    """
    if missing := [z for z, _ in calibration if z not in zones.columns] + [c for _, c in calibration if c not in sources.columns]:
        raise ValueError(f"calibration columns missing: {', '.join(missing)}")
    zones, sources = zones.withColumnRenamed(zone_id, "zone_id"), sources.withColumnRenamed(source_id, "source_id")
    total = reduce(Column.__add__, [F.coalesce(F.col(f"`{z}`"), F.lit(0)) for z, _ in calibration])
    if min_population > 0:
        zones = zones.filter(total >= min_population)
    names = {c: z for z, c in calibration}
    population = long(zones, "zone_id", [z for z, _ in calibration], "bracket", "pop").fillna({"pop": 0.0})
    voters = long(sources, "source_id", list(names), "bracket", "voters").fillna({"voters": 0.0}).withColumn("bracket", text.lookup(F.col("bracket"), names))
    od = od.join(zones.select("zone_id"), "zone_id", "left_semi")
    wt.check_od(od, control.kernel, control.offset)
    if variables is None:
        variables = numeric_columns(sources, ["source_id", *names]) or list(names)
    values = long(sources, "source_id", variables, "variable", "value")
    brackets = wt.active_brackets(population, voters)
    fitted_alpha = history = None
    if weights is None:
        if alpha is None:
            # a fit is not repeated for every table that needs it
            fitted_alpha, history = ft.fit_one(od, population, voters, control, cut_lineage)
        elif isinstance(alpha, DataFrame):
            fitted_alpha = alpha
        else:
            fitted_alpha = population.select("zone_id", "bracket").withColumn("alpha", F.lit(float(alpha)))
        by_bracket = wt.bracket_weights(od, fitted_alpha, brackets, control.kernel, control.offset)
        weights = wt.aggregate_weights(by_bracket, voters, brackets)
        fit = wt.fitted(by_bracket, voters)
    else:
        fit = weights.join(voters, "source_id").groupBy("zone_id", "bracket").agg(F.sum(F.col("w") * F.col("voters")).alias("fitted"))
    meta = {"calibration": [list(c) for c in calibration], "variables": variables, "kernel": control.kernel, "offset": control.offset}
    return res.Interpolation(wt.interpolated(weights, values, zones), weights, fit, fitted_alpha, dictionary, meta, history)


def reinterpolate(result: res.Interpolation, sources: DataFrame, variables: list[str], source_id: str = "source_id", zones: DataFrame | None = None, od: DataFrame | None = None, control: ft.Control | None = None, **settings) -> res.Interpolation:
    """Other variables with the weights that are there: no fit. Given zones and travel times, weights are fitted anew with the result's calibration, or the settings given."""
    if od is not None:
        if zones is None:
            raise ValueError("a new fit needs zones and travel times")
        calibration = settings.pop("calibration", None) or [tuple(c) for c in result.meta["calibration"]]
        kept = control or ft.Control(kernel=result.meta["kernel"], offset=result.meta["offset"])
        return interpolate(zones, sources, od, calibration, variables, source_id=source_id, control=kept, dictionary=settings.pop("dictionary", result.dictionary), **settings)
    values = long(sources.withColumnRenamed(source_id, "source_id"), "source_id", variables, "variable", "value")
    return replace(result, values=wt.interpolated(result.weights, values, result.values.select("zone_id").distinct()), meta={**result.meta, "variables": variables})


def summarise(result: res.Interpolation) -> DataFrame:
    """(type, variable, total, mean, least, most) of every variable, with its type from the dictionary or its name."""
    out = res.summary(result.values)
    read = res.from_columns(out.select(F.col("variable").alias("column")).distinct()).select(F.col("column").alias("variable"), F.col("type").alias("read"))
    out = out.join(read, "variable", "left")
    if result.dictionary is not None:
        known = result.dictionary.groupBy(F.col("column").alias("variable")).agg(F.min("type").alias("known"))
        out = out.join(known, "variable", "left").withColumn("read", F.coalesce("known", "read"))
    return out.select(F.col("read").alias("type"), "variable", "total", "mean", "least", "most")


def coefficients(result: res.Interpolation) -> DataFrame:
    """One row per zone with its alpha in each bracket, named as they are calibrated."""
    if result.alpha is None:
        raise ValueError("an interpolation with given weights has no alpha")
    return result.alpha.groupBy("zone_id").pivot("bracket", [z for z, _ in result.meta["calibration"]]).agg(F.first("alpha"))


def residuals(result: res.Interpolation, population: DataFrame, kind: str = "raw") -> DataFrame:
    return res.residuals(result.fitted, population, kind)


def wide_values(result: res.Interpolation) -> DataFrame:
    """One row per zone, one column per variable, as they are named in the metadata."""
    return result.values.groupBy("zone_id").pivot("variable", list(result.meta["variables"])).agg(F.first("value"))


def classes(result: res.Interpolation, wanted: str, method: str | list[float] = "quantile", n: int = 5) -> DataFrame:
    """(zone_id, value, class) of the variable that a name, number or party stands for."""
    there = result.values.select(F.col("variable").alias("column")).distinct()
    column = res.resolved(result.dictionary, wanted, columns=there)[0]
    values = result.values.filter(F.col("variable") == column).select("zone_id", "value")
    return values.withColumn("class", brk.classed(F.col("value"), brk.breaks(values, "value", method, n)))


def diagnose(result: res.Interpolation, population: DataFrame, voters: DataFrame, od: DataFrame) -> DataFrame:
    if result.alpha is None:
        raise ValueError("an interpolation with given weights has no alpha to judge")
    return dg.checks(result.fitted, population, voters, od, result.alpha, result.history)


@dataclass(frozen=True)
class Wanted:
    """What prepared sources hold besides voters by age: ballots, parties, sexes and schooling by name; crosstab: voters by sex, literacy and age; offices: code to name, for several at once."""

    ballots: tuple[str, ...] = ()
    parties: tuple[str, ...] = ()
    genders: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    crosstab: bool = False
    offices: dict[str, str] | None = None


CROSSTAB = [f"vot_{s}_{a}_{g}" for s in pop.SEXES for a in pop.LITERACY for g in dict.fromkeys(b[9:] for b in text.AGE_BUCKETS.values())]


def prepare_sources(profile: DataFrame, votes: DataFrame, places: DataFrame, fallback: DataFrame | None, ballots: list[str], buckets: list[str], numbers: list[str] = (), names: list[str] = (),
                    wanted: Wanted | None = None, turnout: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, dictionary): one row per position of polling places, with voters by age bucket and votes by ballot, and what else is wanted.

    profile: (zone, place, section, age, n, and for the rest gender and schooling). votes: (zone, place, section, office, ballot, name, party, votes).
    places and fallback: (zone, place, lat, lon). turnout: (zone, place, section) and columns QT_..., in place of the votes of the first office. Keys are compared as whole numbers. The columns are
    those asked for, so that the plan is known before the data are read; with several offices each column is led by its office's name in capitals.
    """
    wanted = wanted or Wanted()
    keys = ["zone", "place", "section"]
    whole = lambda df, ks: df.withColumns({k: text.unpadded(F.col(k)) for k in ks})
    profile, votes, places = whole(profile, keys), whole(votes, keys), whole(places, keys[:2])
    adult = profile.withColumn("bucket", text.age_bucket(F.col("age"))).filter(F.col("bucket").isNotNull())
    rows, columns = vt.wide(adult, keys, F.col("bucket"), F.col("n"), buckets), list(buckets)
    if wanted.crosstab:
        name = F.concat_ws("_", F.lit("vot"), text.gender(F.col("gender")), text.literacy(F.col("schooling")), F.substr("bucket", F.lit(10)))
        rows = rows.join(vt.wide(adult.filter(text.gender(F.col("gender")).isNotNull()), keys, name, F.col("n"), CROSSTAB), keys, "left")
        columns += CROSSTAB
    if wanted.genders or wanted.levels:
        rows = rows.join(pop.demographics(profile, keys, list(wanted.genders), list(wanted.levels)), keys, "left")
        columns += [f"GENERO_{g}" for g in wanted.genders] + [f"EDUC_{e}" for e in wanted.levels]
    chosen = vt.candidates(votes, numbers, names, name="name") if numbers or names else votes
    lead = lambda office: F.concat(F.upper(text.lookup(office.cast("string"), wanted.offices)), F.lit("_"))
    leads = [""] if wanted.offices is None else [f"{o.upper()}_" for o in wanted.offices.values()]
    named = lambda df, c: F.col(c).cast("string") if wanted.offices is None else F.concat(lead(F.col("office")), F.lit("CAND_" if c == "ballot" else "PARTY_"), F.col(c).cast("string"))
    ballots = [*ballots, *[b for b in wanted.ballots if b not in ballots]]
    if wanted.offices is None:
        by_ballot = vt.wide(chosen, keys, named(chosen, "ballot"), F.col("votes"), ballots, "CAND_")
    else:
        by_ballot = vt.wide(chosen, keys, named(chosen, "ballot"), F.col("votes"), [f"{p}CAND_{b}" for p in leads for b in ballots])
    columns += [f"{p}CAND_{b}" for p in leads for b in ballots]
    rows = rows.join(by_ballot, keys, "left")
    dictionary = _dictionary_of(chosen, votes, wanted)
    if wanted.parties:
        party = vt.with_party_key(vt.no_blanks(votes))
        listed = [f"{p}PARTY_{k}" for p in leads for k in wanted.parties]
        prefix = "PARTY_" if wanted.offices is None else ""
        rows = rows.join(vt.wide(party, keys, named(party, "party_key"), F.col("votes"), list(wanted.parties) if prefix else listed, prefix), keys, "left")
        columns += listed
    if turnout is None:
        rows = rows.join(vt.turnout_of_first_office(votes, keys).withColumnRenamed("turnout", "QT_COMPARECIMENTO"), keys, "left")
        columns.append("QT_COMPARECIMENTO")
    else:
        counts = [c for c in turnout.columns if c.startswith("QT_")]
        rows = rows.join(whole(turnout, keys).groupBy(*keys).agg(*[F.max(c).alias(c) for c in counts]), keys, "left")
        columns += counts
    where = vt.with_fallback(places, places.limit(0) if fallback is None else whole(fallback, keys[:2]), keys[:2])
    return vt.rolled_up(rows.join(where, keys[:2], "left"), columns).withColumnRenamed("id", "source_id"), dictionary


def _dictionary_of(chosen: DataFrame, votes: DataFrame, wanted: Wanted) -> DataFrame:
    """Dictionary rows of ballots, and of parties if any are wanted, for each office on its own if there are several."""
    parts = []
    for code, office in (wanted.offices or {None: None}).items():
        mine = lambda df: df if code is None else df.filter(F.col("office").cast("string") == code)  # noqa: B023, E731
        cargo, lead = F.lit(office).cast("string"), "" if office is None else f"{office.upper()}_"
        parts.append(vt.candidate_dictionary(mine(chosen), cargo, lead))
        if wanted.parties:
            parts.append(vt.party_dictionary(mine(votes), cargo).withColumn("column", F.concat(F.lit(lead), "column")))
    return reduce(DataFrame.unionByName, parts)


def interpolate_election(wanted: str, crosswalk: DataFrame, tracts: DataFrame, census: DataFrame, sources: DataFrame, od: DataFrame, year: int, census_year: int | None = None, kinds: list[str] = ("candidates",), uf: str | None = None,
                         clip: list | None = None, income: DataFrame | None = None, **settings) -> res.Interpolation:
    """Interpolate one town's election: zones from tracts and the census of the year, calibration by sex and age, sources as prepared with a crosstab.

    census_year: by default the census that belongs to the year of the election. clip: rings of an outline; zones are cut to it and their people
    reduced by the share of their area that stays.
    """
    from dasymetra.operators import geometry  # noqa: PLC0415

    town = resolve_town(crosswalk, wanted, uf)
    counted = census_year or (2000 if year <= 2004 else 2010 if year <= 2016 else 2022)
    zones = pop.prepare_zones(tracts, pop.prepare_population(census, counted, town.code_ibge), town.code_ibge, income)
    if clip is not None:
        zones = geometry.clipped(zones, clip, [c for c in zones.columns if c.startswith("pop_")]).drop("share")
    mine = sources.filter(text.padded(F.col("cod_mun_tse")) == town.code_tse) if "cod_mun_tse" in sources.columns else sources
    zones, mine, pairs = pop.match_calibration(zones, mine, counted)
    out = interpolate(zones, mine, od, pairs, columns_by_kind(sources.columns, list(kinds)), zone_id="code_tract", **settings)
    return replace(out, meta={**out.meta, "town": town.asDict(), "kinds": list(kinds), "year": year, "census_year": counted})


#: What a kind of result consists of, by the names of its columns (fixed values).
KINDS = {"candidates": "(^|_)CAND_", "parties": "(^|_)PARTY_", "turnout": "^QT_", "demographics": "^(GENERO|EDUC)_"}


def resolve_town(crosswalk: DataFrame, wanted: str, uf: str | None = None):
    """The row (code_ibge, code_tse, uf, nome) of a town given by either code or by name, marks, case and spaces aside; none, or several, are errors that tell which."""
    w = str(wanted).strip()
    hit = F.col("code_ibge") == w if w.isdigit() and len(w) == 7 else F.col("code_tse") == w.zfill(5) if w.isdigit() else text.name_key(F.col("nome")) == text.name_key(F.lit(w))
    found = crosswalk.filter(hit if uf is None else hit & (F.upper(F.trim("uf")) == uf.strip().upper())).orderBy("code_ibge").limit(20).collect()
    if not found:
        raise KeyError(f"no town is called {wanted!r}")
    if len(found) > 1:
        raise KeyError(f"{wanted!r} may be any of {', '.join(f'{r.nome} ({r.uf}, {r.code_ibge})' for r in found)}; give a state or a code")
    return found[0]


def columns_by_kind(columns: list[str], kinds: list[str]) -> list[str]:
    """Columns of the given kinds, each once, in the order of the kinds."""
    if unknown := [k for k in kinds if k not in KINDS]:
        raise ValueError(f"unknown kinds: {', '.join(unknown)}; known: {', '.join(KINDS)}")
    return list(dict.fromkeys(c for k in kinds for c in columns if re.search(KINDS[k], c)))


def interpolate_town(wanted: str, crosswalk: DataFrame, zones: DataFrame, sources: DataFrame, od: DataFrame, calibration: list[tuple[str, str]], kinds: list[str] = ("candidates",), uf: str | None = None, **settings) -> res.Interpolation:
    """Interpolate one town of staged tables: zones by code_muni, sources by cod_mun_tse, variables by kind. The filters reach the scans; other settings are those of ``interpolate``."""
    town = resolve_town(crosswalk, wanted, uf)
    mine = sources.filter(text.padded(F.col("cod_mun_tse")) == town.code_tse)
    out = interpolate(zones.filter(F.col("code_muni") == town.code_ibge), mine, od, calibration, columns_by_kind(sources.columns, list(kinds)), **settings)
    return replace(out, meta={**out.meta, "town": town.asDict(), "kinds": list(kinds)})
