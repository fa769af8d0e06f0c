import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dasymetra.functions import text
from dasymetra.operators import geometry as geo
from dasymetra.operators import od as times
from dasymetra.operators import population as pop
from dasymetra.operators import proximity, spatial
from dasymetra.operators import result as res
from dasymetra.operators import votes as vt
from dasymetra.plans import pipeline
from dasymetra.sources import store

RINGS = "array<array<struct<x: double, y: double>>>"
ring = lambda *points: [{"x": float(x), "y": float(y)} for x, y in points]
SQUARE, HOLE = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (1, 3), (3, 3), (3, 1))
U = ring((0, 0), (5, 0), (5, 5), (4, 5), (4, 1), (1, 1), (1, 5), (0, 5))


def _inside(rings, x, y):
    odd = 0
    for r in rings:
        p = [(q["x"], q["y"]) for q in r]
        odd += sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(p, p[1:] + p[:1]))
    return odd % 2 == 1


def _star(rng, x, y, size, n=9):
    return ring(*[(x + size * rng.uniform(0.3, 1) * math.cos(a), y + size * rng.uniform(0.3, 1) * math.sin(a)) for a in np.sort(rng.uniform(0, 2 * math.pi, n))])


# people


def test_missing_columns_and_nulls_count_nothing(spark):
    census = spark.createDataFrame([("1", "7", 5.0, None, 2.0), ("2", "8", 1.0, 1.0, 9.0)], "code_tract string, code_muni string, pessoa1_V1452 double, pessoa1_V1365 double, pessoa1_V1367 double")
    out = {r.code_tract: r for r in pop.prepare_population(census, 2000).collect()}
    assert out["1"].pop_21_24 == 3.0 and out["2"].pop_21_24 == 0.0 and out["1"].pop_18_20 == 2.0 and out["1"].pop_70mais == 0.0
    assert [r.code_tract for r in pop.prepare_population(census, 2000, "8").collect()] == ["2"]
    assert pop.prepare_population(census.limit(0), 2010).count() == 0
    with pytest.raises(ValueError, match="2000, 2010, 2022"):
        pop.prepare_population(census, 1991)


@pytest.mark.parametrize("year, group, voters", [(2010, "18_20", 5), (2022, "18_19", 1), (2022, "20_24", 12)])
def test_pairs_of_both_censuses(spark, year, group, voters):
    zones = spark.createDataFrame([("z", 10, 20, 7)], "zone_id string, pop_hom_alf_15_19 int, pop_hom_nalf_15_19 int, pop_hom_alf_18_20 int")
    sources = spark.createDataFrame([("s", 1, 4, 8)], "source_id string, vot_hom_alf_18_19 int, vot_hom_nalf_20 int, vot_hom_alf_21_24 int")
    z, s, pairs = pop.match_calibration(zones, sources, year)
    assert len(pairs) == 14 and set(a for a, _ in pairs) <= set(z.columns) and set(b for _, b in pairs) <= set(s.columns)
    assert s.first()[f"vot_hom_{group}"] == voters and s.first()[f"vot_mul_{group}"] == 0
    assert z.first()[f"pop_hom_{group}"] == {"18_20": 7.0, "18_19": 12.0, "20_24": 0.0}[group]


def test_ages_fold_over_sex(spark):
    rows = spark.createDataFrame([("z", "pop_hom_18_20", 1.0), ("z", "pop_mul_18_20", 2.0), ("z", "pop_mul_60_mais", 4.0), ("z", "pop_hom_60_mais", None)], "zone_id string, bracket string, value double")
    assert {(r.age, r.value) for r in pop.fold_ages(rows, "value").collect()} == {("18-20", 3.0), ("60+", 4.0)}


def test_labels_of_every_group(spark):
    ages = ["16 anos", "17 anos", "18 anos", " 19 anos ", "20 anos", "21 a 24 anos", "65 a 69 anos", "70 a 74 anos", None]
    rows = spark.createDataFrame([(a,) for a in ages], "a string").select(text.age_bucket(F.col("a")).alias("b")).collect()
    assert [r.b for r in rows] == [None, None, "votantes_18_19", "votantes_18_19", "votantes_20", "votantes_21_24", "votantes_65_69", None, None]


def test_marks_of_any_latin_letter(spark):
    rows = spark.createDataFrame([("Ǎçãőṩ ñ Šž",), ("Sa\u0303o",), ("ª º ß ø 日",), (None,)], "t string")
    assert [r.p for r in rows.select(text.plain(F.col("t")).alias("p")).collect()] == ["Acaos n Sz", "Sao", "ª º ß ø 日", None]


def test_party_keys_are_settled_for_the_whole_table(spark):
    votes = spark.createDataFrame([(" Pc do B ", 65123), (None, 13), ("PT#1", 13)], "party string, ballot int")
    assert [r.party_key for r in vt.with_party_key(votes).collect()] == ["PC_DO_B", "NA", "PT#1"]
    blank = votes.withColumn("party", F.when(F.col("ballot") > 13, "  "))
    assert [r.party_key for r in vt.with_party_key(blank).collect()] == ["65", "13", "13"] == [r.party_key for r in vt.with_party_key(votes.drop("party")).collect()]
    assert vt.with_party_key(votes.limit(0)).count() == 0


def test_sources_of_several_offices_with_parties_and_people(spark):
    profile = spark.createDataFrame([("1", "7", "1", "18 anos", "FEMININO", "ANALFABETO", 5), ("1", "7", "1", "20 anos", "MASCULINO", "SUPERIOR COMPLETO", 3), ("1", "7", "1", "20 anos", None, None, 2)],
                                    "zone string, place string, section string, age string, gender string, schooling string, n int")
    votes = spark.createDataFrame([("1", "7", "1", "1", "13", "ANA", "PT", 3), ("1", "7", "1", "3", "13", "JO", "PT", 4), ("1", "7", "1", "3", "95", "X", "PT", 9)], "zone string, place string, section string, office string, ballot string, name string, party string, votes int")
    places = spark.createDataFrame([("1", "7", -9.0, -50.0)], "zone string, place string, lat double, lon double")
    turnout = spark.createDataFrame([("01", "007", "1", 20, 12)], "zone string, place string, section string, QT_APTOS int, QT_COMPARECIMENTO int")
    wanted = pipeline.Wanted(parties=("PT",), genders=("FEMININO", "MASCULINO"), levels=("ANALFABETO", "SUP_COMP"), crosstab=True, offices={"1": "presidente", "3": "governador"})
    rows, dictionary = pipeline.prepare_sources(profile, votes, places, None, ["13", "95"], ["votantes_20"], wanted=wanted, turnout=turnout)
    r = rows.first().asDict()
    assert {k: r[k] for k in ("votantes_20", "vot_mul_nalf_18_19", "vot_hom_alf_20", "GENERO_FEMININO", "EDUC_SUP_COMP", "PRESIDENTE_CAND_13", "GOVERNADOR_CAND_13", "GOVERNADOR_CAND_95", "PRESIDENTE_PARTY_PT", "GOVERNADOR_PARTY_PT", "QT_APTOS")} == {
        "votantes_20": 5, "vot_mul_nalf_18_19": 5, "vot_hom_alf_20": 3, "GENERO_FEMININO": 5, "EDUC_SUP_COMP": 3, "PRESIDENTE_CAND_13": 3, "GOVERNADOR_CAND_13": 4, "GOVERNADOR_CAND_95": 9, "PRESIDENTE_PARTY_PT": 3, "GOVERNADOR_PARTY_PT": 4, "QT_APTOS": 20}
    assert {(d.column, d.cargo) for d in dictionary.collect()} == {("PRESIDENTE_CAND_13", "presidente"), ("GOVERNADOR_CAND_13", "governador"), ("GOVERNADOR_CAND_95", "governador"), ("PRESIDENTE_PARTY_PT", "presidente"), ("GOVERNADOR_PARTY_PT", "governador")}


def test_an_election_from_census_to_values(spark, tmp_path):
    crosswalk = spark.createDataFrame([("1700001", "00007", "TO", "Itó")], "code_ibge string, code_tse string, uf string, nome string")
    tracts = spark.createDataFrame([(f"170000100{k}", "1700001", [ring((k, 0), (k + 1, 0), (k + 1, 1), (k, 1))]) for k in range(4)], f"code_tract string, code_muni string, rings {RINGS}")
    names = [f"pessoa{t}_V{34 + a:03d}" for t in (11, 12, 13) for a in range(1, 70)]
    census = spark.createDataFrame([(f"170000100{k}", "1700001", *[2.0 + k] * len(names)) for k in range(3)], "code_tract string, code_muni string, " + ", ".join(f"{n} double" for n in names))
    sources = spark.createDataFrame([(1, "7", *[9] * len(pipeline.CROSSTAB), 40.0, 5.0), (2, "7", *[5] * len(pipeline.CROSSTAB), 60.0, 5.0), (3, "8", *[1] * len(pipeline.CROSSTAB), 7.0, 5.0)],
                                    "source_id int, cod_mun_tse string, " + ", ".join(f"{c} int" for c in pipeline.CROSSTAB) + ", CAND_13 double, QT_APTOS double")
    od = spark.createDataFrame([(f"170000100{k}", s, float(1 + abs(k - s) * 4)) for k in range(4) for s in (1, 2)], "zone_id string, source_id int, minutes double")
    out = pipeline.interpolate_election("ito", crosswalk, tracts, census, sources, od, 2014, alpha=2.0)
    values = {r.zone_id: r.value for r in out.values.collect()}
    assert set(values) == {f"170000100{k}" for k in range(3)} and sum(values.values()) == pytest.approx(100) and out.meta["census_year"] == 2010 and len(out.meta["calibration"]) == 14
    half = [ring((0, 0), (1.5, 0), (1.5, 1), (0, 1))]
    assert {r.zone_id for r in pipeline.interpolate_election("ito", crosswalk, tracts, census, sources, od, 2014, clip=half, alpha=2.0).values.collect()} == {"1700001000", "1700001001"}
    assert pipeline.coefficients(out).count() == 3 and {(r.type, r.variable) for r in pipeline.summarise(out).collect()} == {("candidate", "CAND_13")}
    again = pipeline.reinterpolate(out, sources.filter("cod_mun_tse = '7'"), ["QT_APTOS"])
    assert again.values.agg(F.sum("value")).first()[0] == pytest.approx(10)
    history = spark.createDataFrame([(2, 1.0), (1, 2.0)], "epoch int, loss double")
    store.write_history(history, str(tmp_path / "h"))
    assert [r.epoch for r in spark.read.option("header", True).csv(str(tmp_path / "h")).collect()] == ["1", "2"]


# shapes


def test_points_on_surfaces_lie_inside(spark):
    rng = np.random.default_rng(4)
    shapes = {f"s{k}": [_star(rng, 0, 0, 3, 13)] + ([_star(rng, 0, 0, 0.5)] if k % 3 == 0 else []) for k in range(40)} | {"u": [U], "hole": [SQUARE, HOLE]}
    rows = [*shapes.items(), ("none", []), ("null", None), ("line", [ring((0, 0), (1, 0), (2, 0))]), ("short", [ring((0, 0), (1, 1))])]
    out = geo.points_on_surface(spark.createDataFrame(rows, f"zone_id string, rings {RINGS}")).collect()
    assert {r.zone_id for r in out} == set(shapes)
    assert all(_inside(shapes[r.zone_id], r.x, r.y) for r in out)


def test_lines_that_meet_zones(spark):
    rng = np.random.default_rng(5)
    shapes = {k: [_star(rng, rng.uniform(-50, -46), rng.uniform(-12, -8), 1.0, 9)] for k in range(15)}
    lines = {k: [(float(x), float(y)) for x, y in zip(-48 + rng.uniform(-3, 3, n), -10 + rng.uniform(-3, 3, n))] for k, n in enumerate(rng.integers(2, 5, 80).tolist())}
    lines |= {100: [(-48.0, -10.0)], 101: [(-48.0, -10.0)] * 2, 102: [(-20.0, 0.0), (-19.0, 0.0)]}
    cover = proximity.cover_regions(spark.createDataFrame(list(shapes.items()), f"code int, rings {RINGS}"), "code", "rings").cache()
    table = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in p]) for k, p in lines.items()] + [(200, None), (201, [])], "line_id int, points array<struct<x: double, y: double>>")
    out = geo.lines_in_regions(table, cover).collect()

    def crosses(a, b, c, d):
        turn = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
        return turn(a, b, c) != turn(a, b, d) and turn(c, d, a) != turn(c, d, b)

    def meets(line, rings):
        edges = [((p["x"], p["y"]), (q["x"], q["y"])) for r in rings for p, q in zip(r, r[1:] + r[:1])]
        return len(line) > 1 and (any(_inside(rings, *p) for p in line) or any(crosses(a, b, *e) for a, b in zip(line, line[1:]) for e in edges))

    truth = {(k, c) for k, line in lines.items() for c, rings in shapes.items() if meets(line, rings)}
    assert len(out) == len(truth) and {(r.line_id, r.region) for r in out} == truth and len(truth) > 50
    assert geo.lines_in_regions(table, cover.limit(0)).count() == 0


def test_overlaps_against_a_fine_grid():
    rng = np.random.default_rng(6)
    assert geo.overlap_area([SQUARE], [SQUARE]) == 16 and geo.overlap_area([SQUARE, HOLE], [U]) == pytest.approx(7)
    assert geo.overlap_area([SQUARE], [ring((5, 5), (6, 5), (6, 6))]) == 0 == geo.overlap_area([], [SQUARE]) == geo.overlap_area(None, [SQUARE])
    for _ in range(6):
        a, b = [_star(rng, 0, 0, 2), _star(rng, 0, 0, 0.4)], [_star(rng, 0.5, 0.3, 2)]
        g = np.linspace(-3, 3, 401)
        x, y = (c.ravel() for c in np.meshgrid(g, g))
        both = proximity._odd(proximity._edges(a), x, y) & proximity._odd(proximity._edges(b), x, y)
        assert geo.overlap_area(a, b) == pytest.approx(both.mean() * (6 + 6 / 400) ** 2, abs=0.05)


def test_weighted_points_prefer_roads_of_better_tiers(spark):
    cells = [("z", x, y, float(p)) for x, y, p in ((0, 0, 5), (1, 0, 9), (1, 1, 7), (5, 5, 20), (9, 9, 0))] + [("w", 0, 0, 1.0), ("w", 3, 3, 1.0)]
    table = spark.createDataFrame(cells, "zone_id string, cx int, cy int, pop double").withColumns({"x": F.col("cx") * 0.01, "y": F.col("cy") * 0.01})
    labelled = spatial.patches(table)
    pick = lambda near: {r.zone_id: (r.patch, r.n_patches, r.cx, r.cy, r.near_road, r.tier) for r in geo.weighted_points(labelled, near).collect()}
    assert pick(None) == {"z": (1, 2, 1, 0, False, None), "w": (1, 2, 0, 0, False, None)}
    roads = spark.createDataFrame([("z", 3, -0.01, 0.0, 0.02, 0.0), ("z", 2, -0.01, 0.01, 0.02, 0.01), ("w", 1, 0.5, 0.5, 0.6, 0.6)], "zone_id string, tier int, x1 double, y1 double, x2 double, y2 double")
    near = geo.near_roads(table, roads)
    assert {(r.cx, r.cy, r.tier) for r in near.collect()} == {(0, 0, 3), (1, 0, 3), (1, 1, 2)}
    assert pick(near) == {"z": (1, 2, 1, 1, True, 2), "w": (1, 2, 0, 0, False, None)}
    assert geo.weighted_points(labelled.limit(0), near.limit(0)).count() == 0


def test_representative_points_by_method(spark):
    zones = spark.createDataFrame([("big", [ring((0, 0), (1, 0), (1, 1), (0, 1))]), ("small", [ring((2, 0), (2.001, 0), (2.001, 0.001), (2, 0.001))]), ("bare", [ring((3, 0), (4, 0), (4, 1), (3, 1))])], f"zone_id string, rings {RINGS}")
    cells = spark.createDataFrame([("big", 0, 0, 0.1, 0.2, 5.0), ("big", 1, 1, 0.3, 0.4, 9.0), ("small", 0, 0, 2.0, 0.0, 5.0), ("bare", 0, 0, 3.0, 0.0, 0.0)], "zone_id string, cx int, cy int, x double, y double, pop double")
    out = {r.zone_id: (round(r.x, 4), round(r.y, 4), r.how) for r in geo.representative_points(zones, "pop_weighted", cells).collect()}
    assert out == {"big": (0.3, 0.4, "pop_weighted"), "small": (2.0005, 0.0005, "point_on_surface"), "bare": (3.5, 0.5, "point_on_surface")}
    assert {r.zone_id: (r.x, r.y) for r in geo.representative_points(zones, "centroid").collect()}["bare"] == pytest.approx((3.5, 0.5))
    with pytest.raises(ValueError):
        geo.representative_points(zones, "pop_weighted")


# tables


def test_a_dense_grid_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(times, "GRID", 3)
    zones, sources = spark.range(10).toDF("zone_id"), spark.range(7).toDF("source_id")
    grid = times.dense(zones, sources, spark.createDataFrame([(1, 2, 5.0), (3, 3, float("inf"))], "zone_id bigint, source_id bigint, minutes double"), 9.0)
    rows = {(r.zone_id, r.source_id): r.minutes for r in grid.collect()}
    assert len(rows) == 70 == grid.count() and rows[1, 2] == 5.0 and rows[3, 3] == 9.0
    assert times.dense(zones.limit(0), sources).count() == 0


def test_shares_of_the_town(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 6.0), (3, None)], "zone_id int, v double")
    assert [r.q for r in res.with_quantity(rows, "v", "pct_muni", "q").orderBy("zone_id").collect()] == [25.0, 75.0, None]
    assert [r.q for r in res.with_quantity(rows.filter("v > 9"), "v", "pct_muni", "q").collect()] == []
