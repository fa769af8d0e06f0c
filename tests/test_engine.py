import numpy as np
import pytest
from pyspark.sql import functions as F

from dasymetra.functions import breaks as brk
from dasymetra.functions import text
from dasymetra.operators import od as times
from dasymetra.operators import result as res
from dasymetra.operators import spatial as sp
from dasymetra.operators import votes as vt
from dasymetra.plans import pipeline
from dasymetra.sources import staged, store
from dasymetra.streaming import incremental


def _one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize("value, f, expected", [
    (" SÃO JOÃO ", text.name_key, "SAO JOAO"), ("RIO  DAS OSTRAS", text.title_case, "Rio das Ostras"), ("7", text.padded, "00007"), ("123456", text.padded, "123456"), ("0007 ", text.unpadded, "7"),
    ("x", text.unpadded, None), ("1,5", text.decimal_comma, 1.5), ("Ensino Médio Incompleto", text.education, "MEDIO_INCOMP"), ("Superior completo", text.education, "SUP_COMP"), ("Lê e escreve", text.education, "LE_ESCREVE"),
    ("pop_hom_18_20", text.bracket_label, "Male 18-20"), ("votantes_60_mais", text.bracket_label, "60+"), ("11", text.office_label, "prefeito"), ("99", text.office_label, "CARGO99"), (None, text.name_key, None), ("", text.title_case, ""),
])
def test_text_functions(spark, value, f, expected):
    assert _one(spark, value, f) == expected


def test_offices():
    assert text.office_code("Prefeito") == 11 and text.office_code(3) == 3
    with pytest.raises(ValueError):
        text.office_code("rei")


def test_wide_sums_and_forces_columns(spark):
    rows = spark.createDataFrame([(1, "x", 100), (1, "x", 50), (1, "y", 200), (2, "z", 5), (None, "x", 1)], "k int, n string, v int")
    out = {r.k: (r.P_x, r.P_y, r.P_w) for r in vt.wide(rows, ["k"], F.col("n"), F.col("v"), ["x", "y", "w"], "P_").collect()}
    assert out == {1: (150, 200, 0), 2: (0, 0, 0), None: (1, 0, 0)}


def test_aliases(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], "CODIGO_CARGO string, CD_CARGO string, NUM_ZONA string, NR_SECAO string")
    assert staged.with_aliases(df).first().asDict() == {"CD_CARGO": "a", "NR_ZONA": "c", "NR_SECAO": "d"}
    with pytest.raises(ValueError, match="QT_VOTOS"):
        staged.votes(df)


def test_od_orientation_nearest_and_modes(spark):
    zones = spark.createDataFrame([("z1",), ("z2",)], "zone_id string")
    sources = spark.createDataFrame([("s1",), ("s2",)], "source_id string")
    routes = spark.createDataFrame([("s1", "z1", 5.0), ("s2", "z1", 5.0), ("s1", "z2", float("inf"))], "from_id string, to_id string, minutes double")
    turned = times.oriented(routes, zones)
    dense = times.dense(zones, sources, turned)
    assert dense.count() == 4 and dense.filter("minutes IS NULL").count() == 2
    assert [tuple(r) for r in times.nearest(dense).collect()] == [("z1", "s1", 5.0)]
    car = times.dense(zones, sources, fill_missing=1.0)
    assert {r.mode for r in times.auto_mode(dense, car, 0.5).collect()} == {"CAR"} and {r.mode for r in times.auto_mode(dense, car, 0.6).collect()} == {"WALK"}


def test_resolver_priorities(spark):
    rows = [("CAND_13", "candidate", "13", "ANA DE SÁ", "PT"), ("PARTY_13", "party", None, None, "13"), ("CAND_22", "candidate", "22", "JOÃO SÁ", "PL")]
    d = spark.createDataFrame(rows, "column string, type string, ballot_number string, candidate_name string, party string")
    assert res.resolved(d, "13") == ["CAND_13"] and res.resolved(d, "PARTY_13") == ["PARTY_13"] and res.resolved(d, "joao") == ["CAND_22"]
    with pytest.raises(KeyError):
        res.resolved(d, "sa")
    assert res.resolved(d, "sa", True) == ["CAND_13", "CAND_22"]
    with pytest.raises(KeyError):
        res.resolved(d, "nobody")
    there = spark.createDataFrame([("CAND_13",), ("GOV_CAND_45",), ("PARTY_PSOL",), ("QT_APTOS",)], "column string")
    assert res.resolved(None, 45, columns=there) == ["GOV_CAND_45"] and res.resolved(None, "psol", columns=there) == ["PARTY_PSOL"] and res.resolved(d, "QT_APTOS", columns=there) == ["QT_APTOS"]
    with pytest.raises(KeyError, match="there are CAND_13"):
        res.resolved(d, "nobody", columns=there)
    many = spark.range(300).select(F.format_string("P%03d_CAND_7", "id").alias("column"))
    assert len(res.resolved(None, "7", True, many)) == 300
    with pytest.raises(KeyError, match="and 292 more"):
        res.resolved(None, "7", columns=many)


def test_quantities_do_not_divide_by_nothing(spark):
    row = spark.createDataFrame([(5.0, 0.0, 1.0, 2.0)], "v double, t double, b double, n double")
    more = {"turnout": F.col("t"), "blank": F.col("b"), "null": F.col("n"), "eligible": F.col("t"), "km2": F.col("t")}
    out = {k: res.with_quantity(row, "v", k, **more).first().quantity for k in res.QUANTITIES}
    assert out == {"absolute": 5.0, "pct_tract": None, "pct_muni": 100.0, "pct_valid": None, "pct_eligible": None, "density": None}


def test_breaks(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 11, 12, 50)] + [(None,)], "v double")
    assert brk.breaks(v, "v", "quantile", 2) == [1.0, 10.0, 50.0]
    assert brk.natural([1, 2, 3, 10, 11, 12, 50], 3) == [1, 3, 12, 50]
    assert brk.breaks(v.limit(0), "v") == [] and brk.breaks(v, "v", [3.0, 1.0]) == [1.0, 3.0]
    out = [r.c for r in v.select(brk.classed(F.col("v"), [1.0, 3.0, 12.0, 50.0]).alias("c")).collect()]
    assert out == [1, 1, 1, 2, 2, 2, 3, None]
    assert brk.labels([0.0, 0.5, 1.0], "pct_valid") == ["0.0–0.5%", "0.5–1.0%"] and brk.labels([0.0, 1234.4, 2000.0]) == ["0–1,234", "1,234–2,000"]
    assert brk.labels([float("-inf"), 1.25, 1.26, float("inf")], "density") == ["<1.2/km²", "1.2–1.3/km²", ">1.3/km²"]
    assert brk.clean([1.23456, 2.34567, 1.23456 + 1e-12]) == [1.23, 2.35] and brk.clean([1000.4, 1000.6, 1e-9]) == [0.0, 1000.0, 1001.0] and brk.clean([5.0]) == [5.0]


def test_quantiles_equal_those_of_all_values(spark):
    v = np.round(np.random.default_rng(3).normal(size=2001), 2)
    shares = [0.0, 0.1, 0.33, 0.5, 0.999, 1.0]
    rows = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    assert np.allclose(brk.quantiles(rows, "v", shares), np.quantile(v, shares))
    assert brk.quantiles(rows.limit(0), "v", shares) == []


def test_moran_on_a_chessboard_and_on_halves(spark):
    zones = spark.createDataFrame([(5 * y + x, float(x), float(y)) for x in range(5) for y in range(4)], "zone_id int, x double, y double")
    corner = lambda i, j: F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y"))
    links = sp.neighbours(zones.withColumn("rings", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))))
    assert links.count() == 2 * (4 * 4 + 5 * 3 + 2 * 4 * 3)
    halves = sp.lagged(zones.select("zone_id", (F.col("x") < 2).cast("double").alias("value")), links)
    assert sp.morans_i(halves).first().moran_i > 0.5
    p = sp.permutation_p(halves, 199)
    assert p.count() == 20 and {r.cluster for r in p.collect()} <= {"HH", "LL", "HL", "LH", "NS"}
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, sp.permutation_p(halves, 199).collect()))


def test_two_clusters(spark):
    cells = [("z", 0, 0, 50.0), ("z", 1, 1, 40.0), ("z", 1, 2, 30.0), ("z", 8, 8, 100.0), ("z", 4, 4, 0.0), ("y", 0, 0, 1.0)]
    table = spark.createDataFrame(cells, "zone_id string, cx int, cy int, pop double")
    labelled = sp.patches(table.union(table.limit(1)))
    assert {(r.zone_id, r.cx, r.cy): r.patch for r in labelled.collect()} == {("z", 0, 0): 1, ("z", 1, 1): 1, ("z", 1, 2): 1, ("z", 8, 8): 2, ("y", 0, 0): 1}
    assert {(r.zone_id, r.patch, r.patch_pop, r.cx, r.cy) for r in sp.best_cells(labelled).collect()} == {("z", 1, 120.0, 0, 0), ("y", 1, 1.0, 0, 0)}


def test_clip_and_shoelace(spark):
    ring = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert sp.clipped_share(ring, (1, -5, 5, 1)) == pytest.approx(0.25) and sp.clipped_share(ring, (5, 5, 6, 6)) == 0
    df = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 0.0}, {"x": 0.0, "y": 3.0}],)], "r array<struct<x: double, y: double>>")
    out = df.select(sp.signed_area(F.col("r")).alias("a"), sp.centroid(F.col("r")).alias("c")).first()
    assert out.a == pytest.approx(4.5) and out.c.x == pytest.approx(1) and out.c.y == pytest.approx(1)


def test_store(spark, tmp_path):
    assert store.cache_key(year=2020, parties=["pt", "MDB"], what=["a", "b"]) == store.cache_key(what=["b", "a"], parties=["mdb", "PT"], year=2020) != store.cache_key(year=2022)
    df = spark.range(5)
    assert store.write_cached(df, str(tmp_path), "kind", "k1").count() == 5
    assert store.read_cached(spark, str(tmp_path), "kind", "k1").count() == 5 and store.read_cached(spark, str(tmp_path), "kind", "k2") is None
    assert store.list_cached(str(tmp_path)) == {"kind": ["k1"]} and store.clean_cached(str(tmp_path), containing="k") == 1


def _setting(spark):
    zones = spark.createDataFrame([("z1", 100, 50), ("z2", 300, 100), ("z3", 0, 0), ("z4", 80, 70)], "id string, pop_a int, pop_b int")
    sources = spark.createDataFrame([("s1", 200, 90, 10, 1.5), ("s2", 250, 120, 20, 2.5)], "pid string, v_a int, v_b int, CAND_13 int, extra double")
    od = spark.createDataFrame([("z1", "s1", 5.0), ("z1", "s2", 20.0), ("z2", "s1", 15.0), ("z2", "s2", 8.0), ("z3", "s1", 1.0), ("z4", "s1", None)], "zone_id string, source_id string, minutes double")
    return zones, sources, od


def test_pipeline_conserves_and_brings_back_unreachable_zones(spark, tmp_path):
    zones, sources, od = _setting(spark)
    pairs = [("pop_a", "v_a"), ("pop_b", "v_b")]
    out = pipeline.interpolate(zones, sources, od, pairs, zone_id="id", source_id="pid", alpha=2.0)
    values = {(r.zone_id, r.variable): r.value for r in out.values.collect()}
    assert set(values) == {(z, v) for z in ("z1", "z2", "z4") for v in ("CAND_13", "extra")} and values["z4", "extra"] is None
    assert values["z1", "CAND_13"] + values["z2", "CAND_13"] == pytest.approx(30)
    again = pipeline.reinterpolate(out, sources, ["v_a"], "pid")
    assert again.values.agg(F.sum("value")).first()[0] == pytest.approx(450)
    assert pipeline.wide_values(out).columns == ["zone_id", "CAND_13", "extra"]
    store.save_result(out, str(tmp_path / "r"))
    assert store.load_result(spark, str(tmp_path / "r"), res.Interpolation).weights.count() == out.weights.count()
    with pytest.raises(ValueError):
        store.load_result(spark, str(tmp_path / "r"), dict)
    with pytest.raises(ValueError, match="nope"):
        pipeline.interpolate(zones, sources, od, [("nope", "v_a")], zone_id="id", source_id="pid")


def test_pipeline_fits(spark):
    from dasymetra.operators.fit import Control

    zones, sources, od = _setting(spark)
    out = pipeline.interpolate(zones, sources, od, [("pop_a", "v_a"), ("pop_b", "v_b")], zone_id="id", source_id="pid", control=Control(max_epochs=40))
    assert out.alpha.filter("alpha >= 1").count() == out.alpha.count() > 0
    assert out.fitted.agg(F.sum("fitted")).first()[0] == pytest.approx(660)


def test_prepared_sources(spark):
    profile = spark.createDataFrame([("01", "7", "1", "18 anos", 5), ("1", "007", "1", "nobody", 9), ("1", "8", "2", "20 anos", 4), ("1", "8", "2", "16 anos", 7)], "zone string, place string, section string, age string, n int")
    votes = spark.createDataFrame([("1", "7", "01", "11", "13", "ANA", "PT", 3), ("1", "8", "2", "11", "22", "JO", "PL", 4), ("1", "8", "2", "13", "13", "ANA", "PT", 9)], "zone string, place string, section string, office string, ballot string, name string, party string, votes int")
    places = spark.createDataFrame([("1", "7", -9.0, -50.0), ("1", "8", None, None)], "zone string, place string, lat double, lon double")
    fallback = spark.createDataFrame([("1", "8", -8.0, -51.0)], "zone string, place string, lat double, lon double")
    rows, dictionary = pipeline.prepare_sources(profile, votes, places, fallback, ["13", "22"], ["votantes_20", "votantes_18_19"])
    got = [(r.source_id, r.lat, r.votantes_20, r.votantes_18_19, r.CAND_13, r.CAND_22, r.QT_COMPARECIMENTO) for r in rows.orderBy("source_id").collect()]
    assert got == [(1, -9.0, 0, 5, 3, 0, 3), (2, -8.0, 4, 0, 9, 4, 4)]
    assert {r.ballot_number for r in dictionary.collect()} == {"13", "22"}


def test_assembled_times(spark):
    zones, sources, _ = _setting(spark)
    z, s = zones.select(F.col("id").alias("zone_id")), sources.select(F.col("pid").alias("source_id"))
    walk = spark.createDataFrame([("z1", "s1", 5.0), ("z2", "s1", 500.0)], "zone_id string, source_id string, minutes double")
    out = pipeline.assemble_od(z, s, walk, retry=walk.withColumn("minutes", F.lit(7.0)), routing=pipeline.Routing("WALK", fill_missing=99.0))
    got = {(r.zone_id, r.source_id): r.minutes for r in out.collect()}
    assert len(got) == 8 and got["z1", "s1"] == 5 and got["z2", "s1"] == 7 and got["z4", "s2"] == 99
    with pytest.raises(ValueError):
        pipeline.Routing("FLY")


def test_stream_adds_up_to_the_batch(spark, tmp_path):
    weights = spark.createDataFrame([("z1", "s1", 0.25), ("z2", "s1", 0.75), ("z1", "s2", 1.0)], "zone_id string, source_id string, w double")
    rows = [(f"k{i}", "s1" if i % 3 else "s2", "v", float(i)) for i in range(60)]
    arrivals = spark.createDataFrame(rows, "k string, source_id string, variable string, value double")
    arrivals.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    incremental.start(incremental.zone_totals(stream, weights), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(120)
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("zone_id").agg(F.max_by("value", "batch").alias("value"))
    batch = incremental.zone_totals(arrivals, weights)
    assert {r.zone_id: r.value for r in last.collect()} == pytest.approx({r.zone_id: r.value for r in batch.collect()})


def test_one_town(spark):
    towns = spark.createDataFrame([("1234567", "00123", "SC", " São Itó "), ("7654321", "00456", "PR", "SAO ITO"), ("1111111", "00789", "SC", None)], "code_ibge string, code_tse string, uf string, nome string")
    assert pipeline.resolve_town(towns, "são itó", "sc").code_tse == "00123" and pipeline.resolve_town(towns, "123").code_ibge == "1234567" and pipeline.resolve_town(towns, "7654321").uf == "PR"
    for bad in ("sao ito", "nowhere"):
        with pytest.raises(KeyError):
            pipeline.resolve_town(towns, bad)
    assert pipeline.columns_by_kind(["QT_APTOS", "CAND_1", "A_CAND_2", "PARTY_X", "v"], ["turnout", "candidates", "turnout"]) == ["QT_APTOS", "CAND_1", "A_CAND_2"]
    with pytest.raises(ValueError):
        pipeline.columns_by_kind([], ["weather"])
    zones, sources, od = _setting(spark)
    zones, sources = zones.withColumn("code_muni", F.lit("1234567")), sources.withColumn("cod_mun_tse", F.when(F.col("pid") == "s1", "123").otherwise("456"))
    out = pipeline.interpolate_town("123", towns, zones, sources, od, [("pop_a", "v_a")], zone_id="id", source_id="pid", alpha=1.0)
    assert out.values.agg(F.sum("value")).first()[0] == pytest.approx(10) and out.meta["town"]["uf"] == "SC" and out.meta["variables"] == ["CAND_13"]
