"""Queries that once left out part of their input, against SQL over all of it; the operators behind them against brute force."""

import itertools
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from dasymetra.functions import breaks as brk
from dasymetra.operators import fit as ft
from dasymetra.plans import pipeline

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def _sql(query):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return sorted(con.execute(query).fetchall(), key=repr)


def _rows(spark, name, *columns):
    return sorted(map(tuple, __spark_entry__.queries()[name](spark, FOLDER).select(*columns).collect()), key=repr)


@tables
def test_heatmap_has_every_zone_and_source(spark):
    rows = _rows(spark, "heatmap_order", "zone_id", "place", "source_id", "minutes")
    assert rows == _sql("""WITH p AS (SELECT n_nationkey AS zone_id, CAST(row_number() OVER (ORDER BY n_nationkey // 5, n_nationkey) AS INTEGER) AS place FROM nation)
      SELECT zone_id, place, s_suppkey, CASE WHEN (zone_id * 31 + s_suppkey * 17) % 11 > 0 THEN CAST(abs(zone_id - s_nationkey) * 3 + s_suppkey % 7 + 1 AS DOUBLE) END FROM p, supplier""")


def _course(control, evaluate):
    """Converged and number of epochs of a fit of one zone and bracket in which evaluate(epoch) gives loss, deviance, gradient and sources."""
    seen = []

    def next_one(alpha, *_):
        seen.append(1)
        loss, deviance, gradient, sources = evaluate(len(seen))
        return loss, deviance, np.full_like(alpha, gradient * (-1) ** len(seen)), sources

    _, history, converged = ft._descend(np.ones((1, 1)), np.array([True]), control, next_one, 5)
    return converged, len(history)


def test_a_gradient_is_judged_by_theta_and_the_window_only_at_low_rates():
    assert ft.Control().max_epochs == 50_000
    assert _course(ft.Control(max_epochs=700), lambda e: (50_000.0, 50_000.0, 4.0, 1.0)) == (False, 700)
    converged, epochs = _course(ft.Control(max_epochs=3000), lambda e: (50_000.0, 50_000.0, 4.0, 1.0))
    assert converged and 1200 < epochs < 1500
    assert _course(ft.Control(max_epochs=700), lambda e: (5.0, 5.0, 1e-9, 1.0)) == (True, 509)


@pytest.mark.parametrize("evaluate, expected", [
    (lambda e: (50.0, 50.0, 1e-9, 4.0), True),
    (lambda e: (50.0, 50.0, 1e-9, 4.1), False),
    (lambda e: (50.0, 50.0 * 1.0002**e, 1e-9, 4.0), False),
    (lambda e: (50.0 * 1.001**e, 50.0, 1e-9, 4.0), False),
])
def test_a_target_needs_a_steady_loss_weight_and_deviance(evaluate, expected):
    assert _course(ft.Control(max_epochs=650, target_sources=4.0, entropy=1.0), evaluate)[0] is expected


def test_the_gradient_of_the_pull_agrees_with_differences():
    r = np.random.default_rng(5)
    t, pop, src = r.uniform(1, 30, (6, 4)), r.uniform(20, 80, (6, 3)), r.uniform(50, 150, (4, 3))
    a, loss = r.uniform(1, 3, pop.shape), lambda x: ft.loss_and_gradient(x, np.log(t + 1), t > 0, src.T, pop, 1.0, 0.4, (4, np.log(2.0)))
    gradient, e = loss(a)[2], np.zeros_like(a)
    e[2, 1] = 1e-5
    assert abs((loss(a + e)[0] - loss(a - e)[0]) / 2e-5 - gradient[2, 1]) < 1e-5


def test_an_interpolation_keeps_the_course_of_its_fit(spark):
    zones = spark.createDataFrame([(1, 30.0), (2, 50.0), (3, 20.0)], "zone_id int, pop double")
    sources = spark.createDataFrame([(1, 60.0, 5.0), (2, 40.0, 7.0)], "source_id int, v double, x double")
    od = spark.createDataFrame([(z, s, float(3 * abs(z - s) + 1)) for z in (1, 2, 3) for s in (1, 2)], "zone_id int, source_id int, minutes double")
    out = pipeline.interpolate(zones, sources, od, [("pop", "v")], control=ft.Control(max_epochs=30))
    assert [r.epoch for r in out.history.orderBy("epoch").collect()] == list(range(1, 31)) and not out.history.filter("converged").count()
    population, voters = zones.selectExpr("zone_id", "'pop' bracket", "pop"), sources.selectExpr("source_id", "'pop' bracket", "v voters")
    checks = {r["check"]: r.status for r in pipeline.diagnose(out, population, voters, od).collect()}
    assert checks["convergence"] == "warn"


def test_natural_breaks_are_the_least_of_all_groupings():
    r = np.random.default_rng(7)
    for n in (1, 2, 3, 4, 9):
        x = sorted({float(v) for v in r.integers(0, 60, 8)})
        counts = r.integers(1, 9, len(x)).tolist()
        within = lambda a, b: float(np.cov(x[a:b], fweights=counts[a:b], bias=True)) * sum(counts[a:b]) if b - a > 1 else 0.0
        groups = [(0, *c, len(x)) for c in itertools.combinations(range(1, len(x)), min(n, len(x)) - 1)]
        loss = {tuple(sorted({x[0], *[x[e - 1] for e in g[1:]]})): sum(within(a, b) for a, b in zip(g, g[1:])) for g in groups}
        assert loss[tuple(brk.natural(x, n, counts))] == pytest.approx(min(loss.values()))


def test_breaks_weigh_values_and_lose_no_small_group(spark):
    few = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10, 11, 12, 50)], "v double")
    assert brk.breaks(few, "v", "jenks", 3, tidy=False) == [1, 3, 12, 50]
    many = spark.range(50_000).select((F.col("id") / 50_000).alias("v")).union(spark.createDataFrame([(500.0,)] * 3 + [(1000.0,)] * 4, "v double"))
    assert brk.breaks(many, "v", "jenks", 3) == [0.0, 1.0, 500.0, 1000.0]
    assert brk.breaks(many, "v", "jenks", 3, tidy=False) == [0.0, pytest.approx(49_999 / 50_000), 500.0, 1000.0]


def test_too_many_distinct_values_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(brk, "JENKS_VALUES", 5)
    with pytest.raises(ValueError, match="distinct"):
        brk.breaks(spark.range(6).select(F.col("id").cast("double").alias("v")), "v", "jenks", 3)


def _title(name):
    words = re.split(r"[ \t\n\x0b\f\r]+", name.strip(" ").lower())
    return " ".join(w if w in ("de", "da", "do", "das", "dos", "e") else w[:1].upper() + w[1:] for w in words)


@tables
def test_title_case_takes_every_name(spark):
    names = dict(_sql("SELECT code_ibge, nome FROM muni_crosswalk"))
    rows = _rows(spark, "title_case", "code_ibge", "name")
    assert len(rows) == _sql("SELECT count(*) FROM muni_crosswalk")[0][0]
    assert dict(rows) == {k: None if v is None else _title(v) for k, v in names.items()}
    assert "Aruçaba D'oeste" in dict(rows).values()


@tables
def test_multi_office_pivot_holds_every_vote(spark):
    rows = __spark_entry__.queries()["candidate_pivot_multi_office"](spark, FOLDER).collect()
    got = {(r.section, c): v for r in rows for c, v in r.asDict().items() if c != "section" and v}
    expected = _sql("""SELECT l_suppkey, l_returnflag || '_CAND_' || (l_partkey % 97), CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS v FROM lineitem
      JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING v <> 0""")
    assert got == {(s, c): v for s, c, v in expected} and any(c.startswith("N_") for _, c in got)


def test_the_spread_fit_leaves_out_sources_that_nothing_reaches(spark):
    r = np.random.default_rng(2)
    t, pop, src = r.uniform(1, 30, (7, 6)), r.uniform(20, 80, (7, 3)), r.uniform(50, 150, (6, 3))
    t[:, 4:], src[:4, 2], src[3] = np.nan, 0, 0
    rows = lambda a: [(i, j, None if np.isnan(x) else float(x)) for i, row in enumerate(a) for j, x in enumerate(row)]
    od = spark.createDataFrame(rows(t), "zone_id int, source_id int, minutes double")
    population = spark.createDataFrame(rows(pop), "zone_id int, bracket int, pop double")
    voters = spark.createDataFrame(rows(src), "source_id int, bracket int, voters double")
    control = ft.Control(max_epochs=6, target_sources=2.0)
    table, history, _ = ft.fit_large(od, population, voters, control, partitions=2)
    known, course, _ = ft.fit_arrays(t[:, :4], pop, src[:4], control)
    assert np.array(history) == pytest.approx(np.array(course))
    got = {(r.zone_id, r.bracket): r.alpha for r in table.collect()}
    assert got == pytest.approx({(i, b): known[i, b] for i in range(7) for b in range(3)})
