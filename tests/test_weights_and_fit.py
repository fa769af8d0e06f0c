import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from dasymetra.operators import fit as ft
from dasymetra.operators import weights as wt

T = [(2, 10, 25, 30, 50), (15, 3, 12, 28, 45), (40, 35, 20, 5, 8)]


def _od(spark, columns=T):
    return spark.createDataFrame([(i, j, None if t is None else float(t)) for j, c in enumerate(columns) for i, t in enumerate(c)], "zone_id int, source_id int, minutes double")


def _voters(spark, rows):
    return spark.createDataFrame([(j, b, float(v)) for j, r in enumerate(rows) for b, v in zip("ab", r)], "source_id int, bracket string, voters double")


def _population(spark, rows):
    return spark.createDataFrame([(i, b, float(v)) for i, r in enumerate(rows) for b, v in zip("ab", r)], "zone_id int, bracket string, pop double")


def test_columns_sum_to_one_and_totals_are_kept(spark):
    od, voters = _od(spark), _voters(spark, [(500, 0), (800, 0), (700, 0)])
    population = _population(spark, [(p, 0) for p in (100, 300, 150, 200, 250)])
    brackets = wt.active_brackets(population, voters)
    assert [r.bracket for r in brackets.collect()] == ["a"]
    w = wt.weight_matrix(od, 2.0, population, voters).collect()
    k = np.array([[(t + 1) ** -2.0 for t in c] for c in T])
    expected = k / k.sum(axis=1, keepdims=True)
    assert {(r.zone_id, r.source_id): pytest.approx(r.w) for r in w} == {(i, j): expected[j, i] for j in range(3) for i in range(5)}
    fitted = wt.fitted(wt.bracket_weights(od, 2.0, brackets), voters)
    assert fitted.agg(F.sum("fitted")).first()[0] == pytest.approx(2000)


def test_extreme_alpha_still_hands_out_everything(spark):
    w = wt.bracket_weights(_od(spark), 5000.0, spark.createDataFrame([("a",)], "bracket string"))
    assert [round(r[1], 9) for r in w.groupBy("source_id").agg(F.sum("w")).collect()] == [1.0] * 3


def test_unreachable_pairs_weigh_nothing(spark):
    od = _od(spark, [(None, 5, 5), (None, None, None)])
    w = wt.bracket_weights(od, 1.0, spark.createDataFrame([("a",)], "bracket string")).collect()
    assert sorted((r.zone_id, r.source_id, r.w) for r in w) == [(1, 0, 0.5), (2, 0, 0.5)]


def test_exponential_kernel_ignores_the_offset_and_power_needs_it(spark):
    od = _od(spark, [(0, 10, 20)])
    b = spark.createDataFrame([("a",)], "bracket string")
    one, two = (sorted(map(tuple, wt.bracket_weights(od, 0.05, b, "exponential", o).collect())) for o in (0.0, 5.0))
    assert one == two
    wt.check_od(od, "exponential", 0.0)
    with pytest.raises(ValueError):
        wt.check_od(od, "power", 0.0)
    with pytest.raises(ValueError):
        wt.check_od(_od(spark, [(-1, 2, 3)]), "exponential", 0.0)
    with pytest.raises(ValueError):
        wt.log_kernel(F.col("minutes"), F.lit(1.0), "gaussian")


def test_a_source_without_voters_takes_the_plain_mean(spark):
    voters = _voters(spark, [(0, 0), (10, 20), (5, 5)])
    population = _population(spark, [(1, 2)] * 5)
    w = wt.weight_matrix(_od(spark), 2.0, population, voters)
    assert all(abs(r[1] - 1) < 1e-9 for r in w.groupBy("source_id").agg(F.sum("w")).collect())


def test_offset_in_the_times_is_the_same_as_in_the_kernel(spark):
    b = spark.createDataFrame([("a",)], "bracket string")
    one = wt.bracket_weights(_od(spark), 1.5, b, offset=1.0)
    two = wt.bracket_weights(_od(spark).withColumn("minutes", F.col("minutes") + 1), 1.5, b, offset=0.0)
    assert one.select("zone_id", "source_id", F.round("w", 9)).exceptAll(two.select("zone_id", "source_id", F.round("w", 9))).count() == 0


def _problem(seed=0, n=6, m=4, k=3):
    r = np.random.default_rng(seed)
    t = r.uniform(1, 30, (n, m))
    t[1, 2] = np.nan
    return t, r.uniform(20, 80, (n, k)), r.uniform(50, 150, (m, k))


@pytest.mark.parametrize("entropy", [0.0, 0.7])
def test_gradient_agrees_with_differences(entropy):
    t, pop, src = _problem()
    mask = np.isfinite(t)
    phi = np.where(mask, np.log(np.where(mask, t, 0) + 1), 0)
    a = np.random.default_rng(1).uniform(1, 3, pop.shape)
    loss = lambda x: ft.loss_and_gradient(x, phi, mask, src.T, pop, 1.0, entropy)
    gradient = loss(a)[2]
    for i in range(len(a)):
        for b in range(a.shape[1]):
            e = np.zeros_like(a)
            e[i, b] = 1e-5
            assert abs((loss(a + e)[0] - loss(a - e)[0]) / 2e-5 - gradient[i, b]) < 1e-5


def test_fit_lowers_the_loss_and_keeps_its_bounds():
    t, pop, src = _problem()
    src[:, 2] = 0
    alpha, history, _ = ft.fit_arrays(t, pop, src, ft.Control(max_epochs=300))
    assert history[-1][1] < history[0][1] and len(history) == 300
    assert (alpha[:, :2] >= 1).all() and (alpha[:, 2] == 1).all()
    free, _, _ = ft.fit_arrays(t, pop, src, ft.Control(max_epochs=50, kernel="exponential", alpha_init=0.1))
    assert (free >= 0).all() and np.isfinite(free).all()


def test_dual_ascent_moves_towards_its_target():
    t, pop, src = _problem(3, 12, 8)
    sources = [ft.fit_arrays(t, pop, src, ft.Control(max_epochs=500, target_sources=x))[1][-1][4] for x in (1.5, 6.0)]
    assert sources[0] < sources[1]


@pytest.mark.parametrize("bad", [{"kernel": "x"}, {"rate": 0}, {"barrier": -1}, {"target_sources": 0.5}, {"max_epochs": 0}])
def test_control_is_checked(bad):
    with pytest.raises(ValueError):
        ft.Control(**bad)


def test_problems_are_fitted_apart(spark):
    t, pop, src = _problem()
    rows = lambda a: [(p, i, j, None if np.isnan(x) else float(x)) for p in (1, 2) for i, r in enumerate(a) for j, x in enumerate(r)]
    od = spark.createDataFrame(rows(t), "problem_id int, zone_id int, source_id int, minutes double")
    population = spark.createDataFrame(rows(pop), "problem_id int, zone_id int, bracket int, pop double")
    voters = spark.createDataFrame(rows(src), "problem_id int, source_id int, bracket int, voters double")
    out = ft.fit_problems(od, population, voters, ft.Control(max_epochs=60)).collect()
    assert len(out) == 2 * 6 * 3 and all(r.alpha >= 1 and r.epochs == 60 and not r.converged for r in out)
    expected = ft.fit_arrays(t, pop, src, ft.Control(max_epochs=60))[0]
    assert {(r.zone_id, r.bracket): round(r.alpha, 6) for r in out if r.problem_id == 2} == {(str(i), str(b)): round(float(expected[i, b]), 6) for i in range(6) for b in range(3)}


@pytest.mark.parametrize("settings", [{}, {"entropy": 0.5}, {"kernel": "exponential", "alpha_init": 0.2}])
def test_the_spread_fit_is_the_same_fit(spark, settings):
    t, pop, src = _problem(2, 7, 5)
    src[:, 1] = 0
    rows = lambda a: [(i, j, None if np.isnan(x) else float(x)) for i, r in enumerate(a) for j, x in enumerate(r)]
    od = spark.createDataFrame(rows(t), "zone_id int, source_id int, minutes double")
    population = spark.createDataFrame(rows(pop), "zone_id int, bracket int, pop double")
    voters = spark.createDataFrame(rows(src), "source_id int, bracket int, voters double")
    control = ft.Control(max_epochs=8, **settings)
    table, history, _ = ft.fit_large(od, population, voters, control, partitions=3)
    expected, known, _ = ft.fit_arrays(t, pop, src, control)
    assert [h[1] for h in history] == pytest.approx([h[1] for h in known])
    got = {(r.zone_id, r.bracket): r.alpha for r in table.collect()}
    assert got == pytest.approx({(i, b): expected[i, b] for i in range(7) for b in range(3)})


@pytest.mark.parametrize("target", [3.0, 5.0])
def test_a_target_of_effective_sources_is_met(target):
    r = np.random.default_rng(8)
    z, s = r.uniform(0, 40, (30, 2)), r.uniform(0, 40, (12, 2))
    t = np.sqrt(((z[:, None] - s[None]) ** 2).sum(2)) + 1
    pop = r.gamma(2, 40, (30, 3)).round() + 1
    w = np.exp(-2 * np.log(t + 1))
    src = ((w / w.sum(1, keepdims=True)).T @ pop).round()
    alpha, history, _ = ft.fit_arrays(t, pop, src, ft.Control(target_sources=target, max_epochs=6_000))
    reached = ft.loss_and_gradient(alpha, np.log(t + 1), np.isfinite(t), src.T.astype(float), pop, 1.0, 0.0)[3]
    free = ft.fit_arrays(t, pop, src, ft.Control())[1][-1][4]
    assert abs(reached - target) <= 0.05 * target and abs(free - target) > 0.05 * target


def test_problems_too_large_for_a_task_are_spread_among_others(spark, monkeypatch):
    od = spark.createDataFrame([(p, z, s, float(1 + (z * 7 + s * 3) % 11)) for p, n in ((1, 3), (2, 6)) for z in range(n) for s in range(n)], "problem_id int, zone_id int, source_id int, minutes double")
    pop = spark.createDataFrame([(p, z, b, 20.0 + z * 5 + k) for p, n in ((1, 3), (2, 6)) for z in range(n) for k, b in enumerate("ab")], "problem_id int, zone_id int, bracket string, pop double")
    voters = spark.createDataFrame([(p, s, b, 25.0 + s * 3 + k) for p, n in ((1, 3), (2, 6)) for s in range(n) for k, b in enumerate("ab")], "problem_id int, source_id int, bracket string, voters double")
    control = ft.Control(max_epochs=60)
    rows = lambda df: {(r.problem_id, r.zone_id, r.bracket): r.alpha for r in df.collect()}
    whole = rows(ft.fit_problems(od, pop, voters, control))
    monkeypatch.setattr(ft, "MOST_ELEMENTS", 50)
    parts = rows(ft.fit_problems(od, pop, voters, control))
    assert parts.keys() == whole.keys() and len(whole) == 18 and all(abs(parts[k] - a) < 1e-6 for k, a in whole.items())
    traced = ft.fit_problems(od, pop, voters, control, trace=True).filter("zone_id IS NULL").groupBy("problem_id").count().collect()
    assert {r.problem_id: r["count"] for r in traced} == {1: 60, 2: 60}


def _few_times(m, distinct, seed=4, n=5, k=5):
    """m sources of which many have the same times to all n zones, some pairs without a time, one source without any."""
    r = np.random.default_rng(seed)
    kinds = r.integers(1, 40, (n, distinct)).astype(float)
    kinds[r.random((n, distinct)) < 0.1] = np.nan
    kinds[:, 0] = np.nan
    t = kinds[:, r.integers(0, distinct, m)]
    return t, r.gamma(2, 40, (n, k)).round() + 1, r.gamma(2, 40, (m, k)).round()


@pytest.mark.parametrize("m,distinct", [(60, 7), (60, 60), (400, 3)])
def test_entropy_is_of_single_sources_even_if_their_times_are_equal(m, distinct):
    t, pop, src = _few_times(m, distinct)
    mask = np.isfinite(t)
    phi = np.where(mask, np.log(np.where(mask, t, 0) + 1), 0)
    strength, target = 9.0, np.log(4.0)

    def plain(alpha):
        k = np.where(mask[:, None, :], np.exp(-alpha[:, :, None] * phi[:, None, :]), 0.0)
        w = k / np.maximum(k.sum(axis=0), 1e-300)
        v = (w * src.T).sum(axis=2)
        agg = (w * (src.T / np.maximum(src.sum(axis=1), 1e-30))).sum(axis=1)
        p = agg / agg.sum(axis=1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        deviance = 2 * (v - pop * np.log(v) + pop * np.log(pop) - pop).sum()
        return deviance - np.log(v.sum(axis=1)).sum() + 3.0 * h.sum() + strength / 2 * len(h) * (h.mean() - target) ** 2, deviance, np.exp(h.mean())

    a = np.random.default_rng(1).uniform(1, 3, pop.shape)
    loss, deviance, gradient, sources = ft.loss_and_gradient(a, phi, mask, src.T, pop, 1.0, 3.0, (strength, target))
    assert (loss, deviance, sources) == pytest.approx(plain(a))
    for i, b in ((0, 0), (2, 1), (4, 4)):
        e = np.zeros_like(a)
        e[i, b] = 1e-5
        assert (plain(a + e)[0] - plain(a - e)[0]) / 2e-5 == pytest.approx(gradient[i, b], rel=1e-4, abs=1e-3)


def test_an_epoch_costs_by_different_times_not_by_sources():
    def seconds(distinct):
        t, pop, src = _few_times(12_000, distinct)
        began = time.process_time()
        assert len(ft.fit_arrays(t, pop, src, ft.Control(target_sources=4.0, max_epochs=60))[1]) == 60
        return time.process_time() - began

    seconds(200)
    # without a common column for equal times both take as long
    assert min(seconds(200) for _ in range(3)) < 0.5 * seconds(12_000)


def test_few_problems_have_a_task_each(spark):
    rows = lambda c, n: [(p, i, j, float(1 + (i * 7 + j * 3 + p) % 11)) for p in range(5) for i in range(n) for j in range(3)]
    od = spark.createDataFrame(rows("t", 4), "problem_id int, zone_id int, source_id int, minutes double")
    population = spark.createDataFrame(rows("p", 4), "problem_id int, zone_id int, bracket int, pop double")
    voters = spark.createDataFrame(rows("s", 3), "problem_id int, source_id int, bracket int, voters double")
    out = ft.fit_problems(od, population, voters, ft.Control(max_epochs=5)).select("problem_id", F.spark_partition_id().alias("task")).distinct().collect()
    assert len({r.problem_id for r in out}) == len({r.task for r in out}) == len(out) == 5


@pytest.mark.parametrize("t,src", [(np.full((3, 2), np.nan), np.ones((2, 2))), (np.ones((3, 2)), np.zeros((2, 2)))])
def test_nothing_to_reach_or_to_hand_out_is_no_error(t, src):
    alpha, history, _ = ft.fit_arrays(t, np.ones((3, 2)), src, ft.Control(max_epochs=5, target_sources=2.0))
    assert np.isfinite(alpha).all() and len(history) in (0, 5)
