import random

import pytest
from pyspark.sql import functions as F

from dasymetra.llm.mixing import budgets, hash60, mix, shares, thresholds


def _sizes(spark, n=400, seed=0):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["big"] * 6 + ["mid", "mid", "small"]), rnd.randint(1, 90)) for i in range(n)]
    rows += rows[:10] + [(9001, None, 5), (9002, "none", 7), (None, "big", 3), (9003, "big", None), (9004, "big", -4), (9005, "big", 0)]
    return spark.createDataFrame(rows, "id bigint, source string, n_tokens bigint")


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 9), ("zero", 0.0, 1), (None, 0.4, 1), ("mid", 0.0, 3)]


def _targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def _by_hand(sizes, plan):
    """Sort by hash and take records while the budget lasts."""
    rows = sizes.withColumn("h", hash60(F.col("id"))).collect()
    out = {}
    for b in plan:
        mine = sorted((r for r in rows if r.source == b.source), key=lambda r: r.h)
        rest, extra, k = b.rest, set(), 0
        while k < len(mine):
            same = [r for r in mine if r.h == mine[k].h]
            cost = sum(max(0, r.n_tokens or 0) for r in same)
            if cost > rest:
                break
            rest -= cost
            extra.add(mine[k].h)
            k += len(same)
        for r in mine:
            if n := b.whole + (r.h in extra):
                out.setdefault((r.id, r.source, r.n_tokens, n), 0)
                out[r.id, r.source, r.n_tokens, n] += 1
    return out


@pytest.mark.parametrize("total", [None, 100.0, 5000.0, 1e9, 1.0])
def test_against_sorting(spark, total):
    sizes, targets = _sizes(spark).cache(), _targets(spark)
    got = {}
    for r in mix(sizes, targets, total).collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == _by_hand(sizes, budgets(sizes, targets, total))


def test_shares_are_reached_within_repeats(spark):
    sizes, targets = _sizes(spark, 3000).cache(), _targets(spark)
    report = {r.source: r for r in shares(sizes, targets, mix(sizes, targets)).collect()}
    for source, share, most in TARGETS[:3]:
        assert report[source].actual_share == pytest.approx(share / 0.95, abs=0.005)
        assert report[source].most_repeats <= most
    assert max(report[s].used_tokens / (report[s].available_tokens * m) for s, _, m in TARGETS[:3]) > 0.98
    assert report["none"].used_tokens == report["absent"].used_tokens == report[None].used_tokens == 0
    assert len(report) == 7


def test_a_larger_total_keeps_what_a_smaller_one_has(spark):
    sizes, targets = _sizes(spark, 1500).cache(), _targets(spark)
    few, many = ({r.id: r.repeats for r in mix(sizes, targets, t).collect()} for t in (2000.0, 6000.0))
    assert few and all(many.get(i, 0) >= n for i, n in few.items())


def test_one_hash_for_a_whole_source_and_nothing_to_mix(spark):
    same = spark.createDataFrame([(7, "big", 10)] * 50, "id bigint, source string, n_tokens bigint").cache()
    targets = _targets(spark, [("big", 1.0, 1)])
    assert mix(same, targets, 499.0).count() == 0 and mix(same, targets, 500.0).count() == 50
    assert mix(same.limit(0), targets).count() == 0 and mix(same, targets.limit(0)).count() == 0
    empty = mix(same, targets.limit(0))
    assert [r.actual_share for r in shares(same, targets, empty).collect()] == [None]
    assert thresholds(same, []) == {}
