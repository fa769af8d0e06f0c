from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from dasymetra.operators.integrity import Reference, orphan_references, orphan_report, whole_number

DAY = datetime(2020, 1, 1)


def _run(spark, parents, children):
    p = spark.createDataFrame(parents, "k string, a timestamp, b timestamp")
    c = spark.createDataFrame(children, "id bigint, k string, t timestamp")
    key = (whole_number(F.col("k")),)
    return orphan_references(p, key, F.col("a"), F.col("b"), [Reference("child", c, key, F.col("id"), F.col("t"), F.year("t"))], "parent")


def _state(parents, key, t):
    mine = [(a, b) for k, a, b in parents if k is not None and key is not None and k.strip().lstrip("0") == key.strip().lstrip("0")]
    if not mine:
        return "missing"
    low, high = datetime.min, datetime.max
    t = low if t is None else t
    if any((a or high) <= t and (b is None or b > t) for a, b in mine):
        return None
    return "late" if all((a or high) > t for a, _ in mine) else "deleted"


def test_states_against_the_definition(spark):
    rng = np.random.default_rng(2)
    at = lambda: DAY + timedelta(hours=int(rng.integers(0, 90)))
    parents = []
    for _ in range(300):
        a = at()
        parents.append((f"{'0' * rng.integers(0, 3)}{rng.integers(1, 60)} ", a, None if rng.random() < 0.2 else a + timedelta(hours=int(rng.integers(0, 30)))))
    parents += [(None, at(), None), ("7", None, None)] + parents[:20]
    children = [(i, f" {rng.integers(1, 80)}", at()) for i in range(3000)] + [(9000, None, at()), (9001, "5", None), (9002, "5", None), (9003, "x", at())]
    children += children[:50]
    out = {(r.rec_id, r.state) for r in _run(spark, parents, children).collect()}
    truth = {(i, s) for i, k, t in children if (s := _state(parents, k, t))}
    assert out == truth
    assert {s for _, s in out} == {"missing", "late", "deleted"}


def test_a_hot_key_and_empty_tables(spark):
    parents = [("1", DAY + timedelta(minutes=i), DAY + timedelta(minutes=i + 1)) for i in range(0, 4000, 2)]
    children = [(i, "1", DAY + timedelta(minutes=i)) for i in range(4000)]
    out = _run(spark, parents, children)
    assert sorted(r.rec_id for r in out.collect()) == list(range(1, 4000, 2))
    assert [(r.period, r.state, r.n_rows) for r in orphan_report(out, "parent").collect()] == [("2020", "deleted", 2000)]
    assert _run(spark, [], children[:3]).count() == 3
    assert _run(spark, parents, []).count() == 0
