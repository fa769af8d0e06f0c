import datetime

import pytest
from pyspark.sql import functions as F

from dasymetra.operators.attributes import Attribute, as_date, filled_cells, resolve, usable, widen

DEFS = [Attribute("qt_a", "int"), Attribute("pct", "decimal"), Attribute("ok_in", "boolean"), Attribute("dt", "date"), Attribute("failures", "string")]
T1, T2 = datetime.datetime(2020, 1, 1), datetime.datetime(2020, 1, 2)


@pytest.mark.parametrize("kind, good, bad", [
    ("int", ["0", " 12 ", "1.234", "12.345.678", "0012", "9" * 50], ["", "-1", "1.23", "1,234", "1 234", "12.3456", "１２", "1.2345", ".123", "95x"]),
    ("decimal", ["1", "1.5", "1,5", " 0,25 "], ["1.", ",5", "-1", "1.2.3", "13%", "1e3"]),
    ("boolean", ["S", "n", "SIM", "NÃO", "não", "True", "0", " yes "], ["nao", "y", "", "2", "t"]),
    ("date", ["2020-02-29", "29/02/2020", "29.02.2020", "20200229"], ["2021-02-29", "29-02-2020", "2020/02/29", "31/04/2020", "29/02.2020", "2020-2-9", "20201301"]),
    ("string", ["x", " x "], ["", "   "]),
])
def test_what_each_kind_takes(spark, kind, good, bad):
    rows = spark.createDataFrame([(v,) for v in good + bad] + [(None,)], "v string")
    out = [r.ok for r in rows.select(usable(F.col("v"), kind).alias("ok")).collect()]
    assert out == [True] * len(good) + [False] * (len(bad) + 1)


def test_dates_are_read_the_same_in_every_form(spark):
    rows = spark.createDataFrame([("2020-02-09",), ("09/02/2020",), ("09.02.2020",), ("20200209",)], "v string")
    assert {r.d for r in rows.select(as_date(F.col("v")).alias("d")).collect()} == {datetime.date(2020, 2, 9)}


def test_latest_row_counts_alone(spark):
    rows = [
        (1, "qt_a", "5", T1), (1, "QT A", "x", T2), (1, " Pct ", "1,5", None), (1, "pct", "2,5", T1), (1, "nothing", "1", T1), (1, None, "1", T1), (None, "pct", "1", T1),
        (2, "dt", "01/02/2020", T1), (2, "dt", "01/02/2020", T1), (2, "failures", " x ", T1), (2, "okin", None, T2), (2, "ok_in", "s", T1), (3, "nothing", "1", T1),
    ]
    table = spark.createDataFrame(rows, "ent bigint, name string, value string, at timestamp")
    wide = {r.ent: r for r in widen(resolve(table, "ent", "name", "value", "at", DEFS), DEFS, "ent").collect()}
    assert set(wide) == {1, 2}
    assert wide[1].qt_a is None and wide[1].pct == 2.5 and wide[1].failures == {"qt_a": "x"}
    assert wide[2].dt == datetime.date(2020, 2, 1) and wide[2].failures_ == "x" and wide[2].ok_in is None and wide[2].failures == {"ok_in": None}
    empty = widen(resolve(table.limit(0), "ent", "name", "value", "at", DEFS), DEFS, "ent")
    assert empty.count() == 0 and empty.columns == ["ent", "qt_a", "pct", "ok_in", "dt", "failures_", "failures"]


def test_values_that_no_column_holds_are_kept(spark):
    rows = [(1, "qt_a", "9" * 45, T1), (1, "pct", "x", T1), (2, "qt_a", "0" * 30 + "9" * 20, T1), (2, "dt", "2020-02-30", T1), (3, "QT-A", "1." + ".".join(["000"] * 14), T1), (4, "pct", "1", T1)]
    resolved = resolve(spark.createDataFrame(rows, "ent bigint, name string, value string, at timestamp"), "ent", "name", "value", "at", DEFS)
    wide = widen(resolved, DEFS, "ent")
    out = {r.ent: r for r in wide.collect()}
    assert out[1].qt_a is None and out[1].failures == {"qt_a": "9" * 45, "pct": "x"}
    assert out[2].qt_a == int("9" * 20) and out[2].failures == {"dt": "2020-02-30"}
    assert out[3].qt_a is None and out[3].failures == {"qt_a": rows[4][2]} and out[4].failures == {}
    assert {(r.ent, r.attr_name) for r in filled_cells(wide, DEFS, "ent").collect()} == {(1, "qt_a"), (2, "qt_a"), (3, "qt_a"), (4, "pct")}
    assert filled_cells(wide.limit(0), DEFS, "ent").count() == 0


def test_names_with_signs_of_sql_in_them(spark):
    odd = [Attribute("it's", "string"), Attribute("a`b", "int"), Attribute("back\\slash", "decimal"), Attribute("ent", "date")]
    rows = [(1, a.name, v, T1) for a, v in zip(odd, ("x", "5", "1,5", "20200229"))]
    resolved = resolve(spark.createDataFrame(rows, "ent bigint, name string, value string, at timestamp"), "ent", "name", "value", "at", odd)
    wide = widen(resolved, odd, "ent")
    assert wide.columns == ["ent", "it's", "a`b", "back\\slash", "ent_", "failures"]
    assert tuple(wide.first())[:5] == (1, "x", 5, 1.5, datetime.date(2020, 2, 29))
    assert {r.attr_name for r in filled_cells(wide, odd, "ent").collect()} == {a.name for a in odd}
