import struct

import pytest
from pyspark.sql import functions as F

from dasymetra.operators import labels
from dasymetra.operators import od as times
from dasymetra.sources import staged


def _polygon(rings, order="<", kind=3, extra=0):
    out = struct.pack(order.replace("<", "<") + "BI", 1 if order == "<" else 0, kind) + struct.pack(order + "I", len(rings))
    for r in rings:
        out += struct.pack(order + "I", len(r)) + b"".join(struct.pack(f"{order}{2 + extra}d", *p, *[9.0] * extra) for p in r)
    return out


def test_well_known_binary(spark):
    ring, hole = [(0, 0), (4, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    want = [[(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]]
    multi = struct.pack("<BII", 1, 6, 2) + _polygon([ring]) + _polygon([hole], ">")
    cases = {"a": _polygon([ring, hole]), "b": _polygon([ring, hole], ">"), "c": multi, "z": _polygon([ring, hole], kind=1003, extra=1), "zm": _polygon([ring, hole], kind=0xC0000003, extra=2)}
    bad = {"point": struct.pack("<BIdd", 1, 1, 0.0, 0.0), "short": cases["a"][:30], "empty": b"", "null": None}
    table = spark.createDataFrame([(k, v) for k, v in {**cases, **bad}.items()], "k string, geometry binary")
    out = {r.k: None if r.rings is None else [[(p.x, p.y) for p in x] for x in r.rings] for r in staged.with_rings(table).collect()}
    assert out == {k: want for k in cases} | {k: None for k in bad}
    assert staged.wkb_rings(_polygon([[(0, 0), (1, 1), (0, 0)]])) == []


def test_what_is_missing_is_none(spark, tmp_path):
    assert staged.read_optional(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").write_text("x")
    assert staged.read_optional(spark, str(tmp_path / "bad")) is None
    spark.range(3).write.parquet(str(tmp_path / "good"))
    assert staged.read_optional(spark, str(tmp_path / "good")).count() == 3
    assert staged.preferred(["a_RJ.csv", "a_BRASIL.CSV", "a_SP.csv"]) == ["a_BRASIL.CSV"] and staged.preferred(["b.csv", "a.csv"]) == ["a.csv", "b.csv"]
    with pytest.raises(ValueError, match="NR_SECAO"):
        staged.profile(spark.range(1).select(F.lit("1").alias("CD_MUNICIPIO"), F.lit("1").alias("NR_ZONA"), F.lit("x").alias("DS_FAIXA_ETARIA"), F.lit("1").alias("QT_ELEITORES_PERFIL")))


def test_labels(spark):
    rows = [("C", "candidate", "MARIA DA SÉ", "PT", "13"), ("D", "candidate", None, None, "13"), ("E", "candidate", "ANA", None, None), ("P", "party", None, "PT", None), ("Q", "party", None, None, None), ("T", "turnout", None, None, None)]
    d = spark.createDataFrame(rows, "column string, type string, candidate_name string, party string, ballot_number string")
    got = {r["column"]: (r.t, r.s) for r in d.select("column", labels.title(*[F.col(c) for c in ("column", "type", "candidate_name", "party", "ballot_number")]).alias("t"), labels.label(F.col("type"), F.col("candidate_name"), F.col("party")).alias("s")).collect()}
    assert got == {"C": ("Maria da Sé (PT — 13)", "MARIA DA SÉ (PT)"), "D": ("D", ""), "E": ("Ana", "ANA"), "P": ("PT", "PT"), "Q": ("Q", ""), "T": ("turnout", "turnout")}
    assert labels.subtitle("Itó", "TO", 2020, 1, [11], "pct_valid", "jenks") == "Itó (TO) — 2020 — 1º turno — prefeito — % of valid votes — Jenks" and labels.subtitle() == ""
    assert labels.default_column(d.filter("column IN ('P', 'T')"), ["T", "P"]) == "P" and labels.default_column(None, ["T"]) == "T"
    blank = spark.createDataFrame([("CAND_95", "candidate", "95"), ("CAND_13", "candidate", "13")], "column string, type string, ballot_number string")
    assert labels.default_column(blank, ["CAND_95", "CAND_13"]) == "CAND_13" and labels.default_column(blank, ["CAND_95"]) == "CAND_95"
    assert labels.popup_columns([f"pop_{k}" for k in range(12)] + ["id", "v", "QT_APTOS"], "id", "v", [f"pop_{k}" for k in range(12)]) == ["id", "v", "QT_APTOS", *[f"pop_{k}" for k in range(5)]]


def test_dictionary_from_names(spark):
    names = ["PRESIDENTE_CAND_13", "CAND_95", "DEPUTADO_FEDERAL_PARTY_PT", "PARTY_A_B", "QT_APTOS", "votantes_20", "EDUC_SUP"]
    columns = spark.createDataFrame([(n,) for n in names], "column string")
    out = {r["column"]: (r.type, r.cargo, r.ballot_number, r.candidate_name, r.party) for r in labels.assemble(None, columns, columns.filter("column = 'votantes_20'")).collect()}
    assert out == {"PRESIDENTE_CAND_13": ("candidate", "presidente", "13", None, None), "CAND_95": ("candidate", None, "95", "Votos em Branco", None), "DEPUTADO_FEDERAL_PARTY_PT": ("party", "deputado_federal", None, None, "PT"),
                   "PARTY_A_B": ("party", None, None, None, "A_B"), "QT_APTOS": ("turnout", None, None, None, None), "votantes_20": ("calibration", None, None, None, None), "EDUC_SUP": ("demographics", None, None, None, None)}


def test_spreads_and_densities_of_odd_tables(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (100.0,), (None,)], "v double")
    r = times.spread(rows, F.col("v")).first()
    assert (r.n, r.q50, r.low, r.high, r.n_outside) == (5, 3.0, 1.0, 4.0, 1)
    assert times.spread(rows.limit(0), F.col("v")).count() == 0 == times.density(rows.limit(0), F.col("v")).count()
    curve = times.density(rows, F.col("v"), 2000).orderBy("x").collect()
    assert sum((b.x - a.x) * (a.density + b.density) / 2 for a, b in zip(curve, curve[1:])) == pytest.approx(1, abs=0.01)
