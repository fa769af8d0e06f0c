"""Queries p1, p2, p4 and p5: the core operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dasymetra.operators import attributes as attr
from dasymetra.operators import integrity, proximity
from dasymetra.plans.common import cut_lineage, table
from dasymetra.sources import delimited

NEAR_METRES = 100.0
#: Columns that a wide table may have at most; more ballot numbers than that are an error, not a wider plan.
MOST_COLUMNS = 5_000


def _parsed(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    return delimited.parse_lines(table(spark, sf_dir, "raw_lines"), keep=keep)


def p1_found(spark, sf_dir):
    return _parsed(spark, sf_dir, ["line_id"]).filter(F.col("reason").isNotNull()).select("line_id")


def p1_rejects(spark, sf_dir):
    """The rejected lines themselves, with reason and field, for the sender of the file."""
    out = _parsed(spark, sf_dir, ["line_id", "feed", "file_name", "line_no", "line"])
    return out.filter(F.col("reason").isNotNull()).select("line_id", "feed", "file_name", "line_no", "line", "reason", "at_field")


def p1_report(spark, sf_dir):
    """Lines per file, and how many of them loaded."""
    out = _parsed(spark, sf_dir, ["feed", "file_name"])
    return out.groupBy("feed", "file_name").agg(F.count(F.lit(1)).alias("n_lines"), F.count("fields").alias("n_loaded"), F.count("reason").alias("n_rejected"))


def p1_loaded_geocode(spark, sf_dir):
    out = _parsed(spark, sf_dir, ["line_id", "feed"]).filter(F.col("feed") == "geocode_locs")
    return delimited.loaded_rows(out, delimited.FEEDS["geocode_locs"], ["line_id"])


def p1_loaded_merged(spark, sf_dir):
    out = _parsed(spark, sf_dir, ["line_id", "feed"]).filter(F.col("feed") == "merged")
    return delimited.loaded_rows(out, delimited.FEEDS["merged"], ["line_id"])


def _locations(spark, sf_dir):
    return proximity.located(table(spark, sf_dir, "geocode_locs"), "loc_id", "lat", "long")


def p2_found(spark, sf_dir):
    points = _locations(spark, sf_dir)
    near = proximity.near_pairs(points, NEAR_METRES).select(F.col("id_a").alias("loc_id"), F.lit("near").alias("kind"), F.col("id_b").cast("string").alias("other_key"))
    cover = cut_lineage(proximity.cover_regions(table(spark, sf_dir, "tracts_sf"), "code_tract", "rings"))
    held = proximity.points_in_regions(points, cover).select(F.col("id").alias("loc_id"), F.lit("in").alias("kind"), F.col("region").alias("other_key"))
    return near.unionByName(held)


def p2_tract_counts(spark, sf_dir):
    """Locations in each tract."""
    cover = cut_lineage(proximity.cover_regions(table(spark, sf_dir, "tracts_sf"), "code_tract", "rings"))
    held = proximity.points_in_regions(_locations(spark, sf_dir), cover)
    return held.groupBy(F.col("region").alias("code_tract")).agg(F.count(F.lit(1)).alias("n_locations"))


def _references(spark, sf_dir):
    merged, places = (table(spark, sf_dir, t) for t in ("merged", "geocode_locs"))
    key = lambda: (F.col("cod_mun_tse"), integrity.whole_number(F.col("nr_zona")), integrity.whole_number(F.col("nr_local_votacao")))
    refer = lambda df: df.filter(F.col("nr_zona").isNotNull() & F.col("nr_local_votacao").isNotNull())
    return key(), [integrity.Reference("merged", refer(merged), key(), F.col("row_id"), F.col("loaded_at"), F.col("ano_eleicao")),
                   integrity.Reference("geocode_locs", refer(places), key(), F.col("loc_id"), F.col("loaded_at"), F.col("ano"))]


def _orphans(spark, sf_dir):
    key, references = _references(spark, sf_dir)
    return integrity.orphan_references(table(spark, sf_dir, "locais_votacao"), key, F.col("loaded_at"), F.col("deleted_at"), references, "locais_votacao")


def p4_found(spark, sf_dir):
    return _orphans(spark, sf_dir).select("tab_name", "rec_id", "state").distinct()


def p4_report(spark, sf_dir):
    key, references = _references(spark, sf_dir)
    missing = integrity.missing_counts(table(spark, sf_dir, "locais_votacao"), key, references, "locais_votacao")
    return integrity.orphan_report(_orphans(spark, sf_dir), "locais_votacao", missing)


def _definitions(spark, sf_dir) -> list[attr.Attribute]:
    """attr_defs: a fixed table of a few dozen rows."""
    rows = table(spark, sf_dir, "attr_defs").select("attr_name", "attr_type").distinct().orderBy("attr_name").limit(MOST_COLUMNS + 1).collect()
    return [attr.Attribute(r.attr_name, r.attr_type) for r in rows]


def _with_ballots(spark, sf_dir) -> list[attr.Attribute]:
    """The attributes of attr_defs and one of type int for every other ballot number that the dictionary uses."""
    out = _definitions(spark, sf_dir)
    numbers = table(spark, sf_dir, "dictionary").select(F.trim("ballot_number").alias("n")).filter(F.col("n").rlike("^[0-9]+$")).distinct().orderBy("n")
    known = {a.name for a in out}
    out += [attr.Attribute(f"cand_{r.n}", "int") for r in numbers.limit(MOST_COLUMNS + 1).collect() if f"cand_{r.n}" not in known]
    if len(out) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} attributes")
    return out


def _resolved(spark, sf_dir, attributes):
    return attr.resolve(table(spark, sf_dir, "secao_attrs"), "ent_id", "attr_name", "attr_value", "loaded_at", attributes)


def p5_found(spark, sf_dir):
    """The filled cells of the wide table, read from its typed columns."""
    attributes = _definitions(spark, sf_dir)
    return attr.filled_cells(attr.widen(_resolved(spark, sf_dir, attributes), attributes, "ent_id"), attributes, "ent_id")


def p5_wide(spark, sf_dir):
    attributes = _with_ballots(spark, sf_dir)
    wide = attr.widen(_resolved(spark, sf_dir, attributes), attributes, "ent_id")
    return wide.withColumn("failures", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("failures")))))


def p5_failures(spark, sf_dir):
    out = _resolved(spark, sf_dir, _definitions(spark, sf_dir))
    return out.select(F.col("entity").alias("ent_id"), F.explode("failures").alias("attr_name", "attr_value"))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_rejects, p1_report, p1_loaded_geocode, p1_loaded_merged, p2_found, p2_tract_counts,
    p4_found, p4_report, p5_found, p5_wide, p5_failures)}
